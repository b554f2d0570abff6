import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from gustline.operators import diffusion, joins

HOUR = datetime(2024, 1, 1, 5)


def haversine(a, b):
    (p1, l1), (p2, l2) = [(math.radians(x), math.radians(y)) for x, y in (a, b)]
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin((l2 - l1) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(h))


def points(kind, n=70):
    rng = np.random.default_rng(4)
    if kind == "globe":
        return [(float(a), float(b)) for a, b in zip(rng.uniform(-89, 89, n), rng.uniform(-180, 180, n))]
    if kind == "city":  # a third in one block, the rest scattered
        near = [(43.6 + float(x) * 1e-3, -79.4 + float(y) * 1e-3) for x, y in rng.random((n // 3, 2))]
        return near + [(float(a), float(b)) for a, b in zip(rng.uniform(40, 47, n - len(near)), rng.uniform(-84, -74, n - len(near)))]
    return [(43.6, -79.4)] * (n // 3) + [(43.6 + 0.01 * i + 1e-4 * i * i, -79.4) for i in range(1, n - n // 3 + 1)]  # copies of one place


@pytest.mark.parametrize("kind", ["globe", "city", "copies"])
@pytest.mark.parametrize("k", [1, 3])
def test_k_nearest_equals_brute_force(spark, kind, k):
    at = points(kind)
    df = spark.createDataFrame([(f"s{i:03d}", *p) for i, p in enumerate(at)], "station_id string, lat double, lon double")
    got = {}
    for r in diffusion.knn_edges(df, k).collect():
        got.setdefault(r.src, []).append((round(r.dist_m, 4), r.dst))
    for i, p in enumerate(at):
        want = sorted((round(haversine(p, q), 4), f"s{j:03d}") for j, q in enumerate(at) if j != i)[:k]
        assert sorted(got[f"s{i:03d}"]) == want


@pytest.mark.parametrize("kind", ["globe", "city", "copies"])
def test_many_queries_and_points_are_shuffled_and_equal_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(joins, "FEW", 10)
    monkeypatch.setattr(joins, "QUERIES", 8)
    at = points(kind)
    df = spark.createDataFrame([(f"s{i:03d}", *p) for i, p in enumerate(at)], "id string, lat double, lon double")
    near = joins.nearest_k(df, df.withColumnRenamed("id", "other"), 2, "id", "other")
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 2 and "REPARTITION_BY_NUM" in plan
    got = {}
    for r in near.collect():
        got.setdefault(r.id, []).append((round(r.dist_m, 4), r.other))
    for i, p in enumerate(at):
        assert sorted(got[f"s{i:03d}"]) == sorted((round(haversine(p, q), 4), f"s{j:03d}") for j, q in enumerate(at))[:2]


def test_edges_of_crowded_stations_are_shuffled(spark, monkeypatch):
    """As in the dense query: stations a metre or less apart, more than one task may hold."""
    monkeypatch.setattr(joins, "FEW", 10)
    monkeypatch.setattr(joins, "QUERIES", 50)
    at = [(43.5 + 1e-5 * (i % 13) + 1.3e-7 * i, -79.8 + 1e-5 * (i * 5 % 11) + 1.7e-7 * i) for i in range(200)]
    df = spark.createDataFrame([(f"u-{i}", *p) for i, p in enumerate(at)], "station_id string, lat double, lon double")
    edges = diffusion.neighbour_edges(df, 3)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("SortMergeJoin") >= 2
    want = [(f"u-{j}", f"u-{i}") for i, p in enumerate(at)
            for _, j in sorted((haversine(p, q), j) for j, q in enumerate(at) if j != i)[:3]]
    assert rows(edges, "src", "dst") == sorted(want, key=repr)


def test_points_beyond_the_cube_that_bounds_the_search_are_not_ranked(spark):
    """Five queries at one end of a crowded street: the cubes around them hold hundreds of points."""
    at = [(43.6 + 1e-7 * i, -79.4) for i in range(4000)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "other int, lat double, lon double")
    qs = df.filter("other < 5").withColumnRenamed("other", "id")
    near = joins.nearest_k(qs, df, 3, "id", "other")
    assert "_reach" in near._jdf.queryExecution().optimizedPlan().toString()
    assert rows(near, "id", "other") == sorted((i, j) for i in range(5) for j in sorted(range(4000), key=lambda j: (abs(i - j), j))[:3])


def test_an_id_at_several_places_is_not_its_own_neighbour(spark):
    df = spark.createDataFrame([("a", 43.6 + 1e-6 * i, -79.4) for i in range(6)] + [("b", 43.601, -79.4), ("c", 43.602, -79.4)], "id string, lat double, lon double")
    near = joins.nearest_k(df, df, 2, "id", "id", exclude_self=True)
    assert rows(near.filter("id = 'a'"), "neighbor_id") == rows(near.filter("id = 'a' AND neighbor_id <> 'a'"), "neighbor_id")


def test_fewer_points_than_k_and_no_coordinates(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.1, 1.0), ("c", None, 1.0)], "station_id string, lat double, lon double")
    assert rows(diffusion.knn_edges(df, 5), "src", "dst") == [("a", "b"), ("b", "a")]


def test_pairs_within_radius(spark):
    at = points("city")
    df = spark.createDataFrame([(f"s{i}", *p) for i, p in enumerate(at)], "station_id string, lat double, lon double")
    got = {(r.src, r.dst) for r in joins.station_pairs(df, 80_000).collect()}
    want = {(f"s{i}", f"s{j}") for i, p in enumerate(at) for j, q in enumerate(at) if i != j and 0 < haversine(p, q) <= 80_000}
    assert got == want


def stations(spark):
    return spark.createDataFrame([("t", 43.645, -79.389), ("w", 43.709, -79.543), ("n", 43.780, -79.467)], "station_id string, lat double, lon double")


def met(spark, reports):
    return spark.createDataFrame(reports, "met_id string, hour timestamp, lat double, lon double, wind_speed double")


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_met(spark, k):
    """With k=1 the second hour must find the far station beyond the k nearest."""
    late = datetime(2024, 1, 1, 6)
    m = met(spark, [("far", HOUR, 44.5, -80.0, 1.0), ("near", HOUR, 43.65, -79.39, 2.0), ("blind", HOUR, None, -79.39, 9.0),
                    ("far", late, 44.5, -80.0, 3.0)])
    targets = spark.createDataFrame([("t", HOUR), ("t", late), ("t", datetime(2024, 1, 2))], "station_id string, hour timestamp")
    out = joins.nearest_met(targets, stations(spark), m, ["wind_speed"], k=k)
    assert sorted(rows(out, "met_id", "wind_speed"), key=repr) == sorted([("near", 2.0), ("far", 3.0), (None, None)], key=repr)


def test_as_of_looks_back_any_time(spark):
    m = met(spark, [("near", HOUR, 43.65, -79.39, 2.0)])
    targets = spark.createDataFrame([("t", datetime(2024, 1, 1, 4)), ("t", datetime(2024, 1, 1, 9))], "station_id string, hour timestamp")
    held = joins.met_as_of(m, ["wind_speed"], targets.select(F.max("hour")).scalar())
    out = joins.nearest_met(targets, stations(spark), held, ["wind_speed"]).orderBy("hour").collect()
    assert [r.wind_speed for r in out] == [None, 2.0]


def influence(spark, readings, wind=(3.0, 0.0)):
    edges = joins.station_pairs(stations(spark), 100_000)
    targets = spark.createDataFrame([("t", HOUR, *wind)], "station_id string, hour timestamp, wind_u double, wind_v double")
    r = spark.createDataFrame([(s, HOUR, v) for s, v in readings], "station_id string, hour timestamp, pm25 double")
    return targets, r, edges


def test_one_neighbour_gives_its_value(spark):
    r = diffusion.diffusion_features(*influence(spark, [("w", 20.0), ("n", None)])).first()
    assert r.upwind_pm25 == pytest.approx(20.0) and abs(r.wind_alignment) <= 1


def test_no_neighbour_gives_zeros_or_null(spark):
    r = diffusion.diffusion_features(*influence(spark, [("t", 5.0)])).first()
    assert (r.upwind_pm25, r.transport_potential, r.wind_alignment) == (0.0, 0.0, 0.0)
    assert diffusion.spatial_estimate(*influence(spark, [("t", 5.0)])).first().spatial_estimate is None


@pytest.mark.parametrize("wind", [(0.0, 0.0), (3.0, 4.0), (-2.0, 1.0)])
def test_estimate_lies_between_the_neighbours(spark, wind):
    r = diffusion.spatial_estimate(*influence(spark, [("w", 10.0), ("n", 30.0)], wind)).first()
    assert 10.0 <= r.spatial_estimate <= 30.0


@pytest.mark.parametrize("gap,expect", [(1, ("spatial", 20.0)), (10, ("temporal", 9.0))])
def test_recovery_by_gap(spark, gap, expect):
    targets, r, edges = influence(spark, [("w", 20.0)])
    seen = spark.createDataFrame([("t", datetime(2024, 1, 1, 5) if gap == 0 else HOUR, 0)], "station_id string, h timestamp, x int")
    past = seen.select("station_id", (F.col("h") - F.make_dt_interval(hours=F.lit(gap))).alias("hour"), F.lit(3.0).alias("wind_u"),
                       F.lit(0.0).alias("wind_v"), F.lit(9.0).alias("pm25"))
    full = targets.withColumn("pm25", F.lit(None).cast("double")).unionByName(past)
    out = diffusion.recover(full, r, edges).filter(F.col("hour") == F.lit(HOUR)).first()
    assert out.method == expect[0] and out.recovered == pytest.approx(expect[1])


def test_nothing_to_recover_from(spark):
    targets, r, edges = influence(spark, [("t", None)])
    out = diffusion.recover(targets.withColumn("pm25", F.lit(None).cast("double")), r, edges).first()
    assert (out.recovered, out.method) == (None, "none")


@pytest.mark.parametrize("mask", [False, True])
def test_degradation_counts_and_error(spark, mask):
    n = 100
    hours = spark.range(n).select(F.timestamp_add("HOUR", F.col("id"), F.lit(HOUR)).alias("hour"))
    value = F.lit(10.0)
    targets = hours.select(F.lit("t").alias("station_id"), "hour", F.lit(1.0).alias("wind_u"), F.lit(0.0).alias("wind_v"), value.alias("pm25"))
    readings = targets.select("station_id", "hour", "pm25").unionByName(hours.select(F.lit("w").alias("station_id"), "hour", (value + 0.5).alias("pm25")))
    edges = joins.station_pairs(stations(spark), 100_000)
    out = {r.rate: r for r in diffusion.evaluate_recovery(targets, readings, edges, [0.1, 0.2], seed=1, mask_history=mask).collect()}
    assert (out[0.1].n, out[0.2].n) == (10, 20)
    assert out[0.1].mae == pytest.approx(0.5) and out[0.1].rmse == pytest.approx(0.5)


def test_adjacency_decays_and_skips_copies(spark):
    df = spark.createDataFrame([("a", 43.6, -79.4), ("b", 43.65, -79.4), ("c", 43.9, -79.4), ("d", 43.6, -79.4)], "station_id string, lat double, lon double")
    wind = df.select("station_id", F.lit(HOUR).alias("hour"), F.lit(1.0).alias("wind_u"), F.lit(0.0).alias("wind_v"))
    got = {(r.src, r.dst): r.weight for r in diffusion.adjacency(joins.station_pairs(df, 100_000), wind).collect()}
    assert ("a", "d") not in got and got["a", "b"] > got["a", "c"] > got["b", "a"] >= 0
