import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gustline.operators import aggregates, series
from gustline.plans import frames
from gustline.session import materialize

N = 900
SPAN = 86400 * 10


@pytest.fixture(scope="module")
def data(spark):
    """Three series; one holds most rows. Blocks below are far smaller than the series."""
    rng = np.random.default_rng(1)
    p = pd.DataFrame({"k": rng.choice(["a", "b", "c"], N, p=[0.8, 0.17, 0.03]), "h": rng.permutation(N * 3)[:N], "v": rng.normal(size=N)})
    p.loc[rng.random(N) < 0.4, "v"] = np.nan
    p["ts"] = pd.Timestamp("2020-01-01") + pd.to_timedelta(p.h, unit="h")
    df = spark.createDataFrame(p[["k", "ts", "v"]]).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).cache()
    return df, p.sort_values(["k", "ts"]).reset_index(drop=True)


def same(df, col, expected):
    got = df.orderBy("k", "ts").toPandas()[col].astype(float).to_numpy()
    np.testing.assert_allclose(got, expected.astype(float).to_numpy(), rtol=1e-9, atol=1e-12)


def test_lags_leads_rolls(data):
    df, p = data
    g = p.groupby("k").v
    out = series.features(df, ["k"], "ts", lags={"v": [1, 12]}, rolls={"v": [3]}, stats=("mean", "std", "min", "max"),
                          leads={"v": [5]}, block_rows=32)
    same(out, "v_lag1", g.shift(1))
    same(out, "v_lag12", g.shift(12))
    same(out, "v_lead5", g.shift(-5))
    for stat in ("mean", "std", "min", "max"):
        same(out, f"v_roll3_{stat}", g.transform(lambda s: getattr(s.rolling(3, min_periods=1), stat)()))


def test_fills(data):
    df, p = data
    g = p.groupby("k").v
    same(series.fill(df, ["k"], "ts", ["v"], block_rows=5), "v", g.ffill())
    same(series.fill(df, ["k"], "ts", ["v"], backward=True, default=0.0, block_rows=5), "v",
         g.transform(lambda s: s.ffill().bfill()).fillna(0.0))


def test_interpolation(data):
    df, p = data
    same(series.interpolate_by_row(df, ["k"], "ts", ["v"], block_rows=16), "v",
         p.groupby("k").v.transform(lambda s: s.interpolate(limit_direction="forward").ffill()))
    by_time = p.set_index("ts").groupby("k").v.transform(lambda s: s.interpolate(method="time").ffill().bfill())
    same(series.interpolate_by_time(df, ["k"], "ts", ["v"], block_rows=5), "v", by_time.reset_index().v)


def test_last_known_and_gap(data):
    df, p = data
    out = series.last_known_before(df, ["k"], "ts", "v", block_rows=5)
    same(out, "last_value", p.groupby("k").v.transform(lambda s: s.ffill().shift(1)))
    known = p.h.where(p.v.notna())
    same(out, "gap_hours", p.h - known.groupby(p.k).transform(lambda s: s.ffill().shift(1)))


def test_history_grows_to_its_length(data):
    df, p = data
    out = series.history(df, ["k"], "ts", F.coalesce("v", F.lit(0.0)), 24, block_rows=24)
    same(out.withColumn("n", F.size("history")), "n", (p.groupby("k").cumcount() + 1).clip(upper=24))
    before = series.history(df, ["k"], "ts", F.coalesce("v", F.lit(0.0)), 5, include_current=False, block_rows=8)
    same(before.withColumn("n", F.size("history")), "n", p.groupby("k").cumcount().clip(upper=5))


def test_spine_shows_gaps(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:10:00", 1.0), ("a", "2024-01-01 00:40:00", 3.0), ("a", "2024-01-01 03:00:00", 5.0)],
                               "k string, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    out = aggregates.resample_hourly(df, ["k"], "ts", ["v"]).orderBy("hour").collect()
    assert [r.v for r in out] == [2.0, None, None, 5.0]


def test_generated_hours_are_gapless(spark):
    out = series.generated_hours(spark.range(500).orderBy(F.desc("id")), ["id"])
    hours = sorted(r[0] for r in out.select(F.unix_timestamp("timestamp") / 3600).collect())
    assert hours == [hours[0] + i for i in range(500)]
    assert [r[0] for r in out.orderBy("timestamp").select("id").collect()] == list(range(500))


def test_sequences_match_a_loop(data):
    df, p = data
    out = frames.sequences(df.withColumnRenamed("ts", "timestamp"), ["v"], "v", history=3, label_offset=1, keys=["k"], block_rows=8)
    got = sorted((r.k, r.timestamp, [x[0] for x in r.window], r.label) for r in out.collect())
    want = []
    for k, s in p.groupby("k"):
        v, t = s.v.to_numpy(), s.ts.to_numpy()
        for i in range(3, len(v) - 1):
            if not np.isnan(v[i - 3:i]).any() and not np.isnan(v[i + 1]):
                want.append((k, pd.Timestamp(t[i]).to_pydatetime(), list(v[i - 3:i]), v[i + 1]))
    assert got == sorted(want)


def test_first_lags_take_the_first_value(spark):
    rows = [("a", f"2024-01-01 {h:02d}:00:00", float(h + 1)) for h in range(5)]
    df = spark.createDataFrame(rows, "station_id string, timestamp string, pm25 double")
    out = frames.prepare_training(df).orderBy("timestamp").collect()
    assert [r.pm25_lag2 for r in out] == [1.0, 1.0, 1.0, 2.0, 3.0]
    assert [r.pm25_lag6 for r in out] == [0.0] * 5
    assert [r.pm25_roll3_mean for r in out] == [1.0, 1.5, 2.0, 3.0, 4.0]


def test_given_wind_is_kept(spark):
    df = spark.createDataFrame([("a", "2024-01-01", 1.0, 2.5, -1.5), ("a", "2024-01-02", 2.0, 3.5, -2.5)],
                               "station_id string, timestamp string, pm25 double, wind_u double, wind_v double")
    assert {(r.wind_u, r.wind_v) for r in frames.prepare_training(df).collect()} == {(2.5, -1.5), (3.5, -2.5)}
    assert {(r.wind_u, r.wind_v) for r in frames.prepare_training(df.drop("wind_u")).collect()} == {(0.0, 0.0)}


def test_a_busy_day_is_many_blocks(spark):
    """One station has a third of all rows within one day, most of them in one hour."""
    busy = spark.range(9000).select(F.lit("busy").alias("k"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.when(F.col("id") < 6000, F.col("id") * 500_000).otherwise(
        F.col("id") * 8_000_000)).alias("ts"), F.col("id").cast("double").alias("v"))
    calm = spark.range(18000).select((F.col("id") % 60).cast("string").alias("k"), F.timestamp_micros(F.lit(1_600_000_000_000_000) + F.col("id") * 60_000_000_000).alias("ts"),
                                     F.col("id").cast("double").alias("v"))
    out = series.with_blocks(busy.unionByName(calm), ["k"], "ts", 500)
    sizes = [r["count"] for r in out.groupBy("k", "_blk").count().collect()]
    assert max(sizes) <= 1100 and len([s for s in sizes if s > 100]) >= 15
    pos = series.with_position(busy.unionByName(calm), ["k"], "ts", ["v"], block_rows=500).filter("k = 'busy'")
    assert [r["v"] for r in pos.orderBy("pos").select("v").collect()] == [float(i) for i in range(9000)]
    assert [r["pos"] for r in pos.orderBy("pos").select("pos").collect()] == list(range(9000))


def test_hours_of_a_small_file_are_not_broadcast(spark):
    """Many rows may be few bytes in a file: one constant column, one null, hours that follow each other."""
    stored = materialize(spark.range(20_000).select(
        F.lit("a").alias("k"), F.timestamp_add("HOUR", "id", F.timestamp_seconds(F.lit(0))).alias("ts"), F.when(F.col("id") % 1000 == 0, 1.0).alias("v")))
    out = series.last_known_before(stored, ["k"], "ts", "v")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert all("LeftOuter" in x for x in plan.splitlines() if "BroadcastHashJoin" in x)  # those of crowded hours, few by their count
    assert out.agg(F.count("*"), F.count("last_value"), F.max("gap_hours")).first() == (20_000, 19_999, 1000.0)
