"""Wind-weighted neighbour features, wind-conditioned edges and repair of missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geo
from ..functions.scalar import text_seed_order
from ..session import materialize
from . import joins, ranking, series

DECAY_KM = 10.0
GAP_HOURS = 3


def _influence(targets: DataFrame, near: DataFrame, hour: str, value: str) -> DataFrame:
    """Targets (wind_u, wind_v) with the weighted sums over their neighbours' readings of the hour.

    One join and one aggregation on the same key: the second needs no further shuffle, and the other
    target columns ride along.
    """
    keys = ["station_id", hour]
    rest = [c for c in targets.columns if c not in keys]
    near = near.select(*keys, F.col(value).alias("_v"), "dist_m", "north", "east").filter(
        F.col("_v").isNotNull() & (F.col("dist_m") > 0))
    align = geo.alignment(F.col("north"), F.col("east"), F.col("wind_u"), F.col("wind_v"))
    joined = targets.join(near, keys, "left").withColumn("_a", F.when(F.col("_v").isNotNull(), align))
    joined = joined.withColumn("_w", F.when(F.col("_v").isNotNull(), geo.edge_weight(F.col("dist_m"), F.col("_a"))))
    return joined.groupBy(*keys).agg(
        *[F.any_value(c).alias(c) for c in rest],
        F.try_divide(F.sum(F.col("_w") * F.col("_v")), F.sum("_w")).alias("_estimate"),
        F.max(F.hypot("wind_u", "wind_v") * F.col("_a")).alias("_transport"),
        F.avg("_a").alias("_align"))


def diffusion_features(targets: DataFrame, readings: DataFrame, edges: DataFrame, hour: str = "hour",
                       value: str = "pm25") -> DataFrame:
    """Append upwind_pm25, transport_potential and wind_alignment; all 0 without a usable neighbour."""
    out = _influence(targets, joins.neighbour_readings(readings, edges, value, hour), hour, value)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return out.withColumns({
        "upwind_pm25": zero("_estimate"), "transport_potential": zero("_transport"),
        "wind_alignment": zero("_align")}).drop("_estimate", "_transport", "_align")


def spatial_estimate(targets: DataFrame, readings: DataFrame, edges: DataFrame, hour: str = "hour",
                     value: str = "pm25", name: str = "spatial_estimate") -> DataFrame:
    """Append the wind-weighted mean of the neighbours, null without a usable one."""
    out = _influence(targets, joins.neighbour_readings(readings, edges, value, hour), hour, value)
    return out.withColumnRenamed("_estimate", name).drop("_transport", "_align")


def adjacency(edges: DataFrame, wind: DataFrame, hour: str = "hour", decay_km: float = DECAY_KM) -> DataFrame:
    """Edge weights that decay with distance and favour the direction of the source's wind."""
    w = wind.select(F.col("station_id").alias("src"), hour, "wind_u", "wind_v")
    along = F.try_divide(F.col("north") * F.col("wind_u") + F.col("east") * F.col("wind_v"), F.hypot("north", "east"))
    clipped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), along))
    weight = F.exp(-F.col("dist_m") / 1000 / decay_km) * (0.5 + 0.5 * clipped)
    return w.join(edges, "src").filter(along.isNotNull()).select(hour, "src", "dst", weight.alias("weight"))


def dynamic_edges(edges: DataFrame, wind: DataFrame, on: str = "network", hour: str = "hour") -> DataFrame:
    """Edges of a network under the one wind that holds for it in an hour.

    Uses the raw dot product with the wind, so the weight is not bounded by the distance term.
    """
    along = (F.col("north") * F.col("wind_u") + F.col("east") * F.col("wind_v")) / F.hypot("north", "east")
    return wind.select(on, hour, "wind_u", "wind_v").join(edges, on).select(
        on, hour, "src", "dst", geo.edge_weight(F.col("dist_m"), along).alias("weight"))


def knn_edges(stations: DataFrame, k: int = 3) -> DataFrame:
    """Edges from each station to its ``k`` nearest others, with the displacement from src to dst.

    Stations without coordinates have none.
    """
    stations = materialize(stations.select("station_id", "lat", "lon"))
    near = joins.nearest_k(stations, stations, k, "station_id", "station_id", exclude_self=True)
    at = lambda key, n: stations.select(F.col("station_id").alias(key), F.col("lat").alias(f"la{n}"), F.col("lon").alias(f"lo{n}"))
    placed = near.withColumnsRenamed({"station_id": "src", "neighbor_id": "dst"}).join(at("src", 1), "src").join(at("dst", 2), "dst")
    north, east = geo.north_east_m(*[F.col(c) for c in ("la1", "lo1", "la2", "lo2")])
    return placed.select("src", "dst", "dist_m", north.alias("north"), east.alias("east"))


def neighbour_edges(stations: DataFrame, k: int = 3) -> DataFrame:
    """Edges from the ``k`` nearest other stations to each station, as the diffusion and recovery operators take them.

    Their number grows with the stations, not with the square. Co-located stations are no neighbours.
    """
    stations = materialize(stations.select("station_id", "lat", "lon"))
    e = knn_edges(stations, k).filter("dist_m > 0")
    at = lambda key, n: stations.select(F.col("station_id").alias(key), F.col("lat").alias(f"la{n}"), F.col("lon").alias(f"lo{n}"))
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist_m").join(at("src", 1), "src").join(at("dst", 2), "dst")
    north, east = geo.north_east_m(*[F.col(c) for c in ("la1", "lo1", "la2", "lo2")])
    return back.select("src", "dst", "dist_m", north.alias("north"), east.alias("east"))


def choose_recovery(value: Column, spatial: Column, temporal: Column, gap_hours: Column,
                    threshold_hours: float = GAP_HOURS) -> tuple[Column, Column]:
    """(value, method): neighbours while the gap is short, else the last own value."""
    near = (gap_hours <= threshold_hours) & spatial.isNotNull()
    filled = F.coalesce(value, F.when(near, spatial).otherwise(temporal))
    method = (F.when(value.isNotNull(), "observed").when(near, "spatial")
              .when(temporal.isNotNull(), "temporal").otherwise("none"))
    return filled, method


def recover(targets: DataFrame, readings: DataFrame, edges: DataFrame, hour: str = "hour",
            value: str = "pm25", threshold_hours: float = GAP_HOURS) -> DataFrame:
    """Fill the nulls of ``value`` and say how.

    ``targets``: one row per station and hour, gaps included, with wind_u and wind_v. The gap is the
    event time since the station's last reading.
    """
    # Stored: looking back passes over it twice.
    held = series.last_known_before(materialize(targets), ["station_id"], hour, value)
    full = spatial_estimate(held, readings, edges, hour, value)
    filled, method = choose_recovery(F.col(value), F.col("spatial_estimate"), F.col("last_value"),
                                     F.col("gap_hours"), threshold_hours)
    return full.withColumns({"recovered": filled, "method": method})


def inject_missing(df: DataFrame, rates: Sequence[float], seed: int, keys: Sequence[str],
                   name: str = "rate") -> DataFrame:
    """Exactly round(n·rate) rows per rate, labelled with it; the same rows for the same seed.

    Rows rank by a hash of seed and key. The hash that ends each sample is found by counting, so no
    step sorts all rows.
    """
    order = text_seed_order(seed, *[F.col(k) for k in keys])
    size = lambda r: F.bround(F.col("n") * F.lit(float(r)))
    cuts = ranking.rank_cuts(df, [F.substring(order, 1, 2), F.substring(order, 3, 2)],
                             [order, *[F.col(k) for k in keys]],
                             {f"c{i}": size(r) for i, r in enumerate(rates)})
    ends = cuts.select(F.struct("*")).scalar()
    hits = F.filter(F.array(*[
        F.when(ranking.up_to([order, *[F.col(k) for k in keys]], F.col(f"_ends.c{i}")), F.lit(float(r)))
        for i, r in enumerate(rates)]), lambda r: r.isNotNull())
    return df.withColumn("_ends", ends).withColumn(name, F.explode(hits)).drop("_ends")


def evaluate_recovery(targets: DataFrame, readings: DataFrame, edges: DataFrame, rates: Sequence[float],
                      seed: int = 0, hour: str = "hour", value: str = "pm25",
                      mask_history: bool = False) -> DataFrame:
    """MAE, RMSE and number of repaired rows per share of blanked readings.

    The neighbours' estimate does not depend on which rows are blanked, so it is computed once. The
    own history holds the true values; ``mask_history`` hides blanked ones there too.
    """
    keys = ["station_id", hour]
    truth = targets.filter(F.col(value).isNotNull())
    base = spatial_estimate(truth, readings, edges, hour, value)
    if not mask_history:
        # Stored: drawing the samples passes over it three times.
        base = materialize(series.last_known_before(base, ["station_id"], hour, value, gap=None))
        blank = inject_missing(base, rates, seed, keys)
    else:
        marked = inject_missing(truth.select(*keys), rates, seed, keys).withColumn("_blank", F.lit(True))
        blank = base.withColumn("rate", F.explode(F.array(*[F.lit(float(r)) for r in rates])))
        blank = blank.join(marked, [*keys, "rate"], "left").withColumn(
            "_shown", F.when(F.col("_blank").isNull(), F.col(value)))
        blank = series.last_known_before(blank, ["rate", "station_id"], hour, "_shown", gap=None).filter("_blank")
    err = F.coalesce(F.col("spatial_estimate"), F.col("last_value")) - F.col(value)
    return blank.withColumn("_err", err).groupBy("rate").agg(
        F.avg(F.abs("_err")).alias("mae"), F.sqrt(F.avg(F.col("_err") ** 2)).alias("rmse"),
        F.count("_err").alias("n"))
