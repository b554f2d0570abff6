"""Sensor views over the driver's tables: the inputs every registered query starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geo
from ..operators import diffusion, joins, series
from ..session import materialize

PARAMETERS = {"view": "pm25", "click": "temperature", "purchase": "humidity", "error": "wind_speed", "signup": "wind_dir"}
MET_VALUES = ("wind_speed", "wind_dir", "temperature", "humidity", "dew_point")
# Wider than the network, so its pairs are all pairs.
NETWORK_RADIUS_M = 100_000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a zoned timestamp."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _station() -> F.Column:
    return F.concat(F.lit("st-"), (F.col("user_id") % 8).cast("string"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-format sensor stream."""
    kind = F.create_map(*[F.lit(x) for kv in PARAMETERS.items() for x in kv])
    return events(spark, sf_dir).select(
        "event_id", _station().alias("station_id"), "ts", F.date_trunc("hour", "ts").alias("hour"),
        kind[F.col("event_type")].alias("parameter"), "value",
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("qa"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("user_id") % 8
    return events(spark, sf_dir).select(
        _station().alias("station_id"), (F.lit(43.5) + F.lit(0.05) * i).alias("lat"),
        (F.lit(-79.8) + F.lit(0.06) * (i * 5 % 8)).alias("lon"),
        F.when(i == 0, "target").otherwise("neighbor").alias("role"), F.when(i < 4, "net-0").otherwise("net-1").alias("network")).distinct()


def met(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly weather reports, nulls where nothing was reported."""
    i = F.col("user_id") % 3
    mean = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    return events(spark, sf_dir).groupBy(
        F.concat(F.lit("met-"), i.cast("string")).alias("met_id"), F.date_trunc("hour", "ts").alias("hour")).agg(
        F.min(F.lit(43.6) + F.lit(0.1) * i).alias("lat"), F.min(F.lit(-79.7) + F.lit(0.13) * i).alias("lon"),
        mean("error").alias("wind_speed"), mean("signup").alias("wind_dir"), mean("click").alias("temperature"),
        mean("purchase").alias("humidity"), (mean("view") / 10).alias("dew_point"))


def pm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).filter("parameter = 'pm25'").groupBy("station_id", "hour").agg(
        F.round(F.avg("value"), 4).alias("pm25"))


def gases(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = lambda kind: F.avg(F.when(F.col("parameter") == kind, F.col("value"))) / 100
    return readings(spark, sf_dir).groupBy("station_id", "hour").agg(
        mean("temperature").alias("no"), mean("humidity").alias("no2"), mean("wind_speed").alias("nox"),
        mean("wind_dir").alias("o3"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense series: one value per region and day. Tens are summed as integers, so the sum is exact.

    Stored, because the series operators pass over their input more than once.
    """
    t = lambda n: table(spark, sf_dir, n)
    tens = F.sum(F.round(F.col("o_totalprice") / 10).cast("long"))
    return materialize(
        t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(F.col("r_name").alias("station_id"), F.col("o_orderdate").cast("timestamp").alias("ts"))
        .agg((tens.cast("double") / F.lit(1e3)).alias("pm25"))
    )


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense series with about a quarter of its values missing."""
    holds = F.floor(F.col("pm25") * 100) % 4 != 0
    return daily(spark, sf_dir).withColumn("pm25", F.when(holds, F.col("pm25")))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stations(spark, sf_dir)
    return joins.station_pairs(s, NETWORK_RADIUS_M)


def with_weather(spark: SparkSession, sf_dir: str, targets: DataFrame) -> DataFrame:
    """Targets with the nearest report of the hour and its wind components; missing values are 0."""
    out = joins.nearest_met(targets, stations(spark, sf_dir), met(spark, sf_dir), MET_VALUES)
    out = out.na.fill(0.0, list(MET_VALUES))
    speed, direction = F.col("wind_speed"), F.col("wind_dir")
    return out.withColumns({"wind_u": geo.wind_u(speed, direction), "wind_v": geo.wind_v(speed, direction)})


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every station-hour with a reading, any station being a target."""
    out = with_weather(spark, sf_dir, pm(spark, sf_dir))
    return out.select("station_id", "hour", "pm25", "temperature", "humidity", "dew_point", "wind_u", "wind_v")


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hour of every station, readings and gaps."""
    out = with_weather(spark, sf_dir, series.hourly_spine(pm(spark, sf_dir), ["station_id"], "hour"))
    return out.select("station_id", "hour", "pm25", "wind_u", "wind_v")


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per target hour: weather, wind, neighbour features, gases."""
    out = diffusion.diffusion_features(targets(spark, sf_dir), pm(spark, sf_dir), pairs(spark, sf_dir))
    return joins.with_defaults(out, gases(spark, sf_dir), ["station_id", "hour"],
                               {"no": 0.0, "no2": 0.0, "nox": 0.0, "o3": 0.0})
