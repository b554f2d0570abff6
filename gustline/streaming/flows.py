"""Structured Streaming flows. Each applies the batch operators to micro-batches.

Delivery: file and table sinks written per micro-batch are keyed by the batch id, so a repeated batch
overwrites its own output; checkpoints take the place of committed offsets. All paths are in the
shared folder of the cluster.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import alerts
from ..operators import clean, diffusion, joins, series
from ..operators.ranking import top_per_group
from ..session import materialize
from ..sources import sinks

WATERMARK_HOURS = 2
AHEAD_HOURS = 1
LOOKBACK = 24


def start(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None] | str, once: bool = True,
          mode: str = "append", interval: str = "1 minute") -> StreamingQuery:
    """Run a stream into a per-batch function or a Parquet directory; ``once`` drains what is there."""
    w = df.writeStream.option("checkpointLocation", checkpoint).outputMode(mode)
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime=interval)
    return w.foreachBatch(sink).start() if callable(sink) else w.format("parquet").option("path", sink).start()


def drain(*args, **kw) -> None:
    q = start(*args, **kw)
    q.awaitTermination()


def _part(df: DataFrame, path: str, batch_id: int) -> None:
    """A batch's rows in its own directory: written again, it replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id:09d}")


# --- normalize ------------------------------------------------------------------------------------

def normalize_to(source: str, measurements: str, rejects: str) -> Callable[[DataFrame, int], None]:
    """Per batch: valid raw records to the measurement table, the others with a reason to the rejects."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        good = clean.normalize(batch, source).filter("error IS NULL").drop("error")
        _part(good.withColumn("event_id", F.col("offset")).drop("offset"), f"{measurements}/source_dir={source}", batch_id)
        _part(clean.rejects(batch, source, f"raw.{source}"), f"{rejects}/source_dir={source}", batch_id)
    return sink


# --- event time ------------------------------------------------------------------------------------

CLOCK = T.StructType([T.StructField("newest", T.TimestampType()), T.StructField("closed", T.TimestampType())])


class Clock:
    """Decides once a batch which hours have closed and which rows still count.

    An hour closes when event time has passed its end by ``watermark_hours``. Rows of hours that had closed before the batch are
    late; rows that claim to be more than ``ahead_hours`` later than their ingest time are from the future and do
    not move the clock. Both go to the rejects with that reason.
    """

    def __init__(self, path: str, topic: str, watermark_hours: int = WATERMARK_HOURS, ahead_hours: int = AHEAD_HOURS):
        self.path, self.topic, self.watermark, self.ahead = path, topic, watermark_hours, ahead_hours

    def __call__(self, batch: DataFrame, batch_id: int, ts: str, event_id: str = "event_id") -> tuple[DataFrame, object, object]:
        """(rows that count, hour closed before, hour closed now); the hours are None until there is one."""
        spark, hour = batch.sparkSession, F.date_trunc("hour", ts)
        old = sinks.read_state(spark, f"{self.path}/state", "clock", CLOCK, before=batch_id).first()
        closed, newest = (old["closed"], old["newest"]) if old else (None, None)
        ingested = F.coalesce("ingested_at", F.current_timestamp()) if "ingested_at" in batch.columns else F.current_timestamp()
        future = F.col(ts) > ingested + F.make_dt_interval(hours=F.lit(self.ahead))
        late = F.lit(False) if closed is None else hour <= F.lit(closed)
        reason = F.when(F.col(ts).isNull(), "no time").when(future, "future").when(late, "late")
        judged = batch.withColumn("_reason", reason)
        payload = F.base64(F.to_json(F.struct(*batch.columns)).cast("binary"))
        offset = F.col(event_id).cast("long") if event_id in batch.columns else F.lit(None).cast("long")
        _part(judged.filter("_reason IS NOT NULL").select(
            F.lit(self.topic).alias("source_topic"), offset.alias("offset"), F.col("_reason").alias("error"), payload.alias("value_b64")),
            f"{self.path}/rejects", batch_id)
        good = judged.filter("_reason IS NULL").drop("_reason")
        seen = good.agg(F.max(ts)).first()[0]
        newest = max((x for x in (newest, seen) if x is not None), default=None)
        now = closed
        if newest is not None:
            end = newest.replace(minute=0, second=0, microsecond=0) - timedelta(hours=self.watermark + 1)
            now = end if closed is None else max(closed, end)
        sinks.write_state(spark.createDataFrame([(newest, now)], CLOCK), f"{self.path}/state", "clock", batch_id)
        return good, closed, now


# --- hourly collapse ------------------------------------------------------------------------------

class HourlyCollapse:
    """Per batch: hours that have closed become one row per station and source, last non-null value per column by (ts, event_id).

    State, one version per batch: the open hours, collapsed so far, with the order key of each value. A row is emitted,
    rejected or still open, never two of these; ``n`` counts the rows behind an hour.
    """

    def __init__(self, values: list[str], path: str, **clock):
        self.values, self.path = values, path
        self.clock = Clock(path, "measurements", **clock)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, keys = batch.sparkSession, ["station_id", "source", "hour"]
        batch = materialize(batch)
        rows, _, closed = self.clock(batch, batch_id, "ts")
        seen = F.struct("ts", "event_id")
        at = lambda c: F.when(F.col(c).isNotNull(), seen).alias(f"{c}_at")
        new = rows.select("station_id", "source", F.date_trunc("hour", "ts").alias("hour"), F.lit(1).cast("long").alias("n"),
                          *self.values, *[at(c) for c in self.values])
        old = sinks.read_state(spark, f"{self.path}/state", "open", new.schema, before=batch_id)
        merged = materialize(old.unionByName(new).groupBy(*keys).agg(
            F.sum("n").alias("n"), *[F.max_by(c, f"{c}_at").alias(c) for c in self.values], *[F.max(f"{c}_at").alias(f"{c}_at") for c in self.values]))
        done = F.lit(False) if closed is None else F.col("hour") <= F.lit(closed)
        _part(merged.filter(done).select("station_id", "source", F.col("hour").alias("timestamp"), "n", *self.values), f"{self.path}/hours", batch_id)
        sinks.write_state(merged.filter(~done).select(*new.columns), f"{self.path}/state", "open", batch_id)

    def still_open(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """Rows of the open hours after the last batch."""
        return sinks.read_state(spark, f"{self.path}/state", "open", schema)


# --- rolling history ------------------------------------------------------------------------------

RECORD = T.StructType([T.StructField("station_id", T.StringType()), T.StructField("timestamp", T.TimestampType()),
                       T.StructField("pm25", T.DoubleType())])


class RollingHistory:
    """Per batch: each record with its last ``length`` values, itself included, oldest first.

    State: the newest ``length - 1`` records of each station. History is taken block by block, so a backfill that
    brings a whole station is many tasks.
    """

    def __init__(self, path: str, length: int = LOOKBACK):
        self.path, self.length = path, length

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = sinks.read_state(spark, f"{self.path}/state", "history", RECORD, before=batch_id)
        both = materialize(old.withColumn("_new", F.lit(False)).unionByName(
            batch.select("station_id", "timestamp", "pm25").withColumn("_new", F.lit(True))))
        out = series.history(both, ["station_id"], "timestamp", F.col("pm25"), self.length).filter("_new").drop("_new")
        _part(out, f"{self.path}/records", batch_id)
        kept = top_per_group(both.drop("_new"), ["station_id"], [F.col("timestamp").desc()], self.length - 1)
        sinks.write_state(kept, f"{self.path}/state", "history", batch_id)


# --- hourly features ------------------------------------------------------------------------------

MET_VALUES = ("wind_speed", "wind_dir", "temperature", "humidity", "dew_point")
READING = T.StructType([T.StructField("station_id", T.StringType()), T.StructField("hour", T.TimestampType()),
                        T.StructField("pm25", T.DoubleType())])
MET = T.StructType([T.StructField("station_id", T.StringType()), T.StructField("hour", T.TimestampType()),
                    *[T.StructField(c, T.DoubleType()) for c in ("lat", "lon", *MET_VALUES)]])
EMITTED = T.StructType([T.StructField("station_id", T.StringType()), T.StructField("hour", T.TimestampType()),
                        T.StructField("features", T.MapType(T.StringType(), T.DoubleType()))])


class HourlyFeatures:
    """Per batch: every hour that has closed becomes one feature record per station.

    State, one version per batch: unemitted readings and the last ``LOOKBACK`` emitted ones, the weather reports of open hours and
    the latest one before them of each weather station, the last feature maps, the clock. Of several records of a station and hour
    the last to arrive (later batch, then ingest time, then id) counts, column by column. Weather counts from whatever age, gaps are
    measured in event time, and what the clock refuses goes to the rejects.
    """

    def __init__(self, stations: DataFrame, edges: DataFrame, path: str, **clock):
        self.stations, self.edges, self.path = stations, edges, path
        self.clock = Clock(path, "measurements", **clock)

    def _read(self, spark: SparkSession, name: str, schema: T.StructType, before: int) -> DataFrame:
        return sinks.read_state(spark, f"{self.path}/state", name, schema, before=before)

    def _write(self, df: DataFrame, name: str, version: int) -> None:
        sinks.write_state(df, f"{self.path}/state", name, version)

    def _merged(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """One row per station and hour, last non-null per column in order of arrival."""
        order = {"ingested_at": T.TimestampType(), "event_id": T.LongType()}
        stored = old.withColumns({c: F.lit(None).cast(t) for c, t in order.items()}).withColumn("_arrival", F.lit(0))
        both = stored.unionByName(new.withColumn("_arrival", F.lit(1)))
        return clean.collapse_same_hour(both, ("_arrival", *order), ("station_id", "hour")).select(*old.columns)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = materialize(batch.withColumns({c: F.lit(None).cast(t) for c, t in (("ingested_at", "timestamp"), ("event_id", "long")) if c not in batch.columns}))
        rows, done, closed = self.clock(batch, batch_id, "timestamp")
        hour, arrival = F.date_trunc("hour", "timestamp").alias("hour"), ["ingested_at", "event_id"]
        fresh = rows.filter("source = 'openaq' AND pm25 IS NOT NULL").select("station_id", hour, "pm25", *arrival)
        reports = rows.filter("source <> 'openaq'").select(
            "station_id", hour, F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), *MET_VALUES, *arrival)
        readings = materialize(self._merged(self._read(spark, "readings", READING, batch_id), fresh))
        met = materialize(self._merged(self._read(spark, "met", MET, batch_id), reports))
        emitted = old_emitted = self._read(spark, "emitted", EMITTED, batch_id)
        if closed is not None and closed != done:
            made = materialize(self._emit(readings, met, old_emitted, F.lit(closed), done))
            _part(made.select("station_id", F.lit("openaq").alias("source"), F.col("hour").alias("timestamp"), "features",
                              "history", "method"), f"{self.path}/features", batch_id)
            emitted = top_per_group(old_emitted.unionByName(made.select(*old_emitted.columns)), ["station_id"],
                                    [F.col("hour").desc()], LOOKBACK)
        self._write(emitted, "emitted", batch_id)
        over = F.lit(False) if closed is None else F.col("hour") <= F.lit(closed)
        for table, name, keep in ((readings, "readings", LOOKBACK), (met, "met", 1)):
            held = top_per_group(table.filter(over), ["station_id"], [F.col("hour").desc()], keep)
            self._write(held.unionByName(table.filter(~over)), name, batch_id)

    def _emit(self, readings: DataFrame, met: DataFrame, emitted: DataFrame, closed, done) -> DataFrame:
        begin = F.col("_first") if done is None else F.greatest("_first", F.lit(done) + F.expr("interval 1 hour"))
        spans = readings.groupBy("station_id").agg(F.min("hour").alias("_first")).withColumns({"_from": begin, "_to": closed})
        slots = spans.filter("_from <= _to").select("station_id", F.explode(
            F.sequence("_from", "_to", F.expr("interval 1 hour"))).alias("hour"))
        rows = slots.withColumn("_new", F.lit(True)).join(readings, ["station_id", "hour"], "full_outer").filter(
            F.col("hour") <= closed)
        past = met.filter(F.col("hour") <= closed).withColumnRenamed("station_id", "met_id")
        weather = joins.nearest_met(rows, self.stations, materialize(joins.met_as_of(past, MET_VALUES, closed)), MET_VALUES)
        f = clean.model_features(weather.withColumn("pm25", F.lit(None)))
        names = {"temp definition °c": "temp", "dew point definition °c": "dew", "rel hum definition %": "hum"}
        f = weather.select("station_id", "hour", "_new", "pm25", *[
            c.alias(names.get(n, n)) for n, c in f.items() if n != "pm25"])
        fixed = diffusion.recover(f, readings, self.edges).filter("_new AND method <> 'none'")
        full = diffusion.diffusion_features(fixed.drop("pm25").withColumnRenamed("recovered", "pm25"), readings, self.edges)
        full = full.withColumnsRenamed({v: k for k, v in names.items()})
        cols = [*names, "wind_u", "wind_v", "pm25", "upwind_pm25", "transport_potential", "wind_alignment"]
        made = full.select("station_id", "hour", clean.feature_map(cols).alias("features"), "method")
        both = materialize(made).withColumn("_new", F.lit(True)).unionByName(emitted, allowMissingColumns=True)
        return series.history(both, ["station_id"], "hour", F.col("features"), LOOKBACK).filter("_new").drop("_new")


# --- scoring, alerts, state, audit ----------------------------------------------------------------

def score(stream: DataFrame, bundle) -> DataFrame:
    """Feature records to predictions; stateless."""
    from ..plans import models
    return models.forecast(stream, bundle)


def alert(stream: DataFrame) -> DataFrame:
    """Predictions to alerts; stateless."""
    return alerts.alert_records(stream)


def live_state_to(path: str, kind: str, order=("timestamp", "event_id")) -> Callable[[DataFrame, int], None]:
    def sink(batch: DataFrame, batch_id: int) -> None:
        sinks.upsert_latest(batch, path, kind, batch_id, order)
    return sink


def audit_to(path: str, seq: str = "event_id") -> Callable[[DataFrame, int], None]:
    def sink(batch: DataFrame, batch_id: int) -> None:
        sinks.upsert_by_date(batch, path, seq, batch_id)
    return sink


def timed_alerts_to(path: str, ingested: str = "ingested_at") -> Callable[[DataFrame, int], None]:
    """Per batch: write the alerts, then the milliseconds from each record's ingest stamp to the end of that write."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        _part(batch, f"{path}/alerts", batch_id)
        end = F.lit(datetime.now(timezone.utc)).cast("timestamp")
        stored = batch.sparkSession.read.parquet(f"{path}/alerts/batch={batch_id:09d}")
        _part(stored.select("station_id", latency_ms(F.col(ingested), end).alias("ms")), f"{path}/latency", batch_id)
    return sink


def latency_ms(begin: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(begin)) / 1000
