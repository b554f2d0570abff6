"""Flows on Spark's event-time watermark and state store.

Unlike the per-batch functions of ``flows`` nothing here keeps tables or clocks of its own: open hours, histories, pending ticks and seen keys live in the state
store, are versioned with the checkpoint, and only what a micro-batch touches is written (RocksDB with a changelog). A query that is killed goes on from
the last committed batch and emits every row once, with a file sink. Rows behind the watermark are dropped by Spark and counted in ``Progress.dropped``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators import joins

WATERMARK = "2 hours"
AHEAD = "1 hour"


def keyed_state(spark: SparkSession) -> SparkSession:
    """State in RocksDB: on the executors' disks, not their heap, and uploaded as changes."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return spark


@dataclass(frozen=True)
class Progress:
    """What one micro-batch did: rows read, state rows held and written afterwards, rows dropped behind the watermark."""

    batch: int
    rows: int
    held: int
    written: int
    dropped: int
    watermark: str | None


def drain(df: DataFrame, checkpoint: str, out: str) -> list[Progress]:
    """Run a stream into a Parquet directory until its input is used up."""
    query = df.writeStream.option("checkpointLocation", checkpoint).option("path", out).outputMode("append").format("parquet").trigger(availableNow=True).start()
    query.awaitTermination()
    done = []
    for p in query.recentProgress:
        ops = p["stateOperators"]
        total = lambda name: sum(int(o[name]) for o in ops)  # noqa: E731, B023
        done.append(Progress(p["batchId"], p["numInputRows"], total("numRowsTotal"), total("numRowsUpdated"), total("numRowsDroppedByWatermark"), p["eventTime"].get("watermark")))
    return done


def believable(stream: DataFrame, ts: str = "ts", ingested: str = "ingested_at", ahead: str = AHEAD) -> DataFrame:
    """Rows that do not claim to be later than their arrival by more than ``ahead``: these must not move the watermark."""
    return stream.filter(F.col(ts) <= F.col(ingested) + F.expr(f"interval {ahead}"))


def closed_hours(stream: DataFrame, values: list[str], keys: tuple[str, ...] = ("station_id", "source"), ts: str = "ts", order: str = "event_id", watermark: str = WATERMARK) -> DataFrame:
    """One row per key and hour once the watermark has passed the hour's end: last non-null value per column by (ts, order), and the rows behind it.

    Held: one aggregate per key and open hour, pre-aggregated before the shuffle; it goes when the hour closes.
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(ts, order))).alias(c)
    hours = stream.withWatermark(ts, watermark).groupBy(*keys, F.window(ts, "1 hour").alias("hour")).agg(F.count(F.lit(1)).alias("n"), *[last(c) for c in values])
    return hours.select(*keys, F.col("hour.start").alias("timestamp"), "n", *values)


def first_deliveries(stream: DataFrame, keys: list[str], ts: str = "ts", watermark: str = WATERMARK) -> DataFrame:
    """Each key once, null keys equal, as long as copies come within the watermark of each other; a key is forgotten behind it."""
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)


# --- histories ------------------------------------------------------------------------------------

class _History(StatefulProcessor):
    """A key's newest values, newest last; a batch writes the keys it touches."""

    def __init__(self, key: str, ts: str, value: str, length: int):
        self.key, self.ts, self.value, self.length = key, ts, value, length

    def init(self, handle) -> None:
        self.held = handle.getValueState("held", T.StructType([T.StructField("at", T.ArrayType(T.TimestampType())), T.StructField("value", T.ArrayType(T.DoubleType()))]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(self.ts, kind="stable")
        at, values = self.held.get() if self.held.exists() else ([], [])
        both = pd.concat([pd.DataFrame({"at": pd.to_datetime(list(at)), "value": list(values), "new": False}),
                          pd.DataFrame({"at": new[self.ts].to_numpy(), "value": new[self.value].to_numpy(), "new": True})]).sort_values("at", kind="stable")
        times, all_values, is_new = both["at"].to_list(), both["value"].to_list(), both["new"].to_list()
        found = [i for i, x in enumerate(is_new) if x]
        yield pd.DataFrame({self.key: key[0], self.ts: [times[i] for i in found], self.value: [all_values[i] for i in found],
                            "history": [all_values[max(0, i + 1 - self.length) : i + 1] for i in found]})
        keep = self.length - 1
        self.held.update(([t.to_pydatetime() for t in times[-keep:]], [float(v) for v in all_values[-keep:]]))

    def close(self) -> None:
        pass


def histories(stream: DataFrame, key: str = "station_id", ts: str = "timestamp", value: str = "pm25", length: int = 24) -> DataFrame:
    """Every record with its key's last ``length`` values, itself included, oldest first.

    Held: ``length - 1`` values a key. A key's rows of one micro-batch are sorted in one task, so the batch (files a trigger) bounds memory.
    """
    kind = stream.schema[key].dataType.simpleString()
    keyed_state(stream.sparkSession)
    return stream.select(key, ts, value).groupBy(key).transformWithStateInPandas(
        _History(key, ts, value, length), f"{key} {kind}, {ts} timestamp, {value} double, history array<double>", "append", "none")


# --- as-of join -----------------------------------------------------------------------------------

class _AsOf(StatefulProcessor):
    """Ticks wait until the watermark has passed them; then the report of the best rank that has one, latest at or before the tick."""

    def __init__(self, key: str, key_type: T.DataType, ts: str, fields: list[T.StructField]):
        self.key, self.key_type, self.ts, self.fields = key, key_type, ts, fields
        self.names = [f.name for f in fields]

    def init(self, handle) -> None:
        self.handle = handle
        at = T.StructField("at", T.TimestampType())
        self.ticks = handle.getListState("ticks", T.StructType([at]))
        self.reports = handle.getListState("reports", T.StructType([T.StructField("rank", T.IntegerType()), at, *self.fields]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        for part in rows:
            ticks = part[part["rank"].isna()]
            if len(ticks):
                self.ticks.appendList([(t.to_pydatetime(),) for t in ticks[self.ts]])
                for ms in {int(t.timestamp() * 1000) for t in ticks[self.ts]}:
                    self.handle.registerTimer(max(ms, watermark + 1))
            reports = part[part["rank"].notna()]
            if len(reports):
                values = (reports[n].astype(object).where(reports[n].notna(), None) for n in self.names)
                self.reports.appendList(list(zip(reports["rank"].astype(int).tolist(), (t.to_pydatetime() for t in reports[self.ts]), *values, strict=True)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All ticks up to the watermark at once; what can still win for later ticks stays."""
        until = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms").to_pydatetime()
        waiting = sorted(t for (t,) in self.ticks.get())
        done = [t for t in waiting if t <= until]
        if not done:
            return
        reports = sorted(self.reports.get(), key=lambda r: (r[1], r[0]))
        out, best, i = [], {}, 0
        for t in done:
            while i < len(reports) and reports[i][1] <= t:
                best[reports[i][0]] = reports[i]
                i += 1
            if best:
                rank = min(best)
                out.append((key[0], t, best[rank][1], *best[rank][2:]))
        later = [t for t in waiting if t > until]
        self.ticks.put([(t,) for t in later]) if later else self.ticks.clear()
        for r in reports[i:]:
            if r[1] > until:
                break
            best[r[0]] = r
        winner = min(best, default=None)
        kept = [r for k, r in best.items() if k == winner] + [r for r in reports if r[1] > until and (winner is None or r[0] <= winner)]
        self.reports.put([tuple(r) for r in kept]) if kept else self.reports.clear()
        if out:
            columns = [self.key, self.ts, "report_at", *self.names]
            yield pd.DataFrame({c: [row[j] for row in out] for j, c in enumerate(columns)}).astype({
                f.name: "float64" for f in self.fields if isinstance(f.dataType, T.DoubleType)})

    def close(self) -> None:
        pass


def as_of(ticks: DataFrame, reports: DataFrame, values: list[str], key: str = "station_id", ts: str = "timestamp", watermark: str = WATERMARK) -> DataFrame:
    """Event-time join of two streams: each tick (key, ts) with the latest report at or before it, of any age.

    ``reports`` has key, ts, ``rank`` and ``values``: of several sources of a key the one of the smallest rank that has reported by then counts. The
    result does not depend on the order of arrival within the watermark; ticks without any report give no row. Held: ticks and reports
    ahead of the watermark, and one report a key behind it.
    """
    fields = [reports.schema[v] for v in values]
    kind = ticks.schema[key].dataType
    both = ticks.select(key, ts, F.lit(None).cast("int").alias("rank"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields]).unionByName(
        reports.select(key, ts, F.col("rank").cast("int"), *values))
    keyed_state(ticks.sparkSession)
    out = T.StructType([T.StructField(key, kind), T.StructField(ts, T.TimestampType()), T.StructField("report_at", T.TimestampType()), *fields])
    return both.withWatermark(ts, watermark).groupBy(key).transformWithStateInPandas(_AsOf(key, kind, ts, fields), out, "append", "eventTime")


def ranked_sources(places: DataFrame, sources: DataFrame, k: int, key: str = "station_id", source: str = "met_id") -> DataFrame:
    """``(key, source, rank)``: the ``k`` nearest sources of each place, the nearest first. Static, so found once."""
    near = joins.nearest_k(places, sources, k, key, source)
    return near.select(key, source, F.row_number().over(Window.partitionBy(key).orderBy("dist_m", source)).alias("rank"))
