"""Table sinks: date-partitioned upsert, latest state, CSV export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import scalar
from ..operators import clean
from ..session import materialize

KINDS = ("predictions", "alerts", "measurements", "history", "readings", "met", "emitted", "open", "clock", "models", "dates")
# A version is read by the batch after it, and once more if that batch is repeated.
KEPT_VERSIONS = 3


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def keyed(records: DataFrame) -> DataFrame:
    """Records with dedup key and partition date."""
    return records.withColumns({
        "dedup_key": scalar.dedup_key(F.col("station_id"), F.col("source"), F.col("timestamp")),
        "date": scalar.partition_date(F.col("timestamp"))})


MANIFEST = T.StructType([T.StructField("date", T.StringType()), T.StructField("v", T.IntegerType())])


def upsert_by_date(records: DataFrame, path: str, seq: str = "event_id", version: int | None = None) -> None:
    """Merge records into a table partitioned by date, one row per dedup key, last non-null per column.

    What arrives now counts as later than what is stored. The dates that occur in ``records`` are read, merged and written as
    ``rows/v=N/date=...``; then one manifest publishes all of them at once, the other dates staying at their versions. Readers
    (``read_by_date``) see the snapshot before or after, never half of it. An upsert that is repeated under its ``version`` (a stream's batch id)
    starts from the snapshot before it and replaces itself. One writer at a time.
    """
    spark = records.sparkSession
    if version is None:
        version = max(_versions(spark, f"{path}/dates"), default=-1) + 1
    new = materialize(keyed(records))  # read twice: for its dates and for the merge
    dates = [r[0] for r in new.select("date").distinct().collect()]  # bounded by the calendar
    if not dates:
        return
    known = _manifest(spark, path, before=version)
    stored = _dates(spark, path, {d: v for d, v in known.items() if d in set(dates)}, new.schema)
    both = stored.withColumn("_arrival", F.lit(0)).unionByName(new.withColumn("_arrival", F.lit(1)))
    merged = clean.collapse_same_hour(
        both, order=("_arrival", "ingested_at", seq), keys=("dedup_key", "date", "station_id", "source", "timestamp"))
    merged.select(*new.columns).write.mode("overwrite").partitionBy("date").parquet(f"{path}/rows/v={version:09d}")
    publish = spark.createDataFrame([*(known | dict.fromkeys(dates, version)).items()], MANIFEST)
    write_state(publish.coalesce(1), path, "dates", version)
    kept = [v for v in _versions(spark, f"{path}/dates") if v <= version]
    used = {v for at in kept for v in _manifest(spark, path, before=at + 1).values()}
    for v in _versions(spark, f"{path}/rows"):
        if v < version and v not in used:
            _delete(spark, f"{path}/rows/v={v:09d}")


def read_by_date(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The newest published snapshot of a table written by ``upsert_by_date``; a filter on ``date`` prunes it."""
    return _dates(spark, path, _manifest(spark, path), schema)


def _manifest(spark: SparkSession, path: str, before: int | None = None) -> dict[str, int]:
    return {r["date"]: r["v"] for r in read_state(spark, path, "dates", MANIFEST, before).collect()}


def _dates(spark: SparkSession, path: str, versions: dict[str, int], schema: T.StructType | None) -> DataFrame:
    if not versions:
        if schema is None:
            raise FileNotFoundError(f"nothing was published under {path}")
        return spark.createDataFrame([], schema)
    read = spark.read.option("basePath", f"{path}/rows")
    if schema is not None:
        read = read.schema(T.StructType([*schema.fields, T.StructField("v", T.IntegerType())]))
    folder = lambda d: "__HIVE_DEFAULT_PARTITION__" if d is None else d
    out = read.parquet(*[f"{path}/rows/v={v:09d}/date={folder(d)}" for d, v in versions.items()]).drop("v")
    return out.withColumn("date", F.col("date").cast("string")).select(*(out.columns if schema is None else schema.names))


def upsert_latest(records: DataFrame, path: str, kind: str, version: int, order=("timestamp", "event_id")) -> str:
    """Latest record per station of one kind, as the new version of the state table.

    A version is a complete table under ``path/kind=.../v=N``; readers take the highest committed
    one, so they never see half a write, and re-running a version replaces it.
    """
    spark = records.sparkSession
    old = read_state(spark, path, kind, records.schema, before=version)
    latest = clean.latest_per_key(old.unionByName(records), ["station_id"], list(order))
    return write_state(latest.select(*records.columns), path, kind, version)


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the stored versions, newest first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted((int(s.getPath().getName()[2:]) for s in fs.listStatus(path)), reverse=True) if fs.exists(path) else []


def read_state(spark: SparkSession, path: str, kind: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """Current state of one kind; empty with the schema if there is none.

    Reads the newest version whose table carries the writer's success marker; writers must leave it on.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind: {kind}")
    root = f"{path}/{kind}"
    for v in _versions(spark, root):
        if (before is None or v < before) and _exists(spark, f"{root}/v={v:09d}/_SUCCESS"):
            return spark.read.schema(schema).parquet(f"{root}/v={v:09d}")
    return spark.createDataFrame([], schema)


def write_state(df: DataFrame, path: str, kind: str, version: int, keep: int = KEPT_VERSIONS) -> str:
    """Write one version of a state table and delete all but the newest ``keep`` ones."""
    spark, out = df.sparkSession, f"{path}/{kind}/v={version:09d}"
    df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(out)
    for v in _versions(spark, f"{path}/{kind}")[keep:]:
        _delete(spark, f"{path}/{kind}/v={v:09d}")
    return out


def _delete(spark: SparkSession, path: str) -> None:
    old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV parts with headers, written in parallel."""
    df.write.mode("overwrite").csv(path, header=True)
