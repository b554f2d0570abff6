"""Batch and stream readers, and the shaping of nested payloads into raw records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import schemas
from ..functions import scalar
from ..operators import clean

# Raw weather field -> property names of the instrument variants, best first.
INSTRUMENT_VARIANTS = {
    "air_temp": ["air_temp"],
    "rel_hum": ["rel_hum"],
    "wind_speed": [
        "avg_wnd_spd_10m_pst1mt", "avg_wnd_spd_10m_pst2mts", "avg_wnd_spd_10m_pst10mts",
        "avg_wnd_spd_10m_pst1hr", "avg_wnd_spd_pcpn_gag_pst1mt", "avg_wnd_spd_pcpn_gag_pst10mts",
    ],
    "wind_dir": [
        "avg_wnd_dir_10m_pst1mt", "avg_wnd_dir_10m_pst2mts", "avg_wnd_dir_10m_pst10mts",
        "avg_wnd_dir_10m_pst1hr",
    ],
    "pressure": ["stn_pres"],
    "dew_point": ["dwpt_temp"],
}


# Header names of the archive's columns, best first.
ARCHIVE_NAMES = {"datetime": ("datetime", "date.utc"), "parameter": ("parameter", "param"), "value": ("value",)}
ARCHIVE_COLUMNS = 16


def read_hourly_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a stated schema; headers trimmed and lower-cased. ``schema`` names the file's columns."""
    return clean.lower_headers(spark.read.schema(schema).csv(path, header=True, enforceSchema=True))


def read_archive(spark: SparkSession, root: str, location_id: int, start_date: str) -> DataFrame:
    """Archived readings of one location from a date on: (datetime, parameter, value).

    Layout ``locationid=/year=/month=`` with one, possibly gzipped, CSV per day. Location and month
    prune directories; rows before the start inside the first month are filtered. Columns are found by
    the names in each file's own header, in any order and case, among ``ARCHIVE_COLUMNS`` columns at
    most; a file without them gives no rows. Rows without a time, parameter or number are dropped.
    """
    cells = [f"c{i}" for i in range(ARCHIVE_COLUMNS)]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in cells] + [
        T.StructField(c, T.IntegerType()) for c in ("locationid", "year", "month")])
    y, m = int(start_date[:4]), int(start_date[5:7])
    df = spark.read.schema(schema).csv(root, header=False, recursiveFileLookup=False)
    in_time = (F.col("year") > y) | ((F.col("year") == y) & (F.col("month") >= m))
    df = df.filter((F.col("locationid") == location_id) & in_time).select(
        "locationid", F.array(*cells).alias("row"), F.col("_metadata.file_path").alias("file"))
    names = F.transform("row", lambda c: F.lower(F.trim(c)))
    place = lambda field: F.coalesce(*[F.nullif(F.array_position(names, n), F.lit(0)) for n in ARCHIVE_NAMES[field]])
    df = df.withColumns({f"_{f}": place(f) for f in ARCHIVE_NAMES})
    is_header = F.col("_datetime").isNotNull() & F.col("_parameter").isNotNull() & F.col("_value").isNotNull()
    headers = df.filter(is_header).select("file", *[F.col(f"_{f}").cast("int").alias(f"{f}_at") for f in ARCHIVE_NAMES]).dropDuplicates(["file"])
    rows = df.filter(~is_header).select("file", "locationid", "row").join(headers, "file")
    cell = lambda field: F.get("row", F.col(f"{field}_at") - 1)
    return rows.select(
        "locationid", cell("datetime").try_cast("timestamp").alias("datetime"), cell("parameter").alias("parameter"),
        scalar.number(cell("value")).alias("value"),
    ).filter(F.col("datetime") >= F.lit(start_date).cast("timestamp")).na.drop()


def raw_stream(spark: SparkSession, path: str, source: str, fmt: str = "json", **options) -> DataFrame:
    """Stream of raw records of one source from a directory.

    ``fmt="kafka"`` takes the broker options and reads JSON values; it needs the Kafka package on the
    class path.
    """
    schema = schemas.RAW_SCHEMAS[source]
    reader = spark.readStream.options(**options)
    if fmt == "kafka":
        value = F.from_json(F.col("value").cast("string"), schema.simpleString())
        return reader.format("kafka").load().select(value.alias("r"), "offset").select("r.*", "offset")
    return reader.schema(T.StructType([*schema.fields, T.StructField("offset", T.LongType())])).format(fmt).load(path)


def sensor_map(payloads: DataFrame, col: str = "payload") -> DataFrame:
    """Locations payload to (location_id, latitude, longitude, sensor_id, parameter); unnamed sensors drop out."""
    return payloads.select(F.explode(F.from_json(F.col(col), schemas.LOCATIONS_PAYLOAD)["results"]).alias("l")).select(
        F.col("l.id").alias("location_id"), F.col("l.coordinates.latitude").alias("latitude"),
        F.col("l.coordinates.longitude").alias("longitude"), F.explode("l.sensors").alias("s"),
    ).select("location_id", "latitude", "longitude", F.col("s.id").alias("sensor_id"),
             F.col("s.parameter.name").alias("parameter")).filter(F.nullif(F.col("parameter"), F.lit("")).isNotNull())


def latest_to_raw(payloads: DataFrame, sensors: DataFrame, location: str = "location_id",
                  col: str = "payload") -> DataFrame:
    """Latest-values payload of a location to raw records; sensors not in the map drop out."""
    rows = payloads.select(location, F.explode(F.from_json(F.col(col), schemas.LATEST_PAYLOAD)["results"]).alias("r"))
    rows = rows.select(F.col(location).alias("location_id"), F.col("r.sensorsId").alias("sensor_id"),
                       F.col("r.value").alias("value"), F.col("r.datetime.utc").alias("datetime_utc"))
    return rows.join(sensors, ["location_id", "sensor_id"]).select(
        F.concat(F.lit(clean.STATION_PREFIX["openaq"]), F.col("location_id").cast("string")).alias("station_id"),
        "sensor_id", "parameter", "value", "datetime_utc", "latitude", "longitude")


def prop(props: Column, base: str) -> Column:
    """A property stored as ``base-value`` or, only if that key is absent, as ``base``."""
    flat = base + "-value"
    return F.when(F.map_contains_key(props, flat), F.try_element_at(props, F.lit(flat))).otherwise(
        F.try_element_at(props, F.lit(base)))


def best_variant(props: Column, candidates: Sequence[str], min_qa: float = 0.0) -> Column:
    """First candidate that is a number and whose quality, if stated, is not below ``min_qa``."""
    qa = lambda b: scalar.number(F.try_element_at(props, F.lit(b + "-qa")))
    return F.coalesce(*[
        F.when(qa(b).isNull() | (qa(b) >= min_qa), scalar.number(prop(props, b))) for b in candidates])


def collection_to_raw(collections: DataFrame, min_qa: float = 0.0, col: str = "payload") -> DataFrame:
    """GeoJSON feature collections to raw weather records."""
    f = collections.select(F.explode(F.from_json(F.col(col), schemas.COLLECTION_PAYLOAD)["features"]).alias("f"))
    props, at = F.col("f.properties"), F.col("f.geometry.coordinates")
    return f.select(
        F.concat(F.lit(clean.STATION_PREFIX["envcanada"]), F.coalesce(prop(props, "clim_id"), F.lit("None"))).alias("station_id"),
        prop(props, "date_tm").alias("datetime_utc"),
        F.get(at, 1).alias("latitude"), F.get(at, 0).alias("longitude"),
        *[best_variant(props, names, min_qa).alias(c) for c, names in INSTRUMENT_VARIANTS.items()])


def arrays_to_hours(payloads: DataFrame, col: str = "payload", keep: Sequence[str] = ("met_id", "lat", "lon")) -> DataFrame:
    """Parallel-array weather JSON to one row per hour; arrays shorter than ``time`` end in nulls."""
    h = F.from_json(F.col(col), schemas.ARRAYS_PAYLOAD)["hourly"]
    # Payload array -> canonical field.
    fields = {"temperature_2m": "temperature", "relativehumidity_2m": "humidity", "dewpoint_2m": "dew_point",
              "windspeed_10m": "wind_speed", "winddirection_10m": "wind_dir"}
    n = F.size(h["time"])
    padded = lambda a: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(a, i))
    zipped = F.when(n > 0, F.arrays_zip(h["time"].alias("time"), *[padded(h[k]).alias(v) for k, v in fields.items()]))
    return payloads.select(*keep, F.inline(zipped)).select(
        *keep, scalar.utc_hour(F.col("time")).alias("hour"), *fields.values())


def replay(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """A recorded slice in time order."""
    return clean.time_slice(df, ts, start, end).orderBy(ts)


def mock_records(df: DataFrame, station: str = "mock-7570", source: str = "mock", ts: str = "datetime") -> DataFrame:
    """Wide archive rows as canonical records of a mock source."""
    fields = {c: (F.col(c) if c in df.columns else F.lit(None)) for c in ("pm25", "no", "no2", "nox", "o3")}
    return df.select(
        F.lit(station).alias("station_id"), F.lit(source).alias("source"),
        scalar.utc_hour(F.col(ts)).alias("timestamp"), F.current_timestamp().alias("ingested_at"),
        *[fields.get(c, F.lit(None)).cast("double").alias(c) for c in schemas.CANONICAL_VALUES])


def encode(df: DataFrame, key: str = "station_id") -> DataFrame:
    """Rows as keyed JSON messages."""
    return df.select(F.col(key).alias("key"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def decode(messages: DataFrame, schema: T.StructType, topic: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of JSON messages; a message that breaks the schema becomes a reject."""
    checked = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = messages.withColumn("_r", F.from_json(
        F.col("value"), checked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    broken = F.col("_r").isNull() | F.col("_r._bad").isNotNull()
    offset = F.col("offset").cast("long") if "offset" in messages.columns else F.lit(None).cast("long")
    bad = parsed.filter(broken).select(
        F.lit(topic).alias("source_topic"), offset.alias("offset"), F.lit("message does not match the schema").alias("error"),
        F.base64(F.col("value").cast("binary")).alias("value_b64"))
    return parsed.filter(~broken).select(*[F.col("_r")[f.name].alias(f.name) for f in schema.fields]), bad


# The promotions a reader may make of what an older writer wrote.
WIDER = {"tinyint": ("smallint", "int", "bigint", "float", "double"), "smallint": ("int", "bigint", "float", "double"), "int": ("bigint", "float", "double"),
         "bigint": ("float", "double"), "float": ("double",), "string": ("binary",), "binary": ("string",)}


def incompatibilities(writer: T.DataType, reader: T.DataType, defaults: dict[str, object] | None = None, at: str = "") -> list[str]:
    """Why ``reader`` cannot read what ``writer`` wrote (backward compatibility); empty if it can.

    A field the writer did not have needs a default or must be nullable, a type may only be widened, a field that may be null must stay so; the writer's other
    fields are dropped. ``defaults`` names nested fields by their path (``position.lat``). Arrays, maps and structs are compared inside.
    """
    here = at or "message"
    if isinstance(reader, T.StructType) and isinstance(writer, T.StructType):
        out, known = [], {f.name: f for f in writer.fields}
        for f in reader.fields:
            path = f"{at}.{f.name}" if at else f.name
            if f.name not in known:
                if not f.nullable and path not in (defaults or {}):
                    out.append(f"{path}: added without a default")
                continue
            if known[f.name].nullable and not f.nullable and path not in (defaults or {}):
                out.append(f"{path}: may no longer be null")
            out += incompatibilities(known[f.name].dataType, f.dataType, defaults, path)
        return out
    if isinstance(reader, T.ArrayType) and isinstance(writer, T.ArrayType):
        return incompatibilities(writer.elementType, reader.elementType, defaults, f"{here}[]")
    if isinstance(reader, T.MapType) and isinstance(writer, T.MapType):
        return incompatibilities(writer.keyType, reader.keyType, defaults, f"{here} key") + incompatibilities(writer.valueType, reader.valueType, defaults, f"{here} value")
    old, new = writer.simpleString(), reader.simpleString()
    return [] if old == new or new in WIDER.get(old, ()) else [f"{here}: {old} cannot be read as {new}"]


def _resolved(value: Column, writer: T.DataType, reader: T.DataType, defaults: dict[str, object], at: str = "") -> Column:
    """``value`` of the writer's type as the reader's: fields by name, missing ones by default, types widened."""
    if isinstance(reader, T.StructType):
        known, made = {f.name: f for f in writer.fields}, []
        for f in reader.fields:
            path = f"{at}.{f.name}" if at else f.name
            default = F.lit(defaults.get(path)).cast(f.dataType) if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.lit(None).cast(f.dataType)
            if f.name not in known:
                made.append(default.alias(f.name))
                continue
            c = _resolved(value[f.name], known[f.name].dataType, f.dataType, defaults, path)
            made.append((c if f.nullable or path not in defaults else F.coalesce(c, default)).alias(f.name))
        return F.when(value.isNotNull(), F.struct(*made))
    if isinstance(reader, T.ArrayType):
        return F.transform(value, lambda x: _resolved(x, writer.elementType, reader.elementType, defaults, f"{at}[]"))
    if isinstance(reader, T.MapType):
        return F.transform_values(value, lambda _, x: _resolved(x, writer.valueType, reader.valueType, defaults, f"{at} value"))
    return value.cast(reader)


def decode_versions(messages: DataFrame, writers: dict[int, T.StructType], reader: T.StructType, topic: str,
                    defaults: dict[str, object] | None = None, version: str = "schema") -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of JSON messages written under several schemas, named by the column ``version``, as records of ``reader``.

    Every writer's schema is checked first; one that ``reader`` cannot read is refused with all reasons. A message that breaks the schema it names, or names
    an unknown one, becomes a reject.
    """
    defaults = defaults or {}
    reasons = [f"schema {v}, {r}" for v, w in writers.items() for r in incompatibilities(w, reader, defaults)]
    if reasons:
        raise ValueError("; ".join(reasons))
    record, broken = F.lit(None).cast(reader), F.lit(True)
    for v, w in writers.items():
        checked = T.StructType([*w.fields, T.StructField("_bad", T.StringType())])
        parsed = F.from_json(F.col("value"), checked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
        ours = F.col(version) == v
        broken = F.when(ours, parsed.isNull() | parsed["_bad"].isNotNull()).otherwise(broken)
        record = F.when(ours, _resolved(parsed, w, reader, defaults)).otherwise(record)
    offset = F.col("offset").cast("long") if "offset" in messages.columns else F.lit(None).cast("long")
    judged = messages.withColumns({"_broken": broken, "_record": record})
    known = F.coalesce(F.col(version).isin(list(writers)), F.lit(False))
    error = F.when(known, "message does not match the schema").otherwise("unknown schema")
    bad = judged.filter("_broken").select(F.lit(topic).alias("source_topic"), offset.alias("offset"), error.alias("error"), F.base64(F.col("value").cast("binary")).alias("value_b64"))
    return judged.filter("NOT _broken").select("_record.*"), bad
