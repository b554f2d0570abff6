"""Source, cleaning, deduplication, aggregation and sort queries."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from .. import schemas
from ..functions import scalar
from ..operators import aggregates, clean, series
from ..session import materialize, scratch
from ..sources import readers, sinks, tables as src
from .registry import query

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"
ISO_SQL = "'%Y-%m-%dT%H:%M:%SZ'"


def _location(c="station_id"):
    return F.split_part(F.col(c), F.lit("-"), F.lit(2)).cast("long")


LOCATION_SQL = "CAST(split_part(station_id, '-', 2) AS BIGINT)"
SENSORS = ("pm25", "temperature", "humidity", "wind_speed", "wind_dir")


def _sensor_no(c="parameter"):
    return F.array_position(F.array(*[F.lit(p) for p in SENSORS]), F.col(c))


SENSOR_SQL = "list_position(['pm25','temperature','humidity','wind_speed','wind_dir'], parameter)"


def _csv_text(spark, d):
    """Hourly pm and gases as text, headers padded and in mixed case, some cells not numeric."""
    p = src.pm(spark, d).join(src.gases(spark, d), ["station_id", "hour"])
    return p.select(
        F.col("station_id").alias("City_Name"), F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias(" Timestamp"),
        F.when(F.col("pm25") < 20, "n/a").otherwise(F.col("pm25").cast("string")).alias("PM25 "),
        F.coalesce(F.col("no").cast("string"), F.lit("")).alias("NO"), F.lit("x").alias("Unused"))


CSV_SQL = """SELECT pm.station_id, pm.hour, CASE WHEN pm25 >= 20 THEN pm25 END AS pm25, g.no FROM pm
JOIN gases g ON pm.station_id = g.station_id AND pm.hour = g.hour"""


@query("src1_hourly_csv", f"SELECT station_id AS city_name, hour AS timestamp, pm25, no FROM ({CSV_SQL})", "pm25|no")
def src1_hourly_csv(spark, d):
    path = scratch(spark, "csv")
    text = _csv_text(spark, d)
    sinks.export_csv(text, path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in text.columns])
    df = clean.coerce(readers.read_hourly_csv(spark, path, schema), ["pm25", "no"])
    return df.select("city_name", F.col("timestamp").cast("timestamp").alias("timestamp"), "pm25", "no")


@query("src2_archive_scan", f"""SELECT {LOCATION_SQL}::INT AS locationid, ts AS datetime, parameter, value FROM readings
WHERE station_id = 'st-5' AND ts >= TIMESTAMP '2024-01-10'""", "value")
def src2_archive_scan(spark, d):
    """Nine-column files, and files with other names in another order, side by side."""
    root = scratch(spark, "archive")
    place, time = _location().cast("int"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    text = F.col("value").cast("string")
    folder = [place.alias("locationid"), F.year("ts").alias("year"), F.month("ts").alias("month")]
    r = src.readings(spark, d).withColumn("even", F.dayofmonth("ts") % 2 == 0)
    nine = r.filter("even").select(place.alias("location_id"), F.lit(7).alias("sensors_id"), F.lit("a place, with a comma").alias("location"),
                                   time.alias("datetime"), F.lit(1.5).alias("lat"), F.lit(2.5).alias("lon"), "parameter", F.lit("ug").alias("units"), text.alias("value"), *folder)
    other = r.filter("not even").select(text.alias("Value"), F.lit("x").alias("note"), F.col("parameter").alias("param"), time.alias("date.utc"), *folder)
    for files in (nine, other):
        files.repartition("locationid", "year", "month").write.partitionBy("locationid", "year", "month").mode("append").option(
            "compression", "gzip").csv(root, header=True)
    return readers.read_archive(spark, root, 5, "2024-01-10")


@query("src4_latest_payload", f"""SELECT concat('openaq-', {LOCATION_SQL}) AS station_id, {SENSOR_SQL}::BIGINT AS sensor_id,
  parameter, value, strftime(ts, {ISO_SQL}) AS datetime_utc, lat AS latitude, lon AS longitude
FROM readings JOIN stations USING (station_id)""", "value|latitude|longitude")
def src4_latest_payload(spark, d):
    """Each payload also reports a sensor the location does not list; it must vanish."""
    result = lambda sensor: F.struct(
        sensor.cast("long").alias("sensorsId"), F.col("value"), F.struct(F.date_format("ts", ISO).alias("utc")).alias("datetime"))
    payloads = src.readings(spark, d).select(_location().alias("location_id"), F.to_json(F.struct(
        F.array(result(_sensor_no()), result(F.lit(-1))).alias("results"))).alias("payload"))
    return readers.latest_to_raw(payloads, readers.sensor_map(_location_payloads(spark, d)))


def _location_payloads(spark, d):
    sensor = lambda i, name: F.struct(F.lit(i).cast("long").alias("id"), F.struct(F.lit(name).cast("string").alias("name")).alias("parameter"))
    loc = F.struct(_location().alias("id"), F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).alias("coordinates"),
                   F.array(*[sensor(i + 1, p) for i, p in enumerate(SENSORS)], sensor(99, None)).alias("sensors"))
    pairs = src.stations(spark, d).groupBy(F.substring("station_id", -1, 1).cast("int") % 4).agg(F.collect_list(loc).alias("results"))
    return pairs.select(F.to_json(F.struct("results")).alias("payload"))


@query("src5_sensor_map", f"""SELECT {LOCATION_SQL} AS location_id, lat AS latitude, lon AS longitude, i::BIGINT AS sensor_id,
  ['pm25','temperature','humidity','wind_speed','wind_dir'][i] AS parameter
FROM stations CROSS JOIN (SELECT unnest([1,2,3,4,5]) AS i)""", "latitude|longitude")
def src5_sensor_map(spark, d):
    """Every payload lists two locations."""
    return readers.sensor_map(_location_payloads(spark, d))


def _collections(spark, d):
    """One feature collection per report: variants of the wind sensor with quality marks, some bare keys."""
    text = lambda c: F.col(c).cast("string")
    p, entry = [], lambda k, v: p.extend([F.lit(k), v])
    entry("clim_id-value", F.col("met_id"))
    entry("date_tm", F.date_format("hour", ISO))
    entry("air_temp", text("temperature"))
    entry("rel_hum-value", text("humidity"))
    entry("rel_hum", F.lit("-1"))
    entry("avg_wnd_spd_10m_pst1mt-value", text("wind_speed"))
    entry("avg_wnd_spd_10m_pst1mt-qa", F.when(F.col("wind_speed") > 60, "10").otherwise("100"))
    entry("avg_wnd_spd_10m_pst10mts-value", F.when(F.col("temperature") > 40, "bad").otherwise(text("dew_point")))
    entry("avg_wnd_spd_pcpn_gag_pst1mt", F.lit("1.5"))
    entry("avg_wnd_dir_10m_pst1hr-value", text("wind_dir"))
    feature = F.struct(
        F.struct(F.array("lon", "lat", F.lit(110.0)).alias("coordinates")).alias("geometry"),
        F.create_map(*p).alias("properties"))
    return src.met(spark, d).select(F.to_json(F.struct(F.array(feature).alias("features")), {"ignoreNullFields": "false"}).alias("payload"))


_SPEED = """CASE WHEN wind_speed IS NOT NULL AND NOT (wind_speed > 60) THEN wind_speed
  WHEN (temperature IS NULL OR temperature <= 40) AND dew_point IS NOT NULL THEN dew_point ELSE 1.5e0 END"""


@query("src6_feature_collection", f"""SELECT concat('swob-', met_id) AS station_id, strftime(hour, {ISO_SQL}) AS datetime_utc,
  lat AS latitude, lon AS longitude, temperature AS air_temp, humidity AS rel_hum, {_SPEED} AS wind_speed, wind_dir,
  CAST(NULL AS DOUBLE) AS pressure, CAST(NULL AS DOUBLE) AS dew_point FROM met""",
       "latitude|longitude|air_temp|rel_hum|wind_speed|wind_dir")
def src6_feature_collection(spark, d):
    return readers.collection_to_raw(_collections(spark, d), min_qa=50)


@query("p7_variant_fallback", f"SELECT met_id, hour, {_SPEED} AS wind_speed FROM met", "wind_speed")
def p7_variant_fallback(spark, d):
    raw = readers.collection_to_raw(_collections(spark, d), min_qa=50)
    return raw.select(F.substring("station_id", 6, 99).alias("met_id"), F.to_timestamp("datetime_utc").alias("hour"), "wind_speed")


@query("p8_property_lookup", "SELECT met_id, hour, humidity AS flat, temperature AS bare FROM met", "flat|bare")
def p8_property_lookup(spark, d):
    """The suffixed key decides even when its value is null."""
    f = _collections(spark, d).select(F.explode(F.from_json("payload", schemas.COLLECTION_PAYLOAD)["features"]).alias("f"))
    p = F.col("f.properties")
    return f.select(readers.prop(p, "clim_id").alias("met_id"), F.to_timestamp(readers.prop(p, "date_tm")).alias("hour"),
                    scalar.number(readers.prop(p, "rel_hum")).alias("flat"), scalar.number(readers.prop(p, "air_temp")).alias("bare"))


_DAY = "date_trunc('day', hour)"


@query("src7_column_arrays", f"""SELECT met_id, lat, lon, hour, CASE WHEN row_number() OVER (PARTITION BY met_id, {_DAY} ORDER BY hour)
  < count(*) OVER (PARTITION BY met_id, {_DAY}) THEN temperature END AS temperature, humidity, CAST(NULL AS DOUBLE) AS dew_point,
  wind_speed, wind_dir FROM met""", "lat|lon|temperature|humidity|wind_speed|wind_dir")
def src7_column_arrays(spark, d):
    """One payload per weather station and day; the temperature array lacks its last element."""
    day = src.met(spark, d).groupBy("met_id", "lat", "lon", F.to_date("hour").alias("day")).agg(F.array_sort(F.collect_list(
        F.struct("hour", "temperature", "humidity", "wind_speed", "wind_dir"))).alias("h"))  # at most 24
    pick = lambda c: F.transform("h", lambda s: s[c])
    hourly = F.struct(
        F.transform("h", lambda s: F.date_format(s["hour"], "yyyy-MM-dd'T'HH:mm")).alias("time"),
        F.slice(pick("temperature"), F.lit(1), F.size("h") - 1).alias("temperature_2m"),
        pick("humidity").alias("relativehumidity_2m"), pick("wind_speed").alias("windspeed_10m"),
        pick("wind_dir").alias("winddirection_10m"))
    payloads = day.select("met_id", "lat", "lon", F.to_json(F.struct(hourly.alias("hourly"))).alias("payload"))
    return readers.arrays_to_hours(payloads)


@query("src8_replay_slice", """SELECT station_id, hour, pm25 FROM pm
WHERE hour >= TIMESTAMP '2024-01-10' AND hour < TIMESTAMP '2024-01-15' ORDER BY hour""", "pm25")
def src8_replay_slice(spark, d):
    return readers.replay(src.pm(spark, d), "hour", "2024-01-10", "2024-01-15")


def _raws(spark, d):
    """The event stream as raw records of three sources, with broken records among them."""
    r = src.readings(spark, d)
    # Every tenth id of each source loses its time, every seventh its station.
    broken = lambda c, n, k: F.when(F.col("event_id") % n == k, None).otherwise(c)
    when = broken(F.date_format("ts", ISO), 10, 3).alias("datetime_utc")
    where = broken(F.col("station_id"), 7, 2).alias("station_id")
    by_source = lambda k: F.pmod(F.col("event_id"), F.lit(3)) == k
    offset = F.col("event_id").alias("offset")
    value = lambda p: F.when(F.col("parameter") == p, F.col("value"))
    openaq = r.filter(by_source(0)).select(
        where, F.lit(1).cast("long").alias("sensor_id"), F.when(F.col("parameter") == "wind_dir", "voc").otherwise(F.col("parameter")).alias("parameter"),
        "value", when, F.lit(43.5).alias("latitude"), F.lit(-79.8).alias("longitude"), offset, "event_id")
    met = r.filter(by_source(1)).select(
        where, when, F.lit(43.6).alias("latitude"), F.lit(-79.7).alias("longitude"), value("temperature").alias("air_temp"),
        value("pm25").alias("dew_point"), value("humidity").alias("rel_hum"), value("wind_speed").alias("wind_speed"),
        value("wind_dir").alias("wind_dir"), F.lit(None).cast("double").alias("pressure"), offset, "event_id")
    city = r.filter(by_source(2)).select(where, when, "value", offset, "event_id").withColumnRenamed("value", "pm25")
    return {"openaq": openaq, "envcanada": met, "iqair": city}


_RAW_SQL = """(SELECT event_id, CASE WHEN event_id % 7 <> 2 THEN station_id END AS station_id,
  CASE WHEN event_id % 10 <> 3 THEN hour END AS hour, parameter, value,
  ['openaq', 'envcanada', 'iqair'][event_id % 3 + 1] AS source, ts, qa FROM readings)"""


def _val(source, p):
    return f"CASE WHEN source = '{source}' AND parameter = '{p}' THEN value END"


_NORM = f"""(SELECT event_id, station_id, source, hour AS timestamp, ts AS ingested_at,
  CASE source WHEN 'openaq' THEN 43.5e0 WHEN 'envcanada' THEN 43.6e0 END AS latitude,
  CASE source WHEN 'openaq' THEN -79.8e0 WHEN 'envcanada' THEN -79.7e0 END AS longitude,
  CASE WHEN source = 'iqair' THEN value WHEN source = 'openaq' AND parameter = 'pm25' THEN value END AS pm25,
  CASE WHEN source <> 'iqair' AND parameter = 'temperature' THEN value END AS temperature,
  CASE WHEN source <> 'iqair' AND parameter = 'humidity' THEN value END AS humidity,
  CASE WHEN source <> 'iqair' AND parameter = 'wind_speed' THEN value END AS wind_speed,
  {_val('envcanada', 'wind_dir')} AS wind_dir, {_val('envcanada', 'pm25')} AS dew_point
  FROM {_RAW_SQL} WHERE station_id IS NOT NULL AND hour IS NOT NULL)"""
_NORM_D = "latitude|longitude|pm25|temperature|humidity|wind_speed|wind_dir|dew_point"
_NORM_COLS = ["event_id", "station_id", "source", "timestamp", "latitude", "longitude", "pm25", "temperature", "humidity",
              "wind_speed", "wind_dir", "dew_point"]


def _normalized(spark, d):
    at = src.readings(spark, d).select("event_id", "ts")
    out = clean.normalize_all(_raws(spark, d), F.lit(None)).filter("error IS NULL")
    return out.drop("ingested_at").join(at, "event_id").withColumnRenamed("ts", "ingested_at")


@query("p5_normalize", f"SELECT {', '.join(_NORM_COLS)} FROM {_NORM}", _NORM_D)
def p5_normalize(spark, d):
    return clean.normalize_all(_raws(spark, d), F.lit(None)).filter("error IS NULL").select(*_NORM_COLS)


_REASON = """CASE WHEN station_id IS NULL THEN concat('[', source, '] raw record missing required field: ''station_id''')
  WHEN hour IS NULL THEN concat('[', source, '] raw record missing required field: ''datetime_utc''') END"""


@query("p6_required_fields", f"SELECT event_id, source, {_REASON} AS error FROM {_RAW_SQL} WHERE station_id IS NULL OR hour IS NULL")
def p6_required_fields(spark, d):
    return clean.normalize_all(_raws(spark, d)).filter("error IS NOT NULL").select("event_id", "source", "error")


@query("snk4_rejects", f"""SELECT concat('raw.', source) AS source_topic, event_id AS "offset", {_REASON} AS error, true AS has_payload
FROM {_RAW_SQL} WHERE station_id IS NULL OR hour IS NULL""")
def snk4_rejects(spark, d):
    out = None
    for source, raw in _raws(spark, d).items():
        r = clean.rejects(raw.drop("event_id"), source, f"raw.{source}")
        out = r if out is None else out.unionByName(r)
    return out.select("source_topic", "offset", "error", F.unbase64("value_b64").cast("string").startswith("{").alias("has_payload"))


@query("snk6_codec", f"SELECT {', '.join(_NORM_COLS[1:])}, 0::BIGINT AS bad FROM {_NORM} UNION ALL BY NAME "
       f"SELECT CAST(NULL AS VARCHAR) AS station_id, count(*) AS bad FROM {_NORM} WHERE pm25 > 100", _NORM_D)
def snk6_codec(spark, d):
    """Encode, cut the messages of high readings in half, decode; broken ones are counted."""
    n = _normalized(spark, d)
    whole = readers.encode(n.drop("error", "event_id")).withColumn("offset", F.lit(0))
    cut = readers.encode(n.filter("pm25 > 100").drop("error", "event_id")).withColumn(
        "value", F.expr("substring(value, 1, length(value) div 2)")).withColumn("offset", F.lit(1))
    good, bad = readers.decode(whole.unionByName(cut), schemas.MEASUREMENT, "measurements")
    rows = good.select(*_NORM_COLS[1:], F.lit(0).cast("long").alias("bad"))
    count = bad.groupBy().agg(F.count(F.lit(1)).alias("bad"))
    return rows.unionByName(count, allowMissingColumns=True)


_OLD = "event_id long, station_id string, hour timestamp, qa int, parameter string"
_NEW = "event_id long, station_id string, hour timestamp, qa long, value double"


@query("snk6_schema_versions", """SELECT event_id, station_id, hour, CAST(qa AS BIGINT) AS qa, CASE WHEN event_id % 2 = 0 THEN -1e0 ELSE value END AS value, false AS rejected
FROM readings WHERE event_id % 7 <> 0 UNION ALL BY NAME SELECT event_id, true AS rejected FROM readings WHERE event_id % 7 = 0""", "value")
def snk6_schema_versions(spark, d):
    """Messages under two schemas read as the newer one: a type widened, a field dropped, a field added with a default; every seventh names no known schema."""
    r, even = src.readings(spark, d), F.col("event_id") % 2 == 0
    old, new = T.StructType.fromDDL(_OLD), T.StructType.fromDDL(_NEW)
    said = lambda rows, schema, v: readers.encode(rows.select(*schema.names)).withColumn("schema", F.lit(v)).withColumn("offset", F.get_json_object("value", "$.event_id").cast("long"))
    messages = said(r.filter(even), old, 1).unionByName(said(r.filter(~even), new, 2))
    messages = messages.withColumn("schema", F.when(F.col("offset") % 7 == 0, 9).otherwise(F.col("schema")))
    good, bad = readers.decode_versions(messages, {1: old, 2: new}, new, "readings", {"value": -1.0})
    rejected = bad.filter("error = 'unknown schema'").select(F.col("offset").alias("event_id"), F.lit(True).alias("rejected"))
    return good.withColumn("rejected", F.lit(False)).unionByName(rejected, allowMissingColumns=True)


@query("snk7_publish_wide", """SELECT 'mock-7570' AS station_id, 'mock' AS source, p.hour AS timestamp, p.pm25, g.no, g.no2, g.nox, g.o3
FROM pm p JOIN gases g ON p.station_id = g.station_id AND p.hour = g.hour""", "pm25|no|no2|nox|o3")
def snk7_publish_wide(spark, d):
    wide = src.pm(spark, d).join(src.gases(spark, d), ["station_id", "hour"]).withColumn(
        "datetime", F.date_format("hour", "yyyy-MM-dd HH:15:00"))
    path = scratch(spark, "topic")
    readers.mock_records(wide).write.parquet(path)
    return spark.read.schema(schemas.MEASUREMENT).parquet(path).select(
        "station_id", "source", "timestamp", "pm25", "no", "no2", "nox", "o3")


@query("snk5_csv_export", "SELECT station_id, hour, pm25 FROM pm", "pm25")
def snk5_csv_export(spark, d):
    path = scratch(spark, "export")
    sinks.export_csv(src.pm(spark, d), path)
    return spark.read.schema("station_id string, hour timestamp, pm25 double").csv(path, header=True)


_LAST = "max_by({0}, (ts, event_id)) FILTER (WHERE {0} IS NOT NULL) AS {0}"


@query("d2_collapse_same_hour", f"""SELECT station_id, source, timestamp, {', '.join(
    f'max_by({c}, (ingested_at, event_id)) FILTER (WHERE {c} IS NOT NULL) AS {c}' for c in _NORM_COLS[4:])}
FROM {_NORM} GROUP BY 1, 2, 3""", _NORM_D)
def d2_collapse_same_hour(spark, d):
    return clean.collapse_same_hour(_normalized(spark, d)).select(*_NORM_COLS[1:])


@query("d1_dedup_key", f"""SELECT event_id, concat_ws('|', station_id, source, strftime(timestamp, '%Y-%m-%dT%H:%M:%S+00:00')) AS dedup_key
FROM {_NORM}""")
def d1_dedup_key(spark, d):
    return _normalized(spark, d).select("event_id", scalar.dedup_key(
        F.col("station_id"), F.col("source"), F.col("timestamp")).alias("dedup_key"))


@query("snk1_partitioned_upsert", f"""SELECT concat_ws('|', station_id, source, strftime(timestamp, '%Y-%m-%dT%H:%M:%S+00:00')) AS dedup_key,
  strftime(timestamp, '%Y-%m-%d') AS date, {', '.join(
    f'max_by({c}, (ingested_at, event_id)) FILTER (WHERE {c} IS NOT NULL) AS {c}' for c in _NORM_COLS[4:])}
FROM {_NORM} GROUP BY station_id, source, timestamp""", _NORM_D)
def snk1_partitioned_upsert(spark, d):
    """Two batches that share their hours: the readings of the first and of the second half hour."""
    n = materialize(_normalized(spark, d).drop("error"))
    path = scratch(spark, "sink")
    first = F.minute("ingested_at") < 30
    sinks.upsert_by_date(n.filter(first), path)
    sinks.upsert_by_date(n.filter(~first), path)
    return sinks.read_by_date(spark, path).select("dedup_key", "date", *_NORM_COLS[4:])


@query("snk2_latest_state", """SELECT station_id, max(ts) AS timestamp, max_by(value, (ts, event_id)) AS value, max(event_id) FILTER (WHERE false) AS gap
FROM readings WHERE parameter = 'pm25' GROUP BY 1""", "value")
def snk2_latest_state(spark, d):
    return _state(spark, d).select("station_id", "timestamp", "value", F.lit(None).cast("long").alias("gap"))


def _state(spark, d):
    path = scratch(spark, "state")
    r = src.readings(spark, d).filter("parameter = 'pm25'").select("station_id", F.col("ts").alias("timestamp"), "event_id", "value")
    early = F.col("timestamp") < F.lit("2024-01-15").cast("timestamp")
    sinks.upsert_latest(r.filter(early), path, "predictions", 0)
    sinks.upsert_latest(r.filter(~early), path, "predictions", 1)
    return sinks.read_state(spark, path, "predictions", r.schema)


@query("snk3_read_state", """SELECT station_id, max_by(value, (ts, event_id)) AS value, 'predictions' AS kind
FROM readings WHERE parameter = 'pm25' GROUP BY 1""", "value")
def snk3_read_state(spark, d):
    """The alerts state was never written: reading it gives no rows, not an error."""
    state = _state(spark, d)
    none = sinks.read_state(spark, scratch(spark, "none"), "alerts", state.schema)
    kind = lambda df, k: df.select("station_id", "value", F.lit(k).alias("kind"))
    return kind(state, "predictions").unionByName(kind(none, "alerts"))


_PM_D = "pm25"


@query("p1_keep_columns", """SELECT hour AS timestamp, pm25, CAST(NULL AS VARCHAR) AS co, station_id AS city_name FROM pm""", _PM_D)
def p1_keep_columns(spark, d):
    df = src.pm(spark, d).withColumnsRenamed({"hour": "timestamp", "station_id": "city_name "})
    return clean.keep_columns(df, ["timestamp", "pm25", "co", "city_name "])


@query("p2_header_aliases", 'SELECT station_id, hour, pm25 AS pm2, pm25 * 2 AS "Temp Definition °C" FROM pm', "pm2|Temp Definition °C")
def p2_header_aliases(spark, d):
    df = src.pm(spark, d).withColumn(" TEMP definition °c", F.col("pm25") * 2)
    return clean.alias_headers(df)


_TEXT_SQL = "(SELECT event_id, CASE WHEN qa < 20 THEN 'n/a' WHEN qa > 90 THEN NULL ELSE CAST(value AS VARCHAR) END AS v FROM readings)"


def _text(spark, d):
    return src.readings(spark, d).select("event_id", F.when(F.col("qa") < 20, "n/a").when(
        F.col("qa") > 90, None).otherwise(F.col("value").cast("string")).alias("v"))


@query("p3_coerce_null", f"SELECT event_id, TRY_CAST(v AS DOUBLE) AS v FROM {_TEXT_SQL}", "v")
def p3_coerce_null(spark, d):
    return clean.coerce(_text(spark, d), ["v"])


@query("p4_coerce_zero", f"SELECT event_id, coalesce(TRY_CAST(v AS DOUBLE), 0) AS v FROM {_TEXT_SQL}", "v")
def p4_coerce_zero(spark, d):
    return clean.coerce(_text(spark, d), ["v"], zero=True)


@query("p9_select_features", "SELECT station_id, hour, no2, pm25 FROM training", "no2|pm25")
def p9_select_features(spark, d):
    df = src.training(spark, d)
    return df.select("station_id", "hour", *clean.select_features(["no2", "missing", "pm25"], df.columns, []))


@query("p11_model_features", """SELECT met_id, hour, coalesce(temperature, 0) AS temp, coalesce(dew_point, 0) AS dew,
  coalesce(humidity, 0) AS hum, coalesce(wind_speed, 0)*cos(radians(coalesce(wind_dir, 0))) AS wind_u,
  coalesce(wind_speed, 0)*sin(radians(coalesce(wind_dir, 0))) AS wind_v, 0.0e0 AS pm25 FROM met""", "temp|dew|hum|wind_u|wind_v|pm25")
def p11_model_features(spark, d):
    m = src.met(spark, d)
    f = clean.model_features(m)
    short = dict(zip(f, ["temp", "dew", "hum", "wind_u", "wind_v", "pm25"]))
    return m.select("met_id", "hour", *[c.alias(short[n]) for n, c in f.items()])


@query("p13_finite_only", "SELECT station_id, hour, ln(CASE WHEN pm25 > 20 THEN pm25 END) AS v FROM pm WHERE pm25 > 20", "v")
def p13_finite_only(spark, d):
    v = F.when(F.col("pm25") > 20, F.log("pm25")).when(F.col("pm25") > 10, F.lit(float("nan"))).when(
        F.col("pm25") > 5, F.lit(float("inf")))
    return clean.finite_only(src.pm(spark, d).select("station_id", "hour", v.alias("v")), ["v"])


@query("p14_recent_window", """SELECT event_id, value FROM readings
WHERE ts BETWEEN TIMESTAMP '2024-01-20 10:00:00' AND TIMESTAMP '2024-01-20 12:00:00'""", "value")
def p14_recent_window(spark, d):
    return clean.recent(src.readings(spark, d), "ts", F.lit("2024-01-20 12:00:00").cast("timestamp"), 2).select("event_id", "value")


@query("p15_bounding_box", """SELECT r.event_id, s.station_id FROM readings r JOIN stations s USING (station_id)
WHERE lon BETWEEN -79.75e0 AND -79.45e0 AND lat BETWEEN 43.55e0 AND 43.8e0""")
def p15_bounding_box(spark, d):
    inside = clean.in_box(src.stations(spark, d), -79.75, 43.55, -79.45, 43.8)
    return src.readings(spark, d).join(inside, "station_id").select("event_id", "station_id")


@query("p16_feature_map", """SELECT met_id, hour, k, v FROM (SELECT met_id, hour,
  unnest(['wind_speed','temperature','humidity']) AS k, unnest([wind_speed, temperature, humidity]) AS v FROM met) WHERE v IS NOT NULL""", "v")
def p16_feature_map(spark, d):
    m = src.met(spark, d).select("met_id", "hour", clean.feature_map(["wind_speed", "temperature", "humidity"]).alias("f"))
    return m.select("met_id", "hour", F.explode("f").alias("k", "v"))


@query("p17_hourly_table", f"""SELECT station_id AS city_name, hour AS timestamp, pm25 AS pm2, no FROM ({CSV_SQL}) ORDER BY 1, 2""", "pm2|no")
def p17_hourly_table(spark, d):
    df = clean.alias_headers(clean.lower_headers(_csv_text(spark, d)))
    return clean.hourly_table(df).select("city_name", "timestamp", "pm2", "no").orderBy("city_name", "timestamp")


@query("p19_extract_digits", """SELECT event_id, CAST(nullif(regexp_extract(props, '(\\d+)', 1), '') AS INT) AS n,
  CAST(hour(ts) AS INT) AS hh FROM events""")
def p19_extract_digits(spark, d):
    return src.events(spark, d).select("event_id", scalar.digits(F.col("props")).alias("n"),
                                       scalar.digits(F.date_format("ts", "HH:mm")).alias("hh"))


_PAGE = """(SELECT page_id, CASE page_id % 4 WHEN 0 THEN html || '<b>pm2.5 index: ' || page_id || '.5</b>'
  WHEN 1 THEN html || '<i data-PM25-value="' || page_id || '">' WHEN 2 THEN html || '{"pm25" : ' || page_id || '.25}' ELSE html END AS html FROM pages)"""


@query("p20_pm_from_page", f"""SELECT page_id, CAST(coalesce(nullif(regexp_extract(html, '(?i)PM2\\.5[^0-9\\-\\n\\r]*([0-9]+(?:\\.[0-9]+)?)', 1), ''),
  nullif(regexp_extract(html, '(?i)data\\-pm25\\-value="([0-9]+(?:\\.[0-9]+)?)"', 1), ''),
  nullif(regexp_extract(html, '(?i)"pm25"\\s*:\\s*([0-9]+(?:\\.[0-9]+)?)', 1), '')) AS DOUBLE) AS pm25 FROM {_PAGE}""", "pm25")
def p20_pm_from_page(spark, d):
    """Pages with a reading added in one of the three forms, or none."""
    i = F.col("page_id")
    html = F.concat(F.col("html"), F.when(i % 4 == 0, F.concat(F.lit("<b>pm2.5 index: "), i, F.lit(".5</b>"))).when(
        i % 4 == 1, F.concat(F.lit('<i data-PM25-value="'), i, F.lit('">'))).when(
        i % 4 == 2, F.concat(F.lit('{"pm25" : '), i, F.lit(".25}"))).otherwise(""))
    return src.table(spark, d, "pages").select("page_id", scalar.pm25_from_page(html).alias("pm25"))


@query("p21_city_slug", """SELECT c_custkey, regexp_replace(replace(trim(regexp_replace(lower(c), '[^a-z0-9 ]+', '', 'g')), ' ', '-'), '-+', '-', 'g') AS slug
FROM (SELECT c_custkey, ' ' || n_name || ' -- ' || c_mktsegment || '. (' || c_name || ')' AS c FROM customer JOIN nation ON c_nationkey = n_nationkey)""")
def p21_city_slug(spark, d):
    c = src.table(spark, d, "customer").join(src.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.concat(F.lit(" "), "n_name", F.lit(" -- "), "c_mktsegment", F.lit(". ("), "c_name", F.lit(")"))
    return c.select("c_custkey", scalar.city_slug(name).alias("slug"))


@query("d3_first_per_key", """SELECT station_id, hour, qa, arg_min(event_id, event_id) AS event_id, arg_min(value, event_id) AS value FROM
  (SELECT event_id, station_id, hour, CASE WHEN qa % 5 <> 0 THEN qa END AS qa, value FROM readings) GROUP BY 1, 2, 3""", "value")
def d3_first_per_key(spark, d):
    qa = F.when(F.col("qa") % 5 != 0, F.col("qa"))
    df = src.readings(spark, d).select("event_id", "station_id", "hour", qa.alias("qa"), "value")
    return clean.first_per_key(df, ["station_id", "hour", "qa"], ["event_id"])


@query("d4_distinct_rows", "SELECT DISTINCT station_id, parameter, qa, hour FROM readings")
def d4_distinct_rows(spark, d):
    return src.readings(spark, d).select("station_id", "parameter", "qa", "hour").dropDuplicates()


@query("d5_distinct_stations", "SELECT DISTINCT station_id, role FROM stations")
def d5_distinct_stations(spark, d):
    return src.stations(spark, d).dropDuplicates(["station_id"]).select("station_id", "role")


@query("a1_mean_by_time", "SELECT station_id, hour, parameter, avg(value) AS value FROM readings GROUP BY 1, 2, 3", "value")
def a1_mean_by_time(spark, d):
    return aggregates.mean_by(src.readings(spark, d), ["station_id", "hour", "parameter"])


_PARAMETERS = ["pm25", "temperature", "humidity", "wind_speed", "wind_dir"]


@query("a2_long_to_wide", f"""SELECT station_id, hour, {', '.join(f"avg(value) FILTER (WHERE parameter = '{p}') AS {p}" for p in _PARAMETERS)}
FROM readings GROUP BY 1, 2""", "|".join(_PARAMETERS))
def a2_long_to_wide(spark, d):
    return aggregates.widen(src.readings(spark, d), ["station_id", "hour"], "parameter", "value", _PARAMETERS)


_HOURLY = "(SELECT station_id, hour, avg(value) AS value FROM readings GROUP BY 1, 2)"


@query("a3_resample_hourly", f"""SELECT s.station_id, s.hour, h.value FROM
  (SELECT station_id, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM {_HOURLY} GROUP BY 1) s
  LEFT JOIN {_HOURLY} h ON s.station_id = h.station_id AND s.hour = h.hour""", "value")
def a3_resample_hourly(spark, d):
    return aggregates.resample_hourly(src.readings(spark, d), ["station_id"], "ts", ["value"])


@query("a4_city_hour_mean", "SELECT station_id AS city_name, hour, avg(value) AS pm25 FROM readings WHERE parameter = 'pm25' GROUP BY 1, 2", "pm25")
def a4_city_hour_mean(spark, d):
    r = src.readings(spark, d).filter("parameter = 'pm25'")
    return aggregates.mean_by(r.select(F.col("station_id").alias("city_name"), "hour", F.col("value").alias("pm25")),
                              ["city_name", "hour"], "pm25")


@query("a12_latency_percentiles", """SELECT station_id, avg(ms) AS mean, min(ms) AS min, max(ms) AS max,
  quantile_cont(ms, 0.5) AS median, quantile_cont(ms, 0.95) AS p95 FROM
  (SELECT station_id, epoch_us(ts) / 1000.0e0 - epoch_us(hour) / 1000.0e0 AS ms FROM readings) GROUP BY 1""", "mean|min|max|median|p95")
def a12_latency_percentiles(spark, d):
    ms = F.unix_micros("ts") / 1000 - F.unix_micros("hour") / 1000
    return aggregates.latency_summary(src.readings(spark, d).select("station_id", ms.alias("ms")), ["station_id"], "ms")


@query("m6_log_clip", "SELECT event_id, ln(1 + greatest(value - 50, 0)) AS v FROM readings", "v")
def m6_log_clip(spark, d):
    return src.readings(spark, d).select("event_id", scalar.log_clip(F.col("value") - 50).alias("v"))


@query("m7_exp_clip", "SELECT event_id, greatest(exp((value - 50) / 100) - 1, 0) AS v FROM readings", "v")
def m7_exp_clip(spark, d):
    return src.readings(spark, d).select("event_id", scalar.exp_clip((F.col("value") - 50) / 100).alias("v"))


@query("dt1_floor_hour", f"SELECT event_id, date_trunc('hour', ts - INTERVAL 90 MINUTE) AS hour FROM events")
def dt1_floor_hour(spark, d):
    """Text with a zone offset, floored in UTC."""
    text = F.concat(F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:30"))
    return src.events(spark, d).select("event_id", scalar.utc_hour(text).alias("hour"))


@query("dt2_timestamp_from_parts", """SELECT event_id, CASE WHEN mm = 2 AND dd > CASE WHEN yy % 4 = 0 AND (yy % 100 <> 0 OR yy % 400 = 0) THEN 29 ELSE 28 END
  THEN NULL ELSE make_timestamp(yy, mm, dd, hh, 0, 0) END AS ts FROM
  (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 2026 ELSE year(ts) END AS yy, CASE WHEN event_id % 13 = 0 THEN 1 ELSE 2 END AS mm,
   day(ts) AS dd, CASE WHEN event_id % 17 = 0 THEN 0 ELSE hour(ts) END AS hh FROM events)""")
def dt2_timestamp_from_parts(spark, d):
    """Every day of the month as a day of February or January: 29 is a date in a leap year only, 30 and 31 never are in February."""
    i = F.col("event_id")
    blank = lambda c, n: F.when(i % n == 0, "x").otherwise(c.cast("string"))
    return src.events(spark, d).select("event_id", scalar.timestamp_from_parts(
        blank(F.year("ts"), 11), blank(F.lit(2), 13), F.dayofmonth("ts").cast("string"),
        blank(F.date_format("ts", "HH:mm"), 17)).alias("ts"))


@query("dt3_generated_hours",
       "SELECT event_id, TIMESTAMP '2026-01-01' + (row_number() OVER (ORDER BY event_id) - 1) * INTERVAL 1 HOUR AS timestamp FROM events")
def dt3_generated_hours(spark, d):
    return series.generated_hours(src.events(spark, d).select("event_id"), ["event_id"])


@query("dt4_partition_date", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS date FROM events")
def dt4_partition_date(spark, d):
    return src.events(spark, d).select("event_id", scalar.partition_date(F.col("ts")).alias("date"))


@query("o1_sort", "SELECT station_id, hour, pm25 FROM pm ORDER BY station_id, hour", "pm25")
def o1_sort(spark, d):
    return src.pm(spark, d).orderBy("station_id", "hour")


@query("o2_head", "SELECT station_id, hour, pm25 FROM pm ORDER BY hour, station_id LIMIT 100", "pm25")
def o2_head(spark, d):
    return src.pm(spark, d).orderBy("hour", "station_id").limit(100)


@query("o4_union_parts", """SELECT station_id, hour, pm25, CAST(NULL AS DOUBLE) AS no FROM pm UNION ALL
SELECT station_id, hour, NULL, no FROM gases""", "pm25|no")
def o4_union_parts(spark, d):
    return src.pm(spark, d).unionByName(src.gases(spark, d).select("station_id", "hour", "no"), allowMissingColumns=True)
