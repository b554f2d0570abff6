"""Streaming queries: each writes the driver's rows as stream input, runs to the end, returns the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, clean, series
from ..plans import models
from ..session import materialize, scratch
from ..sources import readers, sinks, tables as src
from ..streaming import flows, state
from .cleaning import _NORM, _NORM_COLS, _NORM_D, _RAW_SQL, _normalized, _raws
from .forecasting import _AHEAD, _ONE, _bundle, _one_frame, _one_records, _records
from .prelude import edge_weight, hav
from .registry import query
from .spatial import ADVICE_SQL, _EVAL, _predictions


def feed(df, ts, label, parts=4):
    """Stream input directory whose files hold consecutive time ranges."""
    path = scratch(df.sparkSession, label)
    df.repartitionByRange(parts, ts).write.parquet(path)
    return path


def open_stream(spark, path, schema, **options):
    return spark.readStream.schema(schema).options(**options).parquet(path)


def _flat_table(spark, path):
    return spark.read.option("recursiveFileLookup", "true").parquet(path)


def _st1(spark, d):
    out, bad = scratch(spark, "measurements"), scratch(spark, "rejects")
    for source, raw in _raws(spark, d).items():
        path = scratch(spark, source)
        raw.drop("event_id").write.json(path, ignoreNullFields=False)
        flows.drain(readers.raw_stream(spark, path, source), scratch(spark, "cp"), flows.normalize_to(source, out, bad))
    return out, bad


_ST1_COLS = [c for c in _NORM_COLS if c != "event_id"]


@query("st1_normalize_stream", f"""SELECT event_id, {', '.join(_ST1_COLS)}, false AS rejected FROM {_NORM} UNION ALL BY NAME
SELECT event_id, source, true AS rejected FROM {_RAW_SQL} WHERE station_id IS NULL OR hour IS NULL""", _NORM_D)
def st1_normalize_stream(spark, d):
    """Every raw record comes out once: normalized or rejected."""
    out, bad = _st1(spark, d)
    good = _flat_table(spark, out).select("event_id", *_ST1_COLS, F.lit(False).alias("rejected"))
    rejected = _flat_table(spark, bad).select(
        F.col("offset").alias("event_id"), F.split_part("source_topic", F.lit("."), F.lit(2)).alias("source"), F.lit(True).alias("rejected"))
    return good.unionByName(rejected, allowMissingColumns=True)


_COLLAPSE = ", ".join(f"max_by({c}, (ts, event_id)) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("pm25", "humidity"))
_WIDE_SQL = """(SELECT event_id, station_id, ts, hour, 'openaq' AS source, CASE WHEN parameter = 'pm25' THEN value END AS pm25,
  CASE WHEN parameter = 'humidity' THEN value END AS humidity FROM readings)"""
_CLOSED = "(SELECT date_trunc('hour', max(ts)) - INTERVAL 3 HOUR FROM readings)"


def _wide(spark, d):
    value = lambda p: F.when(F.col("parameter") == p, F.col("value")).alias(p)
    return src.readings(spark, d).select("event_id", "station_id", "ts", F.lit("openaq").alias("source"), value("pm25"), value("humidity"),
                                         F.col("ts").alias("ingested_at"))


def _collapsed(spark, d, parts, rows=None):
    """The wide readings in several runs of one checkpoint, a run for each condition of ``parts``."""
    rows = _wide(spark, d) if rows is None else rows
    path, out, cp = scratch(spark, "readings"), scratch(spark, "hourly"), scratch(spark, "cp")
    flow = flows.HourlyCollapse(["pm25", "humidity"], out)
    for part in parts:
        rows.filter(part).write.mode("append").parquet(path)
        flows.drain(open_stream(spark, path, rows.schema), cp, flow)
    return out


def _open_hours(spark, out):
    return sinks.read_state(spark, f"{out}/state", "open", "station_id string, source string, hour timestamp, n long")


@query("st2_hourly_collapse", f"""SELECT station_id, source, hour AS timestamp, {_COLLAPSE} FROM {_WIDE_SQL}
WHERE hour <= {_CLOSED} GROUP BY 1, 2, 3""", "pm25|humidity")
def st2_hourly_collapse(spark, d):
    """Hours that event time has closed, from batches cut inside hours; the newest stay open."""
    t, at = F.col("ts"), [F.lit(x).cast("timestamp") for x in ("2024-01-09 10:20:00", "2024-01-20 17:45:00")]
    out = _collapsed(spark, d, [t < at[0], (t >= at[0]) & (t < at[1]), t >= at[1]])
    return _flat_table(spark, f"{out}/hours").select("station_id", "source", "timestamp", "pm25", "humidity")


_EDGE = "TIMESTAMP '2024-01-20'"


@query("st2_late_rejects", f"""SELECT event_id AS "offset", 'late' AS error FROM readings WHERE ts < {_EDGE} AND hour <= {_CLOSED}""", "")
def st2_late_rejects(spark, d):
    """The last ten days arrive first, so all earlier readings are late."""
    edge = F.lit("2024-01-20").cast("timestamp")
    out = _collapsed(spark, d, [F.col("ts") >= edge, F.col("ts") < edge])
    return _flat_table(spark, f"{out}/rejects").select("offset", "error")


_STAMPED = f"(SELECT *, event_id % 500 = 7 AS ahead, {_CLOSED} AS closed FROM readings)"


@query("st2_accounting", f"""SELECT CASE WHEN ahead THEN 'future' WHEN ts < {_EDGE} AND hour <= closed THEN 'late' WHEN hour <= closed THEN 'emitted' ELSE 'open' END AS fate,
  count(*) AS n FROM (SELECT * EXCLUDE closed, (SELECT date_trunc('hour', max(ts)) - INTERVAL 3 HOUR FROM readings WHERE event_id % 500 <> 7) AS closed FROM {_STAMPED}) GROUP BY 1""")
def st2_accounting(spark, d):
    """Late rows, and rows stamped far ahead of their arrival: every input row has exactly one fate."""
    rows = _wide(spark, d)
    rows = rows.withColumn("ts", F.when(F.col("event_id") % 500 == 7, F.col("ts") + F.expr("interval 400 days")).otherwise(F.col("ts")))
    edge = F.lit("2024-01-20").cast("timestamp")
    out = _collapsed(spark, d, [F.col("ingested_at") >= edge, F.col("ingested_at") < edge], rows)
    count = lambda df, fate: df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(fate, "n")
    rejected = _flat_table(spark, f"{out}/rejects").groupBy(F.col("error").alias("fate")).agg(F.count(F.lit(1)).alias("n"))
    emitted = count(_flat_table(spark, f"{out}/hours"), F.lit("emitted").alias("fate"))
    still = count(_open_hours(spark, out), F.lit("open").alias("fate"))
    return rejected.unionByName(emitted).unionByName(still).filter("n > 0")


_W = "PARTITION BY station_id ORDER BY hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW"


@query("st3_rolling_history", f"""SELECT station_id, hour AS timestamp, pm25, CAST(count(*) OVER ({_W}) AS INT) AS n,
  array_to_string(list_transform(list(pm25) OVER ({_W}), lambda x: CAST(round(x * 10000) AS BIGINT)), ',') AS history FROM pm""", "pm25")
def st3_rolling_history(spark, d):
    """Two runs of one checkpoint: the second continues from the state of the first."""
    rows = src.pm(spark, d).withColumnRenamed("hour", "timestamp")
    path, out, cp = scratch(spark, "pm"), scratch(spark, "history"), scratch(spark, "cp")
    edge = F.lit("2024-01-16").cast("timestamp")
    for part in (F.col("timestamp") < edge, F.col("timestamp") >= edge):
        rows.filter(part).write.mode("append").parquet(path)
        flows.drain(open_stream(spark, path, rows.schema), cp, flows.RollingHistory(out))
    shown = F.array_join(F.transform("history", lambda x: F.round(x * 10000).cast("long").cast("string")), ",")
    return _flat_table(spark, f"{out}/records").select("station_id", "timestamp", "pm25", F.size("history").alias("n"), shown.alias("history"))


# --- the same on Spark's watermark and state store -------------------------------------------------

def _in_runs(rows, arrival, edges, flow, label):
    """Several runs of one checkpoint, a run for what arrives between two edges; the output directory and what each batch did."""
    spark = rows.sparkSession
    path, out, cp, done = scratch(spark, label), scratch(spark, f"{label}-out"), scratch(spark, "cp"), []
    at = [F.lit(e).cast("timestamp") for e in edges]
    for low, high in zip([None, *at], [*at, None]):
        part = F.lit(True)
        part = part if low is None else part & (arrival >= low)
        part = part if high is None else part & (arrival < high)
        rows.filter(part).write.mode("append").parquet(path)
        done += state.drain(flow(open_stream(spark, path, rows.schema)), cp, out)
    return out, done


def _delayed(minutes=110):
    """Arrival up to ``minutes`` behind event time, by the row's id, so runs are out of order but within the watermark."""
    return F.timestamp_add("MINUTE", F.col("event_id") % minutes, F.col("ts"))


_RUNS = ("2024-01-09 10:20:00", "2024-01-20 17:45:00")


@query("st2_watermark_collapse", f"""SELECT station_id, source, hour AS timestamp, count(*) AS n, {_COLLAPSE} FROM {_WIDE_SQL}
WHERE hour <= {_CLOSED} GROUP BY 1, 2, 3""", "pm25|humidity")
def st2_watermark_collapse(spark, d):
    """Hours closed by the watermark, from runs whose rows overlap by nearly two hours."""
    flow = lambda s: state.closed_hours(state.believable(s), ["pm25", "humidity"])
    out, _ = _in_runs(_wide(spark, d), _delayed(), _RUNS, flow, "watermark")
    return spark.read.parquet(out)


@query("st3_keyed_history", f"""SELECT station_id, hour AS timestamp, pm25, CAST(count(*) OVER ({_W}) AS INT) AS n,
  array_to_string(list_transform(list(pm25) OVER ({_W}), lambda x: CAST(round(x * 10000) AS BIGINT)), ',') AS history FROM pm""", "pm25")
def st3_keyed_history(spark, d):
    """Three runs of one checkpoint; each station's history continues from keyed state."""
    rows = src.pm(spark, d).withColumnRenamed("hour", "timestamp")
    out, _ = _in_runs(rows, F.col("timestamp"), _RUNS, state.histories, "keyed")
    shown = F.array_join(F.transform("history", lambda x: F.round(x * 10000).cast("long").cast("string")), ",")
    return spark.read.parquet(out).select("station_id", "timestamp", "pm25", F.size("history").alias("n"), shown.alias("history"))


@query("d3_stream_deliveries", "SELECT event_id, station_id, ts, CASE WHEN qa % 5 <> 0 THEN qa END AS qa, value FROM readings", "value")
def d3_stream_deliveries(spark, d):
    """Every third reading is delivered twice, the copy about an hour later and often in another run; a null in the key is equal to another."""
    rows = src.readings(spark, d).select("event_id", "station_id", "ts", F.when(F.col("qa") % 5 != 0, F.col("qa")).alias("qa"), "value")
    copies = F.when(F.col("event_id") % 3 == 0, F.array(F.lit(0), F.lit(70))).otherwise(F.array(F.lit(0)))
    rows = materialize(rows.withColumn("delay", F.explode(copies)))
    flow = lambda s: state.first_deliveries(s.drop("delay"), ["station_id", "event_id", "qa"])
    out, _ = _in_runs(rows, F.timestamp_add("MINUTE", F.col("delay") + F.col("event_id") % 40, F.col("ts")), _RUNS, flow, "deliveries")
    return spark.read.parquet(out)


@query("j2_stream_weather", f"""SELECT station_id, hour AS timestamp, met_id, age_hours, {', '.join(src.MET_VALUES)} FROM (
  SELECT pm.station_id, pm.hour, m.* EXCLUDE hour, datediff('hour', m.hour, pm.hour) AS age_hours,
    row_number() OVER (PARTITION BY pm.station_id, pm.hour ORDER BY {hav('s.lat', 's.lon', 'm.lat', 'm.lon')}, m.met_id) AS rn
  FROM pm JOIN stations s USING (station_id) CROSS JOIN (SELECT DISTINCT met_id FROM met) k
  ASOF JOIN met m ON m.met_id = k.met_id AND m.hour <= pm.hour)
WHERE rn = 1 AND hour <= (SELECT greatest((SELECT max(hour) FROM pm), (SELECT max(hour) FROM met)) - INTERVAL 2 HOUR)""", "|".join(src.MET_VALUES))
def j2_stream_weather(spark, d):
    """Hours and weather reports as two streams that arrive out of order; an hour gets its weather when the watermark has passed it."""
    p = src.pm(spark, d).select("station_id", F.col("hour").alias("timestamp"))
    m = src.met(spark, d)
    edges = materialize(state.ranked_sources(src.stations(spark, d), m.groupBy("met_id").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon")), 3))
    rows = p.withColumn("kind", F.lit("tick")).unionByName(
        m.select("met_id", F.col("hour").alias("timestamp"), *src.MET_VALUES, F.lit("report").alias("kind")), allowMissingColumns=True)
    jitter = F.pmod(F.xxhash64("station_id", "met_id", "timestamp"), F.lit(100))
    rows = materialize(rows.withColumn("arrival", F.timestamp_add("MINUTE", jitter, F.col("timestamp"))))

    def flow(s):
        reports = s.filter("kind = 'report'").select("met_id", "timestamp", *src.MET_VALUES).join(edges, "met_id")
        return state.as_of(s.filter("kind = 'tick'").select("station_id", "timestamp"), reports, ["met_id", *src.MET_VALUES])
    out, _ = _in_runs(rows, F.col("arrival"), _RUNS, flow, "weather")
    age = F.timestamp_diff("HOUR", F.col("report_at"), F.col("timestamp"))
    return spark.read.parquet(out).select("station_id", "timestamp", "met_id", age.alias("age_hours"), *src.MET_VALUES)


def canonical(spark, d):
    """Single PM readings and weather reports in one measurement stream, several a station and hour, and one from the future."""
    r = src.events(spark, d).select("event_id", F.date_trunc("hour", "ts").alias("timestamp"), F.col("ts").alias("ingested_at"), "user_id", "event_type", "value")
    value = lambda kind, scale=1: F.when(F.col("event_type") == kind, F.col("value") / scale)
    none = F.lit(None).cast("double")
    pm = r.filter("event_type = 'view'").join(
        src.stations(spark, d).select("station_id", "lat", "lon"), F.concat(F.lit("st-"), (F.col("user_id") % 8).cast("string")) == F.col("station_id")).select(
        "station_id", F.lit("openaq").alias("source"), "timestamp", "ingested_at", "event_id", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
        F.col("value").alias("pm25"), *[none.alias(c) for c in src.MET_VALUES])
    i = F.col("user_id") % 3
    met = r.select(
        F.concat(F.lit("met-"), i.cast("string")).alias("station_id"), F.lit("envcanada").alias("source"), "timestamp", "ingested_at", "event_id",
        (F.lit(43.6) + F.lit(0.1) * i).alias("latitude"), (F.lit(-79.7) + F.lit(0.13) * i).alias("longitude"), none.alias("pm25"),
        value("error").alias("wind_speed"), value("signup").alias("wind_dir"), value("click").alias("temperature"),
        value("purchase").alias("humidity"), value("view", 10).alias("dew_point"))
    ahead = pm.orderBy("event_id").limit(1)
    ahead = ahead.withColumns({"timestamp": F.col("timestamp") + F.expr("interval 500 days"), "pm25": F.lit(999.0)})
    return pm.unionByName(met).unionByName(ahead)


_LAST_PM = "(SELECT station_id, hour, max_by(value, (ts, event_id)) AS pm25 FROM readings WHERE parameter = 'pm25' GROUP BY 1, 2)"
_OF = lambda kind, scale="": f"max_by(value{scale}, (ts, event_id)) FILTER (WHERE event_type = '{kind}')"
_LAST_MET = f"""(SELECT concat('met-', CAST(user_id % 3 AS VARCHAR)) AS met_id, date_trunc('hour', ts) AS hour, min(43.6e0 + 0.1e0 * (user_id % 3)) AS lat,
  min(-79.7e0 + 0.13e0 * (user_id % 3)) AS lon, {_OF('error')} AS wind_speed, {_OF('signup')} AS wind_dir FROM events GROUP BY 1, 2)"""
_LAST_HOUR = "(SELECT date_trunc('hour', max(ts)) - INTERVAL 3 HOUR FROM events)"
_SPINE2 = f"""(SELECT station_id, unnest(generate_series(min(hour), {_LAST_HOUR}, INTERVAL 1 HOUR)) AS hour FROM {_LAST_PM} GROUP BY 1)"""
_WIND2 = f"""(SELECT station_id, hour, coalesce(wind_speed, 0) * cos(radians(coalesce(wind_dir, 0))) AS wind_u,
  coalesce(wind_speed, 0) * sin(radians(coalesce(wind_dir, 0))) AS wind_v FROM (
  SELECT t.station_id, t.hour, m.wind_speed, m.wind_dir, row_number() OVER (PARTITION BY t.station_id, t.hour ORDER BY {hav('s.lat', 's.lon', 'm.lat', 'm.lon')}, m.met_id) AS rn
  FROM {_SPINE2} t JOIN stations s USING (station_id) CROSS JOIN (SELECT DISTINCT met_id FROM met) k
  ASOF JOIN {_LAST_MET} m ON m.met_id = k.met_id AND m.hour <= t.hour) WHERE rn = 1)"""
_SLOTS2 = f"""(SELECT s.station_id, s.hour, p.pm25, coalesce(w.wind_u, 0) AS wind_u, coalesce(w.wind_v, 0) AS wind_v
  FROM {_SPINE2} s LEFT JOIN {_LAST_PM} p ON s.station_id = p.station_id AND s.hour = p.hour
  LEFT JOIN {_WIND2} w ON s.station_id = w.station_id AND s.hour = w.hour)"""
_INFL2 = f"""(SELECT t.station_id, t.hour, t.wind_u, t.wind_v, p.pm25 AS v, e.dist_m,
  CASE WHEN sqrt(t.wind_u*t.wind_u + t.wind_v*t.wind_v) > 0 THEN (e.north*t.wind_u + e.east*t.wind_v)
    / (sqrt(e.north*e.north + e.east*e.east) * sqrt(t.wind_u*t.wind_u + t.wind_v*t.wind_v)) ELSE 0 END AS a
  FROM {_SLOTS2} t JOIN pairs e ON e.dst = t.station_id JOIN {_LAST_PM} p ON p.station_id = e.src AND p.hour = t.hour)"""
_EST2 = f"""(SELECT station_id, hour, sum({edge_weight('dist_m', 'a')} * v) / sum({edge_weight('dist_m', 'a')}) AS est,
  max(sqrt(wind_u*wind_u + wind_v*wind_v) * a) AS transport, avg(a) AS align FROM {_INFL2} GROUP BY 1, 2)"""
_HELD2 = f"""(SELECT *, last_value(pm25 IGNORE NULLS) OVER w AS last_value,
  epoch(hour - last_value(CASE WHEN pm25 IS NOT NULL THEN hour END IGNORE NULLS) OVER w) / 3600 AS gap_hours FROM {_SLOTS2}
  WINDOW w AS (PARTITION BY station_id ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
TICKS = f"""(SELECT *, count(*) OVER (PARTITION BY station_id ORDER BY hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS n_history FROM
  (SELECT h.station_id, h.hour, wind_u, wind_v, coalesce(pm25, CASE WHEN gap_hours <= 3 AND est IS NOT NULL THEN est ELSE last_value END) AS pm25,
    CASE WHEN pm25 IS NOT NULL THEN 'observed' WHEN gap_hours <= 3 AND est IS NOT NULL THEN 'spatial' ELSE 'temporal' END AS method,
    coalesce(est, 0) AS upwind, coalesce(transport, 0) AS transport, coalesce(align, 0) AS align
   FROM {_HELD2} h LEFT JOIN {_EST2} e ON h.station_id = e.station_id AND h.hour = e.hour))"""


def _ticks(spark, d, edges=("2024-01-11 09:40:00", "2024-01-21 18:15:00")):
    """The month in three runs of one checkpoint, cut inside hours."""
    rows = materialize(canonical(spark, d))
    stations, pairs = materialize(src.stations(spark, d)), materialize(src.pairs(spark, d))
    path, out, cp = scratch(spark, "canonical"), scratch(spark, "ticks"), scratch(spark, "cp")
    at = [F.lit(e).cast("timestamp") for e in edges]
    t = F.col("ingested_at")
    for part in (t < at[0], (t >= at[0]) & (t < at[1]), t >= at[1]):
        rows.filter(part).write.mode("append").parquet(path)
        flows.drain(open_stream(spark, path, rows.schema), cp, flows.HourlyFeatures(stations, pairs, out))
    return _flat_table(spark, f"{out}/features")


@query("st4_hourly_features", f"""SELECT station_id, hour AS timestamp, pm25, method, wind_u, wind_v, upwind, transport, align,
  CAST(n_history AS INT) AS n_history FROM {TICKS}""", "pm25|wind_u|wind_v|upwind|transport|align")
def st4_hourly_features(spark, d):
    f = lambda c: F.col("features")[c]
    return _ticks(spark, d).select(
        "station_id", "timestamp", f("pm25").alias("pm25"), "method", f("wind_u").alias("wind_u"), f("wind_v").alias("wind_v"),
        f("upwind_pm25").alias("upwind"), f("transport_potential").alias("transport"), f("wind_alignment").alias("align"),
        F.size("history").alias("n_history"))


@query("st5_stream_scoring")
def st5_stream_scoring(spark, d):
    frame, bundles = _bundle(spark, d)
    records = _records(frame)
    stream = open_stream(spark, feed(records, "timestamp", "features"), records.schema)
    out = scratch(spark, "predictions")
    flows.drain(flows.score(stream, bundles["lr"]), scratch(spark, "cp"), out)
    return spark.read.parquet(out).select("station_id", "timestamp", "forecast_pm25", "current_pm25", "model_type")


@query("st6_stream_alerts", f"""SELECT station_id, hour AS timestamp, level, level <> 'normal' AS alert, pm25 AS current_pm25,
  f AS forecast_pm25, {ADVICE_SQL} AS recommendation FROM {_EVAL}""", "current_pm25|forecast_pm25")
def st6_stream_alerts(spark, d):
    p = _predictions(spark, d)
    stream = open_stream(spark, feed(p, "timestamp", "predictions"), p.schema, maxFilesPerTrigger=2)
    out = scratch(spark, "alerts")
    flows.drain(flows.alert(stream), scratch(spark, "cp"), out)
    return spark.read.parquet(out)


@query("st7_live_state", """SELECT station_id, max(ts) AS timestamp, max_by(value, (ts, event_id)) AS value FROM readings GROUP BY 1""", "value")
def st7_live_state(spark, d):
    r = src.readings(spark, d).select("station_id", F.col("ts").alias("timestamp"), "event_id", "value")
    path = scratch(spark, "live")
    flows.drain(open_stream(spark, feed(r, "timestamp", "readings"), r.schema, maxFilesPerTrigger=1), scratch(spark, "cp"),
                flows.live_state_to(path, "measurements"))
    return sinks.read_state(spark, path, "measurements", r.schema).select("station_id", "timestamp", "value")


@query("st8_audit_sink", f"""SELECT concat_ws('|', station_id, source, strftime(timestamp, '%Y-%m-%dT%H:%M:%S+00:00')) AS dedup_key,
  strftime(timestamp, '%Y-%m-%d') AS date, {', '.join(
    f'max_by({c}, (ingested_at, event_id)) FILTER (WHERE {c} IS NOT NULL) AS {c}' for c in _NORM_COLS[4:])}
FROM {_NORM} GROUP BY station_id, source, timestamp""", _NORM_D)
def st8_audit_sink(spark, d):
    n = _normalized(spark, d).drop("error")
    path = scratch(spark, "audit")
    flows.drain(open_stream(spark, feed(n, "ingested_at", "measurements", 2), n.schema), scratch(spark, "cp"), flows.audit_to(path))
    return sinks.read_by_date(spark, path).select("dedup_key", "date", *_NORM_COLS[4:])


@query("st9_bounded_replay", """SELECT station_id, hour AS timestamp, pm25, CAST(count(*) OVER w AS INT) AS n_history, last_value(pm25) OVER w AS previous
FROM pm WHERE hour >= TIMESTAMP '2024-01-10' AND hour < TIMESTAMP '2024-01-20'
WINDOW w AS (PARTITION BY station_id ORDER BY hour ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)""", "pm25|previous")
def st9_bounded_replay(spark, d):
    """A slice with the history each record had then, replayed file by file."""
    part = clean.time_slice(src.pm(spark, d), "hour", "2024-01-10", "2024-01-20").withColumnRenamed("hour", "timestamp")
    f = series.history(part.withColumn("features", clean.feature_map(["pm25"])), ["station_id"], "timestamp",
                       F.col("features"), 12, include_current=False)
    out = scratch(spark, "replayed")
    flows.drain(open_stream(spark, feed(f, "timestamp", "replay"), f.schema, maxFilesPerTrigger=1), scratch(spark, "cp"), out)
    newest = F.try_element_at("history", F.lit(-1))
    return spark.read.parquet(out).select("station_id", "timestamp", "pm25", F.size("history").alias("n_history"),
                                          F.try_element_at(newest, F.lit("pm25")).alias("previous"))


@query("st10_latency")
def st10_latency(spark, d):
    """Predictions stamped on ingest, timed when their alerts have been written, summed up per station."""
    p = materialize(_predictions(spark, d)).withColumn("ingested_at", F.current_timestamp())
    stream = open_stream(spark, feed(p, "timestamp", "predictions"), p.schema)
    out = scratch(spark, "latency")
    alerts = flows.alerts.evaluate(stream, current=("current_pm25",))
    flows.drain(alerts, scratch(spark, "cp"), flows.timed_alerts_to(out))
    return aggregates.latency_summary(_flat_table(spark, f"{out}/latency"), ["station_id"], "ms")


@query("st10_latency_given_stamps", """SELECT station_id, avg(ms) AS mean, median(ms) AS median, quantile_cont(ms, 0.95) AS p95, min(ms) AS "min", max(ms) AS "max"
FROM (SELECT station_id, (qa * 37 % 1000) / 1.0e0 AS ms FROM readings) GROUP BY 1""", "mean|median|p95|min|max")
def st10_latency_given_stamps(spark, d):
    """The same summary over stamps that are known."""
    end = F.col("ts") + F.make_dt_interval(secs=(F.col("qa") * 37 % 1000 / 1000).cast("decimal(18,6)"))
    rows = src.readings(spark, d).select("station_id", flows.latency_ms(F.col("ts"), end).alias("ms"))
    return aggregates.latency_summary(rows, ["station_id"], "ms")


@query("st5_stream_scoring_one_feature", f"SELECT station_id, timestamp, current_pm25, h1 AS forecast_pm25, 'lr' AS model_type FROM {_AHEAD}",
       "current_pm25|forecast_pm25")
def st5_stream_scoring_one_feature(spark, d):
    frame = _one_frame(spark, d)
    bundle = models.train(frame, ["lr"], features=_ONE)[0]["lr"]
    records = _one_records(frame)
    stream = open_stream(spark, feed(records, "timestamp", "features"), records.schema, maxFilesPerTrigger=2)
    out = scratch(spark, "predictions")
    flows.drain(flows.score(stream, bundle), scratch(spark, "cp"), out)
    return spark.read.parquet(out).select("station_id", "timestamp", "forecast_pm25", "current_pm25", "model_type")


@query("src3_raw_stream", f"""SELECT source, event_id AS "offset", station_id, strftime(hour, '%Y-%m-%d %H') AS hour_utc, CASE WHEN source <> 'envcanada' THEN value END AS value
FROM {_RAW_SQL}""", "value")
def src3_raw_stream(spark, d):
    """Raw records of each source as they arrive, typed by the source's schema."""
    out = None
    for source, raw in _raws(spark, d).items():
        path, sink = scratch(spark, source), scratch(spark, "raw")
        raw.drop("event_id").write.json(path, ignoreNullFields=False)
        flows.drain(readers.raw_stream(spark, path, source, maxFilesPerTrigger=4), scratch(spark, "cp"), sink)
        value = {"openaq": "value", "iqair": "pm25"}.get(source)
        rows = spark.read.parquet(sink).select(
            F.lit(source).alias("source"), "offset", "station_id", F.substring(F.replace("datetime_utc", F.lit("T"), F.lit(" ")), 1, 13).alias("hour_utc"),
            (F.col(value) if value else F.lit(None).cast("double")).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out
