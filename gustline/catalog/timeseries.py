"""Window, sequence, training-frame and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import aggregates, clean, diffusion, joins, ranking, series
from ..plans import frames, recipes
from ..session import materialize
from ..sources import tables as src
from .prelude import cyclic
from .registry import query

K = ["station_id"]
W = "PARTITION BY station_id ORDER BY ts"
PREV = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
NEXT = f"({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
LAG_NAMES = [f"pm25_lag{k}" for k in range(1, 7)] + ["pm25_lag12"]


@query("w1_lags", f"""SELECT station_id, ts, pm25, {', '.join(f'lag(pm25, {k}) OVER ({W}) AS pm25_lag{k}' for k in (1, 2, 3, 4, 5, 6, 12))}
FROM daily""", "|".join(["pm25", *LAG_NAMES]))
def w1_lags(spark, d):
    return series.features(src.daily(spark, d), K, "ts", lags={"pm25": [1, 2, 3, 4, 5, 6, 12]}, block_rows=512)


_ROLL = f"({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"


@query("w2_rolling", f"""SELECT station_id, ts, pm25, avg(pm25) OVER r AS pm25_roll3_mean, stddev_samp(pm25) OVER r AS pm25_roll3_std,
  min(pm25) OVER r AS pm25_roll3_min, max(pm25) OVER r AS pm25_roll3_max FROM daily WINDOW r AS {_ROLL}""",
       "pm25|pm25_roll3_mean|pm25_roll3_std|pm25_roll3_min|pm25_roll3_max")
def w2_rolling(spark, d):
    return series.features(src.daily(spark, d), K, "ts", rolls={"pm25": [3]}, stats=("mean", "std", "min", "max"), block_rows=512)


@query("w3_fill", f"""SELECT station_id, ts, coalesce(pm25, last_value(pm25 IGNORE NULLS) OVER {PREV}) AS ahead,
  coalesce(pm25, last_value(pm25 IGNORE NULLS) OVER {PREV}, first_value(pm25 IGNORE NULLS) OVER {NEXT}, 0) AS pm25 FROM sparse""", "ahead|pm25")
def w3_fill(spark, d):
    s = src.sparse(spark, d).withColumn("ahead", F.col("pm25"))
    return series.fill(series.fill(s, K, "ts", ["ahead"]), K, "ts", ["pm25"], backward=True, default=0.0)


_KNOWN = f"""(SELECT *, last_value(CASE WHEN pm25 IS NOT NULL THEN pos END IGNORE NULLS) OVER {PREV} AS a0,
  first_value(CASE WHEN pm25 IS NOT NULL THEN pos END IGNORE NULLS) OVER {NEXT} AS a1,
  last_value(pm25 IGNORE NULLS) OVER {PREV} AS v0, first_value(pm25 IGNORE NULLS) OVER {NEXT} AS v1 FROM ({{}}))"""
_BY_ROW = f"SELECT station_id, ts, pm25, row_number() OVER ({W}) AS pos FROM sparse"
_BY_TIME = "SELECT station_id, ts, pm25, epoch(ts) AS pos FROM sparse"
_LINE = "v0 + (v1 - v0) * ((pos - a0) / nullif(a1 - a0, 0))"


@query("w4_interpolate_rows", f"""SELECT station_id, ts, coalesce(pm25, {_LINE}, v0,
  median(pm25) OVER (PARTITION BY station_id)) AS pm25 FROM {_KNOWN.format(_BY_ROW)}""", "pm25")
def w4_interpolate_rows(spark, d):
    s = src.sparse(spark, d)
    q = ranking.exact_percentiles(s, K, ["pm25"], [0.5])
    out = series.interpolate_by_row(s, K, "ts", ["pm25"], block_rows=512).join(q, K)
    return out.select("station_id", "ts", F.coalesce(F.col("pm25"), F.col("pm25__q")[0]).alias("pm25"))


@query("w5_interpolate_time", f"SELECT station_id, ts, coalesce(pm25, {_LINE}, v0, v1) AS pm25 FROM {_KNOWN.format(_BY_TIME)}", "pm25")
def w5_interpolate_time(spark, d):
    return series.interpolate_by_time(src.sparse(spark, d), K, "ts", ["pm25"])


def _hourly_text(spark, d):
    """Sparse daily series as a historical text table with wind in tens of degrees."""
    s = src.sparse(spark, d)
    return s.select(
        F.col("station_id").alias("city_name"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.col("pm25").cast("string").alias("PM25"), (F.col("pm25") / 10).alias("wind spd definition km/h"),
        F.dayofyear("ts").cast("string").alias("wind dir definition 10's deg"))


@query("w6_modelling_frame", f"""SELECT station_id AS city_name, ts AS timestamp, pm2, spd * cos(radians(doy * 10)) AS wind_u,
  spd * sin(radians(doy * 10)) AS wind_v, CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) - 1 AS INT) AS dayofweek, {cyclic('ts')},
  (dense_rank() OVER (ORDER BY station_id) - 1)::DOUBLE AS city_code FROM
  (SELECT station_id, ts, dayofyear(ts) AS doy, coalesce(last_value(pm25 IGNORE NULLS) OVER {PREV}, 0) AS pm2,
    coalesce(last_value(pm25 / 10 IGNORE NULLS) OVER {PREV}, 0) AS spd FROM sparse)""",
       "pm2|wind_u|wind_v|hour_sin|hour_cos|dow_sin|dow_cos|city_code")
def w6_modelling_frame(spark, d):
    return frames.modelling_frame(_hourly_text(spark, d)).drop("Wind Spd Definition km/h", "Wind Dir Definition 10's deg")


@query("p18_feature_dispatch", f"""SELECT 'ha' AS model, station_id AS city_name, ts AS timestamp, pm25 AS pm2, CAST(NULL AS DOUBLE) AS hour_sin FROM sparse
UNION ALL SELECT 'lr', station_id, ts, coalesce(last_value(pm25 IGNORE NULLS) OVER {PREV}, 0), sin(2*pi()*hour(ts)/24) FROM sparse""", "pm2|hour_sin")
def p18_feature_dispatch(spark, d):
    text = _hourly_text(spark, d)
    plain = frames.feature_frame("ha", 1, clean.alias_headers(text)).select(
        F.lit("ha").alias("model"), "city_name", "timestamp", "pm2", F.lit(None).cast("double").alias("hour_sin"))
    rich = frames.feature_frame("lr", 2, text).select(F.lit("lr").alias("model"), "city_name", "timestamp", "pm2", "hour_sin")
    return plain.unionByName(rich)


_W7_COLS = [f"pm25_lag{k}" for k in range(1, 7)] + [f"pm25_roll3{s}" for s in ("", "_mean", "_std", "_min", "_max")]


@query("w7_rolling_features", f"""SELECT city_name, ts AS timestamp, pm25, {', '.join(f'lag(pm25, {k}) OVER w AS pm25_lag{k}' for k in range(1, 7))},
  avg(pm25) OVER r AS pm25_roll3, avg(pm25) OVER r AS pm25_roll3_mean, stddev_samp(pm25) OVER r AS pm25_roll3_std,
  min(pm25) OVER r AS pm25_roll3_min, max(pm25) OVER r AS pm25_roll3_max, CAST(hour(ts) AS INT) AS hour,
  CAST(isodow(ts) - 1 AS INT) AS dayofweek, {cyclic('ts')} FROM
  (SELECT k.station_id AS city_name, ts, greatest(lo, least(hi, coalesce(pm25, {_LINE}, v0, mid))) AS pm25
   FROM {_KNOWN.format(_BY_ROW)} k JOIN (SELECT station_id, quantile_cont(pm25, 0.01) AS lo, median(pm25) AS mid,
     quantile_cont(pm25, 0.99) AS hi FROM sparse GROUP BY 1) q ON k.station_id = q.station_id)
WINDOW w AS (PARTITION BY city_name ORDER BY ts), r AS (PARTITION BY city_name ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
       "|".join(["pm25", *_W7_COLS, "hour_sin", "hour_cos", "dow_sin", "dow_cos"]))
def w7_rolling_features(spark, d):
    s = src.sparse(spark, d).withColumnsRenamed({"station_id": "city_name", "ts": "timestamp"})
    return frames.rolling_feature_table(s, ["pm25"])


@query("w8_shifted_target", f"""SELECT * FROM (SELECT station_id, ts, pm25, lead(pm25, 3) OVER ({W}) AS target_shifted FROM sparse)
WHERE target_shifted IS NOT NULL""", "pm25|target_shifted")
def w8_shifted_target(spark, d):
    return series.shifted_target(src.sparse(spark, d), K, "ts", "pm25", 3, block_rows=512)


_ORDERED = "(SELECT *, row_number() OVER (ORDER BY ts, md5(station_id), station_id) AS rn, count(*) OVER () AS n FROM daily)"
_SPLIT = "CASE WHEN rn <= floor(n * 0.70e0) THEN 'train' WHEN rn <= floor(n * 0.85e0) THEN 'val' ELSE 'test' END"


@query("w9_chronological_split", f"SELECT station_id, ts, {_SPLIT} AS split FROM {_ORDERED}")
def w9_chronological_split(spark, d):
    return ranking.chronological_split(src.daily(spark, d), "ts", "station_id").select("station_id", "ts", "split")


@query("w10_history", f"""SELECT station_id, ts, count(*) OVER a AS n, sum(pm25) OVER a AS total, first_value(pm25) OVER a AS oldest,
  coalesce(count(*) OVER b, 0) AS n_before, last_value(pm25) OVER b AS newest_before FROM daily WINDOW
  a AS ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), b AS ({W} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)""", "total|oldest|newest_before")
def w10_history(spark, d):
    h = series.history(src.daily(spark, d), K, "ts", F.col("pm25"), 24, block_rows=512)
    h = series.history(h, K, "ts", F.col("pm25"), 12, include_current=False, name="before", block_rows=512)
    return h.select("station_id", "ts", F.size("history").cast("long").alias("n"),
                    F.aggregate("history", F.lit(0.0), lambda a, x: a + x).alias("total"), F.col("history")[0].alias("oldest"),
                    F.size("before").cast("long").alias("n_before"), F.try_element_at("before", F.lit(-1)).alias("newest_before"))


def _flat(df):
    """Window rows as comparable numbers: its sum and its first and last features."""
    sums = F.aggregate(F.flatten("window"), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return df.withColumns({"steps": F.size("window").cast("long"), "total": sums, "first_x": F.col("window")[0][0],
                           "last_x": F.element_at(F.element_at("window", -1), 1)}).drop("window")


_SEQ_WIN = f"({W} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)"
_SEQ = f"""SELECT station_id, ts, {{label}} AS label, 24::BIGINT AS steps, sum(coalesce(pm25, 0) + day(ts)) OVER s AS total,
  first_value(pm25) OVER s AS first_x, last_value(pm25) OVER s AS last_x, count(*) OVER s AS rows_in, count(pm25) OVER s AS known,
  row_number() OVER ({W}) AS rn, count(*) OVER (PARTITION BY station_id) AS n FROM sparse WINDOW s AS {_SEQ_WIN}"""


def _seq_input(spark, d):
    return src.sparse(spark, d).withColumnsRenamed({"ts": "timestamp"}).withColumn("d", F.dayofmonth("timestamp").cast("double"))


# About a quarter of the values is missing, so short windows are used where nulls must not occur.
_SEQ4 = _SEQ.replace("24 PRECEDING", "4 PRECEDING").replace("24::BIGINT", "4::BIGINT")


@query("w11_sequences", f"""SELECT station_id, ts AS timestamp, label, steps, total, first_x, last_x FROM
  ({_SEQ4.format(label=f'lead(pm25, 2) OVER ({W})')}) WHERE rows_in = 4 AND known = 4 AND label IS NOT NULL""", "label|total|first_x|last_x")
def w11_sequences(spark, d):
    return _flat(frames.sequences(_seq_input(spark, d), ["pm25", "d"], "pm25", history=4, label_offset=2, block_rows=512))


@query("w11_sequences_day", f"""SELECT station_id, ts AS timestamp, label, steps, total, first_x, last_x FROM
  ({_SEQ.format(label=f'lead(pm25, 2) OVER ({W})').replace("FROM sparse", "FROM daily")}) WHERE rows_in = 24 AND known = 24 AND label IS NOT NULL""", "label|total|first_x|last_x")
def w11_sequences_day(spark, d):
    """The registered history of 24 steps, on the series without gaps."""
    rows = src.daily(spark, d).withColumnsRenamed({"ts": "timestamp"}).withColumn("d", F.dayofmonth("timestamp").cast("double"))
    return _flat(frames.sequences(rows, ["pm25", "d"], "pm25", history=24, label_offset=2, block_rows=512))


@query("w12_sequences_unfiltered", f"""SELECT station_id, ts AS timestamp, label, steps, total, first_x, last_x FROM
  ({_SEQ.format(label='pm25')}) WHERE rows_in = 24""", "label|total|first_x|last_x")
def w12_sequences_unfiltered(spark, d):
    return _flat(frames.sequences(_seq_input(spark, d), ["pm25", "d"], "pm25", history=24, skip_nulls=False, block_rows=512))


def _graph_sql(edges):
    return f"""SELECT station_id, node_id, timestamp, wind_u, wind_v, label, steps, total, first_x, last_x FROM
  (SELECT *, lead(x, 2) OVER w AS label, count(*) OVER s AS steps, sum(x + wind_u) OVER s AS total,
    first_value(x) OVER s AS first_x, last_value(x) OVER s AS last_x FROM
    (SELECT t.station_id, t.station_id AS node_id, t.hour AS timestamp, t.pm25 AS x, wind_u, wind_v FROM targets t UNION ALL
     SELECT t.station_id, e.src, t.hour, coalesce(p.pm25, 0), wind_u, wind_v FROM targets t JOIN {edges} e ON e.dst = t.station_id
     LEFT JOIN pm p ON p.station_id = e.src AND p.hour = t.hour)
   WINDOW w AS (PARTITION BY station_id, node_id ORDER BY timestamp),
     s AS (PARTITION BY station_id, node_id ORDER BY timestamp ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
WHERE steps = 24 AND label IS NOT NULL"""


def _graph(spark, d, edges):
    t = materialize(src.targets(spark, d).withColumnRenamed("hour", "timestamp").select(
        "station_id", "timestamp", "pm25", "wind_u", "wind_v"))
    nodes = frames.node_table(t, src.pm(spark, d).withColumnRenamed("hour", "timestamp"), edges, {"pm25": "pm25"})
    return _flat(frames.graph_sequences(nodes, ["pm25", "wind_u"], horizon=2))


@query("w13_graph_sequences", _graph_sql("pairs"), "wind_u|wind_v|label|total|first_x|last_x")
def w13_graph_sequences(spark, d):
    return _graph(spark, d, src.pairs(spark, d))


@query("w13_knn_graph_sequences", _graph_sql("(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY dist_m, src) AS rn FROM pairs) WHERE rn <= 3)"),
       "wind_u|wind_v|label|total|first_x|last_x")
def w13_knn_graph_sequences(spark, d):
    """Each station with its three nearest, so the samples grow with the stations."""
    return _graph(spark, d, diffusion.neighbour_edges(src.stations(spark, d), 3))


_BEFORE = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("w14_last_known", f"SELECT station_id, ts, last_value(pm25 IGNORE NULLS) OVER {_BEFORE} AS last_value FROM sparse", "last_value")
def w14_last_known(spark, d):
    return series.last_known_before(src.sparse(spark, d), K, "ts", "pm25", gap=None).select("station_id", "ts", "last_value")


@query("w17_gap_hours", f"""SELECT station_id, ts, epoch(ts - last_value(CASE WHEN pm25 IS NOT NULL THEN ts END IGNORE NULLS) OVER {_BEFORE}) / 3600.0e0
  AS gap_hours FROM sparse""", "gap_hours")
def w17_gap_hours(spark, d):
    return series.last_known_before(src.sparse(spark, d), K, "ts", "pm25").select("station_id", "ts", "gap_hours")


@query("m8_cyclic_time", f"SELECT event_id, {cyclic('ts')} FROM events", "hour_sin|hour_cos|dow_sin|dow_cos")
def m8_cyclic_time(spark, d):
    return series.time_features(src.events(spark, d), "ts").select("event_id", "hour_sin", "hour_cos", "dow_sin", "dow_cos")


@query("a9_exact_quantiles", """SELECT station_id, quantile_cont(value, 0.01) AS q01, median(value) AS q50, quantile_cont(value, 0.99) AS q99
FROM readings GROUP BY 1""", "q01|q50|q99")
def a9_exact_quantiles(spark, d):
    q = ranking.exact_percentiles(src.readings(spark, d), K, ["value"], [0.01, 0.5, 0.99])
    return q.select("station_id", *[F.col("value__q")[i].alias(n) for i, n in enumerate(("q01", "q50", "q99"))])


@query("a10_robust_scale", f"""SELECT station_id, ts, (pm25 - mid) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END AS pm25, 0.0e0 AS flat
FROM daily CROSS JOIN (SELECT median(pm25) AS mid, quantile_cont(pm25, 0.25) AS lo, quantile_cont(pm25, 0.75) AS hi
  FROM {_ORDERED} WHERE {_SPLIT} = 'train')""", "pm25|flat")
def a10_robust_scale(spark, d):
    """The constant column has no range and is only centred."""
    df = materialize(ranking.chronological_split(src.daily(spark, d), "ts", "station_id")).withColumn("flat", F.lit(5.0))
    return aggregates.robust_scale(df, ["pm25", "flat"], F.col("split") == "train").drop("split")


# --- training frame -------------------------------------------------------------------------------

_NAMES = """hour AS timestamp, temperature AS "temp definition °c", dew_point AS "dew point definition °c",
  humidity AS "rel hum definition %", wind_u, wind_v, pm25, upwind_pm25, transport_potential, wind_alignment, no, no2, nox, o3"""
_TW = "PARTITION BY station_id ORDER BY hour"
PREPARED = f"""(SELECT station_id, {_NAMES}, {cyclic('hour')},
  {', '.join(f'''coalesce(lag(pm25, {k}) OVER ({_TW}), CASE WHEN count(*) OVER (PARTITION BY station_id) > {k}
    THEN first_value(pm25) OVER ({_TW}) ELSE 0 END) AS pm25_lag{k}''' for k in scalar.LAGS)},
  {', '.join(f'avg(pm25) OVER ({_TW} ROWS BETWEEN {r - 1} PRECEDING AND CURRENT ROW) AS pm25_roll{r}_mean' for r in scalar.ROLLS)}
  FROM training)"""


def training(spark, d):
    return frames.training_table(src.pm(spark, d), src.stations(spark, d), src.met(spark, d), src.gases(spark, d), src.pairs(spark, d))


def prepared(spark, d):
    """The stored training table, prepared. Every model below starts here."""
    return materialize(frames.prepare_training(materialize(training(spark, d))))


_PLAIN = {"temp definition °c": "temp", "dew point definition °c": "dew", "rel hum definition %": "hum"}
_TRAIN_COLS = [_PLAIN.get(c, c) for c in recipes.BASE + recipes.DIFFUSION + recipes.GASES]


@query("f0b_training_table", """SELECT station_id, hour AS timestamp, temperature AS temp, dew_point AS dew, humidity AS hum, wind_u, wind_v,
  pm25, upwind_pm25, transport_potential, wind_alignment, no, no2, nox, o3 FROM training""", "|".join(_TRAIN_COLS))
def f0b_training_table(spark, d):
    return training(spark, d).withColumnsRenamed(_PLAIN).select("station_id", "timestamp", *_TRAIN_COLS)


_PARAMETERS = ["pm25", "temperature", "humidity", "wind_speed", "wind_dir"]
_OPEN = "PARTITION BY station_id ORDER BY hour ROWS BETWEEN"
_BETWEEN = lambda p: f"""last_value({p} IGNORE NULLS) OVER a AS {p}_l0, first_value({p} IGNORE NULLS) OVER b AS {p}_l1,
    last_value(CASE WHEN {p} IS NOT NULL THEN hour END IGNORE NULLS) OVER a AS {p}_t0, first_value(CASE WHEN {p} IS NOT NULL THEN hour END IGNORE NULLS) OVER b AS {p}_t1"""  # noqa: E731
_FILLED = lambda p: f"coalesce({p}, {p}_l0 + ({p}_l1 - {p}_l0) * (epoch(hour) - epoch({p}_t0)) / nullif(epoch({p}_t1) - epoch({p}_t0), 0), {p}_l0, {p}_l1) AS {p}"


@query("f0a_archive_hours", f"""SELECT station_id, hour, {', '.join(map(_FILLED, _PARAMETERS))} FROM (SELECT *, {', '.join(map(_BETWEEN, _PARAMETERS))} FROM
  (SELECT s.station_id, s.hour, h.* EXCLUDE (station_id, hour) FROM
    (SELECT station_id, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM readings GROUP BY 1) s
    LEFT JOIN (SELECT station_id, hour, {', '.join(f"avg(value) FILTER (WHERE parameter = '{p}') AS {p}" for p in _PARAMETERS)} FROM readings GROUP BY 1, 2) h
      ON s.station_id = h.station_id AND s.hour = h.hour)
  WINDOW a AS ({_OPEN} UNBOUNDED PRECEDING AND CURRENT ROW), b AS ({_OPEN} CURRENT ROW AND UNBOUNDED FOLLOWING))""", "|".join(_PARAMETERS))
def f0a_archive_hours(spark, d):
    return frames.archive_hours(src.readings(spark, d), _PARAMETERS)


@query("w18_prepare_training", f"""SELECT station_id, timestamp, pm25, hour_sin, hour_cos, dow_sin, dow_cos, {', '.join(recipes.LAGS)}
FROM {PREPARED}""", "|".join(["pm25", *recipes.TIME, *recipes.LAGS]))
def w18_prepare_training(spark, d):
    return frames.prepare_training(training(spark, d)).select("station_id", "timestamp", "pm25", *recipes.TIME, *recipes.LAGS)


_IDS = [f"st-{i}" for i in range(1, 8)]


@query("p12_neighbour_columns", f"""SELECT t.hour, t.pm25, {', '.join(f'coalesce(max(p.pm25) FILTER (WHERE p.station_id = {i!r}), 0) AS "pm25_{i}"' for i in _IDS)}
FROM pm t LEFT JOIN pm p ON p.hour = t.hour AND p.station_id <> 'st-0' WHERE t.station_id = 'st-0' GROUP BY 1, 2""",
       "|".join(["pm25", *[f"pm25_{i}" for i in _IDS]]))
def p12_neighbour_columns(spark, d):
    p = src.pm(spark, d)
    own = joins.known_stations(p, src.stations(spark, d), role="target").select("hour", "pm25")
    return frames.neighbour_columns(own, p, _IDS, {"pm25": "pm25"})


_AROUND = {"pm25": "pm25", "wind_u": "wind_u", "wind_v": "wind_v", "temperature": "temperature"}
_ROUND_COLS = [f"{p}_{i}" for i in _IDS for p in _AROUND.values()]


@query("p12_neighbour_weather", f"""SELECT t.station_id, t.hour, {', '.join(f'coalesce(max(p.{c}) FILTER (WHERE p.station_id = {i!r}), 0) AS "{n}_{i}"' for i in _IDS for c, n in _AROUND.items())}
FROM targets t LEFT JOIN targets p ON p.hour = t.hour GROUP BY 1, 2""", "|".join(_ROUND_COLS))
def p12_neighbour_weather(spark, d):
    """Readings, wind and temperature of the listed stations beside every station's hours."""
    t = materialize(src.targets(spark, d))
    return frames.neighbour_columns(t.select("station_id", "hour"), t, _IDS, _AROUND)


def design_sql(features, h):
    logged = {n for c in scalar.LOG_SKEWED for n in (c, *[f"{c}_lag{k}" for k in scalar.LAGS], *[f"{c}_roll{r}_mean" for r in scalar.ROLLS])}
    x = lambda f: f'ln(1 + greatest("{f}", 0))' if f in logged else f'"{f}"'
    cols = list(features)
    base = f"""(SELECT station_id, timestamp, y, {', '.join(f'{x(f)} AS x{i}' for i, f in enumerate(cols))},
      row_number() OVER (ORDER BY timestamp, md5(station_id), station_id) AS rn, count(*) OVER () AS n FROM
      (SELECT *, lead(pm25, {h}) OVER (PARTITION BY station_id ORDER BY timestamp) AS y FROM {PREPARED}) WHERE y IS NOT NULL)"""
    q = ", ".join(f"median(x{i}) AS m{i}, quantile_cont(x{i}, 0.75) - quantile_cont(x{i}, 0.25) AS r{i}" for i in range(len(cols)))
    scaled = ", ".join(f"(x{i} - m{i}) / CASE WHEN r{i} = 0 THEN 1 ELSE r{i} END AS x{i}" for i in range(len(cols)))
    return f"""SELECT station_id, timestamp, y, {_SPLIT} AS split, {scaled} FROM {base}
      CROSS JOIN (SELECT {q} FROM {base} WHERE {_SPLIT} = 'train')"""


_LR2 = recipes.features_for("lr", 2)


@query("f1_design_matrix", design_sql(_LR2, 2), "|".join(["y", *[f"x{i}" for i in range(len(_LR2))]]))
def f1_design_matrix(spark, d):
    m = frames.design_matrix(prepared(spark, d), _LR2, 2)
    return m.select("station_id", "timestamp", "y", "split", *[clean.named(f).alias(f"x{i}") for i, f in enumerate(_LR2)])


_RECIPE_SQL = " UNION ALL ".join(
    f"SELECT station_id, timestamp, '{name}' AS recipe, {' + '.join(chr(34) + c + chr(34) for c in cols)} AS total FROM {PREPARED}"
    for name, cols in recipes.RECIPES.items())


@query("p10_feature_recipes", _RECIPE_SQL, "total")
def p10_feature_recipes(spark, d):
    """Every recipe selects its columns; their sum stands for the selected vector."""
    frame = prepared(spark, d)
    total = lambda cols: sum([clean.named(c) for c in cols[1:]], clean.named(cols[0]))
    picks = F.explode(F.array(*[F.struct(F.lit(n).alias("recipe"), total(c).alias("total")) for n, c in recipes.RECIPES.items()]))
    return frame.select("station_id", "timestamp", picks.alias("r")).select("station_id", "timestamp", "r.*")


# --- serving --------------------------------------------------------------------------------------

_SERVE = ["pm25", "pm25_lag1", "pm25_lag3", "pm25_roll3_mean", "hour_sin", "dow_cos"]
_L = "ln(1 + pm25)"


@query("w15_serving_features", f"""SELECT station_id, ts AS timestamp, l AS pm25, coalesce(lag(l, 1) OVER w, l) AS pm25_lag1,
  coalesce(lag(l, 3) OVER w, l) AS pm25_lag3,
  (l + coalesce(lag(l, 1) OVER w, l) + coalesce(lag(l, 2) OVER w, lag(l, 1) OVER w, l)) / 3 AS pm25_roll3_mean,
  sin(2*pi()*hour(ts)/24) AS hour_sin, cos(2*pi()*(isodow(ts)-1)/7) AS dow_cos
FROM (SELECT *, {_L} AS l FROM daily) WINDOW w AS ({W})""", "|".join(_SERVE))
def w15_serving_features(spark, d):
    cols = frames.serving_columns(_SERVE, F.col("timestamp"))
    return _records(spark, d).select("station_id", "timestamp", *[c.alias(n) for n, c in cols.items()])


def _records(spark, d, length=24):
    """Feature records of the dense series, history included, as the live stream carries them."""
    f = src.daily(spark, d).withColumnRenamed("ts", "timestamp").withColumn("features", clean.feature_map(["pm25"]))
    return series.history(f, K, "timestamp", F.col("features"), length, block_rows=512)


@query("w16_history_matrix", f"""SELECT station_id, ts AS timestamp, CAST(step AS INT) AS step, v[13 + step] AS pm25, v[12 + step] AS pm25_lag1, v[1 + step] AS pm25_lag12,
  (v[13 + step] + v[12 + step] + v[11 + step]) / 3 AS pm25_roll3_mean, sin(2*pi()*hour(ts - (23 - step) * INTERVAL 1 HOUR)/24) AS hour_sin FROM
  (SELECT station_id, ts, list_concat(list_transform(range(36 - len(h)), lambda i: h[1]), h) AS v, unnest(range(24)) AS step FROM
    (SELECT station_id, ts, list({_L}) OVER ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS h FROM daily))""",
       "pm25|pm25_lag1|pm25_lag12|pm25_roll3_mean|hour_sin")
def w16_history_matrix(spark, d):
    return frames.history_matrix(_records(spark, d), ["pm25", "pm25_lag1", "pm25_lag12", "pm25_roll3_mean", "hour_sin"])


# --- evaluation of stored predictions -------------------------------------------------------------

_WIDTHS = (1, 3, 6, 12)


def stored_predictions(spark, d):
    """Rolling means of several widths as forecasts of the dense series, per horizon and split."""
    s = materialize(ranking.chronological_split(src.daily(spark, d), "ts", "station_id"))
    f = series.features(s, K, "ts", rolls={"pm25": _WIDTHS}, leads={"pm25": recipes.HORIZONS}, block_rows=512)
    rows = F.explode(F.array(*[
        F.struct(F.lit(f"roll{w}").alias("model"), F.lit(w).alias("trial"), F.lit(h).alias("horizon"),
                 F.col(f"pm25_lead{h}").alias("y"), F.col(f"pm25_roll{w}_mean").alias("p"))
        for w in _WIDTHS for h in recipes.HORIZONS]))
    return f.select("station_id", "ts", "split", rows.alias("r")).select("station_id", "ts", "split", "r.*")


_STORED = f"""(SELECT station_id, ts, split, 'roll' || w AS model, w AS trial, h AS horizon,
  CASE h WHEN 1 THEN y1 WHEN 2 THEN y2 ELSE y3 END AS y, CASE w WHEN 1 THEN r1 WHEN 3 THEN r3 WHEN 6 THEN r6 ELSE r12 END AS p FROM
  (SELECT station_id, ts, {_SPLIT} AS split, {', '.join(f'lead(pm25, {h}) OVER w AS y{h}' for h in (1, 2, 3))},
   {', '.join(f'avg(pm25) OVER ({W} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS r{w}' for w in _WIDTHS)}
   FROM {_ORDERED} WINDOW w AS ({W}))
  CROSS JOIN (SELECT unnest([1, 3, 6, 12]) AS w) CROSS JOIN (SELECT unnest([1, 2, 3]) AS h))"""
_METRICS = f"""(SELECT model, trial, horizon, split, 1 - sum((y-p)*(y-p)) / (var_pop(y) * count(y)) AS r2, avg(abs(y-p)) AS mae,
  avg((y-p)*(y-p)) AS mse, sqrt(avg((y-p)*(y-p))) AS rmse FROM {_STORED} WHERE y IS NOT NULL GROUP BY 1, 2, 3, 4)"""
_MD = "r2|mae|mse|rmse"


def stored_metrics(spark, d):
    return aggregates.regression_metrics(stored_predictions(spark, d), ["model", "trial", "horizon", "split"])


@query("a7_regression_metrics", f"SELECT model, horizon, split, r2, mae, mse, rmse FROM {_METRICS}", _MD)
def a7_regression_metrics(spark, d):
    return stored_metrics(spark, d).drop("trial")


@query("a8_historical_average", f"SELECT avg(pm25) AS train_mean FROM {_ORDERED} WHERE {_SPLIT} = 'train'", "train_mean")
def a8_historical_average(spark, d):
    s = ranking.chronological_split(src.daily(spark, d), "ts", "station_id")
    return s.filter("split = 'train'").agg(F.avg(F.nanvl("pm25", F.lit(None))).alias("train_mean"))


@query("a13_best_setting", f"""SELECT horizon, model, trial, val_r2 FROM (SELECT horizon, model, trial, r2 AS val_r2,
  row_number() OVER (PARTITION BY horizon ORDER BY r2 DESC, trial) AS rn FROM {_METRICS} WHERE split = 'val') WHERE rn = 1""", "val_r2")
def a13_best_setting(spark, d):
    m = stored_metrics(spark, d).filter("split = 'val'")
    return aggregates.best_trial(m.select("horizon", "model", "trial", F.col("r2").alias("val_r2")), ["horizon"])


@query("o3_leaderboard", f"SELECT horizon, model, r2, mae FROM {_METRICS} WHERE split = 'test' ORDER BY horizon, r2 DESC", "r2|mae")
def o3_leaderboard(spark, d):
    return aggregates.leaderboard(stored_metrics(spark, d).filter("split = 'test'").select("horizon", "model", "r2", "mae"))


@query("o5_merge_metrics", f"""SELECT horizon, model, r2 FROM {_METRICS} WHERE split = 'val' AND trial < 6
UNION ALL SELECT horizon, model, r2 FROM {_METRICS} WHERE split = 'test' AND trial >= 6""", "r2")
def o5_merge_metrics(spark, d):
    """Validation metrics of all models, overwritten by the test metrics of some."""
    m = materialize(stored_metrics(spark, d))
    pick = lambda s: m.filter(F.col("split") == s).select("horizon", "model", "r2", "trial")
    return aggregates.merge_metrics(pick("val").drop("trial"), pick("test").filter("trial >= 6").drop("trial"))


@query("f9_composite_selection", f"""SELECT station_id, ts, horizon, model, p AS forecast FROM {_STORED}
WHERE (horizon = 1 AND trial = 1) OR (horizon = 2 AND trial = 6) OR (horizon = 3 AND trial = 12)""", "forecast")
def f9_composite_selection(spark, d):
    from ..plans import models
    active = {1: "roll1", 2: "roll6", 3: "roll12"}
    out = models.select_active(stored_predictions(spark, d), models.registry_table(spark, active))
    return out.select("station_id", "ts", "horizon", "model", F.col("p").alias("forecast"))


# The same operators on the raw readings, where a series has as many rows in a day as the daily ones in years.

_R = "PARTITION BY station_id ORDER BY ts, event_id"


@query("w1_lags_raw", f"""SELECT event_id, lag(value, 1) OVER ({_R}) AS value_lag1, lag(value, 6) OVER ({_R}) AS value_lag6,
  avg(value) OVER ({_R} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS value_roll3_mean FROM readings""", "value_lag1|value_lag6|value_roll3_mean")
def w1_lags_raw(spark, d):
    r = series.with_position(src.readings(spark, d), K, "ts", ["event_id"], block_rows=256)
    out = series.features(r, K, "ts", lags={"value": [1, 6]}, rolls={"value": [3]}, block_rows=256)
    return out.select("event_id", "value_lag1", "value_lag6", "value_roll3_mean")


@query("w3_fill_raw", f"""SELECT event_id, coalesce(v, last_value(v IGNORE NULLS) OVER ({_R} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(v IGNORE NULLS) OVER ({_R} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value
FROM (SELECT *, CASE WHEN qa >= 70 THEN value END AS v FROM readings)""", "value")
def w3_fill_raw(spark, d):
    r = src.readings(spark, d).withColumn("value", F.when(F.col("qa") >= 70, F.col("value")))
    return series.fill(r, K, "ts", ["value"], backward=True, block_rows=256).select("event_id", "value")


@query("w9_chronological_split_raw", """SELECT event_id, CASE WHEN rn <= floor(n * 0.70e0) THEN 'train' WHEN rn <= floor(n * 0.85e0) THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY ts, md5(CAST(event_id AS VARCHAR)), event_id) AS rn, count(*) OVER () AS n FROM events)""")
def w9_chronological_split_raw(spark, d):
    return ranking.chronological_split(src.events(spark, d), "ts", "event_id").select("event_id", "split")
