"""Geometry, joins, diffusion, graph, recovery and alert queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import alerts, geo
from ..operators import clean, diffusion, joins, series
from ..session import materialize
from ..sources import tables as src
from .prelude import east, edge_weight, hav, north
from .registry import query

ADVICE_SQL = f"""CASE WHEN level = 'critical' THEN '{alerts.ADVICE["critical"]}'
  WHEN level = 'warning' THEN '{alerts.ADVICE["warning"]}'
  WHEN f > c + 10 THEN '{alerts.ADVICE["rising"]}' ELSE '{alerts.ADVICE["normal"]}' END"""
LEVEL_SQL = """CASE WHEN f >= 125.5e0 OR c >= 125.5e0 THEN 'critical'
  WHEN f >= 35.5e0 OR c >= 35.5e0 THEN 'warning' ELSE 'normal' END"""


@query("hourly_diffusion_alerts", f"""
SELECT station_id, hour, pm25, upwind_pm25, transport_potential, wind_alignment, level, level <> 'normal' AS alert,
  {ADVICE_SQL} AS recommendation
FROM (SELECT *, {LEVEL_SQL} AS level FROM (SELECT *, coalesce(nullif(pm25, 0), 0) AS c,
  coalesce(nullif(upwind_pm25, 0), coalesce(nullif(pm25, 0), 0)) AS f FROM training))""",
       "pm25|upwind_pm25|transport_potential|wind_alignment")
def hourly_diffusion_alerts(spark, d):
    """Readings to hourly means, nearest weather, wind-weighted neighbours, alert level."""
    out = diffusion.diffusion_features(src.targets(spark, d), src.pm(spark, d), src.pairs(spark, d))
    return alerts.evaluate(out, current=("pm25",), forecast="upwind_pm25").select(
        "station_id", "hour", "pm25", "upwind_pm25", "transport_potential", "wind_alignment", "level", "alert",
        "recommendation")


_MET_AB = ("s.lat", "s.lon", "m.lat", "m.lon")


@query("m1_haversine", f"""SELECT s.station_id, m.met_id, m.hour, {hav(*_MET_AB)} AS dist_m
FROM stations s JOIN met m ON split_part(s.station_id, '-', 2)::INT % 3 = split_part(m.met_id, '-', 2)::INT""", "dist_m")
def m1_haversine(spark, d):
    return _station_met(spark, d).select("station_id", "met_id", "hour", geo.haversine_m(
        *[F.col(c) for c in ("lat", "lon", "mlat", "mlon")]).alias("dist_m"))


def _station_met(spark, d):
    number = lambda c: F.split_part(c, F.lit("-"), F.lit(2)).cast("int")
    m = src.met(spark, d).withColumnsRenamed({"lat": "mlat", "lon": "mlon"})
    return src.stations(spark, d).join(m, number(F.col("station_id")) % 3 == number(F.col("met_id")))


@query("m2_north_east", f"""SELECT s.station_id, m.met_id, m.hour, {north(*_MET_AB)} AS north, {east(*_MET_AB)} AS east
FROM stations s JOIN met m ON split_part(s.station_id, '-', 2)::INT % 3 = split_part(m.met_id, '-', 2)::INT""", "north|east")
def m2_north_east(spark, d):
    n, e = geo.north_east_m(*[F.col(c) for c in ("lat", "lon", "mlat", "mlon")])
    return _station_met(spark, d).select("station_id", "met_id", "hour", n.alias("north"), e.alias("east"))


@query("m3_wind_components", """SELECT met_id, hour, wind_speed*cos(radians(wind_dir)) AS wind_u,
  wind_speed*sin(radians(wind_dir)) AS wind_v, wind_speed*cos(radians(wind_dir*10)) AS tens_u,
  wind_speed*sin(radians(wind_dir*10)) AS tens_v FROM met""", "wind_u|wind_v|tens_u|tens_v")
def m3_wind_components(spark, d):
    m = src.met(spark, d)
    tens = clean.with_wind(m, "wind_speed", "wind_dir", 10).withColumnsRenamed({"wind_u": "tens_u", "wind_v": "tens_v"})
    return clean.with_wind(tens, "wind_speed", "wind_dir").select("met_id", "hour", "wind_u", "wind_v", "tens_u", "tens_v")


_INFLUENCE = "SELECT i.station_id, i.hour, {} FROM influence i"


@query("m4_alignment", "SELECT station_id, hour, v AS pm25, dist_m, a AS alignment FROM influence",
       "pm25|dist_m|alignment")
def m4_alignment(spark, d):
    near = joins.neighbour_readings(src.pm(spark, d), src.pairs(spark, d))
    wind = src.slots(spark, d).select("station_id", "hour", "wind_u", "wind_v")
    return wind.join(near, ["station_id", "hour"]).select("station_id", "hour", "pm25", "dist_m", geo.alignment(
        *[F.col(c) for c in ("north", "east", "wind_u", "wind_v")]).alias("alignment"))


@query("m5_edge_weight", f"SELECT station_id, hour, v AS pm25, {edge_weight('dist_m', 'a')} * 1e4 AS weight FROM influence",
       "pm25|weight")
def m5_edge_weight(spark, d):
    near = joins.neighbour_readings(src.pm(spark, d), src.pairs(spark, d))
    wind = src.slots(spark, d).select("station_id", "hour", "wind_u", "wind_v")
    a = geo.alignment(*[F.col(c) for c in ("north", "east", "wind_u", "wind_v")])
    return wind.join(near, ["station_id", "hour"]).select(
        "station_id", "hour", "pm25", (geo.edge_weight(F.col("dist_m"), a) * 1e4).alias("weight"))


@query("j1_nearest_met", """SELECT pm.station_id, pm.hour, pm.pm25, m.met_id, m.wind_speed, m.wind_dir, m.temperature,
  m.humidity, m.dew_point FROM pm LEFT JOIN met_at m ON pm.station_id = m.station_id AND pm.hour = m.hour""",
       "pm25|wind_speed|wind_dir|temperature|humidity|dew_point")
def j1_nearest_met(spark, d):
    return joins.nearest_met(src.pm(spark, d), src.stations(spark, d), src.met(spark, d), src.MET_VALUES)


@query("j2_nearest_met_as_of", f"""
SELECT station_id, hour, met_id, age_hours, {', '.join(src.MET_VALUES)} FROM (
  SELECT pm.station_id, pm.hour, m.* EXCLUDE hour, datediff('hour', m.hour, pm.hour) AS age_hours,
    row_number() OVER (PARTITION BY pm.station_id, pm.hour ORDER BY {hav('s.lat', 's.lon', 'm.lat', 'm.lon')}, m.met_id) AS rn
  FROM pm JOIN stations s USING (station_id) CROSS JOIN (SELECT DISTINCT met_id FROM met) k
  ASOF JOIN met m ON m.met_id = k.met_id AND m.hour <= pm.hour) WHERE rn = 1""", "|".join(src.MET_VALUES))
def j2_nearest_met_as_of(spark, d):
    """The latest report of each weather station, however old, and of these the nearest."""
    m = src.met(spark, d).withColumn("at", F.col("hour"))
    p = src.pm(spark, d)
    held = materialize(joins.met_as_of(m, [*src.MET_VALUES, "at"], p.select(F.max("hour")).scalar()))
    out = joins.nearest_met(p, src.stations(spark, d), held, [*src.MET_VALUES, "at"])
    age = F.timestamp_diff("HOUR", F.col("at"), F.col("hour"))
    return out.filter("met_id IS NOT NULL").select("station_id", "hour", "met_id", age.alias("age_hours"), *src.MET_VALUES)


@query("j3_neighbour_readings", """SELECT t.station_id, t.hour, t.pm25, e.src AS neighbor_id, p.pm25 AS neighbor_pm25
FROM pm t JOIN pairs e ON e.dst = t.station_id LEFT JOIN pm p ON p.station_id = e.src AND p.hour = t.hour""",
       "pm25|neighbor_pm25")
def j3_neighbour_readings(spark, d):
    """Anchored on target hours: a neighbour without a reading keeps its row."""
    p = src.pm(spark, d)
    edges = src.pairs(spark, d).select(F.col("dst").alias("station_id"), F.col("src").alias("neighbor_id"))
    other = p.withColumnsRenamed({"station_id": "neighbor_id", "pm25": "neighbor_pm25"})
    return p.join(edges, "station_id").join(other, ["neighbor_id", "hour"], "left").select(
        "station_id", "hour", "pm25", "neighbor_id", "neighbor_pm25")


@query("j4_target_gases", """SELECT pm.station_id, pm.hour, pm.pm25, coalesce(g.no, 0) AS no, coalesce(g.no2, 0) AS no2,
  coalesce(g.nox, 0) AS nox, coalesce(g.o3, 0) AS o3 FROM pm LEFT JOIN gases g
  ON pm.station_id = g.station_id AND pm.hour = g.hour""", "pm25|no|no2|nox|o3")
def j4_target_gases(spark, d):
    return joins.with_defaults(src.pm(spark, d), src.gases(spark, d), ["station_id", "hour"],
                               {"no": 0.0, "no2": 0.0, "nox": 0.0, "o3": 0.0})


@query("j5_fill_from_scrape", """SELECT s.station_id, s.hour, coalesce(s.pm25, g.no) AS pm25
FROM slots s LEFT JOIN gases g ON s.station_id = g.station_id AND s.hour = g.hour""", "pm25")
def j5_fill_from_scrape(spark, d):
    spine = series.hourly_spine(src.pm(spark, d), ["station_id"], "hour")
    return joins.fill_missing_from(spine, src.gases(spark, d), ["station_id", "hour"], "pm25", "no")


@query("j6_station_registry", """SELECT pm.station_id, pm.hour, pm.pm25, s.lat, s.lon, s.role
FROM pm JOIN stations s USING (station_id) WHERE s.role = 'neighbor'""", "pm25|lat|lon")
def j6_station_registry(spark, d):
    s = src.stations(spark, d)
    return joins.known_stations(src.pm(spark, d), s, role="neighbor").join(
        s.select("station_id", "lat", "lon", "role"), "station_id").select(
        "station_id", "hour", "pm25", "lat", "lon", "role")


@query("j7_station_pairs", "SELECT src, dst, dist_m, north, east FROM pairs", "dist_m|north|east")
def j7_station_pairs(spark, d):
    return src.pairs(spark, d)


@query("j8_k_nearest", """SELECT src, dst, dist_m, north, east FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist_m, dst) AS rn
FROM pairs) WHERE rn <= 3""", "dist_m|north|east")
def j8_k_nearest(spark, d):
    return diffusion.knn_edges(src.stations(spark, d), 3)


@query("j9_prediction_with_alert", """
SELECT station_id, p.ts AS prediction_at, p.v AS forecast, a.ts AS alert_at, a.v AS reading FROM
  (SELECT station_id, max(ts) AS ts, max_by(value, (ts, event_id)) AS v FROM readings WHERE parameter = 'pm25' GROUP BY 1) p
  FULL OUTER JOIN (SELECT station_id, max(ts) AS ts, max_by(value, (ts, event_id)) AS v FROM readings WHERE parameter = 'humidity' GROUP BY 1) a USING (station_id)""",
       "forecast|reading")
def j9_prediction_with_alert(spark, d):
    r = src.readings(spark, d).select("station_id", "ts", "event_id", "value", "parameter")
    latest = lambda x, at, v: clean.latest_per_key(x, ["station_id"], ["ts", "event_id"]).select(
        "station_id", F.col("ts").alias(at), F.col("value").alias(v))
    return joins.latest_by_station(latest(r.filter("parameter = 'pm25'"), "prediction_at", "forecast"),
                                   latest(r.filter("parameter = 'humidity'"), "alert_at", "reading"))


@query("a5_wind_diffusion", """SELECT station_id, hour, pm25, upwind_pm25, transport_potential, wind_alignment
FROM training""", "pm25|upwind_pm25|transport_potential|wind_alignment")
def a5_wind_diffusion(spark, d):
    return diffusion.diffusion_features(src.targets(spark, d), src.pm(spark, d), src.pairs(spark, d)).select(
        "station_id", "hour", "pm25", "upwind_pm25", "transport_potential", "wind_alignment")


@query("a6_spatial_estimate", """SELECT s.station_id, s.hour, s.pm25, e.est AS spatial_estimate FROM slots s
LEFT JOIN estimate e ON s.station_id = e.station_id AND s.hour = e.hour""", "pm25|spatial_estimate")
def a6_spatial_estimate(spark, d):
    return diffusion.spatial_estimate(src.slots(spark, d), src.pm(spark, d), src.pairs(spark, d)).select(
        "station_id", "hour", "pm25", "spatial_estimate")


@query("e1_adjacency", """SELECT w.hour, e.src, e.dst, exp(-e.dist_m/1000/10)*(0.5+0.5*greatest(-1, least(1,
  (e.north*w.wind_u+e.east*w.wind_v)/sqrt(e.north*e.north+e.east*e.east)))) AS weight
FROM slots w JOIN pairs e ON e.src = w.station_id""", "weight")
def e1_adjacency(spark, d):
    return diffusion.adjacency(src.pairs(spark, d), src.slots(spark, d))


@query("e2_dynamic_edges", f"""SELECT network, hour, src, dst, 1e4 * {edge_weight('dist_m', 'a')} AS weight FROM
  (SELECT s.network, w.hour, p.src, p.dst, p.dist_m, (p.north*w.wind_u+p.east*w.wind_v)/sqrt(p.north*p.north+p.east*p.east) AS a
   FROM pairs p JOIN stations s ON s.station_id = p.src JOIN stations t ON t.station_id = p.dst AND t.network = s.network
   JOIN (SELECT network, hour, avg(wind_u) AS wind_u, avg(wind_v) AS wind_v FROM targets JOIN stations USING (station_id)
     GROUP BY 1, 2) w ON w.network = s.network)""", "weight")
def e2_dynamic_edges(spark, d):
    """The mean wind over a network's stations holds for all its edges."""
    of = src.stations(spark, d).select("station_id", "network")
    edges = src.pairs(spark, d).join(of.withColumnRenamed("station_id", "src"), "src").join(
        of.withColumnRenamed("station_id", "dst"), ["dst", "network"])
    wind = src.targets(spark, d).join(of, "station_id").groupBy("network", "hour").agg(
        F.avg("wind_u").alias("wind_u"), F.avg("wind_v").alias("wind_v"))
    return diffusion.dynamic_edges(edges, wind).withColumn("weight", F.col("weight") * 1e4)


# the three nearest stations of each, whose edges grow with the stations and not with their square
_NEAR = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY dist_m, src) AS rn FROM pairs) WHERE rn <= 3)"


@query("e1_knn_adjacency", f"""SELECT w.hour, e.src, e.dst, exp(-e.dist_m/1000/10)*(0.5+0.5*greatest(-1, least(1,
  (e.north*w.wind_u+e.east*w.wind_v)/sqrt(e.north*e.north+e.east*e.east)))) AS weight
FROM slots w JOIN {_NEAR} e ON e.src = w.station_id""", "weight")
def e1_knn_adjacency(spark, d):
    return diffusion.adjacency(diffusion.neighbour_edges(src.stations(spark, d), 3), src.slots(spark, d))


@query("e2_knn_dynamic_edges", f"""SELECT w.hour, e.src, e.dst, 1e4 * {edge_weight('dist_m', 'a')} AS weight FROM
  (SELECT hour, avg(wind_u) AS wind_u, avg(wind_v) AS wind_v FROM targets GROUP BY 1) w CROSS JOIN {_NEAR} e
  CROSS JOIN LATERAL (SELECT (e.north*w.wind_u+e.east*w.wind_v)/sqrt(e.north*e.north+e.east*e.east) AS a)""", "weight")
def e2_knn_dynamic_edges(spark, d):
    """One network of all stations, each with its three nearest."""
    edges = diffusion.neighbour_edges(src.stations(spark, d), 3).withColumn("network", F.lit("all"))
    wind = src.targets(spark, d).groupBy(F.lit("all").alias("network"), "hour").agg(F.avg("wind_u").alias("wind_u"), F.avg("wind_v").alias("wind_v"))
    return diffusion.dynamic_edges(edges, wind).drop("network").withColumn("weight", F.col("weight") * 1e4)


@query("e3_knn_edges", """SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist_m, dst) AS rn
FROM pairs) WHERE rn <= 2""")
def e3_knn_edges(spark, d):
    return diffusion.knn_edges(src.stations(spark, d), 2).select("src", "dst")


_HELD = """(SELECT *, last_value(pm25 IGNORE NULLS) OVER w AS last_value,
  epoch(hour - last_value(CASE WHEN pm25 IS NOT NULL THEN hour END IGNORE NULLS) OVER w) / 3600 AS gap_hours FROM slots
  WINDOW w AS (PARTITION BY station_id ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("r1_recover", f"""SELECT h.station_id, h.hour,
  coalesce(pm25, CASE WHEN gap_hours <= 3 AND est IS NOT NULL THEN est ELSE last_value END) AS recovered,
  CASE WHEN pm25 IS NOT NULL THEN 'observed' WHEN gap_hours <= 3 AND est IS NOT NULL THEN 'spatial'
       WHEN last_value IS NOT NULL THEN 'temporal' ELSE 'none' END AS method
FROM {_HELD} h LEFT JOIN estimate e ON h.station_id = e.station_id AND h.hour = e.hour""", "recovered")
def r1_recover(spark, d):
    return diffusion.recover(src.slots(spark, d), src.pm(spark, d), src.pairs(spark, d)).select(
        "station_id", "hour", "recovered", "method")


_HASH = "md5('7|' || station_id || '|' || strftime(hour, '%Y-%m-%d %H:%M:%S'))"
_BLANKED = f"""(SELECT p.*, rate FROM (SELECT *, row_number() OVER (ORDER BY {_HASH}) AS rn, count(*) OVER () AS n FROM pm) p
  CROSS JOIN (SELECT unnest([0.05e0, 0.10e0, 0.20e0]) AS rate) r WHERE rn <= round_even(n * rate, 0))"""


@query("r2_inject_missing", f"SELECT rate, station_id, hour FROM {_BLANKED}", "rate")
def r2_inject_missing(spark, d):
    return diffusion.inject_missing(src.pm(spark, d), [0.05, 0.10, 0.20], 7, ["station_id", "hour"]).select(
        "rate", "station_id", "hour")


@query("r3_degradation", f"""SELECT rate, avg(abs(err)) AS mae, sqrt(avg(err*err)) AS rmse, count(err) AS n FROM
  (SELECT b.rate, coalesce(e.est, l.prev) - b.pm25 AS err FROM {_BLANKED} b
   LEFT JOIN estimate e ON b.station_id = e.station_id AND b.hour = e.hour
   LEFT JOIN (SELECT station_id, hour, lag(pm25) OVER (PARTITION BY station_id ORDER BY hour) AS prev FROM pm) l
     ON b.station_id = l.station_id AND b.hour = l.hour) GROUP BY 1""", "rate|mae|rmse")
def r3_degradation(spark, d):
    return diffusion.evaluate_recovery(src.targets(spark, d), src.pm(spark, d), src.pairs(spark, d),
                                       [0.05, 0.10, 0.20], seed=7)


_EVAL = f"""(SELECT *, {LEVEL_SQL} AS level FROM (SELECT t.station_id, t.hour, t.pm25, t.upwind_pm25,
  coalesce(nullif(t.pm25, 0), 0) AS c, coalesce(nullif(t.upwind_pm25, 0), nullif(t.pm25, 0), 0) AS f FROM training t))"""


def _predictions(spark, d):
    out = diffusion.diffusion_features(src.targets(spark, d), src.pm(spark, d), src.pairs(spark, d))
    return out.select("station_id", F.col("hour").alias("timestamp"), F.col("pm25").alias("current_pm25"),
                      F.col("upwind_pm25").alias("forecast_pm25"))


@query("c1_alert_level", f"SELECT station_id, hour AS timestamp, level, level <> 'normal' AS alert FROM {_EVAL}")
def c1_alert_level(spark, d):
    return alerts.evaluate(_predictions(spark, d)).select("station_id", "timestamp", "level", "alert")


@query("c2_recommendation", f"SELECT station_id, hour AS timestamp, {ADVICE_SQL} AS recommendation FROM {_EVAL}")
def c2_recommendation(spark, d):
    return alerts.evaluate(_predictions(spark, d)).select("station_id", "timestamp", "recommendation")


@query("c3_alert_record", f"""SELECT station_id, hour AS timestamp, level, level <> 'normal' AS alert, pm25 AS current_pm25,
  f AS forecast_pm25, {ADVICE_SQL} AS recommendation FROM {_EVAL}""", "current_pm25|forecast_pm25")
def c3_alert_record(spark, d):
    return alerts.alert_records(_predictions(spark, d))


@query("a11_alert_counts", f"SELECT level, count(*) AS n FROM {_EVAL} GROUP BY 1")
def a11_alert_counts(spark, d):
    return alerts.evaluate(_predictions(spark, d)).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


# A station per user: many stations, with edges to the nearest three only.

_MANY_KM = ("43.0e0 + 0.0131e0 * (user_id % 97) + 0.0011e0 * (user_id // 97)", "-80.0e0 + 0.0173e0 * (user_id * 7 % 101)")
_MANY_M = ("43.5e0 + 0.00001e0 * (user_id % 37) + 0.00000013e0 * user_id", "-79.8e0 + 0.00001e0 * (user_id * 11 % 41) + 0.00000017e0 * user_id")


def _many_stations_sql(at):
    return f"(SELECT DISTINCT concat('u-', CAST(user_id AS VARCHAR)) AS station_id, {at[0]} AS lat, {at[1]} AS lon FROM events)"


def _nearest_sql(at, k):
    """Edges from the k nearest stations (src) to each station (dst)."""
    ab = ("a.lat", "a.lon", "b.lat", "b.lon")
    return f"""(SELECT * FROM (SELECT a.station_id AS src, b.station_id AS dst, {hav(*ab)} AS dist_m, {north(*ab)} AS north, {east(*ab)} AS east,
  row_number() OVER (PARTITION BY b.station_id ORDER BY {hav(*ab)}, a.station_id) AS rn
  FROM {_many_stations_sql(at)} a JOIN {_many_stations_sql(at)} b ON a.station_id <> b.station_id) WHERE rn <= {k})"""


def _many_stations(spark, d, at):
    lat, lon = (F.expr(x.replace("//", "div").replace("e0", "D")) for x in at)
    user = F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("station_id")
    return src.events(spark, d).select(user, lat.alias("lat"), lon.alias("lon")).distinct()


def _many_pm(spark, d):
    user = F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("station_id")
    return src.events(spark, d).filter("event_type = 'view'").groupBy(user, F.date_trunc("hour", "ts").alias("hour")).agg(
        F.round(F.avg("value"), 4).alias("pm25"))


def _windy(df):
    """A wind that turns with hour and day."""
    return df.withColumns({"wind_u": F.hour("hour") - F.lit(11.5), "wind_v": F.lit(15.5) - F.dayofmonth("hour")})


_MANY_PM = """(SELECT concat('u-', CAST(user_id AS VARCHAR)) AS station_id, date_trunc('hour', ts) AS hour, round(avg(value), 4) AS pm25
  FROM events WHERE event_type = 'view' GROUP BY 1, 2)"""
_WINDY = "hour(hour) - 11.5e0 AS wind_u, 15.5e0 - day(hour) AS wind_v"
_MANY_SPINE = f"(SELECT station_id, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM {_MANY_PM} GROUP BY 1)"
_MANY_SLOTS = f"(SELECT s.station_id, s.hour, p.pm25, {_WINDY.replace('(hour)', '(s.hour)')} FROM {_MANY_SPINE} s LEFT JOIN {_MANY_PM} p ON s.station_id = p.station_id AND s.hour = p.hour)"
_MANY_ESTIMATE = f"""(SELECT station_id, hour, sum({edge_weight('dist_m', 'a')} * v) / sum({edge_weight('dist_m', 'a')}) AS est,
  max(sqrt(wind_u*wind_u + wind_v*wind_v) * a) AS transport, avg(a) AS align FROM
  (SELECT t.station_id, t.hour, t.wind_u, t.wind_v, p.pm25 AS v, e.dist_m, (e.north*t.wind_u + e.east*t.wind_v)
     / (sqrt(e.north*e.north + e.east*e.east) * sqrt(t.wind_u*t.wind_u + t.wind_v*t.wind_v)) AS a
   FROM {_MANY_SLOTS} t JOIN {_nearest_sql(_MANY_KM, 3)} e ON e.dst = t.station_id JOIN {_MANY_PM} p ON p.station_id = e.src AND p.hour = t.hour) GROUP BY 1, 2)"""


@query("a5_knn_diffusion", f"""SELECT t.station_id, t.hour, t.pm25, coalesce(est, 0) AS upwind_pm25, coalesce(transport, 0) AS transport_potential,
  coalesce(align, 0) AS wind_alignment FROM {_MANY_PM} t LEFT JOIN {_MANY_ESTIMATE} e ON t.station_id = e.station_id AND t.hour = e.hour""",
       "pm25|upwind_pm25|transport_potential|wind_alignment")
def a5_knn_diffusion(spark, d):
    """Every user a station, three neighbours each."""
    pm = _many_pm(spark, d)
    edges = diffusion.neighbour_edges(_many_stations(spark, d, _MANY_KM), 3)
    return diffusion.diffusion_features(_windy(pm), pm, edges).select("station_id", "hour", "pm25", "upwind_pm25", "transport_potential", "wind_alignment")


@query("r1_knn_recover", f"""SELECT h.station_id, h.hour,
  coalesce(pm25, CASE WHEN gap_hours <= 3 AND est IS NOT NULL THEN est ELSE last_value END) AS recovered,
  CASE WHEN pm25 IS NOT NULL THEN 'observed' WHEN gap_hours <= 3 AND est IS NOT NULL THEN 'spatial'
       WHEN last_value IS NOT NULL THEN 'temporal' ELSE 'none' END AS method
FROM (SELECT *, last_value(pm25 IGNORE NULLS) OVER w AS last_value,
  epoch(hour - last_value(CASE WHEN pm25 IS NOT NULL THEN hour END IGNORE NULLS) OVER w) / 3600 AS gap_hours FROM {_MANY_SLOTS}
  WINDOW w AS (PARTITION BY station_id ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) h
LEFT JOIN {_MANY_ESTIMATE} e ON h.station_id = e.station_id AND h.hour = e.hour""", "recovered")
def r1_knn_recover(spark, d):
    pm = _many_pm(spark, d)
    edges = diffusion.neighbour_edges(_many_stations(spark, d, _MANY_KM), 3)
    return diffusion.recover(_windy(series.hourly_spine(pm, ["station_id"], "hour")), pm, edges).select("station_id", "hour", "recovered", "method")


@query("j8_dense", f"SELECT src, dst, dist_m, north, east FROM {_nearest_sql(_MANY_M, 3)}", "dist_m|north|east")
def j8_dense(spark, d):
    """All stations within a few hundred metres."""
    return diffusion.neighbour_edges(_many_stations(spark, d, _MANY_M), 3)


_MOVING = """(SELECT concat('w-', CAST(user_id % 60 AS VARCHAR)) AS met_id, date_trunc('hour', ts) AS hour,
  min(43.3e0 + 0.0107e0 * (user_id % 60) + 0.0031e0 * day(ts)) AS lat, min(-80.0e0 + 0.0113e0 * (user_id % 60 * 7 % 60) - 0.0017e0 * day(ts)) AS lon,
  avg(value) AS wind_speed FROM events WHERE event_type = 'error' GROUP BY 1, 2)"""


@query("j1_many_met", f"""SELECT pm.station_id, pm.hour, m.met_id, m.wind_speed FROM pm LEFT JOIN
  (SELECT s.station_id, m.*, row_number() OVER (PARTITION BY s.station_id, m.hour ORDER BY {hav('s.lat', 's.lon', 'm.lat', 'm.lon')}, m.met_id) AS rn
   FROM stations s CROSS JOIN {_MOVING} m) m ON pm.station_id = m.station_id AND pm.hour = m.hour AND m.rn = 1""", "wind_speed")
def j1_many_met(spark, d):
    """Sixty weather stations that are somewhere else every day; most are silent at most hours."""
    i, day = F.col("user_id") % 60, F.dayofmonth("ts")
    met = src.events(spark, d).filter("event_type = 'error'").groupBy(
        F.concat(F.lit("w-"), i.cast("string")).alias("met_id"), F.date_trunc("hour", "ts").alias("hour")).agg(
        F.min(F.lit(43.3) + F.lit(0.0107) * i + F.lit(0.0031) * day).alias("lat"),
        F.min(F.lit(-80.0) + F.lit(0.0113) * (i * 7 % 60) - F.lit(0.0017) * day).alias("lon"), F.avg("value").alias("wind_speed"))
    return joins.nearest_met(src.pm(spark, d), src.stations(spark, d), met, ["wind_speed"]).select("station_id", "hour", "met_id", "wind_speed")


_HOLES = """(SELECT *, CASE WHEN f >= 125.5e0 OR c >= 125.5e0 THEN 'critical' WHEN f >= 35.5e0 OR c >= 35.5e0 THEN 'warning' ELSE 'normal' END AS level FROM
  (SELECT event_id, coalesce(nullif(CASE WHEN event_id % 3 <> 0 THEN value END, 0), 0) AS c,
    coalesce(nullif(CASE WHEN event_id % 5 <> 0 THEN qa END, 0), nullif(CASE WHEN event_id % 3 <> 0 THEN value END, 0), 0) AS f FROM readings))"""


@query("c1_alert_level_nan", f"SELECT event_id, level, level <> 'normal' AS alert, c AS current_resolved, f AS forecast_resolved, {ADVICE_SQL} AS recommendation FROM {_HOLES}",
       "current_resolved|forecast_resolved")
def c1_alert_level_nan(spark, d):
    """Every third current value and every fifth forecast is NaN."""
    nan = F.lit(float("nan"))
    r = src.readings(spark, d).select("event_id", F.when(F.col("event_id") % 3 == 0, nan).otherwise(F.col("value")).alias("pm25"),
                                      F.when(F.col("event_id") % 5 == 0, nan).otherwise(F.col("qa").cast("double")).alias("forecast_pm25"))
    return alerts.evaluate(r).select("event_id", "level", "alert", "current_resolved", "forecast_resolved", "recommendation")
