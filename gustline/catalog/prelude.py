"""SQL text of the views the oracle queries start from, and small SQL snippets."""

from __future__ import annotations


def hav(la1, lo1, la2, lo2):
    return (f"(2.0e0*6371000.0e0*asin(sqrt(power(sin(radians({la2}-{la1})/2),2)+cos(radians({la1}))*cos(radians({la2}))"
            f"*power(sin(radians({lo2}-{lo1})/2),2))))")


def north(la1, lo1, la2, lo2):
    return f"(6371000.0e0*radians({la2}-{la1}))"


def east(la1, lo1, la2, lo2):
    return f"(6371000.0e0*radians({lo2}-{lo1})*cos(radians(({la1}+{la2})/2)))"


def edge_weight(dist, a):
    return f"(CASE WHEN {a} > 0 THEN (1.0e0/({dist}+1e-5))*(1+{a}) ELSE (1.0e0/({dist}+1e-5))*exp({a}) END)"


def cyclic(ts):
    """hour_sin, hour_cos, dow_sin, dow_cos."""
    h, d = f"(2*pi()*hour({ts})/24)", f"(2*pi()*(isodow({ts})-1)/7)"
    return f"sin({h}) AS hour_sin, cos({h}) AS hour_cos, sin({d}) AS dow_sin, cos({d}) AS dow_cos"


AB = ("a.lat", "a.lon", "b.lat", "b.lon")

PRELUDE = f"""
readings AS (SELECT event_id, concat('st-', CAST(user_id % 8 AS VARCHAR)) AS station_id,
  ts, date_trunc('hour', ts) AS hour,
  CASE event_type WHEN 'view' THEN 'pm25' WHEN 'click' THEN 'temperature'
       WHEN 'purchase' THEN 'humidity' WHEN 'error' THEN 'wind_speed' ELSE 'wind_dir' END AS parameter,
  value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS qa
  FROM events),
stations AS (SELECT DISTINCT concat('st-', CAST(user_id % 8 AS VARCHAR)) AS station_id,
  43.5e0 + 0.05e0 * (user_id % 8) AS lat, -79.8e0 + 0.06e0 * ((user_id % 8) * 5 % 8) AS lon,
  CASE WHEN user_id % 8 = 0 THEN 'target' ELSE 'neighbor' END AS role,
  CASE WHEN user_id % 8 < 4 THEN 'net-0' ELSE 'net-1' END AS network FROM events),
met AS (SELECT concat('met-', CAST(user_id % 3 AS VARCHAR)) AS met_id, date_trunc('hour', ts) AS hour,
  min(43.6e0 + 0.1e0 * (user_id % 3)) AS lat, min(-79.7e0 + 0.13e0 * (user_id % 3)) AS lon,
  avg(CASE WHEN event_type = 'error'    THEN value END) AS wind_speed,
  avg(CASE WHEN event_type = 'signup'   THEN value END) AS wind_dir,
  avg(CASE WHEN event_type = 'click'    THEN value END) AS temperature,
  avg(CASE WHEN event_type = 'purchase' THEN value END) AS humidity,
  avg(CASE WHEN event_type = 'view'     THEN value END) / 10 AS dew_point FROM events GROUP BY 1, 2),
pm AS (SELECT station_id, hour, round(avg(value), 4) AS pm25 FROM readings WHERE parameter = 'pm25' GROUP BY 1, 2),
gases AS (SELECT station_id, hour,
  avg(CASE WHEN parameter = 'temperature' THEN value END) / 100 AS no,
  avg(CASE WHEN parameter = 'humidity' THEN value END) / 100 AS no2,
  avg(CASE WHEN parameter = 'wind_speed' THEN value END) / 100 AS nox,
  avg(CASE WHEN parameter = 'wind_dir' THEN value END) / 100 AS o3 FROM readings GROUP BY 1, 2),
daily AS (SELECT r_name AS station_id, o_orderdate AS ts,
  CAST(sum(CAST(round(o_totalprice / 10) AS BIGINT)) AS DOUBLE) / 1e3 AS pm25
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
sparse AS (SELECT station_id, ts, CASE WHEN CAST(floor(pm25 * 100) AS BIGINT) % 4 <> 0 THEN pm25 END AS pm25 FROM daily),
pairs AS (SELECT a.station_id AS src, b.station_id AS dst, {hav(*AB)} AS dist_m,
  {north(*AB)} AS north, {east(*AB)} AS east
  FROM stations a JOIN stations b ON a.station_id <> b.station_id WHERE {hav(*AB)} > 0),
ranked_met AS (SELECT s.station_id, m.*, row_number() OVER (PARTITION BY s.station_id, m.hour
    ORDER BY {hav('s.lat', 's.lon', 'm.lat', 'm.lon')}, m.met_id) AS rn FROM stations s CROSS JOIN met m),
met_at AS (SELECT station_id, hour, met_id, wind_speed, wind_dir, temperature, humidity, dew_point
  FROM ranked_met WHERE rn = 1),
wind AS (SELECT station_id, hour, coalesce(temperature, 0) AS temperature, coalesce(humidity, 0) AS humidity,
  coalesce(dew_point, 0) AS dew_point,
  coalesce(wind_speed, 0) * cos(radians(coalesce(wind_dir, 0))) AS wind_u,
  coalesce(wind_speed, 0) * sin(radians(coalesce(wind_dir, 0))) AS wind_v FROM met_at),
spine AS (SELECT station_id, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM pm GROUP BY 1),
targets AS (SELECT pm.station_id, pm.hour, pm.pm25, coalesce(w.temperature, 0) AS temperature,
  coalesce(w.humidity, 0) AS humidity, coalesce(w.dew_point, 0) AS dew_point,
  coalesce(w.wind_u, 0) AS wind_u, coalesce(w.wind_v, 0) AS wind_v
  FROM pm LEFT JOIN wind w ON pm.station_id = w.station_id AND pm.hour = w.hour),
slots AS (SELECT s.station_id, s.hour, pm.pm25, coalesce(w.wind_u, 0) AS wind_u, coalesce(w.wind_v, 0) AS wind_v
  FROM spine s LEFT JOIN pm ON s.station_id = pm.station_id AND s.hour = pm.hour
  LEFT JOIN wind w ON s.station_id = w.station_id AND s.hour = w.hour),
influence AS (SELECT t.station_id, t.hour, t.wind_u, t.wind_v, p.pm25 AS v, e.dist_m,
  CASE WHEN sqrt(t.wind_u*t.wind_u + t.wind_v*t.wind_v) > 0 THEN (e.north*t.wind_u + e.east*t.wind_v)
    / (sqrt(e.north*e.north + e.east*e.east) * sqrt(t.wind_u*t.wind_u + t.wind_v*t.wind_v)) ELSE 0 END AS a
  FROM slots t JOIN pairs e ON e.dst = t.station_id JOIN pm p ON p.station_id = e.src AND p.hour = t.hour),
estimate AS (SELECT station_id, hour, sum({edge_weight('dist_m', 'a')} * v) / sum({edge_weight('dist_m', 'a')}) AS est,
  max(sqrt(wind_u*wind_u + wind_v*wind_v) * a) AS transport, avg(a) AS align FROM influence GROUP BY 1, 2),
training AS (SELECT t.*, coalesce(e.est, 0) AS upwind_pm25, coalesce(e.transport, 0) AS transport_potential,
  coalesce(e.align, 0) AS wind_alignment, coalesce(g.no, 0) AS no, coalesce(g.no2, 0) AS no2,
  coalesce(g.nox, 0) AS nox, coalesce(g.o3, 0) AS o3
  FROM targets t LEFT JOIN estimate e ON t.station_id = e.station_id AND t.hour = e.hour
  LEFT JOIN gases g ON t.station_id = g.station_id AND t.hour = g.hour)"""
