"""Record schemas. Field names and types are fixed values shared with the producers."""

from __future__ import annotations

from pyspark.sql import types as T

_D, _S, _L, _TS = T.DoubleType(), T.StringType(), T.LongType(), T.TimestampType()


def _fields(*pairs) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in pairs])


POLLUTANTS = ("pm25", "pm10", "no", "no2", "nox", "so2", "co", "o3")
WEATHER = ("temperature", "humidity", "wind_speed", "wind_dir", "pressure", "dew_point")
CANONICAL_VALUES = ("latitude", "longitude") + POLLUTANTS + WEATHER

OPENAQ_RAW = _fields(
    ("station_id", _S), ("sensor_id", _L), ("parameter", _S), ("value", _D),
    ("datetime_utc", _S), ("latitude", _D), ("longitude", _D),
)
ENVCANADA_RAW = _fields(
    ("station_id", _S), ("datetime_utc", _S), ("latitude", _D), ("longitude", _D),
    ("air_temp", _D), ("dew_point", _D), ("rel_hum", _D), ("wind_speed", _D),
    ("wind_dir", _D), ("pressure", _D),
)
IQAIR_RAW = _fields(("station_id", _S), ("datetime_utc", _S), ("pm25", _D))
RAW_SCHEMAS = {"openaq": OPENAQ_RAW, "envcanada": ENVCANADA_RAW, "iqair": IQAIR_RAW}

MEASUREMENT = _fields(
    ("station_id", _S), ("source", _S), ("timestamp", _TS), ("ingested_at", _TS),
    *[(c, _D) for c in CANONICAL_VALUES],
)
FEATURE = _fields(
    ("station_id", _S), ("source", _S), ("timestamp", _TS),
    ("features", T.MapType(_S, _D)), ("history", T.ArrayType(T.MapType(_S, _D))),
)
PREDICTION = _fields(
    ("station_id", _S), ("timestamp", _TS), ("forecasts", T.MapType(_S, _D)),
    ("forecast_pm25", _D), ("current_pm25", _D), ("model_type", _S),
)
ALERT = _fields(
    ("station_id", _S), ("timestamp", _TS), ("level", _S), ("alert", T.BooleanType()),
    ("current_pm25", _D), ("forecast_pm25", _D), ("recommendation", _S),
)
REJECT = _fields(("source_topic", _S), ("offset", _L), ("error", _S), ("value_b64", _S))

# Payload schemas of the nested JSON sources.
LOCATIONS_PAYLOAD = T.StructType([T.StructField("results", T.ArrayType(T.StructType([
    T.StructField("id", _L),
    T.StructField("coordinates", _fields(("latitude", _D), ("longitude", _D))),
    T.StructField("sensors", T.ArrayType(T.StructType([
        T.StructField("id", _L), T.StructField("parameter", _fields(("name", _S)))]))),
])))])
LATEST_PAYLOAD = T.StructType([T.StructField("results", T.ArrayType(T.StructType([
    T.StructField("sensorsId", _L), T.StructField("value", _D),
    T.StructField("datetime", _fields(("utc", _S))),
])))])
COLLECTION_PAYLOAD = T.StructType([T.StructField("features", T.ArrayType(T.StructType([
    T.StructField("geometry", T.StructType([T.StructField("coordinates", T.ArrayType(_D))])),
    T.StructField("properties", T.MapType(_S, _S)),
])))])
ARRAYS_PAYLOAD = T.StructType([T.StructField("hourly", T.StructType([
    T.StructField("time", T.ArrayType(_S)),
    T.StructField("temperature_2m", T.ArrayType(_D)),
    T.StructField("relativehumidity_2m", T.ArrayType(_D)),
    T.StructField("dewpoint_2m", T.ArrayType(_D)),
    T.StructField("windspeed_10m", T.ArrayType(_D)),
    T.StructField("winddirection_10m", T.ArrayType(_D)),
]))])
