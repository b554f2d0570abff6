"""Column selection, coercion, normalization of the raw sources, deduplication."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas
from ..functions import geo, scalar

# Column order of a cleaned historical table.
KEEP_COLUMNS = (
    "Temp Definition °C", "Dew Point Definition °C", "Rel Hum Definition %",
    "Precip. Amount Definition mm", "Wind Dir Definition 10's deg", "Wind Spd Definition km/h",
    "Visibility Definition km", "Stn Press Definition kPa", "Hmdx Definition",
    "Wind Chill Definition", "Weather Definition", "timestamp", "no", "no2", "nox", "o3", "pm2",
    "city_name", "co", "so2",
)
# Numeric columns of the hourly table; the rest of KEEP_COLUMNS is text.
HOURLY_NUMERIC = tuple(c for c in KEEP_COLUMNS if c not in ("Weather Definition", "timestamp", "city_name"))
HEADER_ALIASES = {c.lower(): c for c in KEEP_COLUMNS if "Definition" in c} | {"pm25": "pm2"}
# Canonical weather field -> raw field of the weather source.
WEATHER_FIELDS = {
    "temperature": "air_temp", "humidity": "rel_hum", "wind_speed": "wind_speed",
    "wind_dir": "wind_dir", "pressure": "pressure", "dew_point": "dew_point",
}
# Model feature name -> canonical field.
MODEL_FIELDS = {
    "temp definition °c": "temperature", "dew point definition °c": "dew_point",
    "rel hum definition %": "humidity",
}
STATION_PREFIX = {"openaq": "openaq-", "envcanada": "swob-"}


def named(c: str) -> Column:
    """A column by its exact name; headers hold dots, quotes and spaces."""
    return F.col("`" + c.replace("`", "``") + "`")


def keep_columns(df: DataFrame, keep: Iterable[str] = KEEP_COLUMNS) -> DataFrame:
    """The listed columns in order, missing ones as null, names trimmed."""
    return df.select(*[(named(c) if c in df.columns else F.lit(None).cast("string")).alias(c.strip()) for c in keep])


def alias_headers(df: DataFrame, aliases: Mapping[str, str] = HEADER_ALIASES) -> DataFrame:
    found = {c: aliases[c.strip().lower()] for c in df.columns if c.strip().lower() in aliases}
    return df.withColumnsRenamed(found)


def lower_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def coerce(df: DataFrame, cols: Iterable[str], zero: bool = False) -> DataFrame:
    """Numbers where the text is one; else null, or 0."""
    fn = scalar.number_or_zero if zero else scalar.number
    return df.withColumns({c: fn(named(c)) for c in cols if c in df.columns})


def select_features(requested: Sequence[str] | None, available: Sequence[str], default: Sequence[str]) -> list[str]:
    return [c for c in (requested or default) if c in available]


def hourly_table(df: DataFrame) -> DataFrame:
    """Typed hourly table: timestamps floored to the hour, numbers coerced, nothing dropped."""
    if "timestamp" not in df.columns:
        raise ValueError("timestamp column is required")
    return coerce(df.withColumn("timestamp", scalar.utc_hour(F.col("timestamp"))), HOURLY_NUMERIC)


def finite_only(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    for c in cols:
        df = df.filter(scalar.is_finite(F.col(c)))
    return df


def recent(df: DataFrame, ts: str, now: Column, hours: int = 2) -> DataFrame:
    return df.filter(F.col(ts).between(now - F.make_dt_interval(hours=F.lit(hours)), now))


def in_box(df: DataFrame, west: float, south: float, east: float, north: float,
           lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.filter(F.col(lon).between(west, east) & F.col(lat).between(south, north))


def time_slice(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Half-open slice; the bounds reach the scan as pushed filters."""
    kind = df.schema[ts].dataType.simpleString()
    return df.filter((F.col(ts) >= F.lit(start).cast(kind)) & (F.col(ts) < F.lit(end).cast(kind)))


def reject_reason(source: Column) -> Column:
    """Why a raw record cannot be normalized; null if it can."""
    where = lambda f: F.concat(F.lit("["), source, F.lit(f"] raw record missing required field: '{f}'"))
    return (
        F.when(F.col("station_id").isNull(), where("station_id"))
        .when(F.col("datetime_utc").try_cast("timestamp").isNull(), where("datetime_utc"))
        .when(~source.isin(*schemas.RAW_SCHEMAS) | source.isNull(),
              F.concat(F.lit("unknown source: "), F.coalesce(source, F.lit("None"))))
    )


def normalize(raw: DataFrame, source: str, ingested_at: Column | None = None) -> DataFrame:
    """Raw records of one source to the canonical hourly row, ``error`` set where that is impossible.

    A parameter without a canonical column loses its value, the row stays.
    """
    has = lambda c: F.col(c) if c in raw.columns else F.lit(None)
    values: dict[str, Column] = {"latitude": has("latitude"), "longitude": has("longitude")}
    if source == "openaq":
        values = {c: F.when(F.col("parameter") == c, F.col("value")) for c in schemas.CANONICAL_VALUES} | {
            c: F.coalesce(F.when(F.col("parameter") == c, F.col("value")), has(c)) for c in ("latitude", "longitude")}
    elif source == "envcanada":
        values |= {c: has(f) for c, f in WEATHER_FIELDS.items()}
    elif source == "iqair":
        values |= {"pm25": has("pm25")}
    extra = [c for c in raw.columns if c in ("event_id", "offset")]
    return raw.select(
        *extra, "station_id", F.lit(source).alias("source"),
        scalar.utc_hour(F.col("datetime_utc")).alias("timestamp"),
        (F.current_timestamp() if ingested_at is None else ingested_at).cast("timestamp").alias("ingested_at"),
        *[values.get(c, F.lit(None)).cast("double").alias(c) for c in schemas.CANONICAL_VALUES],
        reject_reason(F.lit(source)).alias("error"),
    )


def normalize_all(raws: Mapping[str, DataFrame], ingested_at: Column | None = None) -> DataFrame:
    """All sources in one frame; valid rows have a null ``error``."""
    frames = [normalize(df, source, ingested_at) for source, df in raws.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def rejects(raw: DataFrame, source: str, topic: str, offset: str = "offset") -> DataFrame:
    """Dead letters: where the record came from, why it failed, and its payload."""
    payload = F.base64(F.to_json(F.struct(*[c for c in raw.columns if c != offset])).cast("binary"))
    return raw.withColumn("error", reject_reason(F.lit(source))).filter("error IS NOT NULL").select(
        F.lit(topic).alias("source_topic"), F.col(offset).cast("long").alias("offset"), "error",
        payload.alias("value_b64"))


def model_features(df: DataFrame, dir_scale: float = 1.0) -> dict[str, Column]:
    """Canonical row to the six base model features; anything missing is 0."""
    f = lambda c: scalar.number_or_zero(F.col(c)) if c in df.columns else F.lit(0.0)
    speed, direction = f("wind_speed"), f("wind_dir")
    return {name: f(c) for name, c in MODEL_FIELDS.items()} | {
        "wind_u": geo.wind_u(speed, direction, dir_scale), "wind_v": geo.wind_v(speed, direction, dir_scale),
        "pm25": f("pm25")}


def with_wind(df: DataFrame, speed: str, direction: str, dir_scale: float = 1.0) -> DataFrame:
    """wind_u and wind_v from speed and direction; kept if already present, 0 if neither exists."""
    if speed in df.columns and direction in df.columns:
        s, d = scalar.number(named(speed)), scalar.number(named(direction))
        return df.withColumns({"wind_u": geo.wind_u(s, d, dir_scale), "wind_v": geo.wind_v(s, d, dir_scale)})
    if "wind_u" in df.columns and "wind_v" in df.columns:
        return df
    return df.withColumns({"wind_u": F.lit(0.0), "wind_v": F.lit(0.0)})


def feature_map(cols: Sequence[str]) -> Column:
    """Features of a row as a map, nulls left out."""
    entries = [e for c in cols for e in (F.lit(c), named(c).cast("double"))]
    return F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())


def collapse_same_hour(df: DataFrame, order: Sequence[str] = ("ingested_at", "event_id"),
                       keys: Sequence[str] = ("station_id", "source", "timestamp")) -> DataFrame:
    """One row per key; per column the last non-null value in ``order``.

    An aggregate, not a window: partial results shrink a busy station-hour before the shuffle.
    """
    seen = F.struct(*order)
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), seen)).alias(c)
    cols = [c for c in df.columns if c not in keys and c not in order]
    out = df.groupBy(*keys).agg(F.max(seen).alias("_seen"), *[last(c) for c in cols])
    return out.select(*keys, "_seen.*", *cols)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first whole row of each key in ``order``; null keys equal each other."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")
