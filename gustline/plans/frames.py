"""Frames for training and serving, composed from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import geo, scalar
from ..operators import aggregates, clean, diffusion, joins, ranking, series
from ..session import materialize
from . import recipes

KEYS = ("station_id",)
SPEED, DIRECTION = "wind spd definition km/h", "wind dir definition 10's deg"
PM_LAGS, PM_ROLLS = scalar.LAGS, scalar.ROLLS
LOOKBACK = 24


def archive_hours(readings: DataFrame, names: Sequence[str]) -> DataFrame:
    """Archive readings (station_id, ts, parameter, value) to a gapless hourly wide table."""
    mean = aggregates.mean_by(readings, ["station_id", "ts", "parameter"])
    wide = aggregates.widen(mean, ["station_id", "ts"], "parameter", "value", names)
    hourly = aggregates.resample_hourly(wide, KEYS, "ts", names)
    return series.interpolate_by_time(hourly, KEYS, "hour", names)


def training_table(pm: DataFrame, stations: DataFrame, met: DataFrame, gases: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per target hour: nearest weather, wind, neighbour features and gases; missing values are 0."""
    weather = ("wind_speed", "wind_dir", "temperature", "humidity", "dew_point")
    out = joins.nearest_met(pm, stations, met, weather).na.fill(0.0, list(weather))
    speed, direction = F.col("wind_speed"), F.col("wind_dir")
    out = out.select(
        "station_id", "hour", F.col("temperature").alias("temp definition °c"),
        F.col("dew_point").alias("dew point definition °c"), F.col("humidity").alias("rel hum definition %"),
        geo.wind_u(speed, direction).alias("wind_u"), geo.wind_v(speed, direction).alias("wind_v"), "pm25")
    out = diffusion.diffusion_features(out, pm, edges)
    out = joins.with_defaults(out, gases, ["station_id", "hour"], {g: 0.0 for g in recipes.GASES})
    return out.withColumnRenamed("hour", "timestamp")


def neighbour_columns(targets: DataFrame, readings: DataFrame, ids: Sequence[str],
                      values: dict[str, str], hour: str = "hour") -> DataFrame:
    """Values of listed stations as columns ``<prefix>_<id>`` of each target hour; missing ones are 0.

    For one network with a fixed list; ``neighbour_readings`` is the long form for many.
    """
    first = [F.first(c).alias(p) for c, p in values.items()]
    wide = readings.filter(F.col("station_id").isin(list(ids))).groupBy(hour).pivot("station_id", list(ids)).agg(*first)
    prefixes = list(values.values())
    if len(prefixes) == 1:
        old = {i: f"{prefixes[0]}_{i}" for i in ids}
    else:
        old = {f"{i}_{p}": f"{p}_{i}" for i in ids for p in prefixes}
    wide = wide.select(hour, *[clean.named(o).alias(n) for o, n in old.items()])
    return targets.join(wide, hour, "left").na.fill(0.0, list(old.values()))


def build_time(df: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """A ``timestamp`` column from what the frame has: itself, date parts, or generated hours.

    Hours are generated along ``order`` (all columns if none is given; a frame has no row order of its own) when
    there is no time or none of the times can be read.
    """
    low = {c.strip().lower(): c for c in df.columns}
    made = None
    if "timestamp" in low:
        made = scalar.utc_hour(clean.named(low["timestamp"]))
    elif {"year", "month", "day"} <= low.keys():
        hour = next((clean.named(low[c]) for c in ("time lst", "time", "hour", "clean_hour") if c in low), None)
        made = scalar.timestamp_from_parts(*[clean.named(low[c]) for c in ("year", "month", "day")], hour)
    if made is not None and not df.filter(made.isNotNull()).isEmpty():
        return df.withColumn("timestamp", made)
    by = list(order) or [c for c in df.columns if not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]
    return series.generated_hours(df, by)


def city_codes(df: DataFrame, city: str = "city_name") -> DataFrame:
    """0-based alphabetical code of each city.

    The distinct cities are dealt by ranges and stored, so even their list is never sorted in one task.
    """
    cities = df.select(city).filter(F.col(city).isNotNull()).distinct()
    cities = materialize(cities.repartitionByRange(city).withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cities.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select(
        "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(city))
    return cities.withColumn("_r", rank).join(offsets, "_p").select(
        city, (F.col("_off") + F.col("_r") - 1).cast("double").alias("city_code"))


def modelling_frame(df: DataFrame, city: str = "city_name") -> DataFrame:
    """Aliased, typed, causally filled frame with wind, calendar features and a city code.

    Fills stay inside a city: a city's first hours do not take the previous city's values.
    """
    out = build_time(clean.alias_headers(df)).filter("timestamp IS NOT NULL")
    codes = city_codes(out, city)
    numeric = [c for c in clean.HOURLY_NUMERIC if c in out.columns]
    out = series.fill(clean.coerce(out, numeric), [city], "timestamp", numeric, default=0.0)
    if "Wind Spd Definition km/h" in out.columns and "Wind Dir Definition 10's deg" in out.columns:
        out = clean.with_wind(out, "Wind Spd Definition km/h", "Wind Dir Definition 10's deg", dir_scale=10)
    out = out.withColumns({"hour": F.hour("timestamp"), "dayofweek": F.weekday("timestamp")})
    out = series.time_features(out, "timestamp")
    return out.join(codes, city, "left")


def rolling_feature_table(df: DataFrame, cols: Sequence[str], window: int = 3, max_lag: int = 6,
                          keys: Sequence[str] = ("city_name",), ts: str = "timestamp") -> DataFrame:
    """Impute, clip to the 1st and 99th percentile, then lags, rolling statistics and calendar.

    Imputation interpolates by row, then fills forward, then takes the series' median. The clip
    bounds come from the raw values.
    """
    df = materialize(series.with_position(df, keys, ts))
    q = ranking.exact_percentiles(df, keys, cols, [0.01, 0.5, 0.99])
    out = series.interpolate_by_row(df, keys, ts, cols).join(q, list(keys), "left")
    clip = lambda c: F.greatest(F.col(f"{c}__q")[0], F.least(
        F.col(f"{c}__q")[2], F.coalesce(F.col(c), F.col(f"{c}__q")[1])))
    out = out.withColumns({c: clip(c) for c in cols}).drop(*[f"{c}__q" for c in cols])
    out = series.features(out, keys, ts, lags={c: range(1, max_lag + 1) for c in cols},
                          rolls={c: [window] for c in cols}, stats=("mean", "std", "min", "max")).drop("pos")
    out = out.withColumns({f"{c}_roll{window}": F.col(f"{c}_roll{window}_mean") for c in cols})
    out = out.withColumns({"hour": F.hour(ts), "dayofweek": F.weekday(ts)})
    return series.time_features(out, ts)


def feature_frame(model: str, horizon: int, df: DataFrame) -> DataFrame:
    """The frame a model family trains on: the plain hourly table for the mean, else the modelling frame."""
    key = recipes.family(model)
    if int(horizon) not in recipes.HORIZONS:
        raise ValueError(f"Unsupported horizon: {horizon}")
    return clean.hourly_table(df) if key == "ha" else modelling_frame(df)


# Columns of the training frame that are numbers.
TRAINING_NUMERIC = (
    "temp definition °c", "dew point definition °c", "rel hum definition %", SPEED, DIRECTION,
    "pm25", "pm2", "upwind_pm25", "transport_potential", "wind_alignment",
)


def prepare_training(df: DataFrame, keys: Sequence[str] = KEYS, backfill: bool = True,
                     target: str = "pm25", order: Sequence[str] = ()) -> DataFrame:
    """Typed and filled training frame with wind, calendar, lags and rolling means of the target.

    With ``backfill`` gaps at the start take the first later value, as do the first lags; without,
    they become 0. ``order`` names the row order of a frame that has no times.
    """
    keys = list(keys)
    out = build_time(clean.lower_headers(df), [c.strip().lower() for c in order]).filter("timestamp IS NOT NULL")
    numeric = [c for c in (*TRAINING_NUMERIC, *recipes.GASES, "wind_u", "wind_v") if c in out.columns]
    out = materialize(series.with_position(clean.coerce(out, numeric), keys, "timestamp"))
    out = series.fill(out, keys, "timestamp", numeric, backward=backfill, default=0.0)
    out = series.time_features(clean.with_wind(out, SPEED, DIRECTION, dir_scale=10), "timestamp")
    if target not in out.columns:
        return out.drop("pos")
    b, w = series.blocked(out, keys, back=max(PM_LAGS))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # A lag reaches before the start only in the first block, whose first row starts the series.
    start, last = F.first(target).over(whole), F.max("pos").over(whole)
    early = lambda k: F.when(last >= k, start).otherwise(0.0) if backfill else F.lit(0.0)
    new = {f"{target}_lag{k}": F.coalesce(F.lag(target, k).over(w), early(k)) for k in PM_LAGS}
    for r in PM_ROLLS:
        new.update(series.rolling_columns(w, [target], r, ("mean",)))
    return series.core(b.withColumns(new)).drop("pos")


def log_skewed(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """log1p of skewed columns, their lags and rolling means; negative values count as 0."""
    skewed = {n for c in scalar.LOG_SKEWED for n in (
        c, *[f"{c}_lag{k}" for k in scalar.LAGS], *[f"{c}_roll{r}_mean" for r in scalar.ROLLS])}
    return df.withColumns({c: scalar.log_clip(clean.named(c)) for c in cols if c in skewed})


def design_matrix(frame: DataFrame, features: Sequence[str], horizon: int, keys: Sequence[str] = KEYS,
                  target: str = "pm25", scale: bool = True) -> DataFrame:
    """Scaled features, label ``y`` and ``split`` for one horizon.

    Label ``horizon`` rows ahead, complete rows only, log of the skewed columns, chronological split,
    robust scaling fitted on the training part.
    """
    keys = list(keys)
    out = series.shifted_target(frame.select(*keys, "timestamp", *dict.fromkeys([*features, target])),
                                keys, "timestamp", target, horizon, "y")
    out = out.na.drop(subset=[f"`{f}`" if "." in f else f for f in features])
    # Splitting and scaling pass over the matrix several times, so it is stored first.
    out = materialize(log_skewed(out, features).select(*keys, "timestamp", "y", *features))
    out = ranking.chronological_split(out, "timestamp", keys[0], now=True)
    return aggregates.robust_scale(out, features, F.col("split") == "train") if scale else out


def sequences(df: DataFrame, features: Sequence[str], target: str, history: int = 24, label_offset: int = 0,
              skip_nulls: bool = True, keys: Sequence[str] = KEYS, ts: str = "timestamp",
              block_rows: int = series.BLOCK_ROWS) -> DataFrame:
    """Windows of the ``history`` rows before each row with the label ``label_offset`` rows after it.

    ``label_offset=h-1`` predicts h steps past the window from an unshifted target; 0 pairs with a
    target that is shifted already. Rows: keys, ts, ``window`` (array of feature arrays), ``label``.
    """
    item = F.array(*[clean.named(c).cast("double") for c in features])
    df, extra = series.positioned(df, keys, ts)
    b, w = series.blocked(df, keys, back=history, ahead=label_offset, rows=block_rows)
    out = series.core(b.withColumn("_item", item).withColumns({
        "window": F.collect_list("_item").over(w.rowsBetween(-history, -1)),
        "label": F.lead(target, label_offset).over(w) if label_offset else F.col(target),
        "_full": F.col("pos") >= history,
        "_within": F.lead(F.lit(True), label_offset).over(w) if label_offset else F.lit(True)}))
    out = out.filter(F.col("_full") & F.col("_within").isNotNull())
    if skip_nulls:
        hole = lambda x: x.isNull() | F.isnan(x)
        out = out.filter(~hole(F.col("label")) & ~F.exists(F.flatten("window"), hole))
    return out.select(*keys, ts, *(["pos"] if not extra else []), "window", "label")


def node_table(targets: DataFrame, nodes: DataFrame, edges: DataFrame, replace: dict[str, str]) -> DataFrame:
    """Rows (target hour, node): the target's features with the node's own values put in their place.

    ``edges`` (src node, dst target); the target is a node of itself. ``replace`` maps a feature to the
    column of ``nodes`` (station_id, timestamp, ...) that holds the node's value; missing ones are 0.
    """
    own = targets.withColumn("node_id", F.col("station_id"))
    others = edges.select(F.col("dst").alias("station_id"), F.col("src").alias("node_id"))
    values = nodes.select(F.col("station_id").alias("node_id"), "timestamp", *[
        F.col(v).alias(f"_{i}") for i, v in enumerate(replace.values())])
    swapped = targets.join(others, "station_id").join(values, ["node_id", "timestamp"], "left").withColumns({
        f: F.coalesce(F.col(f"_{i}"), F.lit(0.0)) for i, f in enumerate(replace)})
    return own.unionByName(swapped.select(*own.columns))


def graph_sequences(nodes: DataFrame, features: Sequence[str], value: str = "pm25", history: int = LOOKBACK,
                    horizon: int = 1) -> DataFrame:
    """Per (target, node) windows that end at each target hour, the wind then, and the node's own
    value ``horizon`` rows later. One sample is the set of rows of a target and hour; long form, so a
    large network is never gathered in one row."""
    keys = ["station_id", "node_id"]
    item = F.array(*[clean.named(c).cast("double") for c in features])
    b, w = series.blocked(series.with_position(nodes, keys, "timestamp"), keys, back=history, ahead=horizon)
    out = series.core(b.withColumn("_item", item).withColumns({
        "window": F.collect_list("_item").over(w.rowsBetween(-(history - 1), 0)),
        "label": F.lead(value, horizon).over(w)}))
    return out.filter((F.size("window") == history) & F.col("label").isNotNull()).select(
        *keys, "timestamp", "wind_u", "wind_v", "window", "label")


def serving_columns(features: Sequence[str], ts: Column, current: str = "features", history: str = "history",
                    include_current: bool = True) -> dict[str, Column]:
    """Model inputs from a feature record (map and array of maps): log form, calendar of the record's
    time, lags and rolling means from the history.

    A lag past the start of the history is the current value, a rolling mean repeats the previous
    one and averages the log values (training takes the log of the average). If the history ends with the record itself (``include_current``), that entry is cut off, so
    lag 1 is the previous record.
    """
    past = F.slice(history, 1, F.greatest(F.size(history) - 1, F.lit(0))) if include_current else F.col(history)
    skewed = set(scalar.LOG_SKEWED)
    shape = lambda name, c: scalar.log_clip(F.coalesce(c, F.lit(0.0))) if name in skewed else c
    now = lambda name: shape(name, F.try_element_at(F.col(current), F.lit(name)))
    # NaN is a missing value, as null is
    zero = lambda c: F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(0.0))

    def back(name: str, k: int) -> Column:
        step = F.try_element_at(past, F.lit(-k))
        return F.when(F.size(past) >= k, F.coalesce(shape(name, F.try_element_at(step, F.lit(name))), now(name)))

    calendar = scalar.cyclic(ts)
    out = {}
    for f in features:
        if "_lag" in f:
            base, k = f.rsplit("_lag", 1)
            made = F.coalesce(back(base, int(k)), now(base))
        elif "_roll" in f and f.endswith("_mean"):
            base, width = f.rsplit("_roll", 1)
            values = [zero(now(base))]
            for k in range(1, int(width.split("_")[0])):
                values.append(zero(F.coalesce(back(base, k), values[-1])))
            made = sum(values[1:], values[0]) / len(values)
        else:
            made = calendar.get(f, F.lit(0.0))
        given = F.map_contains_key(F.col(current), f)
        out[f] = zero(F.when(given, now(f)).otherwise(made))
    return out


def history_matrix(df: DataFrame, features: Sequence[str], ts: str = "timestamp", history: str = "history",
                   lookback: int = LOOKBACK, warmup: int = max(PM_LAGS)) -> DataFrame:
    """Rows (record, step, features): the last ``lookback`` steps of the padded history.

    A short history repeats its oldest entry up to ``lookback + warmup`` steps, so every lag exists.
    """
    need = lookback + warmup
    padded = F.concat(F.array_repeat(F.col(history)[0], F.greatest(need - F.size(history), F.lit(0))),
                      F.slice(history, -F.least(F.size(history), F.lit(need)), F.lit(need)))
    out = df.filter(F.size(history) > 0).withColumn("_h", padded).select(
        "*", F.explode(F.sequence(F.lit(warmup), F.lit(need - 1))).alias("_i"))
    at = lambda name, i: F.coalesce(F.try_element_at(F.get("_h", i), F.lit(name)), F.lit(0.0))
    val = lambda name, i: scalar.log_clip(at(name, i)) if name in scalar.LOG_SKEWED else at(name, i)
    i, calendar = F.col("_i"), scalar.cyclic(F.timestamp_add("HOUR", F.col("_i") - (need - 1), F.col(ts)))
    new = {}
    for f in features:
        if "_lag" in f:
            base, k = f.rsplit("_lag", 1)
            new[f] = val(base, i - int(k))
        elif "_roll" in f and f.endswith("_mean"):
            base, width = f.rsplit("_roll", 1)
            n = int(width.split("_")[0])
            new[f] = sum([val(base, i - j) for j in range(1, n)], val(base, i)) / n
        else:
            new[f] = calendar[f] if f in calendar else val(f, i)
    keep = [c for c in df.columns if c not in (history, "features", *features)]
    return out.select(*keep, (i - warmup).alias("step"), *[c.alias(n) for n, c in new.items()])
