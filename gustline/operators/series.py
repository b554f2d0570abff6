"""Time-series operators that never hold a whole series in one task.

A window partitioned by station alone sorts every row of that station in one task, so one busy
station sets the run time. Here a series is cut into blocks of bounded size and the little that
crosses a block border is handed over separately:

* ``with_blocks`` cuts a series by counted rows, not by time, so a busy day is as many blocks as its rows need.
* ``with_position`` numbers the rows of each series: the rows before a block plus the rank inside it.
* ``blocked`` gives every block the rows it needs from its neighbours, so a frame of bounded width
  (lags, rolling statistics, histories, leads) is exact inside the block.
* ``with_known`` carries the last known and next known value over block borders, so fills and
  interpolation, whose reach is unbounded, need one row per block from the rest of the series.

All operators of one chain share one block layout: the rows move twice, however many features. The
row-based operators take over a ``pos`` column that is already there, so a chain numbers its rows once;
store the numbered frame (``session.materialize``) if several operators follow.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalar
from ..session import materialize

BLOCK_ROWS = 4096
HOUR, SECOND = 3_600_000_000, 1_000_000


def with_blocks(df: DataFrame, keys: Sequence[str], ts: str, rows: int = BLOCK_ROWS, name: str = "_blk") -> DataFrame:
    """Rows with the number of their block and ``<name>_from``, the number of rows of the series before that block.

    A block is a run of whole hours, or of whole seconds where an hour alone holds more than ``rows``, that begins in the same ``rows``
    rows of its series; it follows the rows, whatever their rate. Only rows of one second are never parted. The counts that
    place the cuts are one row per series and hour. Rows without a time drop out.
    """
    keys, cell = list(keys), f"{name}_cell"
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    df = df.withColumn(cell, at - F.pmod(at, F.lit(HOUR)))
    full = df.groupBy(*keys, cell).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows).select(*keys, cell, F.lit(True).alias("_full"))
    df = df.join(full, [*keys, cell], "left").withColumn(cell, F.when(F.col("_full"), at - F.pmod(at, F.lit(SECOND))).otherwise(F.col(cell))).drop("_full")
    before = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    cells = df.groupBy(*keys, cell).agg(F.count(F.lit(1)).alias("_n")).select(*keys, cell, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    cells = cells.withColumn(name, F.floor(F.col("_off") / rows))
    cells = cells.withColumn(f"{name}_from", F.min("_off").over(Window.partitionBy(*keys, name))).drop("_off")
    # As many cells as rows where hours are single rows; a stored table's size tells little of its rows, so no broadcast by it.
    return df.join(cells.hint("merge"), [*keys, cell]).drop(cell)


def with_position(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str] = (), block_rows: int = BLOCK_ROWS, name: str = "pos") -> DataFrame:
    """0-based rank of each row in its series, ordered by ``ts`` then ``tie`` (together unique)."""
    out = with_blocks(df, keys, ts, block_rows, "_pos_blk")
    inside = Window.partitionBy(*keys, "_pos_blk").orderBy(ts, *tie)
    return out.withColumn(name, F.col("_pos_blk_from") + F.row_number().over(inside) - 1).drop("_pos_blk", "_pos_blk_from")


def positioned(df: DataFrame, keys: Sequence[str], ts: str) -> tuple[DataFrame, list[str]]:
    """``df`` with ``pos``, and what to drop afterwards: nothing if it came with it."""
    return (df, []) if "pos" in df.columns else (with_position(df, keys, ts), ["pos"])


def blocked(df: DataFrame, keys: Sequence[str], back: int = 0, ahead: int = 0,
            pos: str = "pos", rows: int = BLOCK_ROWS) -> tuple[DataFrame, Window]:
    """Rows with their block, plus copies of the ``back`` rows before and ``ahead`` rows after it.

    Returns the frame and the window of a block; finish with ``core``.
    """
    rows = max(rows, back, ahead)
    home, offset = F.floor(F.col(pos) / rows), F.col(pos) % rows
    homes = F.filter(F.array(
        home,
        F.when(offset >= rows - back, home + 1) if back else F.lit(None),
        F.when(offset < ahead, home - 1) if ahead else F.lit(None),
    ), lambda b: b.isNotNull())
    out = df.withColumn("_block", F.explode(homes)).withColumn("_core", F.col("_block") == home)
    return out, Window.partitionBy(*keys, "_block").orderBy(pos)


def core(df: DataFrame) -> DataFrame:
    """Drop the helper rows and columns of ``blocked``."""
    return df.filter("_core").drop("_block", "_core")


def lag_columns(w, cols: Iterable[str], lags: Iterable[int]) -> dict[str, Column]:
    return {f"{c}_lag{k}": F.lag(c, k).over(w) for c in cols for k in lags}


def rolling_columns(w, cols: Iterable[str], width: int,
                    stats: Iterable[str] = ("mean", "std", "min", "max")) -> dict[str, Column]:
    """Statistics over the last ``width`` rows, the current one included; fewer at the start."""
    fn = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    frame = w.rowsBetween(-(width - 1), 0)
    return {f"{c}_roll{width}_{s}": fn[s](c).over(frame) for c in cols for s in stats}


def features(df: DataFrame, keys: Sequence[str], ts: str, lags: Mapping[str, Iterable[int]] = {},
             rolls: Mapping[str, Iterable[int]] = {}, stats: Iterable[str] = ("mean",),
             leads: Mapping[str, Iterable[int]] = {}, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Lags, rolling statistics and leads of one frame in one block layout."""
    back = max([k for ks in lags.values() for k in ks] + [r - 1 for rs in rolls.values() for r in rs] + [0])
    ahead = max([k for ks in leads.values() for k in ks] + [0])
    df, extra = positioned(df, keys, ts)
    b, w = blocked(df, keys, back, ahead, rows=block_rows)
    new: dict[str, Column] = {}
    for c, ks in lags.items():
        new.update(lag_columns(w, [c], ks))
    for c, rs in rolls.items():
        for r in rs:
            new.update(rolling_columns(w, [c], r, stats))
    for c, ks in leads.items():
        new.update({f"{c}_lead{k}": F.lead(c, k).over(w) for k in ks})
    return core(b.withColumns(new)).drop(*extra)


def with_known(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str], block: Column,
               back: bool = True, ahead: bool = False, include_current: bool = True) -> DataFrame:
    """Append ``<c>__prev`` and/or ``<c>__next``: struct(v, at) of the nearest known value.

    ``order`` must be unique per series, ``block`` a non-decreasing function of it. What the blocks
    before and after know is one row per block.
    """
    keys, blk = list(keys), [*keys, "_blk"]
    df = df.withColumn("_blk", block)
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col(order).alias("at"))) for c in cols}
    seen = F.col(order)
    edge = []
    for c in cols:
        if back:
            edge.append(F.max_by(known[c], F.when(F.col(c).isNotNull(), seen)).alias(f"{c}__last"))
        if ahead:
            edge.append(F.min_by(known[c], F.when(F.col(c).isNotNull(), seen)).alias(f"{c}__first"))
    over = Window.partitionBy(*keys).orderBy("_blk")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    later = over.rowsBetween(1, Window.unboundedFollowing)
    carry = df.groupBy(*blk).agg(*edge).select(
        *blk,
        *[F.last(f"{c}__last", True).over(earlier).alias(f"{c}__before") for c in cols if back],
        *[F.first(f"{c}__first", True).over(later).alias(f"{c}__after") for c in cols if ahead],
    )
    w = Window.partitionBy(*blk).orderBy(order)
    to_here = w.rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    from_here = w.rowsBetween(0 if include_current else 1, Window.unboundedFollowing)
    new = {}
    for c in cols:
        if back:
            new[f"{c}__prev"] = F.last(known[c], True).over(to_here)
        if ahead:
            new[f"{c}__next"] = F.first(known[c], True).over(from_here)
    out = df.withColumns(new).join(carry.hint("merge"), blk)
    merged = {}
    for c in cols:
        if back:
            merged[f"{c}__prev"] = F.coalesce(F.col(f"{c}__prev"), F.col(f"{c}__before"))
        if ahead:
            merged[f"{c}__next"] = F.coalesce(F.col(f"{c}__next"), F.col(f"{c}__after"))
    return out.withColumns(merged).drop(
        "_blk", *[f"{c}__before" for c in cols], *[f"{c}__after" for c in cols])


def _drop_known(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*[f"{c}__prev" for c in cols], *[f"{c}__next" for c in cols])


def fill(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], forward: bool = True,
         backward: bool = False, default=None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Forward fill, then backward fill, then a constant; each step optional.

    ``backward`` reads later values; leave it off for features a model must not see ahead.
    """
    df = with_blocks(df, keys, ts, block_rows, "_cut")
    out = with_known(df, keys, ts, cols, F.col("_cut"), back=forward, ahead=backward).drop("_cut", "_cut_from")
    chain = lambda c: [F.col(c)] + [F.col(f"{c}__prev.v")] * forward + [F.col(f"{c}__next.v")] * backward + (
        [] if default is None else [F.lit(default)])
    return _drop_known(out.withColumns({c: F.coalesce(*chain(c)) for c in cols}), cols)


def _between(c: str, here: Column) -> Column:
    before, after = F.col(f"{c}__prev"), F.col(f"{c}__next")
    share = F.try_divide((here - before["at"]).cast("double"), (after["at"] - before["at"]).cast("double"))
    return before["v"] + (after["v"] - before["v"]) * share


def interpolate_by_row(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str],
                       block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Linear between the known neighbours by row index, then forward fill.

    Reads the next known value, so it is not causal; ``fill`` is the causal choice. A row before the
    first known value stays null.
    """
    df, extra = positioned(df, keys, ts)
    out = with_known(df, keys, "pos", cols, F.floor(F.col("pos") / block_rows), ahead=True)
    here = F.col("pos")
    return _drop_known(out.withColumns({
        c: F.coalesce(F.col(c), _between(c, here), F.col(f"{c}__prev.v")) for c in cols}), cols).drop(*extra)


def interpolate_by_time(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str],
                        block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Linear in time between the known neighbours, then forward fill, then backward fill."""
    out = with_blocks(df, keys, ts, block_rows, "_cut").withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")))
    out = with_known(out, keys, "_at", cols, F.col("_cut"), ahead=True).drop("_cut", "_cut_from")
    return _drop_known(out.withColumns({
        c: F.coalesce(F.col(c), _between(c, F.col("_at")), F.col(f"{c}__prev.v"), F.col(f"{c}__next.v"))
        for c in cols}), cols).drop("_at")


def last_known_before(df: DataFrame, keys: Sequence[str], ts: str, col: str, value: str = "last_value",
                      gap: str | None = "gap_hours", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Newest non-null value strictly before each row and the hours since."""
    df = with_blocks(df, keys, ts, block_rows, "_cut")
    out = with_known(df, keys, ts, [col], F.col("_cut"), include_current=False).drop("_cut", "_cut_from")
    new = {value: F.col(f"{col}__prev.v")}
    if gap:
        micros = lambda c: F.unix_micros(c.cast("timestamp"))
        new[gap] = (micros(F.col(ts)) - micros(F.col(f"{col}__prev.at"))) / 3.6e9
    return _drop_known(out.withColumns(new), [col])


def hourly_spine(df: DataFrame, keys: Sequence[str], ts: str, until: Column | None = None) -> DataFrame:
    """Every hour from the first to the last of each series, joined back; gap hours hold nulls.

    ``df`` has at most one row per series and hour.
    """
    end = F.col("_end") if until is None else F.greatest(F.col("_end"), until)
    span = df.groupBy(*keys).agg(F.min(ts).alias("_start"), F.max(ts).alias("_end"))
    hours = span.select(*keys, F.explode(F.sequence("_start", end, F.expr("interval 1 hour"))).alias(ts))
    return hours.join(df, [*keys, ts], "left")


def history(df: DataFrame, keys: Sequence[str], ts: str, item: Column, length: int = 24,
            include_current: bool = True, name: str = "history", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The last ``length`` items of the series as an array, oldest first."""
    df, extra = positioned(df, keys, ts)
    b, w = blocked(df.withColumn("_item", item), keys, length, rows=block_rows)
    frame = w.rowsBetween(-(length - 1), 0) if include_current else w.rowsBetween(-length, -1)
    return core(b.withColumn(name, F.collect_list("_item").over(frame))).drop("_item", *extra)


def shifted_target(df: DataFrame, keys: Sequence[str], ts: str, col: str, horizon: int,
                   name: str = "target_shifted", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The value ``horizon`` rows ahead; rows without one are dropped."""
    df, extra = positioned(df, keys, ts)
    b, w = blocked(df, keys, ahead=horizon, rows=block_rows)
    out = core(b.withColumn(name, F.lead(col, horizon).over(w))).drop(*extra)
    return out.filter(F.col(name).isNotNull())


def time_features(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumns(scalar.cyclic(F.col(ts)))


def generated_hours(df: DataFrame, order: Sequence[str], start: str = "2026-01-01", name: str = "timestamp") -> DataFrame:
    """Hourly timestamps from ``start`` along ``order``, for a frame that carries none.

    Rows are dealt by ranges of the order columns and stored, so every range keeps its rows; a row's number is its
    rank in its range plus the rows of the ranges before it. ``order`` should be unique.
    """
    ranges = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    # One row per range: the only window without a partition.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (
        ranges.withColumn("_rank", rank).join(offsets, "_range")
        .withColumn(name, F.timestamp_add("HOUR", F.col("_off") + F.col("_rank") - 1, F.lit(start).cast("timestamp")))
        .drop("_range", "_rank", "_off")
    )
