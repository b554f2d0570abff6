"""Exact ranks and quantiles of large groups without a global sort."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def rank_cuts(df: DataFrame, cells: Sequence[Column], order: Sequence[Column],
              ranks: Mapping[str, Column]) -> DataFrame:
    """One row with, per name, the order key (a struct) of the row at that 1-based rank.

    ``ranks`` are expressions of ``n``, the number of rows. ``cells`` are ever finer forms of ``order``, each sorting the same way
    inside the one before. Rows are counted per cell of the first kind, the cell that holds the rank is found by summing the counts, and
    only its rows are counted per cell of the next; rows of the last cell are ranked. Every step sorts no more than the cells
    inside one cell. A rank of 0 gives null.
    """
    names = [f"_c{i}" for i in range(len(cells))]
    keyed = df.select(*[c.alias(n) for c, n in zip(cells, names)], F.struct(*[
        c.alias(f"k{i}") for i, c in enumerate(order)]).alias("_key"))

    def located(counts: DataFrame, within: list[str], cell: str) -> DataFrame:
        """The cells that hold the wanted ranks, and the rank left inside them."""
        upto = Window.partitionBy("_name").orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)
        held = counts.withColumn("_end", F.sum("_rows").over(upto))
        held = held.filter((F.col("_need") <= F.col("_end")) & (F.col("_need") > F.col("_end") - F.col("_rows")))
        return held.select("_name", *within, cell, (F.col("_need") - F.col("_end") + F.col("_rows")).alias("_need"))

    first = keyed.groupBy(names[0]).agg(F.count(F.lit(1)).alias("_rows")).withColumn("n", F.sum("_rows").over(Window.partitionBy()))
    wanted = F.inline(F.array(*[F.struct(F.lit(name).alias("_name"), r.cast("long").alias("_need")) for name, r in ranks.items()]))
    picks = located(first.select("*", wanted), [], names[0])
    for i in range(1, len(names)):
        # at most one row per requested rank, hence the broadcasts
        inside = keyed.join(F.broadcast(picks), names[:i])
        picks = located(inside.groupBy("_name", "_need", *names[: i + 1]).agg(F.count(F.lit(1)).alias("_rows")), names[:i], names[i])
    hit = keyed.join(F.broadcast(picks), names).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_name").orderBy("_key"))
    ).filter(F.col("_rank") == F.col("_need"))
    return hit.agg(*[F.max(F.when(F.col("_name") == name, F.col("_key"))).alias(name) for name in ranks])


def up_to(order: Sequence[Column], cut: Column) -> Column:
    """Whether a row's order key is at or before the cut; false for a null cut."""
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    return F.coalesce(key <= cut, F.lit(False))


def _split_order(ts: str, key: str) -> list[Column]:
    return [F.col(ts), F.md5(F.col(key).cast("string")), F.col(key)]


def split_ends(df: DataFrame, ts: str, key: str, fractions: tuple[float, float] = (0.70, 0.85)) -> DataFrame:
    """One row: the order keys that end the training and the validation part."""
    order = _split_order(ts, key)
    cut = lambda f: F.floor(F.col("n").cast("double") * F.lit(f))
    times = [F.date_trunc(unit, F.col(ts)) for unit in ("hour", "second")]
    return rank_cuts(df, [*times, order[0], F.substring(order[1], 1, 2)], order,
                     {"train": cut(fractions[0]), "val": cut(fractions[1])})


def chronological_split(df: DataFrame, ts: str, key: str, fractions: tuple[float, float] = (0.70, 0.85),
                        name: str = "split", now: bool = False) -> DataFrame:
    """Label the first 70 % of all rows in time ``train``, the next 15 % ``val``, the rest ``test``.

    Rows of the same time are ordered by the hash of ``key``, so a time shared by very many series
    is itself split into small cells. ``now`` finds the two ends at once and labels with constants,
    so later passes over a stored ``df`` do not search again.
    """
    found, order = split_ends(df, ts, key, fractions), _split_order(ts, key)
    if now:
        found = df.sparkSession.createDataFrame(found.collect(), found.schema)  # one row
    return df.withColumn("_ends", found.select(F.struct("train", "val")).scalar()).withColumn(
        name, F.when(up_to(order, F.col("_ends.train")), "train")
        .when(up_to(order, F.col("_ends.val")), "val").otherwise("test")).drop("_ends")


CELLS = 4096


def exact_percentiles(df: DataFrame, by: Sequence[str], cols: Sequence[str], probs: Sequence[float],
                      accuracy: int = 10_000) -> DataFrame:
    """Percentiles with linear interpolation, exact for groups of any size.

    One row per group, ``<c>__q`` holding an array aligned with ``probs``. ``percentile`` keeps every
    distinct value of a group in one task's memory. Here a bounded sketch brackets each percentile, a
    second pass counts the rows below the bracket, the bracket is cut into ``CELLS`` cells whose rows are
    counted, and only the cells that hold the rank are sorted. If a bracket should miss its rank, the
    counts show it and the whole range is taken for that percentile.
    """
    by, slack, col = list(by), 2.0 / accuracy, F.col
    data = df.select(*by, F.array(*[F.col("`" + c + "`").cast("double") for c in cols]).alias("_xs"))

    def per_group(table: DataFrame) -> DataFrame:
        """One row per group: what is known of each column, in column order."""
        known = F.struct("_i", *[c for c in table.columns if c not in (*by, "_i")])
        return table.groupBy(*by).agg(F.array_sort(F.collect_list(known)).alias("_t"))

    def values(table: DataFrame | None = None) -> DataFrame:
        """(group, _i, _x) per column, with the column's entry ``_t`` of ``table``."""
        rows = data
        if table is not None:
            rows = data.join(table, by) if by else data.withColumn("_t", table.scalar())
        kept = [] if table is None else [F.get("_t", col("_i")).alias("_t")]
        rows = rows.select(*by, *([] if table is None else ["_t"]), F.posexplode("_xs").alias("_i", "_x"))
        return rows.select(*by, "_i", "_x", *kept)

    lows, highs = [max(p - slack, 0.0) for p in probs], [min(p + slack, 1.0) for p in probs]
    sketch = values().groupBy(*by, "_i").agg(
        F.count("_x").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"),
        F.percentile_approx("_x", lows, accuracy).alias("lows"), F.percentile_approx("_x", highs, accuracy).alias("highs"))
    lo = lambda j, p: col("_t.lo") if p - slack <= 0 else col("_t.lows")[j]
    hi = lambda j, p: col("_t.hi") if p + slack >= 1 else col("_t.highs")[j]
    counted = values(per_group(sketch)).groupBy(*by, "_i").agg(
        F.first("_t").alias("_t"),
        *[F.count_if(col("_x") < lo(j, p)).alias(f"_below{j}") for j, p in enumerate(probs)],
        *[F.count_if(col("_x") <= hi(j, p)).alias(f"_upto{j}") for j, p in enumerate(probs)])

    def bracket(j: int, p: float) -> Column:
        at = (col("_t.n") - 1) * F.lit(float(p))
        k = F.floor(at)
        holds = (col(f"_below{j}") <= k) & (col(f"_upto{j}") >= F.least(k + 2, col("_t.n")))
        return F.struct(
            F.lit(j).alias("j"), F.when(holds, lo(j, p)).otherwise(col("_t.lo")).alias("lo"),
            F.when(holds, hi(j, p)).otherwise(col("_t.hi")).alias("hi"),
            F.when(holds, col(f"_below{j}")).otherwise(0).alias("below"), k.alias("k"), (at - k).alias("frac"))

    brackets = counted.select(*by, "_i", F.array(*[bracket(j, p) for j, p in enumerate(probs)]).alias("b"))
    inside = values(per_group(brackets)).select(*by, "_i", "_x", F.explode(F.filter(
        col("_t.b"), lambda s: (col("_x") >= s["lo"]) & (col("_x") <= s["hi"]))).alias("_b"))
    slot = [*by, "_i", col("_b.j").alias("_j")]
    tally = inside.groupBy(*slot, "_x").agg(F.count(F.lit(1)).alias("_rows"), F.first("_b").alias("_b"))
    slot = [*by, "_i", "_j"]
    # a bracket is cut into even cells; only the cells that hold the two ranks are sorted
    span, place = col("_b.hi") - col("_b.lo"), col("_x") - col("_b.lo")
    even = (span > 0) & (span < F.lit(float("inf")))
    tally = tally.withColumn("_cell", F.when(even, F.floor(F.try_divide(place, span) * CELLS).cast("int")).otherwise(0))
    upto = Window.partitionBy(*slot).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = tally.groupBy(*slot, "_cell").agg(F.sum("_rows").alias("_rows"), F.first("_b").alias("_b"))
    cells = cells.withColumn("_end", col("_b.below") + F.sum("_rows").over(upto)).withColumn("_before", col("_end") - col("_rows"))
    cells = cells.filter((col("_before") <= col("_b.k") + 1) & (col("_end") > col("_b.k")))
    key = ["_i", "_j", "_cell"]
    near = cells.select(*[col(c).alias(f"_cell_{c}") for c in [*by, *key]], "_before")
    same = [col(c).eqNullSafe(col(f"_cell_{c}")) for c in by] + [col(c) == col(f"_cell_{c}") for c in key]
    running = Window.partitionBy(*by, *key).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = tally.join(near, same).withColumn("_upto", col("_before") + F.sum("_rows").over(running))
    reached = lambda more: F.min(F.when(col("_upto") > col("_b.k") + more, col("_x")))
    found = ranked.groupBy(*by, "_i", "_j").agg(reached(0).alias("_x0"), reached(1).alias("_x1"), F.first("_b.frac").alias("_frac"))
    value = col("_x0") + F.when(col("_frac") > 0, (col("_x1") - col("_x0")) * col("_frac")).otherwise(0.0)
    per_column = found.withColumn("_v", value).groupBy(*by, "_i").agg(F.map_from_entries(F.collect_list(
        F.struct("_j", "_v"))).alias("_m"))  # one entry per probability
    per_column = per_column.select(*by, "_i", F.transform(F.sequence(F.lit(0), F.lit(len(probs) - 1)),
                                                          lambda j: F.try_element_at("_m", j)).alias("_q"))
    table = per_column.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_i", "_q"))).alias("_c"))
    empty = f"array({', '.join(['cast(null as double)'] * len(probs))})"
    return table.select(*by, *[
        F.expr(f"coalesce(_c[{i}], {empty})").alias(f"{c}__q") for i, c in enumerate(cols)])


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """First ``n`` rows of each group; Spark trims each partition to ``n`` before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
