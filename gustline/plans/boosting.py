"""Second-order gradient boosting of squared errors on binned features, grown by Spark one level at a time.

Features are cut once into at most ``BINS`` bins at values of their distribution, and a row is stored as one byte a feature. A level of a tree is one
job: tasks add up gradients and curvatures per trial, node, feature and bin, and Spark sums them if there is more than one task. Up to
``CELLS_ON_DRIVER`` cells (their number follows from the settings, not from the rows) are compared on the driver; beyond that Spark runs along the
bins of each feature and the driver sees one row a node. Both find the same cuts. Several settings grow side by side in the same jobs: every job adds
a level to each of them, and settings that differ only in their number of trees are one, cut to length. Scores are written back to the shared folder
every ``STORED`` trees; between two writes a task adds the few newest trees itself.

A leaf's value is ``-shrink(G, l1) / (H + l2)``, a cut's gain the sum of ``shrink(G, l1)^2 / (H + l2)`` of its sides less that of the node, with
``shrink`` moving a sum towards 0 by ``l1``. A cut needs ``least`` rows on both sides and a positive gain. The levels are grown in full; a tree of at
most ``leaves`` leaves keeps the cuts that growing the best leaf first would have chosen.

Gradients are rounded to a multiple of a power of two so small that all sums are exact: their order does not matter, and a repeated task or another
partitioning gives the same trees. Of equal gains the first feature and lowest cut wins. Rows with a NaN go to the right of every cut. Rows drawn for
a tree are those whose hash, mixed with the seed and the tree's number, is small enough; equal rows are drawn together. Without rows the model predicts 0.
"""

from __future__ import annotations

import heapq
import math
import random
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import materialize

BINS = 255
STORED = 16
ROWS_A_TASK = 200_000
CELLS_A_TASK = 100_000
CELLS_ON_DRIVER = 1_000_000
ACCURACY = 10_000


@dataclass(frozen=True)
class Setting:
    trees: int
    rate: float
    depth: int
    l1: float = 0.0
    l2: float = 0.0
    rows: float = 1.0
    columns: float = 1.0
    leaves: int = 31
    least: int = 20


@dataclass
class Tree:
    """Nodes in heap order: the children of ``i`` are ``2i + 1`` (bins up to ``cut``) and ``2i + 2``; ``at`` is -1 at leaves."""

    at: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n))

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node that each row has reached after ``levels`` steps."""
        node, every = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            at = self.at[node]
            node = np.where(at >= 0, 2 * node + 1 + (bins[every, at] > self.cut[node]), node)
        return node

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(bins, (len(self.at) + 1).bit_length() - 2)]


def to_bins(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.searchsorted(e, x[:, j], side="left")
    return out


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


@dataclass
class Boosted:
    """A fitted model. Adds column ``p`` to rows with the feature vector ``x``, in a stream too."""

    base: float
    edges: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        bins, out = to_bins(x, self.edges), np.full(len(x), self.base)
        for t in self.trees:
            out += t.predict(bins)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.trees:
            return df.withColumn("p", F.lit(self.base))
        model, width = self, len(self.edges)

        @F.arrow_udf("double")
        def predicted(xs: pa.Array) -> pa.Array:
            return pa.array(model.predict(_matrix(xs, width)))
        return df.withColumn("p", predicted(vector_to_array("x")))

    def to_rows(self) -> list[tuple]:
        """(tree, node, feature, cut, value), the bounds of the bins as tree -1 and the base as tree -2."""
        out = [(-2, 0, None, None, self.base)]
        out += [(-1, i, j, None, float(v)) for j, e in enumerate(self.edges) for i, v in enumerate([*e, math.nan])]
        return out + [(k, i, int(t.at[i]), int(t.cut[i]), float(t.value[i])) for k, t in enumerate(self.trees) for i in range(len(t.at))]

    @classmethod
    def from_rows(cls, rows: Sequence[tuple]) -> Boosted:
        rows = sorted(rows, key=lambda r: (r[0], r[1]))
        edges: dict[int, list[float]] = {}
        trees: dict[int, list[tuple]] = {}
        for k, _, at, cut, value in rows:
            if k == -1:
                edges.setdefault(at, []).append(value)
            elif k >= 0:
                trees.setdefault(k, []).append((at, cut, value))
        return cls(next(r[4] for r in rows if r[0] == -2), [np.array(edges[j][:-1]) for j in sorted(edges)],
                   [Tree(np.array([n[0] for n in t], np.int32), np.array([n[1] for n in t], np.int32), np.array([n[2] for n in t]))
                    for _, t in sorted(trees.items())])


ROWS = T.StructType([T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()), T.StructField("feature", T.IntegerType()),
                     T.StructField("cut", T.IntegerType()), T.StructField("value", T.DoubleType())])


def bounds(train: DataFrame, width: int) -> list[np.ndarray]:
    """Upper bounds of the bins of each feature: values at even ranks of its distribution. Beyond the last are only NaNs."""
    x, ranks = vector_to_array("x"), ", ".join(f"{(i + 1) / BINS!r}D" for i in range(BINS))
    known = train.select(*[F.nanvl(F.get(x, F.lit(j)), F.lit(None)).alias(f"c{j}") for j in range(width)])
    found = known.agg(*[F.expr(f"percentile_approx(c{j}, array({ranks}), {ACCURACY})") for j in range(width)]).first()  # one row
    return [np.unique(np.array(v or [], dtype=float)) for v in found]


def drawn(hashes: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """Which rows a tree sees: their hash, mixed again with the tree's number, falls below the share."""
    if share >= 1:
        return np.ones(len(hashes), bool)
    with np.errstate(over="ignore"):
        z = hashes.view(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(float) < share * 2.0**53


def columns_of(seed: int, tree: int, share: float, width: int) -> list[int]:
    """Which features a tree may cut."""
    return sorted(random.Random(seed * 1_000_003 + tree).sample(range(width), max(1, round(share * width))))


def shrink(g, l1):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


class _Growing:
    """One setting on its way: finished trees, the tree being grown, and the totals of its nodes."""

    def __init__(self, setting: Setting, seed: int, width: int):
        self.setting, self.seed, self.width = setting, seed, width
        self.trees: list[Tree] = []
        self.stored = 0
        self.start()

    def start(self) -> None:
        self.tree, self.level, self.gains = Tree.empty(self.setting.depth), 0, {}
        self.open = [0]
        self.columns = columns_of(self.seed, len(self.trees), self.setting.columns, self.width)

    @property
    def done(self) -> bool:
        return len(self.trees) >= self.setting.trees

    def add_level(self, found: dict[int, tuple]) -> None:
        """Cut the open nodes where a cut was found: node -> (feature, cut, gain, left G, left n, G, n)."""
        s, nxt = self.setting, []
        leaf = lambda g, n: float(-s.rate * shrink(g, s.l1) / (n + s.l2)) if n + s.l2 else 0.0
        for node in self.open:
            if node not in found:
                continue
            at, cut, gain, gl, nl, g, n = found[node]
            if node == 0:
                self.tree.value[0] = leaf(g, n)
            if gain is None:
                continue
            self.tree.at[node], self.tree.cut[node], self.gains[node] = at, cut, gain
            self.tree.value[2 * node + 1], self.tree.value[2 * node + 2] = leaf(gl, nl), leaf(g - gl, n - nl)
            nxt += [child for child, rows in ((2 * node + 1, nl), (2 * node + 2, n - nl)) if rows >= 2 * max(s.least, 1)]
        self.open, self.level = nxt, self.level + 1
        if not nxt or self.level == s.depth:
            self.finish()

    def finish(self) -> None:
        """Keep the cuts that growing the best leaf first would have made, then start the next tree."""
        kept, heap = set(), [(-self.gains[0], 0)] if 0 in self.gains else []
        while heap and len(kept) + 1 < self.setting.leaves:
            node = heapq.heappop(heap)[1]
            kept.add(node)
            for child in (2 * node + 1, 2 * node + 2):
                if child in self.gains:
                    heapq.heappush(heap, (-self.gains[child], child))
        for node in self.gains:
            if node not in kept:
                self.tree.at[node] = -1
        self.trees.append(self.tree)
        self.start()


def _scores(batch: pa.RecordBatch, bins: np.ndarray, pending: Sequence[Sequence[Tree]]) -> np.ndarray:
    """Scores of a batch: what is stored, and the trees since."""
    s = _matrix(batch.column("s"), len(pending)).copy()
    for t, trees in enumerate(pending):
        for tree in trees:
            s[:, t] += tree.predict(bins)
    return s


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0]:at[-1]].reshape(-1, width)


CELL = T.StructType([*[T.StructField(c, T.IntegerType()) for c in ("t", "node", "f", "b")], T.StructField("g", T.DoubleType()), T.StructField("n", T.DoubleType())])


def _sums(pending, growing, scale: float, width: int, seed: int):
    """The task's side of a level: gradient and count of every filled cell of the open nodes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {t: np.zeros((len(cols), 2, len(nodes) * (BINS + 1))) for t, _, _, _, nodes, cols, _ in growing}
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = _bytes(batch.column("b"), width)
            scores, y = _scores(batch, bins, pending), batch.column("y").to_numpy()
            hashes = batch.column("u").to_numpy()
            for t, tree, number, level, nodes, cols, share in growing:
                place = np.full(len(tree.at), -1, np.int64)
                place[nodes] = np.arange(len(nodes))
                at = place[tree.nodes(bins, level)]
                take = np.flatnonzero((at >= 0) & drawn(hashes, seed, number, share))
                g, first = np.rint((scores[take, t] - y[take]) * scale), at[take] * (BINS + 1)
                for i, f in enumerate(cols):
                    cell = first + bins[take, f]
                    held[t][i, 0] += np.bincount(cell, g, held[t].shape[2])
                    held[t][i, 1] += np.bincount(cell, minlength=held[t].shape[2])
        for t, _, _, _, nodes, cols, _ in growing:
            i, cell = np.nonzero(held[t][:, 1])
            if len(i):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(i), t, np.int32)), pa.array(np.array(nodes, np.int32)[cell // (BINS + 1)]), pa.array(np.array(cols, np.int32)[i]),
                    pa.array((cell % (BINS + 1)).astype(np.int32)), pa.array(held[t][i, 0, cell]), pa.array(held[t][i, 1, cell])], ["t", "node", "f", "b", "g", "n"])
    return run


def best_cuts(cells: DataFrame, settings: Sequence[Setting], scale: float, tasks: int) -> DataFrame:
    """The best cut of every trial's node: (t, node, G, n, best (gain, f, b, left G, left n) or null).

    Cells meet by trial, node and feature, are summed per bin and added up along the bins; one row a feature is left for the second shuffle.
    """
    per = lambda name: F.get(F.array(*[F.lit(float(getattr(s, name))) for s in settings]), F.col("t"))
    key = ["t", "node", "f"]
    summed = cells.repartition(tasks, *key).groupBy(*key, "b").agg((F.sum("g") / F.lit(scale)).alias("g"), F.sum("n").alias("n"))
    along = Window.partitionBy(*key).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*key)
    sides = summed.select(*key, "b", F.sum("g").over(along).alias("gl"), F.sum("n").over(along).alias("nl"),
                          F.sum("g").over(whole).alias("G"), F.sum("n").over(whole).alias("N"),
                          per("l1").alias("l1"), per("l2").alias("l2"), per("least").alias("least"))

    def worth(g, n):
        pull = F.greatest(F.abs(g) - F.col("l1"), F.lit(0.0))
        return F.try_divide(pull * pull, n + F.col("l2"))

    gl, nl, g, n = (F.col(c) for c in ("gl", "nl", "G", "N"))
    gain = worth(gl, nl) + worth(g - gl, n - nl) - worth(g, n)
    able = (nl >= F.col("least")) & (n - nl >= F.col("least")) & (n > nl) & (gain > 0)
    best = F.max(F.when(able, F.struct(gain.alias("gain"), (-F.col("f")).alias("f"), (-F.col("b")).alias("b"), gl.alias("gl"), nl.alias("nl"))))
    return sides.groupBy("t", "node").agg(F.max("G").alias("G"), F.max("N").alias("N"), best.alias("best"))


def cuts_of(rows: Sequence[T.Row]) -> dict[int, dict[int, tuple]]:
    """Trial -> node -> (feature, cut, gain or None, left G, left n, G, n)."""
    found: dict[int, dict[int, tuple]] = {}
    for r in rows:
        b = r["best"]
        found.setdefault(r["t"], {})[r["node"]] = (-b["f"], -b["b"], b["gain"], b["gl"], b["nl"], r["G"], r["N"]) if b else (0, 0, None, 0, 0, r["G"], r["N"])
    return found


def cuts_in(cells: pa.Table, live: Sequence[tuple], settings: Sequence[Setting], scale: float) -> dict[int, dict[int, tuple]]:
    """The same from the summed cells themselves, as dense arrays of (node, feature, bin)."""
    col = {c: cells.column(c).to_numpy() for c in cells.column_names}
    found: dict[int, dict[int, tuple]] = {}
    for t, _, _, _, nodes, cols, _ in live:
        s, mine = settings[t], np.flatnonzero(col["t"] == t)
        at = np.searchsorted(nodes, col["node"][mine]), np.searchsorted(cols, col["f"][mine]), col["b"][mine]
        g, n = np.zeros((2, len(nodes), len(cols), BINS + 1))
        np.add.at(g, at, col["g"][mine] / scale)  # a file of several row groups may have been read by several tasks
        np.add.at(n, at, col["n"][mine])
        gl, nl = g.cumsum(axis=2), n.cumsum(axis=2)
        gs, ns = gl[..., -1:], nl[..., -1:]
        worth = lambda g, n: (p := np.maximum(np.abs(g) - s.l1, 0.0)) * p / (n + s.l2)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = worth(gl, nl) + worth(gs - gl, ns - nl) - worth(gs, ns)
            able = (nl >= s.least) & (ns - nl >= s.least) & (nl > 0) & (ns > nl) & (gain > 0)
        gain = np.where(able, gain, -np.inf).reshape(len(nodes), -1)
        for i, (node, k) in enumerate(zip(nodes, gain.argmax(axis=1))):
            total = float(gs[i, 0, 0]), float(ns[i, 0, 0])
            f, b = divmod(int(k), BINS + 1)
            if gain[i, k] > -np.inf:
                found.setdefault(t, {})[node] = (cols[f], b, float(gain[i, k]), float(gl[i, f, b]), float(nl[i, f, b]), *total)
            elif total[1]:
                found.setdefault(t, {})[node] = (0, 0, None, 0, 0, *total)
    return found


def fit_many(train: DataFrame, settings: Sequence[Setting], seed: int = 42) -> list[Boosted]:
    """One model a setting, all grown in the same jobs. ``train`` has the feature vector ``x`` and the label ``y``."""
    first = train.select("x").head()
    if first is None:
        return [Boosted(0.0, []) for _ in settings]
    width = len(first["x"])
    edges = bounds(train, width)
    # settings that differ in the number of trees only: the longest holds the others
    kinds: dict[Setting, int] = {}
    alike = lambda s: Setting(**(asdict(s) | {"trees": 0}))
    for s in settings:
        kinds[alike(s)] = max(kinds.get(alike(s), 0), s.trees)
    order = list(kinds)
    growing = [_Growing(Setting(**(asdict(k) | {"trees": n})), seed, width) for k, n in kinds.items()]
    rows, mean, spread = train.agg(F.count("y"), F.avg("y"), F.stddev_pop("y")).first()
    # the sum of all gradients stays below 2^52 steps, so sums of doubles are exact
    scale = 2.0 ** math.floor(52 - math.log2(max(4.0 * rows * (spread or 1.0), 2.0**-200)))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                b = to_bins(_matrix(batch.column("x"), width), edges)
                s = pa.FixedSizeListArray.from_arrays(pa.array(np.full(len(b) * len(growing), mean)), len(growing)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("y"), pa.array([r.tobytes() for r in b], pa.binary()), s], ["u", "y", "b", "s"])

    x = vector_to_array("x")
    tasks = max(1, -(-rows // ROWS_A_TASK))
    source = train.select(F.xxhash64(x, F.col("y").cast("double")).alias("u"), F.col("y").cast("double").alias("y"), x.alias("x")).filter("y IS NOT NULL")
    schema = "u long, y double, b binary, s array<double>"
    table = materialize(source.mapInArrow(binned, schema).coalesce(tasks))

    while any(not g.done for g in growing):
        if max(len(g.trees) - g.stored for g in growing) >= STORED:
            table = materialize(table.mapInArrow(_rescored([g.trees[g.stored:] for g in growing], width), schema))
            for g in growing:
                g.stored = len(g.trees)
        live = [(t, g.tree, len(g.trees), g.level, g.open, g.columns, g.setting.rows) for t, g in enumerate(growing) if not g.done]
        cells = table.mapInArrow(_sums([g.trees[g.stored:] for g in growing], live, scale, width, seed), CELL)
        most = sum(len(nodes) * len(cols) for _, _, _, _, nodes, cols, _ in live) * (BINS + 1)
        if most > CELLS_ON_DRIVER:
            found = cuts_of(best_cuts(cells, order, scale, -(-most // CELLS_A_TASK)).collect())  # one row an open node
        else:
            summed = cells if tasks == 1 else cells.groupBy("t", "node", "f", "b").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
            found = cuts_in(summed.toArrow(), live, order, scale)
        for t, *_ in live:
            growing[t].add_level(found.get(t, {}))
    return [Boosted(mean, edges, growing[order.index(alike(s))].trees[:s.trees]) for s in settings]


def _rescored(pending, width: int):
    """Scores brought up to date; the rest of the table stays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = _scores(batch, _bytes(batch.column("b"), width), pending)
                s = pa.FixedSizeListArray.from_arrays(pa.array(s.ravel()), len(pending)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("y"), batch.column("b"), s], ["u", "y", "b", "s"])
    return run


def fit(train: DataFrame, trees: int, rate: float, depth: int, seed: int = 42, **more) -> Boosted:
    return fit_many(train, [Setting(trees, rate, depth, **more)], seed)[0]
