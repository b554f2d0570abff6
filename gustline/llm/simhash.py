"""SimHash near-duplicates by vantage-point trees.

A fingerprint has 64 bits; a bit is set when it is set in over half the hashes of a text's shingles. Equal fingerprints become one
point. A vantage-point tree over a bounded sample of points cuts the space into shards: at each node points nearer to the vantage
point than the median distance go left, others right. By the triangle inequality a point within ``radius`` of
another can lie on the other side only if its own distance is within ``radius`` of the median, so a point is also sent, as a visitor, to
the shards that its border overlaps. Each shard finds its pairs exactly with a tree of its own and gives back a spanning forest
of them (never all pairs), and the forests are joined to connected components.

Defined results: null text counts as empty; a text without words has fingerprint zero; fewer words than a shingle count as one
shingle; rows with equal ids are one vertex; rows with a null id get the component of their fingerprint's group and are no vertex; an
empty table gives an empty table; other columns are ignored. Whole texts are read.

Bounds: the sample holds ``SAMPLE_A_SHARD`` points a shard, the tree at most ``MOST_SHARDS`` shards; beyond that shards grow.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import components, fresh, ragged, stored, text_slices

SEED = 42
WORDS = 3
RADIUS = 2
SHARD_POINTS = 20000
SAMPLE_A_SHARD = 16
MOST_SHARDS = 4096
BRUTE = 1 << 21


def word_bounds(data: np.ndarray, offsets: np.ndarray):
    """Lower-cased words with one blank between: bytes, each word's start and end, each text's first word."""
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = ~gap
    begin[1:] &= gap[:-1] | edge[1:-1]
    starts = np.flatnonzero(begin)
    stop = ~gap
    stop[:-1] &= gap[1:] | edge[1:-1]
    ends = np.flatnonzero(stop) + 1
    size = ends - starts + 1
    at = np.cumsum(size) - size
    out = np.full(int(size.sum()), 32, np.uint8)
    out[ragged(at, size - 1)] = low[~gap]
    return out, at, at + size - 1, np.searchsorted(starts, offsets)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle, repeats included, and each text's first one."""
    joined, starts, ends, first = word_bounds(data, offsets)
    n = np.diff(first)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    at = ragged(first[:-1], count)
    last = np.minimum(at + words, np.repeat(first[1:], count)) - 1
    raw, h = joined.tobytes(), xxhash.xxh64_intdigest
    out = np.fromiter((h(raw[s:e], SEED) for s, e in zip(starts[at].tolist(), ends[last].tolist(), strict=True)), np.uint64, len(at))
    return out, np.concatenate(([0], np.cumsum(count)))


def majority(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text the bits set in over half its hashes. Counts are kept eight to a word, 255 hashes at a time."""
    n = np.diff(offsets)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    parts = -(-n[full] // 255)
    seg = np.repeat(offsets[:-1][full], parts) + 255 * ragged(np.zeros(len(full), np.int64), parts)
    counts = np.zeros((len(seg), 8, 8), np.int64)
    for j in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(j)) & np.uint64(0x0101010101010101), seg)
        counts[:, :, j] = lanes.view(np.uint8).reshape(-1, 8)
    total = np.add.reduceat(counts.reshape(-1, 64), np.cumsum(parts) - parts, axis=0)
    bits = 2 * total > n[full][:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint's bits as a signed long."""
    def run(batches):
        for rows, data, offsets in text_slices(batches):
            fp = majority(*shingle_hashes(data, offsets, words))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


def vantage(points: np.ndarray) -> tuple[np.uint64, int]:
    """A vantage point among a few whose distances spread most, and their median."""
    tried = points[:: max(1, len(points) // 12)][:12]
    seen = points[:: max(1, len(points) // 1024)]
    best = max(tried, key=lambda v: distance(seen, v).std())
    return best, int(np.ceil(np.median(distance(points, best))))


@dataclass
class Tree:
    """Top of the tree: nodes of (vantage point, median, left, right); negative children are shards."""

    nodes: list[tuple[np.uint64, int, int, int]]
    shards: int

    @staticmethod
    def of(sample: np.ndarray, shards: int) -> Tree:
        nodes: list = []
        made = 0

        def grow(points, n):
            nonlocal made
            if n > 1 and len(points) > 2:
                v, mu = vantage(points)
                d = distance(points, v)
                if 0 < (d < mu).sum() < len(points):
                    me = len(nodes)
                    nodes.append(None)
                    left = grow(points[d < mu], n // 2)
                    right = grow(points[d >= mu], n - n // 2)
                    nodes[me] = (v, mu, left, right)
                    return me
            made += 1
            return -made
        grow(sample, shards)
        return Tree(nodes, made)

    def route(self, fp: np.ndarray, radius: int):
        """(row, shard, home) for the shard of each point and those it visits."""
        out = []

        def go(node, rows, home):
            if not len(rows):
                return
            if node < 0:
                out.append((rows, np.full(len(rows), -node - 1), home))
                return
            v, mu, left, right = self.nodes[node]
            d = distance(fp[rows], v)
            # points at home meet those of the far side as visitors there, one way only; visitors look on both sides
            near = d < mu
            go(left, rows[near & home], home[near & home])
            go(right, rows[~near & home], home[~near & home])
            cross = near & home & (d + radius >= mu)
            l, r = ~home & (d - radius < mu), ~home & (d + radius >= mu)
            go(left, rows[l], home[l])
            both = np.concatenate((rows[cross], rows[r]))
            go(right, both, np.zeros(len(both), bool))
        go(0 if self.nodes else -1, np.arange(len(fp)), np.ones(len(fp), bool))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool))


class Forest:
    """Labels of points joined by pairs, by vectorised hooking and pointer jumping."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.label[self.label], self.label):
                self.label = up


def close_pairs(fp: np.ndarray, x: np.ndarray, y: np.ndarray, radius: int, found) -> None:
    """Calls ``found`` with index pairs of x and y whose points are within the radius; a tree with triangle pruning."""
    if not len(x) or not len(y):
        return
    if len(x) * len(y) > BRUTE:
        v, mu = vantage(fp[y])
        dx, dy = distance(fp[x], v), distance(fp[y], v)
        sides = [(x[dx - radius < mu], y[dy < mu]), (x[dx + radius >= mu], y[dy >= mu])]
        if sum(len(a) * len(b) for a, b in sides) < 0.9 * len(x) * len(y):
            for a, b in sides:
                close_pairs(fp, a, b, radius, found)
            return
    step = max(1, BRUTE // len(y))
    for at in range(0, len(x), step):
        i, j = np.nonzero(np.bitwise_count(fp[x[at : at + step], None] ^ fp[y][None, :]) <= radius)
        if len(i):
            found(x[at + i], y[j])


def own_pairs(fp: np.ndarray, x: np.ndarray, radius: int, found) -> None:
    """The same within one set."""
    if len(x) * len(x) > BRUTE:
        v, mu = vantage(fp[x])
        d = distance(fp[x], v)
        left, right = x[d < mu], x[d >= mu]
        if 0 < len(left) < len(x):
            own_pairs(fp, left, radius, found)
            own_pairs(fp, right, radius, found)
            close_pairs(fp, x[(d < mu) & (d + radius >= mu)], x[(d >= mu) & (d - radius < mu)], radius, found)
            return
    step = max(1, BRUTE // max(1, len(x)))
    for at in range(0, len(x), step):
        i, j = np.nonzero(np.bitwise_count(fp[x[at : at + step], None] ^ fp[x][None, :]) <= radius)
        keep = i + at < j
        if keep.any():
            found(x[at + i[keep]], x[j[keep]])


def shard_forest(fp: np.ndarray, ids: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, smallest id of its group) that join what is linked within a shard."""
    order = np.argsort(ids, kind="stable")
    fp, ids, home = fp[order], ids[order], home[order]
    forest = Forest(len(fp))
    at_home, visitors = np.flatnonzero(home), np.flatnonzero(~home)
    own_pairs(fp, at_home, radius, forest.join)
    close_pairs(fp, visitors, at_home, radius, forest.join)
    apart = np.flatnonzero(forest.label != np.arange(len(fp)))
    return ids[apart], ids[forest.label[apart]]


def links(points: DataFrame, radius: int = RADIUS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """Edges ``(a, b)`` between ids of ``points(fp, id)`` with the components of all pairs within ``radius``."""
    n = points.count()
    shards = min(MOST_SHARDS, max(1, -(-n // shard_points)))
    drawn = points.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE_A_SHARD * shards) if shards > 1 else None
    sample = np.array([r[0] for r in drawn.collect()], np.int64).view(np.uint64) if shards > 1 else np.zeros(0, np.uint64)
    tree = Tree.of(sample, shards)

    def send(batches):
        for b in batches:
            fp = np.asarray(b.column("fp")).view(np.uint64)
            row, shard, home = tree.route(fp, radius)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), b.column("fp").take(take), b.column("id").take(take), pa.array(home)], ["shard", "fp", "id", "home"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = shard_forest(pdf["fp"].to_numpy().view(np.uint64), pdf["id"].to_numpy(), pdf["home"].to_numpy(), radius)
        return pd.DataFrame({"a": a, "b": b})

    sent = points.select("fp", "id").mapInArrow(send, "shard int, fp long, id long, home boolean")
    return sent.groupBy("shard").applyInPandas(meet, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fp, component_id)``: the smallest id reachable over links of at most ``radius`` bits."""
    docs = stored(fingerprints(df, id_col, text_col, words), "fingerprints")
    points = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("id")), "points")
    roots = components(links(points.filter("id is not null"), radius))
    named = points.join(roots, "id", "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    return docs.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """``df`` with one row of each group of fingerprints linked within ``radius``: the one with the smallest id (of rows sharing it, the smallest
    fingerprint, then the smallest text). Rows with one id and unlinked texts are told apart by their fingerprints. Rows with a null id stay.
    """
    present = df.filter(F.col(id_col).isNotNull())
    docs = stored(fingerprints(present, id_col, text_col, words), "fingerprints")
    roots = components(links(docs.select("fp", F.col("fp").alias("id")).distinct(), radius))
    groups = docs.join(roots.withColumnRenamed("id", "fp"), "fp", "left").groupBy(F.coalesce("root", "fp").alias("root"))
    stay = stored(groups.agg(F.min(F.struct("doc_id", "fp")).alias("first")).select("first.*"), "stay")
    several = docs.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low <> high").select(F.col("doc_id").alias(id_col))
    kept = present.join(stay.select(F.col("doc_id").alias(id_col)).distinct(), id_col, "left_semi")
    single = _first_of(kept.join(several, id_col, "left_anti"), [id_col], text_col)
    mark = fresh(df, "fp")
    marked = fingerprinted(kept.join(several, id_col, "left_semi"), mark, text_col, words)
    marked = marked.join(stay.select(F.col("doc_id").alias(id_col), F.col("fp").alias(mark)), [id_col, mark], "left_semi")
    told_apart = _first_of(marked, [id_col, mark], text_col).drop(mark)
    return single.unionByName(told_apart).unionByName(df.filter(F.col(id_col).isNull()))


def _first_of(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    rank = fresh(df, "rank")
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(text_col))).filter(F.col(rank) == 1).drop(rank)


def fingerprinted(df: DataFrame, name: str, text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``df`` with the fingerprint of its text as a new column."""
    columns = df.columns

    def run(batches):
        for rows, data, offsets in text_slices(batches, text_col):
            fp = majority(*shingle_hashes(data, offsets, words))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(fp.view(np.int64))], [*columns, name])
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.LongType())]))
