"""Pattern packing by non-negative least squares.

Documents become pieces of at most ``capacity`` tokens. Only the histogram of piece lengths, at most ``capacity`` numbers,
reaches the driver: patterns of one to three lengths that fill a sequence exactly are enumerated, repeat counts are fitted
to the histogram by non-negative least squares, rounded down to what the histogram holds, and the residual
is packed best fit, longest first. A plan is a list of slots (length, range of ranks, first sequence, offset). In Spark
every piece gets its rank among the pieces of its length from counts by block, so a common length is spread
over many tasks, and takes its place from the slot of its rank.

Defined results: null text counts as empty and gives one piece (the end token); null ids are packed; repeated rows are packed each;
pieces of equal length are interchangeable and ranked by block, id, piece and content; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .bpe import vocabulary
from .common import WORD_SLICE_BYTES, stored, text_slices

CAPACITY = 1024
END_TOKEN = 2
BLOCK_ROWS = 1024
ROUNDS = 400
TYPICAL_LENGTHS = 420  # lengths that take part in patterns of three, most frequent first


def pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_token: int = END_TOKEN, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` and, if asked for, ``ids``; a first piece may be shorter, others are full."""
    def run(batches):
        v = vocabulary(path)
        for rows, data, offsets in text_slices(batches, limit=WORD_SLICE_BYTES):
            ids, at = v.encode(data, offsets)
            ids = np.insert(ids, at[1:], end_token).astype("<u4")
            at = at + np.arange(len(at))
            size = np.diff(at)
            n = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            first = size - (n - 1) * capacity
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[doc], capacity)
            raw, begin = ids.tobytes(), at[doc] + start
            crc = [zlib.crc32(raw[4 * b : 4 * (b + k)]) for b, k in zip(begin.tolist(), length.tolist(), strict=True)]
            out = [rows.column("id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            if with_ids:
                out.append(pa.ListArray.from_arrays(np.append(begin, len(ids)).astype(np.int32), ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(out, names)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def patterns(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of three lengths (0 for none) that fill a sequence exactly, longest first."""
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    out = [np.array([[capacity, 0, 0]])] if have[capacity] else []
    a = lengths[(lengths * 2 >= capacity) & (lengths < capacity)]
    a = a[have[capacity - a]]
    out.append(np.stack((a, capacity - a, np.zeros_like(a)), 1))
    some = np.sort(lengths[np.argsort(-counts, kind="stable")][:TYPICAL_LENGTHS])
    x, y = np.meshgrid(some, some, indexing="ij")
    z = capacity - x - y
    ok = (x >= y) & (y >= z) & (z > 0)
    x, y, z = x[ok], y[ok], z[ok]
    ok = have[z]
    out.append(np.stack((x[ok], y[ok], z[ok]), 1))
    return np.concatenate(out)


def fit(pats: np.ndarray, h: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 with least |A x - h|, where a column of A counts the lengths of a pattern: accelerated projected gradient."""
    m = len(h)
    apply = lambda x: sum(np.bincount(pats[:, j], x, m) for j in range(3)) * used
    back = lambda r: (r[pats] * (pats > 0)).sum(axis=1)
    used = np.ones(m)
    used[0] = 0  # zero pads patterns of fewer than three lengths
    # weights even out frequent and rare lengths
    w = used / np.maximum(h, 1.0)
    u = np.ones(len(pats))
    for _ in range(12):  # largest eigenvalue, by powers
        u = back(w * apply(u))
        top = np.linalg.norm(u)
        u /= max(top, 1e-300)
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(w * (apply(y) - h)) / (1.05 * top))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / s * (new - x)
        x, t = new, s
    return x


def best_fit(h: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Packs a histogram longest first, each piece where least room is left: (pattern, repeats) by groups of equal sequences."""
    room: dict[int, list[list]] = defaultdict(list)  # room left to groups [pattern, repeats]
    free = np.zeros(capacity + 1, bool)

    def put(pattern, n):
        left = capacity - sum(pattern)
        room[left].append([pattern, n])
        free[left] = True

    for length in range(capacity, 0, -1):
        c = int(h[length])
        while c:
            fits = np.flatnonzero(free[length:])
            if not len(fits):
                m = capacity // length
                full, rest = divmod(c, m)
                if full:
                    put((length,) * m, full)
                if rest:
                    put((length,) * rest, 1)
                break
            left = length + int(fits[0])
            group = room[left][-1]
            n = min(c, group[1])
            group[1] -= n
            c -= n
            if not group[1]:
                room[left].pop()
                free[left] = bool(room[left])
            put((*group[0], length), n)
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for groups in room.values():
        for pattern, n in groups:
            merged[pattern] += n
    return sorted(merged.items(), reverse=True)


def plan(h: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) covering the histogram ``h`` (entry i: pieces of length i) exactly."""
    lengths = np.flatnonzero(h)
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return []
    pats = patterns(lengths, h[lengths], capacity)
    x = fit(pats, h.astype(float)) if len(pats) else np.zeros(0)
    best = None
    for part in (1.0, 0.9, 0.6, 0.3):
        left, chosen = h.copy(), []
        for i in np.argsort(-x, kind="stable"):
            n = int(np.floor(x[i] * part + 1e-9))
            if n <= 0:
                break
            pattern = tuple(int(p) for p in pats[i] if p)
            n = min([n, *(int(left[p]) // pattern.count(p) for p in pattern)])
            if n > 0:
                chosen.append((pattern, n))
                for p in pattern:
                    left[p] -= n
        chosen += best_fit(left, capacity)
        if best is None or sum(n for _, n in chosen) < sum(n for _, n in best):
            best = chosen
    return best


def slots(packed: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted; ranks of a length go through its slots in order."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for pattern, n in packed:
        offset = 0
        for length in pattern:
            out.append((length, used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def ranked(rows: DataFrame, h: np.ndarray) -> DataFrame:
    """Adds ``rank``, from 0, among the rows of one length; a frequent length (``h`` counts them) is cut into blocks by a hash."""
    blocks = F.lit(np.maximum(1, -(-h // BLOCK_ROWS)).tolist())
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(blocks, F.col("length").cast("int"))))
    counts = rows.groupBy("length", "block").count()
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "start", "ids_crc32")
    rows = rows.withColumn("within", F.row_number().over(within))
    return rows.join(counts, ["length", "block"]).withColumn("rank", F.col("before") + F.col("within") - 1).drop("before", "within", "block")


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_token: int = END_TOKEN) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` for all pieces of ``df``."""
    rows = stored(pieces(df, path, id_col, text_col, capacity, end_token), "pieces")
    h = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("length").count().collect():
        h[r["length"]] = r["count"]
    table = slots(plan(h, capacity))
    key = (table[:, 0] << 40) | table[:, 1]
    columns = rows.columns

    def place(batches):
        for b in batches:
            rank = np.asarray(b.column("rank"))
            at = np.searchsorted(key, (np.asarray(b.column("length")) << 40) | rank, side="right") - 1
            new = [pa.array(table[at, 2] + rank - table[at, 1]), pa.array(table[at, 3])]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], *new], [*columns, "sequence_id", "offset"])
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return ranked(rows, h).select(*columns, "rank").mapInArrow(place, f"{fields}, sequence_id long, offset long")
