"""Context-triggered piecewise hashing of documents.

A rolling hash of the last seven bytes ends a chunk where it is -1 modulo the block size (three times a power of two,
chosen by the text's length, then halved while it gives too few chunks and doubled while it gives too many). Every chunk becomes one letter of a signature; a
fingerprint is ``block size:signature:signature at twice the block size``. Two fingerprints are compared where their block
sizes are compatible (equal, or one twice the other), by edit distance of the signatures (insertions and deletions), after a common run
of letters showed that they share content at all.

Triggers at a block size are a subset of those at half of it, so one pass over the bytes serves all block sizes.

Defined results: null text counts as empty; the empty text has the fingerprint ``3::``, alike (1.0) only to itself; equal texts have
equal fingerprints and likeness 1; repeated rows are neighbours of each other; null ids sort first; an empty table gives
an empty table; other columns are ignored. Whole texts are read. A signature has at most ``LETTERS``
letters (half of that at twice the block size); a run of equal chunks counts as three, and where more chunks are left at every block size, neighbours are merged evenly.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import slices, stored, text_bytes

WINDOW = 7
LETTERS = 64
LEAST_LETTERS = 8
LEAST_BLOCK = 3
RUN = 7
RUN_OF_EQUALS = 3

_MIX = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0xD3A2646D, 0xFD7046C5)]
_BASE = 0x5851F42D4C957F2D
_SHOWN = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    def grown(base):
        steps = np.full(n, base % 2**64, np.uint64)
        steps[0] = 1
        return np.cumprod(steps)
    return grown(_BASE), grown(pow(_BASE, -1, 2**64))


def _table(n: int):
    size = 1 << 16
    while size < n:
        size *= 2
    return _powers(size)


def rolling(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hash of the (up to) seven bytes of the same text ending at each byte."""
    b = data.astype(np.uint32) + np.uint32(1)
    h = b * _MIX[0]
    for back in range(1, WINDOW):
        term = b[:-back] * _MIX[back]
        # the first bytes of a text do not see the text before it
        for ahead in range(back):
            at = offsets[1:-1] + ahead - back
            term[at[(at >= 0) & (at < len(term))]] = 0
        h[back:] += term
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return h


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Fingerprint of each text of a slice."""
    size = np.diff(offsets)
    n = len(size)
    if not len(data):
        return [f"{LEAST_BLOCK}::"] * n
    z = rolling(data, offsets) + np.uint32(1)
    at = np.flatnonzero(z % np.uint32(LEAST_BLOCK) == 0)
    low = z[at] & (~z[at] + np.uint32(1))
    level = np.where(low == 0, 31, np.bitwise_count(low - np.uint32(1))).astype(np.int64)
    doc = np.searchsorted(offsets, at, side="right") - 1
    found = np.bincount(doc * 32 + level, minlength=32 * n).reshape(n, 32)[:, ::-1].cumsum(axis=1)[:, ::-1]
    want = np.maximum(0, np.ceil(np.log2(np.maximum(size, 1) / (LEAST_BLOCK * LETTERS)))).astype(np.int64)
    while True:
        short = (want > 0) & (found[np.arange(n), want] < LEAST_LETTERS)
        if not short.any():
            break
        want[short] -= 1
    while True:
        long = (want < 30) & (found[np.arange(n), want] > LETTERS) & (found[np.arange(n), np.minimum(want + 1, 31)] >= LEAST_LETTERS)
        if not long.any():
            break
        want[long] += 1
    power, inverse = _table(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])

    def signatures(least: np.ndarray, most: int) -> list[str]:
        ok = level >= least[doc]
        end, owner = at[ok] + 1, doc[ok]
        inner = end < offsets[owner + 1]
        # the rest of a text behind its last boundary is its last chunk
        whole = np.flatnonzero(size > 0)
        end, owner = np.concatenate((end[inner], offsets[whole + 1])), np.concatenate((owner[inner], whole))
        order = np.lexsort((end, owner))
        end, owner = end[order], owner[order]
        start = np.concatenate(([0], end[:-1]))
        chunk = (sums[end] - sums[start]) * inverse[start]
        chunk ^= chunk >> np.uint64(32)
        chunk *= np.uint64(0xD6E8FEB86659FD93)
        # of a run of equal chunks three say enough
        again = np.zeros(len(chunk), bool)
        again[1:] = (chunk[1:] == chunk[:-1]) & (owner[1:] == owner[:-1])
        again[RUN_OF_EQUALS:] &= again[2:-1] & again[1:-2] if len(again) > RUN_OF_EQUALS else True
        again[:RUN_OF_EQUALS] = False
        chunk, owner = chunk[~again], owner[~again]
        # more chunks than letters: neighbours are merged into as many even groups
        first = np.searchsorted(owner, np.arange(n + 1))
        count = np.diff(first)[owner]
        rank = np.arange(len(owner)) - first[owner]
        group = np.where(count <= most, rank, rank * most // np.maximum(count, 1))
        new = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (owner[1:] != owner[:-1])))
        chunk, owner = np.add.reduceat(chunk, new), owner[new]
        letters = _SHOWN[(chunk >> np.uint64(58)).astype(np.int64)].tobytes().decode("ascii")
        cut = np.searchsorted(owner, np.arange(n + 1))
        return [letters[cut[i] : cut[i + 1]] for i in range(n)]

    one, two = signatures(want, LETTERS), signatures(want + 1, LETTERS // 2)
    return [f"{LEAST_BLOCK << k}:{a}:{b}" for k, a, b in zip(want.tolist(), one, two, strict=True)]


def _shared_run(a: str, b: str) -> bool:
    k = max(1, min(RUN, -(-min(len(a), len(b)) // 4)))
    return any(a[i : i + k] in b for i in range(len(a) - k + 1))


def _common(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Longest common subsequence of each pair, by bits, for all pairs together."""
    n = len(pairs)
    width = max(len(b) for _, b in pairs)
    code = lambda s: np.frombuffer(s.encode("ascii"), np.uint8)
    masks = np.zeros((n, 129), np.uint64)
    text = np.full((n, width), 128, np.int64)
    lengths = np.array([len(a) for a, _ in pairs])
    left = np.full((n, lengths.max()), 128, np.int64)
    for i, (a, b) in enumerate(pairs):
        left[i, : len(a)], text[i, : len(b)] = code(a), code(b)
    rows = np.arange(n)
    for j in range(left.shape[1]):
        masks[rows, left[:, j]] |= np.uint64(1 << j)
    masks[:, 128] = 0
    v = np.full(n, 2**64 - 1, np.uint64)
    for j in range(width):
        u = v & masks[rows, text[:, j]]
        v = (v + u) | (v - u)
    inside = np.where(lengths >= 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(lengths, 63).astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(~v & inside).astype(np.int64)


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints."""
    out = np.zeros(len(left))
    owner, pairs = [], []
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        if x == y:
            out[i] = 1.0
            continue
        (k, a1, a2), (m, b1, b2) = x.split(":"), y.split(":")
        k, m = int(k), int(m)
        tried = ((a1, b1), (a2, b2)) if k == m else ((a2, b1),) if m == 2 * k else ((a1, b2),) if k == 2 * m else ()
        for a, b in tried:
            if a and b and _shared_run(a, b):
                owner.append(i)
                pairs.append((a, b))
    if pairs:
        alike = 2 * _common(pairs) / np.array([len(a) + len(b) for a, b in pairs])
        np.maximum.at(out, np.array(owner), alike)
    return out


def _of_texts(texts: list[str]) -> list[str]:
    data, offsets = text_bytes(pa.array(texts, pa.large_string()))
    out: list[str] = []
    for lo, hi in slices(offsets):
        out += fingerprints(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
    return out


def fingerprint_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint)`` of every text."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(_of_texts(b.column("text").fill_null("").to_pylist()), pa.string())], ["id", "fingerprint"])
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint string")


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(ids, texts, marks, following, next_marks):
    """Result columns for texts and the texts and fingerprints behind them."""
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    changed_marks = _of_texts(changed)
    return [ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array(marks, pa.string()), pa.array(changed_marks, pa.string()), pa.array(likeness(marks, changed_marks)), pa.array(likeness(marks, next_marks))]


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def neighbour_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint, compared with that of its edited form and of the next text by id.

    Texts are dealt by ranges of ids and compared along each range. The first and last text of a range are put
    aside, and the ranges' ends are joined with the next range's first text in a second, small step: two
    rows a range, whatever the number of documents. After the last text comes the first.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()

    def along(batches):
        me = TaskContext.get().partitionId()
        names = [*NAMES, "place", "at", "text"]

        def aside(i, text, mark, place):
            one = lambda x, t: pa.array([x], t)
            return pa.RecordBatch.from_arrays([one(i, id_type), one(None, pa.int64()), one(None, pa.string()), one(mark, pa.string()), one(None, pa.string()), one(None, pa.float64()),
                                               one(None, pa.float64()), one(place, pa.string()), one(me, pa.int32()), one(text, pa.string())], names)
        last = None
        for batch in batches:
            _, offsets = text_bytes(batch.column("text"))
            for lo, hi in slices(offsets):
                part = batch.slice(lo, hi - lo)
                texts = part.column("text").fill_null("").to_pylist()
                ids, marks = part.column("doc_id").to_pylist(), _of_texts(texts)
                if last is None:
                    yield aside(ids[0], texts[0], marks[0], "first")
                else:
                    ids, texts, marks = [last[0], *ids], [last[1], *texts], [last[2], *marks]
                last = (ids[-1], texts[-1], marks[-1])
                if n := len(ids) - 1:
                    out = _compared(pa.array(ids[:-1], id_type), texts[:-1], marks[:-1], texts[1:], marks[1:])
                    yield pa.RecordBatch.from_arrays([*out, pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], names)
        if last is not None:
            yield aside(*last, "last")

    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    done = stored(ordered.mapInArrow(along, f"doc_id {kind}, {RESULT}, place string, at int, text string"), "ranges")
    ends = done.filter("place is not null")
    places = sorted(r["at"] for r in ends.filter("place = 'first'").select("at").collect())
    follow = {a: b for a, b in zip(places, places[1:] + places[:1], strict=True)}
    steps = done.sparkSession.createDataFrame(list(follow.items()), "at int, to int")
    firsts = ends.filter("place = 'first'").select(F.col("at").alias("to"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_mark"))
    border = ends.filter("place = 'last'").join(steps, "at").join(firsts, "to").select("doc_id", "text", "fingerprint", "next_text", "next_mark")

    def finish(batches):
        for b in batches:
            if b.num_rows:
                get = lambda c: b.column(c).to_pylist()
                yield pa.RecordBatch.from_arrays(_compared(b.column("doc_id"), get("text"), get("fingerprint"), get("next_text"), get("next_mark")), NAMES)
    return done.filter("place is null").select(*NAMES).unionByName(border.mapInArrow(finish, f"doc_id {kind}, {RESULT}"))
