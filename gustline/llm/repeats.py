"""Repeated windows across documents by a depth-limited radix sort of suffixes.

Suffixes are ordered through ``WINDOW`` bytes only, most significant digits first; groups that hold one document leave the sort as soon as
that shows, and what is equal after the last digit is exactly a repeated window. The passes:

1. The first digit of a window is its anchor: the 20-byte string in it with the smallest hash. Equal windows have equal anchors at
   the same place, and neighbouring windows share theirs, so about one position in sixteen stands for all windows. Anchors found
   in one document only leave the sort here.
2. The other anchors go on with the bytes around them. Equal surroundings are one class; where an anchor has several classes, the windows
   of each class are sorted by eight bytes at a time, the groups of a single class leaving after each pass.
3. Every window then knows the smallest document that has it, and documents mark the bytes of windows that a smaller one has.

Texts are dealt once into parts of bounded size and stored bucketed by part; the passes exchange only hashes and surroundings. A part
counts an anchor or a class once, however many of its documents have it, so a passage that is in a third of all documents is as
many rows as there are parts.

Defined results: null text counts as empty; texts shorter than a window lose nothing; rows with equal ids do not repeat each other;
rows with a null id are kept whole and are nobody's repeat; windows never cross texts; an empty table gives an empty table; other
columns are ignored. Whole texts are read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from ..session import shared_dir
from .common import ragged, stored, text_bytes
from .fingerprints import _table as _powers

WINDOW = 50
GRAM = 20
BEFORE = WINDOW - GRAM  # windows of an anchor begin at most so many bytes before it
AROUND = BEFORE + WINDOW
PART_BYTES = 16 << 20
ROW_BYTES = (1 << 20) - 4096
ENTRIES = 750_000

CLASS_RUN = np.dtype([("class", "<i8"), ("near", "u1"), ("far", "u1"), ("least", "<i8")])
RECORD = np.dtype([("key", "<u8"), ("lo", "u1"), ("hi", "u1"), ("pad", "u1", 6), ("around", "u1", AROUND)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pack(x: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes())


def _unpack(x: bytes, kind="u1") -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def anchors(data: np.ndarray, offsets: np.ndarray):
    """Runs of windows with one anchor: its position and hash, and the first and last window start."""
    if len(data) < WINDOW:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    h = _mixed((sums[GRAM:] - sums[:-GRAM]) * inverse[: len(data) - GRAM + 1])
    # leftmost smallest hash of every BEFORE + 1 grams, by doubling
    value, at, width = h, np.arange(len(h), dtype=np.int32), 1
    while width < BEFORE + 1:
        step = min(width, BEFORE + 1 - width)
        left = value[:-step] <= value[step:]
        at = np.where(left, at[:-step], at[step:])
        value = np.minimum(value[:-step], value[step:])
        width += step
    starts = np.arange(len(at), dtype=np.int64)
    inside = np.ones(len(at), bool)
    for_doc = np.diff(offsets)
    # windows over the end of a text do not count
    last = np.minimum(for_doc, WINDOW - 1)
    bad = ragged(offsets[1:] - last, last)
    inside[bad[bad < len(at)]] = False
    starts = starts[inside]
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    a = at[starts]
    begin = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (starts[1:] != starts[:-1] + 1))))
    end = np.append(begin[1:], len(starts)) - 1
    p = a[begin].astype(np.int64)
    return p, h[p], starts[begin], starts[end]


def _keys(h: np.ndarray, hash_parts: int) -> np.ndarray:
    """48 bits of the hash and, in the low 16, the hash part."""
    return ((h >> np.uint64(16)) << np.uint64(16)) | ((h & np.uint64(0xFFFF)) % np.uint64(hash_parts))


def _classes(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of each distinct record and each row's class, in an order that depends on the rows alone."""
    columns = records.view("<u8").reshape(len(records), -1)
    h = np.zeros(len(records), np.uint64)
    for j in range(columns.shape[1]):
        h = _mixed(h ^ columns[:, j]) + np.uint64(j)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    if not (columns[first[which]] == columns).all():  # two records share a hash
        _, first, which = np.unique(columns, axis=0, return_index=True, return_inverse=True)
    return first, which.ravel()


class Part:
    """Texts of one part, in id order."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("seq")
        self.rows = [(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["sizes"], np.int64), r["texts"]) for r in table.to_pylist()]

    def slices(self):
        for ids, sizes, texts in self.rows:
            yield ids, _unpack(texts), np.concatenate(([0], np.cumsum(sizes)))

    def records(self, wanted: np.ndarray, hash_parts: int):
        """Records of anchors in ``wanted``, their documents, and for each slice the rows it has and where they lie."""
        found, docs, where = [], [], []
        for ids, data, offsets in self.slices():
            p, h, s0, s1 = anchors(data, offsets)
            key = _keys(h, hash_parts)
            ok = np.flatnonzero(_among(key, wanted))
            p, key, s0, s1 = p[ok], key[ok], s0[ok], s1[ok]
            rec = np.zeros(len(p), RECORD)
            rec["key"], rec["lo"], rec["hi"] = key, p - s0, p - s1
            padded = np.concatenate((np.zeros(BEFORE, np.uint8), data, np.zeros(WINDOW, np.uint8)))
            around = np.lib.stride_tricks.sliding_window_view(padded, AROUND)[p]
            j = np.arange(AROUND, dtype=np.int8) - np.int8(BEFORE)
            around[(j < -rec["lo"].astype(np.int8)[:, None]) | (j >= np.int8(WINDOW) - rec["hi"].astype(np.int8)[:, None])] = 0
            rec["around"] = around
            found.append(rec)
            docs.append(ids[np.searchsorted(offsets, p, side="right") - 1])
            where.append(p)
        if not found:
            return np.zeros(0, RECORD), np.zeros(0, np.int64), []
        return np.concatenate(found), np.concatenate(docs), where


def _among(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return sorted_[at] == x


def radix_groups(digits, group: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts rows by digit after digit within groups. Rows whose group has one member leave; returns the rows left and their groups.

    ``digits(j, rows)`` gives digit j of rows as 64-bit numbers, or None behind the last digit.
    """
    rows = np.arange(len(group))
    j = 0
    while True:
        order = np.lexsort((member[rows], group))
        rows, group = rows[order], group[order]
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(rows) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(rows)))
        several = member[rows[first]] != member[rows[first + size - 1]] if len(rows) else np.zeros(0, bool)
        keep = np.repeat(several, size)
        rows, group = rows[keep], np.repeat(np.arange(len(first)), size)[keep]
        digit = digits(j, rows) if len(rows) else None
        if digit is None:
            return rows, group
        order = np.lexsort((digit, group))
        rows, group, digit = rows[order], group[order], digit[order]
        group = np.cumsum(np.concatenate(([True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])))) - 1
        j += 1


def smallest_documents(records: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of windows of each class of records with the smallest document that has them, and each record's class.

    A run is (class, near, far, document): windows that begin ``near`` to ``far`` bytes before the anchor.
    """
    first, which = _classes(records)
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, which, docs)
    reps = records[first]
    _, key, times = np.unique(reps["key"], return_inverse=True, return_counts=True)
    alone = times[key] == 1
    out = np.zeros(int(alone.sum()), CLASS_RUN)
    out["class"], out["near"], out["far"], out["least"] = np.flatnonzero(alone), reps["hi"][alone], reps["lo"][alone], least[alone]
    # only anchors with several classes need the sort of their windows
    mixed = np.flatnonzero(~alone)
    if not len(mixed):
        return out, which
    hi, n = reps["hi"][mixed].astype(np.int64), (reps["lo"][mixed] - reps["hi"][mixed]).astype(np.int64) + 1
    owner, back = np.repeat(mixed, n), ragged(hi, n)
    flat = np.concatenate((np.ascontiguousarray(reps["around"]).ravel(), np.zeros(8, np.uint8)))
    eights = np.lib.stride_tricks.as_strided(flat, (len(flat) - 7, 8), (1, 1))
    base = owner * AROUND + BEFORE - back

    def digits(j, rows):
        if 8 * j >= WINDOW:
            return None
        at = min(8 * j, WINDOW - 8)  # the last digit overlaps the one before
        return np.ascontiguousarray(eights[base[rows] + at]).view(">u8").ravel().astype(np.uint64)
    window_least = least[owner]
    rows, group = radix_groups(digits, key[owner] * 64 + back, owner)
    if len(rows):
        best = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(best, group, window_least[rows])
        window_least[rows] = best[group]
    begin = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (window_least[1:] != window_least[:-1]))))
    end = np.append(begin[1:], len(owner)) - 1
    more = np.zeros(len(begin), CLASS_RUN)
    more["class"], more["near"], more["far"], more["least"] = owner[begin], back[begin], back[end], window_least[begin]
    out = np.concatenate((out, more))
    return out[np.argsort(out["class"], kind="stable")], which


def _split(columns: dict[str, np.ndarray], by: np.ndarray, names: list[str], extra=()):
    """One packed row for each value of ``by``."""
    order = np.argsort(by, kind="stable")
    values, at = np.unique(by[order], return_index=True)
    ends = np.append(at[1:], len(by))
    rows = {n: pa.array([_pack(columns[n][order[a:b]]) for a, b in zip(at, ends, strict=True)], pa.binary()) for n in names}
    return pa.table({"to": pa.array(values.astype(np.int32)), **{k: pa.array([v] * len(values), pa.int32()) for k, v in extra}, **rows})


def removed_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """``(doc_id, n_bytes, n_removed, n_spans, kept)``: texts without the bytes of windows that a document of smaller id has."""
    return _removed(df, id_col, text_col, lambda kept: kept, "binary", pa.binary(), "kept")


def removal_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """The same with the SHA-256 of the bytes kept."""
    return _removed(df, id_col, text_col, lambda kept: hashlib.sha256(kept).hexdigest(), "string", pa.string(), "kept_sha256")


def _removed(df, id_col, text_col, show, kind, arrow_kind, name):
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // PART_BYTES))
    hash_parts = min(65536, max(1, -(-total // (16 * ENTRIES))))
    result = f"doc_id long, n_bytes long, n_removed long, n_spans long, {name} {kind}"
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", name]

    def deal(batches):
        for b in batches:
            data, offsets = text_bytes(b.column("text"))
            ids, size, part = np.asarray(b.column("doc_id")), np.diff(offsets), np.asarray(b.column("part"))
            for p in np.unique(part):
                mine = np.flatnonzero(part == p)
                texts = data[ragged(offsets[mine], size[mine])]
                yield pa.RecordBatch.from_arrays([pa.array([int(p)], pa.int32()), pa.array([ids[mine].tobytes()], pa.binary()), pa.array([size[mine].astype(np.int64).tobytes()], pa.binary()),
                                                  pa.array([_pack(texts)], pa.binary())], ["part", "ids", "sizes", "texts"])

    def merge(table: pa.Table) -> pa.Table:
        docs = []
        for r in table.to_pylist():
            texts, at = _unpack(r["texts"]).tobytes(), 0
            for i, n in zip(np.frombuffer(r["ids"], np.int64).tolist(), np.frombuffer(r["sizes"], np.int64).tolist(), strict=True):
                docs.append((i, texts[at : at + n]))
                at += n
        docs.sort()
        out, at = [], 0
        while at < len(docs):
            to, size = at, 0
            while to < len(docs) and (to == at or size + len(docs[to][1]) <= ROW_BYTES):
                size += len(docs[to][1])
                to += 1
            some = docs[at:to]
            out.append((np.array([d[0] for d in some], np.int64).tobytes(), np.array([len(d[1]) for d in some], np.int64).tobytes(), _pack(b"".join(d[1] for d in some))))
            at = to
        ids, sizes, texts = zip(*out, strict=True)
        return pa.table({"part": pa.array([table.column("part")[0].as_py()] * len(out), pa.int32()), "seq": pa.array(range(len(out)), pa.int32()),
                         "ids": pa.array(ids, pa.binary()), "sizes": pa.array(sizes, pa.binary()), "texts": pa.array(texts, pa.binary())})

    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")
    dealt = rows.filter("doc_id is not null").select("doc_id", "text", part.alias("part")).mapInArrow(deal, "part int, ids binary, sizes binary, texts binary")
    merged = dealt.groupBy("part").applyInArrow(merge, "part int, seq int, ids binary, sizes binary, texts binary")
    label = f"parts_{uuid.uuid4().hex}"
    (merged.write.bucketBy(parts, "part").option("path", f"{shared_dir(spark).rstrip('/')}/{label}").option("compression", "none").saveAsTable(label))
    texts = spark.table(label)

    def first_digit(table: pa.Table) -> pa.Table:
        me, keys, docs = table.column("part")[0].as_py(), [], []
        for ids, data, offsets in Part(table).slices():
            p, h, _, _ = anchors(data, offsets)
            keys.append(_keys(h, hash_parts))
            docs.append(ids[np.searchsorted(offsets, p, side="right") - 1])
        key, doc = np.concatenate(keys), np.concatenate(docs)
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        several = (np.maximum.reduceat(doc, first) != np.minimum.reduceat(doc, first)) if len(key) else np.zeros(0, bool)
        key = key[first]
        short = np.zeros(len(key), np.dtype([("low", "<u4"), ("high", "<u2")]))
        short["low"], short["high"] = (key >> np.uint64(16)) & np.uint64(0xFFFFFFFF), key >> np.uint64(48)
        return _split({"keys": short, "several": several}, (key & np.uint64(0xFFFF)).astype(np.int64), ["keys", "several"], [("part", me)])

    def shared_anchors(table: pa.Table) -> pa.Table:
        mine = np.uint64(table.column("to")[0].as_py())
        keys, several, parts_ = [], [], []
        for r in table.to_pylist():
            k = _unpack(r["keys"], np.dtype([("low", "<u4"), ("high", "<u2")]))
            keys.append((k["high"].astype(np.uint64) << np.uint64(48)) | (k["low"].astype(np.uint64) << np.uint64(16)) | mine)
            several.append(_unpack(r["several"], bool))
            parts_.append(np.full(len(k), r["part"], np.int32))
        key, several, part_ = np.concatenate(keys), np.concatenate(several), np.concatenate(parts_)
        order = np.argsort(key, kind="stable")
        key, several, part_ = key[order], several[order], part_[order]
        again = np.zeros(len(key), bool)
        again[1:] = key[1:] == key[:-1]
        again[:-1] |= again[1:].copy()
        ok = again | several
        return _split({"keys": key[ok]}, part_[ok], ["keys"]).rename_columns(["part", "keys"])

    def surroundings(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"to": pa.array([], pa.int32()), "part": pa.array([], pa.int32()), **{n: pa.array([], pa.binary()) for n in ("at", "records", "docs", "several")}})
        rec, doc, _ = Part(left).records(_wanted(right), hash_parts)
        first, which = _classes(rec)
        least, most = np.full(len(first), np.iinfo(np.int64).max), np.full(len(first), np.iinfo(np.int64).min)
        np.minimum.at(least, which, doc)
        np.maximum.at(most, which, doc)
        columns = {"at": np.arange(len(first), dtype=np.uint32), "records": rec[first], "docs": least, "several": most > least}
        return _split(columns, (rec["key"][first] & np.uint64(0xFFFF)).astype(np.int64), ["at", "records", "docs", "several"], [("part", left.column("part")[0].as_py())])

    def sort_windows(table: pa.Table) -> pa.Table:
        rows_ = table.to_pylist()
        unpacked = {n: [_unpack(r[n], k) for r in rows_] for n, k in (("at", "<u4"), ("records", RECORD), ("docs", np.int64), ("several", bool))}
        part_ = np.repeat([r["part"] for r in rows_], [len(x) for x in unpacked["at"]]).astype(np.int32)
        at, rec, doc, several = (np.concatenate(unpacked[n]) for n in ("at", "records", "docs", "several"))
        found, which = smallest_documents(rec, doc)
        lo = np.searchsorted(found["class"], which)
        n = np.searchsorted(found["class"], which, side="right") - lo
        of, row = ragged(lo, n), np.repeat(np.arange(len(rec)), n)
        run = np.zeros(len(of), RUN)
        run["at"], run["near"], run["far"], run["least"] = at[row], found["near"][of], found["far"][of], found["least"][of]
        useful = several[row] | (run["least"] < doc[row])
        return _split({"runs": run[useful]}, part_[row][useful], ["runs"]).rename_columns(["part", "runs"])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if not left.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), arrow_kind), strict=True)})
        me = Part(left)
        rec, doc, where = me.records(_wanted(right), hash_parts)
        run = np.concatenate([np.zeros(0, RUN), *[_unpack(x.as_py(), RUN) for x in right.column("runs") if x.is_valid]])
        run = run[np.argsort(run["at"], kind="stable")]
        which = _classes(rec)[1] if len(rec) else np.zeros(0, np.int64)
        lo, n = np.searchsorted(run["at"], which), np.searchsorted(run["at"], which, side="right")
        n = n - lo
        row, of = np.repeat(np.arange(len(rec)), n), ragged(lo, n)
        gone = doc[row] > run["least"][of]
        row, of = row[gone], of[gone]
        at = 0
        for i, (ids, data, offsets) in enumerate(me.slices()):
            count = len(where[i])
            mine = (row >= at) & (row < at + count)
            p = where[i][row[mine] - at]
            cover = np.zeros(len(data) + 1, np.int64)
            np.add.at(cover, p - run["far"][of[mine]], 1)
            np.add.at(cover, p - run["near"][of[mine]] + WINDOW, -1)
            cut = np.cumsum(cover)[:-1] > 0
            at += count
            edge = np.zeros(len(data) + 1, bool)
            edge[offsets] = True
            begins = cut.copy()
            begins[1:] &= ~cut[:-1] | edge[1:-1]
            total_cut, total_begin = np.concatenate(([0], np.cumsum(cut))), np.concatenate(([0], np.cumsum(begins)))
            kept = data[~cut].tobytes()
            size, lost = np.diff(offsets), np.diff(total_cut[offsets])
            ends = np.concatenate(([0], np.cumsum(size - lost)))
            out.append(pa.table([pa.array(ids), pa.array(size), pa.array(lost), pa.array(np.diff(total_begin[offsets])), pa.array([show(kept[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], arrow_kind)], names))
        return pa.concat_tables(out)

    counted = texts.groupBy("part").applyInArrow(first_digit, "to int, part int, keys binary, several binary")
    shared = stored(counted.groupBy("to").applyInArrow(shared_anchors, "part int, keys binary"), "anchors")
    by_part = texts.groupBy("part")
    around = by_part.cogroup(shared.groupBy("part")).applyInArrow(surroundings, "to int, part int, at binary, records binary, docs binary, several binary")
    runs = around.groupBy("to").applyInArrow(sort_windows, "part int, runs binary")
    answers = shared.select("part", "keys", F.lit(None).cast("binary").alias("runs")).unionByName(runs.select("part", F.lit(None).cast("binary").alias("keys"), "runs"))
    done = by_part.cogroup(answers.groupBy("part")).applyInArrow(finish, result)

    def whole(batches):
        for b in batches:
            raw = [t.encode() for t in b.column("text").to_pylist()]
            zero = pa.array([0] * len(raw), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t) for t in raw], pa.int64()), zero, zero, pa.array([show(t) for t in raw], arrow_kind)], names)
    return done.unionByName(rows.filter("doc_id is null").mapInArrow(whole, result))


RUN = np.dtype([("at", "<u4"), ("near", "u1"), ("far", "u1"), ("least", "<i8")])


def _wanted(right: pa.Table) -> np.ndarray:
    """Sorted keys of the anchors that more than one document has."""
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *[_unpack(x.as_py(), "<u8") for x in right.column("keys") if x.is_valid]]))
