"""Language identification by prediction by partial matching (PPM).

Per language a tree of byte contexts of up to three bytes is counted over a sample of labelled texts and then frozen.
A byte is coded in the longest context that the tree knows; if it was never seen there, an escape is coded
and the next shorter context is tried, without the bytes already excluded (method C: a context with T bytes of d
kinds gives an escape d / (T + d)); below the empty context every byte not yet excluded is equally likely. With frozen counts a
byte's code length depends on the four bytes ending in it, so the code lengths of all four-byte strings of
the samples are worked out once; strings outside them are worked out when they are met. A text's
code length is the exact sum, its language the one with the shortest code, its score 2**-length over the sum of that over all languages.

Texts are folded first: letters in lower case, everything else one blank, three blanks in front.

Defined results: null text or a text without letters gives ``und`` and score 0, as does a corpus without labelled texts;
ties go to the alphabetically first language; null languages teach nothing; repeated rows teach and are predicted each;
an empty table gives an empty table; other columns are ignored. Whole texts are always read.

The bound on the sample is ``docs_per_lang`` (expected documents of each language, drawn by a hash of text and id) and
``max_langs`` (most frequent languages).
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .bpe import LETTER, _classes
from .common import slices, text_bytes, text_slices

UNKNOWN = "und"
ORDER = 3
DOCS_PER_LANG = 1500
MAX_LANGS = 200
PAIRS = 2048
LEAST_SCORE = 0.3
MOST_BITS = 9.0


@functools.cache
def _folded() -> np.ndarray:
    """Code point to its lower case form; 32 for what is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for i in np.flatnonzero(_classes() == LETTER).tolist():
        low = chr(i).lower()
        table[i] = ord(low) if len(low) == 1 else i
    return table


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, each text's offset in them, and whether it has letters."""
    c = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(c) == len(data):
        at = offsets
    else:
        width = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
        at = np.searchsorted(np.concatenate(([0], np.cumsum(width))), offsets)
    low = _folded()[c]
    first = np.zeros(len(c) + 1, bool)
    first[at] = True
    blank = low == 32
    keep = np.ones(len(c), bool)
    keep[1:] = ~(blank[1:] & blank[:-1]) | first[1:-1]
    letters = np.concatenate(([0], np.cumsum(~blank)))
    has = letters[at[1:]] > letters[at[:-1]]
    kept = np.concatenate(([0], np.cumsum(keep)))[at]
    text = low[keep]
    # three blanks before each text
    size = np.diff(kept) + ORDER
    ends = np.cumsum(size)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint32)
    place = np.arange(len(text)) + np.repeat(np.arange(1, len(size) + 1) * ORDER, np.diff(kept))
    out[place] = text
    raw = out.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (out >= 0x80).astype(np.int64) + (out >= 0x800) + (out >= 0x10000)
    bytes_at = np.concatenate(([0], np.cumsum(width)))
    return np.frombuffer(raw, np.uint8), bytes_at[np.concatenate(([0], ends))] if len(ends) else np.zeros(1, np.int64), has


def grams(folded: np.ndarray) -> np.ndarray:
    """Every four bytes as one number, first byte highest; entry i ends in byte i + 3."""
    b = folded.astype(np.uint32)
    return (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]


@dataclass
class Tree:
    """Frozen counts of one language: per order k the sorted codes of k context bytes and one byte."""

    codes: list[np.ndarray]
    counts: list[np.ndarray]
    contexts: list[np.ndarray]
    total: list[np.ndarray]
    kinds: list[np.ndarray]
    total_left: list[np.ndarray]  # of the next shorter context, without the bytes this one has
    kinds_left: list[np.ndarray]

    @staticmethod
    def of(gram: np.ndarray, count: np.ndarray) -> Tree:
        codes, counts, contexts, total, kinds = [], [], [], [], []
        for k in range(ORDER + 1):
            code, inv = np.unique(gram & np.uint64((1 << (8 * (k + 1))) - 1), return_inverse=True)
            n = np.bincount(inv, count, len(code))
            ctx, at = np.unique(code >> np.uint64(8), return_inverse=True)
            codes.append(code), counts.append(n), contexts.append(ctx)
            total.append(np.bincount(at, n, len(ctx))), kinds.append(np.bincount(at, minlength=len(ctx)).astype(float))
        total_left, kinds_left = [np.zeros(1)], [np.zeros(1)]
        for k in range(1, ORDER + 1):
            shorter = np.searchsorted(codes[k - 1], codes[k] & np.uint64((1 << (8 * k)) - 1))
            at = np.searchsorted(contexts[k], codes[k] >> np.uint64(8))
            parent = np.searchsorted(contexts[k - 1], contexts[k] & np.uint64((1 << (8 * (k - 1))) - 1))
            total_left.append(total[k - 1][parent] - np.bincount(at, counts[k - 1][shorter], len(contexts[k])))
            kinds_left.append(kinds[k - 1][parent] - kinds[k])
        return Tree(codes, counts, contexts, total, kinds, total_left, kinds_left)

    def cost(self, gram: np.ndarray) -> np.ndarray:
        """Code length in bits of the last byte of each gram behind its first three."""
        gram = gram.astype(np.uint64)
        bits = np.zeros(len(gram))
        open_ = np.arange(len(gram))
        came = np.full(len(gram), -1)  # node of the longer context that escaped
        for k in range(ORDER, -1, -1):
            g = gram[open_] & np.uint64((1 << (8 * (k + 1))) - 1)
            ctx = g >> np.uint64(8)
            node = np.minimum(np.searchsorted(self.contexts[k], ctx), len(self.contexts[k]) - 1)
            known = self.contexts[k][node] == ctx
            at = np.minimum(np.searchsorted(self.codes[k], g), len(self.codes[k]) - 1)
            n = np.where(self.codes[k][at] == g, self.counts[k][at], 0)
            total, kinds = self.total[k][node], self.kinds[k][node]
            if k < ORDER:
                up, escaped = came[open_], came[open_] >= 0
                total = np.where(escaped, self.total_left[k + 1][up], total)
                kinds = np.where(escaped, self.kinds_left[k + 1][up], kinds)
            hit = known & (n > 0)
            room = np.where(known & (total + kinds > 0), total + kinds, 1)
            bits[open_] += np.where(hit, np.log2(room / np.maximum(n, 1)), np.where(known & (kinds > 0), np.log2(room / np.maximum(kinds, 1)), 0))
            came[open_] = np.where(known, node, -1)
            open_ = open_[~hit]
        bits[open_] += np.log2(256 - self.kinds[0][0])
        return bits


@dataclass
class Model:
    langs: list[str]
    trees: list[Tree]
    known: np.ndarray  # grams of the samples, sorted
    cost: np.ndarray  # their code lengths, a column a language

    def index(self):
        """Table from two pair numbers to a row of ``cost``: the most frequent byte pairs get numbers."""
        pairs = np.concatenate((self.known >> np.uint32(16), self.known & np.uint32(0xFFFF)))
        values, n = np.unique(pairs, return_counts=True)
        top = values[np.argsort(-n, kind="stable")[:PAIRS]]
        number = np.zeros(65536, np.int32)
        number[top] = np.arange(1, len(top) + 1)
        width = len(top) + 1
        table = np.full(width * width, -1, np.int32)
        a, b = number[self.known >> np.uint32(16)], number[self.known & np.uint32(0xFFFF)]
        ok = (a > 0) & (b > 0)
        table[a[ok] * width + b[ok]] = np.flatnonzero(ok)
        return number, width, table

    def lengths(self, folded: np.ndarray, offsets: np.ndarray, index) -> np.ndarray:
        """Code length of each text in each language."""
        number, width, table = index
        g = grams(folded)
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        if not len(g):
            return out
        row = table[number[g >> np.uint32(16)] * width + number[g & np.uint32(0xFFFF)]]
        # grams over the border of two texts count for neither
        inside = np.ones(len(g), bool)
        for back in range(1, ORDER + 1):
            at = offsets[1:-1] - back
            inside[at[(at >= 0) & (at < len(g))]] = False
        strange = np.flatnonzero((row < 0) & inside)
        bits = self.cost[row]
        bits[~inside] = 0
        if len(strange):
            values, inv = np.unique(g[strange], return_inverse=True)
            bits[strange] = np.stack([t.cost(values) for t in self.trees], 1)[inv]
        sums = np.concatenate((np.zeros((1, bits.shape[1])), np.cumsum(bits, axis=0)))
        begin, end = np.minimum(offsets[:-1], len(g)), np.minimum(np.maximum(offsets[1:] - ORDER, offsets[:-1]), len(g))
        return sums[end] - sums[begin]


def sample(df: DataFrame, text_col: str, lang_col: str, id_col: str, docs_per_lang: int, max_langs: int) -> DataFrame:
    """``(lang, text)``: about ``docs_per_lang`` whole texts of each of the most frequent languages."""
    rows = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    langs = rows.groupBy(F.col(lang_col).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    share = F.lit(None).cast("double")
    for r in langs:
        share = F.when(F.col(lang_col) == r["lang"], F.lit(min(1.0, docs_per_lang / r["count"]))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.filter(draw < share).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))


def fit(labelled: DataFrame, text_col="text", lang_col="lang", id_col="doc_id", docs_per_lang=DOCS_PER_LANG, max_langs=MAX_LANGS) -> Model | None:
    """Counts the sample's four-byte strings in Spark; the frozen trees fit on the driver because the sample is bounded."""
    def count(batches):
        for rows, data, offsets in text_slices(batches):
            langs = np.array(rows.column("lang").to_pylist(), dtype=object)
            folded, at, _ = fold(data, offsets)
            g, doc = grams(folded), np.repeat(np.arange(len(at) - 1), np.diff(at))
            inside = doc[:-ORDER] == doc[ORDER:]
            for lang in sorted(set(langs)):
                value, n = np.unique(g[inside & (langs == lang)[doc[:-ORDER]]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(value), pa.string()), pa.array(value.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])
    rows = sample(labelled, text_col, lang_col, id_col, docs_per_lang, max_langs)
    counted = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    if not table.num_rows:
        return None
    lang = np.array(table.column("lang").to_pylist(), dtype=object)
    gram, n = np.asarray(table.column("gram")).astype(np.uint64), np.asarray(table.column("n")).astype(float)
    langs = sorted(set(lang))
    trees = [Tree.of(gram[lang == x], n[lang == x]) for x in langs]
    known = np.unique(gram).astype(np.uint32)
    return Model(langs, trees, known, np.stack([t.cost(known) for t in trees], 1))


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """``(id, lang_pred, score, bits)`` and the columns in ``keep``; ``bits`` is the code length of a folded byte."""
    keep = keep or {}
    rows = df.select(F.col(id_col).alias("id"), *[c.alias(k) for k, c in keep.items()], F.col(text_col).alias("text"))
    extra = "".join(f", {k} {rows.schema[k].dataType.simpleString()}" for k in keep)
    shared, kept = df.sparkSession.sparkContext.broadcast(model), list(keep)

    def run(batches):
        m = shared.value
        index = m.index() if m else None
        for part, data, offsets in text_slices(batches):
            folded, at, has = fold(data, offsets)
            n = len(offsets) - 1
            if m:
                bits = m.lengths(folded, at, index)
                best = bits.argmin(axis=1)
                least = bits[np.arange(n), best]
                score = np.where(has, 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1), 0.0)
                lang = np.where(has, np.array(m.langs, dtype=object)[best], UNKNOWN)
                rate = least / np.maximum(np.diff(at) - ORDER, 1)
            else:
                score, lang, rate = np.zeros(n), np.full(n, UNKNOWN, object), np.zeros(n)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), *[part.column(k) for k in kept], pa.array(lang, pa.string()), pa.array(score), pa.array(rate)],
                ["id", *kept, "lang_pred", "score", "bits"])
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}{extra}, lang_pred string, score double, bits double")


def keep_identified(df: DataFrame, model: Model | None, text_col: str = "text", least_score: float = LEAST_SCORE, most_bits: float = MOST_BITS) -> DataFrame:
    """Rows of ``df`` whose text has a language: letters, a score of at least ``least_score``, at most ``most_bits`` bits a folded byte.

    The second bound is a bit more than a byte takes without any model: it rejects letters in an order that no learned language
    explains, and leaves short texts alone. Without a model nothing is rejected but
    texts without letters.
    """
    shared, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text_col)

    def run(batches):
        m = shared.value
        index = m.index() if m else None
        for b in batches:
            data, offsets = text_bytes(b.column(at))
            for lo, hi in slices(offsets):
                part, n = offsets[lo : hi + 1] - offsets[lo], hi - lo
                folded, where, ok = fold(data[offsets[lo] : offsets[hi]], part)
                if m:
                    bits = m.lengths(folded, where, index)
                    least = bits.min(axis=1)
                    score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                    ok = ok & (score >= least_score) & (least <= most_bits * np.maximum(np.diff(where) - ORDER, 1))
                yield b.slice(lo, n).filter(pa.array(ok))
    return df.mapInArrow(run, df.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """True for a third of all ids; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1
