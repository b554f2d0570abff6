"""Byte-pair encoding and decoding with contiguous rank arrays.

A word's parts and the ranks of its adjacent pairs lie in two contiguous rows; the smallest rank is looked for by
scanning, its boundary is deleted and the two ranks beside it are refreshed, until no pair has a rank. Words
of one length form a matrix, so that one scan serves all distinct words of a slice of text at once: every row
that still merges loses exactly one boundary a step. Words over ``SHORT`` bytes use a heap over the same ranks, so
a very long word costs n log n instead of n squared.

Texts are cut into words by code point classes with array operations, distinct words are encoded once a slice, and
nothing is kept between slices. Defined results: null text counts as empty and gives no ids; repeated rows are
encoded alike; null ids are kept; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WORD_SLICE_BYTES, ragged, text_slices

SHORT = 64
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
NONE = np.int32(2**31 - 1)

# White space of the splitting pattern, and the endings that stay with an apostrophe.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ENDINGS_1, ENDINGS_2 = "stmd", ("re", "ve", "ll")


@functools.cache
def _classes() -> np.ndarray:
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    major = np.array([ord(unicodedata.category(chr(i))[0]) for i in range(sys.maxunicode + 1)], np.uint8)
    table[major == ord("L")] = LETTER
    table[major == ord("N")] = NUMBER
    table[WHITE] = SPACE
    return table


@functools.cache
def _split_classes() -> np.ndarray:
    """Classes of all code points as the tokenizers library splits texts; its Unicode tables may be newer than Python's."""
    from tokenizers import Regex, pre_tokenizers

    table = np.zeros(sys.maxunicode + 1, np.uint8)
    points = np.delete(np.arange(sys.maxunicode + 1, dtype=np.uint32), slice(0xD800, 0xE000))
    text = points.tobytes().decode("utf-32-le")
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
            table[points[a:b]] = kind
    return table


def _byte_letters() -> dict[str, int]:
    """Vocabulary files write a byte as a visible letter: itself, or the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merge ranks and token bytes of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        as_bytes = lambda s: bytes(letters[x] for x in s)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        n = max([*vocab.values(), *self.special.values()]) + 1
        tokens = [b""] * n
        for s, i in vocab.items():
            if s not in self.special:
                tokens[i] = as_bytes(s)
        for s, i in self.special.items():
            tokens[i] = s.encode()
        self.token_len = np.array([len(t) for t in tokens], np.int64)
        self.token_at = np.concatenate(([0], np.cumsum(self.token_len)))[:-1]
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte_id = np.array([vocab[x] for x in sorted(letters, key=letters.get)], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.keys = (left << 20) | right
        # open addressing: slot of a pair by a multiplicative hash
        self.bits = 18
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.bits, NONE, np.int32)
        for rank, (key, slot) in enumerate(zip(self.keys.tolist(), self._slot(self.keys).tolist(), strict=True)):
            while self.slot_key[slot] != -1:
                if self.slot_key[slot] == key:
                    break
                slot = (slot + 1) & ((1 << self.bits) - 1)
            else:
                self.slot_key[slot], self.slot_rank[slot] = key, rank
        pair = self.byte_id.astype(np.int64)
        self.byte_ranks = self.rank(np.repeat(pair, 256), np.tile(pair, 256)).reshape(256, 256)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 20) | right
        slot = self._slot(keys)
        found = self.slot_key[slot]
        out = np.where(found == keys, self.slot_rank[slot], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.slot_key[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.slot_rank[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def first_parts(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts of words of one length before any merge, and the ranks of their adjacent pairs."""
        return self.byte_id[words], self.byte_ranks[words[:, :-1], words[:, 1:]]

    def merge_short(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``words``: bytes of words of one length. Yields (rows, their final parts) as rows finish."""
        rows = np.arange(len(words))
        parts, ranks = self.first_parts(words)
        while True:
            if ranks.shape[1] == 0:
                yield rows, parts
                return
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(rows)), at]
            done = least == NONE
            if done.any():
                yield rows[done], parts[done]
                rows, parts, ranks, at, least = (x[~done] for x in (rows, parts, ranks, at, least))
                if not len(rows):
                    return
            n, width = ranks.shape
            i = np.arange(n)
            parts[i, at] = self.merged[least]
            keep = np.ones((n, width + 1), bool)
            keep[i, at + 1] = False
            parts = parts[keep].reshape(n, width)
            keep = np.ones((n, width), bool)
            keep[i, at] = False
            ranks = ranks[keep].reshape(n, width - 1)
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < width - 1)
            ranks[before, at[before] - 1] = self.rank(parts[before, at[before] - 1], parts[before, at[before]])
            ranks[after, at[after]] = self.rank(parts[after, at[after]], parts[after, at[after] + 1])

    def merge_long(self, word: bytes) -> np.ndarray:
        """The same merges for one long word, smallest rank first, leftmost first, from a heap."""
        parts, first = (x[0].tolist() for x in self.first_parts(np.frombuffer(word, np.uint8)[None, :]))
        after = [*range(1, len(parts)), -1]
        before = list(range(-1, len(parts) - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        ranks, merged = self._rank_of, self.merged
        alive = [True] * len(parts)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j] = int(merged[r]), False
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (k := ranks.get((parts[x] << 20) | parts[y])) is not None:
                    heapq.heappush(heap, (k, x, parts[x], parts[y]))
        return np.array([p for p, ok in zip(parts, alive, strict=True) if ok], np.int32)

    @functools.cached_property
    def _rank_of(self) -> dict[int, int]:
        out: dict[int, int] = {}
        for rank, key in enumerate(self.keys.tolist()):
            out.setdefault(key, rank)
        return out

    def encode_words(self, words: list[bytes] | None, packed=None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words given as (data, starts, lengths): flat ids and each word's count."""
        data, starts, lengths = packed
        counts = np.zeros(len(starts), np.int64)
        found = []
        for size in np.unique(lengths):
            rows = np.flatnonzero(lengths == size)
            if size > SHORT:
                for r in rows:
                    ids = self.merge_long(data[starts[r] : starts[r] + size].tobytes())
                    counts[r] = len(ids)
                    found.append((np.array([r]), ids[None, :]))
                continue
            for done, ids in self.merge_short(data[starts[rows][:, None] + np.arange(size)]):
                counts[rows[done]] = ids.shape[1]
                found.append((rows[done], ids))
        at = np.cumsum(counts) - counts
        flat = np.zeros(int(counts.sum()), np.int32)
        for rows, ids in found:
            flat[at[rows][:, None] + np.arange(ids.shape[1])] = ids
        return flat, counts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, and each text's offset in them."""
        starts, lengths, doc_words, fixed = self.words(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        first, which = distinct_words(data, starts, lengths)
        flat, counts = self.encode_words(None, (data, starts[first], lengths[first]))
        at = np.cumsum(counts) - counts
        n, begin = counts[which], at[which]
        if fixed is not None:
            flat = np.concatenate((flat, fixed[1]))
            begin[fixed[0]] = len(flat) - len(fixed[1]) + np.arange(len(fixed[1]))
            n[fixed[0]] = 1
        ids = flat[ragged(begin, n)]
        return ids, np.concatenate(([0], np.cumsum(n)))[doc_words]

    def words(self, data: np.ndarray, offsets: np.ndarray):
        """Byte starts and lengths of all words, each text's first word, and words with a fixed id."""
        text = data.tobytes().decode("utf-8", "replace")
        c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        width = None
        if len(c) != len(data):
            width = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
            byte_at = np.concatenate(([0], np.cumsum(width)))
            doc_at = np.searchsorted(byte_at, offsets)
        else:
            byte_at, doc_at = None, offsets
        n = len(c)
        edge = np.zeros(n + 3, bool)
        edge[doc_at] = True
        special = []
        for s, token in self.special.items():
            at = text.find(s)
            while at >= 0:
                if not edge[at + 1 : at + len(s)].any():
                    special.append((at, at + len(s), token))
                at = text.find(s, at + len(s))
        for a, b, _ in special:
            edge[[a, b]] = True
        k = _split_classes()[c]
        start = edge[:n].copy()
        if n:
            start[1:] |= k[1:] != k[:-1]
        # a run after white space takes one blank with it; other white space before a run stands alone
        j = np.flatnonzero((k[1:] != SPACE) & (k[:-1] == SPACE) & ~edge[1:n]) + 1
        start[j - 1] = True
        start[j[c[j - 1] == 0x20]] = False
        # endings after an apostrophe that begins a word
        tick = np.flatnonzero((c == 0x27) & start)
        tick = tick[(tick + 1 < n)]
        tick = tick[(k[tick + 1] == LETTER) & ~edge[tick + 1]]
        if len(tick):
            one = np.isin(c[tick + 1], [ord(x) for x in ENDINGS_1])
            second = np.where((tick + 2 < n) & ~edge[tick + 2], c[np.minimum(tick + 2, n - 1)], 0)
            two = np.zeros(len(tick), bool)
            for a, b in ENDINGS_2:
                two |= (c[tick + 1] == ord(a)) & (second == ord(b))
            start[tick[one | two] + 1] = False
            to = np.concatenate((tick[one] + 2, tick[two] + 3))
            start[to[to < n]] = True
        fixed = None
        for a, b, _ in special:
            start[a + 1 : b] = False
        begins = np.flatnonzero(start)
        if special:
            special.sort()
            fixed = (np.searchsorted(begins, [a for a, _, _ in special]), np.array([t for _, _, t in special], np.int32))
        doc_words = np.searchsorted(begins, doc_at)
        ends = np.append(begins[1:], n)
        if byte_at is not None:
            begins, ends = byte_at[begins], byte_at[ends]
        return begins, ends - begins, doc_words, fixed

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts and each text's offset in them."""
        n = self.token_len[ids]
        data = self.token_bytes[ragged(self.token_at[ids], n)]
        return data, np.concatenate(([0], np.cumsum(n)))[offsets]


def distinct_words(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of one occurrence of each distinct word, and for each word which of these it is."""
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    eights = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(data) + 9, 8), (1, 1))
    short = np.flatnonzero(lengths <= 16)
    which = np.zeros(len(starts), np.int64)
    s, n = starts[short], lengths[short]
    part = lambda at, left: eights[at].view(np.uint64).ravel() & _MASKS[np.clip(left, 0, 8)]
    low, high = part(s, n), part(s + np.minimum(n, 8), n - 8)
    mixed = (low * np.uint64(0x9E3779B97F4A7C15)) ^ (low >> np.uint64(29)) ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed ^= n.astype(np.uint64) << np.uint64(57)
    _, first, which_short = np.unique(mixed, return_index=True, return_inverse=True)
    same = (low[first[which_short]] == low) & (high[first[which_short]] == high) & (n[first[which_short]] == n)
    if not same.all():  # two words share a mixed value: tell them apart by their bytes
        _, first, which_short = np.unique(np.stack((low, high, n.astype(np.uint64)), 1), axis=0, return_index=True, return_inverse=True)
    which[short] = which_short
    first = short[first]
    more: dict[bytes, int] = {}
    at = []
    raw = data.tobytes()
    for i in np.flatnonzero(lengths > 16).tolist():
        word = raw[starts[i] : starts[i] + lengths[i]]
        if (k := more.get(word)) is None:
            k = more[word] = len(first) + len(more)
            at.append(i)
        which[i] = k
    return np.concatenate((first, np.array(at, np.int64))), which


_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Loaded once a Python worker; the file must be there on every executor."""
    return Vocabulary(path)


def encode_texts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids)``: the token ids of every text."""
    def run(batches):
        v = vocabulary(path)
        for rows, data, offsets in text_slices(batches, limit=WORD_SLICE_BYTES):
            ids, at = v.encode(data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.ListArray.from_arrays(at.astype(np.int32), ids)], ["id", "ids"])
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")


def decode_texts(df: DataFrame, path: str) -> DataFrame:
    """``(id, text)`` of ``(id, ids)``; bytes that are not UTF-8 become replacement characters."""
    def run(batches):
        v = vocabulary(path)
        for b in batches:
            ids = b.column("ids")
            flat = np.asarray(ids.flatten(), dtype=np.int64)
            n = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(ids), 0), dtype=np.int64)
            data, at = v.decode(flat, np.concatenate(([0], np.cumsum(n))))
            texts = [data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace") for i in range(len(n))]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string())], ["id", "text"])
    return df.select("id", "ids").mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, text string")


def encoding_digests(df: DataFrame, path: str) -> DataFrame:
    """Digests of the ids and of the text decoded from them, in one pass over the texts."""
    def run(batches):
        v = vocabulary(path)
        for rows, data, offsets in text_slices(batches, limit=WORD_SLICE_BYTES):
            ids, at = v.encode(data, offsets)
            back, back_at = v.decode(ids, at)
            raw, back = ids.astype("<u4").tobytes(), back.tobytes()
            id_sha = [hashlib.sha256(raw[4 * at[i] : 4 * at[i + 1]]).hexdigest() for i in range(len(at) - 1)]
            texts = (back[back_at[i] : back_at[i + 1]].decode("utf-8", "replace").encode() for i in range(len(at) - 1))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(np.diff(at)), pa.array(id_sha, pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
