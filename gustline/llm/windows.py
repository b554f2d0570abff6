"""Order-preserving packing by dynamic programming over window cuts.

The token ids of a task's documents, in the order of its input, are one long line that is cut into windows of at most ``capacity`` ids; a
window is a sequence. A window is padded to ``capacity`` unless its length is a power of two. The cuts minimise, in tokens, the padding plus
a penalty for every cut inside a document (``SENTENCE_CUT`` behind a sentence, ``WORD_CUT`` elsewhere) plus ``WINDOW_COST`` a window, which
keeps windows long where padding alone would not decide. Cuts may lie at the end of a document, behind a sentence, or at a multiple of
``GRID`` ids in the line; the last kind bounds what text without sentences can cost.

With f(p) the least cost of the line up to cut p, a padded window gives f(p) = min f(q) + q + capacity - p over the cuts q at most ``capacity``
before p: a sliding minimum, kept in a monotone queue, so each cut enters and leaves it once. Windows of a power of two
have one possible start each and are looked up beforehand for all cuts at once. Equal costs take the longer padded window.

A line is closed at the first document end behind ``LINE_IDS`` ids, so a task holds one line (or one document, if that is longer). Nothing is shuffled; the
sequence number is made of the task's partition and a counter, and a repeated task gives the same rows.

Words are merged once a slice of text each (``WordVocabulary``); what depends on more than single code points is left to the tokenizers library.

Defined results: null text counts as empty and gives one piece (the end token); null ids are packed; repeated rows are packed each; very long texts
are cut into as many windows as they need; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import sys
import unicodedata
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .bpe import LETTER, NUMBER, OTHER, SPACE, Vocabulary, _byte_letters, distinct_words
from .common import WORD_SLICE_BYTES, ragged, text_slices

CAPACITY = 4096
END_TOKEN = 2
LINE_IDS = 1 << 20
GRID = 256
SENTENCE_CUT, WORD_CUT, WINDOW_COST = 2, 16, 16
WORD_END = "</w>"
RARE = 4  # beside the kinds of bpe
SIMPLE = 0x300  # below: no combining marks


class WordVocabulary(Vocabulary):
    """Lower-case words that end in a part of their own kind.

    What becomes of a code point alone (its lower case, letter, digit, white space or other) is asked of the library once a worker, for the code
    points below ``SIMPLE`` that no neighbour can change. Words of these are merged in rank arrays. A run between white space with any
    other code point, an apostrophe or the beginning of a special token goes through the library.
    """

    def __init__(self, path: str):
        super().__init__(path)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        letters = _byte_letters()
        self.last_id = np.array([vocab[x + WORD_END] for x in sorted(letters, key=letters.get)], np.int32)
        self.ends = np.zeros(len(self.token_len), bool)
        for token, i in vocab.items():
            word = token.removesuffix(WORD_END)
            self.ends[i] = word != token and word.rstrip("\"')]}").endswith((".", "!", "?"))
        self.lower = np.arange(sys.maxunicode + 1, dtype=np.uint32)
        self.kind = np.full(sys.maxunicode + 1, RARE, np.uint8)
        normal, split = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        for i in range(SIMPLE):
            low = normal(chr(i))
            if len(low) == 1 and not unicodedata.combining(chr(i)) and chr(i) != "'":
                self.lower[i] = ord(low)
                parts = (len(split(low)), len(split("a" + low)), len(split(low + low)))
                self.kind[i] = {(0, 1, 0): SPACE, (1, 1, 1): LETTER, (1, 2, 1): OTHER, (1, 2, 2): NUMBER}[parts]

    def first_parts(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts, ranks = super().first_parts(words)
        parts[:, -1] = self.last_id[words[:, -1]]
        if ranks.shape[1]:
            ranks[:, -1] = self.rank(parts[:, -2], parts[:, -1])
        return parts, ranks

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        doc_at = offsets
        if len(c) != len(data):
            doc_at = np.searchsorted(np.concatenate(([0], np.cumsum(_width(c)))), offsets)
        kind = self.kind[c]
        kind[1:][(c[1:] == ord("|")) & (c[:-1] == ord("<"))] = RARE
        edge = np.zeros(len(c) + 1, bool)
        edge[doc_at] = True
        solid = kind != SPACE
        begin = solid.copy()
        begin[1:] &= ~solid[:-1] | edge[1:-1]
        runs = np.flatnonzero(begin)
        if not len(runs):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        rare_run = np.add.reduceat((kind == RARE).astype(np.int64), runs) > 0
        rare = np.repeat(rare_run, np.diff(np.append(runs, len(c))))
        rare = np.concatenate((np.zeros(runs[0], bool), rare)) & solid
        start = begin.copy()
        start[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        start &= solid & (begin | ~rare)
        stop = solid.copy()
        stop[:-1] &= start[1:] | ~solid[1:] | edge[1:-1]
        first, last = np.flatnonzero(start), np.flatnonzero(stop)
        shown = np.where(rare, c, self.lower[c])
        at = np.concatenate(([0], np.cumsum(_width(shown))))
        raw = np.frombuffer(shown.tobytes().decode("utf-32-le").encode(), np.uint8)
        starts, lengths = at[first], at[last + 1] - at[first]
        one, which = distinct_words(raw, starts, lengths)
        odd = rare[first[one]]
        flat, count = self.encode_words(None, (raw, starts[one[~odd]], lengths[one[~odd]]))
        begins, counts = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
        begins[~odd], counts[~odd] = np.cumsum(count) - count, count
        if odd.any():
            runs = [raw[s : s + n].tobytes().decode() for s, n in zip(starts[one[odd]].tolist(), lengths[one[odd]].tolist(), strict=True)]
            made = [e.ids for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)]
            n = np.fromiter(map(len, made), np.int64, len(made))
            begins[odd], counts[odd] = len(flat) + np.cumsum(n) - n, n
            flat = np.concatenate((flat, np.fromiter(itertools.chain.from_iterable(made), np.int32, int(n.sum()))))
        n = counts[which]
        ids = flat[ragged(begins[which], n)]
        return ids, np.concatenate(([0], np.cumsum(n)))[np.searchsorted(first, doc_at)]


def _width(c: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of code points."""
    return 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> WordVocabulary:
    """Loaded once a Python worker; the file must be there on every executor."""
    return WordVocabulary(path)


def cut_places(doc_ends: np.ndarray, sentence_ends: np.ndarray, grid: int = GRID) -> tuple[np.ndarray, np.ndarray]:
    """Places where a line may be cut, from 0 to its end, and the penalty of a cut there."""
    total = int(doc_ends[-1])
    places = np.unique(np.concatenate(([0], doc_ends, sentence_ends, np.arange(grid, total, grid))))
    penalty = np.full(len(places), WORD_CUT)
    penalty[np.searchsorted(places, sentence_ends)] = SENTENCE_CUT
    penalty[np.searchsorted(places, doc_ends)] = 0
    penalty[0] = 0
    return places, penalty


def whole_windows(places: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place the places a power of two before it: offsets into a list of their indices."""
    into, starts = [], []
    size = 1
    while size <= capacity:
        at = np.searchsorted(places, places - size)
        hit = np.flatnonzero(places[at] == places - size)
        into.append(hit)
        starts.append(at[hit])
        size *= 2
    into, starts = np.concatenate(into), np.concatenate(starts)
    order = np.lexsort((starts, into))
    return np.concatenate(([0], np.cumsum(np.bincount(into, minlength=len(places))))), starts[order]


def best_cuts(places: np.ndarray, penalty: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The places of the cheapest cuts, from 0 to the end of the line."""
    first, starts = (x.tolist() for x in whole_windows(places, capacity))
    place, cost = places.tolist(), (penalty + WINDOW_COST).tolist()
    least, back = [0] * len(place), [0] * len(place)
    queue = deque([(0, 0, 0)])  # f(q) + q, place, index: values and places rise
    for j in range(1, len(place)):
        p = place[j]
        while queue[0][1] < p - capacity:
            queue.popleft()
        value, _, start = queue[0]
        value += capacity - p
        for i in starts[first[j] : first[j + 1]]:
            if least[i] < value:
                value, start = least[i], i
        value += cost[j]
        least[j], back[j] = value, start
        value += p
        while queue and queue[-1][0] > value:
            queue.pop()
        queue.append((value, p, j))
    cuts = [len(place) - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return places[cuts[::-1]]


def padding(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Padding of sequences of these lengths."""
    return np.where(lengths & (lengths - 1), capacity - lengths, 0)


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_token: int = END_TOKEN, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` of every piece and, if asked for, its ``ids``; ``capacity`` is at least ``GRID``."""
    if capacity < GRID:
        raise ValueError(f"capacity must be at least {GRID}")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def packed(line, number):
        keys, parts, ends, sizes = zip(*line, strict=True)
        ids, size = np.concatenate(parts), np.concatenate(sizes)
        doc_ends = np.cumsum(size)
        cuts = best_cuts(*cut_places(doc_ends, np.flatnonzero(np.concatenate(ends)) + 1), capacity)
        edges = np.union1d(cuts, doc_ends - size)
        start, stop = edges[:-1], edges[1:]
        doc = np.searchsorted(doc_ends, start, side="right")
        window = np.searchsorted(cuts, start, side="right") - 1
        raw = ids.astype("<u4").tobytes()
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
        out = [pa.concat_arrays(keys).take(pa.array(doc)), pa.array(start - (doc_ends - size)[doc]), pa.array(stop - start), pa.array(crc, pa.int64()),
               pa.array(size[doc]), pa.array(number + window), pa.array(start - cuts[window])]
        if with_ids:
            out.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids)))
        return pa.RecordBatch.from_arrays(out, names), len(cuts) - 1

    def run(batches):
        v = vocabulary(path)
        number = TaskContext.get().partitionId() << 40
        line, held = [], 0
        for rows, data, offsets in text_slices(batches, limit=WORD_SLICE_BYTES):
            ids, at = v.encode(data, offsets)
            ends = np.insert(v.ends[ids], at[1:], False)  # the end of a document is a place of its own
            ids = np.insert(ids, at[1:], end_token).astype(np.int32)
            line.append((rows.column("doc_id"), ids, ends, np.diff(at) + 1))
            held += len(ids)
            if held >= LINE_IDS:
                batch, n = packed(line, number)
                line, held, number = [], 0, number + n
                yield batch
        if line:
            yield packed(line, number)[0]
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
