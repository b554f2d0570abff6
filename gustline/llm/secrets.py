"""Secret scan: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Two Markov chains over characters (two characters of context) are trained from labelled samples: random strings, and the
ordinary words and identifiers of texts. A string is taken for a secret when the log-likelihood ratio of the two
chains, in bits, reaches a threshold. What the fixed patterns find stays in any case; the chains add spans that touch none of those.

Defined results: null text counts as empty and has no spans; spans are in code points, end exclusive, sorted by start, then kind;
matches of one kind never overlap; repeated rows are scanned each; an empty table gives an empty table; other columns are ignored.
Whole texts are always read. The bound on the training sample is ``SAMPLE_DOCS`` expected documents.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SAMPLE_DOCS = 4000
MIN_LENGTH = 16
THRESHOLD_BITS = 16.0

# The base patterns with the length each match must have, in the order kinds are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
WORD = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_LENGTH)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
SIZE = len(ALPHABET) + 1  # and one place for any other character, and for the start
CODE = np.full(128, SIZE - 1, np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(SIZE - 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, sorted."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def triples(word: str) -> np.ndarray:
    """Each character with the two before it, as one number."""
    raw = np.frombuffer(word.encode("ascii", "replace"), np.uint8)
    c = np.concatenate(([SIZE - 1, SIZE - 1], CODE[raw]))
    return (c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:]


@dataclass
class Chains:
    """Log-likelihood ratio of each triple, in bits."""

    ratio: np.ndarray
    threshold: float = THRESHOLD_BITS

    @staticmethod
    def of(random_counts: np.ndarray, plain_counts: np.ndarray, threshold: float = THRESHOLD_BITS) -> Chains:
        return Chains(_log_chain(random_counts) - _log_chain(plain_counts), threshold)

    def score(self, word: str) -> float:
        return float(self.ratio[triples(word)].sum())

    def spans(self, text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        out, taken = [], sorted(taken)
        starts, reach = [a for a, _, _ in taken], list(itertools.accumulate((b for _, _, b in taken), max))
        for m in WORD.finditer(text):
            before = bisect.bisect_left(starts, m.end())
            if before and reach[before - 1] > m.start():
                continue
            if self.score(m[0]) >= self.threshold:
                out.append((m.start(), 3, m.end()))
        return out


def _log_chain(counts: np.ndarray) -> np.ndarray:
    """Second-order chain, smoothed by the first-order one, that by the characters alone, that by equal chances."""
    c3 = counts.reshape(SIZE, SIZE, SIZE).astype(float)
    c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
    p1 = (c1 + 1) / (c1.sum() + SIZE)
    p2 = (c2 + 8 * p1) / (c2.sum(axis=1, keepdims=True) + 8)
    p3 = (c3 + 8 * p2[None]) / (c3.sum(axis=2, keepdims=True) + 8)
    return np.log2(p3).ravel()


def random_strings(n: int = 3000, seed: int = 5) -> list[str]:
    """Labelled samples of random strings: hexadecimal, base 32, base 62 and base 64, 16 to 48 characters."""
    r = random.Random(seed)
    kinds = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ALPHABET[:62], ALPHABET[:64])
    return ["".join(r.choices(kinds[i % 4], k=r.randint(16, 48))) for i in range(n)]


def train(labelled: DataFrame, threshold: float = THRESHOLD_BITS) -> Chains:
    """``(word, is_random)`` to chains: triples are counted in Spark, at most 2 * SIZE**3 counts come back."""
    def count(batches):
        total = np.zeros((2, SIZE**3), np.int64)
        for b in batches:
            for word, label in zip(b.column("word").to_pylist(), b.column("is_random").to_pylist(), strict=True):
                if word:
                    np.add.at(total[int(bool(label))], triples(word), 1)
        label, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(at), pa.array(total[label, at])], ["label", "at", "n"])
    rows = labelled.select("word", "is_random").mapInArrow(count, "label long, at long, n long").groupBy("label", "at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, SIZE**3))
    counts[np.asarray(rows.column("label")), np.asarray(rows.column("at"))] = np.asarray(rows.column("n"))
    for word in random_strings():
        np.add.at(counts[1], triples(word), 1)
    return Chains.of(counts[1], counts[0], threshold)


def labelled_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``(word, is_random)`` of a bounded sample: what the fixed patterns find is random, other words are not."""
    n = df.count()
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(23)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = df.filter(F.col(text_col).isNotNull() & (draw < min(1.0, sample_docs / max(n, 1)))).select(F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            words, labels = [], []
            for text in b.column("text").to_pylist():
                at = 0
                for start, kind, end in [*base_spans(text), (len(text), -1, len(text))]:
                    plain = re.findall(r"[A-Za-z0-9+/_=-]{4,}", text[at:start])
                    words += plain
                    labels += [False] * len(plain)
                    if kind >= 0:
                        words.append(ASSIGN.match(text, start)[2] if kind == 0 else text[start:end])
                        labels.append(True)
                    at = max(at, end)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(labels, pa.bool_())], ["word", "is_random"])
    return rows.mapInArrow(run, "word string, is_random boolean")


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(df: DataFrame, chains: Chains, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, spans, n_base)``: spans as (kind, start, end), base spans counted by kind in ``n_base``."""
    shared = df.sparkSession.sparkContext.broadcast(chains)

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                base = base_spans(text or "")
                out.append([{"kind": KINDS[k], "start": s, "end": e, "base": k < 3} for s, k, e in sorted(base + shared.value.spans(text or "", base))])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, kind)], ["id", "spans"])
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def redact(df: DataFrame, chains: Chains, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``df`` with every span of ``text_col`` replaced by ``mask``; overlapping spans become one."""
    shared = df.sparkSession.sparkContext.broadcast(chains)
    at = df.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        base = base_spans(text)
        spans = sorted((s, e) for s, _, e in base + shared.value.spans(text, base))
        out, done = [], 0
        for s, e in spans:
            if s >= done:
                out += [text[done:s], mask]
            done = max(done, e)
        return "".join([*out, text[done:]]) if spans else text

    def run(batches):
        for b in batches:
            yield b.set_column(at, b.schema.field(at), pa.array([clean(t) for t in b.column(at).to_pylist()], b.schema.field(at).type))
    return df.mapInArrow(run, df.schema)


def scan_digests(df: DataFrame, chains: Chains) -> DataFrame:
    """Digest columns of the registered query from ``scan``."""
    def run(batches):
        for b in batches:
            ids, counts, shas, all_ = b.column("id"), [], [], []
            for spans in b.column("spans").to_pylist():
                text = lambda xs: ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in xs)
                base = [x for x in spans if x["base"]]
                counts.append([sum(x["kind"] == k for x in base) for k in KINDS[:3]])
                shas.append(hashlib.sha256(text(base).encode()).hexdigest())
                all_.append(text(spans))
            n = np.array(counts, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(n[:, i]) for i in range(3)], pa.array(shas, pa.string()), pa.array(all_, pa.string())],
                                             ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
    kind = df.schema["doc_id"].dataType.simpleString()
    return scan(df, chains).mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
