"""Conversation repair, fill-in-middle forms and window packing against brute force, the tokenizers library and round trips."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from gustline.llm import infill, queries, repair, windows
from gustline.llm.common import text_bytes

SCHEMA = "doc_id long, text string, n int, form string, ids string, h1 int"  # with names the operators use inside
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "héllo wörld, it's"), (5, "Long text. " * 30_000), (6, "a b c"), (6, "a b c"), (7, "日本語 🙂 text <"), (8, "x <S> y"), (None, "no id here at all")]


def table(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x", "y", 2) for i, t in texts], SCHEMA)


# conversation repair

LETTERS = st.sampled_from(["system", "user", "assistant", "tool", ""])
ROWS = st.lists(st.tuples(LETTERS, st.sampled_from([0, 0, 0, 1, 2, 3])), max_size=14)


def all_edits(rows, last=None):
    """Least (cost, letters); every way by all its role letters, or by the ``last`` one where rows are many."""
    best = {"": (0, "")}  # by the role letters so far
    good = re.compile(r"(s?(ua)*u?)?" if not last else r"(s?|s?u|u?a|au)?")

    def put(new, said, cost, letters):
        if not good.fullmatch(said):
            return
        said = said[-last:] if last and said[-1:] in "ua" else said
        if (said not in new or (cost, letters) < new[said]):
            new[said] = (cost, letters)

    def with_inserts(ways):
        for _ in range(3):
            for said, (cost, letters) in list(ways.items()):
                for c in "ua":
                    put(ways, said + c, cost + 5, letters + "I")
        return ways
    best = with_inserts(best)
    for role, fault in rows:
        new = {}
        for said, (cost, letters) in best.items():
            put(new, said, cost + 2, letters + "D")
            if fault not in (1, 2):
                more = 5 if fault == 3 else 0
                if role[:1]:
                    put(new, said + role[0], cost + more, letters + "K")
                for c in "ua":
                    put(new, said + c, cost + more + 1, letters + "R")
        least = min(c for c, _ in new.values())
        best = with_inserts({s: w for s, w in new.items() if w[0] <= least + 30})
    return min(w for s, w in best.items() if s == "" or s[-1] == "a")


def decided(rows):
    """The operator's letters, taken as they settle."""
    ways, out = repair.Survivors(), ""
    for role, fault in rows:
        ways.row(role[:1], fault)
        out += ways.settled()
    cost, rest = ways.rest()
    return cost, out + rest


@settings(max_examples=400, deadline=None)
@given(ROWS)
def test_edits_are_the_cheapest_and_first(rows):
    assert decided(rows) == all_edits(rows)


def test_undecided_part_stays_short():
    rng = random.Random(5)
    ways, most = repair.Survivors(), 0
    for i in range(20_000):
        ways.row("ua"[i % 2] if rng.random() < 0.9 else "s", 0 if rng.random() < 0.9 else rng.choice((1, 2, 3)))
        ways.settled()
        most = max(most, *(n.depth - ways.root.depth for _, n in ways.ways.values()))
    assert most < 60


def test_held_counts_match_the_tree():
    rng = random.Random(6)
    ways = repair.Survivors()
    for _ in range(500):
        ways.row(rng.choice("suat"), rng.choice((0, 0, 1, 3)))
        ways.settled()
        held, seen = {}, set()
        for _, n in ways.ways.values():
            held[id(n)] = held.get(id(n), 0) + 1
            while n is not ways.root and id(n) not in seen:
                seen.add(id(n))
                held[id(n.parent)] = held.get(id(n.parent), 0) + 1
                n = n.parent
        nodes = {id(n): n for _, w in ways.ways.values() for n in [ways.root, *ways._path(w)]}
        assert {i: n.held for i, n in nodes.items()} == held


def brute_conversations(rows, last=None):
    """The contract, row by row; rows of one turn by role and text."""
    convs = {}
    for conv, turn, role, text in rows:
        found = convs.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(key.encode()) % 20
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        found += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    out = {}
    for conv, found in convs.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, kinds = set(), []
        for _, role, text in found:
            said = text.strip(" \t\n\x0b\x0c\r")
            kinds.append(1 if not said else 2 if (role, text) in seen else 0 if said[-1] in ".!?" else 3)
            seen.add((role, text))
        cost, audit = all_edits([(r, k) for (_, r, _), k in zip(found, kinds)], last)
        turns = [t for t, _, _ in found if t is not None]
        kept, state, left = [], "", iter(found)
        for letter in audit:
            _, role, text = next(left) if letter != "I" else (None, None, "")
            if letter == "D":
                continue
            if letter != "K":
                role = "assistant" if state == "u" else "user"
            state = role[0]
            kept.append(f"{role}:{text}")
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(found)]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in (1, 2, 3)),
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_repair_equals_brute_force(spark):
    rng = random.Random(7)
    rows = [(None, 0, "user", "x."), (None, None, "assistant", None), (900, 1, None, None), (901, 3, "", "Hm"), (902, 5, "user", "y" * 100_000 + "."), (903, None, "user", " \t")]
    for conv in range(160):
        for turn in range(rng.randint(0, 9)):
            rows.append((conv, turn * rng.choice((1, 1, 2)), rng.choice(("user", "assistant", "user", "assistant", "system", "tool")), rng.choice(("Yes.", "No!", "Why?  \n", "And so", "", "Well é.", "  "))))
    rows += [r for r in rows if rng.random() < 0.1]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, fault string, step string")
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.damage_repairs(df.select("conv_id", "turn", "role", "text")).collect()}
    assert got == brute_conversations(rows)
    again = repair.edits(df).filter("edit <> 'insert'").groupBy("conv_id").count().collect()
    assert sum(r["count"] for r in again) == len(rows)
    turns = {}
    for r in sorted(repair.repaired(df).collect(), key=lambda r: r["step"]):
        turns[r["conv_id"]] = turns.get(r["conv_id"], "") + r["role"][:1]
    assert all(re.fullmatch(r"s?(ua)+", t) for t in turns.values())


def test_repair_of_one_long_conversation_over_many_batches(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"Turn {i}." if i % 7 else "cut") for i in range(6000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.damage_repairs(df).collect()}
    assert got == brute_conversations(rows, last=1)


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.damage_repairs(df).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "a.")], df.schema)
    assert [tuple(r) for r in repair.damage_repairs(df).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# fill in the middle

def brute_infill(doc_id, text):
    text, shown = text or "", "" if doc_id is None else str(doc_id)
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{shown}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill_equals_brute_force_and_comes_back(spark):
    rng = random.Random(8)
    texts = ODD + [(100 + i, "".join(rng.choice("aZ é<PSM>日.\n\x00 ") for _ in range(rng.randint(0, 25)))) for i in range(800)]
    made = infill.restore(infill.transform(table(spark, texts))).collect()
    key = lambda r: (str(r[0]), r[1])
    got = sorted(((r["doc_id"], r["restored"], tuple(r)[1:6]) for r in made), key=key)
    want = sorted(((i, t or "", brute_infill(i, t)) for i, t in texts), key=key)
    assert got == want
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}


def test_batches_of_one_form_come_back():
    for form, output in (("psm", "<P><S><M>"), ("spm", "<S><P><M>"), ("plain", "")):
        assert infill.restored(pa.array([output] * 300), pa.array([form] * 300)).to_pylist() == [""] * 300


def test_infill_of_nothing(spark):
    assert infill.restore(infill.transform(table(spark, []))).collect() == []


def test_restore_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "<P>a<S>c<M>b", "psm", 9), (2, "<S>c<P>a<M>b", "spm", 8), (3, "<P>", "plain", 7), (4, None, "plain", 6)], "doc_id long, output string, form string, extra int")
    assert sorted((r["doc_id"], r["extra"], r["restored"]) for r in infill.restore(df).collect()) == [(1, 9, "abc"), (2, 8, "abc"), (3, 7, "<P>"), (4, 6, None)]


# window packing

@pytest.fixture(scope="module")
def word_path():
    return queries.tokenizer_path(queries.WORD_TOKENIZER)


@pytest.fixture(scope="module")
def word_tokenizer(word_path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_path)


def same_ids(texts, path, tokenizer):
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    ids, at = windows.vocabulary(path).encode(data, offsets)
    got = [ids[a:b].tolist() for a, b in itertools.pairwise(at)]
    return got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_words_equal_the_tokenizer_on_every_code_point(word_path, word_tokenizer):
    texts = ["".join(chr(c) for c in range(a, a + 64) if not 0xD800 <= c < 0xE000) for a in range(0, 0x110000, 64)]
    assert same_ids(texts, word_path, word_tokenizer)


def test_words_equal_the_tokenizer(word_path, word_tokenizer):
    rng = random.Random(9)
    alphabet = [chr(c) for c in [*range(0x250), *range(0x300, 0x340), 0x130, 0x3A3, 0x1100, 0x1161, 0x2028, 0x3000, 0x1F642]] + ["'s", "'LL", "<|endoftext|>", "<|", " ", " ", "\n", "word", "1"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(4000)] + ["", "y" * 5000]
    assert same_ids(texts, word_path, word_tokenizer)


def brute_cost(places, penalty, capacity):
    f = [0] + [10**12] * (len(places) - 1)
    for j in range(1, len(places)):
        for i in range(j):
            n = int(places[j] - places[i])
            if n <= capacity:
                f[j] = min(f[j], f[i] + (0 if n & (n - 1) == 0 else capacity - n) + int(penalty[j]) + windows.WINDOW_COST)
    return f[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 90), min_size=1, max_size=15), st.integers(0, 2**30), st.sampled_from([8, 16, 64]))
def test_cuts_are_the_cheapest(sizes, seed, grid):
    ends = np.cumsum(sizes)
    rng = random.Random(seed)
    sentences = np.array(sorted(rng.sample(range(1, ends[-1] + 1), min(ends[-1], rng.randint(0, 12)))), np.int64)
    places, penalty = windows.cut_places(ends, sentences, grid)
    cuts = windows.best_cuts(places, penalty, 64)
    n = np.diff(cuts)
    assert cuts[0] == 0 and cuts[-1] == ends[-1] and (n > 0).all() and (n <= 64).all()
    cost = windows.padding(n, 64).sum() + penalty[np.searchsorted(places, cuts[1:])].sum() + windows.WINDOW_COST * len(n)
    assert cost == brute_cost(places, penalty, 64)


def test_windows_hold_every_id_once_in_order(spark, word_path, word_tokenizer):
    texts = [(i, t) for i, t in ODD if i != 6] + [(6, "a b c")] + [(100 + i, f"Some words here {i}. " * (i % 50)) for i in range(300)]
    made = windows.pack(table(spark, texts).coalesce(2), word_path, with_ids=True).collect()
    again = windows.pack(table(spark, texts).coalesce(2), word_path).collect()
    assert sorted(repr(tuple(r)) for r in again) == sorted(repr(tuple(r)[:-1]) for r in made)
    docs, sequences = {}, {}
    for r in made:
        docs.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    for doc_id, text in texts:
        pieces = sorted(docs[doc_id], key=lambda r: r["start"])
        ids = [x for p in pieces for x in p["ids"]]
        assert ids == [*word_tokenizer.encode(text or "", add_special_tokens=False).ids, windows.END_TOKEN]
        assert [p["start"] for p in pieces] == np.cumsum([0] + [p["length"] for p in pieces])[:-1].tolist()
        assert {p["doc_tokens"] for p in pieces} == {len(ids)}
    lengths = []
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [p["offset"] for p in pieces] == np.cumsum([0] + [p["length"] for p in pieces])[:-1].tolist()
        lengths.append(sum(p["length"] for p in pieces))
    assert max(lengths) <= windows.CAPACITY
    assert windows.padding(np.array(lengths)).sum() < 0.01 * sum(lengths)


def test_repeated_rows_and_the_empty_table(spark, word_path):
    assert windows.pack(table(spark, []), word_path).collect() == []
    made = windows.pack(table(spark, [(1, "a b"), (1, "a b"), (None, None)]), word_path).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in made) == [(0, 1), (1, 3), (1, 3)]


def test_text_without_sentences_is_packed_tight(word_path):
    ends = np.array([100_003])
    cuts = windows.best_cuts(*windows.cut_places(ends, np.zeros(0, np.int64)))
    assert windows.padding(np.diff(cuts)).sum() < windows.GRID and len(cuts) - 1 <= 30
