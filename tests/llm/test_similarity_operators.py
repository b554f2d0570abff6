"""Repeats, near-duplicates, fuzzy lines, top-k and fingerprints against brute force on small cases."""

import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gustline.llm import common, fingerprints, lines, repeats, simhash, topk

SCHEMA = "doc_id long, text string, key string, place int, part int, fp string, seq int, at int, a int, b int"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "k", 1, 2, "f", 3, 4, 5, 6) for i, t in texts], SCHEMA)


def prose(n, seed=0, vocabulary=60):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7))) for _ in range(vocabulary)]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Exact and near copies, shared passages and lines, long and empty texts, nulls and repeated rows."""
    rng = random.Random(7)
    base = [prose(rng.randint(30, 200), i, 300) for i in range(25)]
    passage = prose(20, 99)
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100 + i, base[i % 3]) for i in range(12)]
    for i in range(15):
        w = base[5].split()
        w[rng.randrange(len(w))] = "changed"
        out.append((200 + i, " ".join(w)))
    out += [(300 + i, base[i] [: 40 * i] + passage + "\n" + passage[::-1]) for i in range(12)]
    out += [(400, None), (401, ""), (402, " \n "), (403, "one"), (404, "one two"), (405, "ß" * 30 + "é"), (406, "ß" * 30 + "é"), (407, "a" * 400), (408, "a" * 55), (408, "a" * 55), (409, "ab" * 200)]
    out += [(500 + i, f"Common line of text number one here\nand line {i}\nCommon line, of TEXT number one here") for i in range(10)]
    return out


# repeated windows

def brute_repeats(texts, window=repeats.WINDOW):
    first = {}
    for i, t in texts:
        b = (t or "").encode()
        if i is not None:
            for k in range(len(b) - window + 1):
                w = b[k : k + window]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in texts:
        b = (t or "").encode()
        cut = bytearray(len(b))
        if i is not None:
            for k in range(len(b) - window + 1):
                if first[b[k : k + window]] < i:
                    cut[k : k + window] = b"\1" * window
        spans = sum(1 for k in range(len(b)) if cut[k] and (k == 0 or not cut[k - 1]))
        out.append((i, len(b), sum(cut), spans, bytes(x for x, c in zip(b, cut, strict=True) if not c)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("part_bytes", [repeats.PART_BYTES, 3000])
def test_repeats_equal_brute_force(spark, corpus, monkeypatch, part_bytes):
    monkeypatch.setattr(repeats, "PART_BYTES", part_bytes)
    monkeypatch.setattr(repeats, "ENTRIES", 100)
    monkeypatch.setattr(repeats, "ROW_BYTES", 2000)
    texts = [*corpus, (None, corpus[0][1]), (None, None)]
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.removed_bytes(table(spark, texts)).collect()), key=repr)
    assert got == brute_repeats(texts)
    digest = {(r["doc_id"], r["kept_sha256"]) for r in repeats.removal_digests(table(spark, texts)).collect()}
    assert digest == {(x[0], hashlib.sha256(x[4]).hexdigest()) for x in got}


def test_repeats_of_an_empty_table(spark):
    assert repeats.removal_digests(table(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=130), min_size=1, max_size=6))
def test_anchors_cover_every_window_once(texts):
    data, offsets = common.text_bytes(pa.array(texts))
    p, h, s0, s1 = repeats.anchors(data, offsets)
    covered = [s for a, b in zip(s0.tolist(), s1.tolist(), strict=True) for s in range(a, b + 1)]
    want = [s for i in range(len(texts)) for s in range(offsets[i], offsets[i + 1] - repeats.WINDOW + 1)]
    assert covered == want
    assert ((p - s0 <= repeats.BEFORE) & (p >= s1)).all()
    # equal windows have equal anchors at equal places
    seen = {}
    for k, (a, b) in enumerate(zip(s0.tolist(), s1.tolist(), strict=True)):
        for s in range(a, b + 1):
            w = data[s : s + repeats.WINDOW].tobytes()
            assert seen.setdefault(w, (int(p[k]) - s, int(h[k]))) == (int(p[k]) - s, int(h[k]))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3), st.integers(0, 2), st.integers(0, 3)), max_size=40))
def test_radix_groups(rows):
    group = np.array([r[0] for r in rows], np.int64)
    digits = np.array([r[1:3] for r in rows], np.uint64).reshape(-1, 2)
    member = np.array([r[3] for r in rows], np.int64)
    left, ids = repeats.radix_groups(lambda j, x: digits[x, j] if j < 2 else None, group, member)
    want = {}
    for k, r in enumerate(rows):
        want.setdefault(r[:3], []).append(k)
    want = sorted(sorted(v) for v in want.values() if len({rows[k][3] for k in v}) > 1)
    got = {}
    for k, g in zip(left.tolist(), ids.tolist(), strict=True):
        got.setdefault(g, []).append(k)
    assert sorted(sorted(v) for v in got.values()) == want


# SimHash

def fingerprint(text, words=3):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h))


def brute_components(marks, radius):
    n, parent = len(marks), list(range(len(marks)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(n):
        for j in range(i):
            if (marks[i][1] ^ marks[j][1]).bit_count() <= radius or marks[i][0] == marks[j][0]:
                parent[root(i)] = root(j)
    least = {}
    for i in range(n):
        least[root(i)] = min(least.get(root(i), marks[i][0]), marks[i][0])
    return [least[root(i)] for i in range(n)]


def test_near_duplicates_equal_brute_force(spark, corpus):
    got = {(r["doc_id"], r["fp"] % 2**64): r["component_id"] for r in simhash.near_duplicates(table(spark, corpus)).collect()}
    marks = [(i, fingerprint(t)) for i, t in corpus]
    assert got == dict(zip(marks, brute_components(marks, 2), strict=True))


def test_null_ids_join_their_group(spark):
    rows = simhash.near_duplicates(table(spark, [(3, "a b c d"), (None, "a b c d"), (None, "x y z w v")])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in rows) == [("3", "3"), ("None", "3"), ("None", "None")]
    assert simhash.near_duplicates(table(spark, [])).count() == 0
    kept = simhash.one_of_each(table(spark, [(3, "a b c d"), (3, "a b c d"), (4, "A b C d"), (None, "a b c d"), (5, None), (6, "")])).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["3", "5", "None"]


def test_rows_of_one_id_with_other_texts_stay(spark):
    texts = [(1, "a b c d e"), (1, "wholly other text is here"), (2, "a b c d e"), (2, "and a third one of this"), (2, "and a third one of this"), (None, "a b c d e")]
    kept = simhash.one_of_each(table(spark, texts)).select("doc_id", "text").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, "a b c d e"), (1, "a b c d e"), (1, "wholly other text is here"), (2, "and a third one of this")]
    assert simhash.one_of_each(table(spark, [])).count() == 0


@pytest.mark.parametrize("kind", ["random", "dense"])
def test_links_over_many_shards(spark, monkeypatch, kind):
    monkeypatch.setattr(simhash, "BRUTE", 400)
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    flip = lambda x, k: x ^ sum(1 << b for b in rng.sample(range(64), k))
    points = [rng.getrandbits(64) for _ in range(300)] if kind == "random" else [flip(centre, rng.randint(0, 5)) for _ in range(200)]
    points += [flip(p, rng.randint(1, 3)) for p in points[:150]]
    points = list(dict.fromkeys(points))
    signed = [p - 2**64 if p >= 2**63 else p for p in points]
    df = spark.createDataFrame([(p, 10 + i) for i, p in enumerate(signed)], "fp long, id long")
    edges = simhash.links(df, 2, shard_points=40)
    assert edges.count() < 40 * len(points)
    roots = {r["id"]: r["root"] for r in common.components(edges).collect()}
    want = brute_components([(10 + i, p) for i, p in enumerate(points)], 2)
    assert [roots.get(10 + i, 10 + i) for i in range(len(points))] == want


def test_components_of_paths_stars_and_pairs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5000, 4999), (4999, 5000), (7, 7)]
    got = {r["id"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {1000 + i: 1000 for i in range(60)} | {4999: 4999, 5000: 4999}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_say_when_rounds_run_out(spark):
    with pytest.raises(RuntimeError, match="did not settle"):
        common.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"), rounds=2)


# fuzzy lines

def brute_lines(texts):
    import unicodedata

    def normal(s):
        keep = [c.lower() if unicodedata.category(c)[0] == "L" and len(c.lower()) == 1 else c if unicodedata.category(c)[0] in "LN" else " " for c in s]
        return " ".join("".join(keep).split())
    occurrences = [(i, k, normal(x)) for i, t in texts if t is not None and i is not None for k, x in enumerate(t.split("\n")) if normal(x)]
    names = sorted({n for _, _, n in occurrences})
    parent = {n: n for n in names}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(names):
        for j, b in enumerate(names[:i]):
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) - 1e-9 and 1 - lines.edit_distance(a, b) / max(len(a), len(b)) >= 0.8:
                parent[root(a)] = root(b)
    first = {}
    for i, k, n in occurrences:
        first[root(n)] = min(first.get(root(n), (i, k)), (i, k))
    gone = {}
    for i, k, n in occurrences:
        if (i, k) != first[root(n)]:
            gone.setdefault(i, set()).add(k)
    return [(i, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ()))) for i, t in texts]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last = row
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_line_dedup_equals_brute_force(spark, corpus):
    rng = random.Random(5)
    long_line = prose(80, 1, 400).split()
    near = []
    for i in range(12):
        w = list(long_line)
        w[rng.randrange(80)] = w[0] + "x"
        near.append((600 + i, "before " + str(i) + "\n" + " ".join(w) + "\n\n" + "Zeile " + "ö" * i))
    texts = [*corpus, *near, (None, near[0][1]), (700, "\n\n"), (701, "!!\n??")]
    df = table(spark, texts)
    got = lines.dedup(df)
    assert got.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(brute_lines(texts), key=repr)
    counts = {r["doc_id"]: r for r in lines.dedup_digests(df).collect()}
    assert counts[500]["n_lines"] == 3 and counts[501]["n_removed"] >= 2 and counts[400]["kept_sha256"] is None
    assert lines.dedup_digests(table(spark, [])).count() == 0


def test_line_dedup_by_edit_similarity_alone(spark):
    """One replaced word, short lines with one to four edits, and prose without a partner, against all pairs."""
    rng = random.Random(11)
    texts = []
    for k in range(40):
        w = prose(rng.randint(8, 40), 1000 + k, 400).split()
        v = list(w)
        v[rng.randrange(len(v))] = "zzzz"
        texts += [(k, " ".join(w)), (100 + k, " ".join(v))]
    for k in range(150):
        t = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 24))]
        texts.append((300 + k, "".join(t)))
        for _ in range(max(1, len(t) // 6)):
            t[rng.randrange(len(t)) :][:1] = [rng.choice("abcdefgh")]
            t[rng.randrange(len(t))] = rng.choice("abcdefgh")
        texts.append((500 + k, "".join(t)))
    texts += [(900, "and line 1"), (901, "and line 2"), (902, "abcd"), (903, "abcde")]
    got = {r["doc_id"]: r["text"] for r in lines.dedup(table(spark, texts)).collect()}
    assert got == dict(brute_lines(texts))
    assert sum(got[100 + k] == "" for k in range(40)) > 35 and got[901] == got[903] == ""


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=40), st.text("abc", max_size=40))
def test_edit_distance(a, b):
    assert lines.edit_distance(a, b) == levenshtein(a, b)


def some_lines(texts):
    data, offsets = common.text_bytes(pa.array(["\n".join(texts)], pa.string()))
    return lines.Lines(data, offsets)


def shared_keys(a, b):
    row, key = lines.block_keys(some_lines([a, b]), np.arange(2), 0.8)
    return set(key[row == 0].tolist()) & set(key[row == 1].tolist())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("abcé\U00010348", max_size=150), st.text("abcé\U00010348", max_size=150)), min_size=1, max_size=8))
def test_edit_distances_of_many_pairs(pairs):
    exact = [levenshtein(*p) for p in pairs]
    assert lines.edit_distances(pairs).tolist() == exact
    for limit in (0, 3, 30, 90):
        assert lines.edit_distances(pairs, np.full(len(pairs), limit + 0.5)).clip(max=limit + 1).tolist() == [min(d, limit + 1) for d in exact]
    assert all(lines.word_distance(a.split("c"), b.split("c"), 10**9) >= levenshtein(" ".join(a.split("c")), " ".join(b.split("c"))) for a, b in pairs)
    many = [*pairs, *[(a + b, b + a) for a, b in pairs]] * 20
    assert lines.similar_pairs(many, 0.8).tolist() == [lines.similar(*p, 0.8) for p in many]


def test_words_of_rows_are_compared_in_one_step_inside_the_limit(monkeypatch):
    """Unlike lines are left before half of their columns, with one step a column, and never have all rows looked at; lines shifted by as much as the limit are found."""
    rng, steps = random.Random(5), []

    class Counted:
        def __getattr__(self, name):
            return getattr(np, name)

        @staticmethod
        def take(*args, **kw):
            steps.append(len(args[1]))
            return np.take(*args, **kw)
    monkeypatch.setattr(lines, "np", Counted())
    line = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    assert lines.edit_distances([(line(960), line(960)) for _ in range(40)], np.full(40, 192.5)).tolist() == [193] * 40
    assert 0 < len(steps) < 480 and max(steps) <= 6
    long = [line(900) for _ in range(30)]
    shifted = [(a, a[3 * i :] + line(3 * i)) for i, a in enumerate(long)] + [(a, line(2 * i) + a) for i, a in enumerate(long)]
    exact = np.array([lines.edit_distance(*p) for p in shifted])
    for less in (0, 1):
        assert lines.edit_distances(shifted, exact - less + 0.0).tolist() == exact.tolist()


def test_changed_words_alter_only_their_own_blocks():
    """Blocks that neither lose nor gain a word are the same in both lines, wherever the words stand."""
    rng = random.Random(2)
    for k in range(200):
        w = [f"word{rng.randrange(10**6)}" for _ in range(rng.choice((40, 90, 300)))]
        v = list(w)
        for i in rng.sample(range(len(v)), rng.randint(1, 4)):
            v[i] = f"other{rng.randrange(10**6)}"
        rng.shuffle(v)
        assert shared_keys(" ".join(w), " ".join(v))
    assert not shared_keys(" ".join(w), " ".join(f"else{i}" for i in range(300)))
    assert shared_keys("the " * 60 + "end", "the " * 60 + "stop") and not shared_keys("ab " * 4, "ab " * 11)


def test_recall_of_edited_lines():
    """Lines of 30 to 900 characters with a part of their words replaced."""
    rng, found, similar = random.Random(4), 0, 0
    for k in range(300):
        w = prose(rng.randint(6, 140), 5000 + k, 800).split()
        v = list(w)
        for i in rng.sample(range(len(v)), max(1, len(v) * rng.choice((5, 10, 15)) // 100)):
            v[i] = "zz" + v[i - 1]
        a, b = " ".join(w), " ".join(v)
        if lines.similar(a, b, 0.8):
            similar += 1
            found += bool(shared_keys(a, b))
    assert similar > 200 and found >= 0.9 * similar


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["alpha beta gamma delta ", "one two three four five ", "x", "yy ", "0123456789abcdefghijk"]), max_size=12), st.lists(st.integers(0, 200), max_size=5))
def test_anchored_distance_is_never_below_the_exact_one(parts, cuts):
    a = "".join(f"{p}{i}" for i, p in enumerate(parts)) + "." * 20
    b = a
    for c in cuts:
        b = b[: c % len(b)] + "#" * (c % 3) + b[c % len(b) + c % 7 :] + "." * 20
    got = lines.anchored_distance(a, b, 10**9)
    assert got >= levenshtein(a, b)
    assert lines.anchored_distance(a, a, 10**9) == 0


def test_long_similar_lines_are_decided_quickly():
    a = prose(16000, 1, 3000).split()
    b = [w if i % 40 else w + "q" for i, w in enumerate(a)]
    started = time.perf_counter()
    assert lines.similar(" ".join(a), " ".join(b), 0.8)
    assert time.perf_counter() - started < 2
    assert lines.anchored_distance(" ".join(a[:600]), " ".join(b[:600]), 10**9) == lines.edit_distance(" ".join(a[:600]), " ".join(b[:600]))


def test_large_buckets_are_compared_in_pieces(spark, monkeypatch):
    """Two hundred versions of a line in one bucket, pieces of eight, against all pairs."""
    monkeypatch.setattr(lines, "MEMBERS", 8)
    texts = [(k, f"item {k // 20} {k % 20:02d}") for k in range(200)] + [(300 + k, prose(30, 7, 50) + f" tail {k}") for k in range(40)]
    pieces = list(lines._in_pieces(np.zeros(20, np.uint64), np.arange(20, dtype=np.uint64), np.ones(20, bool), np.array([0]), np.array([20])))
    met = set()
    for name in {int(b[0]) for b, _, _ in pieces if len(b)}:
        rows = [(int(x), int(r)) for b, low, role in pieces for bb, x, r in zip(b, low, role, strict=True) if int(bb) == name]
        met |= {(x, y) for x, r in rows for y, q in rows if x < y and (r == q == 1 or (r ^ q) & 6)}
    assert met == {(x, y) for y in range(20) for x in range(y)}
    assert {r["doc_id"]: r["text"] for r in lines.dedup(table(spark, texts)).collect()} == dict(brute_lines(texts))


def test_crowded_buckets_are_connected_without_all_pairs(monkeypatch):
    """Versions of three lines that only exact distances link: the edges are a forest, few similar pairs are compared, and connected is what all pairs connect."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(3):
        words = [word() for _ in range(60)]
        for _ in range(80):
            changed = set(rng.sample(range(60), 9))
            texts.append(" ".join(w[:2] + rng.choice("xyz") + w[3:] if i in changed else w for i, w in enumerate(words)))
    compared = []
    decide = lines.similar_pairs
    monkeypatch.setattr(lines, "similar_pairs", lambda pairs, least: compared.extend(pairs) or decide(pairs, least))

    def connected(edges):
        label = list(range(len(texts)))
        for i, j in edges:
            label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
        return label
    for role in ([1] * 240, [lines.LEFT | 1 if i % 3 else lines.RIGHT for i in range(240)]):
        compared.clear()
        edges, rest = lines._in_bucket(texts, role, 0.8)
        met = [(i, j) for j in range(240) for i in range(j) if (role[i] | role[j]) & 1 and (role[i] != role[j] or role[i] == 1)]
        alike = [p for p, yes in zip(met, decide([(texts[i], texts[j]) for i, j in met], 0.8), strict=True) if yes]
        left = [p for p, yes in zip(rest, decide([(texts[i], texts[j]) for i, j in rest], 0.8), strict=True) if yes]
        seen = int(decide(list(compared), 0.8).sum())
        assert len(edges) < 240 and len(alike) > 15 * len(edges)
        assert seen < 3 * 240 and not left
        assert connected(edges) == connected(alike) and len(set(connected(edges))) == 3
    chain = [(i, i + 1) for i in range(20)]
    assert lines._forest([*chain, *[(i, j) for i in range(20) for j in range(i)], (30, 31)]) == [*chain, (30, 31)]


def ruled_out(pairs):
    """What ``beyond_limit`` says of pairs at the similarity of 0.8."""
    pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    texts = [t for p in pairs for t in p]
    length = np.array([len(t) for t in texts])
    code = np.array([ord(c) % 32 for t in texts for c in t], np.uint8)
    a, b = np.arange(0, len(texts), 2), np.arange(1, len(texts), 2)
    return lines.beyond_limit(code, np.cumsum(length) - length, length, a, b, np.floor(0.2 * length[b] + 1e-9).astype(np.int64))


def test_only_unlike_pairs_are_ruled_out_by_windows(monkeypatch):
    """Lines edited by characters, words and moved parts at rates about the limit: no similar pair is ruled out; most others are."""
    monkeypatch.setattr(lines, "FEW", 1)
    rng, pairs = random.Random(8), []
    for k in range(400):
        a = prose(rng.randint(12, 120), 9000 + k, 300)
        kind, rate = k % 4, rng.choice((0.05, 0.12, 0.18, 0.2, 0.22))
        if kind == 0:
            b = "".join(c if rng.random() > rate else rng.choice(("", "q", c + "é")) for c in a)
        elif kind == 1:
            at, n = rng.randrange(len(a)), int(rate * len(a))
            b = a[:at] + a[at + n :] if k % 8 == 1 else a[:at] + "x" * n + a[at:]
        elif kind == 2:
            n = int(rate * len(a)) // 2
            b = a[n:] + "".join(rng.choice("abc ") for _ in range(n))
        else:
            b = prose(rng.randint(12, 120), 19000 + k, 300)
        pairs.append((a, b))
    similar = np.array([1 - levenshtein(a, b) / max(len(a), len(b)) >= 0.8 for a, b in pairs])
    out = ruled_out(pairs)
    assert similar.sum() > 150 and not (out & similar).any()
    assert out[3::4].mean() > 0.9


def test_unlike_lines_of_a_bucket_are_not_compared_one_by_one(monkeypatch):
    """Lines that share two words only, and a similar pair in two buckets: the exact distance is asked for next to no pair."""
    texts = [prose(60, 400 + k, 3000) + " shared phrase" for k in range(120)]
    twin = texts[7].replace("e", "u", 40)
    compared = []
    decide = lines.similar_pairs
    monkeypatch.setattr(lines, "similar_pairs", lambda pairs, least: compared.extend(pairs) or decide(pairs, least))
    edges, rest = lines._in_buckets([([*texts, twin], [1] * 121), ([texts[7], twin], [1, 1]), ([texts[9], texts[8]], [1, 1])], 0.8)
    assert len(compared) + len(rest) < 300
    rows = [*texts, twin, texts[7], twin, texts[9], texts[8]]
    found = edges + [p for p, yes in zip(rest, decide([(rows[i], rows[j]) for i, j in rest], 0.8) if rest else (), strict=True) if yes]
    assert [{rows[i], rows[j]} for i, j in found] == [{texts[7], twin}]


def test_short_and_unevenly_lettered_lines_are_ruled_out_exactly(monkeypatch):
    """Pairs of lines shorter than a window, about the limit: those beyond it are ruled out and no others; few such pairs of a bucket are compared one by one."""
    monkeypatch.setattr(lines, "FEW", 1)
    monkeypatch.setattr(lines, "LAST", 1)
    rng, pairs = random.Random(9), []
    for _ in range(600):
        a = "".join(rng.choice("abcdef ") for _ in range(rng.randint(1, 63)))
        b = "".join(c if rng.random() > 0.2 else rng.choice(("", "g", c + "h")) for c in a)
        pairs.append((a, b or "x"))
    far = ruled_out(pairs)
    assert far.tolist() == [levenshtein(a, b) > int(0.2 * max(len(a), len(b)) + 1e-9) for a, b in pairs]
    assert 100 < far.sum() < 500
    texts = sorted({"shared phrase " + "".join(rng.choice("abcdefgh") for _ in range(40)) for _ in range(150)})
    compared = []
    decide = lines.similar_pairs
    monkeypatch.setattr(lines, "similar_pairs", lambda pairs, least: compared.extend(pairs) or decide(pairs, least))
    edges, rest = lines._in_buckets([(texts, [1] * len(texts))], 0.8)
    assert edges == [] and len(compared) + len(rest) < 50
    counts = lines.letter_counts(np.array([1, 2, 2, 31, 0], np.uint8), np.array([0, 3, 3]), np.array([3, 0, 2]))
    assert counts.sum(axis=1).tolist() == [3, 0, 2] and counts[0, :3].tolist() == [0, 1, 2] and counts[2, 31] == 1


def test_first_pieces_of_large_buckets_grow_with_their_rows(spark, monkeypatch):
    """Pieces of a bucket hold each row once or twice; what they leave unconnected, and nothing else, is compared over the whole bucket."""
    monkeypatch.setattr(lines, "MEMBERS", 8)
    monkeypatch.setattr(lines, "OVERLAP", 2)
    n, low = 100, np.arange(100, dtype=np.uint64)
    pieces = [(b, l, r) for b, l, r, _ in lines._alone(np.array([7] * n, np.uint64), low, np.ones(n, bool), np.array([0]), np.array([n]), np.zeros(n, np.int64)) if len(b)]
    assert sum(len(b) for b, _, r in pieces if r[0] < lines.WHOLE) <= 1.3 * n and [l.tolist() for _, l, r in pieces if r[0] >= lines.WHOLE] == [low.tolist()]
    assert all(set(l.tolist()) & set(k.tolist()) for (_, l, _), (_, k, _) in zip(pieces[:-2], pieces[1:-1], strict=True))
    root = np.array([i % 10 if i % 10 < 3 else 9 for i in range(n)])
    met: dict[int, list] = {}
    for b, l, r, x in lines._between(np.uint64(7), low, np.ones(n, bool), np.arange(n), root, 256):
        assert (root[l.astype(int)] == x).all()
        met.setdefault(int(b[0]), []).extend(zip(l.tolist(), r.tolist(), strict=True))
    pairs = {(x, y) for rows in met.values() for x, r in rows for y, q in rows if x < y and (r == q == 1 or (r ^ q) & 6)}
    assert {(x, y) for y in range(n) for x in range(y) if root[x] != root[y]} <= pairs
    assert not any(root[x] == root[y] == 9 for x, y in pairs)
    assert list(lines._between(np.uint64(7), low, np.ones(n, bool), np.arange(n), np.ones(n), 256)) == []
    texts = ["one two three four", "five six seven eight", "one two three fouz"]
    assert lines._in_buckets([(texts, [1, 1, 1])], 0.8, [5, 6, 5])[0] == [] and lines._in_buckets([(texts, [1, 1, 1])], 0.8)[0] == [(0, 2)]


def test_pairs_across_pieces_of_a_large_bucket_are_found(spark):
    """Lines that share one long word, so that hundreds are in one bucket, each pair of them unlike but for a few of different length."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    texts = [(k, " ".join(["extraordinarycommonword", *(word() for _ in range(rng.randint(16, 19)))])) for k in range(3600)]
    twins = {2000 + k: texts[k][1] + " " + " ".join(word() for _ in range(len(texts[k][1].split()) // 6)) for k in range(0, 3600, 300)}
    rows = table(spark, [*texts, *twins.items()])
    docs = rows.select(F.col("doc_id").alias("id"), "text")
    got = lines.candidate_classes(docs, len(texts) + len(twins), 0.8).filter(F.col("role") >= lines.WHOLE)
    assert got.groupBy("bucket").count().agg(F.max("count")).first()[0] > lines.MEMBERS
    gone = {r["doc_id"] for r in lines.dedup_digests(rows).filter("n_removed > 0").collect()}
    assert gone == {k for k, t in twins.items() if lines.similar(texts[k - 2000][1], t, 0.8)} and len(gone) > 5


def test_edges_of_a_task_are_one_forest():
    above = {}
    assert lines._forest([(1, 2), (2, 3), (1, 3)], above) == [(1, 2), (2, 3)]
    assert lines._forest([(3, 1), (3, 4), (5, 6)], above) == [(3, 4), (5, 6)]


def test_majorities_of_few_features():
    rng = np.random.default_rng(1)
    n = rng.integers(1, 9, 2000)
    feature, at = rng.integers(0, 2**64, n.sum(), np.uint64), np.append(0, np.cumsum(n))
    assert (lines._majorities(feature, at) == simhash.majority(feature, at)).all()


def test_length_levels_part_only_lines_that_cannot_be_similar(spark):
    """Similar lengths are within reach wherever the levels part them; classes without a partner of like length are in no bucket."""
    n = np.concatenate((np.arange(1, 3000), np.arange(3000, 400_000, 997)))
    for least in (0.5, 0.8, 0.95):
        long = np.floor(n / least + 1e-9).astype(np.int64)
        assert (lines.length_levels(long).astype(int) - lines.length_levels(n) <= lines.level_reach(least)).all()
    assert lines.level_reach(0.0) == 256
    start = prose(12, 3, 400)
    rows = table(spark, [(1, start), (2, start + " " + prose(90, 4, 400)), (3, "other " + prose(40, 5, 400)), (4, "another " + prose(40, 5, 400))])
    got = lines.candidate_classes(rows.select(F.col("doc_id").alias("id"), "text"), 4, 0.8)
    assert got.count() and got.select("low").distinct().count() == 2


def test_rows_of_one_id_lose_only_their_own_lines(spark):
    line = "a line of words that two documents share"
    rows = [(1, f"{line}\nof its own entirely"), (2, f"first here\n{line}"), (2, "nothing else\nwhollydifferent zebra quartz"), (2, f"first here\n{line}")]
    got = sorted(r["text"] for r in lines.dedup(table(spark, rows)).collect())
    assert got == sorted([rows[0][1], "first here", rows[2][1], "first here"])


# top-k

def brute_top(rows, k=20):
    usable = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            usable[(i, tuple(int(np.floor(64 * float(x))) for x in v))] = True
    out = []
    for i, q in usable:
        if i % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, c, strict=True)), j) for j, c in usable if j != i and len(c) == len(q))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("n,dims,block", [(150, 64, 8192), (90, 33, 16), (7, 3, 8192)])
def test_top_k_equals_brute_force(spark, monkeypatch, n, dims, block):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(n)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=dims) * (1 + (i % 7 == 0))]) for i in range(n)]
    rows += [(n + 1, rows[1][1]), (n + 2, rows[1][1]), (1, rows[1][1]), (n + 3, None), (n + 4, [float("nan")] * dims), (n + 5, [None] * dims), (n + 6, [float("inf")] * dims), (n + 7, [])]
    rows += [(None, rows[0][1]), (n + 8, rows[0][1][:-1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, id int, v int")
    got = topk.exact_top_k(df, "vec_id", "embedding", F.pmod("id", F.lit(20)) == 0)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == brute_top(rows)
    assert topk.exact_top_k(df.limit(0), "vec_id", "embedding", F.pmod("id", F.lit(20)) == 0).count() == 0


def test_branch_and_bound_prunes_without_loss():
    rng = np.random.default_rng(1)
    c = (rng.normal(size=(64, 4000)) * 64 * np.geomspace(3, 0.05, 64)[:, None]).astype(np.int64)
    q = c[:, :5].T
    r, i, s = topk.best_of_block(np.arange(5), q, np.arange(4000), c, 20)
    for k in range(5):
        full = (q[k] @ c).astype(float)
        full[k] = -np.inf
        order = np.lexsort((np.arange(4000), -full))[:20]
        assert (i[r == k] == order).all() and (s[r == k] == full[order]).all()


# piecewise hashing

def test_neighbours_over_ranges(spark, corpus):
    texts = [*corpus, (None, "first of all")]
    rows = fingerprints.neighbour_likeness(table(spark, texts)).collect()
    order = sorted(((-1 if i is None else i, t is not None, t or "", i) for i, t in texts))
    want = []
    for k, (_, _, t, i) in enumerate(order):
        f = order[(k + 1) % len(order)][2]
        e = fingerprints.edited(t, f)
        marks = fingerprints._of_texts([t, e, f])
        near = fingerprints.likeness([marks[0]] * 2, marks[1:])
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), marks[0], marks[1], near[0], near[1]))
    assert sorted((tuple(r) for r in rows), key=repr) == sorted(want, key=repr)
    assert fingerprints.neighbour_likeness(table(spark, [])).count() == 0
    alone = fingerprints.neighbour_likeness(table(spark, [(1, "only one text here")])).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


def test_likeness(spark):
    a, b = prose(600, 1, 500), prose(600, 2, 500)
    half = fingerprints.edited(a, b)
    fa, fb, fh = fingerprints._of_texts([a, b, half])
    assert fingerprints.likeness([fa, fa, fa], [fa, fh, fb]).tolist()[0] == 1.0
    same, near, far = fingerprints.likeness([fa, fa, fa], [fa, fh, fb])
    assert same == 1 and 0.3 < near < 1 and far < near
    assert fingerprints._of_texts(["", a]) == ["3::", fa]
    rows = fingerprints.fingerprint_texts(table(spark, [(1, None), (2, "")])).collect()
    assert {r["fingerprint"] for r in rows} == {"3::"}


def naive_fingerprint(text):
    data = text.encode()
    roll = lambda i: fingerprints.rolling(np.frombuffer(data[max(0, i - 6) : i + 1], np.uint8), np.array([0, min(7, i + 1)]))[-1]
    return [int(roll(i)) for i in range(len(data))]


def test_rolling_hash_sees_seven_bytes_of_its_text():
    texts = [prose(30, 3), "", "ab", prose(10, 4)]
    data, offsets = common.text_bytes(pa.array(texts))
    got = fingerprints.rolling(data, offsets)
    for i, t in enumerate(texts):
        assert got[offsets[i] : offsets[i + 1]].tolist() == naive_fingerprint(t)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("ABCD", min_size=1, max_size=64), st.text("ABCD", min_size=1, max_size=64)), min_size=1, max_size=5))
def test_common_subsequence(pairs):
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(last[j + 1], row[-1]))
        return row[-1]
    assert fingerprints._common(pairs).tolist() == [lcs(a, b) for a, b in pairs]


def test_likeness_of_repetitive_texts_sees_all_of_them():
    unit, rng = "abcdefghijklmnopqrstuvwxyz0123456789-+", random.Random(4)
    head = unit * 70
    ends = ["".join(rng.choice(unit) for _ in range(23_000)) for _ in range(2)]
    a, b = fingerprints._of_texts([head + e for e in ends])
    assert fingerprints.likeness([a, a], [a, b]).tolist()[0] == 1.0
    assert fingerprints.likeness([a], [b]).tolist()[0] < 0.5
    texts = ["".join(rng.choice(unit) for _ in range(rng.choice((30, 60)))) * rng.randint(50, 800) for _ in range(60)]
    for f in fingerprints._of_texts(texts):
        _, one, two = f.split(":")
        assert 0 < len(one) <= fingerprints.LETTERS and 0 < len(two) <= fingerprints.LETTERS // 2
