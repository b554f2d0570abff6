"""Language identification, encoding, packing, secrets and chat formatting on small cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gustline.llm import bpe, chat, langid, packing, queries, secrets
from gustline.llm.common import slices, text_bytes

SCHEMA = "doc_id long, text string, lang string, source string, id string, ids int, bits int, spans int"  # with names the operators use inside


def table(spark, texts, langs=None):
    rows = [(i, t, (langs or {}).get(i), "s", "x", 1, 2, 3) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "héllo wörld"), (5, "x" * 200_000), (6, "a b c"), (6, "a b c"), (7, "日本語 🙂 text"), (None, "no id here at all")]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


# encoding

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def encoded(texts):
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    ids, at = bpe.vocabulary(queries.tokenizer_path()).encode(data, offsets)
    return [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))]


PIECES = ["'s", "s", "re", "'ll", " ", "  ", "\n", "\t", " ", "　", "a", "the", "é", "ß", "中文", "1", "½", "!", "...", "<|endoftext|>", "🙂", "́", "\x1c", "\x85", "_", "'D", "<|", "x" * 70]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=20).map("".join))
def test_encoding_equals_the_tokenizer(text):
    from tokenizers import Tokenizer

    global _TOKENIZER
    _TOKENIZER = globals().get("_TOKENIZER") or Tokenizer.from_file(queries.tokenizer_path())
    assert encoded([text])[0] == _TOKENIZER.encode(text, add_special_tokens=False).ids


def test_every_code_point_is_encoded_as_by_the_tokenizer(tokenizer):
    texts = ["a1 " + "".join(chr(c) + "a1 "[c % 3] for c in range(a, a + 64) if not 0xD800 <= c < 0xE000) for a in range(0, 0x110000, 64)]
    assert encoded(texts) == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_long_words_and_neighbouring_texts(tokenizer):
    texts = ["a" * 5000 + "b", "'s", "", " lead", "tail ", "ab" * 400 + " xyz", "\n\nend"]
    assert encoded(texts) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoding_digests(spark, odd, empty, tokenizer):
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encoding_digests(odd, queries.tokenizer_path()).collect()}
    want = set()
    for i, t in ODD:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    assert bpe.encoding_digests(empty, queries.tokenizer_path()).count() == 0


def test_round_trip(spark, odd):
    path = queries.tokenizer_path()
    back = bpe.decode_texts(bpe.encode_texts(odd, path), path)
    assert sorted((str(r["id"]), r["text"]) for r in back.collect()) == sorted((str(i), t or "") for i, t in ODD)


def test_slices_cover_rows_once():
    offsets = np.array([0, 0, 5, 5, 100, 101])
    assert list(slices(offsets, 6)) == [(0, 3), (3, 4), (4, 5)]


# packing

def check_packing(rows, texts, tokenizer, capacity=1024):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    for i in {i for i, _ in texts}:
        want = sorted(tuple(sorted(pieces_of(t, tokenizer, capacity))) for j, t in texts if j == i)
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[i]) == sorted(p for ps in want for p in ps)
    return len(by_sequence)


def pieces_of(text, tokenizer, capacity):
    ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
    cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids), capacity), len(ids)]
    return [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def test_pack(spark, odd, empty, tokenizer):
    check_packing(packing.pack(odd, queries.tokenizer_path()).collect(), ODD, tokenizer)
    assert packing.pack(empty, queries.tokenizer_path()).count() == 0


def test_pack_a_common_length(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ROWS", 7)
    texts = [(i, "hello there") for i in range(100)] + [(200 + i, "word " * (300 + i)) for i in range(30)]
    check_packing(packing.pack(table(spark, texts), queries.tokenizer_path()).collect(), texts, tokenizer)


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plans_cover_the_histogram(hist):
    h = np.zeros(65, np.int64)
    for k, n in hist.items():
        h[k] = n
    plan = packing.plan(h, 64)
    used = np.zeros(65, np.int64)
    for pattern, n in plan:
        assert n > 0 and sum(pattern) <= 64
        for p in pattern:
            used[p] += n
    assert (used == h).all()
    total = int((h * np.arange(65)).sum())
    assert sum(n for _, n in plan) <= max(1, 2 * -(-total // 64)) or total == 0


def test_patterns_reach_the_bound():
    h = np.bincount(np.random.default_rng(0).integers(1, 1025, 20000), minlength=1025)
    n = sum(k for _, k in packing.plan(h))
    assert n <= -(-int((h * np.arange(1025)).sum()) // 1024) * 1.01
    assert n <= sum(k for _, k in packing.best_fit(h.copy(), 1024))


# secrets

def brute_spans(text):
    out = []
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "SECRET", "tok", "token", "api_key", "apikey", "ſecret", "=", ":", " ", '"', "'", "abc", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "\n", "-"]), max_size=14).map("".join))
def test_base_patterns(text):
    assert secrets.base_spans(text) == brute_spans(text)


@pytest.fixture(scope="module")
def chains(spark):
    words = "configuration management_service getUserProfile description_of_things international understanding documentation-index".split()
    rng = random.Random(1)
    plain = [(rng.choice(words) + rng.choice(["", "_"]) + rng.choice(words), False) for _ in range(600)]
    return secrets.train(spark.createDataFrame(plain + [(None, True), ("", False)], "word string, is_random boolean"))


def test_chains_tell_random_from_ordinary(chains):
    fresh = secrets.random_strings(400, seed=99)
    hits = sum(chains.score(w) >= chains.threshold for w in fresh)
    assert hits > 0.9 * len(fresh)
    for word in ("understanding_documentation_service", "getManagementConfiguration", "international_description"):
        assert chains.score(word) < chains.threshold


def test_scan_and_redact(spark, chains, empty):
    key = "Zx9Qp2Lm7Vt4Rk8Wb3Nc"
    texts = [(1, f"é use {key} now"), (2, "password = hunter22, ok"), (3, None), (4, "nothing here"), (5, "token=0123456789abcdef01234567"), (5, "token=0123456789abcdef01234567")]
    df = table(spark, texts)
    got = {r["doc_id"]: r for r in secrets.scan_digests(df, chains).collect()}
    assert got[1]["spans"] == "random:6:26" and got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[2]["spans"] == "assign:0:19" and got[2]["n_assign"] == 1
    assert got[3]["spans"] == "" and got[4]["spans"] == ""
    assert got[5]["spans"] == "assign:0:30,hex:6:30" and (got[5]["n_assign"], got[5]["n_access"], got[5]["n_hex"]) == (1, 0, 1)
    clean = {r["doc_id"]: r for r in secrets.redact(df, chains).collect()}
    assert clean[1]["text"] == "é use [SECRET] now" and clean[3]["text"] is None and clean[5]["text"] == "[SECRET]" and clean[4]["source"] == "s"
    assert secrets.scan_digests(empty, chains).count() == 0
    assert secrets.train(secrets.labelled_words(empty)).score("abcdef") is not None


# language

def languages(n, seed):
    rng = random.Random(seed)
    words = {"aa": "the and of with from that this which".split(), "bb": "der die und mit nicht das eine auch".split()}
    return [(i, " ".join(rng.choices(words[x], k=rng.randint(3, 30))), x) for i, x in enumerate(rng.choices(list(words), k=n))]


@pytest.fixture(scope="module")
def model(spark):
    rows = languages(200, 3)
    return langid.fit(table(spark, [(i, t) for i, t, _ in rows], {i: x for i, _, x in rows}))


def test_held_out_accuracy(spark, model):
    rows = languages(200, 4)
    got = {r["id"]: r for r in langid.predict(table(spark, [(i, t) for i, t, _ in rows]), model).collect()}
    assert sum(got[i]["lang_pred"] == x for i, _, x in rows) >= 198
    assert all(0 <= r["score"] <= 1 for r in got.values())


def naive_bits(samples, text):
    """Code length of folded ``text`` by the definition, with dictionaries and explicit exclusion."""
    fold = lambda t: "   " + re.sub(r"[^a-z]+", " ", t.lower())
    counts = [{} for _ in range(4)]
    for t in samples:
        f = fold(t)
        for i in range(3, len(f)):
            for k in range(4):
                counts[k].setdefault(f[i - k : i], {}).setdefault(f[i], 0)
                counts[k][f[i - k : i]][f[i]] += 1
    f, bits = fold(text), 0.0
    for i in range(3, len(f)):
        excluded = set()
        for k in (3, 2, 1, 0):
            seen = {c: n for c, n in counts[k].get(f[i - k : i], {}).items() if c not in excluded}
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if f[i] in seen:
                bits += np.log2(total / seen[f[i]])
                break
            bits += np.log2(total / len(seen))
            excluded |= set(seen)
        else:
            bits += np.log2(256 - len(excluded))
    return bits


def test_code_lengths_are_exact(model):
    rows = languages(200, 3)
    texts = ["the of, NICHT mit!", "xyzzy", "und", "a", "", "that  which das"]
    data, offsets = text_bytes(pa.array(texts))
    folded, at, _ = langid.fold(data, offsets)
    got = model.lengths(folded, at, model.index())
    for j, lang in enumerate(model.langs):
        samples = [t for _, t, x in rows if x == lang]
        assert np.allclose(got[:, j], [naive_bits(samples, t) for t in texts])


def test_language_of_odd_texts(spark, odd, empty, model):
    got = {r["id"]: r for r in langid.predict(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[1]["score"] == 0
    assert got[7]["lang_pred"] in ("aa", "bb") and None in got
    assert langid.predict(empty, model).count() == 0
    assert langid.fit(empty) is None and langid.fit(odd) is None
    assert {r["lang_pred"] for r in langid.predict(odd, None).collect()} == {"und"}


def test_rejection(spark, model):
    texts = [(1, "the and of with"), (2, "123 !!"), (3, None), (4, "qzxv kjwq vvzx qqjk zzxq wvkj")]
    kept = langid.keep_identified(table(spark, texts), model)
    assert [r["doc_id"] for r in kept.collect()] == [1] and "source" in kept.columns


def test_added_spans_touch_no_base_span(chains):
    words = [*secrets.random_strings(40, seed=7), "token=0123456789abcdef01234567", "understanding_documentation_service", "password: hunter2222"]
    rng = random.Random(3)
    text = " ".join(rng.choice(words) for _ in range(600))
    taken = secrets.base_spans(text)
    want = [(m.start(), 3, m.end()) for m in secrets.WORD.finditer(text)
            if not any(a < m.end() and m.start() < b for a, _, b in taken) and chains.score(m[0]) >= chains.threshold]
    assert chains.spans(text, taken) == want and len(want) > 100 and len(taken) > 50


# chat

def test_turns_with_one_number_are_ordered_by_text(spark):
    rows = [(1, 0, "user", t) for t in ("<|", "<z", "\\", "a<|b", "a<z", "[INST]", "[Z")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    made = chat.read_back(chat.format_conversations(df.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))).first()
    assert [t["text"] for t in made["turns"]] == sorted(r[3] for r in rows)


def test_control_strings_come_back(spark):
    texts = ["</s>[INST] ok [/INST]", "<|turn|>system<|text|>x<|end|>\n", "\\", "\\<\\|", "<<SYS>>", "", None, "<|>", "a\\|b", "[\\INST]", "line\nline"]
    rows = [(1, i, "assistant" if i % 2 else "user", t, 5) for i, t in enumerate(texts)] + [(2, 0, None, "x", 5), (None, 0, "user", "y", 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, position int")
    df = df.select("conv_id", "turn", "role", "position", chat.text_part(F.col("text")).alias("parts"))
    made = chat.format_conversations(df)
    back = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(texts)]
    assert list(back[1]["loss_texts"]) == [t or "" for t in texts[1::2]]
    assert back[2]["turns"][0]["role"] == "" and back[None]["turns"][0]["text"] == "y"
    inside = back[1]["formatted"]
    for s in ("</s>", "[INST]", "<<SYS>>"):
        assert s not in inside
    assert inside.count("<|turn|>") == len(texts)


def test_parts_become_placeholders(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    rows = [(1, 0, "user", [part("text", "see "), part("image", ref="a.png", w=56, h=29), part("text", " and "), part("audio", ref="b.wav", s=2.0)]),
            (1, 1, "assistant", [part("document", ref="c.pdf", p=3), part(None, "done")]), (1, 2, "user", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts array<{chat.PART}>")
    r = chat.read_back(chat.format_conversations(df)).first()
    assert [t["text"] for t in r["turns"]] == ["see <|image|> and <|audio|>", "<|document|>done", ""]
    assert [(a["turn"], a["part"], a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(1, 1, "image", "a.png", 4), (1, 3, "audio", "b.wav", 50), (2, 0, "document", "c.pdf", 768)]
    assert r["expanded_tokens"] == 822
    assert chat.conversation_digests(df.limit(0)).count() == 0


def test_chat_runs_no_python(spark, tmp_path):
    df = spark.range(3).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), chat.text_part(F.lit("x")).alias("parts"))
    plan = chat.conversation_digests(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
