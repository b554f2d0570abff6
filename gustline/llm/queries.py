"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import configure
from . import bpe, chat, fingerprints, infill, langid, lines, packing, repair, repeats, secrets, simhash, topk, windows
from .common import small_batches

TOKENIZER = "byte_bpe_50k.json"
WORD_TOKENIZER = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(small_batches(configure(spark)), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _escaped_sql(c: str) -> str:
    c = f"replace({c}, '\\', '\\\\')"
    for s in chat.CONTROL:
        c = f"replace({c}, '{s}', '{s[0]}\\{s[1:]}')"
    return c


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The public vocabulary file, installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_language_id")
def op1_language_id(spark, sf_dir):
    """Language of every document; two thirds of them may teach."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(~langid.held_out()))
    out = langid.predict(docs, model)
    held = F.coalesce(langid.held_out("id"), F.lit(False))
    return out.select(F.col("id").alias("doc_id"), held.alias("held_out"), "lang_pred", "score", "bits")


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark, sf_dir):
    """Every document without the 50-byte windows of earlier ones."""
    return repeats.removal_digests(_table(spark, sf_dir, "documents"))


@query("op3_bpe_round_trip")
def op3_bpe_round_trip(spark, sf_dir):
    """Ids of every document and the text decoded from them."""
    return bpe.encoding_digests(_table(spark, sf_dir, "documents"), tokenizer_path())


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark, sf_dir):
    """Every document in sequences of 1024 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


@query("op5_secret_scan")
def op5_secret_scan(spark, sf_dir):
    """Secrets in every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan_digests(docs, secrets.train(secrets.labelled_words(docs)))


_SAID = "'</s>[INST] ok [/INST]'"
OP6_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {_SAID} UNION ALL SELECT -7, 1, 'assistant', {_SAID}),
shown AS (SELECT *, length({_escaped_sql('role')}) + length({_escaped_sql('text')})
  + {len(chat.TURN + chat.TEXT + chat.END)} AS size FROM said)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
"""


@query("op6_chat_formatting", OP6_SQL)
def op6_chat_formatting(spark, sf_dir):
    """All conversations, and one that says control strings itself."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text"))
        for i, role in enumerate(("user", "assistant"))])).alias("m")).select("m.*")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.conversation_digests(rows.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))


@query("op7_simhash_near_duplicates")
def op7_simhash_near_duplicates(spark, sf_dir):
    """Fingerprint and near-duplicate component of every document."""
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op8_line_dedup")
def op8_line_dedup(spark, sf_dir):
    """What every document keeps when equal and similar lines are removed."""
    return lines.dedup_digests(_table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH v AS (SELECT DISTINCT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op9_exact_topk", OP9_SQL)
def op9_exact_topk(spark, sf_dir):
    """The 20 best of all vectors for every 20th."""
    return topk.exact_top_k(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.pmod("id", F.lit(20)) == 0)


@query("op10_document_fingerprints")
def op10_document_fingerprints(spark, sf_dir):
    """Every document against its edited form and the next document."""
    return fingerprints.neighbour_likeness(_table(spark, sf_dir, "documents"))


@query("op11_conversation_repair")
def op11_conversation_repair(spark, sf_dir):
    """Every conversation, damaged and repaired."""
    return repair.damage_repairs(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1,
    CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


@query("op12_fill_in_middle", OP12_SQL)
def op12_fill_in_middle(spark, sf_dir):
    """Every document in a fill-in-middle form, and back."""
    rows = infill.restore(infill.transform(_table(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


@query("op13_window_packing")
def op13_window_packing(spark, sf_dir):
    """Every document in windows of 4096 tokens, in order."""
    return windows.pack(_table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER))
