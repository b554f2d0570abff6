"""Chat formatting with typed content parts, in DataFrame functions only.

A conversation is rows ``(conv_id, turn, role, parts)``; ``parts`` is an array of typed parts. A visitor
over the parts keeps text (escaped) and puts an ordered placeholder where an image, audio clip or document
stood; what stood there is kept as an attachment with its reference and the number of tokens the
placeholder expands to. ``read_back`` parses the formatted text again and gives the original turns.

Defined results: a null role, text, kind or parts array counts as empty; rows with equal turn numbers are
ordered by role, then text; repeated rows are repeated turns; null ``conv_id`` is a conversation of its own;
an empty table gives an empty table; other columns are ignored. One conversation is one formatted string,
so its size is bounded by what a Spark string holds (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# The template's markers, and the strings that must not appear unescaped inside a text.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
CONTROL = ("<|", "|>", "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>")
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"

PATCH_PIXELS = 28
AUDIO_TOKENS_PER_SECOND = 25
TOKENS_PER_PAGE = 256


def escape(c: Column) -> Column:
    """Doubles backslashes, then puts one behind the first character of every control string."""
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for s in CONTROL:
        c = F.replace(c, F.lit(s), F.lit(s[0] + "\\" + s[1:]))
    return c


def unescape(c: Column) -> Column:
    """Inverse of ``escape``: a backslash stands for the character behind it."""
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """A parts array of one text part."""
    fields = [F.lit("text").alias("kind"), text.alias("text")]
    fields += [F.lit(None).cast(t).alias(n) for n, t in
               (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(*fields))


def _is_text(p: Column) -> Column:
    return F.coalesce(p["kind"], F.lit("text")) == "text"


def _tokens(p: Column) -> Column:
    """Tokens that the placeholder of a part expands to, at least one."""
    patches = lambda n: F.ceil(n / F.lit(PATCH_PIXELS))
    n = (F.when(p["kind"] == "image", patches(p["width"]) * patches(p["height"]))
         .when(p["kind"] == "audio", F.ceil(p["seconds"] * AUDIO_TOKENS_PER_SECOND))
         .when(p["kind"] == "document", p["pages"].cast("long") * TOKENS_PER_PAGE))
    return F.greatest(F.coalesce(n.cast("long"), F.lit(1)), F.lit(1).cast("long"))


def _visited(p: Column) -> Column:
    placeholder = F.concat(F.lit("<|"), escape(p["kind"]), F.lit("|>"))
    return F.when(_is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(placeholder)


def _said(p: Column) -> Column:
    return F.when(_is_text(p), F.coalesce(p["text"], F.lit(""))).otherwise(F.concat(F.lit("<|"), p["kind"], F.lit("|>")))


def format_conversations(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``(conv_id, turn, role, parts)`` to one row per conversation.

    Returns ``conv_id``, ``formatted``, ``loss_spans`` (start and end in code points of the bodies of
    ``loss_role``), ``attachments`` (turn position, position in the turn, kind, ref, tokens; in reading order) and
    ``expanded_tokens`` (sum of the attachments' tokens).
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    body = F.array_join(F.transform(parts, _visited), "")
    said = F.array_join(F.transform(parts, _said), "")
    attached = F.filter(
        F.transform(parts, lambda p, i: F.struct(i.alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens"), _is_text(p).alias("is_text"))),
        lambda a: ~a["is_text"])
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    rows = rows.select("conv_id", "turn", "role", head.alias("head"), body.alias("body"), said.alias("said"), attached.alias("attached"))
    seen = Window.partitionBy("conv_id").orderBy("turn", "role", "said", "body")
    before = seen.rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + F.lit(len(END))
    rows = rows.select(
        "conv_id", "role", "head", "body", "attached", F.row_number().over(seen).alias("position"),
        F.coalesce(F.sum(size).over(before), F.lit(0)).alias("at"),
    )
    start = F.col("at") + F.length("head")
    span = F.when(F.col("role") == loss_role, F.struct(start.alias("start"), (start + F.length("body")).alias("end")))
    attached = F.transform("attached", lambda a: F.struct(
        F.col("position").alias("turn"), a["part"].alias("part"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))
    turn = F.struct("position", F.concat("head", "body", F.lit(END)).alias("shown"), span.alias("span"), attached.alias("attached"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    out = grouped.select(
        "conv_id",
        F.array_join(F.col("turns.shown"), "").alias("formatted"),
        F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.col("turns.attached")).alias("attachments"),
    )
    total = F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"])
    return out.withColumn("expanded_tokens", total)


def read_back(formatted: DataFrame) -> DataFrame:
    """Parses ``format_conversations``' output: adds ``turns`` (role, text; unescaped) and ``loss_texts``.

    Placeholders stay in the texts as ``<|kind|>``.
    """
    segments = F.filter(F.split("formatted", r"<\|turn\|>"), lambda _, i: i > 0)
    turn = lambda s: F.struct(
        unescape(F.substring_index(s, TEXT, 1)).alias("role"),
        unescape(F.substring_index(F.substring_index(s, TEXT, -1), END, 1)).alias("text"))
    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.withColumns({"turns": F.transform(segments, turn), "loss_texts": masked})


def conversation_digests(messages: DataFrame) -> DataFrame:
    """Digest columns of the registered query, read back from the formatted text."""
    back = read_back(format_conversations(messages))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
