"""Fill-in-middle forms by a ``pyarrow.compute`` pipeline, and the way back.

A text is a sequence of units: runs of the letters A-Z and a-z, and single other code points. Per batch the units become list arrays (a regular
expression puts a byte that UTF-8 never uses behind each, then a split), are flattened beside their parent indices, numbered, and filtered by role
(before the first cut, between the cuts, behind the second); the lists are built again by role and joined with the sentinels. Only
the two cuts and the form come from Spark, as columns over a digest of the id, so that a lost task is repeated alike.

Output: ``plain``, the text; ``psm``, ``<P>`` prefix ``<S>`` suffix ``<M>`` middle; ``spm``, ``<S>`` suffix ``<P>`` prefix ``<M>`` middle. A text that
holds a sentinel stays plain, and no piece of another text can complete one across a border (no sentinel overlaps another), so the first
sentinel of each kind is always the one that was put there.

Defined results: null text counts as empty, and an empty text is plain; a null id is drawn like an empty one; repeated rows come out alike; very long
texts are worked on alone, whole; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import text_slices

UNIT = rb"([A-Za-z]+|[\x00-\x40\x5b-\x60\x7b-\x7f]|[\xc0-\xff][\x80-\xbf]*)"
BREAK = b"\xff"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20  # of 100
WIDE = pa.large_binary()


def draws(id_col: str, salt: str) -> list[Column]:
    """Four numbers of 32 bits, ``h1`` to ``h4``, from a digest of the id."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def _rest(a: pa.Array, b) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def _joined(*parts) -> pa.Array:
    return pc.binary_join_element_wise(*(pa.scalar(p.encode(), WIDE) if isinstance(p, str) else p for p in parts), pa.scalar(b"", WIDE))


def _text(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_string())


def cut_units(text: pa.Array, h1: pa.Array, h2: pa.Array) -> tuple[pa.Array, list[pa.Array]]:
    """Number of units of each text, and its prefix, middle and suffix as bytes."""
    parts = pc.split_pattern(pc.replace_substring_regex(text, pattern=UNIT, replacement=rb"\1" + BREAK), BREAK)
    parent, units = pc.list_parent_indices(parts), pc.list_flatten(parts)
    size = pc.list_value_length(parts).cast(pa.int64())  # one more than the units: nothing follows the last break
    before = pc.subtract(pc.cumulative_sum(size), size)
    ordinal = pc.subtract(pa.array(np.arange(len(units))), pc.take(before, parent))
    one, two = _rest(h1, size), _rest(h2, size)
    low, high = pc.min_element_wise(one, two), pc.max_element_wise(one, two)
    from_low, from_high = (pc.greater_equal(ordinal, pc.take(x, parent)) for x in (low, high))
    roles = [(pc.invert(from_low), low), (pc.and_not(from_low, from_high), pc.subtract(high, low)), (from_high, pc.subtract(size, high))]
    out = []
    for mask, count in roles:
        ends = pc.cumulative_sum(count).cast(pa.int32())
        lists = pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), pc.filter(units, mask))
        out.append(pc.binary_join(lists, pa.scalar(b"", WIDE)))
    return pc.subtract(size, 1), out


def rearranged(text: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> list[pa.Array]:
    """``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` of a batch."""
    text = pc.fill_null(text, "").cast(WIDE)
    n, (prefix, middle, suffix) = cut_units(text, h1, h2)
    plain = pc.or_(pc.equal(pc.binary_length(text), 0), pc.greater_equal(_rest(h3, 100), PLAIN_FROM))
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        plain = pc.or_(plain, pc.match_substring(text, sentinel.encode()))
    spm = pc.less(_rest(h4, 100), SPM_BELOW)
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    moved = pc.if_else(spm, _joined(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle), _joined(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(_text(x)).cast(pa.int64())) for x in (prefix, middle)]
    return [n, form, *chars, pc.if_else(plain, text, moved).cast(pa.string())]


def restored(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts behind ``output``."""
    plain, spm = pc.equal(form, "plain"), pc.equal(form, "spm")
    shown = pc.if_else(plain, PREFIX + SUFFIX + MIDDLE, output).cast(WIDE)  # plain rows are not taken apart
    halves = lambda x, at: [pc.list_element(pc.split_pattern(x, at.encode(), max_splits=1), i) for i in (0, 1)]
    rest, middle = halves(shown, MIDDLE)
    found = []
    for rows, first, second in ((spm, SUFFIX, PREFIX), (pc.invert(spm), PREFIX, SUFFIX)):
        moved = pc.if_else(rows, rest, pa.scalar((first + second).encode(), WIDE))
        found.append(halves(halves(moved, first)[1], second))
    (suffix_s, prefix_s), (prefix_p, suffix_p) = found
    prefix, suffix = pc.if_else(spm, prefix_s, prefix_p), pc.if_else(spm, suffix_s, suffix_p)
    return pc.if_else(plain, output.cast(WIDE), _joined(prefix, middle, suffix)).cast(pa.string())


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt: str = "1:") -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` of every text."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches):
        for rows, _, _ in text_slices(batches):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *rearranged(rows.column("text"), *(rows.column(f"h{i}") for i in range(1, 5)))], names)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *draws(id_col, salt))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(df: DataFrame, output_col: str = "output", form_col: str = "form", restored_col: str = "restored") -> DataFrame:
    """``df`` with a new column of the texts rebuilt from output and form; a null output or form gives null."""
    columns = df.columns

    def run(batches):
        for rows, _, _ in text_slices(batches, output_col):
            yield pa.RecordBatch.from_arrays([*rows.columns, restored(rows.column(output_col), rows.column(form_col))], [*columns, restored_col])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, `{restored_col}` string")
