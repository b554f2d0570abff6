"""Exact top-k inner products by columnar branch-and-bound.

Vectors are turned into integers and dealt into blocks of queries and blocks of candidates. Spark meets
each query block with each candidate block; inside a task the candidates lie in vertical layout (one row
per dimension), scores are accumulated a block of dimensions at a time, and after each block the candidates
whose score so far plus the most that the remaining dimensions can add (Cauchy-Schwarz on the remaining
mass) stays under every query's k-th best so far are taken out of the columns. Survivors end with exact
scores. The k best of each block pair are merged per query.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no part; rows that repeat
both id and vector count once; a candidate with the query's own id is not returned; ties go to the smaller
id; null ids take no part; vectors of other lengths than the query's are not candidates for it; an empty
table gives an empty table. Other columns are ignored. Scores are exact below 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

SCALE = 64
QUERY_BLOCK = 512
CANDIDATE_BLOCK = 8192
DIMENSION_BLOCK = 16


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """``(id, dims, v)`` with ``v = floor(scale * x)`` for the usable vectors."""
    x = F.col(vec_col)
    usable = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return (df.filter(F.col(id_col).isNotNull() & usable)
            .select(F.col(id_col).cast("long").alias("id"), F.size(x).alias("dims"), v.alias("v")).dropDuplicates())


def _dimension_order(c: np.ndarray) -> np.ndarray:
    """Dimensions with most mass first, so that little is left early."""
    return np.argsort(-np.square(c, dtype=np.float64).sum(axis=1), kind="stable")


def _mass_left(a: np.ndarray) -> np.ndarray:
    """Row d: length of each column's part from dimension d on."""
    return np.sqrt(np.cumsum(np.square(a.astype(np.float64))[::-1], axis=0))[::-1]


def best_of_block(q_ids, q, c_ids, c, k, floor=None):
    """Exact k best candidates for each query. ``q``: queries x dims, ``c``: dims x candidates.

    Returns (query row, candidate id, score) arrays. ``floor`` holds a k-th best score known before.
    """
    biggest = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    kind = np.float32 if biggest < 2**24 else np.float64
    order = _dimension_order(c)
    # sums of integer products are exact below 2**24 in single, below 2**53 in double precision
    q, c = q[:, order].astype(kind), c[order].astype(kind)
    bound = np.full(len(q), -np.inf) if floor is None else floor
    # a first look at a few candidates gives each query a bound to prune with
    if c.shape[1] > 4 * k:
        first = q @ c[:, : 4 * k]
        own = q_ids[:, None] == c_ids[None, : 4 * k]
        first = np.where(own, -np.inf, first)
        bound = np.maximum(bound, -np.partition(-first, k - 1, axis=1)[:, k - 1])
    qt, ct = _mass_left(q.T).T, _mass_left(c)
    score = np.zeros((len(q), c.shape[1]), dtype=kind)
    for at in range(0, len(c), DIMENSION_BLOCK):
        to = min(at + DIMENSION_BLOCK, len(c))
        score += q[:, at:to] @ c[at:to]
        if to < len(c) and np.isfinite(bound).any():
            most = qt[:, to].astype(kind)[:, None] * ct[to].astype(kind)[None, :] * kind(1.001) + score
            alive = (most >= bound.astype(kind)[:, None] - 1).any(axis=0)
            if alive.mean() < 0.8:
                c, ct, c_ids, score = c[:, alive], ct[:, alive], c_ids[alive], score[:, alive]
    rows, ids, scores = [], [], []
    for i in range(len(q)):
        s = score[i]
        ok = c_ids != q_ids[i]
        if ok.sum() > k:
            kth = -np.partition(-s[ok].astype(np.float64), k - 1)[k - 1]
            ok &= s >= kth
        j = np.flatnonzero(ok)
        j = j[np.lexsort((c_ids[j], -s[j].astype(np.float64)))][:k]
        rows.append(np.full(len(j), i))
        ids.append(c_ids[j])
        scores.append(s[j])
    return np.concatenate(rows), np.concatenate(ids), np.concatenate(scores)


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.int64) for x in values])


def exact_top_k(df: DataFrame, id_col: str, vec_col: str, is_query, k: int = 20, scale: int = SCALE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k largest integer inner products of each query.

    ``is_query`` is a condition on the column ``id``. Each candidate block travels once per query block; nothing is
    broadcast or collected, and a task holds one block of either side.
    """
    vectors = integer_vectors(df, id_col, vec_col, scale)
    # only block numbers depend on the counts, never which rows meet
    counts = vectors.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    n_q = max(1, -(-counts["q"] // QUERY_BLOCK))
    n_c = max(1, -(-counts["n"] // CANDIDATE_BLOCK))
    block = lambda salt, n: F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(n)).cast("int")
    packed = vectors.select("id", "dims", "v")
    qs = (packed.filter(is_query).withColumn("qb", block(1, n_q))
          .withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1)))).withColumn("is_q", F.lit(True)))
    cs = (packed.withColumn("cb", block(2, n_c))
          .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))).withColumn("is_q", F.lit(False)))
    both = qs.unionByName(cs)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        mine = pdf["is_q"].to_numpy()
        q, c = pdf[mine], pdf[~mine]
        if len(q) and len(c):
            ids, c_ids, cm = q["id"].to_numpy(), c["id"].to_numpy(), np.ascontiguousarray(_matrix(c["v"]).T)
            r, i, s = best_of_block(ids, _matrix(q["v"]), c_ids, cm, k)
            out.append(pd.DataFrame({"query_id": ids[r], "vec_id": i, "score": s.astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    part = both.groupBy("qb", "cb", "dims").applyInPandas(meet, "query_id long, vec_id long, score long")
    # a query keeps k rows of each candidate block; an aggregate with partial results merges them
    best = F.expr(f"slice(array_sort(collect_list(struct(-score as s, vec_id as i))), 1, {k})").alias("best")
    first = part.groupBy("query_id").agg(best)
    return (first.select("query_id", F.posexplode("best").alias("r", "b"))
            .select("query_id", (F.col("r") + 1).cast("int").alias("rank"), F.col("b.i").alias("vec_id"), (-F.col("b.s")).alias("score")))
