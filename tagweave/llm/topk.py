"""Exact top-k inner products by the threshold algorithm (operator 5).

Vectors and queries are dealt to cells of one vector block and one query
block (sizes bounded by ``VECTORS`` and ``QUERIES``; hashed ids, so no block is
hot).  A cell keeps, per dimension, its vectors sorted by value.  For a query it
walks all lists downwards in step (upwards where the query's weight is
negative), scores every vector when it first appears, and stops when the bound
of all unseen vectors — the sum of the weighted values at the current depth —
is below the k-th best score.  Equal bounds go on, so ties are complete.  The k
best of each cell are then ranked per query.

Scores are exact: components are integers, and sums of products stay within
2**53 in double arithmetic, else the cell uses Python integers.

Defined cases: vectors that are null or hold null, NaN or infinite components,
and rows without an id, take no part; shorter vectors count as padded with
zeros; rows that repeat an id count once (the smallest vector); no vectors or
no queries give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

VECTORS, QUERIES = 4096, 1024
SCALE = 256


def quantised(vec: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null when the vector takes no part."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vec.isNotNull() & ~bad, F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(arrays, width: int) -> np.ndarray:
    out = np.zeros((len(arrays), width), dtype=np.int64)
    for i, a in enumerate(arrays):
        out[i, :len(a)] = a
    return out


def threshold_topk(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """Threshold algorithm in one block: lists of (query id, vector id, score); also the rows scored."""
    out, scored = [], 0
    order_of_ids = np.argsort(ids, kind="stable")
    ids, vectors = ids[order_of_ids], vectors[order_of_ids]
    n, width = vectors.shape
    top = np.abs(vectors).max(initial=0) * np.abs(queries).max(initial=0) * max(width, 1)
    kind = np.float64 if float(top) < 2.0 ** 53 else object
    order = np.argsort(-vectors, axis=0, kind="stable")
    down = np.take_along_axis(vectors, order, axis=0)                   # each list, largest first
    rank = np.empty((n, width), dtype=np.int32)
    np.put_along_axis(rank, order, np.arange(n, dtype=np.int32)[:, None] * np.ones((1, width), dtype=np.int32), axis=0)
    depths = [d for d in (8 << i for i in range(40)) if d < n] + [n]
    at = np.array(depths) - 1
    values, small = vectors.astype(kind), np.int16 if n < 1 << 15 else np.int32
    # rows: dimensions, so that one query's lists are contiguous
    rank_down, rank_up = rank.T.astype(small), (n - 1 - rank).T.astype(small)
    for qid, q in zip(query_ids.tolist(), queries):
        weight = q.astype(kind)
        plus, minus = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        bound = down[at][:, plus].astype(kind) @ weight[plus] + down[n - 1 - at][:, minus].astype(kind) @ weight[minus]
        first = np.full(n, n, dtype=small)
        if len(plus):
            first = np.minimum(first, rank_down[plus].min(axis=0))
        if len(minus):
            first = np.minimum(first, rank_up[minus].min(axis=0))
        if not len(plus) and not len(minus):
            first[:] = 0
        best_id, best = np.empty(0, dtype=np.int64), np.empty(0, dtype=kind)
        before = 0
        for d, limit in zip(depths, bound):
            new = np.flatnonzero((first >= before) & (first < d))
            new = new[ids[new] != qid]
            scored += len(new)
            best_id, best = np.concatenate([best_id, ids[new]]), np.concatenate([best, values[new] @ weight])
            keep = np.lexsort((best_id, -best))[:k]
            best_id, best, before = best_id[keep], best[keep], d
            if len(best) == k and best[-1] > limit:
                break
        out += [(qid, int(i), int(s)) for i, s in zip(best_id, best)]
    return out, scored


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query with all other vectors."""
    def clean(df):
        return (df.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vec_col)).alias("v")).dropna()
                .groupBy("id").agg(F.min("v").alias("v")))

    v, q = cut_lineage(clean(vectors)), cut_lineage(clean(queries))
    n_v, n_q = max(1, -(-v.count() // VECTORS)), max(1, -(-q.count() // QUERIES))
    v = (v.withColumn("a", F.pmod(F.xxhash64("id"), F.lit(n_v)))
         .withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long")))))
    q = (q.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n_q)))
         .withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_v - 1).cast("long")))))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=names).astype("int64")
        width = max(max(map(len, left["v"])), max(map(len, right["v"])), 1)
        rows, _ = threshold_topk(left["id"].to_numpy(), _matrix(left["v"], width), right["id"].to_numpy(),
                                 _matrix(right["v"], width), k)
        return pd.DataFrame(rows, columns=names).astype("int64")

    parts = v.groupBy("a", "b").cogroup(q.groupBy("a", "b")).applyInPandas(cell, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
