"""Exact nearest neighbours: of one vector, and as a join of many."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions import vectors as V
from nearfield.operators import sweep
from nearfield.operators.sweep import BROADCAST_BYTES

def matrix(column: pa.Array, dimension: int | None = None) -> np.ndarray:
    """A list<float> column as rows of doubles; all lists must have one length and no nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten()
    if n == 0:
        return np.zeros((0, dimension or 0))
    if column.null_count or flat.null_count or len(flat) % n or (dimension is not None and len(flat) != n * dimension):
        raise ValueError("vectors must be of one dimension, without nulls")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def top_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, corpus position) of each row's k best by score, ties by the smaller id. NaN is never best."""
    n = scores.shape[1]
    scores = np.where(np.isnan(scores), -np.inf, scores)
    if n > k:
        # the k-th score, then all that tie with it: which of them stay is up to the id
        kth = np.partition(scores, n - k, axis=1)[:, n - k]
        q, c = np.nonzero(scores >= kth[:, None])
    else:
        q, c = np.indices(scores.shape).reshape(2, -1)
    order = np.lexsort((ids[c], -scores[q, c], q))
    q, c = q[order], c[order]
    first = np.searchsorted(q, np.arange(scores.shape[0]))
    keep = np.arange(len(q)) - first[q] < k
    q, c = q[keep], c[keep]
    real = scores[q, c] > -np.inf
    return q[real], c[real]


def nearest(corpus: DataFrame, query: Sequence[float], k: int = 10, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector", native: bool = False) -> DataFrame:
    """corpus's k rows of the best score (column score, best first; ties by id) for one vector.

    For cosine the vectors are taken as normalised, and the query is normalised here. k <= 0 gives no rows. Only the k best of
    each partition are sent on. native keeps to expressions (TakeOrderedAndProject); the default scores Arrow batches
    with NumPy, which is faster and gives the same."""
    q = np.asarray(query, np.float64)
    if metric == "cosine" and (n := np.linalg.norm(q)) > 0:
        q = q / n
    if k <= 0:
        return corpus.withColumn("score", F.lit(0.0)).limit(0)
    if native:
        scored = corpus.withColumn("score", V.score(metric, F.col(vector_col), V.vector_literal(q)))
        return scored.where(~F.isnan("score")).orderBy(F.desc("score"), F.asc(id_col)).limit(k)
    one = corpus.sparkSession.range(1).select(F.lit(0).cast("long").alias("q_id"), F.lit([float(x) for x in q]).cast("array<double>").alias("q"))
    hits = knn_join(one, corpus.select(id_col, vector_col), k, metric, id_col=id_col, vector_col=vector_col, normalize_queries=False)
    hits = hits.select(F.col(id_col).alias("nf_hit"), "score")
    return (
        corpus.join(F.broadcast(hits), corpus[id_col] == hits["nf_hit"])  # k rows
        .drop("nf_hit").orderBy(F.desc("score"), F.asc(id_col)).limit(k)
    )


def knn_join(
    queries: DataFrame, corpus: DataFrame, k: int = 10, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector",
    exclude_self: bool = False, normalize_queries: bool = True, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(q_id, id_col, score, rank): for each row (q_id, q) of queries its k best rows of corpus, ranked from 1; ties by id.

    A task multiplies blocks of corpus vectors by the queries, keeps the k best a query and sends them on at its end; a window picks
    the k best of these. The queries are sent to the tasks if they and their hits take at most broadcast_bytes; else both sides are
    packed in blocks that meet in a Cartesian product, so neither has to fit anywhere. exclude_self leaves out pairs of equal q_id and id. Vectors must have one
    dimension and no nulls (the task fails otherwise); a NaN score is never a hit; empty sides give no rows."""
    if metric not in V.METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {V.METRICS}")

    def unit(m: np.ndarray) -> np.ndarray:
        if not (normalize_queries and metric == "cosine"):
            return m
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(n > 0, n, 1)

    search = sweep.Search(k + exclude_self, "l2" if metric == "l2" else "dot", sweep.vectors_at(0, corpus, vector_col), unit)
    partial = sweep.run_search(queries, corpus, search, id_col, [vector_col], broadcast_bytes)
    if exclude_self:
        partial = partial.where(~F.col("q_id").eqNullSafe(F.col(id_col)))
    return ranked(partial, k, "q_id", id_col)


def ranked(hits: DataFrame, k: int, q_col: str = "q_id", id_col: str = "id") -> DataFrame:
    """hits with rank from 1 by score, ties by id, up to k for each query."""
    w = Window.partitionBy(q_col).orderBy(F.desc("score"), F.asc(id_col))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_join_native(queries: DataFrame, corpus: DataFrame, k: int = 10, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """knn_join() by expressions alone (nested-loop join, window group limit): the semantics in Spark's own terms."""
    q = queries.select("q_id", (V.normalize(F.col("q")) if metric == "cosine" else F.col("q")).alias("q"))
    scored = q.crossJoin(corpus.select(id_col, vector_col)).select("q_id", id_col, V.score(metric, F.col("q"), F.col(vector_col)).alias("score"))
    return ranked(scored, k, "q_id", id_col)


def with_threshold(hits: DataFrame, least: float) -> DataFrame:
    """Hits of at least that score."""
    return hits.where(F.col("score") >= least)


def recall(truth: DataFrame, found: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """(recall): the share of the true neighbours that were found, over k for each query of truth."""
    n = truth.select("q_id").distinct().agg(F.count("*").alias("n"))
    hit = truth.join(found, ["q_id", id_col], "left_semi").agg(F.count("*").alias("hit"))
    return hit.crossJoin(n).select((F.col("hit") / (F.col("n") * k)).alias("recall"))
