"""Inverted-file index: clusters of the corpus, of which a query scans the nearest."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.functions.prng import mulberry32
from nearfield.operators import sweep
from nearfield.operators.knn import knn_join, matrix, ranked, top_of
from nearfield.operators.sampling import by_hash, evenly_spaced, hash_sample
from nearfield.operators.sweep import BROADCAST_BYTES

ITERATIONS = 8
SAMPLE_SIZE = 50_000
TUNE_QUERIES, TUNE_K = 32, 10
#: Training of up to so many multiplications a round runs on the driver; beyond it each round is a job.
LOCAL_WORK = 20_000_000_000


def choose_nlist(rows: int, nlist: int | None = None) -> int:
    """An explicit number within 1 and rows; else the root of rows, from 16 to 4096 and at most rows."""
    if nlist is not None:
        return max(1, min(nlist, rows))
    return max(1, min(rows, max(16, min(4096, round(math.sqrt(rows))))))


def default_nprobe(nlist: int) -> int:
    return max(1, math.floor(0.05 * nlist + 0.5))


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def nearest_centroid(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroid of the largest dot product; the first of equals."""
    step = max(1, sweep.CELLS // len(centroids))
    return np.concatenate([(x[a : a + step] @ centroids.T).argmax(axis=1) for a in range(0, max(1, len(x)), step)])


def lloyd_sums(sample: DataFrame, centroids: np.ndarray, vector_col: str = "vector") -> DataFrame:
    """(cluster, n, total ARRAY<DOUBLE>): one assignment step, summed in each task and then by cluster."""
    sent = sample.sparkSession.sparkContext.broadcast(centroids)
    schema = "cluster int, n long, total array<double>"

    def out(sums: np.ndarray, n: np.ndarray, which: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(which.astype(np.int32)), pa.array(n[which].astype(np.int64)), pa.array(list(sums[which]), pa.list_(pa.float64()))], ["cluster", "n", "total"]
        )

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        sums, n = np.zeros(c.shape), np.zeros(len(c), np.int64)
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0))
                at = nearest_centroid(x, c)
                np.add.at(sums, at, x)
                n += np.bincount(at, minlength=len(c))
        if n.any():
            yield out(sums, n, np.flatnonzero(n))

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for b in batches:
            for k, n, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                have = found.setdefault(k, [0, 0.0])
                have[0] += n
                have[1] = have[1] + np.array(t)
        if found:
            ks = sorted(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ks, pa.int32()), pa.array([found[k][0] for k in ks], pa.int64()), pa.array([found[k][1] for k in ks], pa.list_(pa.float64()))], ["cluster", "n", "total"]
            )

    return sample.select(vector_col).mapInArrow(partial, schema).repartition("cluster").mapInArrow(final, schema)


def train_centroids(sample: DataFrame, nlist: int, id_col: str = "id", vector_col: str = "vector", iterations: int = ITERATIONS, seed: int = 1) -> np.ndarray:
    """Spherical k-means: seeded random rows as centroids, then `iterations` rounds of assignment by dot product
    and normalised means; an empty cluster is seeded anew. sample must be bounded (hash_sample): its rows in the order of their
    hash are what the seeds pick from, so the result is the same at any partitioning up to rounding."""
    sample = sample.select(id_col, vector_col).persist()
    n, d = sample.agg(F.count("*"), F.max(F.size(vector_col))).first()
    if n == 0:
        raise ValueError("no rows to train on")
    order = by_hash(id_col)
    if n * nlist * d <= LOCAL_WORK:
        x = matrix(sample.orderBy(*order).select(vector_col).toArrow().column(0))
        rows = lambda which: x[which]

        def step(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = nearest_centroid(x, centroids)
            sums = np.zeros_like(centroids)
            np.add.at(sums, at, x)
            return sums, np.bincount(at, minlength=nlist)
    else:
        placed = sample.withColumn("nf_at", F.row_number().over(Window.orderBy(*order)) - 1)

        def rows(which: list[int]) -> np.ndarray:
            found = {r[0]: r[1] for r in placed.where(F.col("nf_at").isin(sorted(set(which)))).select("nf_at", vector_col).collect()}
            return np.array([found[i] for i in which], np.float64)

        def step(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            sums, count = np.zeros_like(centroids), np.zeros(nlist, np.int64)
            for r in lloyd_sums(sample, centroids, vector_col).collect():  # nlist rows
                sums[r["cluster"]], count[r["cluster"]] = r["total"], r["n"]
            return sums, count

    draw = mulberry32(seed)
    centroids = unit_rows(rows([int(draw() * n) for _ in range(nlist)]))
    for i in range(iterations):
        sums, count = step(centroids)
        fresh = sums / np.maximum(count, 1)[:, None]
        if not count.all():
            draw = mulberry32(seed + i + 1)
            fresh[count == 0] = rows([int(draw() * n) for _ in range(int((count == 0).sum()))])
        centroids = unit_rows(fresh)
    sample.unpersist()
    return centroids


def kmeans(x: np.ndarray, k: int, seed: int = 1, iterations: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, assignment) of a small matrix: D² seeding, squared distances, means, until nothing moves."""
    x, draw = np.asarray(x, np.float64), mulberry32(seed)
    k = max(1, min(k, len(x)))
    c = [x[int(draw() * len(x))]]
    d = ((x - c[0]) ** 2).sum(1)
    while len(c) < k:
        total = d.sum()
        at = int(np.searchsorted(np.cumsum(d), draw() * total, side="right")) if total > 0 else int(draw() * len(x))
        c.append(x[min(at, len(x) - 1)])
        d = np.minimum(d, ((x - c[-1]) ** 2).sum(1))
    c, old = np.array(c), None
    for _ in range(iterations):
        a = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        if old is not None and np.array_equal(a, old):
            break
        old = a
        c = np.array([x[a == i].mean(0) if (a == i).any() else c[i] for i in range(k)])
    return c, a


def centroid_table(spark: SparkSession, centroids: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centroids)], "cluster int, centroid array<double>")


def assign(vectors: DataFrame, centroids: np.ndarray, vector_col: str = "vector") -> DataFrame:
    """vectors with the column cluster. Narrow; the centroids go to every task (at most 4096 by default)."""
    names = vectors.columns
    at = names.index(vector_col)
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)
    from pyspark.sql import types as T

    schema = T.StructType([*vectors.schema.fields, T.StructField("cluster", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = nearest_centroid(matrix(b.column(at)), sent.value) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(c.astype(np.int32))], [*names, "cluster"])

    return vectors.mapInArrow(run, schema)


def write_lists(assigned: DataFrame, path: str) -> DataFrame:
    """The inverted lists as a table partitioned by cluster: a query's scan opens the probed clusters' files only."""
    assigned.repartition("cluster").write.partitionBy("cluster").mode("overwrite").parquet(path)
    return assigned.sparkSession.read.parquet(path)


def list_offsets(assigned: DataFrame) -> DataFrame:
    """(cluster, n, first): list sizes and where each list begins if they lie end to end."""
    sizes = assigned.groupBy("cluster").agg(F.count("*").alias("n"))
    w = Window.orderBy("cluster").rowsBetween(Window.unboundedPreceding, -1)  # one row a cluster
    return sizes.withColumn("first", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long"))


def nearest_clusters(q: np.ndarray, centroids: np.ndarray, nprobe: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, cluster) of each query's nprobe clusters of the largest dot product, the nearest first; ties by cluster."""
    step = max(1, sweep.CELLS // len(centroids))
    found = [top_of(q[a : a + step] @ centroids.T, np.arange(len(centroids)), nprobe) for a in range(0, len(q), step)]
    return np.concatenate([np.zeros(0, np.int64), *(who + i * step for i, (who, _) in enumerate(found))]), np.concatenate([np.zeros(0, np.int64), *(c for _, c in found)])


def probe(queries: DataFrame, centroids: np.ndarray, nprobe: int) -> DataFrame:
    """(q_id, cluster, score, rank): the nprobe nearest clusters of each query. Narrow: the centroids go to every task."""
    sent = queries.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for b in batches:
            q = matrix(b.column(1)) if b.num_rows else np.zeros((0, c.shape[1]))
            who, cluster = nearest_clusters(q, c, nprobe)
            rank = np.arange(len(who)) - np.searchsorted(who, who) + 1
            for a in range(0, len(who), 1 << 18):
                i, j = who[a : a + (1 << 18)], cluster[a : a + (1 << 18)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(i)), pa.array(j.astype(np.int32)), pa.array(sweep.pair_scores("dot", q[i], c[j])), pa.array(rank[a : a + (1 << 18)].astype(np.int32))],
                    ["q_id", "cluster", "score", "rank"],
                )

    return queries.select("q_id", "q").mapInArrow(run, f"q_id {queries.schema['q_id'].dataType.simpleString()}, cluster int, score double, rank int")


def cluster_ranks(queries: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(q_id, ranks ARRAY<INT>): the rank from 1 of every cluster for each query, in the order of the clusters."""
    sent = queries.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        step = max(1, sweep.CELLS // len(c))
        for b in batches:
            for a in range(0, b.num_rows, step):
                part = b.slice(a, step)
                order = np.argsort(-(matrix(part.column(1)) @ c.T), axis=1, kind="stable")
                ranks = np.empty(order.shape, np.int32)
                np.put_along_axis(ranks, order, np.arange(1, len(c) + 1, dtype=np.int32)[None], 1)
                ends = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * len(c))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(ranks.ravel()))], ["q_id", "ranks"])

    return queries.select("q_id", "q").mapInArrow(run, f"q_id {queries.schema['q_id'].dataType.simpleString()}, ranks array<int>")


class Payload(NamedTuple):
    """How the rows of the lists are kept: their columns, and n of these, of a batch or as bytes of a block, as a matrix."""

    columns: list[str]
    matrix: Callable[[list, int], np.ndarray]


def vectors_payload(lists: DataFrame, vector_col: str = "vector") -> Payload:
    return Payload([vector_col], sweep.vectors_at(0, lists, vector_col))


def list_search(
    k: int, lists: DataFrame, centroids: np.ndarray, nprobe: int, payload: Payload, asked: Callable = lambda q: q, exact: Callable | None = None, factor: int = 1
) -> tuple[sweep.Search, list[str], str | None]:
    """The search, the columns of the lists that it needs, and by which a block's rows are sorted. With all lists probed clusters don't matter."""
    if nprobe >= len(centroids):
        return sweep.Search(k, "dot", payload.matrix, asked, exact, factor), payload.columns, None
    return (
        sweep.Search(
            k, "dot", lambda c, n: payload.matrix(c[1:], n), asked, None if exact is None else lambda c, n: exact(c[1:], n), factor,
            lambda c, n: sweep.numbers_of(c[0], np.int32), lambda q: nearest_clusters(asked(q), centroids, nprobe),
        ),
        ["cluster", *payload.columns], "cluster",
    )


def search(
    queries: DataFrame, lists: DataFrame, centroids: np.ndarray, k: int, nprobe: int, id_col: str = "id", vector_col: str = "vector",
    broadcast_bytes: int = BROADCAST_BYTES, payload: Payload | None = None,
) -> DataFrame:
    """(q_id, id, score, rank): the k best by dot product of the rows in each query's nprobe nearest clusters; fewer than k if these
    hold fewer. payload: what the lists hold, by default vectors in vector_col.

    With a query side of at most broadcast_bytes, hits and all, the tasks get the queries and only probed partitions are read; else
    blocks of queries meet blocks of rows, cluster by cluster. nprobe = all clusters is exact."""
    nprobe = max(1, min(nprobe, len(centroids)))
    how, columns, sort = list_search(k, lists, centroids, nprobe, payload or vectors_payload(lists, vector_col))

    def probed(rows: DataFrame, q: np.ndarray) -> DataFrame:
        return rows.where(F.col("cluster").isin(np.unique(nearest_clusters(q, centroids, nprobe)[1]).tolist()))

    return ranked(sweep.run_search(queries, lists, how, id_col, columns, broadcast_bytes, sort, probed if sort else None), k, "q_id", id_col)


def recall_curve(queries: DataFrame, assigned: DataFrame, centroids: np.ndarray, k: int = TUNE_K, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(nprobe, hits, recall) for each nprobe up to the clusters: the share of the true k neighbours (the query's own row left
    out) that lie in the nprobe nearest clusters. One exact search covers every nprobe."""
    truth = knn_join(queries, assigned, k, "dot", id_col, vector_col, exclude_self=True).select("q_id", id_col)
    needed = truth.join(assigned.select(id_col, "cluster"), id_col).join(cluster_ranks(queries, centroids), "q_id")
    hist = needed.groupBy(F.element_at("ranks", F.col("cluster") + 1).alias("nprobe")).agg(F.count("*").alias("n"))
    every = queries.sparkSession.range(1, len(centroids) + 1).select(F.col("id").cast("int").alias("nprobe"))
    w = Window.orderBy("nprobe")  # one row a cluster
    full = every.join(hist, "nprobe", "left").withColumn("hits", F.sum(F.coalesce("n", F.lit(0))).over(w))
    total = F.max("hits").over(Window.partitionBy())
    return full.withColumn("recall", F.when(total > 0, F.col("hits") / total).otherwise(F.lit(1.0))).select("nprobe", "hits", "recall")


def choose_nprobe(curve: DataFrame, target: float) -> tuple[int, float]:
    """The smallest nprobe whose recall is at least the target (taken within 0 and 1)."""
    target = min(1.0, max(0.0, target))
    best = curve.where(F.col("recall") >= target).orderBy("nprobe").select("nprobe", "recall").first()
    return (int(best[0]), float(best[1])) if best else (int(curve.count()), 1.0)


def tune(assigned: DataFrame, centroids: np.ndarray, target: float, id_col: str = "id", vector_col: str = "vector", sample_size: int = SAMPLE_SIZE) -> tuple[int, float]:
    """(nprobe, estimated recall) for the target, from up to 32 rows of the sample as queries."""
    rows = assigned.count()
    k = min(TUNE_K, rows - 1)
    if k < 1 or len(centroids) <= 1:
        return 1, 1.0
    filled = min(rows, sample_size)
    w = Window.orderBy(*by_hash(id_col))  # over the bounded sample
    at = hash_sample(assigned.select(id_col, vector_col), filled, id_col).withColumn("nf_at", F.row_number().over(w) - 1)
    picks = at.where(F.col("nf_at").isin(evenly_spaced(filled, TUNE_QUERIES))).select(F.col(id_col).alias("q_id"), F.col(vector_col).alias("q"))
    return choose_nprobe(recall_curve(picks, assigned, centroids, k, id_col, vector_col), target)
