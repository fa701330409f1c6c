"""Streams into a store, and queries over arrivals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nearfield.operators.knn import knn_join
from nearfield.operators.sampling import hash_sample
from nearfield.sources import files
from nearfield.sources.store import VectorStore


#: After so many micro-batches the kept order is written as one part.
ORDER_PARTS = 32


def _once(store: VectorStore, name: str, act: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """act on each micro-batch once: the number of the last one is kept beside the store, so that a replay is skipped."""
    at = f"{store.root}/streams/{name}.json"

    def each(batch: DataFrame, number: int) -> None:
        last = files.read_json(store.spark, at)["batch"] if files.exists(store.spark, at) else -1
        if number <= last:
            return
        act(batch)
        files.write_json(store.spark, at, {"batch": number})

    return each


def _start(stream: DataFrame, name: str, store: VectorStore, each: Callable[[DataFrame, int], None], trigger: dict) -> StreamingQuery:
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{store.root}/streams/{name}").trigger(**trigger).start()


def ingest(stream: DataFrame, store: VectorStore, name: str = "ingest", **trigger) -> StreamingQuery:
    """Appends a stream of records (id, vector, metadata?). Records whose id the store has already are left out, so a batch that
    failed half-way can be run again."""

    def act(batch: DataFrame) -> None:
        fresh = batch.dropDuplicates(["id"]).join(store.live().select("id"), "id", "left_anti")
        store.add_batch(fresh)

    return _start(stream, name, store, _once(store, name, act), trigger or {"availableNow": True})


def upsert(stream: DataFrame, store: VectorStore, order_col: str, name: str = "upsert", **trigger) -> StreamingQuery:
    """Upserts a stream of records; of one id the record of the largest order_col counts, in whatever micro-batch it comes (of
    equals the latest to arrive; a null is smaller than any). The order of what was taken is kept beside the store, (id, order_col) in a
    segment for each micro-batch."""
    at = f"{store.root}/streams/{name}-order"

    def act(batch: DataFrame) -> None:
        others = [c for c in batch.columns if c not in ("id", order_col)]
        # max_by passes over nulls: a struct that begins with whether there is a value doesn't
        by = F.struct(F.col(order_col).isNotNull(), order_col)
        last = batch.groupBy("id").agg(F.max_by(F.struct(order_col, *others), by).alias("r")).select("id", "r.*")
        parts = files.names(store.spark, at)
        if parts:
            taken = store.spark.read.parquet(*(f"{at}/{p}" for p in parts)).groupBy("id").agg(F.max(order_col).alias("nf_taken"))
            late = F.col("nf_taken").isNotNull() & (F.col(order_col).isNull() | (F.col(order_col) < F.col("nf_taken")))
            last = last.join(taken, "id", "left").where(~late).drop("nf_taken")
        last = last.persist()
        store.upsert(last.drop(order_col))
        number = int(parts[-1]) + 1 if parts else 0
        last.select("id", order_col).write.mode("overwrite").parquet(f"{at}/{number:08d}")
        last.unpersist()
        if len(parts) >= ORDER_PARTS:  # as one again; the parts are read by no one else
            merged = store.spark.read.parquet(f"{at}/*").groupBy("id").agg(F.max(order_col).alias(order_col))
            merged.write.mode("overwrite").parquet(f"{at}/{number + 1:08d}")
            for p in files.names(store.spark, at)[:-1]:
                files.remove(store.spark, f"{at}/{p}")

    return _start(stream, name, store, _once(store, name, act), trigger or {"availableNow": True})


def refreshing(store: VectorStore, every: int = 1) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends, and rebuilds the index every so many micro-batches instead of at the next query."""

    def each(batch: DataFrame, number: int) -> None:
        store.add_batch(batch)
        if number % every == every - 1:
            store.build()

    return each


def running_sample(stream: DataFrame, store: VectorStore, cap: int, name: str = "sample", **trigger) -> StreamingQuery:
    """Keeps under <root>/samples/<name> the sample that hash_sample() would take of all records so far."""

    def act(batch: DataFrame) -> None:
        at = f"{store.root}/samples/{name}"
        kept = files.names(store.spark, at)
        rows = batch.select("id", "vector")
        if kept:
            rows = rows.unionByName(store.spark.read.parquet(f"{at}/{kept[-1]}"))
        rows = rows.dropDuplicates(["id"])  # a replay after a crash, or an id that comes again
        hash_sample(rows, cap).write.mode("overwrite").parquet(f"{at}/{len(kept):08d}")

    return _start(stream, name, store, _once(store, name, act), trigger or {"availableNow": True})


def standing_query(stream: DataFrame, corpus: DataFrame, k: int, sink: Callable[[DataFrame, int], None], metric: str = "cosine", id_col: str = "id") -> Callable[[DataFrame, int], None]:
    """For foreachBatch over a stream of queries (q_id, q): the nearest rows of corpus for each arrival go to sink."""

    def each(batch: DataFrame, number: int) -> None:
        sink(knn_join(batch, corpus, k, metric, id_col), number)

    return each
