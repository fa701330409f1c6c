"""The vector store: records in immutable segments, with deletes, upserts, indexes and snapshots."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.functions import quant
from nearfield.functions import vectors as V
from nearfield.operators import hnsw, ivf, knn, quantized
from nearfield.operators.embedding import Embedder, embed_column
from nearfield.operators.predicate import compile_filter
from nearfield.sources import files, snapshot

#: Up to so many records that meet a predicate are scored exactly, whatever the index.
EXACT_ROWS = 4096
_ROW = "id string, vector array<float>, metadata string"


@dataclass(frozen=True)
class Config:
    """dimension and metric are fixed. normalize: by default for cosine. quant_bits: 0, 8, 4 or 1. ann: None, "ivf" or "hnsw"."""

    dimension: int
    metric: str = "cosine"
    normalize: bool | None = None
    quant_bits: int = 0
    ann: str | None = None
    seed: int = quant.DEFAULT_SEED
    rounds: int = 2
    rerank: bool = True
    rerank_factor: int | None = None
    nlist: int | None = None
    nprobe: int | None = None
    target_recall: float | None = None
    iterations: int = ivf.ITERATIONS
    sample_size: int = ivf.SAMPLE_SIZE
    ann_seed: int = 1
    m: int = hnsw.M
    ef_construction: int = hnsw.EF_CONSTRUCTION
    ef_search: int = hnsw.EF_SEARCH
    shard_rows: int = hnsw.SHARD_ROWS

    def __post_init__(self):
        if isinstance(self.dimension, bool) or not isinstance(self.dimension, int) or self.dimension < 1:
            raise ValueError("dimension must be a positive whole number")
        if self.metric not in V.METRICS:
            raise ValueError(f"unknown metric {self.metric!r}; one of {V.METRICS}")
        if self.normalize is None:
            object.__setattr__(self, "normalize", self.metric == "cosine")
        if self.quant_bits not in (0, 8, 4, 1):
            raise ValueError(f"{self.quant_bits} bits are not supported; one of 0, 8, 4, 1")
        if self.ann not in (None, "ivf", "hnsw"):
            raise ValueError(f"unknown index {self.ann!r}; None, 'ivf' or 'hnsw'")
        if self.ann == "hnsw" and self.quant_bits:
            raise ValueError("the graph index takes unquantised vectors only")
        if self.metric == "l2" and (self.quant_bits or self.ann == "ivf"):
            raise ValueError("codes and inverted lists take cosine or dot only")
        if self.quant_bits:
            quant.check_width(self.quant_bits, quant.padded_dimension(self.dimension))


def is_supported() -> dict[str, bool]:
    """What the engine has here."""
    return {"arrow": True, "numpy": hasattr(np, "bitwise_count"), "variant": hasattr(F, "try_variant_get")}


class VectorStore:
    """Records (id, vector, metadata) under a folder that all executors reach.

    A batch is a Parquet segment, deletes are segments of tombstoned rows, and a numbered manifest names what counts: a write
    either becomes part of a new manifest or is not seen. Row numbers rise in order of insertion. Metadata is JSON text with
    string, number, boolean and null fields. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str, config: Config, embedder: Embedder | None = None, passphrase: str | None = None, auto_load: bool = True):
        self.spark, self.root, self.config, self.embedder, self.passphrase = spark, root.rstrip("/"), config, embedder, passphrase
        if embedder is not None and embedder.dimension != config.dimension:
            raise ValueError(f"the embedder's dimension is {embedder.dimension}; the store's is {config.dimension}")
        self._state = {"version": 0, "next_row": 0, "segments": [], "tombstones": [], "live": 0}
        self._index: dict[str, Any] = {}
        self._kept: dict[str, Any] = {"key": None, "segments": {}}
        self._last_ms: float | None = None
        held = [n for n in files.names(spark, self.root) if n.startswith("manifest-") and n.endswith(".json")]
        if auto_load and held:
            found = files.read_json(spark, f"{self.root}/{held[-1]}")
            for name in ("dimension", "metric", "normalize"):
                if found["config"][name] != getattr(config, name):
                    raise ValueError(f"the stored {name} is {found['config'][name]!r}, not {getattr(config, name)!r}")
            self._state = found["state"]
            if files.exists(spark, f"{self.root}/index/index.json"):
                kept = files.read_json(spark, f"{self.root}/index/index.json")
                if kept["key"] == self._index_key():
                    self._kept = kept
        elif held:
            self._state["version"] = int(held[-1][9:-5])

    # --- properties

    @property
    def dimension(self) -> int:
        return self.config.dimension

    @property
    def metric(self) -> str:
        return self.config.metric

    @property
    def count(self) -> int:
        return self._state["live"]

    def stats(self) -> dict[str, Any]:
        out = {
            "count": self.count, "deleted": self._state["next_row"] - self.count, "dimension": self.dimension, "metric": self.metric,
            "quant_bits": self.config.quant_bits, "segments": len(self._state["segments"]), "version": self._state["version"], "last_query_ms": self._last_ms,
        }
        for name in ("nlist", "nprobe", "tuned_recall", "shards", "max_level", "indexed_segments"):
            if name in self._index:
                out[name] = self._index[name]
        return out

    # --- reading

    def live(self) -> DataFrame:
        """(row, id, vector, metadata) of all records that are not deleted."""
        if not self._state["segments"]:
            return self.spark.createDataFrame([], "row long, " + _ROW)
        rows = self.spark.read.schema("row long, " + _ROW).parquet(*(f"{self.root}/{s}" for s in self._state["segments"]))
        if not self._state["tombstones"]:
            return rows
        gone = self.spark.read.schema("row long").parquet(*(f"{self.root}/{t}" for t in self._state["tombstones"]))
        return rows.join(gone, "row", "left_anti")

    def get(self, id_: str) -> dict[str, Any] | None:
        """The record with its vector, or None. The id is looked up in the scan's filter."""
        r = self.live().where(F.col("id") == id_).select("id", "vector", "metadata").first()
        return None if r is None else {"id": r.id, "vector": list(r.vector), "metadata": json.loads(r.metadata) if r.metadata else None}

    # --- writing

    def _commit(self, **changes: Any) -> None:
        state = self._state | changes | {"version": self._state["version"] + 1}
        files.write_json(self.spark, f"{self.root}/manifest-{state['version']:08d}.json", {"config": asdict(self.config), "state": state})
        self._state = state

    def _prepare(self, df: DataFrame) -> DataFrame:
        kinds = df.schema
        for name in ("id", "vector"):
            if name not in kinds.names:
                raise ValueError(f"records need a column {name}")
        if "metadata" not in kinds.names:
            meta = F.lit(None).cast("string")
        elif isinstance(kinds["metadata"].dataType, T.StringType):
            meta = F.col("metadata")
        else:
            meta = F.to_json("metadata", {"ignoreNullFields": "false"})
        return df.select(F.col("id").cast("string").alias("id"), F.col("vector").cast("array<float>").alias("vector"), meta.alias("metadata"))

    def _write(self, df: DataFrame, upsert: bool, raw: bool = False) -> int:
        """Writes a checked batch as a segment; nothing of it counts unless all of it is valid."""
        part = f"staging/{uuid.uuid4().hex}"
        # numbered in input order: partitions one after the other, rows within them
        self._prepare(df).withColumn("nf_part", F.spark_partition_id()).withColumn("nf_at", F.monotonically_increasing_id()).write.parquet(f"{self.root}/{part}/rows")
        staged = self.spark.read.parquet(f"{self.root}/{part}/rows")
        try:
            bad = staged.agg(
                F.count("*").alias("n"),
                F.count_if(F.col("id").isNull()).alias("no_id"),
                F.count_if(~V.is_valid(F.col("vector"), self.dimension)).alias("bad_vector"),
                F.count_if(F.col("metadata").isNotNull() & F.get_json_object("metadata", "$").isNull()).alias("bad_metadata"),
            ).first()
            if bad.n == 0:
                return 0
            if bad.no_id or bad.bad_vector or bad.bad_metadata:
                raise ValueError(f"{bad.no_id} records without an id, {bad.bad_vector} vectors not of {self.dimension} finite numbers, {bad.bad_metadata} metadata that are no JSON")
            if not upsert:
                twice = staged.groupBy("id").count().where("count > 1").select("id").first()
                if twice:
                    raise ValueError(f"id {twice[0]!r} is twice in the batch")
            n = bad.n
            if upsert:  # the last of a batch counts, as if the records came one by one
                last = staged.groupBy("id").agg(F.max_by(F.struct("vector", "metadata", "nf_part", "nf_at"), "nf_at").alias("r"))
                last.select("id", "r.*").write.parquet(f"{self.root}/{part}/last")
                staged = self.spark.read.parquet(f"{self.root}/{part}/last")
                n = staged.count()
            tombstones = list(self._state["tombstones"])
            n_replaced = 0
            if upsert and self.count:
                replaced = self.live().select("id", "row").join(staged.select("id"), "id", "left_semi").select("row")
                name = f"tombstones/{uuid.uuid4().hex}"
                replaced.write.parquet(f"{self.root}/{name}")
                n_replaced = self.spark.read.parquet(f"{self.root}/{name}").count()
                tombstones += [name] if n_replaced else []
            elif self.count and (have := self.live().select("id").join(staged.select("id"), "id", "left_semi").first()):
                raise ValueError(f"id {have[0]!r} is in the store")
            # dense numbers in input order: the parts' counts, then the place within the part
            counts = staged.groupBy("nf_part").agg(F.count("*").alias("n"), F.min("nf_at").alias("nf_from"))
            before = F.sum("n").over(Window.orderBy("nf_part").rowsBetween(Window.unboundedPreceding, -1))  # one row a task
            offsets = counts.select("nf_part", "nf_from", F.coalesce(before, F.lit(0)).alias("nf_before"))
            place = F.col("nf_at") - F.col("nf_from")
            if upsert:  # some rows of a part may be gone
                place = F.row_number().over(Window.partitionBy("nf_part").orderBy("nf_at")) - 1
            row = F.lit(self._state["next_row"]) + F.col("nf_before") + place
            vector = V.normalize(F.col("vector")) if self.config.normalize and not raw else F.col("vector")
            name = f"segments/{uuid.uuid4().hex}"
            staged.join(F.broadcast(offsets), "nf_part").select(row.cast("long").alias("row"), "id", vector.alias("vector"), "metadata").write.parquet(f"{self.root}/{name}")
        finally:
            files.remove(self.spark, f"{self.root}/{part}")
        self._commit(
            next_row=self._state["next_row"] + n, segments=[*self._state["segments"], name], tombstones=tombstones, live=self.count + n - n_replaced
        )
        return n_replaced if upsert else n

    def _frame(self, records: DataFrame | Iterable[dict[str, Any]], text: bool = False) -> DataFrame:
        if isinstance(records, DataFrame):
            return records
        rows = []
        for r in records:
            meta = r.get("metadata")
            if meta is not None:
                for k, v in meta.items():
                    if not isinstance(v, (str, int, float, bool, type(None))):
                        raise ValueError(f"metadata {k!r} is no string, number, boolean or null")
                meta = json.dumps(meta, allow_nan=False)
            rows.append((r["id"], r["text"] if text else [float(x) for x in r["vector"]], meta))
        return self.spark.createDataFrame(rows, "id string, text string, metadata string" if text else "id string, vector array<double>, metadata string")

    def add(self, record: dict[str, Any]) -> None:
        self.add_batch([record])

    def add_batch(self, records: DataFrame | Iterable[dict[str, Any]]) -> int:
        """Appends records; an id that the store or the batch has already, or a bad vector, refuses the whole batch. No
        records are no change."""
        return self._write(self._frame(records), upsert=False)

    def _embedded(self, records: DataFrame | Iterable[dict[str, Any]]) -> DataFrame:
        if self.embedder is None:
            raise ValueError("the store has no embedder")
        return self._frame(records, text=True).withColumn("vector", embed_column(self.embedder)(F.col("text")))

    def add_text(self, record: dict[str, Any]) -> None:
        self.add_texts([record])

    def add_texts(self, records: DataFrame | Iterable[dict[str, Any]]) -> int:
        return self._write(self._embedded(records), upsert=False)

    def update(self, record: dict[str, Any]) -> bool:
        """Adds the record, replacing the one of its id; whether there was one. A bad record leaves the old one."""
        return self.upsert([record]) > 0

    def upsert(self, records: DataFrame | Iterable[dict[str, Any]]) -> int:
        """Adds records, replacing those of their ids; how many were replaced. Of records with one id the last counts."""
        return self._write(self._frame(records), upsert=True)

    def delete(self, id_: str) -> bool:
        return self.delete_where(F.col("id") == id_) > 0

    def delete_where(self, condition: Any) -> int:
        """Tombstones the live records that meet the condition (a column or a metadata predicate); how many."""
        if isinstance(condition, dict):
            condition = compile_filter(condition, self.live().schema, "metadata")
        name = f"tombstones/{uuid.uuid4().hex}"
        self.live().where(condition).select("row").write.parquet(f"{self.root}/{name}")
        n = self.spark.read.parquet(f"{self.root}/{name}").count()
        if n:
            self._commit(tombstones=[*self._state["tombstones"], name], live=self.count - n)
        return n

    def compact(self) -> int:
        """Rewrites the live records as one segment with fresh row numbers; how many deleted ones went. 0 changes nothing. The
        old files stay, as results not yet evaluated and other readers may need them, until vacuum()."""
        gone = self._state["next_row"] - self.count
        if not gone:
            return 0
        name = f"segments/{uuid.uuid4().hex}"
        part = f"staging/{uuid.uuid4().hex}"
        self.live().repartitionByRange("row").sortWithinPartitions("row").withColumn("nf_part", F.spark_partition_id()).withColumn(
            "nf_at", F.monotonically_increasing_id()
        ).write.parquet(f"{self.root}/{part}")
        staged = self.spark.read.parquet(f"{self.root}/{part}")
        counts = staged.groupBy("nf_part").agg(F.count("*").alias("n"), F.min("nf_at").alias("nf_from"))
        before = F.sum("n").over(Window.orderBy("nf_part").rowsBetween(Window.unboundedPreceding, -1))
        offsets = counts.select("nf_part", "nf_from", F.coalesce(before, F.lit(0)).alias("nf_before"))
        row = (F.col("nf_before") + F.col("nf_at") - F.col("nf_from")).cast("long")
        staged.join(F.broadcast(offsets), "nf_part").select(row.alias("row"), "id", "vector", "metadata").write.parquet(f"{self.root}/{name}")
        files.remove(self.spark, f"{self.root}/{part}")
        self._commit(next_row=self.count, segments=[name] if self.count else [], tombstones=[])
        return gone

    def vacuum(self) -> int:
        """Deletes the files that the newest state does not name, and older manifests; how many. Only when nobody reads them any more."""
        keep = {*self._state["segments"], *self._state["tombstones"], *(x["path"] for x in self._kept["segments"].values()), self._kept.get("centroids")}
        removed = 0
        for folder in ("segments", "tombstones", "index", "staging"):
            for name in files.names(self.spark, f"{self.root}/{folder}"):
                if f"{folder}/{name}" not in keep and not name.endswith(".json"):
                    removed += files.remove(self.spark, f"{self.root}/{folder}/{name}")
        newest = f"manifest-{self._state['version']:08d}.json"
        for name in files.names(self.spark, self.root):
            if name.startswith("manifest-") and name.endswith(".json") and name != newest:
                removed += files.remove(self.spark, f"{self.root}/{name}")
        return removed

    # --- indexes

    def _index_key(self) -> str:
        """What an index depends on besides the records."""
        c = self.config
        return json.dumps([c.dimension, c.metric, c.quant_bits, c.ann, c.seed, c.rounds, c.nlist, c.nprobe, c.target_recall, c.iterations, c.sample_size, c.ann_seed, c.m, c.ef_construction, c.shard_rows])

    def _rows_of(self, segment: str) -> DataFrame:
        return self.spark.read.schema("row long, vector array<float>").parquet(f"{self.root}/{segment}")

    def build(self) -> None:
        """Builds the configured index over what has none yet; queries call it.

        A segment of records has an index segment of its own (codes, lists, or graph shards), written once: adding records
        adds one, deletes are filtered in the search, opening the folder again finds them all. The centroids of inverted
        lists are trained once and anew when the records have doubled, or been compacted; then all lists are written again."""
        c, segments = self.config, self._state["segments"]
        if not (c.ann or c.quant_bits) or not self.count:
            return
        if self._index.get("segments") == segments:
            self._index["indexed_segments"] = 0
            return
        key = self._index_key()
        kept = self._kept if self._kept["key"] == key else {"key": key, "segments": {}}
        kept = kept | {"segments": {s: x for s, x in kept["segments"].items() if s in segments}}
        trained = self._index.get("centroids")
        if c.ann == "ivf":
            if "centroids" in kept and kept["segments"] and self.count <= 2 * kept["trained"]:
                if trained is None:
                    trained = np.array([r[0] for r in self.spark.read.parquet(f"{self.root}/{kept['centroids']}").orderBy("cluster").select("centroid").collect()])  # nlist rows
            else:
                trained = None
                kept["segments"] = {}
        fresh = [s for s in segments if s not in kept["segments"]]
        rotator = quant.Rotator(c.dimension, c.seed, c.rounds) if c.quant_bits else None
        encode = lambda rows: quantized.encode(rows, rotator, c.quant_bits, "row")
        if c.ann == "ivf" and trained is None:
            nlist = ivf.choose_nlist(self.count, c.nlist)
            sample = ivf.hash_sample(self.live().select("row", "vector"), max(1024, c.sample_size), "row")
            if rotator is not None:
                sample = quantized.decode(encode(sample), rotator, c.quant_bits, "row").withColumnRenamed("rotated", "vector")
            trained = ivf.train_centroids(sample, nlist, "row", "vector", c.iterations, c.ann_seed)
            kept |= {"centroids": f"index/{uuid.uuid4().hex}-centroids", "trained": self.count, "nlist": nlist}
            kept.pop("nprobe", None)
            ivf.centroid_table(self.spark, trained).coalesce(1).write.parquet(f"{self.root}/{kept['centroids']}")
        shards = sum(x.get("shards", 0) for x in kept["segments"].values())
        number = max((x.get("first_shard", 0) + x.get("shards", 0) for x in kept["segments"].values()), default=0)
        for segment in fresh:
            rows, path, about = self._rows_of(segment), f"index/segment={uuid.uuid4().hex}", {}
            if c.ann == "ivf":
                assigned = ivf.assign(rows, trained) if rotator is None else quantized.assign_codes(encode(rows), trained, c.quant_bits, "row")
                ivf.write_lists(assigned, f"{self.root}/{path}")
            elif c.ann == "hnsw":
                about = {"shards": -(-rows.count() // c.shard_rows), "first_shard": number}
                hnsw.build(rows, self._walk_metric, about["shards"], "row", "vector", c.m, c.ef_construction, c.ann_seed, number).write.parquet(f"{self.root}/{path}")
                number, shards = number + about["shards"], shards + about["shards"]
            else:
                encode(rows).write.parquet(f"{self.root}/{path}")
            kept["segments"][segment] = {"path": path} | about
        index: dict[str, Any] = {"segments": list(segments), "indexed_segments": len(fresh), "rotator": rotator, "rows": self._index_rows(kept)}
        if c.ann == "ivf":
            if "nprobe" not in kept:
                kept["nprobe"] = ivf.default_nprobe(kept["nlist"])
                if c.nprobe is not None:
                    kept["nprobe"] = max(1, min(c.nprobe, kept["nlist"]))
                elif c.target_recall is not None:
                    lists = index["rows"]
                    if rotator is not None:
                        lists = quantized.decode(lists, rotator, c.quant_bits, "row").join(lists.select("row", "cluster"), "row").withColumnRenamed("rotated", "vector")
                    kept["nprobe"], kept["tuned_recall"] = ivf.tune(lists, trained, c.target_recall, "row", "vector", c.sample_size)
            index |= {"centroids": trained} | {n: kept[n] for n in ("nlist", "nprobe", "tuned_recall") if n in kept}
        if c.ann == "hnsw":
            index["shards"] = shards
            index["max_level"] = kept["max_level"] if not fresh and "max_level" in kept else hnsw.edges(index["rows"], "row").agg(F.max("level")).first()[0]
            kept["max_level"] = index["max_level"]
        if kept != self._kept:
            files.write_json(self.spark, f"{self.root}/index/index.json", kept)
        self._kept, self._index = kept, index

    @property
    def _walk_metric(self) -> str:
        return "l2" if self.config.metric == "l2" else "dot"

    def _index_rows(self, kept: dict[str, Any]) -> DataFrame:
        """The index segments as one table."""
        c = self.config
        if c.ann == "hnsw":
            schema = hnsw.packed_schema("row", "bigint")
        else:
            schema = ("row long, codes binary, scale double" if c.quant_bits else "row long, vector array<float>") + (", cluster int" if c.ann == "ivf" else "")
        paths = [f"{self.root}/{x['path']}" for x in kept["segments"].values()]
        return self.spark.read.schema(schema + ", segment string").option("basePath", f"{self.root}/index").parquet(*paths).drop("segment")

    def _deleted(self) -> DataFrame | None:
        """(row) of the tombstones, if there are any."""
        if not self._state["tombstones"]:
            return None
        return self.spark.read.schema("row long").parquet(*(f"{self.root}/{t}" for t in self._state["tombstones"]))

    # --- queries

    def query(self, vector: Sequence[float], k: int = 10, filter: dict | None = None, **options: Any) -> list[dict[str, Any]]:
        """Up to k records {id, score, metadata}, best first. filter: see compile_filter(); options: those of query_batch()."""
        began = time.time()
        found = self.query_batch([vector], k, filter, **options).orderBy("rank").collect()
        self._last_ms = (time.time() - began) * 1000
        return [{"id": r["id"], "score": r["score"]} | ({"metadata": json.loads(r["metadata"])} if r["metadata"] else {}) for r in found]

    def query_text(self, text: str, k: int = 10, **options: Any) -> list[dict[str, Any]]:
        if self.embedder is None:
            raise ValueError("the store has no embedder")
        return self.query(self.embedder.embed([text])[0].tolist(), k, **options)

    def query_batch(
        self, queries: DataFrame | Sequence[Sequence[float]], k: int = 10, filter: dict | None = None, rerank: bool | None = None,
        nprobe: int | None = None, ef_search: int | None = None, entry_mode: str = "descend",
    ) -> DataFrame:
        """(q_id, id, score, metadata, rank) for queries (q_id, q), or for vectors numbered from 0. Options count for this call only;
        entry_mode "spread" starts graph walks from rows spread over the shard instead of descending its upper layers.

        The predicate is part of the plan below the top-k. If at most EXACT_ROWS records meet it they are scored exactly; beyond that
        flat and inverted lists are searched among what meets it, and a graph is walked until enough of its hits do."""
        c = self.config
        if isinstance(queries, DataFrame):
            q = queries
        else:
            for v in queries:
                if len(v) != c.dimension or not np.isfinite(np.asarray(v, float)).all():
                    raise ValueError(f"a query needs {c.dimension} finite numbers")
            q = self.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(queries)], "q_id long, q array<double>")
        if c.normalize:
            q = q.withColumn("q", V.normalize(F.col("q")))
        live = self.live()
        if filter is not None:
            live = live.where(compile_filter(filter, live.schema, "metadata"))
        few = filter is not None and (c.ann or c.quant_bits) and live.select("row").limit(EXACT_ROWS + 1).count() <= EXACT_ROWS
        if few and k > 0:
            hits = knn.knn_join(q, live, k, "l2" if c.metric == "l2" else "dot", "row", normalize_queries=False)
        elif k <= 0 or not self.count:
            hits = q.select("q_id", F.lit(0).cast("long").alias("row"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
        else:
            self.build()
            hits = self._hits(q, live, k, filter is not None, c.rerank if rerank is None else rerank, nprobe, ef_search, entry_mode)
        return hits.join(live.select("row", "id", "metadata"), "row").select("q_id", "id", "score", "metadata", "rank")

    def _hits(self, q: DataFrame, live: DataFrame, k: int, filtered: bool, rerank: bool, nprobe: int | None, ef: int | None, entry_mode: str) -> DataFrame:
        c, x = self.config, self._index
        if not (c.ann or c.quant_bits):
            return knn.knn_join(q, live, k, self._walk_metric, "row", normalize_queries=False)
        gone = self._deleted()
        if c.ann == "hnsw":
            keep = live.select("row") if filtered or gone is not None else None
            return hnsw.search(q, x["rows"], k, ef or c.ef_search, self._walk_metric, "row", entry_mode, keep)
        rows = x["rows"]
        if filtered:
            rows = rows.join(live.select("row"), "row", "left_semi")
        elif gone is not None:
            rows = rows.join(gone, "row", "left_anti")
        factor = (c.rerank_factor or quant.RERANK_FACTOR[c.quant_bits]) if c.quant_bits and rerank else 1
        if c.ann == "ivf" and c.quant_bits:
            return quantized.ivf_knn(q, rows, x["centroids"], live, k, nprobe or x["nprobe"], x["rotator"], c.quant_bits, "row", factor=factor)
        if c.ann == "ivf":
            return ivf.search(q, rows, x["centroids"], k, nprobe or x["nprobe"], "row")
        return quantized.quantized_knn(q, rows, live, k, x["rotator"], c.quant_bits, "row", factor=factor)

    # --- snapshots

    def save(self) -> int:
        """Compacts, so that the folder holds the live records only, and records the state; the version."""
        if not self.compact():
            self._commit()
        return self._state["version"]

    def save_as_table(self, name: str) -> None:
        """The live records as a table of the catalog: the other backend."""
        self.live().write.mode("overwrite").saveAsTable(name)

    def export(self, passphrase: str | None = None, most_rows: int = 5_000_000) -> bytes:
        """The live records as one blob, encrypted if there is a passphrase (the store's own by default). The graph goes with
        it if nothing was deleted and there is one shard. For single files only: ValueError beyond most_rows (copy the folder)."""
        if self.count > most_rows:
            raise ValueError(f"{self.count} records are too many for one blob")
        table = self.live().orderBy("row").toArrow()
        entries = [{"id": i} | ({"metadata": json.loads(m)} if m else {}) for i, m in zip(table.column("id").to_pylist(), table.column("metadata").to_pylist())]
        x = knn.matrix(table.column("vector"), self.dimension).astype(np.float32)
        graph = None
        if self.config.ann == "hnsw" and self.count and self._state["next_row"] == self.count:
            self.build()
            if self._index["shards"] == 1:
                # positions within the shard are the rows in order
                graph = {"m": self.config.m, "links": hnsw.Graph.unpack(self._index["rows"].first().asDict(), self._walk_metric).state()}
        data = snapshot.serialize(snapshot.Snapshot(self.dimension, self.metric, bool(self.config.normalize), entries, x, graph))
        word = self.passphrase if passphrase is None else passphrase
        return data if word is None else snapshot.seal(self.spark, data, word)

    @classmethod
    def import_(cls, spark: SparkSession, root: str, data: bytes, passphrase: str | None = None, embedder: Embedder | None = None, **config: Any) -> VectorStore:
        """A store of its own under root from a blob; dimension, metric and normalisation are the blob's. Vectors are taken as
        they are, and a graph in it is used as it is."""
        s = snapshot.deserialize(snapshot.open_bytes(spark, data, passphrase))
        store = cls(spark, root, Config(s.dimension, s.metric, s.normalize, **config), embedder, passphrase, auto_load=False)
        if s.count:
            rows = [(e["id"], [float(v) for v in x], json.dumps(e["metadata"]) if e.get("metadata") is not None else None) for e, x in zip(s.entries, s.vectors)]
            # one partition: the order of the rows is the blob's
            store._write(spark.createDataFrame(rows, _ROW).coalesce(1), upsert=False, raw=True)
        if s.graph is not None and store.config.ann == "hnsw" and s.graph["m"] == store.config.m:
            # row numbers are the blob's order
            g = hnsw.Graph.restore(np.asarray(s.vectors, np.float32), s.graph["links"], store._walk_metric, s.graph["m"])
            path = f"index/segment={uuid.uuid4().hex}"
            made = hnsw.packed_table(0, pa.array(range(s.count), pa.int64()), g, "row")
            spark.createDataFrame([made.to_pylist()[0]], hnsw.packed_schema("row", "bigint")).write.parquet(f"{store.root}/{path}")
            store._kept = {"key": store._index_key(), "segments": {store._state["segments"][0]: {"path": path, "shards": 1, "first_shard": 0}}, "max_level": g.top}
            files.write_json(spark, f"{store.root}/index/index.json", store._kept)
            store.build()  # nothing is left to build: it is opened
        return store

    def destroy(self) -> None:
        """Forgets what the store keeps in memory; neither its files nor the session end."""
        self._index = {}
