"""The store, snapshots and streams."""

import json
import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import embedding
from nearfield.sources import snapshot, synthetic
from nearfield.sources.store import Config, VectorStore, is_supported
from nearfield.streaming import ingest


def records(x, meta=lambda i: {"n": i, "group": "even" if i % 2 == 0 else "odd"}):
    return [{"id": f"v{i}", "vector": v.tolist(), "metadata": meta(i)} for i, v in enumerate(x)]


@pytest.fixture
def new(spark, tmp_path):
    made = iter(range(100))
    return lambda config, **k: VectorStore(spark, f"{tmp_path}/{next(made)}", config, **k)


def test_records_live_and_die(new):
    x = synthetic.uniform(60, 8, 5)
    s = new(Config(8))
    assert s.add_batch([]) == 0 and s.count == 0 and s.query([1.0] * 8) == [] and s.get("v1") is None
    assert s.add_batch(records(x)) == 60
    top = s.query(x[7].tolist(), 3)
    assert top[0]["id"] == "v7" and top[0]["score"] == pytest.approx(1, abs=1e-5) and top[0]["metadata"] == {"n": 7, "group": "odd"}
    odd = s.query(x[6].tolist(), 60, {"group": "odd"})
    assert len(odd) == 30 and all(r["metadata"]["group"] == "odd" for r in odd)
    assert s.query(x[0].tolist(), 5, {"group": "none"}) == []
    assert s.delete("v7") and not s.delete("v7") and s.get("v7") is None and s.query(x[7].tolist(), 1)[0]["id"] != "v7"
    assert s.update({"id": "v8", "vector": x[9].tolist(), "metadata": {"n": -1}}) and not s.update({"id": "new", "vector": x[7].tolist()})
    assert s.get("v8")["metadata"] == {"n": -1} and s.count == 60
    assert {r["id"] for r in s.query(x[9].tolist(), 2)} == {"v8", "v9"}
    assert s.get("new")["metadata"] is None and "metadata" not in s.query(x[7].tolist(), 1)[0]
    assert s.stats()["deleted"] == 2 and s.compact() == 2 and s.compact() == 0 and s.stats()["deleted"] == 0
    rows = sorted(r.row for r in s.live().select("row").collect())
    assert rows == list(range(60)) and s.query(x[7].tolist(), 1)[0]["id"] == "new"
    s.destroy()
    assert s.dimension == 8 and s.metric == "cosine" and is_supported()["arrow"]


def test_bad_batches_change_nothing(new):
    x = synthetic.uniform(5, 4, 1)
    s = new(Config(4))
    s.add_batch(records(x))
    bad = [
        [{"id": "v1", "vector": [1, 2, 3, 4]}], [{"id": "a", "vector": [1, 2, 3, 4]}, {"id": "a", "vector": [1, 2, 3, 4]}], [{"id": "a", "vector": [1, 2, 3]}],
        [{"id": "b", "vector": [1, 2, 3, 4]}, {"id": "a", "vector": [1, 2, float("nan"), 4]}], [{"id": "a", "vector": [1, 2, float("inf"), 4]}], [{"id": None, "vector": [1, 2, 3, 4]}],
        [{"id": "a", "vector": [1, 2, 3, 4], "metadata": {"x": [1]}}], [{"id": "a", "vector": [1, 2, 3, 4], "metadata": {"x": float("nan")}}],
    ]
    for b in bad:
        with pytest.raises(ValueError):
            s.add_batch(b)
    with pytest.raises(ValueError):
        s.update({"id": "v1", "vector": [1.0]})
    with pytest.raises(ValueError):
        s.query([1.0] * 3)
    with pytest.raises(ValueError):
        s.query([1.0, 2.0, 3.0, float("nan")])
    assert s.count == 5 and s.get("v1")["metadata"]["n"] == 1 and s.live().count() == 5


@pytest.mark.parametrize(
    "bad", [{"dimension": 0}, {"dimension": True}, {"dimension": 4, "metric": "x"}, {"dimension": 4, "quant_bits": 2}, {"dimension": 4, "ann": "tree"},
            {"dimension": 64, "ann": "hnsw", "quant_bits": 8}, {"dimension": 64, "metric": "l2", "quant_bits": 8}, {"dimension": 4, "metric": "l2", "ann": "ivf"}, {"dimension": 16, "quant_bits": 1}],
)
def test_bad_configurations(bad):
    with pytest.raises(ValueError):
        Config(**bad)


@pytest.mark.parametrize(
    ("config", "floor"),
    [({}, 1), ({"metric": "l2"}, 1), ({"metric": "dot"}, 1), ({"quant_bits": 8}, 0.95), ({"quant_bits": 4}, 0.85), ({"quant_bits": 1}, 0.7), ({"ann": "ivf", "nprobe": 16}, 0.99),
     ({"ann": "ivf", "target_recall": 0.9}, 0.75), ({"ann": "ivf", "quant_bits": 8, "nprobe": 16}, 0.95), ({"ann": "ivf", "quant_bits": 4, "nprobe": 16}, 0.85), ({"ann": "ivf", "quant_bits": 1, "target_recall": 1.0}, 0.7), ({"ann": "hnsw"}, 0.9), ({"ann": "hnsw", "metric": "l2", "shard_rows": 100}, 0.9)],
)
def test_every_index_answers(new, config, floor):
    x, q = synthetic.uniform(300, 32, 3), synthetic.uniform(6, 32, 4)
    s = new(Config(32, **config))
    s.add_batch(records(x))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    a, b = (unit(x.astype(float)), unit(q.astype(float))) if s.config.normalize else (x.astype(float), q.astype(float))
    score = -((b[:, None] - a[None]) ** 2).sum(2) if s.metric == "l2" else b @ a.T
    want = [{f"v{i}" for i in np.argsort(-r)[:10]} for r in score]
    got = s.query_batch(q.tolist(), 10).collect()
    assert np.mean([len({r.id for r in got if r.q_id == i} & w) / 10 for i, w in enumerate(want)]) >= floor
    assert s.stats()["version"] == 1
    # a predicate, deletes and later records hold on every index
    some = s.query(q[0].tolist(), 300, {"n": {"$lt": 5}}, nprobe=16)
    assert {r["id"] for r in some} == {f"v{i}" for i in range(5)}
    best = s.query(q[0].tolist(), 1, nprobe=16)[0]["id"]
    s.delete(best)
    s.add({"id": "same", "vector": (2 * q[0]).tolist() if s.config.normalize else q[0].tolist()})
    again = s.query(q[0].tolist(), 300, nprobe=16, ef_search=300)
    assert best not in {r["id"] for r in again} and (s.metric == "dot" or again[0]["id"] == "same")


def index_files(store):
    return sorted(p for p in pathlib.Path(store.root, "index").rglob("*.parquet"))


@pytest.mark.parametrize("config", [{"quant_bits": 8}, {"ann": "ivf", "nprobe": 16}, {"ann": "ivf", "quant_bits": 4, "nprobe": 16}, {"ann": "hnsw", "shard_rows": 100}])
def test_indexes_outlive_the_process_and_grow(spark, new, config):
    x, q = synthetic.uniform(400, 32, 3), synthetic.uniform(5, 32, 4)
    s = new(Config(32, **config))
    s.add_batch(records(x[:250]))
    ask = lambda store: {(r.q_id, r.id) for r in store.query_batch(q.tolist(), 10, ef_search=400).collect()}
    first, made = ask(s), index_files(s)
    t = VectorStore(spark, s.root, s.config)
    assert ask(t) == first and index_files(t) == made and t.stats()["indexed_segments"] == 0  # nothing is built
    # new records add an index segment, deletes none
    t.add_batch([r | {"id": f"w{i}"} for i, r in enumerate(records(x[250:]))])
    grown = ask(t)
    after = index_files(t)
    assert set(made) < set(after) and t.stats()["indexed_segments"] == 1 and any(i.startswith("w") for _, i in grown)
    gone = {i for n, i in grown if n == 0}
    for i in gone:
        assert t.delete(i)
    assert not {i for _, i in ask(t)} & gone and index_files(t) == after and t.stats()["indexed_segments"] == 0
    # compaction makes one segment; vacuum leaves its index only
    assert t.compact() == len(gone)
    compacted = ask(t)
    assert t.vacuum() > 0 and ask(VectorStore(spark, s.root, s.config)) == compacted
    assert len({p.parent if "cluster=" not in str(p) else p.parent.parent for p in index_files(t)} - {p.parent for p in index_files(t) if "centroids" in str(p)}) == 1
    other = VectorStore(spark, s.root, Config(32, **(config | {"seed": 5, "m": 8})))
    assert len(ask(other)) == 50 and other.stats()["indexed_segments"] == 1  # an index of another kind is not taken


def test_spread_entry(new):
    x = synthetic.uniform(200, 16, 3)
    s = new(Config(16, ann="hnsw"))
    s.add_batch(records(x))
    assert [r.id for r in s.query_batch(x[:20].tolist(), 1, entry_mode="spread").orderBy("q_id").collect()] == [f"v{i}" for i in range(20)]


def test_the_last_of_a_batch_wins(spark, new):
    s = new(Config(2, normalize=False))
    s.add_batch([{"id": "a", "vector": [1, 0]}])
    assert s.upsert([{"id": "b", "vector": [1, 0], "metadata": {"n": 9}}, {"id": "a", "vector": [2, 0]}, {"id": "b", "vector": [0, 1], "metadata": {"n": 1}}, {"id": "c", "vector": [3, 0]}]) == 1
    assert s.get("b") == {"id": "b", "vector": [0.0, 1.0], "metadata": {"n": 1}} and s.count == 3 and s.get("a")["vector"] == [2.0, 0.0]
    rows = spark.createDataFrame([("d", [float(i), 1.0], None) for i in range(500)], "id string, vector array<double>, metadata string").repartition(1).sortWithinPartitions("vector")
    s.upsert(rows)
    assert s.get("d")["vector"] == [499.0, 1.0] and s.stats()["deleted"] == 1
    numbers = sorted(r.row for r in s.live().select("row").collect())
    assert len(set(numbers)) == 4 and s.compact() == 1


def test_compaction_keeps_what_readers_name(new):
    s = new(Config(2, normalize=False))
    s.add_batch([{"id": str(i), "vector": [i, 1]} for i in range(10)])
    s.delete("3")
    reader = s.live()
    s.compact()
    assert reader.count() == 9 and s.vacuum() >= 2 and s.live().count() == 9 and s.vacuum() == 0


def test_late_records_of_a_stream(spark, new, tmp_path):
    s = new(Config(2, normalize=False))
    schema = "id string, vector array<double>, metadata string, at int"
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/up")
    for batch in ([("a", 2), ("b", None)], [("a", 1), ("b", 0), ("c", 5)], [("a", 3), ("c", 4), ("b", None)], [("a", 3), ("c", 5)]):
        spark.createDataFrame([(i, [float(n or 0), 0.0], json.dumps({"at": n, "turn": len(s.root)}), n) for i, n in batch], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/up")
        ingest.upsert(source(), s, "at").awaitTermination()
    assert {i: s.get(i)["metadata"]["at"] for i in "abc"} == {"a": 3, "b": 0, "c": 5}


def test_batches_equal_single_queries(new):
    x, q = synthetic.uniform(100, 16, 9), synthetic.uniform(4, 16, 10)
    s = new(Config(16))
    s.add_batch(records(x))
    both = s.query_batch(q.tolist(), 5).orderBy("q_id", "rank").collect()
    for i in range(4):
        assert [r.id for r in both if r.q_id == i] == [r["id"] for r in s.query(q[i].tolist(), 5)]


def test_text(new):
    s = new(Config(64), embedder=embedding.HashingEmbedder(64))
    s.add_texts([{"id": "a", "text": "vector database on spark"}, {"id": "b", "text": "baking a chocolate cake"}, {"id": "c", "text": "fast vector search database"}])
    s.add_text({"id": "d", "text": "gardens"})
    assert {r["id"] for r in s.query_text("vector database", 2)} == {"a", "c"}
    with pytest.raises(ValueError):
        new(Config(32), embedder=embedding.HashingEmbedder(64))
    plain = new(Config(64))
    for call in (lambda: plain.add_texts([{"id": "a", "text": "x"}]), lambda: plain.query_text("x")):
        with pytest.raises(ValueError, match="embedder"):
            call()


def test_save_and_open(spark, new):
    x = synthetic.uniform(50, 8, 1)
    s = new(Config(8))
    s.add_batch(records(x))
    s.delete("v0")
    assert s.save() > 0
    t = VectorStore(spark, s.root, Config(8))
    assert t.count == 49 and [r["id"] for r in t.query(x[7].tolist(), 3)] == [r["id"] for r in s.query(x[7].tolist(), 3)]
    assert VectorStore(spark, s.root, Config(8), auto_load=False).count == 0
    for other in (Config(16), Config(8, "l2"), Config(8, normalize=False)):
        with pytest.raises(ValueError, match="stored"):
            VectorStore(spark, s.root, other)
    s.save_as_table("saved_vectors")
    assert spark.table("saved_vectors").count() == 49
    spark.sql("DROP TABLE saved_vectors")


def test_export_and_import(spark, new, tmp_path):
    x = synthetic.uniform(30, 8, 4)
    s = new(Config(8, ann="hnsw"))
    s.add_batch(records(x, lambda i: {"tag": f"é{i}", "nil": None, "flag": True}))
    s.delete("v2")
    t = VectorStore.import_(spark, f"{tmp_path}/i1", s.export())
    assert t.count == 29 and t.get("v3")["metadata"] == {"tag": "é3", "nil": None, "flag": True}
    assert [r["id"] for r in t.query(x[3].tolist(), 5)] == [r["id"] for r in s.query(x[3].tolist(), 5)]
    sealed = s.export("secret")
    assert snapshot.is_sealed(sealed)
    for word in (None, "other", ""):
        with pytest.raises(ValueError):
            VectorStore.import_(spark, f"{tmp_path}/i2", sealed, word)
    with pytest.raises(ValueError):
        VectorStore.import_(spark, f"{tmp_path}/i2", s.export(), "secret")
    kept = VectorStore.import_(spark, f"{tmp_path}/i3", sealed, "secret")
    assert kept.count == 29 and snapshot.is_sealed(kept.export())
    s.compact()
    with_graph = s.export()
    assert snapshot.deserialize(with_graph).graph is not None
    g = VectorStore.import_(spark, f"{tmp_path}/i4", with_graph, ann="hnsw")
    assert g.stats()["max_level"] >= 0 and [r["id"] for r in g.query(x[3].tolist(), 5)] == [r["id"] for r in s.query(x[3].tolist(), 5)]
    empty = new(Config(8)).export()
    assert VectorStore.import_(spark, f"{tmp_path}/i5", empty).count == 0


def test_snapshot_layout():
    entries = [{"id": "id-0", "metadata": {"n": 1, "tag": "日本", "flag": True, "nil": None}}, {"id": "ü"}, {"id": "c"}]
    x = np.arange(12, dtype=np.float32).reshape(3, 4)
    s = snapshot.Snapshot(4, "l2", False, entries, x)
    data = snapshot.serialize(s)
    back = snapshot.deserialize(data)
    assert back.entries == entries and np.array_equal(back.vectors, x) and (back.metric, back.normalize, back.graph) == ("l2", False, None)
    assert data[4] == 1 and (len(data) - 48) % 4 == 0
    links = [[[1, 2], [2]], [[0]], [[0], [0]]]
    with_graph = snapshot.serialize(snapshot.Snapshot(4, "dot", True, entries, x, {"m": 2, "links": links}))
    assert with_graph[4] == 2 and snapshot.deserialize(with_graph).graph == {"m": 2, "links": links}
    for bad in (data[:10], b"XXXX" + data[4:], data[:4] + b"\x09" + data[5:], data[:12] + b"\x09" + data[13:], data[:-4], with_graph[:-4], data[:20] + b"\x02" + data[21:]):
        with pytest.raises((ValueError, json.JSONDecodeError)):
            snapshot.deserialize(bad)
    none = snapshot.Snapshot(4, "cosine", True, [], np.zeros((0, 4), np.float32))
    assert snapshot.deserialize(snapshot.serialize(none)).count == 0
    with pytest.raises(ValueError):
        snapshot.serialize(snapshot.Snapshot(1, "dot", False, [{"id": "a", "metadata": {"x": float("nan")}}], np.zeros((1, 1))))


def test_envelope(spark):
    data = bytes((i * 7) & 255 for i in range(256))
    a, b = snapshot.seal(spark, data, "pw", 1000), snapshot.seal(spark, data, "pw", 1000)
    assert a != b and snapshot.unseal(spark, a, "pw") == data and not snapshot.is_sealed(data) and not snapshot.is_sealed(b"")
    for bad in (a[:-1] + bytes([a[-1] ^ 1]), a[:60] + bytes([a[60] ^ 1]) + a[61:], a[:4] + b"\x02" + a[5:], a[:20]):
        with pytest.raises(ValueError):
            snapshot.unseal(spark, bad, "pw")
    with pytest.raises(ValueError):
        snapshot.unseal(spark, a, "wrong")
    with pytest.raises(ValueError):
        snapshot.seal(spark, data, "")


def test_streams(spark, new, tmp_path):
    s = new(Config(2, normalize=False))
    x = [(f"r{i}", [float(i), 1.0], json.dumps({"i": i})) for i in range(20)]
    schema = "id string, vector array<double>, metadata string"
    for part in range(4):
        spark.createDataFrame(x[part * 5 : part * 5 + 5], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    ingest.ingest(source(), s).awaitTermination()
    assert s.count == 20
    spark.createDataFrame([("r20", [20.0, 1.0], None)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    ingest.ingest(source(), s).awaitTermination()
    assert s.count == 21 and len(s.query([1.0, 0.0], 1)) == 1
    ingest.ingest(source(), s, name="again").awaitTermination()  # all of it is there already
    assert s.count == 21
    up = spark.createDataFrame([("r1", [5.0, 5.0], '{"i": 100}', 2), ("r1", [6.0, 6.0], '{"i": 50}', 1), ("z", [1.0, 1.0], None, 1)], schema + ", at int")
    up.coalesce(1).write.parquet(f"{tmp_path}/up")
    ingest.upsert(spark.readStream.schema(up.schema).parquet(f"{tmp_path}/up"), s, "at").awaitTermination()
    assert s.count == 22 and s.get("r1")["metadata"] == {"i": 100}
    ingest.running_sample(source(), s, 7).awaitTermination()
    from nearfield.operators.sampling import hash_sample

    last = spark.read.parquet(f"{s.root}/samples/sample/*").count()
    assert last >= 7
    newest = sorted(p.name for p in __import__("pathlib").Path(f"{s.root}/samples/sample").iterdir() if p.is_dir())[-1]
    every = spark.read.schema(schema).parquet(f"{tmp_path}/in")
    assert {r.id for r in spark.read.parquet(f"{s.root}/samples/sample/{newest}").collect()} == {r.id for r in hash_sample(every, 7).collect()}
    got = []
    q = spark.createDataFrame([(1, [1.0, 0.0])], "q_id long, q array<double>")
    q.write.parquet(f"{tmp_path}/q")
    each = ingest.standing_query(None, s.live(), 2, lambda hits, n: got.extend(hits.collect()), "dot")
    spark.readStream.schema(q.schema).parquet(f"{tmp_path}/q").writeStream.foreachBatch(each).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert [r.id for r in got] == ["r20", "r19"]
    fresh = new(Config(2, normalize=False, quant_bits=0, ann="hnsw"))
    ingest.refreshing(fresh)(every.select("id", "vector", "metadata"), 0)
    assert fresh.stats()["shards"] == 1
    assert fresh.live().where(F.col("id") == "r3").count() == 1
