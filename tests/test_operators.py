"""Functions and operators against brute force, and the floors of recall."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.functions import hashing, prng, quant
from nearfield.functions import vectors as V
from nearfield.operators import embedding, hnsw, ivf, knn, quantized, sampling
from nearfield.operators.predicate import compile_filter
from nearfield.sources import synthetic


def frame(spark, x, partitions=3):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<float>").repartition(partitions)


def asked(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "q_id long, q array<double>")


def brute(q, x, k, metric="dot"):
    x, q = np.asarray(x, np.float64), np.asarray(q, np.float64)
    s = -((q[:, None] - x[None]) ** 2).sum(2) if metric == "l2" else q @ x.T
    return [sorted(range(len(x)), key=lambda i: (-r[i], i))[:k] for r in s]


def found(df, n):
    out = [[] for _ in range(n)]
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out[r.q_id].append(r.id)
    return out


def recall(a, b):
    return np.mean([len(set(x) & set(y)) / len(x) for x, y in zip(a, b)])


# --- functions


def test_prng_is_deterministic_and_even():
    a, b = prng.mulberry32(42), prng.mulberry32(42)
    x = [a() for _ in range(5000)]
    assert x == [b() for _ in range(5000)] and all(0 <= v < 1 for v in x) and abs(np.mean(x) - 0.5) < 0.02
    assert x[:5] != [prng.mulberry32(43)() for _ in range(5)]
    # by the definition, in wrapping arithmetic of its own
    def reference(seed):
        mul = lambda p, q: (p * q) % 2**32
        s = (seed + 0x6D2B79F5) % 2**32
        t = mul(s ^ (s >> 15), s | 1)
        t = (t ^ ((t + mul(t ^ (t >> 7), t | 61)) % 2**32)) % 2**32
        return (t ^ (t >> 14)) / 2**32
    assert prng.mulberry32(7)() == reference(7)
    assert set(prng.random_signs(100, 3)) == {-1.0, 1.0}


@pytest.mark.parametrize(("n", "p"), [(1, 4), (3, 4), (4, 4), (5, 8), (100, 128), (384, 512), (768, 1024), (1536, 2048)])
def test_padding(n, p):
    assert quant.padded_dimension(n) == p


def test_rotation_keeps_products():
    r, x = quant.Rotator(100, 12345), np.random.default_rng(1).normal(size=(5, 100))
    y = r.rotate(x)
    assert y.shape == (5, 128) and np.allclose(y @ y.T, x @ x.T, atol=1e-9)
    h = np.random.default_rng(2).normal(size=(1, 16))
    assert np.allclose(quant.hadamard(quant.hadamard(h)) / 16, h)
    with pytest.raises(ValueError):
        quant.hadamard(np.zeros((1, 6)))


@pytest.mark.parametrize("bits", [8, 4, 1])
def test_codes_round_trip(bits):
    x = np.random.default_rng(bits).uniform(-3, 3, (40, 64))
    x[3] = 0
    codes, scale = quant.quantize(x, bits)
    assert np.array_equal(quant.unpack(quant.pack(codes, bits), bits), codes)
    assert quant.pack(codes, bits).shape[1] == 64 * bits // 8
    back = quant.dequantize(codes, scale, bits)
    if bits == 1:
        assert np.array_equal(back[0] > 0, x[0] >= 0) and np.allclose(scale[0], np.abs(x[0]).mean()) and not back[3].any()
    else:
        assert (np.abs(back - x) <= scale[:, None] / quant.LEVELS[bits] / 2 + 1e-12).all() and scale[3] == 1
    with pytest.raises(ValueError):
        quant.check_width(bits, 2)
    with pytest.raises(ValueError):
        quant.check_width(3, 64)


def test_halves_round_up():
    codes, _ = quant.quantize(np.array([[127.0, -0.5, 0.5, 1.5, -1.5, 0, 0, 0]]), 8)
    assert codes[0, :5].tolist() == [127, 0, 1, 2, -1]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.floats(-100, 100, width=32), min_size=5, max_size=5), min_size=1, max_size=6))
def test_top_of_equals_a_full_sort(rows):
    s = np.round(np.array(rows))
    ids = np.array([4, 1, 3, 0, 2])
    q, c = knn.top_of(s, ids, 3)
    for i in range(len(s)):
        assert c[q == i].tolist() == sorted(range(5), key=lambda j: (-s[i, j], ids[j]))[:3]


def test_top_of_leaves_nan_out():
    q, c = knn.top_of(np.array([[1.0, np.nan, 3.0], [np.nan] * 3]), np.arange(3), 2)
    assert (q.tolist(), c.tolist()) == ([0, 0], [2, 0])


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    got = df.select(V.dot(a, b), V.neg_sq_l2(a, b), V.norm(a), V.normalize(a), V.cosine(a, b), V.sq_dist(a, b)).collect()
    assert got[0][:3] == (11.0, -8.0, 5.0) and got[0][3] == pytest.approx([0.6, 0.8]) and got[0][4] == pytest.approx(11 / 5 / math.sqrt(5))
    assert got[1][3] == [0.0, 0.0] and got[1][4] == 0.0
    bad = spark.createDataFrame([([1.0, float("nan")],), ([1.0],), (None,), ([1.0, float("inf")],), ([1.0, None],), ([1.0, 2.0],)], "v array<double>")
    assert [r[0] for r in bad.select(V.is_valid(F.col("v"), 2)).collect()] == [False] * 5 + [True]
    with pytest.raises(ValueError):
        V.score("manhattan", a, b)


# --- hashing


def test_hashing_embedder_equals_the_expression(spark):
    texts = ["Hello, World! hello", "", "   ", "one", "the quick brown fox jumps", "naïve café", "a-b a_b 12 12"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    native = [r[0] for r in df.select(hashing.hashing_embed(F.col("text"), 32)).collect()]
    made = embedding.HashingEmbedder(32).embed(texts)
    dense = [r.vector for r in embedding.hashed_vectors(df, "id", "text", 32).orderBy("id").collect()]
    for a, b, c in zip(native, made, dense):
        assert a == pytest.approx(b.tolist(), abs=1e-6) and c == pytest.approx(b.tolist())
        assert np.linalg.norm(b) == pytest.approx(1, abs=1e-6) or not b.any()
    sparse = {}
    for r in embedding.hashed_features(df, "id", "text", 32).collect():
        sparse.setdefault(r.id, np.zeros(32))[r.idx] = r.weight
    assert all(np.allclose(sparse.get(i, np.zeros(32)), m, atol=1e-6) for i, m in enumerate(made))
    one, two = embedding.HashingEmbedder(64).embed(["Big Dog!", "big dog"])
    assert np.array_equal(one, two)
    a, b = embedding.HashingEmbedder(64).embed(["dog bites man", "man bites dog"])
    assert not np.array_equal(a, b)
    a, b = embedding.HashingEmbedder(64, bigrams=False).embed(["dog bites man", "man bites dog"])
    assert np.array_equal(a, b)


def test_own_embedders(spark):
    loads = []

    def load():
        loads.append(1)
        return lambda texts: [np.array([len(t), 1.0]) for t in texts]

    m = embedding.ModelEmbedder(load, 2)
    assert not loads and m.embed(["abc"])[0].tolist() == [3, 1] and len(loads) == 1
    df = spark.createDataFrame([("ab",), (None,)], "t string")
    assert [r[0] for r in df.select(embedding.embed_column(embedding.HashingEmbedder(4))(F.col("t"))).collect()][1] == [0.0] * 4

    class Wrong:
        dimension = 3

        def embed(self, texts):
            return [np.zeros(2) for _ in texts]

    with pytest.raises(Exception, match="coordinates"):
        df.select(embedding.embed_column(Wrong())(F.col("t"))).collect()


# --- predicates

ROWS = ['{"lang": "en", "n": 1}', '{"lang": "fr", "n": "1"}', '{"n": true}', '{"n": 2.5, "x": null}', "{}", None, '{"year": 2020, "x": 0}', '{"year": "2021"}', "no json"]


def truth(predicate):
    import json

    out = []
    for i, t in enumerate(ROWS):
        try:
            m = json.loads(t) if t else {}
        except ValueError:
            m = {}
        ok = True
        for f, w in predicate.items():
            for op, v in (w if isinstance(w, dict) else {"$eq": w}).items():
                has, x = f in m, m.get(f)
                number = isinstance(x, (int, float)) and not isinstance(x, bool)
                same = lambda y: has and (x is None if y is None else type(x) is type(y) and x == y or number and isinstance(y, (int, float)) and not isinstance(y, bool) and x == y)  # noqa: E731, B023
                ok &= bool({"$eq": lambda: same(v), "$ne": lambda: not same(v), "$in": lambda: any(map(same, v)), "$gt": lambda: number and x > v, "$gte": lambda: number and x >= v, "$lt": lambda: number and x < v, "$lte": lambda: number and x <= v}[op]())  # noqa: B023
        if ok:
            out.append(i)
    return out


@pytest.mark.parametrize(
    "predicate",
    [{}, {"lang": "en"}, {"n": 1}, {"n": "1"}, {"n": True}, {"x": None}, {"x": 0}, {"x": {"$ne": None}}, {"n": {"$ne": 1}}, {"lang": {"$in": ["en", "fr"]}}, {"n": {"$in": []}},
     {"n": {"$gt": 1}}, {"n": {"$gte": 1, "$lt": 2.5}}, {"year": {"$lte": 2020}}, {"year": {"$gt": 0}}, {"lang": "en", "n": {"$lte": 1}}, {"lang": {"$in": [None, 1, "fr"]}}],
)
def test_predicates_on_dynamic_metadata(spark, predicate):
    df = spark.createDataFrame(list(enumerate(ROWS)), "id int, metadata string")
    assert sorted(r.id for r in df.where(compile_filter(predicate, df.schema, "metadata")).collect()) == truth(predicate)
    v = df.withColumn("metadata", F.try_parse_json("metadata"))
    assert sorted(r.id for r in v.where(compile_filter(predicate, v.schema, "metadata")).collect()) == truth(predicate)


def test_predicates_on_typed_columns(spark):
    df = spark.createDataFrame([(1, "a", True, 2.0), (2, None, None, None), (3, "b", False, 5.0)], "id int, s string, b boolean, n double")
    ids = lambda p: [r.id for r in df.where(compile_filter(p, df.schema)).orderBy("id").collect()]
    assert ids({"s": "a"}) == [1] and ids({"s": {"$ne": "a"}}) == [2, 3] and ids({"n": {"$gte": 2}}) == [1, 3] and ids({"b": False}) == [3]
    assert ids({"n": "2"}) == [] and ids({"n": {"$ne": "2"}}) == [1, 2, 3] and ids({"s": {"$gt": 1}}) == [] and ids({"none": 1}) == [] and ids({"none": {"$ne": 1}}) == [1, 2, 3]
    s = df.select("id", F.struct("s", "n").alias("m"))
    assert [r.id for r in s.where(compile_filter({"s": "b", "n": {"$gt": 4}}, s.schema, "m")).collect()] == [3]


@pytest.mark.parametrize("bad", [{"a": {"$regex": "x"}}, {"a": {"$in": 3}}, {"a": {"$gt": "x"}}, {"a": {"$lt": True}}, {"a": [1]}, {"a": {"$eq": [1]}}])
def test_bad_predicates_fail_before_anything_runs(spark, bad):
    with pytest.raises(ValueError):
        compile_filter(bad, spark.range(1).withColumn("a", F.lit(1)).schema)


def test_predicates_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, 2)], "id int, n int").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    plan = df.where(compile_filter({"n": {"$gte": 2}}, df.schema)).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(n,2)" in plan


# --- search


@pytest.mark.parametrize("metric", ["dot", "l2", "cosine"])
@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}])
def test_exact_search(spark, metric, options):
    x, q = synthetic.uniform(400, 33, 1, unit=metric == "cosine"), synthetic.uniform(7, 33, 2)
    x[5] = x[9]
    df = frame(spark, x)
    got = knn.knn_join(asked(spark, q), df, 10, metric, **options)
    want = brute(q, x, 10, metric)
    assert found(got, 7) == want
    assert found(knn.knn_join_native(asked(spark, q), df, 10, metric), 7) == want
    one = [r.id for r in knn.nearest(df, q[0].tolist(), 10, metric).collect()]
    assert one == want[0] == [r.id for r in knn.nearest(df, q[0].tolist(), 10, metric, native=True).collect()]


def test_exact_search_edges(spark):
    x = synthetic.uniform(20, 4, 1)
    df = frame(spark, x)
    q = asked(spark, x[:3])
    assert knn.knn_join(q, df, 50, "dot").count() == 60 and knn.nearest(df, [1, 0, 0, 0], 0).count() == 0
    assert all(r.q_id != r.id for r in knn.knn_join(q, df, 19, "dot", exclude_self=True).collect())
    assert knn.knn_join(q, df.where("false"), 5).count() == 0 and knn.knn_join(q.where("false"), df, 5).count() == 0
    ties = frame(spark, np.ones((30, 4)))
    assert found(knn.knn_join(q, ties, 5, "dot"), 3) == [[0, 1, 2, 3, 4]] * 3
    assert knn.with_threshold(knn.knn_join(q, df, 20, "cosine"), 2).count() == 0
    assert knn.recall(knn.knn_join(q, df, 5), knn.knn_join(q, df, 5), 5).first()[0] == 1.0
    with pytest.raises(Exception, match="dimension"):
        knn.knn_join(q, spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, vector array<float>").coalesce(1), 5).collect()
    names = spark.createDataFrame([("b", [1.0]), ("a", [1.0]), ("c", [2.0])], "id string, vector array<float>")
    assert [r.id for r in knn.knn_join(asked(spark, [[1.0]]), names, 2, "dot").orderBy("rank").collect()] == ["c", "a"]


@pytest.mark.parametrize(("bits", "floor"), [(8, 0.95), (4, 0.85), (1, 0.70)])
def test_quantised_recall(spark, bits, floor):
    x, q = synthetic.uniform(1000, 64, 20 + bits, unit=True), synthetic.uniform(10, 64, 30 + bits, unit=True)
    df, r = frame(spark, x), quant.Rotator(64)
    codes = quantized.encode(df, r, bits).persist()
    want = brute(q, x, 10)
    got = found(quantized.quantized_knn(asked(spark, q), codes, df, 10, r, bits), 10)
    raw = found(quantized.quantized_knn(asked(spark, q), codes, df, 10, r, bits, factor=1), 10)
    assert recall(want, got) >= floor and recall(want, raw) <= recall(want, got)
    by_join = quantized.code_hits(asked(spark, q), codes, 10, r, bits, broadcast_bytes=0)
    assert found(by_join, 10) == raw


def test_kmeans_finds_blobs():
    x, labels = synthetic.blobs(4, 50, 8, 1)
    c, a = ivf.kmeans(x, 4, seed=7)
    assert all(len(set(a[labels == i])) == 1 for i in range(4)) and len(set(a)) == 4
    assert np.array_equal(a, ivf.kmeans(x, 4, seed=7)[1])
    assert len(ivf.kmeans(x[:2], 5)[0]) == 2


def test_lloyd_step_and_training(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [2.0, 2.0]), (2, [10.0, 10.0])], "id long, vector array<float>")
    got = {r.cluster: (r.n, r.total) for r in ivf.lloyd_sums(df, np.array([[1.0, -1.0], [1.0, 1.0]])).collect()}
    assert got == {0: (1, [0.0, 0.0]), 1: (2, [12.0, 12.0])}
    x = synthetic.uniform(300, 8, 3, unit=True)
    a = ivf.train_centroids(frame(spark, x, 2), 12, seed=5)
    b = ivf.train_centroids(frame(spark, x, 7), 12, seed=5)
    assert np.allclose(a, b, atol=1e-9) and np.allclose(np.linalg.norm(a, axis=1), 1)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(ivf, "LOCAL_WORK", 0)
        assert np.allclose(a, ivf.train_centroids(frame(spark, x, 4), 12, seed=5), atol=1e-9)
    twin = ivf.train_centroids(frame(spark, np.ones((5, 3))), 4, seed=1)
    assert twin.shape == (4, 3) and np.isfinite(twin).all()


@pytest.mark.parametrize(("rows", "given", "want"), [(10_000, None, 100), (100, None, 16), (5, None, 5), (10**9, None, 4096), (50, 70, 50), (50, 0, 1)])
def test_choose_nlist(rows, given, want):
    assert ivf.choose_nlist(rows, given) == want


@pytest.mark.parametrize(("target", "want"), [(0.5, 1), (0.9, 2), (0.95, 8), (1.5, 8), (-1, 1)])
def test_choose_nprobe(spark, target, want):
    ranks = [0] * 6 + [1] * 3 + [7]
    curve = spark.createDataFrame([(p, sum(r < p for r in ranks) / 10) for p in range(1, 17)], "nprobe int, recall double")
    assert ivf.choose_nprobe(curve, target)[0] == want


def test_evenly_spaced():
    assert sampling.evenly_spaced(10, 4) == [0, 2, 5, 7] and sampling.evenly_spaced(3, 8) == [0, 1, 2] and sampling.evenly_spaced(0, 5) == []


def test_inverted_lists(spark, tmp_path):
    x, q = synthetic.uniform(2000, 32, 40, unit=True), synthetic.uniform(10, 32, 41, unit=True)
    df = frame(spark, x)
    c = ivf.train_centroids(ivf.hash_sample(df, 1500), 32, seed=1)
    lists = ivf.write_lists(ivf.assign(df, c), f"{tmp_path}/lists")
    want, ask = brute(q, x, 10), asked(spark, q)
    half = found(ivf.search(ask, lists, c, 10, 16), 10)
    assert recall(want, half) >= 0.8
    assert found(ivf.search(ask, lists, c, 10, 16, broadcast_bytes=0), 10) == half
    assert recall(want, found(ivf.search(ask, lists, c, 10, 32), 10)) >= 0.99
    plan = ivf.search(ask, lists, c, 10, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cluster" in plan or "cluster#" in plan.split("PartitionFilters")[1][:200]
    nprobe, estimate = ivf.tune(lists, c, 0.95)
    assert estimate >= 0.95 and recall(want, found(ivf.search(ask, lists, c, 10, nprobe), 10)) >= 0.85
    sizes = ivf.list_offsets(lists).orderBy("cluster").collect()
    assert sum(r.n for r in sizes) == 2000 and all(b.first == a.first + a.n for a, b in zip(sizes, sizes[1:]))


def test_graph_recall_persistence_and_growth():
    x = synthetic.uniform(600, 16, 2)
    q = synthetic.uniform(20, 16, 999)
    for metric in ("l2", "dot"):
        y = x if metric == "l2" else x / np.linalg.norm(x, axis=1, keepdims=True)
        g = hnsw.Graph(16, metric, 16, 200, seed=4)
        g.append(y)
        got = [[i for i, _ in g.search(v, 10, 128)] for v in q]
        assert recall(brute(q, y, 10, metric), got) >= 0.9
        spread = [[i for i, _ in g.search(v, 10, 128, "spread")] for v in q]
        assert recall(brute(q, y, 10, metric), spread) >= 0.85
    whole = hnsw.Graph(8, "l2", 8, seed=9)
    y = synthetic.uniform(300, 8, 9)
    whole.append(y)
    part = hnsw.Graph(8, "l2", 8, seed=9)
    part.append(y[:200])
    back = hnsw.Graph.restore(part.x, part.state(), "l2", 8, seed=9)
    assert (back.entry, back.top) == (part.entry, part.top)
    back.append(y[200:])
    assert back.state() == whole.state() and back.search(y[3], 5) == whole.search(y[3], 5)
    assert all(len(levels[0]) <= 16 and all(len(l) <= 8 for l in levels[1:]) for levels in whole.state())
    assert hnsw.Graph(4).search(np.ones(4), 3) == [] and whole.search(y[0], 0) == []


def test_sharded_graph(spark):
    x, q = synthetic.uniform(800, 32, 52, unit=True), synthetic.uniform(8, 32, 53, unit=True)
    df = frame(spark, x)
    g = hnsw.build(df, "dot", 4).persist()
    got = found(hnsw.search(asked(spark, q), g, 10, 128), 8)
    assert recall(brute(q, x, 10), got) >= 0.9
    few = df.where("id % 100 = 7")
    kept = found(hnsw.search(asked(spark, q), g, 10, 16, keep=few), 8)
    assert all(set(r) <= set(range(7, 800, 100)) and len(r) == 8 for r in kept)
    e = hnsw.edges(g)
    assert e.where("level = 0").count() == 800 and e.select(F.max(F.size("neighbours"))).first()[0] <= 32
    assert found(hnsw.search(asked(spark, q), g, 10, 128, broadcast_bytes=1), 8) == got  # in blocks
    assert recall(brute(q, x, 10), found(hnsw.search(asked(spark, q), g, 10, 128, entry_mode="spread"), 8)) >= 0.85
    exact = hnsw.search(asked(spark, q), g, 10, 800)  # walks that reach every row
    assert found(exact, 8) == brute(q, x, 10)
    plan = hnsw.search(asked(spark, q), g, 10, 128)._jdf.queryExecution().executedPlan().toString()
    assert "shard" not in plan.split("hashpartitioning")[1].split("\n")[0]


def test_samples_merge(spark):
    df = frame(spark, synthetic.uniform(500, 2, 1))
    whole = {r.id for r in sampling.hash_sample(df, 50).collect()}
    a, b = sampling.hash_sample(df.where("id < 100"), 50), sampling.hash_sample(df.where("id >= 100"), 50)
    assert {r.id for r in sampling.merge_samples(a, b, 50).collect()} == whole and len(whole) == 50


def test_synthetic_sources(spark):
    assert np.array_equal(synthetic.uniform(5, 3, 1), synthetic.uniform(5, 3, 1))
    assert np.allclose(np.linalg.norm(synthetic.clustered(50, 8), axis=1), 1, atol=1e-5)
    docs = synthetic.templated_documents(spark, 70)
    n = docs.selectExpr("min(size(split(text, ' ')))", "max(size(split(text, ' ')))", "count(distinct topic)").first()
    assert tuple(n) == (30, 59, 7)
    assert synthetic.records(spark, synthetic.uniform(2, 3, 1), [{"n": 1}, {}]).count() == 2


def test_matrix_refuses_ragged_and_null():
    assert knn.matrix(pa.array([[1.0, 2.0], [3.0, 4.0]])).tolist() == [[1, 2], [3, 4]]
    for bad in ([[1.0], [1.0, 2.0]], [[1.0], None], [[None], [1.0]]):
        with pytest.raises(ValueError):
            knn.matrix(pa.array(bad, pa.list_(pa.float64())))
    assert random.Random(1).random() == random.Random(1).random()


def test_normalising_takes_the_norm_once(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "a array<float>").select(V.normalize(F.col("a")).alias("u"))
    assert [r.u for r in df.collect()] == [pytest.approx([0.6, 0.8]), [0.0, 0.0], None]
    # once a vector, not once a coordinate
    assert df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
