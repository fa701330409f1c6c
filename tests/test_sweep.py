"""All-pairs searches: the best so far against brute force, in bounded memory."""

import math
import tracemalloc

import numpy as np
import pytest

from nearfield.functions import quant
from nearfield.operators import embedding, hnsw, ivf, knn, quantized, sweep
from nearfield.plans import catalogue
from nearfield.sources import synthetic
from tests.test_operators import asked, brute, found, frame


@pytest.mark.parametrize("text", [False, True])
def test_best_equals_a_full_sort(text):
    rng = np.random.default_rng(1)
    for _ in range(100):
        n, m, k = rng.integers(1, 9), rng.integers(1, 60), rng.integers(1, 12)
        s = np.round(rng.normal(size=(n, m)), rng.integers(0, 3))
        s[rng.random((n, m)) < 0.1] = np.nan
        seen, ids = rng.random((n, m)) < 0.6, rng.permutation(m)
        ids = np.array([f"{i:03d}" for i in ids], object) if text else ids
        best = sweep.Best(n, k, True)
        for a in range(0, m, 7):
            rows = np.flatnonzero(seen[:, a : a + 7].any(1))
            block = np.where(seen[rows, a : a + 7], s[rows, a : a + 7], np.nan)
            i, j = best.candidates(block, rows)
            best.add(rows[i], block[i, j], ids[a : a + 7][j], 2 * block[i, j])
            if rng.random() < 0.5:
                best.settle()
        who, which, score = best.result()
        for q in range(n):
            want = sorted((-s[q, j], ids[j]) for j in range(m) if seen[q, j] and not np.isnan(s[q, j]))[:k]
            assert [(-x, i) for x, i in zip(score[who == q], which[who == q])] == want


def test_many_queries_take_bounded_memory():
    rng = np.random.default_rng(2)
    q, x = rng.normal(size=(20_000, 16)), rng.normal(size=(8192, 16))
    centroids = rng.normal(size=(64, 16))
    own = ivf.nearest_centroid(x, centroids)
    search = sweep.Search(5, "dot", lambda c, n: c[1], lambda q: q, own=lambda c, n: c[0], probes=lambda q: ivf.nearest_clusters(q, centroids, 8))
    tracemalloc.start()
    state = search.begin(q)
    state.offer(np.arange(len(x)), [own, x])
    who, rows, _ = state.result()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20  # all scores would be 1300 MB
    some = q[77] @ x.T
    near = np.isin(own, np.argsort(-(centroids @ q[77]))[:8])
    assert rows[who == 77].tolist() == [i for i in np.argsort(-some) if near[i]][:5]


@pytest.mark.parametrize("factor", [3, 1000])
def test_candidates_of_many_queries_are_ranked_where_they_are(spark, factor):
    x, q = synthetic.uniform(700, 32, 5, unit=True), synthetic.uniform(90, 32, 6, unit=True)
    x[40:60] = x[7]  # equals: the smaller id
    df, r = frame(spark, x), quant.Rotator(32)
    codes = quantized.encode(df, r, 4)
    few = quantized.quantized_knn(asked(spark, q), codes, df, 10, r, 4, factor=factor, broadcast_bytes=1 << 30)
    many = quantized.quantized_knn(asked(spark, q), codes, df, 10, r, 4, factor=factor, broadcast_bytes=0)
    assert found(many, 90) == found(few, 90)
    if factor == 1000:
        assert found(many, 90) == brute(q, x, 10)
    centroids = r.rotate(ivf.unit_rows(x[:9].astype(float)))
    lists = quantized.assign_codes(codes, centroids, 4)
    for nprobe in (3, 9):
        a, b = (quantized.ivf_knn(asked(spark, q), lists, centroids, df, 10, nprobe, r, 4, factor=factor, broadcast_bytes=n) for n in (1 << 30, 0))
        assert found(a, 90) == found(b, 90)


def test_a_block_task_keeps_only_the_best(spark):
    """Hits that are sent on grow with the queries, not with queries times blocks."""
    x = synthetic.uniform(9000, 8, 3)
    df, q = frame(spark, x, 1), asked(spark, x[:100])
    search = sweep.Search(5, "dot", sweep.vectors_at(0, df, "vector"), lambda q: q)
    assert sweep.run_search(q, df, search, "id", ["vector"], 1 << 30).count() == 500
    assert sweep.run_search(q, df, search, "id", ["vector"], 0).count() == 500
    assert found(knn.knn_join(q, df, 5, "dot", broadcast_bytes=0), 100) == brute(x[:100], x, 5)


@pytest.mark.parametrize("mode", ["descend", "spread"])
def test_a_beam_for_all_rows_is_not_walked(monkeypatch, mode):
    x = synthetic.uniform(900, 16, 4)
    g = hnsw.Graph(16, dtype=np.float32)
    g.append(x)
    walked = [sorted(r for r, _ in g.search(v, 10, 899, mode)) for v in x[:5]]
    monkeypatch.setattr(hnsw.Graph, "_walk", None)
    who, rows, _ = g.search_many(x, 10, 900, mode)
    assert [rows[who == i].tolist() for i in range(900)] == brute(x, x, 10)
    assert [sorted(rows[who == i].tolist()) for i in range(5)] == walked
    may = np.arange(900) % 3 == 0
    who, rows, _ = g.search_many(x[:20], 10, 900, mode, may)
    assert [(rows[who == i] // 3).tolist() for i in range(20)] == brute(x[:20], x[::3], 10)


def test_a_beam_for_all_rows_finds_what_is_reached_and_no_more():
    g = hnsw.Graph(4)
    g.append(synthetic.uniform(60, 4, 8).astype(float))
    g.base[:, :] = np.where(g.base == 5, -1, g.base)  # no edge leads to 5 any more
    start = g._enter(g.x, "descend")[0][:, 0]
    who, rows, _ = g.search_many(g.x, 60, 60)
    for i in range(60):
        met = set(np.flatnonzero(g._reach(np.array([start[i]]))).tolist())
        assert set(rows[who == i].tolist()) == met


def test_graphs_that_are_compared_have_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(catalogue, "APPEND_ROWS", 100)
    df = catalogue.QUERIES["hnsw_append_and_restore"](spark, "/root/testdata/sf0.001")
    assert sorted(tuple(r) for r in df.collect()) == [("grown", True), ("packed", True), ("restored", True)]


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 30])
def test_texts_meet_only_in_shared_cells(spark, broadcast_bytes):
    words = "ant bee cat dog elk fox gnu hen".split()
    texts = [" ".join(words[(i * j) % 8] for j in range(1, 1 + i % 5)) for i in range(60)] + ["ant bee cat"] * 3 + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    q = df.where("doc_id < 25 OR doc_id > 61").withColumnRenamed("doc_id", "q_id")
    got = {}
    # few cells: sums cancel, and products are negative
    for r in knn.ranked(embedding.nearest_texts(q, df, 40, dimension=8, broadcast_bytes=broadcast_bytes), 40, "q_id", "doc_id").orderBy("rank").collect():
        got.setdefault(r.q_id, []).append((r.doc_id, r.score))
    x = embedding.hashed_sums(texts, 8)
    norm = np.maximum(np.linalg.norm(x, axis=1), 1e-9)
    for i in (*range(25), 62, 63, 64):
        s = {j: float(x[i] @ x[j] / norm[i] / norm[j]) for j in range(len(texts)) if ((x[i] != 0) & (x[j] != 0)).any()}
        want = sorted((-math.copysign(math.floor(abs(v) * 1e5 + 0.5), v) / 1e5, j) for j, v in s.items())[:40]
        assert [d for d, _ in got.get(i, [])] == [j for _, j in want]
        assert [v for _, v in got.get(i, [])] == pytest.approx([-v for v, _ in want])
