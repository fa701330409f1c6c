"""Every query of the engine by name, with the SQL that checks it.

All run over whole tables. Where a search needs many queries, every row is one; where it needs one, the query is a fixed vector."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.functions import hashing, prng, quant
from nearfield.functions import vectors as V
from nearfield.operators import embedding, hnsw, ivf, knn, quantized, sampling
from nearfield.operators.predicate import compile_filter
from nearfield.sources import files, session, snapshot, synthetic
from nearfield.sources.store import Config, VectorStore
from nearfield.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIMENSION = 64
K = 10


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(session.prepare(spark), sf_dir)

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, embedding, label in as many partitions as there are cores: the file alone may be one split."""
    df = table(spark, sf_dir, "embeddings")
    return df.repartition(spark.sparkContext.defaultParallelism) if df.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism else df


def every_row(df: DataFrame) -> DataFrame:
    return df.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})


def _drawn(seed: int, i: str) -> str:
    """SQL of number i (from 0) that the generator draws from a seed, by its definition."""
    state = f"((({seed} + ({i} + 1)::UBIGINT * 1831565813) % 4294967296)::UBIGINT)"
    one = f"(xor({state}, {state} >> 15) * ({state} | 1)) % 4294967296"
    return f"list_transform([{one}], lambda t: list_transform([xor(t, (t + (xor(t, t >> 7) * (t | 61)) % 4294967296) % 4294967296)], lambda v: xor(v, v >> 14)::DOUBLE / 4294967296)[1])[1]"


# --- one query vector

QUERY = [float((i * 37 + 11) % 64) - 31.5 for i in range(DIMENSION)]
_Q = "list_transform(range(0, 64), lambda i: ((i * 37 + 11) % 64) - 31.5::DOUBLE)"
_E = "SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings"
_ONE = {
    "cosine": "list_inner_product(e, q) / sqrt(list_inner_product(q, q))",
    "dot": "list_inner_product(e, q)",
    "l2": "-list_sum(list_transform(list_zip(e, q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))",
}


def _one_sql(metric: str, where: str = "true", k: int = K, columns: str = "vec_id, label") -> str:
    return f"""WITH s AS (SELECT {columns}, {_ONE[metric]} AS s FROM ({_E}), (SELECT {_Q} AS q) WHERE {where})
SELECT {columns}, round(s, 6) + 0.0 AS score FROM s ORDER BY s DESC, vec_id LIMIT {k}"""


def _one(metric: str, native: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        hits = knn.nearest(table(spark, sf_dir, "embeddings"), QUERY, K, metric, "vec_id", "embedding", native)
        return rounded(hits.select("vec_id", "label", "score"), "score")

    return run


for _m in V.METRICS:
    query(_one_sql(_m), f"knn_{_m}_top10")(_one(_m))
query(_one_sql("cosine"), "knn_cosine_native")(_one("cosine", native=True))


@query(_one_sql("cosine", "label <> 3 AND label >= 2"))
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    df = df.where(compile_filter({"label": {"$ne": 3, "$gte": 2}}, df.schema))
    return rounded(knn.nearest(df, QUERY, K, "cosine", "vec_id", "embedding").select("vec_id", "label", "score"), "score")


@query(f"""SELECT vec_id, round(s, 6) + 0.0 AS score FROM (SELECT vec_id, {_ONE['cosine']} AS s FROM ({_E}), (SELECT {_Q} AS q)) WHERE s >= 0.1""")
def knn_score_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of at least a score: retrieval with a relevance cutoff."""
    q = np.array(QUERY) / np.linalg.norm(QUERY)
    df = table(spark, sf_dir, "embeddings").select("vec_id", V.dot(F.col("embedding"), V.vector_literal(q)).alias("score"))
    return rounded(knn.with_threshold(df, 0.1), "score")


# --- every row a query

_UNIT = "list_transform(e, lambda x: x / sqrt(list_inner_product(e, e)))"


def _batch_sql(metric: str, self_too: bool = True, k: int = K) -> str:
    q = _UNIT if metric == "cosine" else "e"
    score = {"l2": "-list_sum(list_transform(list_zip(b.e, a.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"}.get(metric, "list_inner_product(b.e, a.q)")
    return f"""WITH v AS ({_E}), a AS (SELECT vec_id, {q} AS q FROM v),
s AS (SELECT a.vec_id AS q_id, b.vec_id, {score} AS s FROM a, v b {'' if self_too else 'WHERE a.vec_id <> b.vec_id'}),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, vec_id) AS rank FROM s)
SELECT q_id, vec_id, round(s, 6) + 0.0 AS score, rank::INT AS rank FROM r WHERE rank <= {k}"""


def _batch(metric: str, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = corpus(spark, sf_dir)
        return rounded(knn.knn_join(every_row(df), df, K, metric, "vec_id", "embedding", **options), "score")

    return run


for _m in V.METRICS:
    query(_batch_sql(_m), f"knn_batch_{_m}")(_batch(_m))
query(_batch_sql("cosine"), "knn_batch_blocks")(_batch("cosine", broadcast_bytes=0))


@query(_batch_sql("cosine", self_too=False, k=9))
def knn_more_like_this(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = corpus(spark, sf_dir)
    return rounded(knn.knn_join(every_row(df), df, 9, "cosine", "vec_id", "embedding", exclude_self=True), "score")


# --- predicates

_FILTERS = {
    "filter_eq": ({"label": 3}, "label = 3"),
    "filter_ne": ({"label": {"$ne": 3}}, "label IS DISTINCT FROM 3"),
    "filter_in": ({"label": {"$in": [1, 4, 7]}}, "label IN (1, 4, 7)"),
    "filter_gt": ({"label": {"$gt": 6}}, "label > 6"),
    "filter_gte": ({"label": {"$gte": 6}}, "label >= 6"),
    "filter_lt": ({"label": {"$lt": 2}}, "label < 2"),
    "filter_lte": ({"label": {"$lte": 2}}, "label <= 2"),
    "filter_and": ({"label": {"$gte": 2, "$lt": 8, "$ne": 5}, "vec_id": {"$gt": 100}}, "label >= 2 AND label < 8 AND label <> 5 AND vec_id > 100"),
    "filter_empty": ({}, "true"),
    "filter_wrong_type": ({"label": "3"}, "false"),
}


def _filter(predicate: dict):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "embeddings")
        return df.where(compile_filter(predicate, df.schema)).select("vec_id", "label")

    return run


for _n, (_p, _w) in _FILTERS.items():
    query(f"SELECT vec_id, label FROM embeddings WHERE {_w}", _n)(_filter(_p))


def _doc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS DISTINCT FROM 1")
def filter_ne_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """$ne holds for documents that have no label."""
    df = _doc_labels(spark, sf_dir)
    return df.where(compile_filter({"quality": {"$ne": 1}}, df.schema)).select("doc_id", "quality")


@query("SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE toxic IS NULL")
def filter_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """$eq null holds for an explicit null of a dynamic record, not for a missing field."""
    df = _doc_labels(spark, sf_dir).withColumn(
        "metadata", F.when(F.col("quality").isNotNull(), F.to_json(F.struct("quality", "toxic"), {"ignoreNullFields": "false"})).otherwise(F.lit("{}"))
    )
    return df.where(compile_filter({"toxic": None}, df.schema, "metadata")).select("doc_id")


@query("SELECT event_id FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND (props->>'$.k')::DOUBLE >= 50")
def filter_json_gte(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return df.where(compile_filter({"k": {"$gte": 50}}, df.schema, "props")).select("event_id")


@query("SELECT event_id, props FROM events WHERE json_type(props, '$.k') = 'VARCHAR' AND props->>'$.k' = '69'")
def filter_strict_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A string operand never meets a number."""
    df = table(spark, sf_dir, "events")
    return df.where(compile_filter({"k": "69"}, df.schema, "props")).select("event_id", "props")


# --- vector functions


@query(f"""SELECT vec_id, unnest(range(0, 64))::INT AS i, unnest(list_transform({_UNIT}, lambda x: round(x::FLOAT::DOUBLE, 6) + 0.0)) AS x FROM ({_E})""")
def normalize_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(V.normalize(F.col("embedding"))).alias("i", "x"))
    return df.select("vec_id", "i", (F.round(F.col("x").cast("double"), 6) + F.lit(0.0)).alias("x"))


@query(f"""SELECT vec_id, round(sqrt(list_inner_product(e, e)), 6) AS norm, round(list_sum(list_transform(list_zip(e, q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS sq_dist,
round(list_inner_product(e, q) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(q, q))), 6) + 0.0 AS cosine FROM ({_E}), (SELECT {_Q} AS q)""")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = F.col("embedding"), V.vector_literal(QUERY)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(V.norm(e), 6).alias("norm"), F.round(V.sq_dist(e, q), 6).alias("sq_dist"), (F.round(V.cosine(e, q), 6) + F.lit(0.0)).alias("cosine")
    )


# --- text

TEXT_DIMENSION = 384
_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '')"


def _fnv(f: str, salt: int = 0) -> str:
    start = (2166136261 ^ salt) & 0xFFFFFFFF
    return f"list_reduce(list_concat([{start}::BIGINT], list_transform(string_split({f}, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


def _embedded_sql(source: str, id_col: str) -> str:
    """(id, idx, weight) of every text of a table."""
    return f"""tok AS (SELECT {id_col}, {_TOKENS.replace('text', 'coalesce(text, $$$$)')} AS t FROM {source}),
feat AS (SELECT {id_col}, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS f FROM tok),
hash AS (SELECT f, {_fnv('f')} AS h, {_fnv('f', hashing.SIGN_SALT)} AS g FROM (SELECT DISTINCT f FROM feat)),
cell AS (SELECT {id_col}, (h % {TEXT_DIMENSION})::INT AS idx, sum(CASE WHEN g & 1 = 0 THEN 1.0::DOUBLE ELSE -1.0 END) AS s FROM feat JOIN hash USING (f) GROUP BY ALL HAVING s <> 0),
emb AS (SELECT {id_col}, idx, s / sqrt(sum(s * s) OVER (PARTITION BY {id_col})) AS weight FROM cell)"""


@query(f"""SELECT token, {_fnv('token')} AS hash, n FROM (SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS token FROM documents) GROUP BY token)""")
def hash_fnv1a_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select(F.explode(hashing.tokenize(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return t.select("token", hashing.fnv1a(F.col("token")).alias("hash"), "n")


@query(f"WITH {_embedded_sql('documents', 'doc_id')} SELECT doc_id, idx, round(weight, 6) AS weight FROM emb")
def hash_embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(embedding.hashed_features(table(spark, sf_dir, "documents"), "doc_id", "text", TEXT_DIMENSION), "weight")


def _text_sql(queries: str, q_col: str, q_text: str) -> str:
    return f"""WITH {_embedded_sql('documents', 'doc_id')},
{_embedded_sql(queries, q_col).replace('tok ', 'qtok ').replace('FROM tok', 'FROM qtok').replace('feat ', 'qfeat ').replace('FROM feat', 'FROM qfeat').replace('hash ', 'qhash ').replace('JOIN hash', 'JOIN qhash').replace('cell ', 'qcell ').replace('FROM cell', 'FROM qcell').replace('emb ', 'qemb ')},
s AS (SELECT q.{q_col} AS q_id, d.doc_id, sum(q.weight * d.weight) AS s FROM qemb q JOIN emb d USING (idx) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(s, 5) DESC, doc_id) AS rank FROM s)
SELECT q_id, doc_id, round(s, 5) AS score, rank::INT AS rank FROM r WHERE rank <= {K}"""


def _text_hits(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Ties beyond five decimals fall by doc_id."""
    return knn.ranked(embedding.nearest_texts(queries, docs, K, dimension=TEXT_DIMENSION), K, "q_id", "doc_id")


@query(_text_sql("benchmark", "item_id", "text"))
def text_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest documents of every text of benchmark."""
    return _text_hits(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "q_id"), table(spark, sf_dir, "documents"))


_DENSE_SQL = (
    _text_sql("benchmark", "item_id", "text")
    .replace("sum(q.weight * d.weight) AS s", "sum(q.weight::FLOAT::DOUBLE / q.norm * d.weight::FLOAT::DOUBLE) AS s")
    .replace("FROM qemb q JOIN emb d USING (idx)", "FROM (SELECT *, sqrt(sum(weight::FLOAT::DOUBLE * weight::FLOAT::DOUBLE) OVER (PARTITION BY item_id)) AS norm FROM qemb) q JOIN emb d USING (idx)")
    .replace("ORDER BY round(s, 5) DESC, doc_id", "ORDER BY s DESC")
    .replace("SELECT q_id, doc_id, round(s, 5)", "SELECT q_id, round(s, 5)")
)


@query(_DENSE_SQL)
def text_knn_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text_knn over dense float32 vectors, as a store holds them: the scores by rank (copies tie in all but the last bits)."""
    docs = embedding.hashed_vectors(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", TEXT_DIMENSION)
    q = embedding.hashed_vectors(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), "text"), "q_id", "text", TEXT_DIMENSION)
    hits = knn.knn_join(q.select("q_id", F.col("vector").alias("q")), docs, K, "cosine", "doc_id", "vector")
    return hits.select("q_id", (F.round("score", 5) + F.lit(0.0)).alias("score"), "rank")


@query(_text_sql("(SELECT conv_id * 1000 + turn AS item_id, text FROM conversations WHERE role = 'user')", "item_id", "text"))
def session_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest documents of every user turn."""
    q = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("q_id"), "text")
    return _text_hits(q, table(spark, sf_dir, "documents"))


# --- rotation and codes


def _rotation_sql(coordinate: str = "round(sum(x * m), 9)") -> str:
    """rot(i, j, m): the rotation matrix from its signs, two rounds of H."""
    a, b = ((quant.DEFAULT_SEED ^ (0x9E3779B9 * (r + 1))) & 0xFFFFFFFF for r in range(2))
    return f"""sign AS (SELECT i, CASE WHEN {_drawn(a, 'i')} < 0.5 THEN -1 ELSE 1 END AS a, CASE WHEN {_drawn(b, 'i')} < 0.5 THEN -1 ELSE 1 END AS b FROM range(0, 64) t(i)),
h AS (SELECT i, j, 1 - 2 * (bit_count((i & j)::BIGINT) % 2) AS h FROM range(0, 64) a(i), range(0, 64) b(j)),
rot AS (SELECT x.i, y.j, sum(p.a * x.h * q.b * y.h)::DOUBLE / 64 AS m FROM h x JOIN h y ON x.j = y.i JOIN sign p ON p.i = x.i JOIN sign q ON q.i = x.j GROUP BY ALL),
flat AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings),
turned AS (SELECT vec_id, j AS i, {coordinate} AS x FROM flat JOIN rot USING (i) GROUP BY vec_id, j)"""


@query(f"WITH {_rotation_sql('sum(x * m)')} SELECT vec_id, i::INT AS i, round(x, 6) + 0.0 AS x FROM turned")
def rotate_hadamard(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))
    long = quantized.rotated(df, quant.Rotator(DIMENSION)).select(F.col("q_id").alias("vec_id"), F.posexplode("q").alias("i", "x"))
    return rounded(long, "x")


#: The largest magnitude of coordinates with 9 decimals has 9 itself: rounded to fewer it could be a tie.
_SCALE_DECIMALS = {8: 9, 4: 9, 1: 6}


def _codes_sql(bits: int) -> str:
    if bits == 1:
        code, scale = "CASE WHEN x >= 0 THEN 1 ELSE 0 END", "avg(abs(x)) OVER (PARTITION BY vec_id)"
    else:
        n = quant.LEVELS[bits]
        scale = "max(abs(x)) OVER (PARTITION BY vec_id)"
        code = f"greatest(-{n}, least({n}, floor(x / scale * {n} + 0.5)))"
    return f"WITH {_rotation_sql()}, c AS (SELECT *, {scale} AS scale FROM turned) SELECT vec_id, i::INT AS i, ({code})::INT AS code, round(scale, {_SCALE_DECIMALS[bits]}) AS scale FROM c"


def _codes(bits: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _spelled(quantized.encode(table(spark, sf_dir, "embeddings"), quant.Rotator(DIMENSION), bits, "vec_id", "embedding", rounding=9), bits)

    return run


def _spelled(codes: DataFrame, bits: int) -> DataFrame:
    def run(batches):
        for b in batches:
            if b.num_rows:
                packed = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                c = quant.unpack(packed, bits).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(c), pa.list_(pa.int32())), b.column(2)], ["vec_id", "codes", "scale"])

    rows = codes.mapInArrow(run, "vec_id long, codes array<int>, scale double")
    return rows.select("vec_id", F.posexplode("codes").alias("i", "code"), F.round("scale", _SCALE_DECIMALS[bits]).alias("scale"))


def _quant_knn(bits: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = corpus(spark, sf_dir)
        r = quant.Rotator(DIMENSION)
        codes = quantized.encode(df, r, bits, "vec_id", "embedding", rounding=9)
        return rounded(quantized.quantized_knn(every_row(df), codes, df, K, r, bits, "vec_id", "embedding"), "score")

    return run


def _quant_knn_sql(bits: int) -> str:
    """Candidates by the codes at k times the factor, then exactly."""
    value = "(2 * code - 1) * scale" if bits == 1 else f"code * scale / {quant.LEVELS[bits]}"
    inner = _codes_sql(bits).replace(f"round(scale, {_SCALE_DECIMALS[bits]}) AS scale", "scale")
    w = inner[5:]  # without WITH
    ctes, last = w.rsplit(" SELECT vec_id", 1)
    return f"""WITH {ctes}, k AS (SELECT vec_id{last}),
dec AS (SELECT vec_id, list({value} ORDER BY i) AS v FROM k GROUP BY vec_id),
full_ AS (SELECT vec_id, list(x ORDER BY i) AS v FROM (SELECT vec_id, j AS i, sum(x * m) AS x FROM flat JOIN rot USING (i) GROUP BY vec_id, j) GROUP BY vec_id),
c AS (SELECT q.vec_id AS q_id, d.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, d.v) DESC, d.vec_id) AS n FROM full_ q, dec d),
e AS ({_E}),
s AS (SELECT c.q_id, c.vec_id, list_inner_product(a.e, b.e) AS s FROM c JOIN e a ON a.vec_id = c.q_id JOIN e b ON b.vec_id = c.vec_id WHERE n <= {K * quant.RERANK_FACTOR[bits]}),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, vec_id) AS rank FROM s)
SELECT q_id, vec_id, round(s, 6) + 0.0 AS score, rank::INT AS rank FROM r WHERE rank <= {K}""".replace(", c AS (SELECT *", ", c0 AS (SELECT *").replace("FROM c),", "FROM c0),")


for _b in (8, 4, 1):
    query(_codes_sql(_b), f"quant_{_b}bit_codes")(_codes(_b))
    query(_quant_knn_sql(_b), f"quant_{_b}bit_knn_rerank")(_quant_knn(_b))


@query(
    "\nUNION ALL\n".join(
        f"""SELECT {b}::INT AS bits, round(max(err), 6) AS max_error, round(max(err / step), 4) <= 0.5 AS within_half_step FROM (
WITH {_rotation_sql()}, c AS (SELECT *, max(abs(x)) OVER (PARTITION BY vec_id) AS scale FROM turned)
SELECT abs(x - greatest(-{n}, least({n}, floor(x / scale * {n} + 0.5))) * scale / {n}) AS err, scale / {n} AS step FROM c)"""
        for b, n in quant.LEVELS.items()
    )
)
def quant_roundtrip_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far decoded vectors lie from the rotated ones: at most half a step."""
    df, r = table(spark, sf_dir, "embeddings"), quant.Rotator(DIMENSION)
    turned = quantized.rotated(every_row(df), r).select(F.col("q_id").alias("vec_id"), F.col("q").alias("x"))
    out = None
    for bits, level in quant.LEVELS.items():
        codes = quantized.encode(df, r, bits, "vec_id", "embedding", rounding=9)
        both = turned.join(quantized.decode(codes, r, bits, "vec_id"), "vec_id").join(codes.select("vec_id", "scale"), "vec_id")
        err = both.select(F.array_max(F.zip_with("x", "rotated", lambda a, b: F.abs(F.round(a, 9) - b))).alias("err"), (F.col("scale") / level).alias("step"))
        one = err.agg(
            F.lit(bits).alias("bits"), F.round(F.max("err"), 6).alias("max_error"), (F.round(F.max(F.col("err") / F.col("step")), 4) <= 0.5).alias("within_half_step")
        )
        out = one if out is None else out.unionByName(one)
    return out


# --- inverted lists

NLIST = 16
#: Fixed centroids, so that each step can be checked by SQL.
FIXED = ivf.unit_rows(np.array([[float((j * 131 + i * i * 17 + i * 7) % 97) - 48 for i in range(DIMENSION)] for j in range(NLIST)]))
_CENT = f"""cent AS (SELECT j AS cluster, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) AS c FROM
(SELECT j, list_transform(range(0, 64), lambda i: (((j * 131 + i * i * 17 + i * 7) % 97) - 48)::DOUBLE) AS c FROM range(0, {NLIST}) t(j))),
e AS ({_E}),
near AS (SELECT e.vec_id, cent.cluster, row_number() OVER (PARTITION BY e.vec_id ORDER BY list_inner_product(e.e, cent.c) DESC, cent.cluster) AS rank FROM e, cent),
own AS (SELECT e.*, near.cluster FROM e JOIN near USING (vec_id) WHERE rank = 1)"""


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.assign(corpus(spark, sf_dir), FIXED, "embedding")


@query(f"WITH {_CENT} SELECT vec_id, cluster::INT AS cluster FROM own")
def ivf_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).select("vec_id", "cluster")


@query(f"WITH {_CENT} SELECT cluster::INT AS cluster, i::INT AS i, round(avg(x), 6) + 0.0 AS x FROM (SELECT cluster, unnest(range(0, 64)) AS i, unnest(e) AS x FROM own) GROUP BY ALL")
def ivf_kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round's means, before they are normalised."""
    sums = ivf.lloyd_sums(corpus(spark, sf_dir), FIXED, "embedding")
    return rounded(sums.select("cluster", F.posexplode(F.transform("total", lambda x: x / F.col("n"))).alias("i", "x")), "x")


@query(f"WITH {_CENT} SELECT cluster::INT AS cluster, count(*) AS n FROM own GROUP BY cluster")
def ivf_list_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).groupBy("cluster").agg(F.count("*").alias("n"))


@query(f"WITH {_CENT}, s AS (SELECT cluster::INT AS cluster, count(*) AS n FROM own GROUP BY cluster) SELECT cluster, n, coalesce(sum(n) OVER (ORDER BY cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM s")
def ivf_list_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.list_offsets(_assigned(spark, sf_dir))


@query(f"WITH {_CENT} SELECT vec_id AS q_id, cluster::INT AS cluster, rank::INT AS rank FROM near WHERE rank <= 4")
def ivf_probe_top4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.probe(every_row(corpus(spark, sf_dir)), FIXED, 4).select("q_id", "cluster", "rank")


def _ivf_sql(nprobe: int) -> str:
    return f"""WITH {_CENT},
s AS (SELECT q.vec_id AS q_id, o.vec_id, list_inner_product(a.e, o.e) AS s FROM near q JOIN own o USING (cluster) JOIN e a ON a.vec_id = q.vec_id WHERE q.rank <= {nprobe}),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, vec_id) AS rank FROM s)
SELECT q_id, vec_id, round(s, 6) + 0.0 AS score, rank::INT AS rank FROM r WHERE rank <= {K}"""


def _ivf_knn(nprobe: int, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lists = ivf.write_lists(_assigned(spark, sf_dir), session.scratch(spark, "lists"))
        return rounded(ivf.search(every_row(corpus(spark, sf_dir)), lists, FIXED, K, nprobe, "vec_id", "embedding", **options), "score")

    return run


query(_ivf_sql(4), "ivf_knn_nprobe4")(_ivf_knn(4))
query(_ivf_sql(4), "ivf_knn_join")(_ivf_knn(4, broadcast_bytes=0))
query(_batch_sql("dot"), "ivf_knn_full")(_ivf_knn(NLIST))


@query(f"""WITH {_CENT},
p AS (SELECT a.vec_id AS q_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.e, b.e) DESC, b.vec_id) AS n FROM e a, e b WHERE a.vec_id <> b.vec_id),
need AS (SELECT near.rank FROM p JOIN own USING (vec_id) JOIN near ON near.vec_id = p.q_id AND near.cluster = own.cluster WHERE n <= {K}),
every_ AS (SELECT unnest(range(1, {NLIST} + 1)) AS nprobe)
SELECT nprobe::INT AS nprobe, (SELECT count(*) FROM need WHERE rank <= nprobe) AS hits, (SELECT count(*) FROM need WHERE rank <= nprobe)::DOUBLE / (SELECT count(*) FROM need) AS recall FROM every_""")
def ivf_tune_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _assigned(spark, sf_dir)
    return ivf.recall_curve(every_row(df), df, FIXED, K, "vec_id", "embedding")


def _trained(spark: SparkSession, sf_dir: str):
    df = corpus(spark, sf_dir)
    n = df.count()
    sample = ivf.hash_sample(df, ivf.SAMPLE_SIZE, "vec_id")
    centroids = ivf.train_centroids(sample, ivf.choose_nlist(n), "vec_id", "embedding", seed=1)
    return df, centroids, ivf.write_lists(ivf.assign(df, centroids, "embedding"), session.scratch(spark, "lists"))


def _training_sql(nlist: int, rounds: int, seed: int = 1) -> str:
    """Spherical k-means from drawn rows, round by round. No cluster falls empty with so few."""
    mean = lambda k: f"""c{k + 1} AS MATERIALIZED (SELECT cluster, list(x / norm ORDER BY i) AS c FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY cluster)) AS norm FROM (
SELECT cluster, i, avg(x) AS x FROM (SELECT cluster, unnest(range(0, 64)) AS i, unnest(e) AS x FROM (
SELECT e.e, arg_max(c.cluster, (list_inner_product(e.e, c.c), -c.cluster)) AS cluster FROM e, c{k} c GROUP BY e.vec_id, e.e)) GROUP BY cluster, i)) GROUP BY cluster)"""  # noqa: E731
    return f"""e AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY md5('1:' || vec_id), vec_id) - 1 AS pos FROM ({_E})), n AS (SELECT count(*) AS n FROM e),
c0 AS MATERIALIZED (SELECT k AS cluster, {_UNIT} AS c FROM (SELECT k, floor({_drawn(seed, 'k')} * n)::BIGINT AS pos FROM range(0, {nlist}) t(k), n) JOIN e USING (pos)),
{", ".join(mean(k) for k in range(rounds))}"""


@query(f"WITH {_training_sql(4, 2)} SELECT cluster::INT AS cluster, unnest(range(0, 64))::INT AS i, round(unnest(c), 6) + 0.0 AS x FROM c2")
def ivf_train_two_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids from seeded rows after two rounds."""
    c = ivf.train_centroids(corpus(spark, sf_dir), 4, "vec_id", "embedding", iterations=2)
    return rounded(ivf.centroid_table(spark, c).select("cluster", F.posexplode("centroid").alias("i", "x")), "x")


@query(_batch_sql("dot"))
def ivf_trained_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained centroids, all lists probed: exact. (ivf_train_two_rounds checks the training.)"""
    df, centroids, lists = _trained(spark, sf_dir)
    return rounded(ivf.search(every_row(df), lists, centroids, K, len(centroids), "vec_id", "embedding"), "score")


_CURVE = f"""{_CENT},
p AS (SELECT a.vec_id AS q_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.e, b.e) DESC, b.vec_id) AS n FROM e a, e b WHERE a.vec_id <> b.vec_id),
need AS (SELECT p.q_id, near.rank FROM p JOIN own USING (vec_id) JOIN near ON near.vec_id = p.q_id AND near.cluster = own.cluster WHERE n <= {K}),
curve AS (SELECT nprobe, (SELECT count(*) FROM need WHERE rank <= nprobe)::DOUBLE / (SELECT count(*) FROM need) AS recall FROM (SELECT unnest(range(1, {NLIST} + 1)) AS nprobe)),
size AS (SELECT cluster, count(*) AS n FROM own GROUP BY cluster),
read AS (SELECT nprobe, sum(size.n)::DOUBLE / (SELECT count(*) * count(*) FROM e) AS scanned FROM curve JOIN near ON near.rank <= nprobe JOIN size USING (cluster) GROUP BY nprobe)"""


@query(f"""WITH {_CURVE}, m AS (SELECT 'untuned' AS mode, 1 AS nprobe UNION ALL SELECT 'tuned', (SELECT min(nprobe) FROM curve WHERE recall >= 0.9))
SELECT mode, nprobe::INT AS nprobe, round(recall, 6) AS recall, round(scanned, 6) AS scanned FROM m JOIN curve USING (nprobe) JOIN read USING (nprobe)""")
def ivf_untuned_and_tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mode, nprobe, recall, scanned): the default nprobe against the least with a recall of 0.9, and the share of rows scanned."""
    df = _assigned(spark, sf_dir).persist()
    curve = ivf.recall_curve(every_row(df), df, FIXED, K, "vec_id", "embedding").persist()
    modes = [("untuned", ivf.default_nprobe(NLIST)), ("tuned", ivf.choose_nprobe(curve, 0.9)[0])]
    sizes = df.groupBy("cluster").agg(F.count("*").alias("n"))
    n, rows = df.count(), None
    for mode, nprobe in modes:
        read = ivf.probe(every_row(df), FIXED, nprobe).join(sizes, "cluster").agg((F.sum("n") / F.lit(float(n) * n)).alias("scanned"))
        one = curve.where(F.col("nprobe") == nprobe).crossJoin(read).select(F.lit(mode).alias("mode"), "nprobe", F.round("recall", 6).alias("recall"), F.round("scanned", 6).alias("scanned"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query()
def ivf_tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nlist, nprobe, estimate, recall): the tuner at a target of 0.9 against the recall over all rows."""
    df, centroids, lists = _trained(spark, sf_dir)
    nprobe, estimate = ivf.tune(lists, centroids, 0.9, "vec_id", "embedding")
    truth = knn.knn_join(every_row(df), df, K, "dot", "vec_id", "embedding")
    found = ivf.search(every_row(df), lists, centroids, K, nprobe, "vec_id", "embedding")
    r = knn.recall(truth, found, K, "vec_id")
    return r.select(F.lit(len(centroids)).alias("nlist"), F.lit(nprobe).alias("nprobe"), F.lit(estimate).alias("estimate"), "recall")


TARGET_RECALL = 0.9


@query()
def ivf_int8_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverted lists of 8-bit codes, re-ranked; nprobe is the least whose recall over all rows is the target."""
    df, r = corpus(spark, sf_dir), quant.Rotator(DIMENSION)
    codes = quantized.encode(df, r, 8, "vec_id", "embedding")
    sample = quantized.decode(codes.join(ivf.hash_sample(df.select("vec_id"), ivf.SAMPLE_SIZE, "vec_id"), "vec_id", "left_semi"), r, 8, "vec_id")
    centroids = ivf.train_centroids(sample, NLIST, "vec_id", "rotated")
    lists = ivf.write_lists(quantized.assign_codes(codes, centroids, 8, "vec_id"), session.scratch(spark, "lists"))
    base = quantized.decode(lists, r, 8, "vec_id").withColumnRenamed("rotated", "embedding").join(lists.select("vec_id", "cluster"), "vec_id")
    nprobe, _ = ivf.choose_nprobe(ivf.recall_curve(every_row(base), base, centroids, K, "vec_id", "embedding"), TARGET_RECALL)
    return rounded(quantized.ivf_knn(every_row(df), lists, centroids, df, K, nprobe, r, 8, "vec_id", "embedding"), "score")


def _code_lists(spark: SparkSession, sf_dir: str, bits: int, folder: str | None = None) -> tuple[DataFrame, DataFrame, np.ndarray, quant.Rotator]:
    df, r = corpus(spark, sf_dir), quant.Rotator(DIMENSION)
    centroids = r.rotate(FIXED)
    assigned = quantized.assign_codes(quantized.encode(df, r, bits, "vec_id", "embedding", rounding=9), centroids, bits, "vec_id")
    return df, ivf.write_lists(assigned, folder or session.scratch(spark, "lists")), centroids, r


def _code_lists_sql(bits: int, nprobe: int) -> str:
    """Lists of what the codes stand for, around the rotated fixed centroids."""
    rest = _quant_knn_sql(bits)
    head, tail = rest.split("c AS (SELECT q.vec_id AS q_id", 1)
    tail = tail[tail.index("e AS (") :]
    cent = _CENT[: _CENT.index(",\ne AS")]
    return f"""{head}{cent},
centr AS (SELECT cluster, list(x ORDER BY i) AS c FROM (SELECT cluster, j AS i, sum(x * m) AS x FROM (SELECT cluster, unnest(range(0, 64)) AS i, unnest(c) AS x FROM cent) JOIN rot USING (i) GROUP BY cluster, j) GROUP BY cluster),
home AS (SELECT d.vec_id, arg_max(c.cluster, (list_inner_product(d.v, c.c), -c.cluster)) AS cluster FROM dec d, centr c GROUP BY d.vec_id),
near AS (SELECT f.vec_id AS q_id, c.cluster, row_number() OVER (PARTITION BY f.vec_id ORDER BY list_inner_product(f.v, c.c) DESC, c.cluster) AS probe FROM full_ f, centr c),
c AS (SELECT near.q_id, home.vec_id, row_number() OVER (PARTITION BY near.q_id ORDER BY list_inner_product(f.v, d.v) DESC, home.vec_id) AS n
FROM near JOIN home USING (cluster) JOIN full_ f ON f.vec_id = near.q_id JOIN dec d ON d.vec_id = home.vec_id WHERE probe <= {nprobe}),
{tail}"""


def _code_lists_knn(bits: int, nprobe: int, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, lists, centroids, r = _code_lists(spark, sf_dir, bits)
        return rounded(quantized.ivf_knn(every_row(df), lists, centroids, df, K, nprobe, r, bits, "vec_id", "embedding", **options), "score")

    return run


for _b in (8, 4, 1):
    query(_code_lists_sql(_b, 6), f"ivf_{_b}bit_knn")(_code_lists_knn(_b, 6))
query(_code_lists_sql(4, 6), "ivf_4bit_knn_blocks")(_code_lists_knn(4, 6, broadcast_bytes=0))


@query("SELECT bits::INT AS bits, count(*) * 64 * bits // 8 AS code_bytes, count(*) * 64 * bits // 8 + count(*) * 8 < count(*) * 64 * 4 AS smaller FROM embeddings, (SELECT unnest([8, 4, 1]) AS bits) GROUP BY bits")
def ivf_code_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the lists of codes hold, scales and all, is smaller than the float32 vectors."""
    out = None
    for bits in (8, 4, 1):
        lists = _code_lists(spark, sf_dir, bits)[1]
        one = lists.agg(F.lit(bits).alias("bits"), F.sum(F.octet_length("codes")).alias("code_bytes"), (F.sum(F.octet_length("codes") + 8) < F.count("*") * DIMENSION * 4).alias("smaller"))
        out = one if out is None else out.unionByName(one)
    return out


_SAMPLE = "SELECT vec_id, label FROM embeddings ORDER BY md5('1:' || vec_id), vec_id LIMIT 100"


@query(_SAMPLE)
def sample_merge_is_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged samples of two parts: the sample of the whole."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    a, b = (sampling.hash_sample(df.where(c), 100, "vec_id") for c in ("label < 5", "label >= 5"))
    return sampling.merge_samples(a, b, 100, "vec_id")


@query(_SAMPLE)
def reservoir_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.hash_sample(table(spark, sf_dir, "embeddings").select("vec_id", "label"), 100, "vec_id")


@query(f"""WITH s AS (SELECT *, row_number() OVER (ORDER BY md5('1:' || vec_id), vec_id) - 1 AS pos FROM embeddings),
n AS (SELECT count(*) AS n FROM s), t AS (SELECT unnest(range(0, 32)) AS t)
SELECT DISTINCT vec_id FROM s JOIN (SELECT (t * n // least(n, 32)) AS pos FROM t, n WHERE t < least(n, 32)) USING (pos)""")
def sample_evenly_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the sample that the tuner takes as queries."""
    df = table(spark, sf_dir, "embeddings").select("vec_id")
    w = Window.orderBy(*sampling.by_hash("vec_id"))
    n = df.count()
    at = sampling.hash_sample(df, n, "vec_id").withColumn("at", F.row_number().over(w) - 1)
    return at.where(F.col("at").isin(sampling.evenly_spaced(n, ivf.TUNE_QUERIES))).select("vec_id")


# --- generators


@query(f"SELECT i, {_drawn(42, 'i')} AS u FROM range(0, 1000) t(i)")
def prng_mulberry32(spark: SparkSession, sf_dir: str) -> DataFrame:
    draw = prng.mulberry32(42)
    return spark.createDataFrame([(i, draw()) for i in range(1000)], "i long, u double")


@query(f"SELECT i, CASE WHEN {_drawn(77, 'i')} < 0.5 THEN -1.0 ELSE 1.0 END::DOUBLE AS sign FROM range(0, 256) t(i)")
def random_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(prng.random_signs(256, 77).tolist())), "i long, sign double")


@query(f"SELECT i // 8 AS n, i % 8 AS j, round(({_drawn(5, 'i')} * 2 - 1)::FLOAT::DOUBLE, 7) + 0.0 AS x FROM range(0, 800) t(i)")
def synthetic_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = synthetic.uniform(100, 8, 5).astype(float)
    df = spark.createDataFrame([(n, j, float(x[n, j])) for n in range(100) for j in range(8)], "n long, j long, x double")
    return df.withColumn("x", F.round("x", 7) + F.lit(0.0))


@query(f"SELECT i AS row, least(30, floor(-ln(1 - {_drawn(hnsw.SEED, 'i')}) / ln(16)))::INT AS level FROM range(0, 2000) t(i)")
def hnsw_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The levels that rows are inserted at, in order."""
    g = hnsw.Graph(2)
    return spark.createDataFrame([(i, g._level()) for i in range(2000)], "row long, level int")


@query("SELECT n, 2 ** greatest(2, ceil(log2(n)))::INT AS padded FROM (SELECT unnest(range(1, 2049))::INT AS n)")
def quant_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, float(quant.padded_dimension(n))) for n in range(1, 2049)], "n int, padded double")


@query("""SELECT bits, padded, padded % CASE bits WHEN 8 THEN 4 WHEN 4 THEN 8 ELSE 32 END = 0 AS ok
FROM (SELECT unnest([8, 4, 1])::INT AS bits), (SELECT unnest([4, 8, 16, 32, 64])::INT AS padded)""")
def quant_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which padded dimensions each code takes."""

    def ok(bits: int, padded: int) -> bool:
        try:
            quant.check_width(bits, padded)
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(b, p, ok(b, p)) for b in (8, 4, 1) for p in (4, 8, 16, 32, 64)], "bits int, padded int, ok boolean")


@query("""SELECT n, greatest(1, least(n, greatest(16, least(4096, round_even(sqrt(n), 0)))))::BIGINT AS nlist,
greatest(1, floor(0.05 * greatest(1, least(n, greatest(16, least(4096, round_even(sqrt(n), 0))))) + 0.5))::BIGINT AS nprobe
FROM (SELECT unnest([1, 5, 16, 17, 100, 400, 10000, 123456, 1000000, 20000000, 1000000000]) AS n)""")
def ivf_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, ivf.choose_nlist(n), ivf.default_nprobe(ivf.choose_nlist(n))) for n in (1, 5, 16, 17, 100, 400, 10000, 123456, 1000000, 20000000, 1000000000)]
    return spark.createDataFrame(rows, "n int, nlist long, nprobe long")


@query("SELECT unnest(['$regex', '$in', '$gt', 'list']) AS predicate, 'refused' AS outcome")
def predicates_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad predicates fail before anything runs."""
    schema, rows = table(spark, sf_dir, "embeddings").schema, []
    for name, bad in {"$regex": {"label": {"$regex": "x"}}, "$in": {"label": {"$in": 3}}, "$gt": {"label": {"$gt": "x"}}, "list": {"label": [1]}}.items():
        try:
            compile_filter(bad, schema)
            rows.append((name, "taken"))
        except ValueError:
            rows.append((name, "refused"))
    return spark.createDataFrame(rows, "predicate string, outcome string")


@query("SELECT unnest(['dimension', 'metric', 'bits', 'ann', 'graph of codes', 'l2 codes', 'width']) AS setting, 'refused' AS outcome")
def settings_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = {
        "dimension": {"dimension": 0}, "metric": {"dimension": 4, "metric": "x"}, "bits": {"dimension": 4, "quant_bits": 2}, "ann": {"dimension": 4, "ann": "tree"},
        "graph of codes": {"dimension": 64, "ann": "hnsw", "quant_bits": 8}, "l2 codes": {"dimension": 64, "metric": "l2", "quant_bits": 8}, "width": {"dimension": 16, "quant_bits": 1},
    }
    rows = []
    for name, config in bad.items():
        try:
            Config(**config)
            rows.append((name, "taken"))
        except ValueError:
            rows.append((name, "refused"))
    return spark.createDataFrame(rows, "setting string, outcome string")


# --- graph


def _graph(spark: SparkSession, sf_dir: str, shards: int = 8) -> DataFrame:
    at, df = session.scratch(spark, "graph"), corpus(spark, sf_dir)
    shards = max(shards, -(-df.count() // hnsw.SHARD_ROWS))
    hnsw.build(df, "dot", shards, "vec_id", "embedding").write.parquet(at)
    return spark.read.parquet(at)


@query()
def hnsw_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hnsw.search(every_row(corpus(spark, sf_dir)), _graph(spark, sf_dir), K, 64, "dot", "vec_id"), "score")


@query("SELECT vec_id, true AS linked, true AS bounded FROM embeddings")
def hnsw_edges_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row has layer-0 edges, at most 2m of them, and at most m on each layer above. (hnsw_exhaustive shows that all are reached.)"""
    g = _graph(spark, sf_dir, 4)
    most = F.when(F.col("level") == 0, 2 * hnsw.M).otherwise(hnsw.M)
    by_row = hnsw.edges(g, "vec_id").groupBy("shard", F.col("row").alias("nf_row")).agg(
        F.max((F.col("level") == 0) & (F.size("neighbours") > 0)).alias("linked"), F.min(F.size("neighbours") <= most).alias("bounded")
    )
    return hnsw.positions(g, "vec_id").join(by_row, ["shard", "nf_row"]).select("vec_id", "linked", "bounded")


def _exhaustive(entry_mode: str = "descend", keep: str | None = None, **options):
    """A walk whose beam holds all rows is exact if it reaches them all from its entry."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = corpus(spark, sf_dir)
        n, some = df.count(), None if keep is None else df.where(keep).select("vec_id")
        hits = hnsw.search(every_row(df), _graph(spark, sf_dir, 3), K, n, "dot", "vec_id", entry_mode, some, **options)
        return rounded(hits, "score")

    return run


query(_batch_sql("dot"), "hnsw_exhaustive")(_exhaustive())
query(_batch_sql("dot"), "hnsw_exhaustive_spread")(_exhaustive("spread"))
query(_batch_sql("dot"), "hnsw_exhaustive_blocks")(_exhaustive(broadcast_bytes=0))
query(_batch_sql("dot").replace("FROM a, v b ", "FROM a, v b WHERE b.label IN (1, 2)"), "hnsw_exhaustive_filtered")(_exhaustive(keep="label IN (1, 2)"))


#: Rows of a graph that is built four times over to be compared.
APPEND_ROWS = 2000


@query("SELECT 'restored' AS graph, true AS same UNION ALL SELECT 'grown', true UNION ALL SELECT 'packed', true")
def hnsw_append_and_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph restored from its links and added to is the graph that was never away; one added to in parts is that built at once.
    Of every row, in graphs of up to APPEND_ROWS of them."""
    df = corpus(spark, sf_dir)
    shards = max(1, -(-df.count() // APPEND_ROWS))

    def same(table: pa.Table) -> pa.Table:
        x = knn.matrix(table.sort_by("vec_id").column("embedding"))
        half = len(x) // 2
        whole, part = hnsw.Graph(DIMENSION, "dot"), hnsw.Graph(DIMENSION, "dot")
        whole.append(x)
        part.append(x[:half])
        back, packed = hnsw.Graph.restore(part.x, part.state(), "dot"), hnsw.Graph.unpack(part.pack(), "dot")
        for g in (part, back, packed):
            g.append(x[half:])
        return pa.table({"graph": ["restored", "grown", "packed"], "same": [g.state() == whole.state() for g in (back, part, packed)]})

    sharded = df.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), "vec_id", "embedding")
    checks = sharded.groupBy("shard").applyInArrow(same, "graph string, same boolean")
    return checks.groupBy("graph").agg(F.min("same").alias("same"))


def _recalls(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    df = corpus(spark, sf_dir)
    q, r = every_row(df), quant.Rotator(DIMENSION)
    graph = _graph(spark, sf_dir)
    found = {"hnsw_ef64": hnsw.search(q, graph, K, 64, "dot", "vec_id"), "hnsw_spread": hnsw.search(q, graph, K, 64, "dot", "vec_id", "spread")}
    for bits in (8, 4, 1):
        codes = quantized.encode(df, r, bits, "vec_id", "embedding")
        found[f"{bits}bit"] = quantized.quantized_knn(q, codes, df, K, r, bits, "vec_id", "embedding")
    _, centroids, lists = _trained(spark, sf_dir)
    tuned, _ = ivf.choose_nprobe(ivf.recall_curve(q, lists, centroids, K, "vec_id", "embedding"), TARGET_RECALL)
    found["ivf_default"] = ivf.search(q, lists, centroids, K, ivf.default_nprobe(len(centroids)), "vec_id", "embedding")
    found["ivf_tuned"] = ivf.search(q, lists, centroids, K, tuned, "vec_id", "embedding")
    found["ivf_int8_tuned"] = QUERIES["ivf_int8_knn"](spark, sf_dir)
    truth = knn.knn_join(q, df, K, "dot", "vec_id", "embedding").persist()
    return {name: knn.recall(truth, hits, K, "vec_id").select(F.lit(name).alias("index"), "recall") for name, hits in found.items()}


@query()
def recall_at_10_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(index, recall) of every approximate index against the exact join, every row a query."""
    out = None
    for one in _recalls(spark, sf_dir).values():
        out = one if out is None else out.unionByName(one)
    return out


#: The least recall that each index must have; the default nprobe of inverted lists promises none.
FLOORS = {"hnsw_ef64": 0.9, "hnsw_spread": 0.85, "8bit": 0.95, "4bit": 0.85, "1bit": 0.7, "ivf_tuned": 0.9, "ivf_int8_tuned": 0.9}


@query("SELECT index, true AS met FROM (VALUES " + ", ".join(f"('{n}')" for n in FLOORS) + ") t(index)")
def recall_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, one in _recalls(spark, sf_dir).items():
        if name in FLOORS:
            one = one.select("index", (F.col("recall") >= FLOORS[name]).alias("met"))
            out = one if out is None else out.unionByName(one)
    return out


#: Least recall by the width of the beam.
EF_FLOORS = {10: 0.8, 20: 0.85, 40: 0.9, 80: 0.95, 160: 0.98}


@query("SELECT ef::INT AS ef, true AS met FROM (VALUES " + ", ".join(f"({n})" for n in EF_FLOORS) + ") t(ef)")
def hnsw_ef_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, graph, out = corpus(spark, sf_dir), _graph(spark, sf_dir, 3), None
    truth = knn.knn_join(every_row(df), df, K, "dot", "vec_id", "embedding").persist()
    for ef, floor in EF_FLOORS.items():
        hits = hnsw.search(every_row(df), graph, K, ef, "dot", "vec_id")
        one = knn.recall(truth, hits, K, "vec_id").select(F.lit(ef).alias("ef"), (F.col("recall") >= floor).alias("met"))
        out = one if out is None else out.unionByName(one)
    return out


# --- the store


def _store(spark: SparkSession, sf_dir: str, **config) -> VectorStore:
    df = table(spark, sf_dir, "embeddings")
    store = VectorStore(spark, session.scratch(spark, "store"), Config(DIMENSION, **config))
    store.add_batch(df.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), F.to_json(F.struct("label")).alias("metadata")))
    return store


def _ids(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").cast("long").alias("vec_id"))


@query("SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1)::BIGINT AS n FROM embeddings")
def store_rows_are_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which id has which row number: from 0, in the order of the batch."""
    ordered = table(spark, sf_dir, "embeddings").repartitionByRange(3, "vec_id").sortWithinPartitions("vec_id")
    store = VectorStore(spark, session.scratch(spark, "store"), Config(DIMENSION))
    store.add_batch(ordered.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector")))
    return store.live().select(F.col("id").cast("long").alias("vec_id"), F.col("row").alias("n"))


@query("SELECT vec_id FROM embeddings WHERE label <> 3")
def store_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    store.delete_where({"label": 3})
    return _ids(store.live())


@query("SELECT vec_id, CASE WHEN label >= 5 THEN -1 ELSE label END::INT AS label FROM embeddings")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    store.upsert(store.live().where(F.get_json_object("metadata", "$.label").cast("int") >= 5).select("id", "vector", F.lit('{"label": -1}').alias("metadata")))
    return store.live().select(F.col("id").cast("long").alias("vec_id"), F.get_json_object("metadata", "$.label").cast("int").alias("label"))


@query("SELECT vec_id, CASE WHEN label >= 5 THEN -2 ELSE label END::INT AS label FROM embeddings")
def store_upsert_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of records with one id in a batch the last counts."""
    store = _store(spark, sf_dir)
    some = store.live().where(F.get_json_object("metadata", "$.label").cast("int") >= 5)
    first, last = (some.select("id", "vector", F.lit(f'{{"label": {n}}}').alias("metadata")) for n in (-1, -2))
    store.upsert(first.unionByName(last))
    return store.live().select(F.col("id").cast("long").alias("vec_id"), F.get_json_object("metadata", "$.label").cast("int").alias("label"))


@query("SELECT vec_id FROM embeddings UNION ALL SELECT -1")
def store_add_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    store.add({"id": "-1", "vector": [1.0] * DIMENSION, "metadata": {"label": 0}})
    return _ids(store.live())


@query("SELECT count(*) AS count, count(*) FILTER (label <> 3) AS left_, count(*) FILTER (label = 3) AS deleted, 1::BIGINT AS segments FROM embeddings")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    count = store.count
    store.delete_where({"label": 3})
    s = store.stats()
    return spark.createDataFrame([(count, s["count"], s["deleted"], s["segments"])], "count long, left_ long, deleted long, segments long")


@query(f"""WITH {_embedded_sql('documents', 'doc_id')}, f AS (SELECT doc_id, idx, weight::FLOAT::DOUBLE AS w FROM emb)
SELECT doc_id, idx, round((w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE, 4) AS weight FROM f""")
def store_add_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts embedded into a store: their vectors' cells."""
    store = VectorStore(spark, session.scratch(spark, "store"), Config(TEXT_DIMENSION), embedder=embedding.HashingEmbedder(TEXT_DIMENSION))
    store.add_texts(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text"))
    cells = store.live().select(F.col("id").cast("long").alias("doc_id"), F.posexplode("vector").alias("idx", "weight")).where("weight <> 0")
    return cells.select("doc_id", "idx", F.round(F.col("weight").cast("double"), 4).alias("weight"))


_WITHOUT = _batch_sql("dot").replace("FROM a, v b ", "FROM a, v b WHERE b.label <> 3")


def _exact_index(ann: str, bits: int = 0) -> dict:
    """An index that is exact as it looks at everything: what is searched then shows which rows it has."""
    return {"metric": "dot", "normalize": False, "ann": ann, "quant_bits": bits, "nprobe": 4096, "ef_search": 4096, "rerank_factor": 1000, "shard_rows": 200}


def _told_hits(store: VectorStore, df: DataFrame) -> DataFrame:
    hits = store.query_batch(every_row(df), K)
    w = Window.partitionBy("q_id").orderBy(F.desc("s"), "vec_id")
    hits = hits.select("q_id", F.col("id").cast("long").alias("vec_id"), F.col("score").alias("s")).withColumn("rank", F.row_number().over(w))
    return rounded(hits.select("q_id", "vec_id", F.col("s").alias("score"), "rank"), "score")


for _ann, _bits in (("ivf", 0), ("ivf", 4), ("hnsw", 0), (None, 8)):
    _name = f"{_ann or 'flat'}{_bits or ''}"

    @query(_batch_sql("dot"), f"index_reload_{_name}")
    def _reload(spark: SparkSession, sf_dir: str, ann=_ann, bits=_bits) -> DataFrame:
        """Built, then opened again from its folder: nothing is built."""
        store = _store(spark, sf_dir, **_exact_index(ann, bits))
        store.build()
        again = VectorStore(spark, store.root, store.config)
        hits = _told_hits(again, corpus(spark, sf_dir))
        assert again.stats()["indexed_segments"] == 0
        return hits

    @query(_batch_sql("dot"), f"index_append_{_name}")
    def _append(spark: SparkSession, sf_dir: str, ann=_ann, bits=_bits) -> DataFrame:
        """Records added to an index: one index segment more."""
        df = table(spark, sf_dir, "embeddings")
        part = lambda where: df.where(where).select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))
        store = VectorStore(spark, session.scratch(spark, "store"), Config(DIMENSION, **_exact_index(ann, bits)))
        store.add_batch(part("label < 7"))
        store.build()
        store.add_batch(part("label >= 7"))
        hits = _told_hits(store, corpus(spark, sf_dir))
        assert store.stats()["indexed_segments"] == 1
        return hits

    @query(_WITHOUT, f"index_delete_no_rebuild_{_name}")
    def _delete(spark: SparkSession, sf_dir: str, ann=_ann, bits=_bits) -> DataFrame:
        """Deleted records are left out by the search; the index stays."""
        store = _store(spark, sf_dir, **_exact_index(ann, bits))
        store.build()
        store.delete_where({"label": 3})
        hits = _told_hits(store, corpus(spark, sf_dir))
        assert store.stats()["indexed_segments"] == 0
        return hits


@query(_one_sql("cosine", "label IN (1, 2)", columns="vec_id"))
def store_query_few(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few records that meet a predicate are scored exactly, whatever the index."""
    store = _store(spark, sf_dir, normalize=False, quant_bits=1, rerank=False)
    q = np.array(QUERY) / np.linalg.norm(QUERY)
    hits = store.query_batch([q.tolist()], K, {"label": {"$in": [1, 2]}})
    return rounded(hits.select(F.col("id").cast("long").alias("vec_id"), "score"), "score")


@query("""WITH e AS (SELECT '{"id":"' || vec_id || '","metadata":{"label":' || label || '}}' AS t FROM embeddings), m AS (SELECT (sum(length(t)) + count(*) + 1)::BIGINT AS meta, count(*) AS n FROM e)
SELECT 1::BIGINT AS version, 64::BIGINT AS dimension, 0::BIGINT AS metric, 0::BIGINT AS normalize, n AS count, meta, 32 + meta + (4 - meta % 4) % 4 + 256 * n AS size FROM m""")
def snapshot_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of a blob's header, and its size."""
    data = _store(spark, sf_dir, normalize=False).export()
    words = [int.from_bytes(data[i : i + 4], "little") for i in range(4, 28, 4)]
    return spark.createDataFrame([(*words, len(data))], "version long, dimension long, metric long, normalize long, count long, meta long, size long")


@query("SELECT count(*) AS live, (count(*) - 1)::BIGINT AS last_row FROM embeddings WHERE label <> 3")
def store_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    store.delete_where({"label": 3})
    store.compact()
    return store.live().agg(F.count("*").alias("live"), F.max("row").alias("last_row"))


@query(f"SELECT vec_id, round(list_inner_product(e, e), 5) AS sq FROM ({_E}) WHERE vec_id = 17")
def store_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _store(spark, sf_dir).get("17")
    return spark.createDataFrame([(int(found["id"]), round(sum(x * x for x in found["vector"]), 5))], "vec_id long, sq double")


@query("SELECT 'refused' AS outcome, count(*) AS live FROM embeddings")
def dup_id_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch with an id that the store has is refused as a whole."""
    store = _store(spark, sf_dir)
    outcome = "taken"
    try:
        store.add_batch([{"id": "new", "vector": [1.0] * DIMENSION}, {"id": "1", "vector": [1.0] * DIMENSION}])
    except ValueError:
        outcome = "refused"
    return store.live().agg(F.lit(outcome).alias("outcome"), F.count("*").alias("live"))


@query(_one_sql("cosine", "label IN (1, 2)", columns="vec_id"))
def store_query_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir, normalize=False)
    q = np.array(QUERY) / np.linalg.norm(QUERY)
    hits = store.query_batch([q.tolist()], K, {"label": {"$in": [1, 2]}})
    return rounded(hits.select(F.col("id").cast("long").alias("vec_id"), "score"), "score")


_SAME = "SELECT vec_id, label, round(list_sum(embedding::DOUBLE[]), 5) + 0.0 AS total FROM embeddings"


def _told(store: VectorStore) -> DataFrame:
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return store.live().select(
        F.col("id").cast("long").alias("vec_id"), F.get_json_object("metadata", "$.label").cast("int").alias("label"), (F.round(total, 5) + F.lit(0.0)).alias("total")
    )


@query(_SAME)
def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _store(spark, sf_dir, normalize=False).export()
    return _told(VectorStore.import_(spark, session.scratch(spark, "store"), data))


@query(_SAME)
def snapshot_encrypted_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _store(spark, sf_dir, normalize=False).export("pass phrase")
    assert snapshot.is_sealed(data)
    return _told(VectorStore.import_(spark, session.scratch(spark, "store"), data, "pass phrase"))


@query(_SAME)
def store_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved, then opened again from its folder."""
    store = _store(spark, sf_dir, normalize=False)
    store.save()
    return _told(VectorStore(spark, store.root, store.config))


# --- streams


def _event_vector():
    return F.array(F.col("value"), F.hour("ts").cast("double"), F.lit(1.0), F.lit(0.0))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = VectorStore(spark, session.scratch(spark, "store"), Config(4))
    path = session.scratch(spark, "events")
    table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"), _event_vector().alias("vector"), F.to_json(F.struct("event_type")).alias("metadata")
    ).repartition(4).write.parquet(path)
    stream = spark.readStream.schema("id string, vector array<double>, metadata string").option("maxFilesPerTrigger", 2).parquet(path)
    ingest.ingest(stream, store).awaitTermination()
    return store.live().groupBy(F.get_json_object("metadata", "$.event_type").alias("event_type")).agg(F.count("*").alias("n"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS last_event FROM events GROUP BY user_id")
def stream_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's record is that of the last event, though events come in several micro-batches in no order."""
    store = VectorStore(spark, session.scratch(spark, "store"), Config(4))
    path = session.scratch(spark, "events")
    table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("id"), _event_vector().alias("vector"), F.to_json(F.struct("event_id")).alias("metadata"), F.struct("ts", "event_id").alias("at")
    ).repartition(4, F.hash("at")).write.parquet(path)
    schema = spark.read.parquet(path).schema
    ingest.upsert(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), store, "at").awaitTermination()
    return store.live().select(F.col("id").cast("long").alias("user_id"), F.get_json_object("metadata", "$.event_id").cast("long").alias("last_event"))


def _embedding_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = session.scratch(spark, "stream")
    table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), F.to_json(F.struct("label")).alias("metadata")).repartition(3).write.parquet(path)
    return spark.readStream.schema("id string, vector array<float>, metadata string").option("maxFilesPerTrigger", 1).parquet(path)


@query("SELECT vec_id FROM embeddings ORDER BY md5('1:' || vec_id), vec_id LIMIT 100")
def stream_running_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample of all arrivals so far, after three micro-batches."""
    store = VectorStore(spark, session.scratch(spark, "store"), Config(DIMENSION))
    ingest.running_sample(_embedding_stream(spark, sf_dir), store, 100).awaitTermination()
    at = f"{store.root}/samples/sample"
    return _ids(spark.read.parquet(f"{at}/{files.names(spark, at)[-1]}"))


@query(_batch_sql("dot"))
def stream_refreshed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index kept up by a stream: each micro-batch adds an index segment."""
    store = VectorStore(spark, session.scratch(spark, "store"), Config(DIMENSION, **_exact_index("ivf")))
    each = ingest.refreshing(store)
    _embedding_stream(spark, sf_dir).writeStream.foreachBatch(each).option("checkpointLocation", session.scratch(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return _told_hits(store, corpus(spark, sf_dir))


@query(_batch_sql("dot"))
def stream_standing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that arrive in a stream, each answered from the corpus."""
    df, out = corpus(spark, sf_dir), session.scratch(spark, "answers")
    path = session.scratch(spark, "asked")
    every_row(df).repartition(2).write.parquet(path)
    each = ingest.standing_query(None, df.withColumnRenamed("embedding", "vector"), K, lambda hits, n: hits.write.mode("overwrite").parquet(f"{out}/{n}"), "dot", "vec_id")
    stream = spark.readStream.schema("q_id long, q array<float>").option("maxFilesPerTrigger", 1).parquet(path)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", session.scratch(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.read.parquet(f"{out}/*"), "score")
