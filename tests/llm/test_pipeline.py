"""The pipeline against a brute-force version of its stages, on a small corpus."""

import math
import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa

import corpus_pipeline
from nearfield.llm import language_id, simhash, textscan
from tests.llm.test_corpus import coding, components, drain, leaks, ppm_bits

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(data, items, model_texts, lang):
    even = math.log2(len({b for ts in model_texts.values() for t in ts for b in t}))
    en = []
    for d, t in data:
        if t:
            bits = ppm_bits(model_texts, 3, 4, t.encode())
            least = min(bits.values())
            if least <= even * len(t.encode()) + language_id.SLACK_BITS and bits.get(lang[d], least) - least <= language_id.LABEL_BITS:
                en.append((d, t))
    gone = drain(en)
    lines = []
    for d, t in en:
        kept = "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)
        if kept == t or kept.strip():
            lines.append((d, kept))
    texts = [t for _, t in lines]
    f, words = simhash.fingerprints(*textscan.string_spans(pa.array(texts)))
    near = [(a, b) for a, b in combinations(range(len(texts)), 2) if words[a] and words[b] and np.unpackbits(f[a] ^ f[b]).sum() <= simhash.MAX_DISTANCE]
    top = components(len(texts), near)
    first = defaultdict(lambda: 10**9)
    for i, t in enumerate(top):
        first[t] = min(first[t], lines[i][0])
    single = [x for i, x in enumerate(lines) if first[top[i]] == x[0]]
    enc = coding()
    return sorted((d, enc.encode_ordinary(t)) for d, t in single if not leaks(t, items))


def test_pipeline(spark, tmp_path):
    r = random.Random(21)
    words = ["".join(r.choices("etaoinshrdlu", k=r.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(r.choices(words, k=n))
    items = [(i, prose(20)) for i in range(4)]
    data = []
    for i in range(60):
        data.append((i, "\n".join(prose(r.randint(8, 30)) for _ in range(r.randint(1, 4)))))
    data += [(100 + i, data[i][1]) for i in range(5)]  # copies
    near = data[7][1].split(" ")
    near[3] = "changed"
    data.append((110, " ".join(near)))
    data += [(120 + i, f"{prose(25)}\nthis page was printed on day {i} of the year\n{prose(9)}") for i in range(6)]
    data += [(130, prose(12) + " " + items[1][1] + " " + prose(5)), (131, items[2][1].upper()), (140, "漢字" * 30), (141, ""), (142, None)]
    docs = spark.createDataFrame([(d, t, None if d == 140 else "en" if d % 2 else "xx", "s", None if t is None else len(t)) for d, t in data], DOCS)
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((x.doc_id, x.token_ids) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())
    samples = language_id.training_sample(docs, language_id.TRAIN_DOCS)
    lang = {x.doc_id: x.lang for x in docs.collect()}
    assert got == brute(data, items, samples, lang)
    kept = {d for d, _ in got}
    assert not kept & {100, 101, 110, 130, 131, 140, 141, 142} and {0, 1, 7, 59, 120, 125} <= kept


def test_stages_keep_the_columns(spark, tmp_path):
    spark.createDataFrame([(1, "a question of some words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    extra = DOCS + ", leaf long, node string, count int"
    docs = spark.createDataFrame([(1, "the river and the stone " * 9, "en", "s", 5, 1, "x", 2), (None, "words", None, None, None, None, None, None)], extra)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for table in (docs, docs.where("false")):
        out = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, str(tmp_path))
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            out = textscan.materialize(out, "test")
        assert corpus_pipeline.STAGES[-1][1](spark, out, str(tmp_path)).count() == table.count()
