"""Seeded synthetic records."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.prng import mulberry32

SCHEMA = "id string, row long, vector array<float>"


def uniform(n: int, dimension: int, seed: int, unit: bool = False) -> np.ndarray:
    """Coordinates in [-1, 1) as float32, rows in order; unit rows on demand."""
    draw = mulberry32(seed)
    x = np.array([draw() * 2 - 1 for _ in range(n * dimension)], np.float32).reshape(n, dimension)
    if unit:
        norms = np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
        x = (x / np.where(norms > 0, norms, 1)).astype(np.float32)
    return x


def clustered(n: int, dimension: int, seed: int = 42, spread: float = 0.35) -> np.ndarray:
    """Unit rows around max(4, round(sqrt(n / 2))) unit centres in turn."""
    draw = mulberry32(seed)
    c = max(4, round((n / 2) ** 0.5))
    centres = np.array([draw() * 2 - 1 for _ in range(c * dimension)]).reshape(c, dimension)
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    noise = np.array([(draw() * 2 - 1) * spread for _ in range(n * dimension)]).reshape(n, dimension)
    x = centres[np.arange(n) % c] + noise
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def blobs(k: int, per: int, dimension: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, labels): per rows of noise in [-0.5, 0.5) around 10 on coordinate c mod dimension."""
    draw = mulberry32(seed)
    labels = np.repeat(np.arange(k), per)
    x = np.array([draw() - 0.5 for _ in range(k * per * dimension)]).reshape(-1, dimension)
    x[np.arange(len(x)), labels % dimension] += 10
    return x.astype(np.float32), labels


def records(spark: SparkSession, vectors: np.ndarray, metadata: list[dict] | None = None) -> DataFrame:
    """(id 'v<i>', row, vector) and, with metadata, a column of JSON."""
    import json

    rows = [(f"v{i}", i, [float(c) for c in v]) for i, v in enumerate(vectors)]
    if metadata is None:
        return spark.createDataFrame(rows, SCHEMA)
    return spark.createDataFrame([(*r, json.dumps(m)) for r, m in zip(rows, metadata)], SCHEMA + ", metadata string")


def templated_documents(spark: SparkSession, n: int, topics: tuple[str, ...] = ("sea", "farm", "steel", "music", "law", "cells", "trade")) -> DataFrame:
    """(id 'doc-<i>', text, topic): 30 to 59 words, made of the row number alone."""
    t = F.array(*(F.lit(x) for x in topics))
    base = spark.range(n).withColumn("topic", F.element_at(t, (F.col("id") % len(topics) + 1).cast("int")))
    word = lambda j: F.concat(F.col("topic"), F.lit("-"), (F.pmod(F.xxhash64("id", j), F.lit(97))).cast("string"))
    words = F.transform(F.sequence(F.lit(1), (F.lit(30) + F.col("id") % 30).cast("int")), word)
    return base.select(F.concat(F.lit("doc-"), F.col("id").cast("string")).alias("id"), F.array_join(words, " ").alias("text"), "topic")
