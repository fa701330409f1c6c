"""Embedding of text tables by feature hashing, and the embedder interface."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions import hashing
from nearfield.operators import sweep
from nearfield.operators.knn import matrix


class Embedder(Protocol):
    """Turns a batch of texts into vectors of one dimension, in order."""

    dimension: int

    def embed(self, texts: list[str]) -> list[np.ndarray]: ...


_TOKEN = np.zeros(256, bool)
_TOKEN[48:58] = _TOKEN[97:123] = True


def _fold(h: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """FNV-1a of data[start:start+size] continued from h, a byte of all spans at a time."""
    order = np.argsort(-size, kind="stable")
    h, start, size = h[order].astype(np.uint32), start[order], size[order]
    for p in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -p, side="left"))  # spans longer than p
        h[:n] = (h[:n] ^ data[start[:n] + p]) * np.uint32(16777619)
    out = np.empty_like(h)
    out[order] = h
    return out


def hashed_sums(texts: list[str | None], dimension: int, bigrams: bool = True) -> np.ndarray:
    """(texts, dimension): the signed sums of the hashed features of each text, not normalised."""
    parts = [(t or "").lower().encode() for t in texts]
    data = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    edge = np.diff(np.r_[False, _TOKEN[data], False].astype(np.int8))
    start = np.flatnonzero(edge == 1)
    size = np.flatnonzero(edge == -1) - start
    row = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), start, side="right")
    both = np.flatnonzero(row[1:] == row[:-1]) if bigrams else np.zeros(0, np.int64)
    at, sign = [], []
    with np.errstate(over="ignore"):
        for salt in (0, hashing.SIGN_SALT):
            one = _fold(np.full(len(start), 2166136261 ^ salt, np.uint32), data, start, size)
            two = (one[both] ^ np.uint32(32)) * np.uint32(16777619)
            h = np.concatenate([one, _fold(two, data, start[both + 1], size[both + 1])])
            (sign if salt else at).append(1.0 - 2.0 * (h & np.uint32(1)) if salt else h % np.uint32(dimension))
    cell = np.concatenate([row, row[both]]) * dimension + at[0].astype(np.int64)
    return np.bincount(cell, sign[0], len(texts) * dimension).reshape(len(texts), dimension)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def hashed_features(docs: DataFrame, id_col: str, text_col: str, dimension: int = 384, bigrams: bool = True) -> DataFrame:
    """(id, idx, weight): the sparse hashed bag of features of every row, normalised. Sums that cancel to 0 are left out; a
    text without tokens has no row. Narrow: each row is hashed where it lies."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                x = _unit(hashed_sums(part.column(1).to_pylist(), dimension, bigrams))
                i, j = np.nonzero(x)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), pa.array(j.astype(np.int32)), pa.array(x[i, j])], [id_col, "idx", "weight"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"{id_col} {kind}, idx int, weight double")


def hashed_counts(docs: DataFrame, id_col: str, text_col: str, name: str, dimension: int = 384, bigrams: bool = True) -> DataFrame:
    """(id, name ARRAY<INT>): the signed sums of every row, not normalised; a text whose sums are all 0 has no row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                x = hashed_sums(part.column(1).to_pylist(), dimension, bigrams).astype(np.int32)
                i = np.flatnonzero(x.any(1))
                ends = pa.array(np.arange(len(i) + 1, dtype=np.int32) * dimension)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), pa.ListArray.from_arrays(ends, pa.array(x[i].ravel()))], [id_col, name])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"{id_col} {kind}, {name} array<int>")


def nearest_texts(queries: DataFrame, docs: DataFrame, k: int, q_text: str = "text", id_col: str = "doc_id", text_col: str = "text", dimension: int = 384, decimals: int = 5, broadcast_bytes: int = sweep.BROADCAST_BYTES) -> DataFrame:
    """(q_id, id, score): for each text of queries at least its k best of docs by the cosine of hashed features, rounded; ties by id.
    Texts that share no cell don't meet.

    Texts are hashed where they lie and compared as dense blocks: pairs in shared cells would be hundreds for each two texts."""
    x = hashed_counts(docs, id_col, text_col, "cells", dimension)
    q = hashed_counts(queries, "q_id", q_text, "q", dimension)
    ten = 10.0**decimals

    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        s = sweep.pair_scores("dot", a, b) * ten
        return np.copysign(np.floor(np.abs(s) + 0.5), s) / ten + 0.0

    def seen(columns: list, n: int) -> np.ndarray:
        return _unit(sweep.vectors_of(columns[0], n, np.int32) if isinstance(columns[0], pa.Scalar) else matrix(columns[0]))

    # a rounded score is within half a unit of the last place, a float32 product of unit vectors within 1e-4 of the true one
    how = sweep.Search(k, "dot", seen, _unit, pair=pair, apart=1 / ten + 1e-4)
    return sweep.run_search(q, x, how, id_col, ["cells"], broadcast_bytes, most=docs.count())


def hashed_vectors(docs: DataFrame, id_col: str, text_col: str, dimension: int = 384, bigrams: bool = True) -> DataFrame:
    """docs with vector ARRAY<FLOAT>: the dense form."""
    return docs.withColumn("vector", embed_column(HashingEmbedder(dimension, bigrams))(F.col(text_col)))


class HashingEmbedder:
    """The deterministic feature-hashing embedder; equals hashing.hashing_embed()."""

    def __init__(self, dimension: int = 384, bigrams: bool = True):
        self.dimension, self.bigrams = dimension, bigrams

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for a in range(0, len(texts), 512):
            out += list(_unit(hashed_sums(texts[a : a + 512], self.dimension, self.bigrams)).astype(np.float32))
        return out


class ModelEmbedder:
    """A sentence model, loaded once a worker by `load` (which must return texts -> vectors); mean pooling and
    normalisation are the model's. Nothing is loaded or imported before the first batch."""

    def __init__(self, load: Callable[[], Callable[[list[str]], list[np.ndarray]]], dimension: int = 384):
        self.load, self.dimension, self._model = load, dimension, None

    def __getstate__(self):
        return {"load": self.load, "dimension": self.dimension, "_model": None}

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        if self._model is None:
            self._model = self.load()
        return self._model(texts)


def embed_column(embedder: Embedder) -> Callable[[Column], Column]:
    """An Arrow-batched UDF text -> ARRAY<FLOAT>; a vector of another dimension fails the task."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            made = embedder.embed(["" if t is None else t for t in texts.tolist()])
            for v in made:
                if len(v) != embedder.dimension:
                    raise ValueError(f"embedder gave {len(v)} coordinates; its dimension is {embedder.dimension}")
            yield pd.Series([np.asarray(v, np.float32) for v in made])

    return embed
