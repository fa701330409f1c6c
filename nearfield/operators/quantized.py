"""Flat index over rotated scalar codes, with exact re-ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions import quant
from nearfield.operators import ivf, sweep
from nearfield.operators.knn import matrix, ranked
from nearfield.operators.sweep import BROADCAST_BYTES


def encode(vectors: DataFrame, rotator: quant.Rotator, bits: int, id_col: str = "id", vector_col: str = "vector", rounding: int | None = None) -> DataFrame:
    """(id, codes BINARY, scale): each vector rotated and coded; bits/8 bytes a padded coordinate. rounding: decimals to
    which rotated coordinates are rounded first."""
    quant.check_width(bits, rotator.padded)
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = rotator.rotate(matrix(b.column(1), rotator.dimension))
            codes, scale = quant.quantize(x if rounding is None else np.round(x, rounding), bits)
            packed = quant.pack(codes, bits)
            data = pa.array([row.tobytes() for row in packed], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), data, pa.array(scale)], [id_col, "codes", "scale"])

    return vectors.select(id_col, vector_col).mapInArrow(run, f"{id_col} {kind}, codes binary, scale double")


def decode_arrays(codes: pa.Array, scale: pa.Array, bits: int) -> np.ndarray:
    packed = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(codes), -1)
    return quant.dequantize(quant.unpack(packed, bits), np.asarray(scale), bits)


def decode_batch(b: pa.RecordBatch, bits: int, codes: int = 1, scale: int = 2) -> np.ndarray:
    return decode_arrays(b.column(codes), b.column(scale), bits)


def codes_payload(bits: int) -> ivf.Payload:
    """Codes and scales, decoded as they are scanned."""

    def decoded(columns: list, n: int) -> np.ndarray:
        codes = columns[0].as_buffer() if isinstance(columns[0], pa.Scalar) else b"".join(columns[0].to_pylist())
        return quant.dequantize(quant.unpack(np.frombuffer(codes, np.uint8).reshape(n, -1), bits), sweep.numbers_of(columns[1], np.float64), bits)

    return ivf.Payload(["codes", "scale"], decoded)


def assign_codes(codes: DataFrame, centroids: np.ndarray, bits: int, id_col: str = "id") -> DataFrame:
    """(id, codes, scale, cluster): each code's nearest centroid (of rotated vectors) by what it stands for."""
    kind = codes.schema[id_col].dataType.simpleString()
    sent = codes.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = ivf.nearest_centroid(decode_batch(b, bits), sent.value) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(c.astype(np.int32))], [id_col, "codes", "scale", "cluster"])

    return codes.select(id_col, "codes", "scale").mapInArrow(run, f"{id_col} {kind}, codes binary, scale double, cluster int")


def ivf_knn(
    queries: DataFrame, lists: DataFrame, centroids: np.ndarray, vectors: DataFrame, k: int, nprobe: int, rotator: quant.Rotator, bits: int, id_col: str = "id",
    vector_col: str = "vector", factor: int | None = None, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """k * factor candidates by the codes of the probed lists, the k best of them exactly. lists: see assign_codes()."""
    factor = quant.RERANK_FACTOR[bits] if factor is None else factor
    nprobe = max(1, min(nprobe, len(centroids)))
    if factor > 1 and not sweep.fits(*sweep.side(queries, "q"), k * factor, broadcast_bytes):
        both = lists.select(id_col, "codes", "scale", "cluster").join(vectors.select(id_col, vector_col), id_col)
        how, columns, sort = ivf.list_search(
            k, both, centroids, nprobe, codes_payload(bits)._replace(columns=["codes", "scale", vector_col]), rotator.rotate, sweep.vectors_at(2, vectors, vector_col), factor
        )
        both = both.repartition("cluster").sortWithinPartitions("cluster") if sort else both
        return ranked(sweep.run_search(queries, both, how, id_col, columns, broadcast_bytes, sort), k, "q_id", id_col)
    hits = ivf.search(rotated(queries, rotator), lists, centroids, k * factor, nprobe, id_col, broadcast_bytes=broadcast_bytes, payload=codes_payload(bits))
    return hits if factor <= 1 else rerank(queries, hits, vectors, k, "dot", id_col, vector_col)


def decode(codes: DataFrame, rotator: quant.Rotator, bits: int, id_col: str = "id") -> DataFrame:
    """(id, rotated ARRAY<DOUBLE>): the rotated vectors that the codes stand for."""
    kind = codes.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(decode_batch(b, bits)), pa.list_(pa.float64()))], [id_col, "rotated"])

    return codes.select(id_col, "codes", "scale").mapInArrow(run, f"{id_col} {kind}, rotated array<double>")


def code_hits(queries: DataFrame, codes: DataFrame, k: int, rotator: quant.Rotator, bits: int, id_col: str = "id", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(q_id, id, score, rank) by the codes alone: the full-precision rotated query against what the codes stand for."""
    how = sweep.Search(k, "dot", codes_payload(bits).matrix, rotator.rotate)
    return ranked(sweep.run_search(queries, codes, how, id_col, ["codes", "scale"], broadcast_bytes), k, "q_id", id_col)


def rotated(queries: DataFrame, rotator: quant.Rotator) -> DataFrame:
    q_kind = queries.schema["q_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = rotator.rotate(matrix(b.column(1), rotator.dimension))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["q_id", "q"])

    return queries.select("q_id", "q").mapInArrow(run, f"q_id {q_kind}, q array<double>")


def rerank(queries: DataFrame, hits: DataFrame, vectors: DataFrame, k: int, metric: str = "dot", id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """The k best of the candidates by their exact scores. Candidates and vectors meet on the id: a shuffle of the narrow
    candidates and a scan of the vectors, of which AQE makes a broadcast where the candidates are few."""
    from nearfield.functions import vectors as V

    pairs = hits.select("q_id", id_col).join(vectors.select(id_col, vector_col), id_col).join(queries.select("q_id", "q"), "q_id")
    kind, q_kind = vectors.schema[id_col].dataType.simpleString(), queries.schema["q_id"].dataType.simpleString()
    if metric not in V.METRICS:
        raise ValueError(f"unknown metric {metric!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = matrix(b.column(2)), matrix(b.column(3))
            s = -((x - y) ** 2).sum(1) if metric == "l2" else np.einsum("ij,ij->i", x, y)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], ["q_id", id_col, "score"])

    exact = pairs.select("q_id", id_col, vector_col, "q").mapInArrow(run, f"q_id {q_kind}, {id_col} {kind}, score double")
    return ranked(exact, k, "q_id", id_col)


def quantized_knn(
    queries: DataFrame, codes: DataFrame, vectors: DataFrame, k: int, rotator: quant.Rotator, bits: int, id_col: str = "id", vector_col: str = "vector",
    factor: int | None = None, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """k * factor candidates by the codes, the k best of them exactly. factor 1 leaves the codes' own order.

    Candidates of many queries aren't sent anywhere: codes and vectors travel together, and each block of queries ranks its own."""
    factor = quant.RERANK_FACTOR[bits] if factor is None else factor
    if factor > 1 and not sweep.fits(*sweep.side(queries, "q"), k * factor, broadcast_bytes):
        both = codes.select(id_col, "codes", "scale").join(vectors.select(id_col, vector_col), id_col)
        how = sweep.Search(k, "dot", codes_payload(bits).matrix, rotator.rotate, sweep.vectors_at(2, vectors, vector_col), factor)
        return ranked(sweep.run_search(queries, both, how, id_col, ["codes", "scale", vector_col], broadcast_bytes), k, "q_id", id_col)
    hits = code_hits(queries, codes, k * factor, rotator, bits, id_col, broadcast_bytes)
    return hits if factor <= 1 else rerank(queries, hits, vectors, k, "dot", id_col, vector_col)
