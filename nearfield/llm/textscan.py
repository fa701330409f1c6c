"""Byte-level views of Arrow text and the few helpers that the operators share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Odd, so that it has an inverse modulo 2**64 and span hashes can be shifted back to position 0.
BASE64 = 0x9E3779B97F4A7C15 | 1
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset a folder of this machine serves a local master; on a
    cluster it would silently split a table over machines, so that is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return (named or "file:///tmp/nearfield-shared").rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df once as a Parquet table in the shared folder and rereads it: lineage ends there, and the
    files outlive any executor. They go when the application ends."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/nearfield-{spark.sparkContext.applicationId}"
    path = f"{root}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._nearfield_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes the files of a materialized table that nothing will read again."""
    context = df.sparkSession.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(df._nearfield_path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def string_spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of a string array, without copying; a null is an empty span."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    starts, ends = at[:-1], at[1:].copy()
    if column.null_count:
        gone = np.asarray(column.is_null())
        ends[gone] = starts[gone]
    return raw, starts, ends


def groups_of_rows(starts: np.ndarray, ends: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about `limit` bytes; a longer row is a range of its own."""
    first, total = 0, 0
    for i, size in enumerate((ends - starts).tolist()):
        if total and total + size > limit:
            yield first, i
            first, total = i, 0
        total += size
    if first < len(starts):
        yield first, len(starts)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE64**i and BASE64**-i modulo 2**64 for i < n; kept, and grown when a longer text comes."""
    have = _POW.get(0)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            up = np.cumprod(np.r_[U64(1), np.full(size - 1, BASE64, U64)], dtype=U64)
            down = np.cumprod(np.r_[U64(1), np.full(size - 1, pow(BASE64, -1, 1 << 64), U64)], dtype=U64)
        have = _POW[0] = (up, down)
    return have


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads the high-quality upper bits over the word."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
        return h ^ (h >> U64(31))


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of symbols[starts:ends], each taken from one prefix array over all symbols."""
    n = len(symbols)
    up, down = powers(n + 1)
    with np.errstate(over="ignore"):
        prefix = np.zeros(n + 1, U64)
        np.cumsum(symbols.astype(U64) * up[:n], out=prefix[1:])
        return mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64))


def word_table() -> np.ndarray:
    """1 for bytes of words: ASCII letters and digits, and every byte of a character beyond ASCII."""
    t = np.zeros(256, np.uint8)
    t[128:] = 1
    for a, b in ((48, 58), (65, 91), (97, 123)):
        t[a:b] = 1
    return t


WORD, LOWER = word_table(), np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, np.uint8)
SPACE[[9, 10, 11, 12, 13, 32]] = 1


def runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ones."""
    edge = np.diff(np.r_[np.int8(0), flag.astype(np.int8), np.int8(0)])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def words_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray, fold: bool = True):
    """Words of some consecutive rows: (row, start, end, hash), offsets relative to starts[0] of the slice.

    Rows are joined with one breaking byte between them, so no word spans two rows."""
    n = len(starts)
    sizes = ends - starts
    place = np.cumsum(np.r_[0, sizes[:-1] + 1]) if n else np.zeros(0, np.int64)
    text = np.full(int(sizes.sum()) + n, 32, np.uint8)
    if n and (starts[1:] == ends[:-1]).all():
        keep = np.ones(len(text), bool)
        keep[place + sizes] = False
        text[keep] = raw[starts[0] : ends[-1]]
    else:
        for p, s, e in zip(place.tolist(), starts.tolist(), ends.tolist()):
            text[p : p + e - s] = raw[s:e]
    low = LOWER[text] if fold else text
    if fold:
        after = np.r_[False, text[:-1] == 0xC3]
        low = np.where(after & (text >= 0x80) & (text <= 0x9E) & (text != 0x97), text + 32, low)
    is_word = table[text]
    ws, we = runs(is_word)
    row = np.searchsorted(place, ws, side="right") - 1
    return row, ws - place[row], we - place[row], span_hashes(low, ws, we)


_WORD = re.compile(r"\w+")


def plain_words(text: str) -> list[str]:
    """Words as \\w+ finds them; callers fold their case."""
    return _WORD.findall(text)
