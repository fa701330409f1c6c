"""Small files through Hadoop's file systems, so that paths mean the same as in spark.read."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, path)
    return fs.delete(at, True)


def names(spark: SparkSession, path: str) -> list[str]:
    at, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Written beside its place and moved there, so that readers see all of it or nothing."""
    at, fs = _fs(spark, path)
    aside = at.suffix(".part")
    out = fs.create(aside, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    fs.delete(at, False)
    if not fs.rename(aside, at):
        raise OSError(f"could not move {aside} to {at}")


def read_bytes(spark: SparkSession, path: str) -> bytes:
    at, fs = _fs(spark, path)
    stream = fs.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    write_bytes(spark, path, json.dumps(value, sort_keys=True).encode())


def read_json(spark: SparkSession, path: str) -> Any:
    return json.loads(read_bytes(spark, path))
