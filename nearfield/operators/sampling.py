"""Deterministic samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_hash(id_col: str, seed: int = 1) -> list:
    """The order of samples: MD5 of "<seed>:<id>", which any engine has, then the id."""
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), F.col(id_col)]


def hash_sample(df: DataFrame, cap: int, id_col: str = "id", seed: int = 1) -> DataFrame:
    """The cap rows of the smallest hash of (seed, id): a uniform sample that is the same at any partitioning, and of
    which a sample of a part of df, merged with another part's, is again the sample of both."""
    return df.orderBy(*by_hash(id_col, seed)).limit(cap)


def merge_samples(a: DataFrame, b: DataFrame, cap: int, id_col: str = "id", seed: int = 1) -> DataFrame:
    return hash_sample(a.unionByName(b), cap, id_col, seed)


def evenly_spaced(filled: int, want: int) -> list[int]:
    """Positions i * filled // n of the n = min(filled, want) picks."""
    n = min(filled, want)
    return [i * filled // n for i in range(n)]
