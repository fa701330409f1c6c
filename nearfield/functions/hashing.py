"""Feature hashing of text, wholly as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearfield.functions.vectors import normalize

SIGN_SALT = 0x9E3779B9
_OFFSET, _PRIME, _MASK = 2166136261, 16777619, 0xFFFFFFFF


def fnv1a(text: Column, salt: int = 0) -> Column:
    """32-bit FNV-1a over the characters of an ASCII string, as a BIGINT."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    start = F.lit((_OFFSET ^ salt) & _MASK).cast("bigint")
    return F.aggregate(codes, start, lambda h, c: (h.bitwiseXOR(c) * F.lit(_PRIME).cast("bigint")).bitwiseAND(F.lit(_MASK).cast("bigint")))


def tokenize(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def features(text: Column, bigrams: bool = True) -> Column:
    """Tokens, and with bigrams every two neighbours joined by a blank."""
    t = tokenize(text)
    if not bigrams:
        return t
    n = F.size(t)
    pairs = F.when(
        n > 1, F.zip_with(F.slice(t, 1, F.greatest(n - 1, F.lit(1))), F.slice(t, 2, F.greatest(n - 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(t, pairs)


def feature_index(feature: Column, dimension: int) -> Column:
    return (fnv1a(feature) % F.lit(dimension)).cast("int")


def feature_sign(feature: Column) -> Column:
    return F.when(fnv1a(feature, SIGN_SALT).bitwiseAND(F.lit(1).cast("bigint")) == 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def hashing_embed(text: Column, dimension: int = 384, bigrams: bool = True) -> Column:
    """The normalised bag of hashed features as ARRAY<FLOAT>; zeros for a text without tokens.

    Expression only: for one text or a few. hashed_vectors() in operators.embedding is the form for tables."""
    pairs = F.transform(features(text, bigrams), lambda f: F.struct(feature_index(f, dimension).alias("i"), feature_sign(f).alias("s")))
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(dimension - 1)),
        lambda i: F.aggregate(F.filter(pairs, lambda p: p["i"] == i), F.lit(0.0), lambda a, p: a + p["s"]),
    )
    return normalize(dense)
