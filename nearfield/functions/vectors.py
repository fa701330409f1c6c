"""Vector arithmetic as Spark expressions. Factors are widened to double before they are multiplied."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "dot", "l2")


def vector_literal(values: Sequence[float]) -> Column:
    """A constant array of doubles: folded into the plan once."""
    return F.array(*(F.lit(float(v)) for v in values))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def sq_dist(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def neg_sq_l2(a: Column, b: Column) -> Column:
    return -sq_dist(a, b)


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def normalize(a: Column) -> Column:
    """a over its norm, as floats; a zero vector stays as it is."""
    # the norm as a variable: as an expression within the inner function it would be computed anew for each coordinate
    over = lambda n: F.when(n > 0, F.transform(a, lambda x: (x.cast("double") / n).cast("float"))).otherwise(a.cast("array<float>"))
    return F.transform(F.array(norm(a)), over).getItem(0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of vectors of any length; 0 if one of them is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def score(metric: str, a: Column, b: Column) -> Column:
    """Higher is closer: the dot product for cosine (over vectors already normalised) and dot, minus the
    squared distance for l2."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {METRICS}")
    return neg_sq_l2(a, b) if metric == "l2" else dot(a, b)


def is_valid(a: Column, dimension: int) -> Column:
    """Whether a has the dimension and only finite coordinates."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(a) == dimension) & finite, F.lit(False))
