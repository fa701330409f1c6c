"""Metadata predicates as Catalyst expressions."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RANGES = {"$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}
OPERATORS = ("$eq", "$ne", "$in", *_RANGES)


def _kind(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    raise ValueError(f"{value!r} is no filter value: strings, numbers, booleans and None are")


class _Typed:
    """A column of known type. NULL is a missing field; an explicit null has no form there."""

    def __init__(self, column: Column, kind: T.DataType):
        self.column = column
        self.kind = "boolean" if isinstance(kind, T.BooleanType) else "number" if isinstance(kind, T.NumericType) else "string" if isinstance(kind, T.StringType) else "other"

    def equals(self, value: Any) -> Column:
        if value is None or _kind(value) != self.kind:
            return F.lit(False)
        # false, not NULL, where the field is missing; unlike coalesce() both terms are pushed into the scan
        return self.column.isNotNull() & (self.column == F.lit(value))

    def compares(self, how: str, value: float) -> Column:
        if self.kind != "number":
            return F.lit(False)
        return self.column.isNotNull() & getattr(self.column, how)(F.lit(value))


class _Variant:
    """A field of a VARIANT, whose type is each row's own; an explicit null and a missing field differ."""

    def __init__(self, metadata: Column, field: str):
        path = "$['" + field.replace("\\", "\\\\").replace("'", "\\'") + "']"
        self.value = F.try_variant_get(metadata, path, "variant")
        self.kind = F.schema_of_variant(self.value)
        self.metadata, self.path = metadata, path

    def _as(self, kind: str) -> Column:
        return F.try_variant_get(self.metadata, self.path, kind)

    def _is_number(self) -> Column:
        return self.kind.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")

    def equals(self, value: Any) -> Column:
        kind = _kind(value)
        if kind == "null":
            return F.coalesce(F.is_variant_null(self.value), F.lit(False))
        if kind == "boolean":
            hit = (self.kind == "BOOLEAN") & (self._as("boolean") == F.lit(value))
        elif kind == "string":
            hit = (self.kind == "STRING") & (self._as("string") == F.lit(value))
        else:
            hit = self._is_number() & (self._as("double") == F.lit(float(value)))
        return F.coalesce(hit, F.lit(False))

    def compares(self, how: str, value: float) -> Column:
        return F.coalesce(self._is_number() & getattr(self._as("double"), how)(F.lit(float(value))), F.lit(False))


def _one(field: _Typed | _Variant, op: str, value: Any) -> Column:
    if op == "$eq":
        return field.equals(value)
    if op == "$ne":
        return ~field.equals(value)
    if op == "$in":
        if not isinstance(value, (list, tuple)):
            raise ValueError("$in takes a list")
        return reduce(lambda a, b: a | b, [field.equals(v) for v in value], F.lit(False))
    if op in _RANGES:
        if _kind(value) != "number":
            raise ValueError(f"{op} takes a number")
        return field.compares(_RANGES[op], value)
    raise ValueError(f"unknown operator {op!r}; one of {OPERATORS}")


def compile_filter(predicate: dict[str, Any], schema: T.StructType, metadata: str | None = None) -> Column:
    """The predicate as one boolean expression that is never NULL.

    Fields are ANDed, and so are the operators of a field; a bare value stands for $eq; {} holds for all. Values compare by type
    and value, so 1, '1' and True differ. $eq None holds for an explicit null only, $ne also for missing fields,
    ranges for numbers only. Unknown operators, lists as bare values and operands of a wrong type raise ValueError
    before anything runs.

    schema: that of the rows. Without `metadata` the fields are columns; with it they are fields of that column: a struct
    (typed: comparisons reach the Parquet scan), a VARIANT, or a string of JSON. An unknown typed field is missing."""
    terms = [F.lit(True)]
    for name, wanted in predicate.items():
        field: _Typed | _Variant
        if metadata is None:
            field = _Typed(F.col(f"`{name}`"), schema[name].dataType) if name in schema.names else _Typed(F.lit(None), T.NullType())
        else:
            kind = schema[metadata].dataType
            if isinstance(kind, T.StructType):
                field = _Typed(F.col(metadata)[name], kind[name].dataType) if name in kind.names else _Typed(F.lit(None), T.NullType())
            else:
                held = F.col(metadata) if isinstance(kind, T.VariantType) else F.try_parse_json(F.col(metadata))
                field = _Variant(held, name)
        if isinstance(wanted, dict):
            terms += [_one(field, op, value) for op, value in wanted.items()]
        elif isinstance(wanted, (list, tuple)):
            raise ValueError(f"{name}: a list needs $in")
        else:
            terms.append(field.equals(wanted) if _kind(wanted) else F.lit(False))
    return reduce(lambda a, b: a & b, terms)
