"""Vectors: arrays of numbers, worked on within generated code's reach, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def _same(a: Column, b: Column, out: Column, kind: str) -> Column:
    return F.when(F.size(a) == F.size(b), out).when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("vectors differ in length")).cast(kind))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cos_distance(a: Column, b: Column) -> Column:
    """One minus the cosine, between 0 and 2; 1 if a vector is zero. Lengths must agree."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    inner = F.when(norms == 0, F.lit(1.0)).otherwise(F.least(F.lit(2.0), F.greatest(F.lit(0.0), 1 - dot(a, b) / F.nullif(norms, F.lit(0.0)))))
    return _same(a, b, inner, "double")


def add(a: Column, b: Column) -> Column:
    return _same(a, b, F.zip_with(a, b, lambda x, y: x + y), "array<double>")


def sub(a: Column, b: Column) -> Column:
    return _same(a, b, F.zip_with(a, b, lambda x, y: x - y), "array<double>")


def mul(a: Column, b: Column) -> Column:
    return _same(a, b, F.zip_with(a, b, lambda x, y: x * y), "array<double>")


def less(a: Column, b: Column) -> Column:
    """Shorter vectors first, then element by element."""
    return (F.size(a) < F.size(b)) | ((F.size(a) == F.size(b)) & (a < b))


def item(a: Column, i: int) -> Column:
    """Element ``i`` from 0; out of range raises."""
    return F.element_at(a, i + 1)
