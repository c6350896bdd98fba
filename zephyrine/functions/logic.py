"""Truth values, comparison with NULL, and quantified predicates over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_and(a: Column, b: Column) -> Column:
    """AND that is NULL if either side is, even beside false."""
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).otherwise(a & b)


def strict_or(a: Column, b: Column) -> Column:
    """OR that is NULL only if both sides are: a NULL counts as false beside a value."""
    return F.when(a.isNull() & b.isNull(), F.lit(None).cast("boolean")).otherwise(
        F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))
    )


def truthy(x: Column, kind: str) -> Column:
    """Truth of a value by its type: numbers above zero, non-empty strings and vectors, intervals that are
    not zero, uuids that are not nil; JSON values always."""
    if kind in ("boolean", "bool"):
        return x
    if kind in ("int", "long", "bigint", "smallint", "tinyint", "float", "double") or kind.startswith("decimal"):
        return x > 0
    if kind == "string":
        return F.length(x) > 0
    if kind == "uuid":
        return x != "00000000-0000-0000-0000-000000000000"
    if kind == "vector":
        return F.size(x) > 0
    if kind == "interval":
        return (x["m"] != 0) | (x["d"] != 0) | (x["us"] != 0)
    if kind == "json":
        return F.when(x.isNotNull(), F.lit(True))
    raise ValueError(f"no truth value for {kind}")


_COMPARE = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def compare(a: Column, op: str, b: Column) -> Column:
    return _COMPARE["<>" if op == "!=" else op](a, b)


def any_of(x: Column, op: str, array: Column) -> Column:
    """``x op ANY (array)``: true on a match, else NULL if an element is, else false. NULL ``x``: NULL."""
    return F.when(x.isNotNull(), F.exists(array, lambda y: compare(x, op, y)))


def all_of(x: Column, op: str, array: Column) -> Column:
    """``x op ALL (array)``: false on a mismatch, else NULL if an element is, else true."""
    return F.when(x.isNotNull(), F.forall(array, lambda y: compare(x, op, y)))


def in_list(x: Column, *values) -> Column:
    """IN over a list that may be empty: false then."""
    return x.isin(*values) if values else F.when(x.isNotNull(), F.lit(False))
