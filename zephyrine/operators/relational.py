"""Joins, quantified subqueries, DISTINCT ON and first-row scalars as DataFrame compositions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zephyrine.functions.logic import compare


def using_join(left: DataFrame, right: DataFrame, column: str, how: str = "inner") -> DataFrame:
    """JOIN … USING of one column that keeps both sides' columns, the right one's as ``<column>_right``."""
    other = right.withColumnRenamed(column, f"{column}_right")
    return left.join(other, F.col(column) == F.col(f"{column}_right"), how)


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first by ``order``.

    The rows are not ranked: the least row of each key is an aggregate, partial before the shuffle, so a key
    with very many rows costs no task more than others.
    """
    rest = [c for c in df.columns if c not in keys]
    ordered = [c if isinstance(c, Column) else F.col(c) for c in order]
    best = F.min_by(F.struct(*rest), F.struct(*ordered, *[F.col(c) for c in rest])).alias("__row")
    out = df.groupBy(*keys).agg(best)
    return out.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def scalar_first(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """The first row by ``order``, as a scalar subquery with several rows has it; none: no row."""
    return df.orderBy(*order).limit(1)


def _facts(values: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    v = F.col(column)
    return values.groupBy(*keys).agg(
        F.count("*").alias("__all"),
        F.count(v).alias("__filled"),
        F.min(v).alias("__min"),
        F.max(v).alias("__max"),
    )


def any_subquery(
    df: DataFrame, x: str, op: str, values: DataFrame, column: str, name: str, keys: Sequence[str] = ()
) -> DataFrame:
    """``df`` with ``name``: ``x op ANY (SELECT column FROM values)``, correlated on ``keys``.

    True on a match; else NULL if a value is NULL; else false. Over no values: false. NULL ``x`` beside any
    value: NULL. Ordered operators need the extremes only; for equality the values are joined as a set, for
    inequality two extremes tell.
    """
    return _quantified(df, x, op, values, column, name, keys, every=False)


def all_subquery(
    df: DataFrame, x: str, op: str, values: DataFrame, column: str, name: str, keys: Sequence[str] = ()
) -> DataFrame:
    """``x op ALL (…)``: false on a mismatch; else NULL if a value is NULL; else true. No values: true."""
    return _quantified(df, x, op, values, column, name, keys, every=True)


def _quantified(df, x, op, values, column, name, keys, every):
    op = "<>" if op == "!=" else op
    facts = _facts(values, column, keys)
    facts = facts.select(*[F.col(k).alias(f"__{k}") for k in keys], "__all", "__filled", "__min", "__max")
    if keys:
        on = [F.col(k) == F.col(f"__{k}") for k in keys]
        out = df.join(facts, on, "left")
    else:
        out = df.crossJoin(F.broadcast(facts))  # one row
    v = F.col(x)
    if op in ("<", "<="):
        told = compare(v, op, F.col("__min") if every else F.col("__max"))
    elif op in (">", ">="):
        told = compare(v, op, F.col("__max") if every else F.col("__min"))
    elif (op == "=") == every:
        # all are equal to x, or any differs from it: the extremes decide
        same = (v == F.col("__min")) & (v == F.col("__max"))
        told = same if every else ~same
    else:
        held = values.select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.col(column).alias("__h")).where(F.col("__h").isNotNull()).distinct()
        on = [v == F.col("__h"), *[F.col(k) == F.col(f"__h_{k}") for k in keys]]
        out = out.join(held, on, "left")
        told = F.col("__h").isNull() if every else F.col("__h").isNotNull()
    none = F.coalesce(F.col("__all"), F.lit(0)) == 0
    missing = F.col("__filled") < F.col("__all")
    decided = told if every else ~told  # what a missing value leaves open
    answer = (
        F.when(none, F.lit(every))
        .when(v.isNull(), F.lit(None).cast("boolean"))
        .when(F.col("__filled") == 0, F.lit(None).cast("boolean"))
        .when(missing & decided, F.lit(None).cast("boolean"))
        .otherwise(told)
    )
    return out.select(*[F.col(c) for c in df.columns], answer.alias(name))


def range_join(left: DataFrame, right: DataFrame, at: str, begin: str, end: str, width: float) -> DataFrame:
    """Rows with ``begin <= at < end``. Both sides are cut into cells of ``width`` and meet by equality on
    the cell, so the join is hashed instead of nested; an interval is in each cell that it touches."""
    cell = F.floor(F.col(at) / width).alias("__cell")
    cells = F.explode(F.sequence(F.floor(F.col(begin) / width), F.floor(F.col(end) / width))).alias("__cell")
    a, b = left.select("*", cell), right.where(F.col(begin) < F.col(end)).select("*", cells)
    return a.join(b, "__cell").where((F.col(at) >= F.col(begin)) & (F.col(at) < F.col(end))).drop("__cell")


def top_k(df: DataFrame, order: Sequence[Column | str], k: int, offset: int = 0) -> DataFrame:
    """ORDER BY … LIMIT … OFFSET: each task keeps ``k + offset`` rows."""
    return df.orderBy(*order).offset(offset).limit(k) if offset else df.orderBy(*order).limit(k)


def top_k_each(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key; ranks are cut before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= k).drop("__rank")
