"""Lambda aggregates: a left fold of an expression over a group's rows in a given order."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lambda_fold(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    seed: Column,
    step: Callable[[Column, Column], Column],
    order: str,
    name: str = "fold",
    combine: Callable[[Column, Column], Column] | None = None,
    width: int = 100_000,
) -> DataFrame:
    """``keys`` and ``name``: ``step(state, value)`` from ``seed`` on, rows ascending by ``order``.

    The state has the seed's type; a NULL state reads as the seed. Without ``combine`` a group is gathered in
    one task, as a fold of any kind needs. With it (it joins two states, the earlier one first, and the seed
    is neutral) runs of ``width`` consecutive values of the numeric ``order`` are folded apart, and a group's
    memory is bounded by its number of runs.
    """
    def fold(rows: Column, f) -> Column:
        return F.aggregate(rows, seed, lambda acc, x: f(F.coalesce(acc, seed), x))

    def gathered(v: Column, o: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct(o.alias("o"), v.alias("v")))), lambda r: r["v"])

    if combine is None:
        return df.groupBy(*keys).agg(fold(gathered(value, F.col(order)), step).alias(name))
    run = F.floor(F.col(order) / width).alias("__run")
    parts = df.groupBy(*keys, run).agg(fold(gathered(value, F.col(order)), step).alias("__part"))
    return parts.groupBy(*keys).agg(fold(gathered(F.col("__part"), F.col("__run")), combine).alias(name))
