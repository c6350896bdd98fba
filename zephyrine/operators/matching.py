"""Exact nearest vectors by cosine distance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyrine.functions import vectors


def matching(df: DataFrame, column: str, query: Sequence[float], k: int, key: str, distance: str | None = None) -> DataFrame:
    """The ``k`` whole rows nearest to ``query``, nearest first, ties by ``key``; NULL vectors never match.

    One pass; each task keeps its own ``k`` rows and the driver merges those.
    """
    if k <= 0:
        raise ValueError("matching: k must be positive")
    d = distance or "__distance"
    out = df.where(F.col(column).isNotNull()).withColumn(d, vectors.cos_distance(F.col(column), vectors.literal(query)))
    out = out.orderBy(d, key).limit(k)
    return out if distance else out.drop(d)
