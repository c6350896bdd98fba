"""The registered queries of the engine's own operators, each with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from zephyrine.queries import changes, dialect, documents, expressions, relational

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {k: v for m in (relational, expressions, documents, changes, dialect) for k, v in m.Q.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in (relational, expressions, documents, changes, dialect) for k, v in m.Q.sql.items()}
