"""Registration of queries with the SQL that they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from zephyrine.sources.files import load


class Tables:
    """The tables of a folder by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return load(self.spark, self.folder, name)


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def register(f: Callable[[Tables], DataFrame]):
            self.queries[name] = lambda spark, folder: f(Tables(spark, folder))
            if sql:
                self.sql[name] = sql
            return f

        return register
