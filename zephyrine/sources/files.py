"""Tables kept as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder of Parquet tables; filters and columns are pushed into its scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, *names: str) -> None:
    """Temporary views over tables, for SQL."""
    for name in names:
        load(spark, folder, name).createOrReplaceTempView(name)


def json_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Lines of JSON objects; malformed ones raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def csv_rows(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").option("header", header).csv(path)


def values(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    """Literal rows."""
    return spark.createDataFrame(list(rows), schema)


def generate(spark: SparkSession, n: int) -> DataFrame:
    """``n`` rows without columns but ``id`` from 0."""
    return spark.range(n)
