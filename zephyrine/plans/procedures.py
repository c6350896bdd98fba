"""SQL functions and procedures, on Spark's own function and scripting support."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType


def scalar_function(spark: SparkSession, name: str, args: str, returns: str, body: str) -> None:
    """A function of an expression, for any query; replaced if it exists."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")


def table_function(spark: SparkSession, name: str, args: str, returns: str, query: str) -> None:
    """A function that gives rows, for FROM."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS TABLE({returns}) RETURN {query}")


def run(spark: SparkSession, body: str) -> DataFrame:
    """A block of statements with variables, IF, WHILE, FOR; the result is its last query's."""
    return spark.sql(f"BEGIN {body} END")


def native_function(spark: SparkSession, name: str, f: Callable, returns: str) -> None:
    """A function written in Python over Arrow arrays, for any query; replaced if it exists."""
    spark.udf.register(name, F.arrow_udf(f, returns, ArrowUDFType.SCALAR))


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(v)
