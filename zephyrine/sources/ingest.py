"""JSON rows written to a table: names matched, defaults filled in, unknown and repeated names refused."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyrine.functions.jsons import values


def json_source(df: DataFrame, array: Column, name: str, kind: str) -> DataFrame:
    """A row for each element of a JSON array (text), cast to ``kind`` (``variant`` for any); NULL arrays give
    none, other JSON values raise."""
    elements = values(array)
    return df.select("*", F.explode(elements).alias(name)).withColumn(name, F.col(name).cast(kind))


def parse_rows(text: str) -> list[dict]:
    """``{}`` or ``[{}, …]``; a name twice in one object is an error."""

    def pairs(items):
        names = [k for k, _ in items]
        if len(set(names)) < len(names):
            raise ValueError("a column is given twice")
        return dict(items)

    out = json.loads(text, object_pairs_hook=pairs)
    out = out if isinstance(out, list) else [out]
    if not all(isinstance(r, dict) for r in out):
        raise ValueError("rows must be objects")
    return out


def rows(df: DataFrame, text: str, schema: T.StructType, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Rows of a column of JSON objects, by ``schema``. A member that the schema lacks raises, as does text
    that is no object; members left out get their default or NULL. Runs where the rows are."""
    known = F.array(*[F.lit(f.name) for f in schema.fields])
    names = F.json_object_keys(F.col(text))
    bad = F.when(names.isNull(), "rows must be objects").when(F.size(F.array_except(names, known)) > 0, "unknown column").when(
        F.size(F.array_distinct(names)) < F.size(names), "a column is given twice"
    )
    checked = F.when(bad.isNotNull(), F.raise_error(bad).cast("string")).otherwise(F.col(text))
    parsed = df.select(F.from_json(checked, schema).alias("r"), names.alias("names"))
    defaults = defaults or {}
    return parsed.select(
        *[
            F.when(F.array_contains("names", f.name), F.col(f"r.{f.name}")).otherwise(defaults.get(f.name, F.lit(None)).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )
