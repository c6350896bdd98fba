"""Output formats: JSON row arrays, aligned text, and request envelopes."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_rows(df: DataFrame) -> DataFrame:
    """``row``: each row as a JSON array of its values, made where the row is."""
    each = [F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(f"`{c}`").alias("v")), {"ignoreNullFields": "false"}), r"(?s)^\{\"v\":(.*)\}$", 1), F.lit("null")) for c in df.columns]
    return df.select(F.concat(F.lit("["), F.concat_ws(", ", *each), F.lit("]")).alias("row"))


def json_text(df: DataFrame) -> Iterable[str]:
    """A result as one JSON array, a piece at a time."""
    yield "["
    for i, r in enumerate(json_rows(df).toLocalIterator()):
        yield (", " if i else "") + r["row"]
    yield "]"


def text_table(df: DataFrame, rows: int = 100) -> str:
    """The first rows as an aligned table."""
    head = [tuple("null" if v is None else str(v) for v in r) for r in df.take(rows)]
    widths = [max(len(c), *(len(r[i]) for r in head), 0) if head else len(c) for i, c in enumerate(df.columns)]
    line = lambda r: " | ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip()
    return "\n".join([line(df.columns), "-+-".join("-" * w for w in widths), *map(line, head)])


def envelope(ident, result: str | None = None, error: str | None = None) -> str:
    """A JSON-RPC answer around a JSON result or a message."""
    body = {"jsonrpc": "2.0", "id": ident}
    if error is not None:
        return json.dumps({**body, "error": {"code": -32000, "message": error}})
    return json.dumps(body)[:-1] + f', "result": {result or "null"}}}'
