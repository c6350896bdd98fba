"""JSON. Access goes through variants; arrays of one type are lifted to Spark arrays; changes by path work
on JSON text and keep the order of members."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from zephyrine.session import ship


def parse(text: Column) -> Column:
    """JSON text as a variant."""
    return F.parse_json(text)


def get(v: Column, path: str, kind: str = "string") -> Column:
    """A member by path (``$.a.b[0]``): NULL where there is none."""
    return F.variant_get(v, path, kind)


def values(text: Column) -> Column:
    """The elements of a JSON array (text), of any kinds, as an array of JSON values; for the functions below.
    Text that is no array raises."""
    parsed = F.parse_json(text)
    bad = F.raise_error(F.lit("a JSON array is expected")).cast("array<variant>")
    return F.when(F.schema_of_variant(parsed).startswith("ARRAY"), parsed.cast("array<variant>")).when(parsed.isNotNull(), bad)


def value(x: Column) -> Column:
    """Any value as a JSON value."""
    return x.cast("variant")


def append(array: Column, *values: Column) -> Column:
    """Values at the end of an array."""
    return F.concat(array, F.array(*values))


def push(array: Column, *values: Column) -> Column:
    """Values before an array, in the order given."""
    return F.concat(F.array(*values), array)


def pop(array: Column) -> Column:
    """Without the first element."""
    return F.slice(array, F.lit(2), F.greatest(F.size(array), F.lit(0)))


def pop_back(array: Column) -> Column:
    """Without the last element."""
    return F.slice(array, F.lit(1), F.greatest(F.size(array) - 1, F.lit(0)))


def _checked(array: Column, i: int, out: Column, kind: str) -> Column:
    bad = (F.size(array) <= i) | F.lit(i < 0)
    return F.when(array.isNull(), None).when(bad, F.raise_error(F.lit("index out of range")).cast(kind)).otherwise(out)


def put(array: Column, i: int, value: Column, kind: str = "array<long>") -> Column:
    """Element ``i`` (from 0) replaced; out of range raises."""
    return _checked(array, i, F.transform(array, lambda x, j: F.when(j == i, value).otherwise(x)), kind)


def remove(array: Column, i: int, kind: str = "array<long>") -> Column:
    """Without element ``i``; out of range raises."""
    return _checked(array, i, F.filter(array, lambda _, j: j != i), kind)


def set_path(text: str | None, path: str, value: str) -> str | None:
    """JSON text with the member at a dotted path set; a missing parent is an error."""
    if text is None:
        return None
    doc = json.loads(text)
    at, names = doc, path.split(".")
    for name in names[:-1]:
        at = at[name] if isinstance(at, dict) and name in at else None
    if not isinstance(at, dict):
        raise ValueError(f"set: no object at {path}")
    at[names[-1]] = json.loads(value)
    return json.dumps(doc, ensure_ascii=False, separators=(",", ":"))


def unset_path(text: str | None, path: str) -> str | None:
    """JSON text without the member at a dotted path, if it is there."""
    if text is None:
        return None
    doc = json.loads(text)
    at, names = doc, path.split(".")
    for name in names[:-1]:
        at = at.get(name) if isinstance(at, dict) else None
    if isinstance(at, dict):
        at.pop(names[-1], None)
    return json.dumps(doc, ensure_ascii=False, separators=(",", ":"))


def set_(text: Column, path: str, value: Column) -> Column:
    """:func:`set_path` with the new value as JSON text."""
    ship()

    @F.pandas_udf("string")
    def run(t: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([set_path(a, path, b) for a, b in zip(t, v)], dtype=object)

    return run(text, value)


def unset(text: Column, path: str) -> Column:
    ship()

    @F.pandas_udf("string")
    def run(t: pd.Series) -> pd.Series:
        return pd.Series([unset_path(a, path) for a in t], dtype=object)

    return run(text)


def has(text: Column, path: str) -> Column:
    """Whether there is a member at a dotted path; a JSON null counts."""
    quoted = "".join("['" + n.replace("\\", "\\\\").replace("'", "\\'") + "']" for n in path.split("."))
    return F.when(text.isNotNull(), F.variant_get(F.parse_json(text), f"${quoted}", "variant").isNotNull())


def array_of(*values: Column) -> Column:
    """A JSON array as text."""
    return F.to_json(F.array(*values))


def object_of(**members: Column) -> Column:
    """A JSON object as text, members in the order given."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in members.items()]), {"ignoreNullFields": "false"})
