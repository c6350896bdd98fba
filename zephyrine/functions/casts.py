"""Casts between the engine's types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from zephyrine.functions import temporal
from zephyrine.functions.logic import truthy

#: Spark's type names -> the engine's.
NAMES = {
    "boolean": "bool", "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "float": "double", "double": "double",
    "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp", "string": "string", "variant": "json", "void": "null",
    temporal.INTERVAL.replace(":long", ":bigint"): "interval", "array<float>": "vector",
}


def type_of(x: Column) -> Column:
    """The type's name; NULL is 'null'."""
    name = F.typeof(x)
    pairs = F.create_map(*[F.lit(v) for kv in NAMES.items() for v in kv])
    named = F.when(name.startswith("decimal"), F.lit("decimal")).otherwise(F.coalesce(F.try_element_at(pairs, name), name))
    return F.when(x.isNull(), F.lit("null")).otherwise(named)


def to_int(x: Column, kind: str) -> Column:
    """Integer from a boolean, number (truncated), text, timestamp (microseconds) or date (Julian day)."""
    if kind == "timestamp":
        return temporal.micros(x)
    if kind == "date":
        return temporal.to_julian(x)
    if kind == "json":
        return F.variant_get(x, "$", "long")
    return x.cast("long")


def to_bool(x: Column, kind: str) -> Column:
    if kind == "string":
        return F.when(x == "true", F.lit(True)).when(x == "false", F.lit(False)).when(
            x.isNotNull(), F.raise_error(F.lit("not a boolean")).cast("boolean")
        )
    return truthy(x, kind)


def to_double(x: Column) -> Column:
    return x.cast("double")


def to_decimal(x: Column, precision: int = 15, scale: int = 2) -> Column:
    return x.cast(f"decimal({precision},{scale})")


def to_string(x: Column, kind: str = "") -> Column:
    if kind == "timestamp":
        return F.date_format(x.cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if kind == "json":
        return F.variant_get(x, "$", "string")
    return x.cast("string")


def to_json(x: Column) -> Column:
    """Any value as a JSON value; text becomes a JSON string."""
    return F.parse_json(F.regexp_extract(F.to_json(F.struct(x.alias("v")), {"ignoreNullFields": "false"}), r"^\{\"v\":(.*)\}$", 1))


def json_decode(text: Column) -> Column:
    return F.parse_json(text)


def to_timestamp(x: Column, kind: str = "string", zone: str | None = None) -> Column:
    """Timestamp from microseconds, a date, or text (in a zone)."""
    if kind == "int":
        return F.timestamp_micros(x.cast("long"))
    out = x.cast("timestamp")
    return F.to_utc_timestamp(out, zone) if zone else out


def to_date(x: Column, kind: str = "string") -> Column:
    return temporal.from_julian(x) if kind == "int" else x.cast("date")


def to_vector(text: Column) -> Column:
    """A vector from a JSON array of numbers."""
    return F.from_json(text, "array<float>")


def to_uuid(x: Column) -> Column:
    """A checked identifier in lower case; anything else raises."""
    good = x.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
    return F.when(x.isNull(), None).when(good, F.lower(x)).otherwise(F.raise_error(F.lit("not a uuid")).cast("string"))
