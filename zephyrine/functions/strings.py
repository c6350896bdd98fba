"""Strings and regular expressions. Positions count characters from 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What trim() removes by default: space, tab, vertical tab, line feed, form feed.
BLANKS = " \t\v\n\f"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def concat(*parts: Column) -> Column:
    """Joins what is not NULL."""
    return F.concat_ws("", *[p.cast("string") for p in parts])


def joined(*parts: Column) -> Column:
    """``||``: NULL if a part is."""
    return F.concat(*parts)


def lower(s: Column) -> Column:
    """A-Z only."""
    return F.translate(s, UPPER, LOWER)


def upper(s: Column) -> Column:
    """a-z only."""
    return F.translate(s, LOWER, UPPER)


def substr(s: Column, pos: int, n: int | None = None, strict: bool = True) -> Column:
    """From ``pos`` on, ``n`` characters or all; out of range raises if ``strict``."""
    out = F.substring(s, pos, n if n is not None else (1 << 31) - 1)
    if not strict:
        return out
    last = pos + n - 1 if n is not None else pos
    bad = (F.length(s) < last) if pos >= 1 else F.lit(True)
    return F.when(s.isNull(), None).when(bad, F.raise_error(F.lit("substr: position out of range")).cast("string")).otherwise(out)


def strpos(s: Column, needle: str) -> Column:
    """Position of the first occurrence, 0 if there is none or the needle is empty."""
    return F.instr(s, needle).cast("long") if needle else F.when(s.isNotNull(), F.lit(0).cast("long"))


def replace(s: Column, old: str, new: str) -> Column:
    if not old:
        raise ValueError("replace: nothing to look for")
    return F.replace(s, F.lit(old), F.lit(new))


def trim(s: Column, chars: str = BLANKS) -> Column:
    return F.btrim(s, F.lit(chars))


def ltrim(s: Column, chars: str = BLANKS) -> Column:
    return F.ltrim(s, F.lit(chars))


def rtrim(s: Column, chars: str = BLANKS) -> Column:
    return F.rtrim(s, F.lit(chars))


def size(x: Column, kind: str = "string") -> Column:
    """Characters of a string, elements of an array or vector, members of a JSON text."""
    if kind == "string":
        return F.char_length(x).cast("long")
    if kind == "json":
        return F.coalesce(F.json_array_length(x), F.size(F.json_object_keys(x))).cast("long")
    return F.when(x.isNotNull(), F.size(x)).cast("long")


def octet_length(x: Column, kind: str = "string") -> Column:
    """Bytes of a string; four for each element of a vector."""
    return (F.octet_length(x) if kind == "string" else 4 * F.size(x)).cast("long")


def regexp_like(s: Column, pattern: str) -> Column:
    return s.rlike(pattern)


def regexp_substr(s: Column, pattern: str) -> Column:
    """The first match, NULL if there is none."""
    return F.regexp_substr(s, F.lit(pattern))


def regexp_match(s: Column, pattern: str, groups: int) -> Column:
    """The first match and its groups as an array, NULL if there is none."""
    return F.when(s.rlike(pattern), F.array(*[F.regexp_extract(s, pattern, i) for i in range(groups + 1)]))


def regexp_replace(s: Column, pattern: str, by: str) -> Column:
    """All matches; groups as $1."""
    return F.regexp_replace(s, pattern, by)
