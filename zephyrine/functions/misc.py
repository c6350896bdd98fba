"""NULL handling, hashes, encodings, tokens and identifiers."""

from __future__ import annotations

import base64
import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from zephyrine.session import ship


def coalesce(*x: Column) -> Column:
    return F.coalesce(*x)


def nullif(a: Column, b: Column) -> Column:
    return F.nullif(a, b)


def error(message: str) -> Column:
    return F.raise_error(F.lit(message))


def encode(s: Column, how: str = "base64") -> Column:
    """Base 64 of a string, ``base64`` or (other characters, no padding) ``base64url``."""
    out = F.regexp_replace(F.base64(s.cast("binary")), r"\s", "")
    if how == "base64url":
        return F.rtrim(F.translate(out, "+/", "-_"), F.lit("="))
    if how != "base64":
        raise ValueError(f"unknown encoding {how}")
    return out


def decode(s: Column, how: str = "base64") -> Column:
    if how == "base64url":
        s = F.translate(s, "-_", "+/")
        s = F.rpad(s, (F.ceil(F.length(s) / 4) * 4).cast("int"), F.lit("="))
    elif how != "base64":
        raise ValueError(f"unknown encoding {how}")
    return F.unbase64(s).cast("string")


def _url64(x: bytes) -> str:
    return base64.urlsafe_b64encode(x).decode().rstrip("=")


def jwt(header: Column, payload: Column, secret: Column) -> Column:
    """A signed token (HMAC-SHA256) over two JSON texts; NULL if an argument is."""
    ship()

    @F.pandas_udf("string")
    def sign(h: pd.Series, p: pd.Series, s: pd.Series) -> pd.Series:
        def one(a, b, key):
            if a is None or b is None or key is None:
                return None
            said = f"{_url64(a.encode())}.{_url64(b.encode())}"
            return f"{said}.{_url64(hmac.new(key.encode(), said.encode(), hashlib.sha256).digest())}"

        return pd.Series([one(*x) for x in zip(h, p, s)], dtype=object)

    return sign(header, payload, secret)


def random_uuid() -> Column:
    return F.expr("uuid()")


def md5(s: Column) -> Column:
    return F.md5(s.cast("binary"))


def sha1(s: Column) -> Column:
    return F.sha1(s.cast("binary"))
