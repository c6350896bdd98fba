"""Arithmetic and mathematics. Integer arithmetic is 64-bit; overflow and division by zero raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idiv(a: Column, b: Column) -> Column:
    """Integer division, truncated toward zero."""
    return F.call_function("div", a.cast("long"), b.cast("long"))


def imod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the dividend."""
    return a.cast("long") % b.cast("long")


def dec_div(a: Column, b: Column, scale: int, precision: int = 38) -> Column:
    """Decimal division that keeps the left operand's scale, rounded half away from zero."""
    wide = a.cast(f"decimal({precision - 12},{scale})") / b.cast("decimal(20,6)")
    return F.round(wide, scale).cast(f"decimal({precision},{scale})")


def dec_mul(a: Column, b: Column, scale_a: int, scale_b: int) -> Column:
    """Decimal product: scales add up, to 15 at most, rounded half away from zero."""
    scale = scale_a + scale_b
    out = a.cast(f"decimal(19,{scale_a})") * b.cast(f"decimal(18,{scale_b})")
    return F.round(out, min(scale, 15))


def avg_int(x: Column) -> Column:
    """Average of integers as an integer, truncated; NULL over no values."""
    total = F.sum(x.cast("long"))
    n = F.nullif(F.count(x), F.lit(0))
    return ((total - total % n) / n).cast("long")


def avg_decimal(x: Column, scale: int) -> Column:
    """Average of decimals at the sum's scale, rounded half away from zero."""
    return F.round(F.sum(x) / F.nullif(F.count(x), F.lit(0)), scale)


def round_int(x: Column) -> Column:
    return F.round(x.cast("double")).cast("long")


def sign_int(x: Column) -> Column:
    return F.signum(x.cast("double")).cast("long")


def ceil_double(x: Column) -> Column:
    return F.ceil(x.cast("double")).cast("double")


def floor_double(x: Column) -> Column:
    return F.floor(x.cast("double")).cast("double")


def trunc_double(x: Column) -> Column:
    x = x.cast("double")
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def pow_int(a: Column, b: Column) -> Column:
    return F.pow(a.cast("double"), b.cast("double")).cast("long")


def sqrt_strict(x: Column) -> Column:
    """Square root; a negative number raises."""
    return F.when(x < 0, F.raise_error(F.lit("sqrt of a negative number")).cast("double")).otherwise(F.sqrt(x.cast("double")))


def log(x: Column) -> Column:
    """To base 10."""
    return F.log10(x.cast("double"))


def bit_and(a: Column, b: Column) -> Column:
    return a.cast("long").bitwiseAND(b.cast("long"))


def bit_or(a: Column, b: Column) -> Column:
    return a.cast("long").bitwiseOR(b.cast("long"))


def bit_xor(a: Column, b: Column) -> Column:
    return a.cast("long").bitwiseXOR(b.cast("long"))


def random_int() -> Column:
    """A random integer, zero or more."""
    return F.shiftrightunsigned(F.xxhash64(F.rand()), 1)
