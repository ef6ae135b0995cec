"""Rounding and formatting that agree with Python's, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def py_round(x: Column, digits: int) -> Column:
    """Half to even on the exact binary value, as Python's round; null stays null.

    The scaled value is exact as a rounded product and its error (split into
    halves whose products with a power of ten lose nothing), so ties are
    decided by what the double really holds.
    """
    # the value is bound once, by a lambda, as it is needed many times
    return F.get(F.transform(F.array(x.cast("double")), lambda v: _round(v, float(10**digits))), F.lit(0))


def _round(x: Column, m: float) -> Column:
    c = x * F.lit(134217729.0)
    high = c - (c - x)
    p = x * F.lit(m)
    error = (high * F.lit(m) - p) + (x - high) * F.lit(m)
    low = F.floor(p)
    beyond = p - low - F.lit(0.5)
    up = (beyond > 0) | ((beyond == 0) & (error > 0)) | ((beyond == 0) & (error == 0) & (low % 2 != 0))
    return F.when(F.abs(x) < 4e15 / m, (low + up.cast("long")).cast("double") / F.lit(m)).otherwise(x)


def py_round_sql(x: str, digits: int) -> str:
    """The same in SQL, for a column or a short expression."""
    m = f"{float(10**digits)}::DOUBLE"
    p, high = f"({x} * {m})", f"(({x} * 134217729.0::DOUBLE) - (({x} * 134217729.0::DOUBLE) - {x}))"
    error, low = f"(({high} * {m} - {p}) + ({x} - {high}) * {m})", f"floor({p})"
    beyond = f"({p} - {low} - 0.5::DOUBLE)"
    return f"(({low} + CASE WHEN {beyond} > 0 OR ({beyond} = 0 AND {error} > 0) OR ({beyond} = 0 AND {error} = 0 AND {low} % 2 <> 0) THEN 1 ELSE 0 END) / {m})"


def fixed(x: Column, digits: int, plus: bool = False) -> Column:
    """Text with so many digits after the point, as Python's f"{x:.1f}", or f"{x:+.1f}" with ``plus``; null stays null.

    Java's format rounds the shortest decimal half up (6.25 to 6.3), so values
    are rounded before (below 4e15 / 10^digits, as by py_round).
    """
    sign = F.when(F.startswith(x.cast("double").cast("string"), F.lit("-")), "-").otherwise("+" if plus else "")
    return F.when(x.isNotNull(), F.concat(sign, F.format_string(f"%.{digits}f", py_round(F.abs(x), digits))))


def plain_number(x: Column) -> Column:
    """Whole numbers without a point, others with four significant digits and no exponent; null stays null."""
    x = x.cast("double")
    size = F.when(x == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(x))).cast("int"))
    # rounding to significant digits: scaled to four digits before the point, rounded half to even, scaled back
    four = py_round(x * F.pow(F.lit(10.0), F.lit(3) - size), 0) * F.pow(F.lit(10.0), size - 3)
    text = F.rtrim(F.format_number(four, 10), F.lit("0"))
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(F.regexp_replace(F.regexp_replace(text, ",", ""), r"\.$", ""))
