"""Rounding and sums whose result does not depend on row order or retries.

Floating sums change in their last digits with the order in which partitions
arrive. Measures here carry a known number of decimals, so they are summed as
scaled LONGs: exact, order-free, and still a plain partial + final hash
aggregate inside whole-stage codegen. ANSI mode raises if a sum overflows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_to(c: str | Column, digits: int = 2) -> Column:
    """Half away from zero on the binary value of a double.

    ``F.round`` rounds the decimal *string* of a double instead, so it turns
    1.005 into 1.01.
    """
    c, k = col(c).cast("double"), float(10**digits)
    return F.signum(c) * F.floor(F.abs(c) * k + 0.5) / k + 0.0


def scaled(c: str | Column, digits: int) -> Column:
    """The value as a LONG count of 10^-digits units."""
    c = col(c).cast("double")
    return (F.signum(c) * F.floor(F.abs(c) * float(10**digits) + 0.5)).cast("long")


def _units(name: str, digits: int) -> str:
    x = f"CAST(`{name}` AS DOUBLE)"
    return f"CAST(signum({x}) * floor(abs({x}) * 1e{digits}D + 0.5D) AS BIGINT)"


def exact_sum(name: str, digits: int) -> Column:
    return F.expr(f"sum({_units(name, digits)}) / 1e{digits}D")


def exact_mean(name: str, digits: int, out: int) -> Column:
    """Mean of a measure with ``digits`` decimals, rounded to ``out`` decimals.

    The division happens in units of the output digit, so an exact half is
    seen as an exact half.
    """
    unit = f"sum({_units(name, digits)}) / (count(`{name}`) * 1e{digits - out}D)"
    return F.expr(f"signum({unit}) * floor(abs({unit}) + 0.5D) / 1e{out}D + 0D")


def unit_sum(name: str, digits: int) -> Column:
    """The exact sum in units of 10^-digits, to be added up again by a coarser group."""
    return F.expr(f"sum({_units(name, digits)})")


def mean_of_units(total: str, count: str, digits: int, out: int) -> Column:
    """``exact_mean`` over groups reduced before: sums of their ``unit_sum`` and of their counts."""
    unit = f"sum(`{total}`) / (sum(`{count}`) * 1e{digits - out}D)"
    return F.expr(f"CASE WHEN sum(`{count}`) > 0 THEN signum({unit}) * floor(abs({unit}) + 0.5D) / 1e{out}D + 0D END")


def _number(name: str) -> str:
    return f"CASE WHEN trim(`{name}`) RLIKE r'{NUMBER}' THEN try_cast(trim(`{name}`) AS DOUBLE) END"


def lenient_double(name: str) -> Column:
    """Number text to double, anything else to NULL.

    The pattern keeps Java's 'd'/'f' suffixes out and, as important, keeps
    blanks and markers away from the parser: a failed parse inside a cast is a
    caught exception, some fifty times the cost of a match.
    """
    return F.expr(_number(name))


def lenient_int(name: str) -> Column:
    """Number text to int, rounding fractions half away from zero; bad text to NULL."""
    return F.expr(f"try_cast(round({_number(name)}) AS INT)")
