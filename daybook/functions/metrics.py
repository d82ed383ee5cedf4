"""Rates, shares, bands and error measures as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from daybook.functions.numbers import col, exact_mean, round_to

FULL_AT = 95.0


def guarded_rate(amount: str | Column, capacity: str | Column, digits: int = 2) -> Column:
    """Percent of capacity; NULL where capacity is missing, zero or negative."""
    a, b = col(amount), col(capacity)
    return F.when(b > 0, round_to(a / b * 100, digits))


def ratio_of_sums(num: str | Column, den: str | Column, require_both: bool = False, digits: int = 2) -> Column:
    """Aggregate: 100 * sum(num) / sum(den), NULL on a zero total.

    With ``require_both`` only rows with both parts and a positive
    denominator count; without it the two sums are independent.
    """
    n, d = col(num), col(den)
    if require_both:
        keep = n.isNotNull() & (d > 0)
        n, d = F.when(keep, n), F.when(keep, d)
    return round_to(F.sum(n) / F.nullif(F.sum(d), F.lit(0)) * 100, digits)


def mean_of_rates(rate: str, digits: int = 2) -> Column:
    """Aggregate: plain mean of a rate column that carries two decimals."""
    return exact_mean(rate, 2, digits)


def share(flag: str | Column, digits: int = 2) -> Column:
    """Aggregate: percent of all rows where the flag is true."""
    return round_to(F.count_if(col(flag)) / F.nullif(F.count(F.lit(1)), F.lit(0)) * 100, digits)


def at_least(c: str | Column, threshold: float = FULL_AT) -> Column:
    return col(c) >= threshold


def stress_band(rate: str | Column) -> Column:
    r = col(rate)
    return (
        F.when(r >= 98, "Critical").when(r >= 95, "Effectively full").when(r >= 85, "High").otherwise("Moderate")
    )


def stress_color(rate: str | Column) -> Column:
    # The marker colour of each band.
    r = col(rate)
    return F.when(r >= 98, "#e63946").when(r >= 95, "#f4a261").when(r >= 85, "#e9c46a").otherwise("#2a9d8f")


def bubble_radius(capacity: str | Column) -> Column:
    """Marker size between 6 and 22 by square root of capacity; 7 without capacity."""
    c = col(capacity).cast("double")
    return F.when(c > 0, F.greatest(F.lit(6.0), F.least(F.lit(22.0), F.sqrt(c / 5) + 6))).otherwise(7.0)


def vacancy_band(rate: str | Column) -> Column:
    r = col(rate)
    return F.when(r < 2, "tight").when(r >= 3, "renter choice").when(r.isNotNull(), "balanced")


def rent_to_income(monthly_rent: str | Column, yearly_income: str | Column) -> Column:
    return col(monthly_rent) * 12 / F.nullif(col(yearly_income), F.lit(0)) * 100


def mid_temperature(high: str | Column, low: str | Column) -> Column:
    return (col(high) + col(low)) / 2


def after_break(day: str | Column, start) -> Column:
    """True from a structural break onwards."""
    return col(day) >= F.lit(start)


def abs_error(actual: str | Column, forecast: str | Column) -> Column:
    return F.abs(col(actual) - col(forecast))


def pct_error(actual: str | Column, forecast: str | Column) -> Column:
    a = col(actual)
    return F.abs((a - col(forecast)) / F.nullif(a, F.lit(0.0))) * 100


def pct_change(new: str | Column, base: str | Column) -> Column:
    """Percent change against a base; NULL where the base is zero."""
    b = col(base)
    return (col(new) - b) / F.nullif(b, F.lit(0.0)) * 100


def stars(p: str | Column) -> Column:
    p = col(p)
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")
