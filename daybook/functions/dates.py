"""Date parsing, repair and calendar parts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from daybook.functions.numbers import col

SEASONS = ("Winter", "Spring", "Summer", "Fall")


def iso_date(c: str | Column) -> Column:
    """ISO text, with or without a time part; anything else becomes NULL."""
    return col(c).try_cast("date")


def mixed_date(c: str | Column) -> Column:
    """Month/day/year text where a slash is present, ISO text elsewhere."""
    c = col(c)
    return F.when(c.contains("/"), F.try_to_date(F.trim(c), "M/d/yyyy")).otherwise(iso_date(c))


def repair_short_year(c: str | Column) -> Column:
    """'21-01-15T00:00:00' to '2021-01-15'; four-digit years stay as they are."""
    trimmed = F.btrim(col(c), F.lit(" \t\r\n"))
    return F.regexp_replace(trimmed, r"(?s)^(\d{2})-(\d{2})-(\d{2}).*$", "20$1-$2-$3")


def month_start(c: str | Column) -> Column:
    return F.trunc(col(c), "MM")


def week_start(c: str | Column) -> Column:
    """Monday of the ISO week."""
    return F.trunc(col(c), "WEEK")


def season(c: str | Column) -> Column:
    """Meteorological season: December to February is Winter, and so on."""
    quarter = F.floor(F.month(col(c)) % 12 / 3).cast("int")
    return F.element_at(F.array(*[F.lit(s) for s in SEASONS]), quarter + 1)


def season_rank(c: str | Column) -> Column:
    """Winter, Spring, Summer, Fall as 1 to 4, for sorting."""
    return F.array_position(F.array(*[F.lit(s) for s in SEASONS]), col(c))


def day_of_week(c: str | Column) -> Column:
    """0 is Sunday, 6 is Saturday."""
    return F.dayofweek(col(c)) - 1


def fiscal_year(c: str | Column, first_month: int = 1) -> Column:
    return F.year(F.add_months(col(c), (13 - first_month) % 12))


def between_years(c: str | Column, first: int, last: int) -> Column:
    """A year range written on the date itself, so that it reaches the file scan."""
    c = col(c)
    return (c >= F.lit(date(first, 1, 1))) & (c < F.lit(date(last + 1, 1, 1)))
