"""Generated calendar rows and the calendar dimension."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.functions import dates

# Dates outside this window are errors of the data and stop the load, so the
# dimension has at most 109,573 rows and may always be broadcast.
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2199, 12, 31)


def days(spark: SparkSession, start: date, end: date) -> DataFrame:
    """One row per day, both ends included."""
    if not FIRST_DAY <= start <= end <= LAST_DAY:
        raise ValueError(f"calendar must lie within {FIRST_DAY} and {LAST_DAY}")
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date_day"))


def days_of(df: DataFrame, day: str | Column) -> DataFrame:
    """One row per day from the first to the last date found in a table.

    A date outside ``FIRST_DAY`` to ``LAST_DAY`` raises when the rows are read.
    """
    d = F.col(day) if isinstance(day, str) else day
    ends = df.agg(F.min(d).alias("lo"), F.max(d).alias("hi")).filter("lo is not null")
    return ends.select(F.explode(F.sequence(_checked("lo"), _checked("hi"))).alias("date_day"))


def months_of(df: DataFrame, day: str | Column) -> DataFrame:
    """Like ``days_of``, from the first day of the first month to the last day of the last one."""
    d = F.col(day) if isinstance(day, str) else day
    return days_of(df.select(F.explode(F.array(F.trunc(d, "month"), F.last_day(d))).alias("_d")), "_d")


def _checked(end: str) -> Column:
    message = F.concat(F.lit(f"a date outside {FIRST_DAY} to {LAST_DAY}: "), F.col(end).cast("string"))
    return F.when(F.col(end).between(F.lit(FIRST_DAY), F.lit(LAST_DAY)), F.col(end)).otherwise(F.raise_error(message))


def dim_date(day_rows: DataFrame, fiscal_first_month: int = 1) -> DataFrame:
    d = F.col("date_day")
    return day_rows.select(
        d,
        F.year(d).alias("year_number"),
        F.month(d).alias("month_number"),
        F.day(d).alias("day_of_month"),
        F.weekofyear(d).alias("week_of_year"),
        dates.day_of_week(d).alias("day_of_week"),
        F.date_format(d, "EEEE").alias("day_name"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.quarter(d).alias("quarter_number"),
        F.concat(F.lit("Q"), F.quarter(d).cast("string")).alias("quarter_label"),
        dates.season(d).alias("season"),
        dates.fiscal_year(d, fiscal_first_month).alias("fiscal_year"),
        dates.day_of_week(d).isin(0, 6).alias("is_weekend"),
        (d == dates.month_start(d)).alias("is_month_start"),
        (d == F.last_day(d)).alias("is_month_end"),
    )
