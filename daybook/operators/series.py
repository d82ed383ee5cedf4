"""Time-series preparation.

Everything here works on series that were rolled up first: one row per
(series, period). The length of a series is therefore bounded by the calendar
(a century of days is 36,525 rows) no matter how many raw rows stand behind
it, so a window per series is a small sort, and all windows of one function
share one shuffle on the series keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daybook.functions import dates
from daybook.functions.numbers import col

STEPS = {"day": "1 day", "week": "7 days", "month": "1 month"}


def over(keys: Sequence[str], ts: str) -> WindowSpec:
    """The rows of a series in order. Without keys the table is one series, and Spark says so in its log."""
    return W.partitionBy(*[F.col(k) for k in keys]).orderBy(ts) if keys else W.orderBy(ts)


def changed(value: str, keys: Sequence[str], ts: str) -> Column:
    """Whether the value differs from the previous row; NULL on the first row."""
    return F.col(value) != F.lag(value).over(over(keys, ts))


def add_index(df: DataFrame, keys: Sequence[str], ts: str, name: str = "idx") -> DataFrame:
    """Position in the series from 0 (the time trend of a regression)."""
    return df.withColumn(name, F.row_number().over(over(keys, ts)) - 1)


def add_lag(df: DataFrame, keys: Sequence[str], ts: str, value: str, k: int, name: str) -> DataFrame:
    """The value ``k`` rows back: positional, so a missing period shifts it."""
    return df.withColumn(name, F.lag(value, k).over(over(keys, ts)))


def add_calendar_lag(df: DataFrame, keys: Sequence[str], ts: str, value: str, months: int, name: str) -> DataFrame:
    """The value ``months`` calendar months back, NULL where that month is missing."""
    past = df.select(*keys, F.add_months(ts, months).alias(ts), F.col(value).alias(name))
    return df.join(past, [*keys, ts], "left")


def difference(df: DataFrame, keys: Sequence[str], ts: str, value: str, name: str = "diff") -> DataFrame:
    """First difference; the first row of a series has none and is dropped."""
    out = df.withColumn(name, F.col(value) - F.lag(value).over(over(keys, ts)))
    return out.filter(F.col(name).isNotNull())


def regularize(df: DataFrame, keys: Sequence[str], ts: str, every: str) -> DataFrame:
    """One row per period from the first to the last of each series; new rows hold NULLs.

    Each row is stretched up to just before its successor, so filling the gaps
    needs the window's one shuffle and no join with a calendar.
    """
    step = F.expr(f"interval {STEPS[every]}")
    values = [c for c in df.columns if c not in keys and c != ts]
    until = (F.lead(ts).over(over(keys, ts)) - step).cast("date")
    spans = df.select(*keys, F.col(ts).alias("_ts"), *values, F.greatest(F.col(ts), until).alias("_until"))
    wide = spans.select(*keys, "_ts", *values, F.explode(F.sequence("_ts", "_until", step)).alias(ts))
    kept = [F.when(F.col(ts) == F.col("_ts"), F.col(c)).alias(c) for c in values]
    return wide.select(*keys, ts, *kept)


def interpolate(df: DataFrame, keys: Sequence[str], ts: str, value: str, name: str | None = None) -> DataFrame:
    """Linear between known values; the tail repeats the last one; the head stays NULL."""
    w = over(keys, ts)
    # Both frames run up to the current row, one of them from the other end: a frame that
    # runs to the end of the partition would be evaluated anew for every row.
    back = w.rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*[F.col(k) for k in keys]).orderBy(F.col(ts).desc()).rowsBetween(W.unboundedPreceding, 0)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(value).cast("double").alias("v")))
    marked = df.withColumn("_i", F.row_number().over(w)).withColumn("_k", known)
    framed = marked.withColumns(
        {"_lo": F.last("_k", True).over(back), "_hi": F.last("_k", True).over(ahead)}
    )
    lo, hi = F.col("_lo"), F.col("_hi")
    part = (F.col("_i") - lo["i"]) / (hi["i"] - lo["i"])
    filled = (
        F.when(F.col(value).isNotNull(), F.col(value).cast("double"))
        .when(hi.isNull(), lo["v"])
        .when(lo.isNotNull(), lo["v"] + (hi["v"] - lo["v"]) * part)
    )
    return framed.withColumn(name or value, filled).drop("_i", "_k", "_lo", "_hi")


def forward_fill(df: DataFrame, keys: Sequence[str], ts: str, value: str, name: str | None = None) -> DataFrame:
    """Carry the last known value forward."""
    w = over(keys, ts).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name or value, F.last(value, True).over(w))


def spread_annual(df: DataFrame, annual: DataFrame, ts: str, year: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Every period of a year gets that year's survey value."""
    right = annual.select(*keys, F.col(year).alias("_year"), value)
    cond = F.year(ts) == F.col("_year")
    for k in keys:
        cond = cond & (df[k] == right[k])
    return df.join(right, cond, "left").drop("_year", *[right[k] for k in keys])


def mask_window(df: DataFrame, ts: str, value: str, start: date, end: date, name: str | None = None) -> DataFrame:
    """The value set to NULL inside a window, both ends included."""
    return df.withColumn(name or value, F.when(~F.col(ts).between(F.lit(start), F.lit(end)), F.col(value)))


def in_window(ts: str | Column, start: date, end: date) -> Column:
    """1.0 inside the window, 0.0 outside."""
    return col(ts).between(F.lit(start), F.lit(end)).cast("double")


def tail(df: DataFrame, keys: Sequence[str], ts: str, n: int) -> DataFrame:
    """The last ``n`` rows of every series."""
    back = W.partitionBy(*[F.col(k) for k in keys]).orderBy(F.col(ts).desc())
    return df.withColumn("_r", F.row_number().over(back)).filter(F.col("_r") <= n).drop("_r")


def future_index(df: DataFrame, keys: Sequence[str], ts: str, horizon: int, every: str) -> DataFrame:
    """The next ``horizon`` periods after the last row of every series."""
    last = df.groupBy(*keys).agg(F.max(ts).alias("origin"))
    k = F.col("step")
    ahead = {
        "day": F.date_add("origin", k),
        "week": F.date_add("origin", k * 7),
        "month": F.add_months("origin", k),
    }[every]
    steps = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return steps.select(*keys, "origin", "step", ahead.alias("target"))


def regression_frame(
    monthly: DataFrame,
    calendar: DataFrame,
    first: int,
    last: int,
    rate_lag: int = 6,
    shock_year: int = 2020,
    shift_year: int = 2021,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Complete cases of the monthly regression: trend, lagged rate, season and period dummies.

    Rows with a missing target, rate or temperature go first, then trend and
    lag are positional over what is left, then rows with any NULL are dropped.
    """
    needed = ["system_occupancy_rate", "avg_policy_rate", "avg_temp_c"]
    rows = monthly.filter(F.col("year_number").between(first, last)).na.drop(subset=needed)
    rows = rows.join(
        F.broadcast(calendar.select("date_day", "season")), F.col("month_start") == F.col("date_day")
    ).drop("date_day")
    w = over(keys, "month_start")
    rows = rows.withColumns(
        {
            "time_trend": F.row_number().over(w) - 1,
            "policy_rate_lag": F.lag("avg_policy_rate", rate_lag).over(w),
            "is_covid": (F.col("year_number") == shock_year).cast("int"),
            "post_2021": (F.col("year_number") >= shift_year).cast("int"),
            **{f"is_{s.lower()}": (F.col("season") == s).cast("int") for s in dates.SEASONS[1:]},
        }
    )
    return rows.na.drop()
