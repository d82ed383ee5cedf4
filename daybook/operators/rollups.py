"""Roll-ups over time and over levels of the panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.functions import dates
from daybook.functions.numbers import round_to, scaled

ALL = "ALL"


def daily_sums(fact: DataFrame, keys: Sequence[str] = ("sector",), require_both: bool = True) -> DataFrame:
    """(keys, day) totals: the only step of the series work that touches every row."""
    rows = fact
    if require_both:
        rows = rows.filter(F.col("occupancy").isNotNull() & (F.col("capacity_actual") > 0))
    return rows.groupBy(*keys, "occupancy_date").agg(
        F.sum("occupancy").alias("occupied"), F.sum("capacity_actual").alias("capacity")
    )


def period_series(
    daily: DataFrame,
    period: Column,
    name: str,
    key: str | None = "sector",
    min_days: int = 1,
    with_total: bool = True,
) -> DataFrame:
    """Daily totals to one row per (series, period), plus the ``ALL`` series.

    Works on the (key, day) totals, so the expansion for the two grouping sets
    and the distinct day count never see raw rows.
    """
    rows = daily.withColumn(name, period)
    if key is None:
        grouped, series = rows.groupBy(name), F.lit(ALL)
    elif with_total:
        grouped = rows.groupingSets([[name, key], [name]], name, key)
        series = F.when(F.grouping(key) == 1, F.lit(ALL)).otherwise(F.col(key))
    else:
        grouped, series = rows.groupBy(name, key), F.col(key)
    out = grouped.agg(
        series.alias("series"),
        F.sum("occupied").alias("total_occupied"),
        F.sum("capacity").alias("total_capacity"),
        F.count_distinct("occupancy_date").alias("n_days"),
    )
    return out.filter(F.col("n_days") >= min_days).select(
        "series",
        name,
        round_to(F.col("total_occupied") / F.nullif("total_capacity", F.lit(0)) * 100, 2).alias("occupancy_rate"),
        "total_occupied",
        "total_capacity",
        "n_days",
    )


def weekly_series(fact: DataFrame, key: str | None = "sector", min_days: int = 5) -> DataFrame:
    """ISO weeks (Monday) with at least ``min_days`` observed days."""
    daily = daily_sums(fact, [key] if key else [])
    return period_series(daily, dates.week_start("occupancy_date"), "week_start", key, min_days)


def monthly_series(fact: DataFrame, key: str | None = "sector", min_days: int = 28, require_both: bool = False) -> DataFrame:
    """Full months only: ``min_days`` distinct days observed.

    As in the monthly fact, occupied and capacity are summed independently
    unless ``require_both`` is set.
    """
    daily = daily_sums(fact, [key] if key else [], require_both)
    return period_series(daily, dates.month_start("occupancy_date"), "month_start", key, min_days)


def level_rollup(fact: DataFrame, levels: Sequence[Sequence[str]] = ((), ("sector",), ("location_id",))) -> DataFrame:
    """Occupied, capacity, ratio of sums and mean of rates for several levels at once.

    Rows are first reduced to the finest combination of keys; the grouping sets
    then expand those sums, not the raw rows.
    """
    keys = list(dict.fromkeys(k for level in levels for k in level))
    finest = fact.groupBy(*keys).agg(
        F.sum("occupancy").alias("occupied"),
        F.sum("capacity_actual").alias("capacity"),
        F.sum(scaled("occupancy_rate", 2)).alias("rate_units"),
        F.count("occupancy_rate").alias("n_rates"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    level_name = F.lit(None).cast("string")
    for level in levels:
        match = F.lit(True)
        for k in keys:
            match = match & (F.grouping(k) == (0 if k in level else 1))
        level_name = F.when(match, F.lit("+".join(level) or "system")).otherwise(level_name)
    out = finest.groupingSets([list(lv) for lv in levels], *keys).agg(
        level_name.alias("level"),
        F.sum("occupied").alias("occupied"),
        F.sum("capacity").alias("capacity"),
        F.sum("rate_units").alias("rate_units"),
        F.sum("n_rates").alias("n_rates"),
        F.sum("n_rows").alias("n_rows"),
    )
    return out.select(
        "level",
        *keys,
        "occupied",
        "capacity",
        "n_rows",
        round_to(F.col("occupied") / F.nullif("capacity", F.lit(0)) * 100, 2).alias("ratio_of_sums"),
        (F.floor(F.col("rate_units") / F.col("n_rates") + 0.5) / 100.0).alias("mean_of_rates"),
    )


def day_bits(fact: DataFrame, keys: Sequence[str], day: str = "occupancy_date") -> DataFrame:
    """One row per (keys, month) with the observed days as bits: distinct days that can be added up.

    Distinct counts of any coarser key, of months, and of weeks come from this
    table by OR, where counting distinct days would expand every row anew.
    """
    bit = F.expr(f"shiftleft(1, day(`{day}`) - 1)")
    return fact.filter(F.col(day).isNotNull()).groupBy(*keys, dates.month_start(day).alias("month_start")).agg(F.bit_or(bit).alias("days"))


def distinct_days(bits: DataFrame, keys: Sequence[str], period: str = "month") -> DataFrame:
    """Distinct days per (keys, month or ISO week), from ``day_bits`` of these or finer keys."""
    if period == "month":
        name, rows, merged = "month_start", bits, "days"
    else:
        # A month's bits as those of the weeks it has days in, seven bits from Monday; weeks that months share meet in the aggregate.
        name, merged = "week_start", "_week"
        weeks = F.sequence(dates.week_start("month_start"), F.last_day("month_start"), F.expr("interval 7 days"))
        rows = bits.select("*", F.explode(weeks).alias(name))
        shift = F.datediff(name, "month_start")
        moved = F.when(shift >= 0, F.expr("shiftright(days, datediff(week_start, month_start))")).otherwise(F.expr("shiftleft(days, datediff(month_start, week_start))"))
        rows = rows.withColumn(merged, moved.bitwiseAND(F.lit(127))).filter(F.col(merged) != 0)
    return rows.groupBy(*keys, name).agg(F.bit_count(F.bit_or(merged)).cast("long").alias("n_days"))
