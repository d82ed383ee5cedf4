"""Star schema: location dimension, daily fact, monthly fact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.functions import dates
from daybook.functions.metrics import FULL_AT, at_least, mean_of_rates, ratio_of_sums, share
from daybook.functions.numbers import exact_mean, round_to
from daybook.functions.text import postal_prefix, surrogate_key

FACT_KEY = ("occupancy_date", "location_name", "program_name")
DATE_ATTRIBUTES = (
    "year_number", "month_number", "month_name", "quarter_number", "season", "week_of_year", "is_weekend",
)
LOCATION_ATTRIBUTES = (
    "location_name", "location_address", "location_postal_code", "location_city", "location_province",
    "organization_name", "shelter_group",
)
# The sectors that get their own column in the monthly fact.
SECTOR_COLUMNS = {
    "families_occupied": "FAMILIES",
    "youth_occupied": "YOUTH",
    "women_occupied": "WOMEN",
    "men_occupied": "MEN",
}


def canonical_rows(df: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """One row per key: the smallest by the attributes in the order given, NULLs last.

    Distinct combinations are formed first, as hash aggregation with map-side
    merging; the minimum over structs (which Spark aggregates by sorting) then
    sees only those. A key that holds a third of all rows shrinks before either
    shuffle, where a ``row_number`` window would sort all its rows in one task.
    """
    distinct = df.filter(F.col(key).isNotNull()).select(key, *attributes).distinct()
    ranked = [x for c in attributes for x in (F.col(c).isNull().alias(f"_{c}"), F.col(c))]
    best = F.min(F.struct(*ranked)).alias("_row")
    return distinct.groupBy(key).agg(best).select(key, *[F.col(f"_row.{c}") for c in attributes])


def dim_location(current: DataFrame) -> DataFrame:
    rows = canonical_rows(current, "location_id", LOCATION_ATTRIBUTES)
    return rows.select(
        F.col("location_id").alias("shelter_id"),
        F.col("location_name").alias("shelter_name"),
        F.col("location_address").alias("shelter_address"),
        F.col("location_postal_code").alias("shelter_postal_code"),
        F.col("location_city").alias("shelter_city"),
        F.col("location_province").alias("shelter_province"),
        "organization_name",
        "shelter_group",
        postal_prefix("location_postal_code").alias("forward_sortation_area"),
    )


def with_flags(panel: DataFrame, full_at: float = FULL_AT) -> DataFrame:
    """Three-valued flags: unknown where the rate or the capacity is unknown."""
    return panel.withColumns(
        {
            "is_effectively_full": at_least("occupancy_rate", full_at),
            "is_over_capacity": F.col("occupancy") > F.col("capacity_actual"),
        }
    )


def with_calendar(panel: DataFrame, calendar: DataFrame, day: str = "occupancy_date") -> DataFrame:
    """Calendar attributes by a broadcast left join; the calendar is bounded by its window of years."""
    attributes = calendar.select("date_day", *DATE_ATTRIBUTES)
    return panel.join(F.broadcast(attributes), F.col(day) == F.col("date_day"), "left").drop("date_day")


def fact_daily(unified: DataFrame, calendar: DataFrame) -> DataFrame:
    """Grain: one program on one date."""
    fact = with_calendar(with_flags(unified), calendar)
    return fact.select(
        surrogate_key(*FACT_KEY).alias("fact_id"),
        "occupancy_date",
        "organization_name",
        "location_name",
        "location_address",
        "location_postal_code",
        "program_name",
        "sector",
        "overnight_service_type",
        "capacity_type",
        "occupancy",
        "capacity_actual",
        "capacity_funding",
        "occupancy_rate",
        "is_effectively_full",
        "is_over_capacity",
        "has_actual_capacity",
        *DATE_ATTRIBUTES,
        "data_schema_version",
    )


def occupied_where(sector: str) -> Column:
    return F.sum(F.when(F.col("sector") == sector, F.col("occupancy")))


def panel_monthly(fact: DataFrame, sectors: dict[str, str] = SECTOR_COLUMNS) -> DataFrame:
    """Daily panel to month. ``total_programs`` counts program-days."""
    keys = [dates.month_start("occupancy_date").alias("month_start"), "year_number", "month_number"]
    return fact.groupBy(*keys).agg(
        mean_of_rates("occupancy_rate").alias("avg_occupancy_rate"),
        F.sum("occupancy").alias("total_occupied"),
        F.sum("capacity_actual").alias("total_capacity"),
        ratio_of_sums("occupancy", "capacity_actual").alias("system_occupancy_rate"),
        F.count_if("is_effectively_full").alias("programs_effectively_full"),
        F.count(F.lit(1)).alias("total_programs"),
        share("is_effectively_full").alias("pct_programs_full"),
        *[occupied_where(sector).alias(name) for name, sector in sectors.items()],
    )


def rates_monthly(rates: DataFrame) -> DataFrame:
    """The change flag looks inside the month only: a change on the 1st is not one."""
    return rates.groupBy(dates.month_start("rate_date").alias("month_start")).agg(
        exact_mean("policy_rate", 8, 4).alias("avg_policy_rate"),
        (F.max("policy_rate") - F.min("policy_rate") > 0).alias("rate_changed_this_month"),
    )


def weather_monthly(weather: DataFrame) -> DataFrame:
    """Sums and means of the values as measured; DECIMAL keeps them free of the order of rows."""
    return weather.groupBy(dates.month_start("weather_date").alias("month_start")).agg(
        exact_mean("temp_mean_c", 8, 2).alias("avg_temp_c"),
        round_to(F.min("temp_min_c"), 2).alias("min_temp_c"),
        F.sum(F.col("snow_total_cm").cast("decimal(28,8)")).cast("double").alias("total_snow_cm"),
        F.count_if("is_cold_day").alias("cold_days"),
        F.count_if("is_extreme_cold").alias("extreme_cold_days"),
    )


def fact_monthly(fact: DataFrame, rates: DataFrame, weather: DataFrame) -> DataFrame:
    """Each input is reduced to months first, so the joins see one row per month."""
    return (
        panel_monthly(fact)
        .join(rates_monthly(rates), "month_start", "left")
        .join(weather_monthly(weather), "month_start", "left")
    )
