"""Finished reports over the marts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.functions import dates, metrics
from daybook.functions.numbers import col, exact_mean, mean_of_units, round_to, unit_sum
from daybook.functions.text import category, entity_label, postal_prefix
from daybook.sources.lookups import CITY_CENTRE


def annual_trend(monthly: DataFrame, first: int, last: int) -> DataFrame:
    """Mean of the monthly system rates, with yearly totals."""
    return (
        monthly.filter(F.col("year_number").between(first, last))
        .groupBy("year_number")
        .agg(
            exact_mean("system_occupancy_rate", 2, 1).alias("avg_occupancy_rate"),
            F.sum("total_occupied").alias("total_occupied"),
            F.sum("total_capacity").alias("total_capacity"),
        )
        .orderBy("year_number")
    )


def seasonal_pattern(monthly: DataFrame, calendar: DataFrame, first: int, last: int) -> DataFrame:
    """Mean monthly rate per season, in the order Winter, Spring, Summer, Fall."""
    joined = monthly.filter(F.col("year_number").between(first, last)).join(
        F.broadcast(calendar.select("date_day", "season")), F.col("month_start") == F.col("date_day")
    )
    return (
        joined.groupBy("season")
        .agg(
            exact_mean("system_occupancy_rate", 2, 1).alias("avg_rate"),
            F.count(F.lit(1)).alias("months"),
        )
        .orderBy(dates.season_rank("season"))
    )


def sector_trend(fact: DataFrame, sectors: Sequence[str]) -> DataFrame:
    return (
        fact.filter(F.col("occupancy_rate").isNotNull() & F.col("sector").isin(*sectors))
        .groupBy("year_number", "sector")
        .agg(exact_mean("occupancy_rate", 2, 1).alias("avg_rate"))
        .orderBy("year_number", "sector")
    )


# The attributes that make an entity of the stress table: variants of an address are entities of their own.
ENTITY = ("location_name", "location_address", "location_postal_code", "sector", "organization_name")


def stress_sums(fact: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What ``stress_by_entity`` needs of the daily rows, reduced by ids before any name is joined."""
    return (
        fact.filter(F.col("occupancy_rate").isNotNull())
        .groupBy(*keys)
        .agg(
            unit_sum("occupancy_rate", 2).alias("_rate"),
            unit_sum("occupancy", 0).alias("_occupied"),
            unit_sum("capacity_actual", 0).alias("_capacity"),
            F.count("occupancy").alias("_n_occupied"),
            F.count("capacity_actual").alias("_n_capacity"),
            F.count_if("is_effectively_full").alias("_full"),
            F.count(F.lit(1)).alias("_days"),
        )
    )


def stress_by_entity(sums: DataFrame, keys: Sequence[str], more_than: int) -> DataFrame:
    """Per entity: mean rate, mean occupied and capacity, days full, for entities seen often enough."""
    return (
        sums.groupBy(*keys)
        .agg(
            mean_of_units("_rate", "_days", 2, 1).alias("avg_occupancy_rate"),
            mean_of_units("_occupied", "_n_occupied", 0, 0).alias("avg_daily_occupied"),
            mean_of_units("_capacity", "_n_capacity", 0, 0).alias("avg_capacity"),
            F.sum("_full").alias("days_full"),
            F.sum("_days").alias("total_days"),
            round_to(F.sum("_full").cast("double") / F.sum("_days") * 100, 1).alias("pct_days_full"),
        )
        .filter(F.col("total_days") > more_than)
    )


def stress_table(sums: DataFrame, more_than: int = 30) -> DataFrame:
    """Stress by the five attributes of an entity, for those with an address."""
    return stress_by_entity(sums.filter(F.col("location_address").isNotNull()), ENTITY, more_than)


def top_stressed(stress: DataFrame, name: str, group: str, k: int = 15) -> DataFrame:
    """Top k by mean rate; ties by name and group. Plans as TakeOrderedAndProject."""
    ranked = stress.orderBy(F.col("avg_occupancy_rate").desc_nulls_last(), F.col(name).asc_nulls_last(), F.col(group).asc_nulls_last())
    return ranked.limit(k).select(
        name,
        group,
        entity_label(name, group).alias("label"),
        "avg_occupancy_rate",
        "days_full",
        "total_days",
        "pct_days_full",
    )


def with_coordinates(df: DataFrame, areas: DataFrame, postal: str, default: tuple[float, float] = CITY_CENTRE) -> DataFrame:
    """Coordinates by postal prefix, the city centre for unknown ones. ``areas`` is the fixed 100-row lookup."""
    lookup = F.broadcast(areas.select(F.col("prefix").alias("_prefix"), "lat", "lon"))
    key = F.upper(postal_prefix(postal))
    return (
        df.join(lookup, key == F.col("_prefix"), "left")
        .drop("_prefix")
        .withColumns(
            {"lat": F.coalesce("lat", F.lit(default[0])), "lon": F.coalesce("lon", F.lit(default[1]))}
        )
    )


def map_rows(stress: DataFrame, areas: DataFrame) -> DataFrame:
    """The export behind a map: defaults for missing values, coordinates, band, colour and size."""
    placed = with_coordinates(stress, areas, "location_postal_code")
    rate = F.coalesce(col("avg_occupancy_rate"), F.lit(0.0))
    capacity = F.coalesce(col("avg_capacity"), F.lit(0.0))
    return placed.select(
        F.col("location_name").alias("name"),
        F.col("organization_name").alias("org"),
        F.col("location_address").alias("address"),
        F.coalesce(F.nullif(category("sector"), F.lit("")), F.lit("OTHER")).alias("sector"),
        rate.alias("occ_rate"),
        F.coalesce(col("avg_daily_occupied"), F.lit(0.0)).cast("int").alias("avg_occupied"),
        capacity.cast("int").alias("avg_capacity"),
        F.coalesce(col("pct_days_full"), F.lit(0.0)).alias("pct_full"),
        "lat",
        "lon",
        metrics.stress_band(rate).alias("band"),
        metrics.stress_color(rate).alias("color"),
        metrics.bubble_radius(capacity).alias("radius"),
    )


def only_sector(rows: DataFrame, sector: str = "ALL") -> DataFrame:
    return rows if sector == "ALL" else rows.filter(F.col("sector") == sector)


def system_kpi(stress: DataFrame, full_at: float = metrics.FULL_AT) -> DataFrame:
    """Over a stress table: entities, entities at the threshold, mean of their mean rates."""
    return stress.agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.count_if(F.col("avg_occupancy_rate") >= full_at).alias("n_full"),
        exact_mean("avg_occupancy_rate", 1, 1).alias("avg_of_averages"),
    )


def system_flag(monthly: DataFrame, full_at: float = metrics.FULL_AT) -> DataFrame:
    """Capacity pressure of the whole system per month."""
    return monthly.select(
        "month_start",
        "system_occupancy_rate",
        (F.col("system_occupancy_rate") >= full_at).alias("is_system_full"),
    )


def series_summary(df: DataFrame, day: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day")
    )


def latest_rows(df: DataFrame, order: str, k: int = 5) -> DataFrame:
    return df.orderBy(F.col(order).desc_nulls_last()).limit(k)
