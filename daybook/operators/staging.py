"""Raw text tables to typed staging tables.

All four are narrow projections: no shuffle, one pass, built-in expressions
only. Text that does not parse becomes NULL and is counted by
``quality.rejects``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.functions import dates
from daybook.functions.metrics import guarded_rate
from daybook.functions.numbers import lenient_double, lenient_int
from daybook.functions.text import PACK_MOST, category, non_blank, pack, tidy, unpack
from daybook.operators.series import changed

# Column names of the landed tables.
LEGACY_COLUMNS = (
    "OCCUPANCY_DATE", "ORGANIZATION_NAME", "SHELTER_NAME", "SHELTER_ADDRESS", "SHELTER_CITY",
    "SHELTER_POSTAL_CODE", "FACILITY_NAME", "PROGRAM_NAME", "SECTOR", "OCCUPANCY", "CAPACITY",
)
CURRENT_COLUMNS = (
    "OCCUPANCY_DATE", "ORGANIZATION_ID", "ORGANIZATION_NAME", "SHELTER_ID", "SHELTER_GROUP",
    "LOCATION_ID", "LOCATION_NAME", "LOCATION_ADDRESS", "LOCATION_POSTAL_CODE", "LOCATION_CITY",
    "LOCATION_PROVINCE", "PROGRAM_ID", "PROGRAM_NAME", "SECTOR", "PROGRAM_MODEL",
    "OVERNIGHT_SERVICE_TYPE", "PROGRAM_AREA", "SERVICE_USER_COUNT", "CAPACITY_TYPE",
    "CAPACITY_ACTUAL_BED", "CAPACITY_FUNDING_BED", "OCCUPIED_BEDS", "UNOCCUPIED_BEDS",
    "CAPACITY_ACTUAL_ROOM", "CAPACITY_FUNDING_ROOM", "OCCUPIED_ROOMS", "UNOCCUPIED_ROOMS",
)
WEATHER_COLUMNS = {
    "Max Temp (°C)": "temp_max_c",
    "Min Temp (°C)": "temp_min_c",
    "Mean Temp (°C)": "temp_mean_c",
    "Total Precip (mm)": "precip_total_mm",
    "Total Rain (mm)": "precip_rain_mm",
    "Total Snow (cm)": "snow_total_cm",
}
WEATHER_DATE = "Date/Time"

UNIFIED_COLUMNS = (
    "occupancy_date", "organization_name", "location_name", "location_address", "location_postal_code",
    "program_name", "sector", "occupancy", "capacity_actual", "capacity_funding", "occupancy_rate",
    "capacity_type", "overnight_service_type", "data_schema_version", "source_year", "has_actual_capacity",
)


def stage_legacy(raw: DataFrame) -> DataFrame:
    """First generation: mixed date formats, funded capacity only."""
    typed = raw.filter(F.col("OCCUPANCY_DATE").isNotNull() & non_blank("OCCUPANCY_DATE")).select(
        dates.mixed_date("OCCUPANCY_DATE").alias("occupancy_date"),
        *[tidy(c).alias(c.lower()) for c in LEGACY_COLUMNS[1:8]],
        category("SECTOR").alias("sector"),
        lenient_int("OCCUPANCY").alias("occupancy"),
        lenient_int("CAPACITY").alias("capacity_funding"),
        # the rate keeps fractions the integer columns round away
        lenient_double("OCCUPANCY").alias("_occupancy"),
        lenient_double("CAPACITY").alias("_capacity"),
        "_source_year",
    )
    rate = F.when(F.col("capacity_funding") > 0, guarded_rate("_occupancy", "_capacity"))
    return typed.select(
        "occupancy_date",
        *[c.lower() for c in LEGACY_COLUMNS[1:8]],
        "sector",
        "occupancy",
        "capacity_funding",
        F.lit(None).cast("int").alias("capacity_actual"),
        rate.alias("occupancy_rate"),
        F.lit("legacy").alias("data_schema_version"),
        F.col("_source_year").alias("source_year"),
    )


def repaired(raw: DataFrame) -> DataFrame:
    """Second-generation rows with their years repaired, without the loader's row number."""
    return raw.drop("_id").withColumn("OCCUPANCY_DATE", dates.repair_short_year("OCCUPANCY_DATE"))


def copies(rows: DataFrame, apart: tuple[str, ...] = ("OCCUPANCY_DATE",)) -> DataFrame:
    """Every distinct row with ``n``, how often it occurs; its texts are packed into ``_row`` and ``_nulls``, except ``apart``.

    Copies of one row collapse map-side before the shuffle however many there
    are. A packed row takes a fraction of what a row of many text columns takes
    in the hash map, the shuffle and the spill. What later filters look at stays
    apart, so that they still run before the dedupe.
    """
    texts, others = _packed_and_others(rows, apart)
    keys = [F.col(f"`{c}`") for c in others]
    if texts:
        row, nulls = pack(*[F.col(f"`{c}`") for c in texts])
        keys += [row.alias("_row"), nulls.alias("_nulls")]
    packed = rows.select(*keys)
    return packed.groupBy(*[F.col(f"`{c}`") for c in packed.columns]).agg(F.count(F.lit(1)).alias("n"))


def _packed_and_others(rows: DataFrame, apart: tuple[str, ...]) -> tuple[list[str], list[str]]:
    texts = [c for c, t in rows.dtypes if t == "string" and c not in apart][:PACK_MOST]
    return texts, [c for c in rows.columns if c not in texts]


def repair_current(raw: DataFrame, apart: tuple[str, ...] = ("OCCUPANCY_DATE",)) -> DataFrame:
    """What happens to second-generation rows before staging: year repair, then full-row dedupe."""
    rows = repaired(raw)
    texts, others = _packed_and_others(rows, apart)
    distinct = copies(rows, apart)
    if texts:
        distinct = distinct.select(*[F.col(f"`{c}`") for c in others], unpack(F.col("_row")).alias("_texts"), "_nulls")
    bit = {c: i for i, c in enumerate(texts)}
    text = lambda c: F.when(F.col("_nulls").bitwiseAND(F.lit(1 << bit[c]).cast("long")) == 0, F.col("_texts")[bit[c]])
    return distinct.select(*[(text(c) if c in bit else F.col(f"`{c}`")).alias(c) for c in rows.columns])


def stage_current(raw: DataFrame) -> DataFrame:
    """Second generation: bed and room measures side by side, blanks for the unused kind."""

    def whole(name: str):
        return lenient_int(name).alias(name.lower())

    typed = raw.filter(F.col("OCCUPANCY_DATE").isNotNull()).select(
        dates.iso_date("OCCUPANCY_DATE").alias("occupancy_date"),
        whole("ORGANIZATION_ID"),
        tidy("ORGANIZATION_NAME").alias("organization_name"),
        whole("SHELTER_ID"),
        tidy("SHELTER_GROUP").alias("shelter_group"),
        whole("LOCATION_ID"),
        *[tidy(f"LOCATION_{c}").alias(f"location_{c.lower()}") for c in ("NAME", "ADDRESS", "POSTAL_CODE", "CITY", "PROVINCE")],
        whole("PROGRAM_ID"),
        tidy("PROGRAM_NAME").alias("program_name"),
        category("SECTOR").alias("sector"),
        *[tidy(c).alias(c.lower()) for c in ("PROGRAM_MODEL", "OVERNIGHT_SERVICE_TYPE", "PROGRAM_AREA", "CAPACITY_TYPE")],
        *[whole(c) for c in CURRENT_COLUMNS[19:]],
        whole("SERVICE_USER_COUNT"),
    )
    measured = typed.select(
        *[c for c in typed.columns if c != "service_user_count"],
        F.coalesce("occupied_beds", "occupied_rooms").alias("occupancy"),
        F.coalesce("capacity_actual_bed", "capacity_actual_room").alias("capacity_actual"),
        F.coalesce("capacity_funding_bed", "capacity_funding_room").alias("capacity_funding"),
        "service_user_count",
    )
    return measured.select(
        *[c for c in measured.columns if c != "service_user_count"],
        guarded_rate("occupancy", "capacity_actual").alias("occupancy_rate"),
        "service_user_count",
        F.lit("current").alias("data_schema_version"),
        F.year("occupancy_date").alias("source_year"),
    )


def unify(legacy: DataFrame, current: DataFrame) -> DataFrame:
    """Both generations in one schema. Legacy rows carry the funded capacity as their capacity."""
    old = legacy.select(
        F.col("occupancy_date").cast("date").alias("occupancy_date"),
        "organization_name",
        F.col("shelter_name").alias("location_name"),
        F.col("shelter_address").alias("location_address"),
        F.col("shelter_postal_code").alias("location_postal_code"),
        "program_name",
        "sector",
        "occupancy",
        F.col("capacity_funding").alias("capacity_actual"),
        "capacity_funding",
        "occupancy_rate",
        F.lit(None).cast("string").alias("capacity_type"),
        F.lit(None).cast("string").alias("overnight_service_type"),
        "data_schema_version",
        "source_year",
        F.lit(False).alias("has_actual_capacity"),
    )
    new = current.withColumn("occupancy_date", F.col("occupancy_date").cast("date"))
    new = new.withColumn("has_actual_capacity", F.lit(True)).select(*UNIFIED_COLUMNS)
    return old.unionByName(new)


def stage_rates(raw: DataFrame, series_keys: tuple[str, ...] = ()) -> DataFrame:
    """Daily rate with its year, month and change flag (NULL on the first day of a series)."""
    typed = raw.select(*series_keys, F.col("date").cast("date").alias("rate_date"), "policy_rate")
    return typed.select(
        *series_keys,
        "rate_date",
        "policy_rate",
        F.year("rate_date").alias("rate_year"),
        F.month("rate_date").alias("rate_month"),
        changed("policy_rate", series_keys, "rate_date").alias("is_rate_change_day"),
    )


def stage_weather(raw: DataFrame) -> DataFrame:
    """Daily weather: 'M' and blanks to NULL, repeated header rows dropped, cold and snow flags."""
    rows = raw.filter(F.col(f"`{WEATHER_DATE}`").isNotNull() & (F.col(f"`{WEATHER_DATE}`") != WEATHER_DATE))
    typed = rows.select(
        dates.iso_date(F.col(f"`{WEATHER_DATE}`")).alias("weather_date"),
        *[lenient_double(c).alias(name) for c, name in WEATHER_COLUMNS.items()],
        "_source_year",
    )
    return typed.select(
        "weather_date",
        *WEATHER_COLUMNS.values(),
        (F.col("temp_mean_c") < 0).alias("is_cold_day"),
        (F.col("snow_total_cm") > 0).alias("is_snow_day"),
        (F.col("temp_mean_c") < -10).alias("is_extreme_cold"),
        F.year("weather_date").alias("weather_year"),
        F.month("weather_date").alias("weather_month"),
        dates.day_of_week("weather_date").alias("day_of_week"),
        "_source_year",
    )
