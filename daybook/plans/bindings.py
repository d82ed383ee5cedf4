"""The driver's tables read as the panel's inputs.

Line items stand for observations of programs at locations: ship date for the
day, supplier for the location, line number for the program, quantity for the
occupied amount. Dates move 24 years ahead (leap years stay leap years), so
that the panel spans 2019 to 2025 with two schema generations, split at 2021.
Orders give a daily rate, ship days a daily weather record.

``RAW`` expressions only use SQL that Spark and other engines share, with
``{day}`` and ``{fmt_...}`` slots for the date functions that differ.
"""

from __future__ import annotations

from functools import cache, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.functions.metrics import guarded_rate
from daybook.operators.marts import with_flags
from daybook.operators.reports import stress_sums
from daybook.operators.staging import WEATHER_COLUMNS, WEATHER_DATE
from daybook.session import INPUT_TASKS
from daybook.sources import calendar
from daybook.sources.registry import Sources

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
SHIFT_YEARS = 24
SPLIT = 2021
RATE_SERIES = "V1"

SPARK_SLOTS = {
    "day": "add_months(CAST(l_shipdate AS DATE), 288)",
    "order_day": "add_months(CAST(o_orderdate AS DATE), 288)",
    "fmt_us": "date_format(d, 'MM/dd/yyyy')",
    "fmt_iso_t": "concat(date_format(d, 'yyyy-MM-dd'), 'T00:00:00')",
    "fmt_short_t": "concat(date_format(d, 'yy-MM-dd'), 'T00:00:00')",
    "fmt_short": "date_format(d, 'yy-MM-dd')",
    "fmt_iso": "date_format(d, 'yyyy-MM-dd')",
}

# One row per line item: the measures every expression below is built from.
ITEM = {
    "d": "{day}",
    "l_orderkey": "l_orderkey",
    "location_id": "l_suppkey",
    "n": "l_linenumber",
    "q": "CAST(l_quantity AS INT)",
    "disc": "CAST(round(l_discount * 100) AS INT)",
    "tax": "CAST(round(l_tax * 100) AS INT)",
    "sector": (
        "CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'MEN' WHEN 'AO' THEN 'WOMEN' WHEN 'NF' THEN 'YOUTH' "
        "WHEN 'NO' THEN 'FAMILIES' WHEN 'RF' THEN 'CO-ED' ELSE 'MIXED ADULT' END"
    ),
}
LOCATION = {
    "location_id": "s_suppkey",
    "location_name": "s_name",
    "location_address": "concat(CAST(s_suppkey + 1 AS STRING), ' Main St')",
    "location_postal_code": (
        "concat('M', CAST(1 + s_suppkey % 9 AS STRING), "
        "substr('ABCEGHJKLMNPRSTVWXYZ', CAST(1 + s_suppkey % 20 AS INT), 1), ' 1A1')"
    ),
    "location_city": "r_name",
    "location_province": "'ON'",
    "organization_id": "n_nationkey",
    "organization_name": "n_name",
    "shelter_group": "concat('Group ', r_name)",
}
# As reported: several locations share a name, some programs have an address of their own, some locations none.
SITE = {
    "location_name": "concat('Site ', CAST(location_id % 3 AS STRING))",
    "location_address": (
        "CASE WHEN location_id % 11 = 0 THEN NULL WHEN program_name > 'Program 6' THEN concat(location_address, ' / ', program_name) "
        "ELSE location_address END"
    ),
}
# A location is null-capacity, zero-capacity or open depending on the tax code.
CAPACITY = "CASE WHEN tax = 8 THEN NULL WHEN tax = 0 THEN 0 ELSE 38 + 2 * n END"
PANEL = {
    "occupancy_date": "d",
    "location_id": "location_id",
    "program_name": "concat('Program ', CAST(n AS STRING))",
    "sector": "sector",
    "occupancy": "CASE WHEN disc = 10 THEN NULL ELSE q END",
    "capacity_actual": CAPACITY,
    "capacity_funding": f"CASE WHEN year(d) < {SPLIT} THEN {CAPACITY} ELSE 50 END",
    "capacity_type": (
        f"CASE WHEN year(d) < {SPLIT} THEN NULL WHEN n <= 4 THEN 'Bed Based Capacity' ELSE 'Room Based Capacity' END"
    ),
    "overnight_service_type": f"CASE WHEN year(d) < {SPLIT} THEN NULL WHEN n % 2 = 1 THEN 'Shelter' ELSE 'Motel' END",
    "data_schema_version": f"CASE WHEN year(d) < {SPLIT} THEN 'legacy' ELSE 'current' END",
    "source_year": "CAST(year(d) AS INT)",
    "has_actual_capacity": f"year(d) >= {SPLIT}",
}
RAW_LEGACY = {
    "OCCUPANCY_DATE": (
        "CASE WHEN disc = 0 AND n = 1 THEN '   ' WHEN disc = 0 AND n = 2 THEN NULL "
        "WHEN year(d) = 2020 THEN {fmt_us} ELSE {fmt_iso_t} END"
    ),
    "ORGANIZATION_NAME": "concat(' ', organization_name, ' ')",
    "SHELTER_NAME": "concat(location_name, ' ')",
    "SHELTER_ADDRESS": "location_address",
    "SHELTER_CITY": "location_city",
    "SHELTER_POSTAL_CODE": "concat(' ', location_postal_code)",
    "FACILITY_NAME": "concat('Facility ', CAST(n AS STRING))",
    "PROGRAM_NAME": "concat('Program ', CAST(n AS STRING), ' ')",
    "SECTOR": "concat(' ', lower(sector), ' ')",
    "OCCUPANCY": "CASE WHEN disc = 10 THEN '' WHEN n = 3 THEN concat(CAST(q AS STRING), '.6') ELSE CAST(q AS STRING) END",
    "CAPACITY": f"CAST({CAPACITY} AS STRING)",
    "_source_year": "CAST(year(d) AS INT)",
}


def _measure(text: str, bed: bool) -> str:
    return f"CASE WHEN n {'<= 4' if bed else '> 4'} THEN {text} ELSE '' END"


_OCCUPIED = "CASE WHEN disc = 10 THEN '' WHEN n = 3 THEN concat(CAST(q AS STRING), '.6') ELSE CAST(q AS STRING) END"
_FREE = f"CAST({CAPACITY} - q AS STRING)"
RAW_CURRENT = {
    "_id": "l_orderkey",
    "OCCUPANCY_DATE": (
        "CASE WHEN disc = 0 AND n = 2 THEN NULL WHEN year(d) = 2021 THEN {fmt_short_t} "
        "WHEN year(d) = 2022 THEN {fmt_short} ELSE {fmt_iso_t} END"
    ),
    "ORGANIZATION_ID": "CAST(organization_id AS STRING)",
    "ORGANIZATION_NAME": "concat('  ', organization_name)",
    "SHELTER_ID": "CAST(location_id % 7 AS STRING)",
    "SHELTER_GROUP": "shelter_group",
    "LOCATION_ID": "CASE WHEN n = 7 THEN '' ELSE CAST(location_id AS STRING) END",
    "LOCATION_NAME": "concat(location_name, ' ')",
    "LOCATION_ADDRESS": "concat(location_address, CASE WHEN n > 3 THEN concat(' Unit ', CAST(n AS STRING)) ELSE '' END)",
    "LOCATION_POSTAL_CODE": "concat(' ', location_postal_code)",
    "LOCATION_CITY": "location_city",
    "LOCATION_PROVINCE": "location_province",
    "PROGRAM_ID": "CAST(n AS STRING)",
    "PROGRAM_NAME": "concat('Program ', CAST(n AS STRING))",
    "SECTOR": "concat(lower(sector), ' ')",
    "PROGRAM_MODEL": "CASE WHEN n < 4 THEN ' Emergency' ELSE 'Transitional' END",
    "OVERNIGHT_SERVICE_TYPE": "CASE WHEN n % 2 = 1 THEN 'Shelter ' ELSE ' Motel' END",
    "PROGRAM_AREA": "CASE WHEN n = 6 THEN NULL ELSE ' Base ' END",
    "SERVICE_USER_COUNT": "CAST(q * 2 AS STRING)",
    "CAPACITY_TYPE": (
        "CASE WHEN n <= 4 THEN 'Bed Based Capacity' WHEN n <= 6 THEN 'Room Based Capacity ' ELSE 'Other Capacity' END"
    ),
    "CAPACITY_ACTUAL_BED": _measure(f"CAST({CAPACITY} AS STRING)", True),
    "CAPACITY_FUNDING_BED": _measure("'50'", True),
    "OCCUPIED_BEDS": _measure(_OCCUPIED, True),
    "UNOCCUPIED_BEDS": _measure(_FREE, True),
    "CAPACITY_ACTUAL_ROOM": _measure(f"CAST({CAPACITY} AS STRING)", False),
    "CAPACITY_FUNDING_ROOM": _measure("'1,200'", False),
    "OCCUPIED_ROOMS": _measure(_OCCUPIED, False),
    "UNOCCUPIED_ROOMS": _measure(_FREE, False),
}
# Daily rate: the day's mean order price in steps of a quarter; unknown on days with two orders.
RATE_DAY = {
    "d": "{order_day}",
    "cents": "CAST(round(o_totalprice * 100) AS BIGINT)",
}
RATE = "CAST(floor(total / cnt / 4000000) AS DOUBLE) / 4"
RATE_TEXT = f"CASE WHEN cnt = 2 THEN NULL ELSE CAST({RATE} AS STRING) END"
# Daily weather: seasonal level plus the day's mean discount code.
_TENTHS = "floor(((disc_sum / cnt - 5) * 10 + (6 - abs(month(d) - 7)) * 4 - 6) * 10 + 0.5)"
WEATHER_DAY = {
    "mean_c": f"CAST({_TENTHS} AS DOUBLE) / 10",
    "max_c": f"CAST({_TENTHS} + 50 AS DOUBLE) / 10",
    "min_c": f"CAST({_TENTHS} - 50 AS DOUBLE) / 10",
    "tax_mean": "CAST(floor(tax_sum / cnt * 10 + 0.5) AS DOUBLE) / 10",
}
RAW_WEATHER = {
    WEATHER_DATE: "{fmt_iso}",
    "Max Temp (°C)": "CASE WHEN day(d) = 13 THEN 'M' ELSE CAST(max_c AS STRING) END",
    "Min Temp (°C)": "CASE WHEN day(d) = 13 THEN 'M' ELSE CAST(min_c AS STRING) END",
    "Mean Temp (°C)": "CASE WHEN day(d) = 13 THEN 'M' WHEN day(d) = 14 THEN '' ELSE CAST(mean_c AS STRING) END",
    "Total Precip (mm)": "CAST(tax_mean AS STRING)",
    "Total Rain (mm)": "CASE WHEN mean_c < 0 THEN '0' ELSE CAST(tax_mean AS STRING) END",
    "Total Snow (cm)": "CASE WHEN mean_c < 0 THEN CAST(tax_mean AS STRING) ELSE '0' END",
    "_source_year": "CAST(year(d) AS INT)",
}


def _select(df: DataFrame, exprs: dict[str, str], *also: str) -> DataFrame:
    return df.select(*also, *[F.expr(e.format(**SPARK_SLOTS)).alias(name) for name, e in exprs.items()])


def sources(sf_dir: str) -> Sources:
    return Sources.parquet_folder(sf_dir, TABLES)


class Inputs:
    """Lazy inputs of all plans over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.tables = spark, sources(sf_dir)
        self.table = cache(partial(self.tables.read, spark))
        self.locations = cache(self._locations)
        # For inputs that can't be split (one row group), the session may name a number of tasks; see session.py.
        self.tasks = int(spark.conf.get(INPUT_TASKS, "0"))

    def items(self, first: int | None = None, last: int | None = None) -> DataFrame:
        """Line items as observations; a year range becomes a range on the stored column."""
        rows = self.table("lineitem")
        kind = rows.schema["l_shipdate"].dataType
        if first is not None:
            rows = rows.filter(F.col("l_shipdate") >= F.lit(f"{first - SHIFT_YEARS}-01-01").cast(kind))
        if last is not None:
            rows = rows.filter(F.col("l_shipdate") < F.lit(f"{last + 1 - SHIFT_YEARS}-01-01").cast(kind))
        return _select(rows.repartition(self.tasks) if self.tasks else rows, ITEM)

    def _locations(self) -> DataFrame:
        """Supplier with its nation and region, as large as the supplier table: adaptive execution picks the join."""
        suppliers = self.table("supplier")
        joined = suppliers.join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left"
        )
        return _select(joined, LOCATION)

    def panel(self, first: int | None = None, last: int | None = None) -> DataFrame:
        """Typed daily panel keyed by location id."""
        rows = _select(self.items(first, last), PANEL)
        return rows.withColumn("occupancy_rate", guarded_rate("occupancy", "capacity_actual"))

    def unified(self, first: int | None = None, last: int | None = None) -> DataFrame:
        return self.panel(first, last).join(self.locations(), "location_id", "left")

    def fact(self, first: int | None = None, last: int | None = None) -> DataFrame:
        """Panel with flags and year, keyed by location id: what the reports aggregate."""
        return with_flags(self.panel(first, last)).withColumns(
            {"year_number": F.year("occupancy_date"), "month_number": F.month("occupancy_date")}
        )

    def calendar(self) -> DataFrame:
        """The months that the observations span."""
        return calendar.dim_date(calendar.months_of(self.items(), "d"))

    def sites(self, first: int) -> DataFrame:
        """Stress sums per location and program, under reported names and addresses that vary."""
        sums = stress_sums(self.fact(first=first), ["location_id", "program_name", "sector"])
        joined = sums.join(self.locations(), "location_id", "left")
        return joined.withColumns({name: F.expr(e) for name, e in SITE.items()})

    def raw_legacy(self) -> DataFrame:
        return _select(self.items(last=SPLIT - 1).join(self.locations(), "location_id", "left"), RAW_LEGACY)

    def raw_current(self) -> DataFrame:
        """Second generation as landed, with a second copy of every first-program row under a new id."""
        rows = _select(self.items(first=SPLIT).join(self.locations(), "location_id", "left"), RAW_CURRENT)
        copies = F.when(F.col("PROGRAM_ID") == "1", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        return rows.withColumn("_copy", F.explode(copies)).withColumn("_id", F.col("_id") * 2 + F.col("_copy")).drop("_copy")

    def rate_days(self) -> DataFrame:
        days = _select(self.table("orders"), RATE_DAY)
        return days.groupBy("d").agg(F.sum("cents").alias("total"), F.count(F.lit(1)).alias("cnt"))

    def raw_rates(self) -> DataFrame:
        """(date text, value text) per day."""
        return self.rate_days().select(F.expr(SPARK_SLOTS["fmt_iso"]).alias("date"), F.expr(RATE_TEXT).alias("v"))

    def rates(self) -> DataFrame:
        days = self.rate_days().filter("cnt <> 2")
        return days.select(F.col("d").alias("date"), F.expr(RATE).alias("policy_rate"))

    def rate_panel(self) -> DataFrame:
        """One rate series per order priority: (series, date, policy_rate)."""
        rows = _select(self.table("orders"), RATE_DAY, F.col("o_orderpriority").alias("series"))
        days = rows.groupBy("series", "d").agg(F.sum("cents").alias("total"), F.count(F.lit(1)).alias("cnt"))
        return days.filter("cnt <> 2").select("series", F.col("d").alias("date"), F.expr(RATE).alias("policy_rate"))

    def weather_days(self) -> DataFrame:
        rows = self.items().groupBy("d").agg(
            F.sum("disc").alias("disc_sum"), F.sum("tax").alias("tax_sum"), F.count(F.lit(1)).alias("cnt")
        )
        return _select(rows, WEATHER_DAY, "d")

    def raw_weather(self) -> DataFrame:
        """Weather as landed: a repeated header row on every New Year's Day."""
        rows = _select(self.weather_days(), RAW_WEATHER)
        header = rows.filter(F.col(f"`{WEATHER_DATE}`").endswith("-01-01")).select(
            *[F.lit(c).alias(c) for c in [WEATHER_DATE, *WEATHER_COLUMNS]], "_source_year"
        )
        return rows.unionByName(header)
