"""Every registered query: the Spark plan, and the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.functions import dates, metrics, text
from daybook.functions.numbers import exact_mean, exact_sum, lenient_double, lenient_int, round_to, scaled
from daybook.operators import backtest, marts, ordered, quality, regression, reports, rollups, running, series, staging, stationarity
from daybook.plans import bindings as b
from daybook.plans import models
from daybook.plans import oracle as o
from daybook.plans.bindings import Inputs
from daybook.session import pin_session, shared_folder
from daybook.sources import calendar, landed, lookups, sinks, versions
from daybook.sources.registry import Sources
from daybook.streaming import late

Plan = Callable[[Inputs], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SERIES = ["series"]
LAG_KEYS = ["series", "lag_months"]
# The window, test start, lags and sectors of the reports.
COVID = (date(2020, 3, 1), date(2020, 12, 1))
TEST_START = date(2024, 1, 1)
LAGS = (3, 6, 9, 12)
REPORT_SECTORS = ("MEN", "WOMEN", "YOUTH", "FAMILIES")


def query(name: str, sql: str | None = None):
    def add(plan: Plan) -> Plan:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            pin_session(spark)
            return plan(Inputs(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return add


# --- shared inputs ---------------------------------------------------------------------------


def raw_sources(t: Inputs) -> Sources:
    return Sources(
        {
            "raw_legacy": lambda _: t.raw_legacy(),
            "raw_current": lambda _: t.raw_current(),
            "raw_rates": lambda _: t.rates(),
            "raw_weather": lambda _: t.raw_weather(),
        }
    )


def stg_legacy(t: Inputs) -> DataFrame:
    return staging.stage_legacy(t.raw_legacy())


def stg_current(t: Inputs) -> DataFrame:
    return staging.stage_current(staging.repair_current(t.raw_current()))


def stg_unified(t: Inputs) -> DataFrame:
    return staging.unify(stg_legacy(t), stg_current(t))


def stg_rates(t: Inputs) -> DataFrame:
    return staging.stage_rates(t.rates())


def stg_weather(t: Inputs) -> DataFrame:
    return staging.stage_weather(t.raw_weather())


def monthly(t: Inputs) -> DataFrame:
    return marts.fact_monthly(t.fact(), stg_rates(t), stg_weather(t))


def weekly(t: Inputs, first: int | None = None, last: int | None = None) -> DataFrame:
    """Weeks of all years, unless a report asks for some."""
    return rollups.weekly_series(t.fact(first, last))


def weekly_filled(t: Inputs) -> DataFrame:
    regular = series.regularize(weekly(t), SERIES, "week_start", "week")
    return series.interpolate(regular, SERIES, "week_start", "occupancy_rate", "y").select("series", "week_start", "y")


def written(t: Inputs, rows: DataFrame, name: str) -> DataFrame:
    """Rolled-up rows written once, for plans that read them several times."""
    path = shared_folder(t.spark, name)
    rows.write.parquet(path)
    return t.spark.read.schema(rows.schema).parquet(path)


def rate_series(t: Inputs) -> DataFrame:
    """Full months of the panel with the month's mean rate, per sector and for the system."""
    full = rollups.monthly_series(t.fact()).select("series", "month_start", "occupancy_rate")
    rates = marts.rates_monthly(stg_rates(t)).select("month_start", "avg_policy_rate")
    return full.join(rates, "month_start")


SEASON_LENGTH = 366  # weeks at which the trend may break, at most


def weekly_folds(t: Inputs) -> DataFrame:
    rows = running.season_fits(weekly_filled(t), SERIES, "week_start", "y", SEASON_LENGTH)
    w = series.over(SERIES, "week_start")
    trend = lambda k: running.season_forecast(F.lag("season_fit", k).over(w), F.col("pos"), SEASON_LENGTH)
    rows = backtest.folds(
        rows, SERIES, "week_start", "y", 104, 12, 4, season=52, drift=True, models={"trend_season": trend}, carry=("pos", "season_fit")
    )
    return rows.withColumns({m: round_to(m, 6) for m in ("drift", "trend_season")})


RATE_MODELS = ("naive", "drift", "rate_lag", "arma", "arma_rate")


def rate_folds(t: Inputs, lags=LAGS) -> DataFrame:
    """Folds of every lag, with forecasts that use the lagged rate and forecasts that don't."""
    frame = backtest.lagged_frame(rate_series(t), SERIES, "month_start", "occupancy_rate", "avg_policy_rate", lags, 3)
    masked = F.col("month_start").between(*map(F.lit, COVID))
    fits = running.rate_fits(frame, LAG_KEYS, "month_start", "occupancy_rate", "exog_lag", masked)
    models = running.rate_forecasts(LAG_KEYS, "month_start")
    rows = backtest.folds(
        fits, LAG_KEYS, "month_start", "occupancy_rate", 48, 3, 1, drift=True, models=models, carry=("x_now", "dx", "fit")
    )
    return rows.withColumns({m: round_to(m, 6) for m in RATE_MODELS[1:]})


def stress(t: Inputs) -> DataFrame:
    return reports.stress_table(t.sites(2023))


def map_rows(t: Inputs) -> DataFrame:
    return reports.map_rows(stress(t), lookups.postal_areas(t.spark))


# --- staging and marts -----------------------------------------------------------------------


@query(
    "dim_date",
    "WITH ends AS (SELECT min({0}) AS lo, max({0}) AS hi FROM lineitem), days AS (SELECT CAST(unnest(generate_series("
    "lo, hi, INTERVAL 1 DAY)) AS DATE) AS date_day FROM ends) SELECT date_day, {1} FROM days".format(
        o.SLOTS["day"], o.DATE_PARTS
    ),
)
def _(t: Inputs) -> DataFrame:
    return calendar.dim_date(calendar.days_of(t.items(), "d"))


@query(
    "dim_location",
    o.sql(
        "SELECT location_id AS shelter_id, location_name AS shelter_name, location_address AS shelter_address, "
        "location_postal_code AS shelter_postal_code, location_city AS shelter_city, location_province AS shelter_province, "
        "organization_name, shelter_group, left(trim(location_postal_code), 3) AS forward_sortation_area FROM ("
        "SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY location_name, location_address, location_postal_code, "
        "location_city, location_province, organization_name, shelter_group) AS rn FROM stg_current "
        "WHERE location_id IS NOT NULL) WHERE rn = 1",
        "stg_current",
    ),
)
def _(t: Inputs) -> DataFrame:
    return marts.dim_location(stg_current(t))


query("stg_legacy", o.table("stg_legacy"))(stg_legacy)
query("stg_current", o.table("stg_current"))(stg_current)
query("stg_unified", o.table("stg_unified"))(stg_unified)
query("rate_change_days", o.table("stg_rates"))(stg_rates)


@query(
    "rate_change_days_by_series",
    o.sql(
        "SELECT a.series, a.date AS rate_date, a.policy_rate, CAST(year(a.date) AS INT) AS rate_year, CAST(month(a.date) AS INT) AS rate_month, "
        "a.policy_rate <> p.policy_rate AS is_rate_change_day FROM rate_panel a ASOF LEFT JOIN rate_panel p "
        "ON a.series = p.series AND a.date > p.date",
        "rate_panel",
    ),
)
def _(t: Inputs) -> DataFrame:
    """Many rate series in one table, each compared within itself."""
    return staging.stage_rates(t.rate_panel(), ("series",))


query("weather_flags", o.table("stg_weather"))(stg_weather)


@query("fact_daily", o.table("fact_daily"))
def fact_daily(t: Inputs) -> DataFrame:
    return marts.fact_daily(t.unified(), t.calendar())


query("fact_monthly", o.table("monthly"))(monthly)


@query("raw_to_monthly", o.table("raw_monthly"))
def raw_to_monthly(t: Inputs) -> DataFrame:
    """The whole chain from dirty text: staging, harmonised union, daily fact, monthly roll-up."""
    fact = marts.with_calendar(marts.with_flags(stg_unified(t)), t.calendar())
    return marts.panel_monthly(fact)


@query(
    "build_marts",
    o.sql(
        "SELECT * FROM raw_monthly LEFT JOIN rates_monthly USING (month_start) LEFT JOIN weather_monthly USING (month_start)",
        "raw_monthly",
        "rates_monthly",
        "weather_monthly",
    ),
)
def _(t: Inputs) -> DataFrame:
    """The full build from declared raw sources to written marts; the monthly fact is read back.

    The gate is off: some rows break data tests on purpose, see dq_report.
    """
    out = shared_folder(t.spark, "marts")
    models.build(t.spark, raw_sources(t), out, gate=False)
    return t.spark.read.parquet(f"{out}/fact_monthly")


# --- roll-ups and reports --------------------------------------------------------------------

query("weekly_rollup", o.table("weekly"))(weekly)


@query("full_months", o.table("full_months"))
def _(t: Inputs) -> DataFrame:
    return rollups.monthly_series(t.fact())


@query(
    "annual_trend",
    o.sql(
        f"SELECT year_number, {o.mean('system_occupancy_rate', 2, 1)} AS avg_occupancy_rate, {o.big('sum(total_occupied)')} AS "
        f"total_occupied, {o.big('sum(total_capacity)')} AS total_capacity FROM panel_monthly "
        "WHERE year_number BETWEEN 2017 AND 2026 GROUP BY 1 ORDER BY 1",
        "panel_monthly",
    ),
)
def _(t: Inputs) -> DataFrame:
    return reports.annual_trend(marts.panel_monthly(t.fact()), 2017, 2026)


@query(
    "seasonal_pattern",
    o.sql(
        f"SELECT season, {o.mean('system_occupancy_rate', 2, 1)} AS avg_rate, count(*) AS months FROM panel_monthly "
        "JOIN calendar ON month_start = date_day WHERE panel_monthly.year_number BETWEEN 2017 AND 2025 GROUP BY 1",
        "panel_monthly",
        "calendar",
    ),
)
def _(t: Inputs) -> DataFrame:
    return reports.seasonal_pattern(marts.panel_monthly(t.fact()), t.calendar(), 2017, 2025)


@query(
    "sector_trend",
    o.sql(
        f"SELECT year_number, sector, {o.mean('occupancy_rate', 2, 1)} AS avg_rate FROM fact WHERE year_number BETWEEN 2017 "
        f"AND 2025 AND occupancy_rate IS NOT NULL AND sector IN {REPORT_SECTORS} GROUP BY 1, 2 ORDER BY 1, 2",
        "fact",
    ),
)
def _(t: Inputs) -> DataFrame:
    return reports.sector_trend(t.fact(2017, 2025), REPORT_SECTORS)


@query(
    "top_stressed",
    o.sql(
        "SELECT location_name, sector, location_name || ' (' || upper(left(sector, 1)) || lower(substr(sector, 2)) || ')' AS label, "
        "avg_occupancy_rate, days_full, total_days, pct_days_full FROM stress_names "
        "ORDER BY avg_occupancy_rate DESC NULLS LAST, location_name, sector LIMIT 15",
        "stress_names",
    ),
)
def _(t: Inputs) -> DataFrame:
    rows = reports.stress_by_entity(t.sites(2023), ["location_name", "sector"], 100)
    return reports.top_stressed(rows, "location_name", "sector")


query("entity_stress_geo", o.table("map_rows"))(map_rows)


@query("map_rows_of_sector", o.sql("SELECT * FROM map_rows WHERE sector = 'MIXED ADULT'", "map_rows"))
def _(t: Inputs) -> DataFrame:
    return reports.only_sector(map_rows(t), "MIXED ADULT")


@query(
    "system_kpi",
    o.sql(
        "SELECT count(*) AS n_entities, count(*) FILTER (WHERE avg_occupancy_rate >= 95) AS n_full, "
        f"{o.mean('avg_occupancy_rate', 1, 1)} AS avg_of_averages FROM stress",
        "stress",
    ),
)
def _(t: Inputs) -> DataFrame:
    return reports.system_kpi(stress(t))


def _level(level: str, keys: list[str]) -> str:
    shown = ", ".join(f"{k if k in keys else f'CAST(NULL AS {kind})'} AS {k}" for k, kind in _LEVEL_KEYS.items())
    group = f" GROUP BY {', '.join(keys)}" if keys else ""
    return (
        f"SELECT '{level}' AS level, {shown}, {o.big('sum(occupancy)')} AS occupied, {o.big('sum(capacity_actual)')} AS capacity, "
        "count(*) AS n_rows, round(CAST(sum(occupancy) AS DOUBLE) / nullif(sum(capacity_actual), 0) * 100, 2) AS ratio_of_sums, "
        f"{o.mean('occupancy_rate', 2, 2)} AS mean_of_rates FROM fact{group}"
    )


_LEVEL_KEYS = {"sector": "VARCHAR", "location_id": "BIGINT", "program_name": "VARCHAR"}
_LEVELS = ((), ("sector",), ("location_id",), ("location_id", "program_name"))


@query("rollup_levels", o.sql(" UNION ALL ".join(_level("+".join(lv) or "system", list(lv)) for lv in _LEVELS), "fact"))
def _(t: Inputs) -> DataFrame:
    return rollups.level_rollup(t.fact(), _LEVELS)


@query(
    "sector_pivot",
    o.sql(
        f"SELECT {o.month('occupancy_date')} AS month_start, "
        + ", ".join(f"{o.big(f'sum(occupancy) FILTER (WHERE sector = {s!r})')} AS \"{s}\"" for s in quality.SECTORS)
        + " FROM fact GROUP BY 1",
        "fact",
    ),
)
def _(t: Inputs) -> DataFrame:
    months = t.fact().groupBy(dates.month_start("occupancy_date").alias("month_start"))
    return months.pivot("sector", list(quality.SECTORS)).agg(F.sum("occupancy"))


# --- documented metrics ----------------------------------------------------------------------


@query(
    "capacity_utilisation",
    o.sql(
        "SELECT sector, round(CAST(sum(capacity_actual) AS DOUBLE) / nullif(sum(capacity_funding), 0) * 100, 2) AS utilisation "
        "FROM fact WHERE has_actual_capacity GROUP BY 1",
        "fact",
    ),
)
def _(t: Inputs) -> DataFrame:
    rows = t.fact(first=b.SPLIT).filter("has_actual_capacity")
    return rows.groupBy("sector").agg(metrics.ratio_of_sums("capacity_actual", "capacity_funding").alias("utilisation"))


@query(
    "system_full_flag",
    o.sql(
        "SELECT month_start, system_occupancy_rate, system_occupancy_rate >= 95 AS is_system_full, "
        "month_start >= DATE '2024-04-01' AS after_break FROM panel_monthly",
        "panel_monthly",
    ),
)
def _(t: Inputs) -> DataFrame:
    flagged = reports.system_flag(marts.panel_monthly(t.fact()))
    return flagged.withColumn("after_break", metrics.after_break("month_start", date(2024, 4, 1)))


# Parts stand for dwellings: size class for bedrooms, price for the monthly rent.
_RENTS = "SELECT CASE WHEN p_size <= 10 THEN 0 WHEN p_size <= 25 THEN 1 WHEN p_size <= 40 THEN 2 ELSE 3 END AS bedrooms, p_retailprice AS rent, p_size FROM part"


def rents(t: Inputs) -> DataFrame:
    s = F.col("p_size")
    return t.table("part").select(
        F.when(s <= 10, 0).when(s <= 25, 1).when(s <= 40, 2).otherwise(3).alias("bedrooms"),
        F.col("p_retailprice").alias("rent"),
        "p_size",
    )


@query("average_rent", f"SELECT bedrooms, {o.mean('rent', 2, 2)} AS avg_rent, count(*) AS n FROM ({_RENTS}) GROUP BY 1")
def _(t: Inputs) -> DataFrame:
    return rents(t).groupBy("bedrooms").agg(exact_mean("rent", 2, 2).alias("avg_rent"), F.count(F.lit(1)).alias("n"))


@query(
    "vacancy_band",
    "SELECT p_brand, vacancy, CASE WHEN vacancy < 2 THEN 'tight' WHEN vacancy >= 3 THEN 'renter choice' "
    "WHEN vacancy IS NOT NULL THEN 'balanced' END AS band FROM (SELECT p_brand, round(CAST(count(*) FILTER (WHERE p_size = 7) "
    "AS DOUBLE) / count(*) * 100, 2) AS vacancy FROM part GROUP BY 1)",
)
def _(t: Inputs) -> DataFrame:
    rates = t.table("part").groupBy("p_brand").agg(metrics.share(F.col("p_size") == 7).alias("vacancy"))
    return rates.withColumn("band", metrics.vacancy_band("vacancy"))


@query(
    "rent_to_income",
    f"WITH r AS (SELECT {o.mean('p_retailprice', 2, 2)} AS rent FROM part WHERE p_size > 10 AND p_size <= 25), "
    f"i AS (SELECT n_name AS area, round({o.mean('c_acctbal', 2, 2)} * 12, 2) AS income FROM customer JOIN nation ON c_nationkey = n_nationkey "
    "GROUP BY 1) SELECT area, rent, income, round(rent * 12 / nullif(income, 0) * 100, 2) AS ratio FROM i, r",
)
def _(t: Inputs) -> DataFrame:
    rent = rents(t).filter("bedrooms = 1").agg(exact_mean("rent", 2, 2))
    people = t.table("customer").join(t.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    incomes = people.groupBy(F.col("n_name").alias("area")).agg(round_to(exact_mean("c_acctbal", 2, 2) * 12, 2).alias("income"))
    joined = incomes.withColumn("rent", rent.scalar())
    return joined.select("area", "rent", "income", round_to(metrics.rent_to_income("rent", "income"), 2).alias("ratio"))


@query(
    "mid_temperature",
    o.sql(
        "SELECT weather_date, temp_mean_c, round((temp_max_c + temp_min_c) / 2, 1) AS mid_c FROM stg_weather", "stg_weather"
    ),
)
def _(t: Inputs) -> DataFrame:
    mid = round_to(metrics.mid_temperature("temp_max_c", "temp_min_c"), 1).alias("mid_c")
    return stg_weather(t).select("weather_date", "temp_mean_c", mid)


# --- sources and sinks -----------------------------------------------------------------------

_PAGE_COLUMNS = ("event_id", "event_type", "value")


@query(
    "source_pages",
    "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS value "
    "FROM events",
)
def _(t: Inputs) -> DataFrame:
    """Land one page per event and load them through the checks of a load."""
    path = shared_folder(t.spark, "pages")
    record = F.struct(
        F.col("event_id").alias("_id"),
        F.col("event_id").cast("string").alias("event_id"),
        "event_type",
        scaled("value", 2).cast("string").alias("value"),
    )
    pages = t.table("events").select(
        F.lit(True).alias("success"),
        F.struct(F.lit(1).cast("long").alias("total"), F.array(record).alias("records")).alias("result"),
    )
    pages.write.json(path)
    return landed.load_pages(t.spark, path, _PAGE_COLUMNS, multiline=False)


@query(
    "source_observations",
    o.sql("SELECT date, policy_rate FROM rates WHERE date >= DATE '2020-01-01'", "rates"),
)
def _(t: Inputs) -> DataFrame:
    """One payload per month with its (at most 31) observations, some without a value."""
    path = shared_folder(t.spark, "observations")
    obs = F.struct(F.col("date").alias("d"), F.when(F.col("v").isNotNull(), F.struct("v")).alias(b.RATE_SERIES))
    months = t.raw_rates().groupBy(F.substring("date", 1, 7).alias("m"))
    months.agg(F.collect_list(obs).alias("observations")).drop("m").write.json(path)
    payload = landed.read_observations(t.spark, path, b.RATE_SERIES, multiline=False)
    return landed.observation_rows(payload, b.RATE_SERIES, start="2020-01-01")


@query(
    "source_yearly_csv",
    o.sql('SELECT * REPLACE (nullif("Mean Temp (°C)", \'\') AS "Mean Temp (°C)") FROM raw_weather', "raw_weather"),
)
def _(t: Inputs) -> DataFrame:
    """Weather landed as CSV in yearly folders; files of later years have more columns, in another order."""
    path = shared_folder(t.spark, "weather")
    columns = [b.WEATHER_DATE, *b.WEATHER_COLUMNS]
    rows = t.raw_weather().repartition("_source_year")
    later = rows.filter(F.col("_source_year") >= 2023).withColumns({"Longitude (x)": F.lit("-79.4"), "Climate ID": F.lit("6158359")})
    for part, order in ((rows.filter(F.col("_source_year") < 2023), columns), (later, ["Longitude (x)", *columns[::-1], "Climate ID"])):
        writer = part.select(*[F.col(f"`{c}`") for c in order], "_source_year").write.mode("append")
        writer.partitionBy("_source_year").option("header", True).csv(path)
    return landed.read_yearly_csv(t.spark, path, columns).drop(landed.CORRUPT)


@query(
    "source_reject_counts",
    o.sql(
        f'SELECT _source_year, count(*) AS n_rows, count(*) FILTER (WHERE day(d) <> 14) AS n_named, '
        "count(*) FILTER (WHERE day(d) IN (13, 14)) AS n_corrupt FROM "
        f'(SELECT _source_year, try_cast("{b.WEATHER_DATE}" AS DATE) AS d FROM raw_weather0) GROUP BY 1',
        "raw_weather0",
    ),
)
def _(t: Inputs) -> DataFrame:
    """Broken rows of landed files, counted by year: some are cut short, some have a field too many."""
    path = shared_folder(t.spark, "weather")
    day = F.substring(F.col(f"`{b.WEATHER_DATE}`"), 9, 2)
    fields = [F.col(f"`{c}`") for c in (b.WEATHER_DATE, *b.WEATHER_COLUMNS)]
    whole = F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in fields])
    line = F.when(day == "13", fields[0]).when(day == "14", F.concat(F.lit(","), whole)).otherwise(whole)
    header = ",".join([b.WEATHER_DATE, *b.WEATHER_COLUMNS])
    dates_only = t.raw_weather().filter(F.col(f"`{b.WEATHER_DATE}`") != b.WEATHER_DATE)
    lines = dates_only.select(line.alias("value"), "_source_year", F.lit(1).alias("_at"))
    heads = lines.select(F.lit(header).alias("value"), "_source_year", F.lit(0).alias("_at")).distinct()
    landing = lines.unionByName(heads).repartition("_source_year").sortWithinPartitions("_source_year", "_at")
    landing.select("value", "_source_year").write.partitionBy("_source_year").text(path)
    rows = landed.read_yearly_csv(t.spark, path, [b.WEATHER_DATE, *b.WEATHER_COLUMNS])
    return landed.corrupt_rows(rows, ["_source_year"], b.WEATHER_DATE)


def _yearly(t: Inputs, source: str) -> DataFrame:
    rows = t.items().select(F.year("d").alias("_source_year"), "l_orderkey", "n", "q", "disc", "tax")
    held = {
        "api": F.col("_source_year").isin(2019, 2020),
        "csv": F.col("_source_year").isin(2020, 2021, 2022),
        "manual": F.col("_source_year") >= 2019,
    }[source]
    return rows.filter(held).drop("disc", "tax").withColumn("source", F.lit(source))


@query(
    "source_fallback",
    o.sql(
        "SELECT CAST(year(d) AS INT) AS _source_year, l_orderkey, n, q, CASE WHEN year(d) <= 2020 THEN 'api' "
        "WHEN year(d) <= 2022 THEN 'csv' ELSE 'manual' END AS source FROM items",
        "items",
    ),
)
def _(t: Inputs) -> DataFrame:
    return landed.first_available([_yearly(t, s) for s in ("api", "csv", "manual")], shared_folder(t.spark, "yearly"))


@query(
    "resource_selection",
    "WITH c AS (SELECT p_partkey AS id, CASE WHEN p_type < 'M' THEN 'csv' WHEN p_type < 'S' THEN 'JSON' END AS format, "
    "CASE WHEN p_size > 45 THEN true WHEN p_size < 10 THEN false END AS datastore_active FROM part), "
    "h AS (SELECT * FROM c WHERE upper(format) = 'CSV') SELECT * FROM h WHERE datastore_active OR "
    "NOT EXISTS (SELECT 1 FROM h WHERE datastore_active)",
)
def _(t: Inputs) -> DataFrame:
    size = F.col("p_size")
    entries = t.table("part").select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_type") < "M", "csv").when(F.col("p_type") < "S", "JSON").alias("format"),
        F.when(size > 45, True).when(size < 10, False).alias("datastore_active"),
    )
    return landed.pick_resources(entries)


@query(
    "union_missing_columns",
    "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment FROM supplier "
    "UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer",
)
def _(t: Inputs) -> DataFrame:
    old = t.table("supplier").selectExpr("s_suppkey AS id", "s_name AS name", "s_acctbal AS balance")
    new = t.table("customer").selectExpr("c_mktsegment AS segment", "c_custkey AS id", "c_name AS name")
    return landed.stack(old, new)


@query(
    "dedupe_rows",
    o.sql(
        "SELECT (SELECT count(*) FROM raw_current) AS n_before, (SELECT count(*) FROM repaired) AS n_after, "
        "(SELECT count(*) FROM raw_current) - (SELECT count(*) FROM repaired) AS n_removed",
        "raw_current",
        "repaired",
    ),
)
def _(t: Inputs) -> DataFrame:
    """Duplicate accounting in one aggregate: copies per distinct row, then totals."""
    copies = staging.copies(staging.repaired(t.raw_current()))
    totals = copies.agg(F.sum("n").alias("n_before"), F.count(F.lit(1)).alias("n_after"))
    return totals.withColumn("n_removed", F.col("n_before") - F.col("n_after"))


@query(
    "registry_views",
    "SELECT n_name, count(*) AS n_suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1",
)
def _(t: Inputs) -> DataFrame:
    """Declared sources as views, queried by name in SQL."""
    t.tables.register_views(t.spark)
    return t.spark.sql(
        "SELECT n_name, count(*) AS n_suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name"
    )


@query(
    "sink_mart",
    o.sql(
        "SELECT location_id, program_name, sector, occupancy, occupancy_rate, is_effectively_full, year_number FROM fact "
        "WHERE year_number >= 2023",
        "fact",
    ),
)
def _(t: Inputs) -> DataFrame:
    """Write the fact by year, read the years from 2023 on: only those folders are opened."""
    path = shared_folder(t.spark, "mart")
    columns = ["location_id", "program_name", "sector", "occupancy", "occupancy_rate", "is_effectively_full", "year_number"]
    sinks.save_mart(t.fact().select(*columns), path)
    return t.spark.read.parquet(path).filter("year_number >= 2023")


@query("sink_replace", o.sql(f"SELECT {o.big('count(*)')} AS n_loaded, {o.big('count(*)')} AS n_stored FROM rates", "rates"))
def _(t: Inputs) -> DataFrame:
    """Load twice, store once: the second load replaces the first; rows are counted while writing."""
    path = shared_folder(t.spark, "load")
    sinks.replace(t.rates(), path)
    n = sinks.replace(t.rates(), path)
    stored = t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_stored"))
    return stored.select(F.lit(n).cast("long").alias("n_loaded"), "n_stored")


@query("sink_csv", o.sql("SELECT series, lag_months, scope, mae_naive, mae_drift FROM rate_errors", "rate_errors"))
def _(t: Inputs) -> DataFrame:
    path = shared_folder(t.spark, "csv")
    rows = backtest.error_table(rate_folds(t), ("naive", "drift"), TEST_START, LAG_KEYS)
    sinks.write_csv(rows.drop("n_forecasts"), path, digits=3)
    schema = "series string, lag_months int, scope string, mae_naive double, mae_drift double"
    return t.spark.read.schema(schema).option("header", True).csv(path)


@query("sink_json", o.table("map_rows"))
def _(t: Inputs) -> DataFrame:
    path, rows = shared_folder(t.spark, "map"), map_rows(t)
    sinks.write_json(rows, path)
    return t.spark.read.schema(rows.schema).json(path)


@query(
    "freshness",
    "SELECT request_key, payload, fetched_at, age_hours, age_hours < 24 AS is_fresh FROM (SELECT md5(event_type || '{\"user\": ' "
    "|| user_id || '}') AS request_key, arg_max(event_id, ts) AS payload, max(ts) AS fetched_at, "
    "date_diff('microsecond', max(ts), TIMESTAMP '2024-01-31') / 3.6e9::DOUBLE AS age_hours FROM events GROUP BY 1)",
)
def _(t: Inputs) -> DataFrame:
    params = F.concat(F.lit('{"user": '), F.col("user_id").cast("string"), F.lit("}"))
    manifest = t.table("events").select(
        text.request_key("event_type", params).alias("request_key"),
        F.col("ts").alias("fetched_at"),
        F.col("event_id").alias("payload"),
    )
    now = F.lit("2024-01-31").cast(manifest.schema["fetched_at"].dataType)
    return landed.freshness(landed.latest_landed(manifest, "request_key"), now, 24.0)


@query(
    "json_fields",
    "SELECT event_id, try_cast(props->>'$.k' AS INTEGER) AS k, props->>'$.missing' AS missing FROM events",
)
def _(t: Inputs) -> DataFrame:
    return t.table("events").select(
        "event_id", text.json_field("props", "k", "int").alias("k"), text.json_field("props", "missing").alias("missing")
    )


# --- data quality ----------------------------------------------------------------------------


def _check_sql(table: str, rules: quality.Rules) -> str:
    parts = [(k, c, f"count(*) FILTER (WHERE {c} IS NULL)") for k, c in (("not_null", c) for c in rules.not_null)]
    parts += [
        ("accepted_values", c, f"count(*) FILTER (WHERE {c} NOT IN ({', '.join(repr(v) for v in vs)}))")
        for c, vs in rules.accepted.items()
    ]
    out = [f"SELECT '{table}' AS table_name, '{k}' AS test, '{c}' AS column_name, {e} AS n_failures FROM {table}" for k, c, e in parts]
    out += [
        f"SELECT '{table}', 'unique', '{c}', (SELECT count(*) FROM (SELECT {c} FROM {table} WHERE {c} IS NOT NULL GROUP BY 1 HAVING count(*) > 1))"
        for c in rules.unique
    ]
    return " UNION ALL ".join(out)


@query(
    "dq_report",
    o.sql(
        "SELECT *, n_failures = 0 AS passed FROM ("
        + " UNION ALL ".join(_check_sql(n, r) for n, r in quality.STAGING_RULES.items())
        + ")",
        *quality.STAGING_RULES,
    ),
)
def _(t: Inputs) -> DataFrame:
    """Every test as an aggregate over its plan: a report writes no staging table."""
    return models.data_tests(models.staging_models(t.spark, raw_sources(t)))


@query(
    "dq_duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL "
    "GROUP BY 1, 2 HAVING count(*) > 1",
)
def _(t: Inputs) -> DataFrame:
    return quality.duplicates(t.table("lineitem"), "l_orderkey", "l_linenumber")


@query(
    "dq_rejects",
    o.sql(
        " UNION ALL ".join(
            f"SELECT '{label}' AS column_name, count(*) FILTER (WHERE trim({c}) <> '' AND {typed} IS NULL) AS n_rejected, "
            "count(*) AS n_rows FROM raw_current"
            for label, c, typed in (
                ("occupied_beds", "OCCUPIED_BEDS", "try_cast(OCCUPIED_BEDS AS INTEGER)"),
                ("capacity_funding_room", "CAPACITY_FUNDING_ROOM", "try_cast(CAPACITY_FUNDING_ROOM AS INTEGER)"),
                ("location_id", "LOCATION_ID", "try_cast(LOCATION_ID AS INTEGER)"),
                ("service_user_count", "SERVICE_USER_COUNT", "try_cast(SERVICE_USER_COUNT AS DOUBLE)"),
                ("occupancy_date", "OCCUPANCY_DATE", "try_cast(CASE WHEN length(trim(OCCUPANCY_DATE)) IN (8, 17) THEN '20' ELSE '' END "
                 "|| split_part(trim(OCCUPANCY_DATE), 'T', 1) AS DATE)"),
            )
        ),
        "raw_current",
    ),
)
def _(t: Inputs) -> DataFrame:
    return quality.rejects(
        t.raw_current(),
        {
            "occupied_beds": ("OCCUPIED_BEDS", lenient_int("OCCUPIED_BEDS")),
            "capacity_funding_room": ("CAPACITY_FUNDING_ROOM", lenient_int("CAPACITY_FUNDING_ROOM")),
            "location_id": ("LOCATION_ID", lenient_int("LOCATION_ID")),
            "service_user_count": ("SERVICE_USER_COUNT", lenient_double("SERVICE_USER_COUNT")),
            "occupancy_date": ("OCCUPANCY_DATE", dates.iso_date(dates.repair_short_year("OCCUPANCY_DATE"))),
        },
    )


# --- time-series preparation -----------------------------------------------------------------


@query("regularize", o.table("weekly_regular"))
def _(t: Inputs) -> DataFrame:
    return series.regularize(weekly(t), SERIES, "week_start", "week")


@query("interpolate", o.sql("SELECT series, week_start, round(y, 6) AS y FROM weekly_filled", "weekly_filled"))
def _(t: Inputs) -> DataFrame:
    return weekly_filled(t).withColumn("y", round_to("y", 6))


@query(
    "forward_fill",
    o.sql(
        "SELECT g.series, g.date_day, r.policy_rate FROM (SELECT series, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) "
        "AS DATE) AS date_day FROM rate_panel GROUP BY 1) g ASOF LEFT JOIN rate_panel r ON g.series = r.series AND g.date_day >= r.date",
        "rate_panel",
    ),
)
def _(t: Inputs) -> DataFrame:
    """Rates carried over days without an observation, series by series."""
    daily = series.regularize(t.rate_panel(), SERIES, "date", "day")
    return series.forward_fill(daily, SERIES, "date", "policy_rate").withColumnRenamed("date", "date_day")


@query(
    "annual_spread",
    o.sql(
        f"SELECT month_start, total_occupied, survey FROM panel_monthly LEFT JOIN (SELECT year({o.SLOTS['order_day']}) AS y, "
        f"{o.mean('o_totalprice', 2, 2)} AS survey FROM orders WHERE month(o_orderdate) = 10 GROUP BY 1) "
        "ON year_number = y",
        "panel_monthly",
    ),
)
def _(t: Inputs) -> DataFrame:
    """An October survey applied to every month of its year."""
    october = t.table("orders").filter(F.month("o_orderdate") == 10)
    survey = october.groupBy(F.year(F.add_months(F.col("o_orderdate").cast("date"), 288)).alias("survey_year")).agg(
        exact_mean("o_totalprice", 2, 2).alias("survey")
    )
    months = marts.panel_monthly(t.fact()).select("month_start", "total_occupied")
    return series.spread_annual(months, survey, "month_start", "survey_year", "survey")


@query(
    "mask_window",
    o.sql(
        "SELECT series, month_start, CASE WHEN month_start BETWEEN DATE '2020-03-01' AND DATE '2020-12-01' THEN NULL "
        "ELSE occupancy_rate END AS masked, CAST(month_start BETWEEN DATE '2020-03-01' AND DATE '2020-12-01' AS INT)::DOUBLE AS covid "
        "FROM full_months",
        "full_months",
    ),
)
def _(t: Inputs) -> DataFrame:
    rows = rollups.monthly_series(t.fact())
    masked = series.mask_window(rows, "month_start", "occupancy_rate", *COVID, name="masked")
    return masked.select("series", "month_start", "masked", series.in_window("month_start", *COVID).alias("covid"))


@query("features_lag", o.table("lag_frame"))
def _(t: Inputs) -> DataFrame:
    return backtest.lagged_frame(rate_series(t), SERIES, "month_start", "occupancy_rate", "avg_policy_rate", LAGS, 3)


@query(
    "calendar_lag",
    o.sql(
        "SELECT a.series, a.month_start, a.occupancy_rate, p.occupancy_rate AS a_year_ago FROM full_months a LEFT JOIN full_months p "
        "ON p.series = a.series AND p.month_start + INTERVAL 12 MONTH = a.month_start",
        "full_months",
    ),
)
def _(t: Inputs) -> DataFrame:
    rows = rollups.monthly_series(t.fact()).select("series", "month_start", "occupancy_rate")
    return series.add_calendar_lag(rows, SERIES, "month_start", "occupancy_rate", 12, "a_year_ago")


@query(
    "first_difference",
    o.sql(
        "SELECT series, month_start, round(diff, 2) AS diff, idx FROM (SELECT series, month_start, occupancy_rate - lag(occupancy_rate) "
        "OVER w AS diff, CAST(row_number() OVER w - 2 AS INT) AS idx FROM full_months WINDOW w AS (PARTITION BY series ORDER BY month_start)) "
        "WHERE diff IS NOT NULL",
        "full_months",
    ),
)
def _(t: Inputs) -> DataFrame:
    rows = rollups.monthly_series(t.fact()).select("series", "month_start", "occupancy_rate")
    diff = series.difference(rows, SERIES, "month_start", "occupancy_rate")
    indexed = series.add_index(diff, SERIES, "month_start")
    return indexed.select("series", "month_start", round_to("diff", 2).alias("diff"), "idx")


@query(
    "recent_tail",
    o.sql("SELECT * FROM weekly QUALIFY row_number() OVER (PARTITION BY series ORDER BY week_start DESC) <= 52", "weekly"),
)
def _(t: Inputs) -> DataFrame:
    return series.tail(weekly(t), SERIES, "week_start", 52)


@query(
    "future_index",
    o.sql(
        "SELECT series, origin, CAST(k AS INT) AS step, CAST(origin + to_days(CAST(7 * k AS INT)) AS DATE) AS target FROM "
        "(SELECT series, max(week_start) AS origin FROM weekly GROUP BY 1), range(1, 13) AS r(k)",
        "weekly",
    ),
)
def _(t: Inputs) -> DataFrame:
    return series.future_index(weekly(t), SERIES, "week_start", 12, "week")


@query(
    "series_summary",
    o.sql(
        "SELECT data_schema_version, count(*) AS n_rows, min(occupancy_date) AS first_day, max(occupancy_date) AS last_day "
        "FROM panel GROUP BY 1",
        "panel",
    ),
)
def _(t: Inputs) -> DataFrame:
    return reports.series_summary(t.panel(), "occupancy_date", ["data_schema_version"])


@query("latest_rates", o.sql("SELECT date, policy_rate FROM rates ORDER BY date DESC LIMIT 5", "rates"))
def _(t: Inputs) -> DataFrame:
    return reports.latest_rows(t.rates(), "date")


# --- backtests -------------------------------------------------------------------------------

query("backtest_baselines", o.table("weekly_folds"))(weekly_folds)
query("backtest_rate_folds", o.table("rate_folds"))(rate_folds)
MODELS = ("naive", "seasonal_naive", "drift", "trend_season")


@query("fold_metrics", o.table("fold_metrics"))
def _(t: Inputs) -> DataFrame:
    return backtest.fold_metrics(weekly_folds(t), MODELS, SERIES)


@query("model_summary", o.sql("SELECT * FROM model_summary ORDER BY series, mean_mae, model", "model_summary"))
def _(t: Inputs) -> DataFrame:
    summary = backtest.model_summary(backtest.fold_metrics(weekly_folds(t), MODELS, SERIES), SERIES)
    return summary.orderBy("series", "mean_mae", "model")


@query(
    "best_model",
    o.sql(
        "SELECT series, model AS best_model, mean_mae FROM model_summary QUALIFY row_number() OVER (PARTITION BY series "
        "ORDER BY mean_mae, model) = 1",
        "model_summary",
    ),
)
def _(t: Inputs) -> DataFrame:
    return backtest.best_model(backtest.model_summary(backtest.fold_metrics(weekly_folds(t), MODELS, SERIES), SERIES), SERIES)


_RATE_ERRORS = ", ".join(f"mae_{m}" for m in RATE_MODELS)
_AGAINST = {"pct_vs_naive": "naive", "pct_vs_univariate": "arma"}
_AGAINST_SQL = ", ".join(
    f"round((mae_arma_rate - mae_{base}) / nullif(mae_{base}, 0) * 100, 3) AS {name}" for name, base in _AGAINST.items()
)


@query("error_by_scope", o.sql(f"SELECT series, scope, n_forecasts, {_RATE_ERRORS}, {_AGAINST_SQL} FROM rate_errors WHERE lag_months = 6", "rate_errors"))
def _(t: Inputs) -> DataFrame:
    """Errors of all monthly models; the rate model against the last value and against the same model without the rate."""
    table = backtest.error_table(rate_folds(t, (6,)), RATE_MODELS, TEST_START, SERIES)
    return backtest.compare_errors(table, "arma_rate", _AGAINST)


@query("lag_sweep", o.sql(f"SELECT series, lag_months, n_forecasts, {_RATE_ERRORS}, {_AGAINST_SQL} FROM rate_errors WHERE scope = 'test'", "rate_errors"))
def _(t: Inputs) -> DataFrame:
    rows = backtest.within(rate_folds(t), start=TEST_START)
    return backtest.compare_errors(backtest.error_table(rows, RATE_MODELS, None, LAG_KEYS).drop("scope"), "arma_rate", _AGAINST)


@query("unit_root", o.table("unit_root"))
def _(t: Inputs) -> DataFrame:
    """Whether the weekly series, or their steps, are stationary, which decides on differencing in the backtests."""
    weeks = written(t, weekly_filled(t), "weeks")
    level = weeks.select("series", F.lit("level").alias("variable"), "week_start", "y")
    steps = series.difference(weeks, SERIES, "week_start", "y").select("series", F.lit("difference").alias("variable"), "week_start", F.col("diff").alias("y"))
    tested = stationarity.unit_root(level.unionByName(steps), ["series", "variable"], "week_start", "y", max_lag=4)
    return tested.withColumns({c: round_to(c, 6) for c in ("statistic", "p_value")})


@query("forecast_ahead", o.table("ahead"))
def _(t: Inputs) -> DataFrame:
    """The twelve weeks after the last one of every series."""
    rows = running.ahead(weekly_filled(t), SERIES, "week_start", "y", 12, "week", 52, SEASON_LENGTH)
    return rows.withColumns({c: round_to(c, 6) for c in ("drift", "trend_season", "arma")})


@query("one_step_folds", o.sql("SELECT * FROM weekly_folds WHERE step = 1", "weekly_folds"))
def _(t: Inputs) -> DataFrame:
    return backtest.one_step(weekly_folds(t))


# --- regression ------------------------------------------------------------------------------

TARGET = "system_occupancy_rate"
FRAME_COLUMNS = (
    "series", "month_start", "year_number", TARGET, "avg_policy_rate", "avg_temp_c", "season", "time_trend",
    "policy_rate_lag", "is_covid", "post_2021", "is_spring", "is_summer", "is_fall",
)


def regression_rows(t: Inputs) -> DataFrame:
    """Monthly regression input for the system and every sector."""
    months = rollups.monthly_series(t.fact(), min_days=1).select(
        "series", "month_start", F.year("month_start").alias("year_number"), F.col("occupancy_rate").alias(TARGET)
    )
    rates = marts.rates_monthly(stg_rates(t)).select("month_start", "avg_policy_rate")
    weather = marts.weather_monthly(stg_weather(t)).select("month_start", "avg_temp_c")
    joined = months.join(rates, "month_start").join(weather, "month_start")
    return series.regression_frame(joined, t.calendar(), 2017, 2025, keys=SERIES).select(*FRAME_COLUMNS)


def written_rows(t: Inputs) -> DataFrame:
    """The monthly frame written once, for plans that fit and then predict on it."""
    return written(t, regression_rows(t), "regression")


def fits(rows: DataFrame) -> DataFrame:
    return regression.fit(rows, SERIES, TARGET, o.PREDICTORS)


query("regression_input", o.table("regression", ", ".join(FRAME_COLUMNS)))(regression_rows)


@query(
    "ols_coefficients",
    o.sql("SELECT series, term, round(coef, 6) AS coef, round(std_err, 6) AS std_err, round(coef / std_err, 4) AS t_value FROM reg_terms", "reg_terms"),
)
def _(t: Inputs) -> DataFrame:
    rows = regression.coefficients(fits(regression_rows(t)), SERIES)
    return rows.select("series", "term", *[round_to(c, d).alias(c) for c, d in (("coef", 6), ("std_err", 6), ("t_value", 4))])


_INFERENCE = {"coef": 6, "std_err": 6, "t_value": 4, "p_value": 6, "ci_low": 5, "ci_high": 5}


@query(
    "ols_inference",
    o.sql(
        "SELECT series, term, round(coef, 6) AS coef, round(std_err, 6) AS std_err, round(t, 4) AS t_value, abs(round(p, 6)) AS p_value, "
        "round(coef - width * std_err, 5) AS ci_low, round(coef + width * std_err, 5) AS ci_high, "
        "CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM reg_tests",
        "reg_tests",
    ),
)
def _(t: Inputs) -> DataFrame:
    """p-values, intervals and stars of every coefficient."""
    rows = regression.coefficients(fits(regression_rows(t)), SERIES)
    return rows.select("series", "term", *[round_to(c, d).alias(c) for c, d in _INFERENCE.items()], "stars")


@query(
    "ols_effects",
    o.sql(
        "SELECT series, term, CASE term WHEN 'avg_temp_c' THEN '10 degrees colder' ELSE 'per year' END AS effect, "
        "round(coef * CASE term WHEN 'avg_temp_c' THEN -10 ELSE 12 END, 5) AS amount FROM reg_terms "
        "WHERE term IN ('avg_temp_c', 'time_trend')",
        "reg_terms",
    ),
)
def _(t: Inputs) -> DataFrame:
    table = regression.coefficients(fits(regression_rows(t)), SERIES)
    scales = {"avg_temp_c": ("10 degrees colder", -10), "time_trend": ("per year", 12)}
    return regression.effects(table, scales).select("series", "term", "effect", round_to("amount", 5).alias("amount"))


@query("vif", o.sql("SELECT series, term, round(vif, 6) AS vif FROM reg_terms WHERE term <> 'Intercept'", "reg_terms"))
def _(t: Inputs) -> DataFrame:
    return regression.vif(fits(regression_rows(t)), SERIES).withColumn("vif", round_to("vif", 6))


@query(
    "ols_fit_statistics",
    o.sql(
        "SELECT series, n, CAST(dof AS BIGINT) AS dof, round(1 - ssr / syy, 8) AS r2, round(1 - ssr / syy * (n - 1) / dof, 8) AS adj_r2, "
        "round((syy - ssr) / 7 / (ssr / dof), 4) AS f_value, round(-n / 2.0 * (ln(2 * pi()) + ln(ssr / n) + 1), 6) AS log_lik, "
        "round(16 + n * (ln(2 * pi()) + ln(ssr / n) + 1), 6) AS aic, round(8 * ln(n) + n * (ln(2 * pi()) + ln(ssr / n) + 1), 6) AS bic, "
        f"round(ssr, 6) AS ssr, round({o.f_above('(syy - ssr) / 7 / (ssr / dof)', '7', 'dof')}, 8) AS f_p FROM reg_fit",
        "reg_fit",
    ),
)
def _(t: Inputs) -> DataFrame:
    digits = {"r2": 8, "adj_r2": 8, "f_value": 4, "log_lik": 6, "aic": 6, "bic": 6, "ssr": 6, "f_p": 8}
    stats = regression.fit_statistics(fits(regression_rows(t)), SERIES)
    return stats.select("series", "n", "dof", *[round_to(c, d).alias(c) for c, d in digits.items()])


@query(
    "ols_residuals",
    o.sql(
        "SELECT series, month_start, system_occupancy_rate, round(fitted, 6) AS fitted, "
        "round(system_occupancy_rate - fitted, 6) AS residual FROM reg_rows",
        "reg_rows",
    ),
)
def _(t: Inputs) -> DataFrame:
    rows = written_rows(t)
    out = regression.predict(rows, fits(rows), SERIES, TARGET, o.PREDICTORS)
    return out.select("series", "month_start", TARGET, round_to("fitted", 6).alias("fitted"), round_to("residual", 6).alias("residual"))


@query(
    "residual_diagnostics",
    o.sql(
        "SELECT series, n, round(ss / s2, 6) AS durbin_watson, round(s3 / n / pow(s2 / n, 1.5), 6) AS skew, "
        "round(s4 / n / pow(s2 / n, 2), 6) AS kurtosis, round(n / 6.0 * (pow(s3 / n / pow(s2 / n, 1.5), 2) + "
        "pow(s4 / n / pow(s2 / n, 2) - 3, 2) / 4), 6) AS jarque_bera, round(exp(-n / 12.0 * (pow(s3 / n / pow(s2 / n, 1.5), 2) + "
        "pow(s4 / n / pow(s2 / n, 2) - 3, 2) / 4)), 6) AS jb_p FROM (SELECT series, count(*) AS n, sum(pow(e, 2)) AS s2, sum(pow(e, 3)) AS s3, "
        "sum(pow(e, 4)) AS s4, sum(pow(e - e0, 2)) AS ss FROM (SELECT series, system_occupancy_rate - fitted AS e, "
        "lag(system_occupancy_rate - fitted) OVER (PARTITION BY series ORDER BY month_start) AS e0 FROM reg_rows) GROUP BY 1)",
        "reg_rows",
    ),
)
def _(t: Inputs) -> DataFrame:
    rows = written_rows(t)
    residuals = regression.predict(rows, fits(rows), SERIES, TARGET, o.PREDICTORS)
    out = regression.residual_diagnostics(residuals, SERIES, "month_start")
    return out.select("series", "n", *[round_to(c, 6).alias(c) for c in ("durbin_watson", "skew", "kurtosis", "jarque_bera", "jb_p")])


def line_ahead(train: np.ndarray, horizon: int) -> np.ndarray:
    """A straight line through all values, from exact sums; no opinion beyond ten steps."""
    units = [round(v * 1e6) for v in train.tolist()]
    n, sy, sty = float(len(units)), float(sum(units)), float(sum(i * u for i, u in enumerate(units)))
    st, stt = n * (n - 1) / 2, (n - 1) * n * (2 * n - 1) / 6
    slope = (n * sty - st * sy) / (n * stt - st * st)
    return ((sy - slope * st) / n + slope * (n + np.arange(min(horizon, 10)))) / 1e6


@query(
    "model_fold_alignment",
    o.sql(
        "SELECT coalesce(w.series, x.series) AS series, coalesce(w.origin, x.origin) AS origin, coalesce(w.target, x.target) AS target, w.fold, w.step, "
        "round(w.actual, 6) AS actual, round(x.drift, 3) AS forecast, CASE WHEN w.series IS NULL THEN 'extra' WHEN x.series IS NULL THEN 'missing' ELSE 'scored' END "
        "AS status FROM baseline_folds w FULL JOIN (SELECT * FROM outside_folds WHERE step <= 10) x ON w.series = x.series AND w.origin = x.origin AND w.target = x.target",
        "baseline_folds",
        "outside_folds",
    ),
)
def _(t: Inputs) -> DataFrame:
    """A model from outside, run per series by a grouped function, beside the targets of the weekly backtest.

    It starts four weeks early and looks ten weeks ahead, so it has targets that no fold asks for, and lacks others.
    """
    weeks = written(t, weekly_filled(t), "weeks")
    asked = backtest.folds(weeks, SERIES, "week_start", "y", 104, 12, 4)
    given = backtest.outside_forecasts(weeks, SERIES, "week_start", "y", 100, 12, 4, line_ahead)
    rows = backtest.align(asked, given, SERIES)
    return rows.withColumns({"actual": round_to("actual", 6), "forecast": round_to(round_to("forecast", 6), 3)})


@query(
    "long_series",
    "WITH e AS (SELECT event_id, ts, CASE WHEN event_id % 7 < 3 THEN value END AS value, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx FROM events), "
    "f AS (SELECT *, lag(value, 3) OVER (ORDER BY idx) AS lag3, value - lag(value) OVER (ORDER BY idx) AS diff, "
    "last_value(CASE WHEN value IS NOT NULL THEN idx END IGNORE NULLS) OVER (ORDER BY idx) AS i0, last_value(value IGNORE NULLS) OVER (ORDER BY idx) AS v0, "
    "first_value(CASE WHEN value IS NOT NULL THEN idx END IGNORE NULLS) OVER (ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS i1, "
    "first_value(value IGNORE NULLS) OVER (ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1 FROM e) "
    "SELECT event_id, idx, value, lag3, round(diff, 6) AS diff, round(CASE WHEN value IS NOT NULL THEN value WHEN i1 IS NULL THEN v0 "
    "ELSE v0 + (v1 - v0) * (CAST(idx - i0 AS DOUBLE) / (i1 - i0)) END, 6) AS filled FROM f",
)
def _(t: Inputs) -> DataFrame:
    """All events as one series, four values of seven unknown: position, lag, step and interpolation without a key."""
    value = F.when(F.col("event_id") % 7 < 3, F.col("value")).alias("value")
    rows = ordered.lay_out(t.table("events").select("event_id", "ts", value), ["ts", "event_id"])
    rows = ordered.indexed(ordered.differenced(ordered.lagged(rows, "value", 3, "lag3"), "value"))
    rows = ordered.interpolated(rows, "value", "filled")
    return rows.select("event_id", "idx", "value", "lag3", round_to("diff", 6).alias("diff"), round_to("filled", 6).alias("filled"))


_DAY_LEVELS = {"system": None, "sector": "sector", "location": "location_id"}


@query(
    "distinct_days",
    o.sql(
        " UNION ALL ".join(
            f"SELECT '{level}' AS level, {f'CAST({key} AS VARCHAR)' if key else 'NULL'} AS key, '{period}' AS period, "
            f"{start('occupancy_date')} AS period_start, count(DISTINCT occupancy_date) AS n_days FROM fact GROUP BY ALL"
            for level, key in _DAY_LEVELS.items()
            for period, start in (("month", o.month), ("week", o.week))
        ),
        "fact",
    ),
)
def _(t: Inputs) -> DataFrame:
    """Observed days of every level and period, all from one stored table of day bits."""
    bits = written(t, rollups.day_bits(t.fact(), ["sector", "location_id"]), "day-bits")
    parts = []
    for level, key in _DAY_LEVELS.items():
        for period in ("month", "week"):
            days = rollups.distinct_days(bits, [key] if key else [], period)
            shown = F.col(key).cast("string") if key else F.lit(None).cast("string")
            parts.append(days.select(F.lit(level).alias("level"), shown.alias("key"), F.lit(period).alias("period"), F.col(f"{period}_start").alias("period_start"), "n_days"))
    return landed.stack(*parts)


# --- versioned loads -------------------------------------------------------------------------


@query(
    "versioned_load",
    "SELECT event_type AS resource, CAST(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 2 ELSE 1 END AS INT) AS version, "
    "CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN count(*) ELSE count(*) FILTER (WHERE event_id % 5 <> 0) END AS n_rows, "
    "CAST(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN sum(CAST(round(value * 100) AS BIGINT)) "
    "ELSE sum(CAST(round(value * 100) AS BIGINT)) FILTER (WHERE event_id % 5 <> 0) END AS BIGINT) AS total FROM events GROUP BY 1",
)
def _(t: Inputs) -> DataFrame:
    """Events by type, loaded twice: the second time only the first type has changed, and only its files are read.

    The third load fails after writing a resource; readers stay with the second.
    """
    spark, root = t.spark, shared_folder(t.spark, "versions")
    events = t.table("events").select("event_id", "event_type", scaled("value", 2).alias("units"))
    kinds = [r[0] for r in events.select("event_type").distinct().orderBy("event_type").collect()]  # a few types
    part = events.filter(F.col("event_id") % 5 != 0)
    of = lambda rows, kind: lambda: rows.filter(F.col("event_type") == kind)

    def fail() -> DataFrame:
        raise RuntimeError("unreadable")

    versions.load(spark, root, {k: ("part", of(part, k)) for k in kinds})
    versions.load(spark, root, {k: ("all", of(events, k)) if k == kinds[0] else ("part", fail) for k in kinds})
    try:
        versions.load(spark, root, {k: ("new", of(events, k) if k == kinds[0] else fail) for k in kinds})
    except RuntimeError:
        pass  # the failed load this query is about
    sums = versions.read(spark, root).groupBy("resource").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("units").alias("total"))
    return versions.manifest(spark, root).select("resource", "version").join(sums, "resource")


# --- incremental ingest ----------------------------------------------------------------------


LATE = 3


@query(
    "late_daily_totals",
    "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n_rows, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total, "
    "count(*) FILTER (WHERE event_id % 17 = 0 AND CAST(ts AS DATE) < "
    f"(SELECT max(CAST(ts AS DATE)) FROM events WHERE event_id % 17 <> 0) - {LATE}) AS n_late FROM events GROUP BY 1, 2",
)
def _(t: Inputs) -> DataFrame:
    """Events landed in two deliveries, the second with the missing rows and all others again; every day has its totals."""
    spark, landing = t.spark, shared_folder(t.spark, "landing")
    rows = t.table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", scaled("value", 2).alias("units"))
    store, progress = shared_folder(spark, "daily"), shared_folder(spark, "progress")
    for delivery in (rows.filter(F.col("event_id") % 17 != 0), rows):
        delivery.write.mode("append").parquet(landing)
        stream = late.landed_stream(spark, landing, rows.schema)
        late.run_available(stream, store, progress, "ts", ["event_type"], "units", ["event_id"], LATE)
    return late.daily_totals(spark, store, ["event_type"])


_ON_TIME = f"date_trunc('millisecond', (SELECT max(ts) FROM events WHERE event_id % 17 <> 0)) - INTERVAL {LATE} DAY"
_CLOSED = f"date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL {LATE} DAY"


@query(
    "event_time_totals",
    "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n_rows, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events "
    f"WHERE (event_id % 17 <> 0 OR ts > {_ON_TIME}) AND CAST(ts AS DATE) + INTERVAL 1 DAY <= {_CLOSED} GROUP BY 1, 2",
)
def _(t: Inputs) -> DataFrame:
    """The deliveries of ``late_daily_totals`` by event-time state, in two runs of one checkpoint: days behind the watermark."""
    spark, landing = t.spark, shared_folder(t.spark, "landing")
    rows = t.table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", scaled("value", 2).alias("units"))
    store, progress = shared_folder(spark, "closed-days"), shared_folder(spark, "progress")
    for delivery in (rows.filter(F.col("event_id") % 17 != 0), rows):
        delivery.write.mode("append").parquet(landing)
        stream = late.landed_stream(spark, landing, rows.schema)
        late.run_event_time(late.event_time_totals(stream, "ts", ["event_type"], "units", ["event_id"], f"{LATE} days"), store, progress)
    return spark.read.schema("event_type string, day date, n_rows long, total long").parquet(store)
