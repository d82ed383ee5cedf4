"""The whole transformation from raw tables to marts, as one lazy graph and one build."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from daybook.operators import marts, quality, staging
from daybook.session import shared_folder
from daybook.sources import calendar, sinks
from daybook.sources.registry import Sources

RAW = ("raw_legacy", "raw_current", "raw_rates", "raw_weather")


def staging_models(spark: SparkSession, raw: Sources) -> dict[str, DataFrame]:
    """Staging tables by name; nothing runs until one of them is used."""
    legacy = staging.stage_legacy(raw.read(spark, "raw_legacy"))
    current = staging.stage_current(staging.repair_current(raw.read(spark, "raw_current")))
    return {
        "stg_legacy": legacy,
        "stg_current": current,
        "stg_unified": staging.unify(legacy, current),
        "stg_rates": staging.stage_rates(raw.read(spark, "raw_rates")),
        "stg_weather": staging.stage_weather(raw.read(spark, "raw_weather")),
    }


def write_staging(spark: SparkSession, raw: Sources, out: str | None = None) -> dict[str, DataFrame]:
    """The staging tables written once, below ``out`` or a shared folder, and read again.

    Raw text is parsed, and copies of second-generation rows are dropped, once
    for all marts, tests and reports; the union is derived from its two parts.
    """
    out = out or shared_folder(spark, "staging")
    models = {}
    for name, df in staging_models(spark, raw).items():
        if name != "stg_unified":
            df.write.parquet(f"{out}/{name}")
            models[name] = spark.read.schema(df.schema).parquet(f"{out}/{name}")
    return models | {"stg_unified": staging.unify(models["stg_legacy"], models["stg_current"])}


def data_tests(models: dict[str, DataFrame]) -> DataFrame:
    """The 18 data tests of the staging tables, stored ones or plans: each is an aggregate that writes nothing."""
    return quality.report({name: (models[name], rules) for name, rules in quality.STAGING_RULES.items()})


def build(spark: SparkSession, raw: Sources, out: str, gate: bool = True) -> dict[str, int]:
    """Staging and marts as Parquet below ``out``; returns the rows written per mart.

    With ``gate``, a failing data test stops the build before any mart is
    written. The calendar spans the months of the daily rows. The monthly fact
    reads the daily fact as written.
    """
    models = write_staging(spark, raw, f"{out}/staging")
    for name, df in models.items():
        sinks.as_view(df, name)
    if gate:
        quality.require_passed(data_tests(models))
    dim = calendar.dim_date(calendar.months_of(models["stg_unified"], "occupancy_date"))
    rows = {
        "dim_date": sinks.replace(dim, f"{out}/dim_date"),
        "dim_location": sinks.replace(marts.dim_location(models["stg_current"]), f"{out}/dim_location"),
    }
    dim = spark.read.parquet(f"{out}/dim_date")
    rows["fact_daily"] = sinks.save_mart(marts.fact_daily(models["stg_unified"], dim), f"{out}/fact_daily")
    fact = spark.read.parquet(f"{out}/fact_daily")
    monthly = marts.fact_monthly(fact, models["stg_rates"], models["stg_weather"])
    return rows | {"fact_monthly": sinks.replace(monthly, f"{out}/fact_monthly")}
