import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from daybook.operators import marts, quality, reports, rollups, staging
from daybook.sources import calendar, lookups, sinks


def legacy_rows(spark, *rows):
    schema = ", ".join(f"{c} string" for c in staging.LEGACY_COLUMNS) + ", _source_year int"
    base = dict.fromkeys(staging.LEGACY_COLUMNS, " x ")
    return spark.createDataFrame([tuple({**base, **r}[c] for c in staging.LEGACY_COLUMNS) + (2020,) for r in rows], schema)


def current_rows(spark, *rows):
    schema = "_id long, " + ", ".join(f"{c} string" for c in staging.CURRENT_COLUMNS)
    base = dict.fromkeys(staging.CURRENT_COLUMNS, "")
    return spark.createDataFrame([(i, *({**base, **r}[c] for c in staging.CURRENT_COLUMNS)) for i, r in enumerate(rows)], schema)


def test_legacy_staging(spark):
    raw = legacy_rows(
        spark,
        {"OCCUPANCY_DATE": "01/31/2020", "SECTOR": " Men ", "OCCUPANCY": "12.6", "CAPACITY": "20"},
        {"OCCUPANCY_DATE": "2019-05-01T00:00:00", "SECTOR": "Women", "OCCUPANCY": "", "CAPACITY": "0"},
        {"OCCUPANCY_DATE": "2019-05-02T00:00:00", "OCCUPANCY": "5", "CAPACITY": None},
        {"OCCUPANCY_DATE": "  ", "OCCUPANCY": "5", "CAPACITY": "5"},
        {"OCCUPANCY_DATE": None, "OCCUPANCY": "5", "CAPACITY": "5"},
    )
    got = staging.stage_legacy(raw).orderBy("occupancy_date").collect()
    assert [(r.occupancy_date, r.occupancy, r.capacity_funding, r.capacity_actual, r.occupancy_rate) for r in got] == [
        (date(2019, 5, 1), None, 0, None, None),
        (date(2019, 5, 2), 5, None, None, None),
        (date(2020, 1, 31), 13, 20, None, 63.0),
    ]
    assert got[2].sector == "MEN" and got[2].shelter_name == "x" and got[2].data_schema_version == "legacy"


def test_current_staging_and_union(spark):
    bed = {"OCCUPANCY_DATE": "21-01-15T00:00:00", "OCCUPIED_BEDS": "9", "CAPACITY_ACTUAL_BED": "10", "CAPACITY_FUNDING_BED": "12"}
    room = {"OCCUPANCY_DATE": "2023-02-01", "OCCUPIED_ROOMS": "4", "CAPACITY_ACTUAL_ROOM": "0", "LOCATION_ID": "x"}
    raw = current_rows(spark, bed, bed, room, {**room, "OCCUPANCY_DATE": None})
    repaired = staging.repair_current(raw)
    assert repaired.count() == 3 and "_id" not in repaired.columns
    current = staging.stage_current(repaired)
    got = current.orderBy("occupancy_date").collect()
    assert [(r.occupancy_date, r.occupancy, r.capacity_actual, r.occupancy_rate, r.source_year) for r in got] == [
        (date(2021, 1, 15), 9, 10, 90.0, 2021),
        (date(2023, 2, 1), 4, 0, None, 2023),
    ]
    assert got[1].location_id is None and got[0].unoccupied_beds is None
    legacy = staging.stage_legacy(legacy_rows(spark, {"OCCUPANCY_DATE": "01/01/2020", "OCCUPANCY": "3", "CAPACITY": "4"}))
    both = staging.unify(legacy, current)
    assert tuple(both.columns) == staging.UNIFIED_COLUMNS
    old = both.filter("data_schema_version = 'legacy'").first()
    assert (old.capacity_actual, old.capacity_funding, old.has_actual_capacity, old.capacity_type) == (4, 4, False, None)


def test_rates_and_weather(spark):
    rates = spark.createDataFrame([("2020-01-01", 1.0), ("2020-01-02", 1.0), ("2020-02-01", 1.5)], "date string, policy_rate double")
    staged = staging.stage_rates(rates.withColumn("date", F.col("date").cast("date")))
    assert [r.is_rate_change_day for r in staged.orderBy("rate_date").collect()] == [None, False, True]
    months = marts.rates_monthly(staged).orderBy("month_start").collect()
    # a change on the first of a month is invisible inside that month
    assert [(r.avg_policy_rate, r.rate_changed_this_month) for r in months] == [(1.0, False), (1.5, False)]
    columns = [staging.WEATHER_DATE, *staging.WEATHER_COLUMNS]
    raw = spark.createDataFrame(
        [("2020-01-05", "1", "-20", "-10.5", "0", "0", "2.5", 2020), ("2020-01-06", "M", "", "M", "0", "0", "0", 2020),
         ("Date/Time", *columns[1:], 2020), (None, *["1"] * 6, 2020)],
        ", ".join(f"`{c}` string" for c in columns) + ", _source_year int",
    )
    got = staging.stage_weather(raw).orderBy("weather_date").collect()
    assert [(r.temp_mean_c, r.is_cold_day, r.is_extreme_cold, r.is_snow_day, r.day_of_week) for r in got] == [
        (-10.5, True, True, True, 0), (None, None, None, False, 1),
    ]


def test_calendar_dimension(spark):
    rows = calendar.dim_date(calendar.days(spark, date(2019, 12, 28), date(2020, 3, 1))).orderBy("date_day").collect()
    assert len(rows) == 65
    leap = [r for r in rows if r.date_day == date(2020, 2, 29)][0]
    assert (leap.day_name, leap.month_name, leap.season, leap.is_month_end, leap.is_weekend, leap.day_of_week) == (
        "Saturday", "February", "Winter", True, True, 6,
    )
    assert [r.week_of_year for r in rows if r.date_day in (date(2019, 12, 30), date(2020, 1, 5))] == [1, 1]
    assert rows[-1].quarter_label == "Q1" and rows[-1].is_month_start and rows[-1].season == "Spring"
    with pytest.raises(ValueError):
        calendar.days(spark, date(21, 1, 1), date(2020, 1, 1))


def test_canonical_row_is_deterministic_with_nulls_last(spark):
    rows = [(1, None, "a"), (1, "b", "z"), (1, "b", "c"), (2, None, "q"), (None, "x", "y")]
    df = spark.createDataFrame(rows, "id int, name string, address string")
    got = {r.id: (r.name, r.address) for r in marts.canonical_rows(df, "id", ["name", "address"]).collect()}
    assert got == {1: ("b", "c"), 2: (None, "q")}


PANEL = (
    "occupancy_date date, location_id long, sector string, occupancy int, capacity_actual int, occupancy_rate double, "
    "organization_name string, location_name string, location_address string, location_postal_code string, program_name string, "
    "capacity_funding int, overnight_service_type string, capacity_type string, data_schema_version string, has_actual_capacity boolean"
)


def panel(spark, *rows):
    tail = ("Org", "Loc", "1 St", "M5V 1A1", "P", 10, None, None, "current", True)
    return spark.createDataFrame([(*r, *tail) for r in rows], PANEL)


def test_fact_keeps_days_outside_the_calendar(spark):
    dim = calendar.dim_date(calendar.days(spark, date(2023, 1, 1), date(2023, 1, 31)))
    fact = marts.fact_daily(
        panel(spark, (date(2023, 1, 2), 1, "MEN", 11, 10, 110.0), (date(2024, 1, 2), 1, "MEN", None, 10, None)), dim
    )
    a, b = fact.orderBy("occupancy_date").collect()
    assert (a.is_effectively_full, a.is_over_capacity, a.month_name) == (True, True, "January")
    assert (b.is_effectively_full, b.is_over_capacity, b.year_number) == (None, None, None)


def flagged(spark, *rows):
    return marts.with_flags(panel(spark, *rows)).withColumn("year_number", F.year("occupancy_date")).withColumn(
        "month_number", F.month("occupancy_date")
    )


def test_monthly_rollup_by_hand(spark):
    d = date(2023, 5, 1)
    month = marts.panel_monthly(
        flagged(spark, (d, 1, "MEN", 10, 10, 100.0), (d, 2, "YOUTH", 5, None, None), (date(2023, 5, 9), 1, "MEN", 9, 20, 45.0))
    ).first()
    assert (month.avg_occupancy_rate, month.total_occupied, month.total_capacity) == (72.5, 24, 30)
    # occupied without capacity still counts above the line
    assert month.system_occupancy_rate == 80.0
    assert (month.programs_effectively_full, month.total_programs, month.pct_programs_full) == (1, 3, 33.33)
    assert (month.men_occupied, month.youth_occupied, month.families_occupied) == (19, 5, None)


def test_level_rollup_equals_separate_groupings(spark):
    rows = [(date(2023, 1, 1 + i % 28), i % 3, "MEN" if i % 2 else "WOMEN", i, 40, float(i)) for i in range(1, 40)]
    fact = flagged(spark, *rows)
    got = rollups.level_rollup(fact, ((), ("sector",), ("location_id",)))
    assert got.filter("level = 'system'").count() == 1
    assert {(r.sector, r.occupied) for r in got.filter("level = 'sector'").collect()} == {
        (r.sector, r.s) for r in fact.groupBy("sector").agg(F.sum("occupancy").alias("s")).collect()
    }
    total = got.filter("level = 'system'").first()
    assert total.mean_of_rates != total.ratio_of_sums and total.n_rows == 39


def test_weekly_series_needs_five_days(spark):
    monday = date(2023, 1, 2)
    rows = [(date(2023, 1, 2 + i), 1, "MEN", 5, 10, 50.0) for i in range(5)] + [(date(2023, 1, 9 + i), 1, "MEN", 5, 10, 50.0) for i in range(4)]
    got = rollups.weekly_series(flagged(spark, *rows)).collect()
    assert {(r.series, r.week_start, r.n_days) for r in got} == {("ALL", monday, 5), ("MEN", monday, 5)}


def test_hot_location_gives_the_same_report(spark):
    """A third of all rows on one location changes nothing but its own line."""
    rows = [(date(2023, 1, 1 + i % 28), 7 if i % 3 == 0 else 1000 + i, "MEN", i % 50, 50, float(i % 50) * 2) for i in range(900)]
    keys = ["location_id", "sector"]
    stress = reports.stress_by_entity(reports.stress_sums(flagged(spark, *rows), keys), keys, 30)
    got = stress.collect()
    assert [(r.location_id, r.total_days) for r in got] == [(7, 300)]
    want = sum(float(i % 50) * 2 for i in range(0, 900, 3)) / 300
    assert got[0].avg_occupancy_rate == pytest.approx(want, abs=0.05)


def test_variants_of_an_address_are_entities_and_same_names_are_one(spark):
    rows = [(date(2023, 1, 1 + i % 28), 1 + i % 3, "MEN", i % 50, 50, float(i % 50) * 2) for i in range(300)]
    sums = reports.stress_sums(flagged(spark, *rows), ["location_id", "sector"])
    places = spark.createDataFrame(
        [(1, "Site", "1 St", "M5V", "Org"), (2, "Site", "1 St Unit 2", "M5V", "Org"), (3, "Site", None, "M5V", "Org")],
        "location_id int, location_name string, location_address string, location_postal_code string, organization_name string",
    )
    joined = sums.join(places, "location_id")
    table = {r.location_address: r.total_days for r in reports.stress_table(joined, 30).collect()}
    assert table == {"1 St": 100, "1 St Unit 2": 100}
    named = reports.stress_by_entity(joined, ["location_name", "sector"], 100).collect()
    assert [(r.location_name, r.total_days) for r in named] == [("Site", 300)]
    want = sum(float(i % 50) * 2 for i in range(300)) / 300
    assert named[0].avg_occupancy_rate == pytest.approx(want, abs=0.05)


def test_sums_keep_the_decimals_of_the_values(spark):
    rows = [(date(2023, 1, d), -1.0 - d / 1000, -5.0, 0.24) for d in (1, 2, 3)]
    df = spark.createDataFrame(rows, "weather_date date, temp_mean_c double, temp_min_c double, snow_total_cm double")
    df = df.withColumn("is_cold_day", F.lit(True)).withColumn("is_extreme_cold", F.lit(False))
    got = marts.weather_monthly(df).first()
    assert (got.total_snow_cm, got.avg_temp_c) == (0.72, -1.0)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables not present")
def test_a_build_stops_before_its_marts_when_a_data_test_fails(spark, tmp_path):
    from daybook.plans import bindings, catalog, models

    inputs = bindings.Inputs(spark, "/root/testdata/sf0.001")
    with pytest.raises(RuntimeError, match="data tests failed"):
        models.build(spark, catalog.raw_sources(inputs), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["staging"]


def test_top_and_map(spark):
    stress = spark.createDataFrame(
        [("A", "MEN", 96.0, 10.0, 125.0, 3, 40, 7.5, "Org", "1 St", "m5v 1a1"), ("B", None, None, None, None, 0, 40, 0.0, "Org", "2 St", "Z9Z"),
         ("C", "MEN", 96.0, 10.0, 0.0, 3, 40, 7.5, "Org", "3 St", None)],
        "location_name string, sector string, avg_occupancy_rate double, avg_daily_occupied double, avg_capacity double, days_full long, "
        "total_days long, pct_days_full double, organization_name string, location_address string, location_postal_code string",
    )
    assert [r.location_name for r in reports.top_stressed(stress, "location_name", "sector", 2).collect()] == ["A", "C"]
    rows = {r.name: r for r in reports.map_rows(stress, lookups.postal_areas(spark)).collect()}
    assert (rows["A"].lat, rows["A"].lon, rows["A"].band, rows["A"].radius) == (43.643, -79.396, "Effectively full", 11.0)
    assert (rows["B"].lat, rows["B"].sector, rows["B"].occ_rate, rows["B"].radius) == (43.6532, "OTHER", 0.0, 7.0)
    assert rows["C"].lon == -79.3832
    assert reports.only_sector(reports.map_rows(stress, lookups.postal_areas(spark)), "MEN").count() == 2
    kpi = reports.system_kpi(stress).first()
    assert (kpi.n_entities, kpi.n_full, kpi.avg_of_averages) == (3, 2, 96.0)


def test_data_tests_ignore_nulls_where_they_should(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), (None, None), (None, None)], "c string, k int")
    rules = quality.Rules(("c",), ("k",), {"c": ("a",)})
    got = {(r.test, r.column_name): (r.n_failures, r.passed) for r in quality.check("t", df, rules).collect()}
    assert got == {("not_null", "c"): (2, False), ("accepted_values", "c"): (1, False), ("unique", "k"): (1, False)}
    with pytest.raises(RuntimeError, match="t.c not_null: 2"):
        quality.require_passed(quality.check("t", df, rules))


def test_rule_count_and_gates(spark):
    n = sum(len(r.not_null) + len(r.unique) + len(r.accepted) for r in quality.STAGING_RULES.values())
    assert n == 18
    empty = spark.createDataFrame([], "a int")
    with pytest.raises(RuntimeError):
        quality.require_rows(empty, "nothing")
    quality.require_empty(empty, "bad rows")
    with pytest.raises(RuntimeError):
        quality.require_empty(spark.range(2), "bad rows")


def test_rejects_count_only_lost_text(spark):
    df = spark.createDataFrame([("1",), ("",), (" ",), ("M",), (None,)], "x string")
    row = quality.rejects(df, {"x": ("x", F.col("x").try_cast("int"))}).first()
    assert (row.n_rejected, row.n_rows) == (1, 5)


def test_dedupe_of_packed_rows_is_the_dedupe_of_rows(spark):
    texts = ["", None, "a", "\x1f", "\x10", "\x10e", "\x10s", "\x10n", "a\x1f", "\x1fa", "\x10\x1f", "é 中", " "]
    rows = [(i, "21-03-01", a, b, k) for i, (a, b, k) in enumerate([(a, b, k) for a in texts for b in texts for k in (1, None)] * 2)]
    raw = spark.createDataFrame(rows, "_id long, OCCUPANCY_DATE string, `A b` string, B string, k int")
    got = staging.repair_current(raw)
    want = staging.repaired(raw).distinct()
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {r.n for r in staging.copies(staging.repaired(raw)).collect()} == {2}
    # The shuffle moves the texts in one column, and the rest apart.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(OCCUPANCY_DATE" in plan and "_row#" in plan.split("hashpartitioning(")[1].split(")")[0]
    many = raw.select("_id", "OCCUPANCY_DATE", *[F.col("B").alias(f"c{i}") for i in range(70)])
    assert sorted(map(str, staging.repair_current(many).collect())) == sorted(map(str, staging.repaired(many).distinct().collect()))


def test_a_mart_is_written_without_sorting_its_years(spark, tmp_path, monkeypatch):
    setting, seen = "spark.sql.maxConcurrentOutputFileWriters", []
    days = spark.range(400).select((F.col("id") % 20 + 2000).cast("int").alias("year_number"), F.col("id").alias("x"))
    writer = type(days.write)
    plain = writer.parquet
    monkeypatch.setattr(writer, "parquet", lambda w, *a, **k: (seen.append(int(spark.conf.get(setting))), plain(w, *a, **k))[1])
    before = spark.conf.get(setting)
    assert sinks.save_mart(days, f"{tmp_path}/mart") == 400  # more years than a task has open
    # Spark adds no sort by the partition column where a task may have several files open.
    assert seen and min(seen) > 0 and spark.conf.get(setting) == before
    back = spark.read.parquet(f"{tmp_path}/mart")
    assert sorted((r.x, r.year_number) for r in back.collect()) == [(i, i % 20 + 2000) for i in range(400)]
