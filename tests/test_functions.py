import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from daybook.functions import dates, distributions, metrics, text
from daybook.functions.numbers import exact_mean, exact_sum, lenient_double, lenient_int, round_to, scaled


def test_lenient_int_rounds_and_rejects(column):
    values = ["12", "12.6", "2.5", "-2.5", "1e2", "", "M", "1,200", " 7 ", None, "3d", "4f", "99999999999"]
    assert column(values, lenient_int("x")) == [12, 13, 3, -3, 100, None, None, None, 7, None, None, None, None]


def test_lenient_double(column):
    assert column(["-3.5", ".5", "5.", "M", "NaN", "1e-2", "+4"], lenient_double("x")) == [-3.5, 0.5, 5.0, None, None, 0.01, 4.0]


def test_round_to_uses_the_binary_value(column):
    got = column([1.005, 2.675, 0.125, 2.5, -2.5, -0.001, None], round_to("x", 2), "double")
    assert got == [1.0, 2.68, 0.13, 2.5, -2.5, 0.0, None]
    assert math.copysign(1, got[5]) == 1.0
    assert column([-2.5, 2.5, 0.4], round_to("x", 0), "double") == [-3.0, 3.0, 0.0]


def test_exact_sums_do_not_depend_on_order(spark):
    values = [0.1, 0.2, 0.3, 1e6, -0.05] * 200
    totals = set()
    for parts in (1, 3, 7):
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(parts)
        totals.add(df.agg(exact_sum("x", 2)).first()[0])
    assert totals == {sum(round(v * 100) for v in values) / 100}
    assert [r[0] for r in spark.createDataFrame([(-0.05,)], "x double").select(scaled("x", 2)).collect()] == [-5]


def test_exact_mean_sees_an_exact_half(spark):
    df = spark.createDataFrame([(1.0,), (1.01,)], "x double")
    assert df.agg(exact_mean("x", 2, 2)).first()[0] == 1.01
    assert spark.createDataFrame([(-1.0,), (-1.01,)], "x double").agg(exact_mean("x", 2, 2)).first()[0] == -1.01


def test_mixed_dates(column):
    values = ["2017-01-01T00:00:00", "01/31/2020", "1/5/2020", "2018-02-03", "13/45/2020", "junk", None]
    assert column(values, dates.mixed_date("x")) == [
        date(2017, 1, 1), date(2020, 1, 31), date(2020, 1, 5), date(2018, 2, 3), None, None, None,
    ]


def test_short_year_repair_then_cast(column):
    values = ["21-01-15T00:00:00", "22-06-30", "2023-05-01T00:00:00", " 21-02-03 ", None]
    assert column(values, dates.repair_short_year("x")) == ["2021-01-15", "2022-06-30", "2023-05-01T00:00:00", "2021-02-03", None]
    # without the repair a two-digit year must not become year 21
    assert column(["21-01-15"], dates.iso_date("x")) == [None]


def test_calendar_parts(column):
    sunday, friday = date(2023, 1, 1), date(2023, 12, 1)
    assert column([sunday, friday], dates.day_of_week("x"), "date") == [0, 5]
    assert column([sunday, date(2023, 3, 31), date(2023, 8, 1), friday], dates.season("x"), "date") == ["Winter", "Spring", "Summer", "Winter"]
    assert column([sunday], dates.week_start("x"), "date") == [date(2022, 12, 26)]
    assert column(["Fall", "Winter"], dates.season_rank("x")) == [4, 1]
    assert column([date(2023, 3, 31), date(2023, 4, 1)], dates.fiscal_year("x", 4), "date") == [2023, 2024]
    assert column([date(2022, 12, 31), sunday], dates.between_years("x", 2023, 2023), "date") == [False, True]


def test_text_helpers(column):
    assert column([" Men ", "mixed adult", None], text.category("x")) == ["MEN", "MIXED ADULT", None]
    assert column(["MIXED ADULT", "men"], text.capitalize("x")) == ["Mixed adult", "Men"]
    assert column(["House"], text.entity_label("x", F.lit("CO-ED"))) == ["House (Co-ed)"]
    assert column([" m5v 1a1"], text.postal_prefix("x")) == ["m5v"]
    assert column(['{"k": 7}', "{}", None], text.json_field("x", "k", "int")) == [7, None, None]


def test_surrogate_key_marks_nulls(column):
    import hashlib

    want = hashlib.md5(b"a-_dbt_utils_surrogate_key_null_").hexdigest()
    assert column(["a"], text.surrogate_key("x", F.lit(None).cast("string"))) == [want]
    a, b = column(["a", None], text.surrogate_key("x", F.lit("b")))
    assert a != b


def test_bands_and_marks(column):
    assert column([98.0, 95.0, 85.0, 84.9, None], metrics.stress_band("x"), "double") == [
        "Critical", "Effectively full", "High", "Moderate", "Moderate",
    ]
    assert column([None, 0.0, 0.1, 125.0, 1e6], metrics.bubble_radius("x"), "double") == [7.0, 7.0, pytest.approx(6 + math.sqrt(0.02)), 11.0, 22.0]
    assert column([1.9, 2.0, 3.0, None], metrics.vacancy_band("x"), "double") == ["tight", "balanced", "renter choice", None]
    assert column([0.0005, 0.005, 0.04, 0.06], metrics.stars("x"), "double") == ["***", "**", "*", ""]


def test_flags_are_three_valued(column):
    assert column([95.0, 94.99, None], metrics.at_least("x"), "double") == [True, False, None]
    assert column([10.0, 0.0, None], metrics.guarded_rate(F.lit(5), "x"), "double") == [50.0, None, None]


def test_ratio_of_sums_with_and_without_missing_capacity(spark):
    df = spark.createDataFrame([(10, 10), (5, None), (3, 0)], "a int, b int")
    row = df.agg(metrics.ratio_of_sums("a", "b").alias("loose"), metrics.ratio_of_sums("a", "b", True).alias("strict")).first()
    assert (row.loose, row.strict) == (180.0, 100.0)
    assert spark.createDataFrame([(1, 0)], "a int, b int").agg(metrics.ratio_of_sums("a", "b")).first()[0] is None


def test_percent_change(column):
    assert column([1.1, 0.9], metrics.pct_change("x", F.lit(1.0)), "double") == [pytest.approx(10.0), pytest.approx(-10.0)]
    assert column([1.0], metrics.pct_change("x", F.lit(0.0)), "double") == [None]


def test_tail_probabilities():
    assert distributions.t_quantile(0.975, 57) == pytest.approx(2.00247, abs=1e-5)
    assert distributions.t_two_sided(2.0, 1e7) == pytest.approx(0.0455003, abs=1e-5)
    assert distributions.t_two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-12)
    assert distributions.f_upper(4.0, 1, 10) == pytest.approx(distributions.t_two_sided(2.0, 10), abs=1e-12)
    # published 5% and 1% points of the unit-root statistic with a constant
    assert distributions.unit_root_p(-2.8615) == pytest.approx(0.05, abs=0.002)
    assert distributions.unit_root_p(-3.4304) == pytest.approx(0.01, abs=0.001)
    assert (distributions.unit_root_p(3.0), distributions.unit_root_p(-20.0)) == (1.0, 0.0)
