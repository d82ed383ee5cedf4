import os
import subprocess
import sys
from datetime import date

import numpy as np
import pytest

from daybook.operators import regression, series


def test_ols_equals_least_squares(spark):
    rng = np.random.default_rng(3)
    n, x = 80, rng.normal(size=(80, 3))
    y = 2 + x @ [1.5, -0.5, 0.0] + rng.normal(0, 0.3, n)
    rows = [("A", float(i), *map(float, x[i]), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "series string, ts double, a double, b double, c double, y double")
    xs = ["a", "b", "c"]
    fits = regression.fit(df, ["series"], "y", xs)
    design = np.column_stack([np.ones(n), x])
    beta, ssr = np.linalg.lstsq(design, y, rcond=None)[:2]
    cov = np.linalg.inv(design.T @ design) * ssr[0] / (n - 4)
    got = {r.term: r for r in regression.coefficients(fits, ["series"]).collect()}
    assert [got[t].coef for t in ("Intercept", *xs)] == pytest.approx(beta)
    assert [got[t].std_err for t in ("Intercept", *xs)] == pytest.approx(np.sqrt(np.diag(cov)))
    assert got["a"].stars == "***" and got["a"].ci_low < 1.5 < got["a"].ci_high
    stats = regression.fit_statistics(fits, ["series"]).first()
    assert stats.r2 == pytest.approx(1 - ssr[0] / np.sum((y - y.mean()) ** 2))
    assert stats.log_lik == pytest.approx(-n / 2 * (np.log(2 * np.pi * ssr[0] / n) + 1))
    vifs = {r.term: r.vif for r in regression.vif(fits, ["series"]).collect()}
    other = np.column_stack([np.ones(n), x[:, 1:]])
    rest = x[:, 0] - other @ np.linalg.lstsq(other, x[:, 0], rcond=None)[0]
    assert vifs["a"] == pytest.approx(np.sum((x[:, 0] - x[:, 0].mean()) ** 2) / np.sum(rest**2))
    residuals = regression.predict(df, fits, ["series"], "y", xs)
    e = np.array([r.residual for r in residuals.orderBy("ts").collect()])
    assert e == pytest.approx(y - design @ beta)
    assert design.T @ e == pytest.approx(np.zeros(4), abs=1e-8)
    diag = regression.residual_diagnostics(residuals, ["series"], "ts").first()
    assert diag.durbin_watson == pytest.approx(np.sum(np.diff(e) ** 2) / np.sum(e**2))
    scaled = regression.effects(regression.coefficients(fits, ["series"]), {"a": ("per ten", 10)}).first()
    assert scaled.amount == pytest.approx(10 * beta[1])


def test_series_that_cannot_be_fitted_keep_a_row_with_the_reason(spark):
    rows = [("dependent", float(i), 2.0 * i, float(i % 5)) for i in range(20)]
    rows += [("constant x", float(i), 7.0, float(i % 5)) for i in range(20)]
    rows += [("short", float(i), float(i * i), 1.0 + i) for i in range(3)]
    rows += [("flat", float(i), float(i * i), 4.0) for i in range(20)]
    rows += [("fine", float(i), float(i * i), float(i % 5)) for i in range(20)]
    df = spark.createDataFrame(rows, "series string, a double, b double, y double")
    fits = regression.fit(df, ["series"], "y", ["a", "b"])
    got = {r.series: r.reason for r in regression.fit_statistics(fits, ["series"]).collect()}
    assert got == {
        "dependent": "dependent predictors", "constant x": "dependent predictors", "short": "too few rows",
        "flat": "constant target", "fine": None,
    }
    coefs = regression.coefficients(fits, ["series"]).filter("coef IS NULL").groupBy("series").count()
    assert {r.series: r["count"] for r in coefs.collect()} == {k: 3 for k in got if got[k]}


def test_python_tasks_find_the_package_from_any_folder(tmp_path):
    """A session of its own in another folder, without the repository on the path of its workers."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "import __spark_entry__ as e\n"
        "from daybook.session import get_session\n"
        "spark = get_session('local[2]', **{'spark.sql.shuffle.partitions': '2'})\n"
        "from daybook.operators import regression\n"
        "rows = [('A', float(i), float(i % 7), float(i * i)) for i in range(30)]\n"
        "df = spark.createDataFrame(rows, 'series string, a double, b double, y double')\n"
        "print('FITTED', regression.fit(df, ['series'], 'y', ['a', 'b']).count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "FITTED 1" in out.stdout, out.stderr[-2000:]


def test_regression_frame_is_positional_and_complete(spark):
    from daybook.sources import calendar

    months = [date(2019 + i // 12, i % 12 + 1, 1) for i in range(24)]
    rows = [("A", m, m.year, None if i == 3 else float(i), float(i), 1.0) for i, m in enumerate(months)]
    df = spark.createDataFrame(rows, "series string, month_start date, year_number int, system_occupancy_rate double, avg_policy_rate double, avg_temp_c double")
    dim = calendar.dim_date(calendar.days(spark, date(2019, 1, 1), date(2020, 12, 31)))
    got = series.regression_frame(df, dim, 2017, 2025, keys=["series"]).orderBy("month_start").collect()
    # the month without a target goes first, so the seventh remaining row has the first lag
    assert (got[0].month_start, got[0].time_trend, got[0].policy_rate_lag) == (date(2019, 8, 1), 6, 0.0)
    assert [r.is_covid for r in got] == [0] * 5 + [1] * 12
