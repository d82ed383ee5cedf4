from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

from daybook.operators import backtest, series

MONDAY = date(2021, 1, 4)


def weeks(spark, values, name="A", skip=()):
    rows = [(name, MONDAY + timedelta(weeks=i), v) for i, v in enumerate(values) if i not in skip]
    return spark.createDataFrame(rows, "series string, ts date, y double")


def listed(df, column, order="ts"):
    return [r[column] for r in df.orderBy(order).collect()]


def test_regularize_fills_the_grid(spark):
    df = weeks(spark, [1.0, 2.0, 3.0, 4.0, 5.0], skip=(1, 2))
    got = series.regularize(df, ["series"], "ts", "week")
    assert listed(got, "ts") == [MONDAY + timedelta(weeks=i) for i in range(5)]
    assert listed(got, "y") == [1.0, None, None, 4.0, 5.0]
    months = spark.createDataFrame([("A", date(2020, 1, 1), 1.0), ("A", date(2020, 4, 1), 2.0)], "series string, ts date, y double")
    assert listed(series.regularize(months, ["series"], "ts", "month"), "ts") == [date(2020, m, 1) for m in (1, 2, 3, 4)]


@pytest.mark.parametrize("values", [
    [None, 1.0, None, None, 4.0, None], [None, None], [2.0], [1.0, None, 2.0, None, None, None, -6.0, None, 5.0],
])
def test_interpolate_matches_pandas(spark, values):
    got = listed(series.interpolate(weeks(spark, values), ["series"], "ts", "y"), "y")
    want = pd.Series(values, dtype=float).interpolate().tolist()
    assert [np.nan if v is None else v for v in got] == pytest.approx(want, nan_ok=True)


def test_series_do_not_leak_into_each_other(spark):
    df = weeks(spark, [1.0, None], "A").union(weeks(spark, [None, 5.0], "B"))
    got = {(r.series, r.ts): r.y for r in series.interpolate(df, ["series"], "ts", "y").collect()}
    assert got[("A", MONDAY + timedelta(weeks=1))] == 1.0 and got[("B", MONDAY)] is None


def test_forward_fill_difference_index_tail(spark):
    df = weeks(spark, [1.0, None, 4.0, None])
    assert listed(series.forward_fill(df, ["series"], "ts", "y"), "y") == [1.0, 1.0, 4.0, 4.0]
    full = weeks(spark, [1.0, 3.0, 2.0])
    assert listed(series.difference(full, ["series"], "ts", "y"), "diff") == [2.0, -1.0]
    assert listed(series.add_index(full, ["series"], "ts"), "idx") == [0, 1, 2]
    assert listed(series.tail(full, ["series"], "ts", 2), "y") == [3.0, 2.0]


def test_lag_is_positional_unless_asked(spark):
    rows = [("A", date(2020, m, 1), float(m)) for m in (1, 2, 4)]
    df = spark.createDataFrame(rows, "series string, ts date, y double")
    assert listed(series.add_lag(df, ["series"], "ts", "y", 1, "p"), "p") == [None, 1.0, 2.0]
    assert listed(series.add_calendar_lag(df, ["series"], "ts", "y", 1, "p"), "p") == [None, 1.0, None]


def test_future_index(spark):
    got = series.future_index(weeks(spark, [1.0, 2.0]), ["series"], "ts", 3, "week")
    assert listed(got, "target", "step") == [MONDAY + timedelta(weeks=w) for w in (2, 3, 4)]


def panel(spark, *levels):
    """Two years of months per level: the value repeats the level, the rate counts the months."""
    rows = [(name, date(2001 + m // 12, m % 12 + 1, 1), level, float(m)) for name, level in levels for m in range(24)]
    return spark.createDataFrame(rows, "series string, ts date, y double, rate double")


@pytest.mark.parametrize("lag, horizon, known", [(1, 1, True), (4, 5, False), (5, 5, True)])
def test_a_lag_must_be_known_when_the_forecast_is_made(spark, lag, horizon, known):
    frame = lambda: backtest.lagged_frame(panel(spark, ("A", 1.0)), ["series"], "ts", "y", "rate", (lag,), horizon)
    if known:
        assert frame().count() == 24 - lag
    else:
        with pytest.raises(ValueError, match=f"{lag} periods"):
            frame()


def test_lagged_rates_stay_in_their_series(spark):
    got = backtest.lagged_frame(panel(spark, ("A", 1.0), ("B", 2.0)), ["series"], "ts", "y", "rate", (2, 7), 2)
    seen = {(r.series, r.lag_months, r.ts): (r.y, r.exog_lag) for r in got.collect()}
    assert len(seen) == 2 * (22 + 17)
    assert seen[("B", 7, date(2001, 8, 1))] == (2.0, 0.0) and seen[("A", 2, date(2002, 12, 1))] == (1.0, 21.0)
    assert ("A", 7, date(2001, 7, 1)) not in seen


def test_interpolation_is_linear_in_the_length_of_a_series(spark):
    n = 40_000
    df = spark.range(n).selectExpr("'A' AS series", "date_add(DATE '1900-01-01', CAST(id AS INT)) AS ts", "IF(id % 1000 = 0, CAST(id AS DOUBLE), NULL) AS y")
    got = series.interpolate(df, ["series"], "ts", "y")
    off = got.filter("abs(y - least(datediff(ts, DATE '1900-01-01'), 39000)) > 1e-6 OR y IS NULL")
    assert off.count() == 0 and got.count() == n


def test_rate_changes_look_at_their_own_series(spark):
    from daybook.operators import staging

    rows = [("A", "2020-01-01", 1.0), ("B", "2020-01-02", 2.0), ("A", "2020-01-03", 1.0), ("B", "2020-01-04", 3.0)]
    got = staging.stage_rates(spark.createDataFrame(rows, "series string, date string, policy_rate double"), ("series",))
    assert {(r.series, r.rate_date.day): r.is_rate_change_day for r in got.collect()} == {("A", 1): None, ("B", 2): None, ("A", 3): False, ("B", 4): True}


def test_a_calendar_spans_its_months_and_refuses_impossible_dates(spark):
    from daybook.sources import calendar

    df = spark.createDataFrame([(date(2031, 1, 30),), (date(2031, 3, 2),)], "d date")
    got = [r.date_day for r in calendar.months_of(df, "d").orderBy("date_day").collect()]
    assert (got[0], got[-1], len(got)) == (date(2031, 1, 1), date(2031, 3, 31), 90)
    assert calendar.days_of(df.limit(0), "d").isEmpty()
    with pytest.raises(Exception, match="a date outside"):
        calendar.days_of(df.union(spark.createDataFrame([(date(213, 1, 1),)], "d date")), "d").collect()


def brute_folds(y, min_train, horizon, step, season):
    out = {}
    for f, end in enumerate(range(min_train, len(y) - horizon + 1, step), 1):
        slope, level = np.polyfit(np.arange(end), y[:end], 1)
        for k in range(1, horizon + 1):
            back = end - season + (k - 1) % season
            out[(f, k)] = (y[end + k - 1], y[end - 1], y[back] if back >= 0 else y[end - 1], level + slope * (end + k - 1))
    return out


@pytest.mark.parametrize("n, min_train, horizon, step, season", [(60, 24, 3, 1, 12), (40, 10, 12, 4, 52), (37, 5, 7, 3, 4), (12, 10, 3, 1, 5)])
def test_folds_equal_a_plain_loop(spark, n, min_train, horizon, step, season):
    rng = np.random.default_rng(n)
    y = np.round(rng.normal(90, 3, n), 2)
    got = backtest.folds(weeks(spark, [float(v) for v in y]), ["series"], "ts", "y", min_train, horizon, step, season, True)
    rows = {(r.fold, r.step): (r.actual, r.naive, r.seasonal_naive, r.drift) for r in got.collect()}
    want = brute_folds(y, min_train, horizon, step, season)
    assert rows.keys() == want.keys()
    for key, values in want.items():
        assert rows[key] == pytest.approx(values, abs=1e-6)
    assert got.filter("target <= origin").isEmpty()


@pytest.mark.parametrize("n, args, folds", [(261, (104, 12, 4), 37), (108, (48, 3, 1), 58), (10, (48, 3, 1), 0)])
def test_fold_counts(spark, n, args, folds):
    got = backtest.folds(weeks(spark, [float(i) for i in range(n)]), ["series"], "ts", "y", *args)
    assert got.select("fold").distinct().count() == folds


def test_error_table_by_hand(spark):
    rows = [
        ("A", date(2023, 11, 1), 10.0, 11.0, 10.5), ("A", date(2023, 12, 1), 10.0, 8.0, 10.5),
        ("A", date(2024, 1, 1), 10.0, 10.0, 9.0),
    ]
    df = spark.createDataFrame(rows, "series string, target date, actual double, naive double, model double")
    table = backtest.error_table(df, ("naive", "model"), date(2024, 1, 1), ["series"])
    got = {r.scope: (r.n_forecasts, r.mae_naive, r.mae_model) for r in table.collect()}
    assert got == {"validation": (2, 1.5, 0.5), "test": (1, 0.0, 1.0), "all": (3, 1.0, 0.667)}
    pct = {r.scope: r.pct for r in backtest.compare_errors(table, "model", {"pct": "naive"}).collect()}
    assert pct == {"validation": pytest.approx(-66.667), "test": None, "all": pytest.approx(-33.3)}


def test_summary_rounds_per_fold_and_uses_population_deviation(spark):
    rows = [("A", 1, 10.0, 10.1234), ("A", 1, 10.0, 10.0), ("A", 2, 20.0, 21.0)]
    df = spark.createDataFrame(rows, "series string, fold int, actual double, naive double")
    metrics = backtest.fold_metrics(df, ("naive",), ["series"])
    got = {r.fold: (r.mae, r.mape) for r in metrics.collect()}
    assert got == {1: (0.062, 0.62), 2: (1.0, 5.0)}
    row = backtest.model_summary(metrics, ["series"]).first()
    assert (row.mean_mae, row.mean_mape, row.n_folds) == (0.531, 2.81, 2)
    assert row.std_mae == pytest.approx(np.std([0.062, 1.0]), abs=5e-4)
    assert backtest.best_model(backtest.model_summary(metrics, ["series"]), ["series"]).first().best_model == "naive"
