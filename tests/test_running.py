"""Expanding-window fits, unit-root tests and forecasts past the last row, against dense solves and plain loops."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from daybook.functions.distributions import unit_root_p
from daybook.operators import backtest, running, stationarity


def weeks(spark, **lists):
    rows = [(s, date(2001, 1, 1) + timedelta(days=7 * i), None if v is None else float(v)) for s, values in lists.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series string, ts date, y double").repartition(3)


def months(spark, y, rate, name="A"):
    rows = [(name, date(2015 + i // 12, i % 12 + 1, 1), float(a), float(r)) for i, (a, r) in enumerate(zip(y, rate, strict=True))]
    return spark.createDataFrame(rows, "series string, ts date, y double, rate double")


def test_running_fits_equal_dense_ones_and_skip_what_is_missing(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(0, 2, (40, 3)), 6)
    x[:, 2] = 2 * x[:, 0]  # says nothing new
    y = np.round(x[:, 0] - 3 * x[:, 1] + rng.normal(0, 0.1, 40), 6)
    rows = [("A", i, *map(float, x[i]), None if i % 7 == 3 else float(y[i])) for i in range(40)]
    df = spark.createDataFrame(rows, "series string, ts int, a double, b double, c double, y double")
    got = {r.ts: r.f for r in running.fit_running(df, ["series"], "ts", "y", ["a", "b", "c"], 5, "f").collect()}
    for i in range(40):
        used = [j for j in range(i + 1) if j % 7 != 3]
        if len(used) < 5:
            assert got[i] is None
            continue
        want = np.linalg.lstsq(x[used][:, :2], y[used], rcond=None)[0]
        assert got[i] == pytest.approx([*want, 0.0], abs=1e-6)
    assert running.fit_running(df.limit(0), ["series"], "ts", "y", ["a"], 5, "f").count() == 0


def rate_rows(spark, y, rate, lag=3, horizon=3, train=24, masked=None, order=4):
    frame = backtest.lagged_frame(months(spark, y, rate), ["series"], "ts", "y", "rate", (lag,), horizon)
    keys = ["series", "lag_months"]
    fits = running.rate_fits(frame, keys, "ts", "y", "exog_lag", masked, order)
    return backtest.folds(fits, keys, "ts", "y", train, horizon, models=running.rate_forecasts(keys, "ts"), carry=("x_now", "dx", "fit"))


def test_a_lag_shorter_than_the_horizon_is_rejected_and_targets_lie_ahead(spark):
    y, rate = 95 + np.cumsum(np.random.default_rng(0).normal(0, 0.1, 60)), np.linspace(0.25, 4, 60)
    with pytest.raises(ValueError):
        rate_rows(spark, y, rate, lag=2)
    rows = rate_rows(spark, y, rate, lag=6).collect()
    assert all(r.target > r.origin for r in rows) and {r.step for r in rows} == {1, 2, 3}


def test_forecasts_read_nothing_behind_their_origin(spark):
    rng = np.random.default_rng(2)
    y, rate = np.round(90 + rng.normal(0, 1, 60).cumsum(), 3), np.round(rng.normal(2, 1, 60).cumsum(), 3)
    changed = np.concatenate([y[:45], y[45:] + 50])
    one, two = ({(r.origin, r.step): r for r in rate_rows(spark, v, rate).collect()} for v in (y, changed))
    cut = date(2015 + 44 // 12, 44 % 12 + 1, 1)
    early = [k for k in one if k[0] <= cut]
    assert early and all(one[k][m] == two[k][m] for k in early for m in ("rate_lag", "arma", "arma_rate"))
    assert any(one[k].arma != two[k].arma for k in one if k[0] > cut)


def test_the_lag_that_made_the_series_forecasts_it_best(spark):
    rng = np.random.default_rng(3)
    rate = np.round(rng.normal(0, 1, 110).cumsum(), 4)
    y = 80 + np.array([0.0] * 6 + [2.5 * rate[i - 6] for i in range(6, 110)]) + rng.normal(0, 0.05, 110).cumsum()
    errors = {}
    for lag in (3, 6, 9):
        table = backtest.error_table(rate_rows(spark, np.round(y, 4), rate, lag=lag), ("naive", "rate_lag", "arma_rate"), None)
        errors[lag] = table.first()
    assert errors[6].mae_rate_lag < 0.2 * errors[6].mae_naive and errors[6].mae_arma_rate < 0.3 * errors[6].mae_naive
    assert errors[6].mae_rate_lag < 0.5 * min(errors[3].mae_rate_lag, errors[9].mae_rate_lag)


def plain_arma(y, order=4):
    """Step by step with dense least squares: coefficients and state at every row."""
    d = [None, *np.diff(y)]
    e, coefs, out = [None] * len(y), None, []
    for t in range(len(y)):
        before = [d[t - j] if t - j > 0 else None for j in range(1, order + 1)]
        if coefs is not None and None not in before:
            e[t] = d[t] - float(np.dot(coefs, before))
        done = [s for s in range(order + 1, t + 1)]
        if len(done) >= 2 * order + 2:
            coefs = np.linalg.lstsq(np.array([[d[s - j] for j in range(1, order + 1)] for s in done]), np.array([d[s] for s in done]), rcond=None)[0]
        done = [s for s in range(2, t + 1) if e[s - 1] is not None]
        arma = np.linalg.lstsq(np.array([[d[s - 1], e[s - 1]] for s in done]), np.array([d[s] for s in done]), rcond=None)[0] if len(done) >= 8 else None
        out.append((arma, d[t], e[t]))
    return out


def test_lagged_surprises_equal_a_plain_loop_and_find_the_coefficients(spark):
    rng = np.random.default_rng(4)
    shocks, d = rng.normal(0, 1, 3000), [0.0]
    for i in range(1, 3000):
        d.append(0.6 * d[-1] + shocks[i] + 0.3 * shocks[i - 1])
    y = np.round(100 + np.cumsum(d), 6)
    rows = weeks(spark, A=y).withColumn("dy", F.col("y") - F.lag("y").over(running.over(["series"], "ts")))
    rows = running.fit_running(running.with_surprises(rows, ["series"], "ts", 4), ["series"], "ts", "dy", ["_d1", "_e1"], 8, "arma")
    got = [r for r in rows.orderBy("ts").collect()]
    assert got[-1].arma == pytest.approx([0.6, 0.3], abs=0.06)
    for t, (arma, _, e) in enumerate(plain_arma(y[:60])):
        assert got[t].arma == (None if arma is None else pytest.approx(list(arma), abs=1e-4))
        assert got[t]._e == (None if e is None else pytest.approx(e, abs=1e-4))


def test_masked_targets_are_in_no_fit(spark):
    rng = np.random.default_rng(5)
    y, rate = np.round(90 + rng.normal(0, 1, 60).cumsum(), 3), np.round(rng.normal(2, 1, 60).cumsum(), 3)
    shaken = y.copy()
    shaken[20:24] += 30
    masked = F.col("ts").between(F.lit(date(2016, 9, 1)), F.lit(date(2016, 12, 1)))
    one, two = ({(r.origin, r.step): r for r in rate_rows(spark, v, rate, masked=masked).collect()} for v in (y, shaken))
    assert all(one[k][m] == two[k][m] for k in one for m in ("rate_lag", "arma", "arma_rate"))


def test_trend_and_season_recover_what_was_planted(spark):
    t = np.arange(300)
    wave = 4 * np.sin(2 * np.pi * t / 52.1775)
    y = 70 + 3 * t / 52.1775 - 9 * np.maximum(t - 156, 0) / 52.1775 + wave
    fits = running.season_fits(weeks(spark, A=np.round(y, 6)), ["series"], "ts", "y", 300, penalty=0.001)
    last = fits.orderBy(F.desc("ts")).first().season_fit
    names = list(running.season_columns(300, 52.1775, 2, 52, F.lit(0)))
    found = dict(zip(names, last, strict=True))
    assert found["_s1"] == pytest.approx(4, abs=0.05) and found["_t"] == pytest.approx(3, abs=0.1) and found["_h2"] == pytest.approx(-9, abs=0.2)
    trend = lambda k: running.season_forecast(F.lag("season_fit", k).over(running.over(["series"], "ts")), F.col("pos"), 300)
    rows = backtest.folds(fits, ["series"], "ts", "y", 220, 12, 4, season=52, models={"trend_season": trend}, carry=("pos", "season_fit"))
    table = backtest.error_table(rows, ("seasonal_naive", "trend_season"), None).first()
    assert table.mae_trend_season < 0.1 < table.mae_seasonal_naive


def test_forecasts_past_the_last_row_equal_a_plain_loop(spark):
    rng = np.random.default_rng(6)
    y = np.round(90 + rng.normal(0, 1, 150).cumsum(), 4)
    got = running.ahead(weeks(spark, A=y, B=[5.0, 7.0], C=[3.0]), ["series"], "ts", "y", 12, "week", 52, 156).collect()
    rows = {(r.series, r.step): r for r in got}
    assert len(rows) == 36
    arma, step, surprise = plain_arma(y)[-1]
    level, step = y[-1], arma[0] * step + arma[1] * surprise
    slope, base = np.polyfit(np.arange(150), y, 1)
    for k in range(1, 13):
        level += step
        step *= arma[0]
        r = rows["A", k]
        assert r.target == r.origin + timedelta(days=7 * k) and r.naive == y[-1] and r.seasonal_naive == y[150 - 52 + k - 1]
        assert (r.arma, r.drift) == (pytest.approx(level, abs=1e-3), pytest.approx(base + slope * (149 + k), abs=1e-5))
        assert (rows["B", k].drift, rows["B", k].arma, rows["B", k].seasonal_naive) == (pytest.approx(7 + 2 * k), 7.0, 7.0)
        assert (rows["C", k].drift, rows["C", k].trend_season) == (3.0, 3.0)


def dense_unit_root(y, most):
    d = np.diff(y)

    def fit(lags, trim):
        at = range(trim, len(d))
        x = np.array([[1.0, y[i], *[d[i - j] for j in range(1, lags + 1)]] for i in at])
        z = d[trim:]
        coef, *_ = np.linalg.lstsq(x, z, rcond=None)
        error = z - x @ coef
        spread = np.linalg.inv(x.T @ x) * (error @ error) / (len(z) - x.shape[1])
        return len(z), len(z) * math.log(error @ error / len(z)) + 2 * x.shape[1], coef[1] / math.sqrt(spread[1, 1])

    best = min(range(most + 1), key=lambda p: fit(p, most)[1])
    n, _, t = fit(best, best)
    return best, n, t


@pytest.mark.parametrize("max_lag", [None, 0, 3])
def test_unit_root_statistics_equal_dense_least_squares(spark, max_lag):
    rng = np.random.default_rng(7)
    noise = rng.normal(0, 1, 200)
    lists = {"walk": noise.cumsum(), "still": noise, "echo": np.convolve(rng.normal(0, 1, 90), [1, 0.8, -0.5, 0.4], "valid").cumsum(), "short": noise[:30].cumsum()}
    flat = {"flat": [2.0] * 30, "tiny": [1.0, 2.0]}
    got = {r.series: r for r in stationarity.unit_root(weeks(spark, **lists, **flat), ["series"], "ts", "y", max_lag).collect()}
    for name, y in lists.items():
        most = stationarity.default_lags(len(y)) if max_lag is None else min(max_lag, stationarity.default_lags(len(y)))
        lags, n, t = dense_unit_root(np.array(y), most)
        assert (got[name].lags, got[name].n) == (lags, n)
        assert got[name].statistic == pytest.approx(t, abs=1e-6) and got[name].p_value == pytest.approx(unit_root_p(t), abs=1e-9)
    assert got["still"].stationary and not got["walk"].stationary
    assert got["flat"].statistic is None and got["tiny"].statistic is None and len(got) == 6
