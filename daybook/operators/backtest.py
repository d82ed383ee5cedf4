"""Rolling-origin backtests and their scores.

A baseline forecast for a target period is a fixed number of rows back in the
same series, so no training slice is ever materialised: every row looks up
its own origins by ``lag`` for each step of the horizon, all in one window
pass, and then expands into at most ``horizon`` fold rows. One shuffle on the
series keys, O(n * horizon) rows, no self-join.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daybook.functions.metrics import abs_error, pct_change, pct_error
from daybook.functions.numbers import round_to, scaled
from daybook.operators.series import over

BASELINES = ("naive", "seasonal_naive", "drift")


def check_leakage(lag: int, horizon: int) -> None:
    if lag < horizon:
        raise ValueError(f"a lag of {lag} periods is not known yet at a horizon of {horizon}")


def folds(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    y: str,
    min_train: int,
    horizon: int,
    step: int = 1,
    season: int | None = None,
    drift: bool = False,
    models: Mapping[str, Callable[[int], Column]] | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per (series, origin, step) with the actual and the baseline forecasts.

    Origins sit after ``min_train`` rows and then every ``step`` rows, as long
    as the whole horizon is observed. ``naive`` repeats the value at the
    origin, ``seasonal_naive`` the value one season back (the value at the
    origin where history is too short), ``drift`` extends the least-squares
    line through all rows up to the origin (from the second row on). ``models``
    are further forecasts: functions of the step that give a column at the target
    row, looking back as many rows for the origin, over the ``carry`` columns.
    """
    models = models or {}
    w = over(keys, ts)
    size = F.count(F.lit(1)).over(W.partitionBy(*[F.col(k) for k in keys]))
    rows = df.select(*keys, ts, F.col(y).cast("double").alias("_y"), *carry)
    rows = rows.withColumns({"_t": F.row_number().over(w) - 1, "_n": size})
    if drift:
        # running sums in units of 10^-6 are exact, so the line depends on no summation order
        grown = w.rowsBetween(W.unboundedPreceding, 0)
        rows = rows.withColumns(
            {"_sy": F.sum(scaled("_y", 6)).over(grown), "_sty": F.sum(scaled("_y", 6) * F.col("_t")).over(grown)}
        )
        rows = rows.withColumn("_line", F.when(F.col("_t") >= 1, line(F.col("_t") + 1.0)))

    def fold(k: int) -> Column:
        naive = F.lag("_y", k).over(w)
        fields = [F.lit(k).alias("step"), F.lag(ts, k).over(w).alias("origin"), naive.alias("naive")]
        if season:
            back = season * -(-k // season)
            seasonal = F.when(F.col("_t") >= back, F.lag("_y", back).over(w)).otherwise(naive)
            fields.append(seasonal.alias("seasonal_naive"))
        if drift:
            line = F.lag("_line", k).over(w)
            fields.append(((line["a"] + line["b"] * F.col("_t")) / 1e6).alias("drift"))
        fields += [forecast(k).alias(name) for name, forecast in models.items()]
        return F.struct(*fields)

    wide = rows.withColumn("_f", F.array(*[fold(k) for k in range(1, horizon + 1)]))
    long = wide.select(*keys, "_t", "_n", F.col(ts).alias("target"), F.col("_y").alias("actual"), F.explode("_f").alias("_f"))
    end = F.col("_t") - F.col("_f.step") + 1
    valid = (end >= min_train) & (end <= F.col("_n") - horizon) & ((end - min_train) % step == 0)
    names = ["naive", *(["seasonal_naive"] if season else []), *(["drift"] if drift else []), *models]
    return long.filter(valid).select(
        *keys,
        (F.floor((end - min_train) / step) + 1).cast("int").alias("fold"),
        F.col("_f.origin").alias("origin"),
        "target",
        F.col("_f.step").alias("step"),
        "actual",
        *[F.col(f"_f.{m}").alias(m) for m in names],
    )


def line(n: Column) -> Column:
    """Least-squares level and slope over positions 0 to n-1, from the two running sums."""
    st, stt = n * (n - 1) / 2, (n - 1) * n * (2 * n - 1) / 6
    sy, sty = F.col("_sy").cast("double"), F.col("_sty").cast("double")
    slope = (n * sty - st * sy) / (n * stt - st * st)
    return F.struct(slope.alias("b"), ((sy - slope * st) / n).alias("a"))


def lagged_frame(
    df: DataFrame, keys: Sequence[str], ts: str, y: str, exog: str, lags: Sequence[int], horizon: int
) -> DataFrame:
    """Complete rows of (series, lag): target and exogenous value ``lag`` rows back.

    Several lags become an extra key ``lag_months``, so a sensitivity sweep is
    one job; the headline lag is a filter on it.
    """
    for lag in lags:
        check_leakage(lag, horizon)
    w = over(keys, ts)
    shifted = [F.struct(F.lit(k).alias("lag_months"), F.lag(exog, k).over(w).alias("exog_lag")) for k in lags]
    wide = df.select(*keys, ts, y, F.array(*shifted).alias("_v"))
    return wide.select(*keys, ts, y, F.inline("_v")).na.drop()


def error_table(
    fold_rows: DataFrame,
    models: Sequence[str],
    test_start: date | None,
    keys: Sequence[str] = (),
    digits: int = 3,
) -> DataFrame:
    """Mean absolute error per model for the scopes validation, test and all.

    Targets before ``test_start`` are validation. Sums of errors per scope are
    formed first; the ``all`` scope is the sum of the two.
    """
    scope = F.lit("all") if test_start is None else F.when(F.col("target") < F.lit(test_start), "validation").otherwise("test")
    sums = fold_rows.groupBy(*keys, scope.alias("scope")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(scaled(abs_error("actual", m), 6)).alias(f"s_{m}") for m in models],
    )
    if test_start is not None:
        sums = sums.select("*", F.explode(F.array("scope", F.lit("all"))).alias("_scope"))
        sums = sums.groupBy(*keys, F.col("_scope").alias("scope")).agg(
            F.sum("n").alias("n"), *[F.sum(f"s_{m}").alias(f"s_{m}") for m in models]
        )
    unit = float(10 ** (6 - digits))
    mae = [(F.floor(F.col(f"s_{m}") / (F.col("n") * unit) + 0.5) / float(10**digits)).alias(f"mae_{m}") for m in models]
    return sums.select(*keys, "scope", F.col("n").alias("n_forecasts"), *mae)


def compare_errors(table: DataFrame, model: str, bases: dict[str, str], digits: int = 3) -> DataFrame:
    """Percent change of one model's error against others: ``{"pct_vs_naive": "naive"}``."""
    return table.withColumns(
        {name: round_to(pct_change(f"mae_{model}", f"mae_{base}"), digits) for name, base in bases.items()}
    )


def unpivot_models(fold_rows: DataFrame, models: Sequence[str]) -> DataFrame:
    ids = [c for c in fold_rows.columns if c not in models]
    return fold_rows.unpivot(ids, list(models), "model", "forecast")


def fold_metrics(fold_rows: DataFrame, models: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """MAE (3 decimals) and MAPE (2 decimals) of every fold and model."""
    long = unpivot_models(fold_rows, models).filter(F.col("forecast").isNotNull() & F.col("actual").isNotNull())
    n = F.count(F.lit(1))
    mae = F.floor(F.sum(scaled(abs_error("actual", "forecast"), 6)) / (n * 1000.0) + 0.5) / 1000.0
    pct = pct_error("actual", "forecast")
    mape = F.floor(F.sum(scaled(pct, 6)) / (F.count(pct) * 10000.0) + 0.5) / 100.0
    return long.groupBy(*keys, "model", "fold").agg(mae.alias("mae"), mape.alias("mape"))


def model_summary(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Over folds: mean of the rounded errors, population deviation, fold count."""
    n, s = F.count(F.lit(1)), F.sum(scaled("mae", 3))
    ss = F.sum(scaled("mae", 3) * scaled("mae", 3))
    deviation = F.floor(F.sqrt(n * ss - s * s) / n + 0.5) / 1000.0
    return metrics.groupBy(*keys, "model").agg(
        (F.floor(s / n + 0.5) / 1000.0).alias("mean_mae"),
        (F.floor(F.sum(scaled("mape", 2)) / n + 0.5) / 100.0).alias("mean_mape"),
        deviation.alias("std_mae"),
        n.alias("n_folds"),
    )


def best_model(summary: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The model with the smallest mean error; ties go to the first name."""
    best = F.min(F.struct("mean_mae", "model")).alias("_b")
    return summary.groupBy(*keys).agg(best).select(*keys, F.col("_b.model").alias("best_model"), F.col("_b.mean_mae").alias("mean_mae"))


def one_step(fold_rows: DataFrame) -> DataFrame:
    return fold_rows.filter(F.col("step") == 1)


def within(fold_rows: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """Targets in a half-open window."""
    rows = fold_rows
    if start is not None:
        rows = rows.filter(F.col("target") >= F.lit(start))
    if end is not None:
        rows = rows.filter(F.col("target") < F.lit(end))
    return rows


Model = Callable[[np.ndarray, int], np.ndarray]


def outside_forecasts(
    df: DataFrame, keys: Sequence[str], ts: str, y: str, min_train: int, horizon: int, step: int, model: Model, most: int = 40_000
) -> DataFrame:
    """Forecasts of any function of (training values, steps) at the origins of ``folds``: keys, origin, target, forecast.

    A series is one group of Arrow rows in one task, which is why its length is bounded: rolled-up
    series have a row per calendar period, and one of more than ``most`` rows stops the job. The function
    may return fewer steps than asked for; targets behind the last row are left out.
    """
    rows = df.select(*keys, ts, F.col(y).cast("double").alias("_y"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)
    when = rows.schema[ts].dataType.simpleString()

    def forecast(series: pa.Table) -> pa.Table:
        series = series.sort_by(ts)
        n = series.num_rows
        if n > most:
            raise ValueError(f"a series of {n} rows, more than {most}")
        values = series.column("_y").to_numpy()
        origins, targets, found = [], [], []
        for end in range(min_train, n - horizon + 1, step):
            ahead = np.asarray(model(values[:end], horizon), float)[: n - end]
            origins += [end - 1] * len(ahead)
            targets += range(end, end + len(ahead))
            found += ahead.tolist()
        out = {k: pa.array([series.column(k)[0].as_py()] * len(found), series.schema.field(k).type) for k in keys}
        out |= {"origin": series.column(ts).take(pa.array(origins, pa.int64())), "target": series.column(ts).take(pa.array(targets, pa.int64()))}
        return pa.table(out | {"forecast": pa.array(found, pa.float64())})

    return rows.groupBy(*keys).applyInArrow(forecast, f"{kind}, origin {when}, target {when}, forecast double")


def align(fold_rows: DataFrame, forecasts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A forecast table beside the folds, one row per (keys, origin, target) of either.

    ``status`` is ``scored`` where both have it, ``missing`` where the forecast lacks a target, ``extra`` where no
    fold asks for it. Scores belong to the scored rows alone, the intersection.
    """
    on = [*keys, "origin", "target"]
    left = fold_rows.select(*on, "fold", "step", "actual", F.lit(True).alias("_asked"))
    right = forecasts.select(*on, "forecast", F.col("forecast").isNotNull().alias("_given"))
    status = F.when(F.col("_asked").isNull(), "extra").when(F.col("_given"), "scored").otherwise("missing")
    return left.join(right, on, "full").select(*on, "fold", "step", "actual", "forecast", status.alias("status"))
