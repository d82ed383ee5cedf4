"""Expanding-window least squares and the forecasts that come from it.

A rolling-origin backtest fits a model again at every origin, on all rows so far.
The fits share their sums: a running total of X'X and X'y, one window pass over a
series, holds what every origin's fit needs, and each row is then solved on its
own. Nothing is fitted row by row over its history, so a backtest costs the same
as a single fit of the last origin.

Sums run in units of 10^-6 as 38-digit decimals: exact, so neither the order of
rows nor a retried task changes a coefficient. Rows with a missing target or
predictor are left out of the sums; a row's coefficients are NULL until ``least``
complete rows stand behind it. A predictor that the earlier ones determine gets
the coefficient 0.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from daybook.functions.numbers import scaled
from daybook.operators.backtest import line
from daybook.operators.series import over

DIGITS = 6
#: A pivot below this part of its own first value counts as nothing.
TOLERANCE = 1e-9


def sweep(matrices: np.ndarray, k: int, left: list[np.ndarray] | None = None) -> np.ndarray:
    """Gauss-Jordan elimination of the first ``k`` columns of many matrices at once.

    The rest of a row becomes what the pivots explain of it; a pivot that earlier
    ones determine is skipped, and its row becomes zero. ``left`` gets, pivot by
    pivot, what remains at row and column ``k``: the target's unexplained sum of squares.
    """
    m = np.array(matrices, float)
    first = np.einsum("nii->ni", m[:, :k, :k]).copy()
    for p in range(k):
        pivot = m[:, p, p]
        sound = pivot > TOLERANCE * first[:, p]
        row = m[:, p, :] * np.divide(1.0, pivot, out=np.zeros_like(pivot), where=sound)[:, None]
        m -= m[:, :, p][:, :, None] * row[:, None, :]
        m[:, p, :] = row
        if left is not None:
            left.append(m[:, k, k].copy())
    return m


def _solve(lower: np.ndarray, k: int, ridge: np.ndarray) -> np.ndarray:
    """Coefficients from lower triangles of the moments of k predictors and the target."""
    full = np.zeros((len(lower), k + 1, k + 1))
    i, j = np.tril_indices(k + 1)
    full[:, i, j] = lower
    full[:, j, i] = lower
    full[:, range(k), range(k)] += ridge
    return sweep(full, k)[:, :k, k]


def fit_running(df: DataFrame, keys: Sequence[str], ts: str, y: str, xs: Sequence[str], least: int, name: str, ridge: Sequence[float] | None = None) -> DataFrame:
    """``df`` with ``name``: the coefficients (no constant but one among ``xs``) of all rows up to each row.

    ``ridge`` adds a penalty to each predictor's sum of squares.
    """
    names = [*xs, y]
    complete = functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in names])
    grown = over(keys, ts).rowsBetween(W.unboundedPreceding, 0)
    # Long-scaled values first, so that every product is of two whole numbers.
    units = df.withColumns({f"_u{i}": F.when(complete, scaled(c, DIGITS)).cast("decimal(19,0)") for i, c in enumerate(names)})
    cells = [F.sum(F.col(f"_u{i}") * F.col(f"_u{j}")).over(grown).cast("double") / 10.0 ** (2 * DIGITS) for i in range(len(names)) for j in range(i + 1)]
    sums = units.select(*df.columns, F.count("_u0").over(grown).alias("_n"), F.array(*cells).alias("_m"))
    k, penalty = len(xs), np.array(ridge if ridge is not None else [0.0] * len(xs))
    schema = StructType([*df.schema.fields, StructField(name, ArrayType(DoubleType()))])
    kept = df.columns

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ready = batch.column("_n").to_numpy(zero_copy_only=False) >= max(least, 1)
            moments = batch.column("_m").filter(pa.array(ready)).flatten().to_numpy(zero_copy_only=False).reshape(-1, (k + 1) * (k + 2) // 2)
            found = iter(_solve(moments, k, penalty).tolist())
            coefs = pa.array([next(found) if r else None for r in ready], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], coefs], [*kept, name])

    return sums.mapInArrow(solve, schema)


def _dot(coefs: Column, xs: Sequence[Column]) -> Column:
    return functools.reduce(lambda a, b: a + b, [coefs[i] * x for i, x in enumerate(xs)])


def slope_running(dx: str, dy: str, grown) -> Column:
    """The coefficient of a regression through the origin, 0 where the predictor never moved."""
    both = F.col(dx).isNotNull() & F.col(dy).isNotNull()
    x, z = (F.when(both, scaled(c, DIGITS)).cast("decimal(19,0)") for c in (dx, dy))
    top, below = F.sum(x * z).over(grown).cast("double"), F.sum(x * x).over(grown).cast("double")
    return F.when(below > 0, top / below).otherwise(0.0)


def with_surprises(rows: DataFrame, keys: Sequence[str], ts: str, order: int) -> DataFrame:
    """Steps ``dy`` with the step before (``_d1``) and what it brought unforeseen (``_e``, and ``_e1`` before).

    A surprise is what a long autoregression, fitted on the rows before, doesn't foresee (Hannan-Rissanen's first stage).
    """
    w = over(keys, ts)
    before = [f"_d{j}" for j in range(1, order + 1)]
    rows = rows.withColumns({c: F.lag("dy", j).over(w) for j, c in enumerate(before, 1)})
    rows = fit_running(rows, keys, ts, "dy", before, 2 * order + 2, "_long")
    foreseen = _dot(F.lag("_long").over(w), [F.col(c) for c in before])
    rows = rows.withColumn("_e", F.col("dy") - foreseen)
    return rows.withColumn("_e1", F.lag("_e").over(w)).drop("_long", *before[1:])


def rate_fits(frame: DataFrame, keys: Sequence[str], ts: str, y: str, x: str, masked: Column | None = None, order: int = 4) -> DataFrame:
    """``frame`` with what the forecasts from each row need: a struct ``fit`` and the step ``dx`` of ``x``.

    The target is differenced once. ``masked`` rows have no target for any fit.

    * ``rate``: the target's step is a multiple of the predictor's.
    * ``arma``: the step follows from the step before and the last surprise (Hannan-Rissanen's
      second stage; the first one looks ``order`` steps back).
    * ``arma_rate``: the same with the predictor's step.
    """
    w = over(keys, ts)
    grown = w.rowsBetween(W.unboundedPreceding, 0)
    target = F.col(y).cast("double") if masked is None else F.when(~masked, F.col(y).cast("double"))
    rows = frame.withColumns({"_y": target, "_x": F.col(x).cast("double")})
    rows = rows.withColumns({"dy": F.col("_y") - F.lag("_y").over(w), "dx": F.col("_x") - F.lag("_x").over(w)})
    known = F.when(F.col("_y").isNotNull(), F.struct(F.col("_y").alias("y"), F.col("_x").alias("x")))
    rows = rows.withColumns({"_last": F.last(known, True).over(grown), "_beta": slope_running("dx", "dy", grown)})
    rows = with_surprises(rows, keys, ts, order)
    rows = fit_running(rows, keys, ts, "dy", ["_d1", "_e1"], 8, "_arma")
    rows = fit_running(rows, keys, ts, "dy", ["_d1", "_e1", "dx"], 10, "_armax")
    fit = F.struct(
        F.col("_last.y").alias("y"),
        F.col("_last.x").alias("x"),
        F.col("_beta").alias("beta"),
        F.coalesce("dy", F.lit(0.0)).alias("dy"),
        F.coalesce("_e", F.lit(0.0)).alias("e"),
        F.col("_arma").alias("arma"),
        F.col("_armax").alias("armax"),
    )
    return rows.select(*frame.columns, F.col("_x").alias("x_now"), "dx", fit.alias("fit"))


def rate_forecasts(keys: Sequence[str], ts: str) -> dict[str, Callable[[int], Column]]:
    """Forecasts at a target row, ``k`` rows after its origin, for ``backtest.folds`` over ``rate_fits``."""
    w = over(keys, ts)

    def origin(k: int) -> Column:
        return F.lag("fit", k).over(w)

    def steps(k: int, coefs: Column, move: bool) -> Column:
        at = origin(k)
        step, total = coefs[0] * at["dy"] + coefs[1] * at["e"], F.lit(0.0)
        for j in range(1, k + 1):
            if j > 1:
                step = coefs[0] * step
            if move:
                # the predictor's step is known ahead, as its lag is no shorter than the horizon
                step = step + coefs[2] * F.coalesce(F.lag("dx", k - j).over(w) if k > j else F.col("dx"), F.lit(0.0))
            total = total + step
        return F.coalesce(at["y"] + total, at["y"])

    return {
        "rate_lag": lambda k: F.coalesce(origin(k)["y"] + origin(k)["beta"] * (F.col("x_now") - origin(k)["x"]), origin(k)["y"]),
        "arma": lambda k: steps(k, origin(k)["arma"], False),
        "arma_rate": lambda k: steps(k, origin(k)["armax"], True),
    }


# --- trend and season


def season_columns(length: int, period: float, waves: int, every: int, t: Column) -> dict[str, Column]:
    """Constant, trend, hinges every ``every`` rows and ``waves`` pairs of waves of a period, at position ``t``.

    The trend and the hinges count in periods, so that all columns are of similar size.
    """
    out = {"_c": F.lit(1.0), "_t": t / period}
    for i, at in enumerate(range(every, length, every)):
        out[f"_h{i}"] = F.greatest(t - at, F.lit(0)) / period
    for n in range(1, waves + 1):
        angle = t * (2.0 * np.pi * n / period)
        out |= {f"_s{n}": F.sin(angle), f"_k{n}": F.cos(angle)}
    return out


def season_fits(df: DataFrame, keys: Sequence[str], ts: str, y: str, length: int, period: float = 52.1775, waves: int = 2, every: int = 52, penalty: float = 2.0) -> DataFrame:
    """``df`` with ``pos`` and ``season_fit``: a broken trend with yearly waves, on all rows up to each.

    ``length`` bounds the positions at which the trend may break, every ``every`` rows. Breaks and
    waves have a penalty, so a break that few rows speak for stays small.
    """
    rows = df.withColumn("pos", F.row_number().over(over(keys, ts)) - 1)
    columns = season_columns(length, period, waves, every, F.col("pos"))
    ridge = [0.0 if c in ("_c", "_t") else penalty if c.startswith("_h") else penalty / 10 for c in columns]
    fitted = fit_running(rows.withColumns(columns), keys, ts, y, list(columns), len(columns) + 2, "season_fit", ridge)
    return fitted.select(*df.columns, "pos", "season_fit")


def season_forecast(coefs: Column, t: Column, length: int, period: float = 52.1775, waves: int = 2, every: int = 52) -> Column:
    return _dot(coefs, list(season_columns(length, period, waves, every, t).values()))


# --- past the last row


def ahead(df: DataFrame, keys: Sequence[str], ts: str, y: str, horizon: int, every: str, season: int, length: int, order: int = 4) -> DataFrame:
    """Forecasts for the ``horizon`` periods after the last row of every series: one row per series and step.

    ``naive``, ``seasonal_naive``, ``drift`` and ``trend_season`` are what the backtest scores at an
    origin; ``arma`` is carried from step to step, a fold over the horizon whose state is the level and
    the last step. Where too few rows stand behind a model, its forecast is the last value.
    """
    w = over(keys, ts)
    value = F.col(y).cast("double")
    rows = season_fits(df.select(*keys, ts, value.alias("y")), keys, ts, "y", length)
    rows = with_surprises(rows.withColumn("dy", F.col("y") - F.lag("y").over(w)), keys, ts, order)
    rows = fit_running(rows, keys, ts, "dy", ["_d1", "_e1"], 8, "_arma")
    grown = w.rowsBetween(W.unboundedPreceding, 0)
    back = [F.coalesce(F.lag("y", season * -(-k // season) - k).over(w), F.col("y")) for k in range(1, horizon + 1)]
    rows = rows.withColumns(
        {
            "_season": F.array(*back),
            "_sy": F.sum(scaled("y", DIGITS)).over(grown),
            "_sty": F.sum(scaled("y", DIGITS) * F.col("pos")).over(grown),
            "_rest": F.lead(ts).over(w),
        }
    )
    last = rows.filter(F.col("_rest").isNull()).withColumn("_line", F.when(F.col("pos") >= 1, line(F.col("pos") + 1.0)))
    begin = F.struct(
        F.col("y").alias("level"),
        (F.col("_arma")[0] * F.col("dy") + F.col("_arma")[1] * F.col("_e")).alias("step"),
        F.array().cast("array<double>").alias("out"),
    )

    def on(state: Column, k: Column) -> Column:
        level = state["level"] + state["step"]
        return F.struct(level.alias("level"), (state["step"] * F.col("_arma")[0]).alias("step"), F.concat(state["out"], F.array(level)).alias("out"))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), begin, on, lambda state: state["out"])
    steps = last.withColumn("_path", path).select("*", F.posexplode(F.arrays_zip("_season", "_path")).alias("_k", "_z"))
    step = (F.col("_k") + 1).cast("int")
    unit = {"day": F.date_add(ts, step), "week": F.date_add(ts, step * 7), "month": F.add_months(ts, step)}[every]
    position = F.col("pos") + step
    return steps.select(
        *keys,
        F.col(ts).alias("origin"),
        unit.alias("target"),
        step.alias("step"),
        F.col("y").alias("naive"),
        F.col("_z._season").alias("seasonal_naive"),
        F.coalesce((F.col("_line.a") + F.col("_line.b") * position) / 1e6, "y").alias("drift"),
        F.coalesce(season_forecast(F.col("season_fit"), position, length), "y").alias("trend_season"),
        F.coalesce("_z._path", "y").alias("arma"),
    )
