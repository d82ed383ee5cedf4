"""Unit-root tests of many series from aggregated moments.

The regression of a step on the level before and on earlier steps needs nothing
but the co-moments of those columns. One aggregate per series gives them for the
longest regression; eliminating one column after another gives the unexplained sum
of squares of every shorter one on the way, from which AIC picks the number of
lagged steps. A second aggregate, over the rows that number leaves, gives the
statistic. Only a row of moments per series reaches Python.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daybook.functions.distributions import unit_root_p
from daybook.operators.regression import moments
from daybook.operators.running import sweep
from daybook.operators.series import over

LEVEL = 0.05


def default_lags(n: int) -> int:
    """Lagged steps to try for n values."""
    return max(0, min(math.ceil(12.0 * (n / 100.0) ** 0.25), n // 2 - 2))


def _matrix(n: int, lower: np.ndarray, k: int) -> np.ndarray:
    """Centred sums of products of k predictors and, behind them, the target, from moments with the target first."""
    full = np.zeros((k + 1, k + 1))
    full[np.tril_indices(k + 1)] = np.asarray(lower, float) * n
    full = full + np.tril(full, -1).T
    order = [*range(1, k + 1), 0]
    return full[np.ix_(order, order)]


def best_order(n: int, lower: np.ndarray, lags: int, most: int) -> int | None:
    """The number of lagged steps, up to ``lags`` of ``most``, with the least AIC; the smaller of equals."""
    k = most + 1
    if n <= lags + 2:
        return None
    left: list[np.ndarray] = []
    sweep(_matrix(n, lower, k)[None], k, left)
    errors = [float(e[0]) for e in left[: lags + 1]]
    if errors[0] <= 0:
        return 0
    scores = [n * math.log(max(e, 1e-300) / n) + 2 * (p + 2) for p, e in enumerate(errors)]
    return int(np.argmin(scores))


def statistic(n: int, lower: np.ndarray, lags: int, most: int) -> float | None:
    """The level's t-value."""
    k, dof = most + 1, n - lags - 2
    if dof < 1:
        return None
    unit = np.zeros((k + 1, 1))
    unit[0] = 1.0
    found = sweep(np.hstack([_matrix(n, lower, k), unit])[None], k)[0]
    error, spread = found[k, k] / dof, found[0, k + 1]
    return float(found[0, k] / math.sqrt(error * spread)) if error > 0 and spread > 0 else None


def _columns(rows: DataFrame, lags: Column, most: int) -> DataFrame:
    """Rows with enough steps behind them; steps beyond ``lags`` are zero, which elimination skips."""
    used = {f"_s{j}": F.when(lags >= j, F.col(f"_s{j}")).otherwise(0.0) for j in range(1, most + 1)}
    return rows.filter(F.col("_i") > lags).withColumns(used)


def unit_root(df: DataFrame, keys: Sequence[str], ts: str, y: str, max_lag: int | None = None) -> DataFrame:
    """Per series ``lags`` (by AIC), ``n`` rows of the regression, ``statistic``, ``p_value`` and ``stationary``.

    Missing values are left out first. Without ``max_lag`` the longest series gives the number of
    columns, and every series tries as many lags as its own length allows. A series that is too short
    or constant keeps its row, with a NULL statistic.
    """
    w = over(keys, ts)
    rows = df.select(*keys, ts, F.col(y).cast("double").alias("_y")).na.drop(subset=["_y"])
    rows = rows.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(W.partitionBy(*keys)), "_b": F.lag("_y").over(w)})
    if max_lag is None:
        longest = rows.agg(F.max("_n")).first()[0] or 0
        max_lag = default_lags(longest)
    most = max_lag
    own = F.greatest(F.lit(0), F.least(F.lit(most), F.ceil(12.0 * F.pow(F.col("_n") / 100.0, F.lit(0.25))), F.floor(F.col("_n") / 2) - 2)).cast("int")
    rows = rows.withColumns({"_d": F.col("_y") - F.col("_b"), "_own": own})
    rows = rows.withColumns({f"_s{j}": F.lag("_d", j).over(w) for j in range(1, most + 1)})
    names = ["_b", *[f"_s{j}" for j in range(1, most + 1)]]
    series = rows.select(*keys, "_own").distinct()
    first = moments(_columns(rows, F.col("_own"), most), [*keys, "_own"], "_d", names)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [best_order(n, lower, own, most) for n, lower, own in zip(b["n"], b["comoments"], b["_own"], strict=True)]
            yield b[list(keys)].assign(lags=pd.array(found, "Int32"))

    chosen = first.mapInPandas(choose, f"{kinds}, lags int").na.drop(subset=["lags"])
    second = moments(_columns(rows.join(chosen, list(keys)), F.col("lags"), most), [*keys, "lags"], "_d", names)

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            t = [statistic(n, lower, lags, most) for n, lower, lags in zip(b["n"], b["comoments"], b["lags"], strict=True)]
            p = [None if v is None else unit_root_p(v) for v in t]
            yield b[[*keys, "lags", "n"]].assign(statistic=pd.array(t, "Float64"), p_value=pd.array(p, "Float64"))

    tested = second.mapInPandas(test, f"{kinds}, lags int, n long, statistic double, p_value double")
    return series.drop("_own").join(tested, list(keys), "left").withColumn("stationary", F.col("p_value") < LEVEL)
