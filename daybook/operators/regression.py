"""Least squares with diagnostics, one fit per series, from aggregated moments.

One aggregate per series computes counts, means and co-moments (Spark's
covariances merge partial results in a stable way), so the rows are read once
and never leave the JVM. What reaches Python is one small row of moments per
series, solved there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.functions.distributions import f_upper, t_quantile, t_two_sided
from daybook.functions.metrics import stars
from daybook.operators.series import over

INTERCEPT = "Intercept"


def moments(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """n, means and co-moment sums of the target and all predictors, per series."""
    names = [y, *xs]
    means = F.array(*[F.avg(F.col(c).cast("double")) for c in names])
    pairs = [
        F.covar_pop(F.col(names[i]).cast("double"), F.col(names[j]).cast("double"))
        for i in range(len(names))
        for j in range(i + 1)
    ]
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), means.alias("means"), F.array(*pairs).alias("comoments")
    )


def _solve(n: int, means: np.ndarray, lower: np.ndarray, terms: list[str], level: float) -> dict:
    """All results of one fit from its moments (``lower``: lower triangle, row by row)."""
    k = len(terms)
    s = np.zeros((k + 1, k + 1))
    s[np.tril_indices(k + 1)] = np.asarray(lower, float) * n
    s = s + np.tril(s, -1).T
    sxx, sxy, syy = s[1:, 1:], s[1:, 0], s[0, 0]
    if n <= k + 1:
        return {"reason": "too few rows"}
    # Scaled to unit variances, so that the units of the predictors don't decide.
    unit = np.sqrt(np.diag(sxx))
    if not unit.all() or np.linalg.matrix_rank(sxx / np.outer(unit, unit), tol=1e-10) < k:
        return {"reason": "dependent predictors"}
    if syy <= 0:
        return {"reason": "constant target"}
    inverse = np.linalg.inv(sxx)
    slope = inverse @ sxy
    mx = np.asarray(means[1:], float)
    ssr = max(syy - slope @ sxy, 0.0)
    dof = n - k - 1
    s2 = ssr / dof
    coef = np.concatenate([[means[0] - slope @ mx], slope])
    se = np.sqrt(s2 * np.concatenate([[1.0 / n + mx @ inverse @ mx], np.diag(inverse)]))
    t = coef / se
    width = t_quantile(0.5 + level / 2, dof) * se
    r2 = 1.0 - ssr / syy
    f = (syy - ssr) / k / s2
    loglik = -n / 2 * (math.log(2 * math.pi) + math.log(ssr / n) + 1)
    return {
        "coef": coef,
        "std_err": se,
        "t_value": t,
        "p_value": [t_two_sided(v, dof) for v in t],
        "ci_low": coef - width,
        "ci_high": coef + width,
        "vif": np.concatenate([[np.nan], np.diag(inverse) * np.diag(sxx)]),
        "fit": dict(
            n=n, dof=dof, r2=r2, adj_r2=1 - (1 - r2) * (n - 1) / dof, f_value=f, f_p=f_upper(f, k, dof),
            log_lik=loglik, aic=2 * (k + 1) - 2 * loglik, bic=math.log(n) * (k + 1) - 2 * loglik, ssr=ssr,
        ),
    }


TERM_COLUMNS = ("coef", "std_err", "t_value", "p_value", "ci_low", "ci_high", "vif")
FIT_COLUMNS = ("r2", "adj_r2", "f_value", "f_p", "log_lik", "aic", "bic", "ssr")


def fit(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str], level: float = 0.95) -> DataFrame:
    """One row per series: arrays over the terms, plus the statistics of the fit.

    A series that can't be fitted (too few rows, dependent predictors, a
    constant target) keeps its row, with NULL statistics and the ``reason``.
    """
    terms, key_list = list(xs), list(keys)
    table = moments(df, keys, y, xs)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                got = _solve(row.n, row.means, row.comoments, terms, level)
                fitted = got.get("fit", {})
                nothing = [None] * (len(terms) + 1)
                out.append(
                    {
                        **{k: getattr(row, k) for k in key_list},
                        "term": [INTERCEPT, *terms],
                        **{c: list(got.get(c, nothing)) for c in TERM_COLUMNS},
                        "n": row.n,
                        "dof": row.n - len(terms) - 1,
                        **{c: fitted.get(c) for c in FIT_COLUMNS},
                        "reason": got.get("reason"),
                    }
                )
            yield pd.DataFrame(out, columns=[*key_list, "term", *TERM_COLUMNS, "n", "dof", *FIT_COLUMNS, "reason"])

    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema if f.name in key_list)
    schema = ", ".join(
        [key_schema, "term array<string>"]
        + [f"{c} array<double>" for c in TERM_COLUMNS]
        + ["n long", "dof long"]
        + [f"{c} double" for c in FIT_COLUMNS]
        + ["reason string"]
    )
    return table.mapInPandas(solve, schema)


def coefficients(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Coefficient table: one row per series and term, with significance stars."""
    rows = fits.select(*keys, F.inline(F.arrays_zip("term", *[c for c in TERM_COLUMNS if c != "vif"])))
    return rows.withColumn("stars", stars("p_value"))


def vif(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Variance inflation factor of every predictor (the design includes the constant)."""
    rows = fits.select(*keys, F.inline(F.arrays_zip("term", "vif")))
    return rows.filter(F.col("term") != INTERCEPT)


def fit_statistics(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    return fits.select(*keys, "n", "dof", *FIT_COLUMNS, "reason")


def predict(df: DataFrame, fits: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """Fitted values and residuals: one join with the per-series coefficients, then plain arithmetic."""
    joined = df.join(fits.select(*keys, F.col("coef").alias("_coef")), list(keys))
    fitted = F.col("_coef")[0]
    for i, x in enumerate(xs, 1):
        fitted = fitted + F.col("_coef")[i] * F.col(x)
    out = joined.withColumn("fitted", fitted).drop("_coef")
    return out.withColumn("residual", F.col(y) - F.col("fitted"))


def residual_diagnostics(rows: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Durbin-Watson, skewness, kurtosis and the Jarque-Bera test of the residuals, per series."""
    step = F.col("residual") - F.lag("residual").over(over(keys, ts))
    e = F.col("residual")
    sums = rows.withColumn("_step", step).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("_step") * F.col("_step")).alias("ss_step"),
        *[F.sum(F.pow(e, F.lit(p))).alias(f"s{p}") for p in (2, 3, 4)],
    )
    # residuals of a fit with a constant have mean zero, so raw moments are central ones
    m2, m3, m4 = (F.col(f"s{p}") / F.col("n") for p in (2, 3, 4))
    shape = sums.select(
        *keys,
        "n",
        (F.col("ss_step") / F.col("s2")).alias("durbin_watson"),
        (m3 / F.pow(m2, F.lit(1.5))).alias("skew"),
        (m4 / (m2 * m2)).alias("kurtosis"),
    )
    excess = F.col("kurtosis") - 3
    jb = F.col("n") / 6 * (F.col("skew") * F.col("skew") + excess * excess / 4)
    # chi-square with two degrees of freedom
    return shape.withColumn("jarque_bera", jb).withColumn("jb_p", F.exp(-F.col("jarque_bera") / 2))


def effects(coefs: DataFrame, scales: dict[str, tuple[str, float]]) -> DataFrame:
    """Coefficients in readable units: ``{"avg_temp_c": ("per 10 degrees colder", -10)}``."""
    table = F.create_map(*[x for t, (label, _) in scales.items() for x in (F.lit(t), F.lit(label))])
    factor = F.create_map(*[x for t, (_, k) in scales.items() for x in (F.lit(t), F.lit(float(k)))])
    kept = coefs.filter(F.col("term").isin(*scales))
    return kept.withColumn("effect", table[F.col("term")]).withColumn("amount", F.col("coef") * factor[F.col("term")])
