"""Declarative data tests, reject counts and load gates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """Tests of one table. NULLs pass ``accepted`` and ``unique``."""

    not_null: Sequence[str] = ()
    unique: Sequence[str] = ()
    accepted: dict[str, Sequence[str]] = field(default_factory=dict)


# The data tests of the staging tables.
SECTORS = ("MEN", "WOMEN", "YOUTH", "FAMILIES", "CO-ED", "MIXED ADULT")
CAPACITY_TYPES = ("Bed Based Capacity", "Room Based Capacity")
STAGING_RULES = {
    "stg_legacy": Rules(("occupancy_date", "sector", "occupancy"), (), {"sector": SECTORS}),
    "stg_current": Rules(
        ("occupancy_date", "organization_name", "sector", "capacity_type"), (), {"capacity_type": CAPACITY_TYPES}
    ),
    "stg_unified": Rules(
        ("occupancy_date", "occupancy", "data_schema_version"), (), {"data_schema_version": ("legacy", "current")}
    ),
    "stg_rates": Rules(("rate_date", "policy_rate"), ("rate_date",)),
    "stg_weather": Rules(("weather_date",), ("weather_date",)),
}


def _row_tests(rules: Rules) -> list[tuple[str, str, Column]]:
    tests = [("not_null", c, F.col(c).isNull()) for c in rules.not_null]
    tests += [("accepted_values", c, ~F.col(c).isin(*values)) for c, values in rules.accepted.items()]
    return tests


def duplicates(df: DataFrame, *cols: str) -> DataFrame:
    """Values that occur more than once, with their count."""
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    return df.filter(present).groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def check(table: str, df: DataFrame, rules: Rules) -> DataFrame:
    """table, test, column, failures, passed.

    All row tests of a table are counted in one scan and one aggregate, with the
    table's uniqueness test if it has a single one; each of several groups by its
    column in a pass of its own. Counts are merged map-side.
    """
    tests = _row_tests(rules)
    counts = [F.count_if(bad).alias(f"t{i}") for i, (_, _, bad) in enumerate(tests)]
    if len(rules.unique) == 1:
        # One pass for all tests: rows meet by the unique column, and its repeats are counted with the row tests.
        key = F.col(rules.unique[0])
        repeated = F.count_if(F.col("_key").isNotNull() & (F.col("_n") > 1)).alias("u0")
        grouped = df.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("_n"), *counts)
        df, counts, unique = grouped, [F.coalesce(F.sum(f"t{i}"), F.lit(0)).alias(f"t{i}") for i in range(len(tests))] + [repeated], rules.unique
    else:
        unique = ()
    kinds = [*tests, *[("unique", c, None) for c in unique]]
    names = [*[f"t{i}" for i in range(len(tests))], *[f"u{i}" for i in range(len(unique))]]
    out = []
    if kinds:
        rows = F.array(
            *[
                F.struct(F.lit(kind).alias("test"), F.lit(c).alias("column_name"), F.col(n).alias("n_failures"))
                for (kind, c, _), n in zip(kinds, names, strict=True)
            ]
        )
        out.append(df.agg(*counts).select(F.inline(rows)))
    for c in rules.unique if not unique else ():
        found = duplicates(df, c).agg(F.count(F.lit(1)).alias("n_failures"))
        out.append(found.select(F.lit("unique").alias("test"), F.lit(c).alias("column_name"), "n_failures"))
    report = reduce(DataFrame.unionByName, out)
    return report.select(
        F.lit(table).alias("table_name"), "test", "column_name", "n_failures", (F.col("n_failures") == 0).alias("passed")
    )


def report(tables: dict[str, tuple[DataFrame, Rules]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [check(name, df, rules) for name, (df, rules) in tables.items()])


def rejects(df: DataFrame, pairs: dict[str, tuple[str, Column]]) -> DataFrame:
    """Per column: non-blank texts that the typed expression turned into NULL.

    ``pairs`` maps a label to (raw column, typed expression); one scan for all.
    """
    counts = df.agg(
        *[
            F.count_if((F.trim(F.col(raw)) != "") & typed.isNull()).alias(f"r{i}")
            for i, (raw, typed) in enumerate(pairs.values())
        ],
        F.count(F.lit(1)).alias("n_rows"),
    )
    rows = F.array(
        *[
            F.struct(F.lit(label).alias("column_name"), F.col(f"r{i}").alias("n_rejected"), F.col("n_rows").alias("n_rows"))
            for i, label in enumerate(pairs)
        ]
    )
    return counts.select(F.inline(rows))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Stop a load that found nothing."""
    if df.isEmpty():
        raise RuntimeError(f"no rows loaded for {what}")
    return df


def require_empty(df: DataFrame, what: str) -> None:
    """Stop a load when bad rows or failed pages were found."""
    n = df.count()
    if n:
        raise RuntimeError(f"{n} {what}")


def require_passed(checks: DataFrame) -> DataFrame:
    """Stop when any data test of a report failed; the report is one row per test."""
    bad = [f"{r.table_name}.{r.column_name} {r.test}: {r.n_failures}" for r in checks.filter("not passed").collect()]
    if bad:
        raise RuntimeError("data tests failed: " + "; ".join(bad))
    return checks
