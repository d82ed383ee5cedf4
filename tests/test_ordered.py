"""Keyless windows by ranges, versioned loads, day bits, forecasts from outside."""

import random
import re
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from daybook.operators import backtest, ordered, quality, rollups
from daybook.sources import landed, versions


@pytest.fixture
def many_parts(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("known", [0.6, 0.02, 0.0])
def test_ranges_give_what_one_window_gives(spark, many_parts, known):
    rng = random.Random(7)
    values = [round(rng.random() * 9, 3) if rng.random() < known else None for _ in range(900)]
    rows = list(enumerate(values))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "ts int, v double").repartition(5)
    laid = ordered.lay_out(df, ["ts"])
    assert laid.select("_part").distinct().count() > 150
    out = ordered.indexed(ordered.interpolated(ordered.lagged(ordered.differenced(ordered.changed(laid, "v", "c"), "v"), "v", 7, "lag7"), "v", "filled"))
    got = {r.ts: r for r in out.collect()}
    want = pd.Series(values, dtype=float).interpolate(limit_area="inside")
    want = want.ffill()
    for i, v in enumerate(values):
        r, before = got[i], values[i - 1] if i else None
        assert (r.idx, r.v, r.lag7) == (i, v, values[i - 7] if i >= 7 else None)
        assert r.diff == (None if v is None or before is None else v - before)
        assert r.c == (None if v is None or before is None else v != before)
        assert r.filled == (None if np.isnan(want[i]) else pytest.approx(want[i], abs=1e-9))


def test_short_series_and_few_rows_a_range(spark, many_parts):
    df = spark.createDataFrame([(i, float(i)) for i in range(3)], "ts int, v double")
    got = sorted((r.ts, r.idx, r.l) for r in ordered.indexed(ordered.lagged(ordered.lay_out(df, ["ts"]), "v", 2, "l")).collect())
    assert got == [(0, 0, None), (1, 1, None), (2, 2, 0.0)]
    assert ordered.interpolated(ordered.lay_out(df.limit(0), ["ts"]), "v", "f").count() == 0


def test_no_task_sees_the_whole_series(spark):
    laid = ordered.lay_out(spark.range(1000).select(F.col("id").alias("ts"), F.col("id").cast("double").alias("v")), ["ts"])
    for out in (ordered.lagged(laid, "v", 1, "l"), ordered.interpolated(laid, "v", "f")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        # Single partitions only gather rows of the border table, which an aggregate by partition has reduced.
        for part in plan.split("Exchange SinglePartition")[1:]:
            assert re.search(r"Aggregate\(keys?=\[_part", part.split("FileScan")[0])


def folder(tmp_path):
    return str(tmp_path / "table")


def test_a_load_that_fails_leaves_the_version_before(spark, tmp_path):
    root, calls = folder(tmp_path), []

    def rows(name, n):
        def read():
            calls.append(name)
            return spark.range(n).withColumn("from", F.lit(name))

        return read

    assert versions.version(spark, root) == 0 and versions.read(spark, root) is None
    assert versions.load(spark, root, {"a": ("1", rows("a", 3)), "b": ("1", rows("b", 2))}) == 1
    assert versions.load(spark, root, {"a": ("1", rows("a", 3)), "b": ("2", rows("b", 5))}) == 2
    assert calls == ["a", "b", "b"]  # what didn't change isn't read
    assert versions.load(spark, root, {"a": ("1", rows("a", 3)), "b": ("2", rows("b", 5))}) == 2 and len(calls) == 3

    def broken():
        raise OSError("gone")

    with pytest.raises(OSError):
        versions.load(spark, root, {"a": ("9", rows("a", 9)), "b": ("9", broken)})
    # a killed writer of the manifest leaves files, but no success file
    spark.createDataFrame([("a", "9", "nowhere", 1, 3)], versions.MANIFEST).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{root}/manifest/version=3")
    assert versions.version(spark, root) == 2
    count = lambda n=None: {r.resource: r["count"] for r in versions.read(spark, root, n).groupBy("resource").count().collect()}
    assert count() == {"a": 3, "b": 5} and count(1) == {"a": 3, "b": 2}
    assert versions.load(spark, root, {"b": ("2", broken), "c": ("1", rows("c", 1))}) == 3  # over the remains, without "a"
    assert count() == {"b": 5, "c": 1} and count(2) == {"a": 3, "b": 5}


def test_digests_follow_the_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a\n1\n")
    one = versions.file_digest(spark, f"{tmp_path}/*.csv")
    assert one == versions.file_digest(spark, f"{tmp_path}/*.csv")
    (tmp_path / "x.csv").write_text("a\n1\n2\n")
    assert one != versions.file_digest(spark, f"{tmp_path}/*.csv")


def test_day_bits_add_up_over_levels_and_weeks(spark):
    rng = random.Random(3)
    rows = [(rng.choice("AB"), rng.randint(1, 4), date(2019, 12, 20) + timedelta(days=rng.randint(0, 500))) for _ in range(3000)] + [("A", 1, None)]
    df = spark.createDataFrame(rows, "sector string, location_id int, occupancy_date date")
    bits = rollups.day_bits(df, ["sector", "location_id"])
    for keys, of in (([], lambda r: ()), (["sector"], lambda r: r[:1]), (["location_id"], lambda r: r[1:2]), (["sector", "location_id"], lambda r: r[:2])):
        for period, start in (("month", lambda d: d.replace(day=1)), ("week", lambda d: d - timedelta(days=d.weekday()))):
            want = {}
            for r in rows[:-1]:
                want.setdefault((*of(r), start(r[2])), set()).add(r[2])
            got = {tuple(r)[:-1]: r.n_days for r in rollups.distinct_days(bits, keys, period).collect()}
            assert got == {k: len(v) for k, v in want.items()}


def weeks(spark, **lists):
    rows = [(s, date(2001, 1, 1) + timedelta(days=7 * i), float(v)) for s, values in lists.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series string, ts date, y double").repartition(3)


def test_a_line_from_outside_equals_drift_and_gaps_are_reported(spark):
    rng = np.random.default_rng(8)
    df = weeks(spark, A=np.round(rng.normal(9, 1, 50), 2), B=np.round(rng.normal(9, 1, 33), 2), C=[1.0] * 5)

    def line(train, horizon):
        slope, level = np.polyfit(np.arange(len(train)), train, 1)
        return level + slope * (len(train) + np.arange(horizon - 1))

    asked = backtest.folds(df, ["series"], "ts", "y", 20, 4, 3, drift=True)
    given = backtest.outside_forecasts(df, ["series"], "ts", "y", 17, 4, 3, line)
    rows = backtest.align(asked, given, ["series"]).join(asked.select("series", "origin", "target", "drift"), ["series", "origin", "target"], "left").collect()
    kinds = {s: [r for r in rows if r.status == s] for s in ("scored", "missing", "extra")}
    assert all(r.forecast == pytest.approx(r.drift, abs=1e-6) for r in kinds["scored"]) and len(kinds["scored"]) == asked.filter("step < 4").count()
    assert {r.step for r in kinds["missing"]} == {4} and len(kinds["missing"]) == asked.filter("step = 4").count()
    assert len(kinds["extra"]) == 6 and {r.fold for r in kinds["extra"]} == {None}
    with pytest.raises(Exception, match="more than 10"):
        backtest.outside_forecasts(df, ["series"], "ts", "y", 17, 4, 3, line, most=10).collect()


def test_one_pass_counts_row_tests_and_repeats(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "x"), (None, "a"), (None, "a")], "k int, v string")
    for unique in ((), ("k",), ("k", "v")):
        got = {(r.test, r.column_name): r.n_failures for r in quality.check("t", df, quality.Rules(("k", "v"), unique, {"v": ("a",)})).collect()}
        want = {("not_null", "k"): 2, ("not_null", "v"): 1, ("accepted_values", "v"): 1} | {("unique", c): 1 for c in unique}
        assert got == want
    empty = {(r.test, r.n_failures) for r in quality.check("t", df.limit(0), quality.Rules(("k",), ("k",), {})).collect()}
    assert empty == {("not_null", 0), ("unique", 0)}


def test_chosen_years_filter_each_source_without_moving_its_rows(spark, tmp_path):
    frames = [spark.createDataFrame(r, "_source_year int, v string") for r in ([(1, "a"), (None, "n")], [(1, "b"), (2, "b")], [(2, "c"), (3, "c"), (None, "m")])]
    out = landed.first_available(frames, str(tmp_path / "years"))
    assert {tuple(r) for r in out.collect()} == {(1, "a"), (None, "n"), (2, "b"), (3, "c")}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
