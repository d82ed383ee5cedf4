import json
from datetime import date, datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from daybook.session import shared_folder, shuffle_partitions
from daybook.sources import landed, sinks
from daybook.sources.registry import Sources
from daybook.streaming import late


def land_pages(folder, *pages, total=5):
    folder.mkdir()
    for n, (ids, ok) in enumerate(pages):
        body = {"success": ok, "result": {"total": total, "records": [{"_id": i, "a": str(i), "extra": 1} for i in ids]}}
        (folder / f"p{n}.json").write_text(json.dumps(body, indent=1))
    return str(folder)


def test_paged_json(spark, tmp_path):
    path = land_pages(tmp_path / "whole", ([1, 2], True), ([3, 4], True), ([5], True))
    rows = landed.load_pages(spark, path, ["a", "missing"])
    assert rows.columns == ["a", "missing"]
    assert sorted(r.a for r in rows.collect()) == ["1", "2", "3", "4", "5"]


def test_failed_incomplete_and_empty_loads_stop(spark, tmp_path):
    failed = land_pages(tmp_path / "failed", ([1, 2, 3, 4, 5], True), ([], False))
    with pytest.raises(RuntimeError, match="1 landed pages"):
        landed.load_pages(spark, failed, ["a"])
    with pytest.raises(Exception, match="does not say success"):
        landed.page_records(landed.read_pages(spark, failed, ["a"])).collect()
    (tmp_path / "failed" / "p9.json").write_text('{"success": true, "result": {"rec')
    pages = landed.read_pages(spark, failed, ["a"])
    assert landed.failed_pages(pages).count() == 2
    assert landed.page_progress(pages).first().asDict() == {"failed": 2, "announced": 5, "landed": 5}
    with pytest.raises(RuntimeError, match="announces 5 records, 2 landed"):
        landed.load_pages(spark, land_pages(tmp_path / "part", ([1, 2], True)), ["a"])
    with pytest.raises(RuntimeError, match="no rows landed"):
        landed.load_pages(spark, land_pages(tmp_path / "none", ([], True), total=0), ["a"])
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "empty.csv").write_text("")
    with pytest.raises(RuntimeError, match="no CSV files"):
        landed.read_csv(spark, str(tmp_path / "csv"), ["a"])


def test_observations(spark, tmp_path):
    obs = [{"d": "2017-01-03", "V9": {"v": "0.50"}}, {"d": "2017-01-04"}, {"V9": {"v": "1"}}, {"d": "2016-01-04", "V9": {"v": "2"}}]
    (tmp_path / "o.json").write_text(json.dumps({"observations": obs}, indent=1))
    payload = landed.read_observations(spark, str(tmp_path), "V9")
    assert landed.observation_rows(payload, "V9", start="2017-01-01").collect() == [(date(2017, 1, 3), 0.5)]
    assert landed.observation_rows(payload, "V9").count() == 2


def test_yearly_csv_with_byte_order_mark(spark, tmp_path):
    for year in (2019, 2020):
        text = '"Date/Time","Mean Temp (°C)"\n' + f'"{year}-01-01","M"\n"{year}-01-02","-1.5"\n'
        (tmp_path / f"weather_{year}.csv").write_bytes(b"\xef\xbb\xbf" + text.encode())
    rows = landed.read_yearly_csv(spark, str(tmp_path), ["Date/Time", "Mean Temp (°C)"])
    got = sorted(tuple(r) for r in rows.drop(landed.CORRUPT).collect())
    assert got[0] == ("2019-01-01", "M", 2019) and got[-1] == ("2020-01-02", "-1.5", 2020) and len(got) == 4


def test_csv_goes_by_column_name(spark, tmp_path):
    (tmp_path / "x_2019.csv").write_bytes(b"\xef\xbb\xbf" + "k,v,w\n1,x,p\n".encode())
    (tmp_path / "x_2020.csv").write_text("extra,v,k\nq,y,2\n")
    (tmp_path / "x_2021.csv").write_text("")
    (tmp_path / "_source_year=2022").mkdir()
    (tmp_path / "_source_year=2022" / "part.csv").write_text("w,k,v\nr,3,z\n")
    rows = landed.read_yearly_csv(spark, str(tmp_path), ["k", "v", "w"])
    got = sorted(tuple(r) for r in rows.drop(landed.CORRUPT).collect())
    assert got == [("1", "x", "p", 2019), ("2", "y", None, 2020), ("3", "z", "r", 2022)]
    assert len(landed.csv_layouts(spark, str(tmp_path))) == 3


def test_rows_with_a_wrong_number_of_fields_are_kept_and_counted(spark, tmp_path):
    (tmp_path / "x_2019.csv").write_text("k,v,w\n1,x,p\n2,y\n3,z,q,too much\n,a,b\n")
    rows = landed.read_yearly_csv(spark, str(tmp_path), ["k", "w"])
    assert [(r.k, r.w, r[landed.CORRUPT]) for r in rows.collect()] == [
        ("1", "p", None), ("2", None, "2,y"), ("3", "q", "3,z,q,too much"), (None, "b", None),
    ]
    assert landed.corrupt_rows(rows, ["_source_year"], "k").collect() == [(2019, 4, 3, 2)]


def test_fallback_takes_whole_years_from_the_first_source(spark, tmp_path):
    api = spark.createDataFrame([(2019, "a")], "_source_year int, v string")
    csv = spark.createDataFrame([(2019, "b"), (2020, "b"), (2020, "b2")], "_source_year int, v string")
    manual = spark.createDataFrame([(2020, "c"), (2021, "c"), (1999, "c"), (None, "c")], "_source_year int, v string")
    got = landed.first_available([api, csv, manual], str(tmp_path / "a"), range(2019, 2023))
    assert sorted(tuple(r) for r in got.collect()) == [(2019, "a"), (2020, "b"), (2020, "b2"), (2021, "c")]
    got = landed.first_available([api, csv, manual], str(tmp_path / "b"))
    assert sorted((str(r._source_year), r.v) for r in got.collect()) == [
        ("1999", "c"), ("2019", "a"), ("2020", "b"), ("2020", "b2"), ("2021", "c"), ("None", "c"),
    ]
    assert landed.first_available([api.limit(0)], str(tmp_path / "c")).isEmpty()


def test_resource_selection(spark):
    schema = "id int, format string, datastore_active boolean"
    rows = [(1, "csv", True), (2, "CSV", None), (3, "JSON", True)]
    assert [r.id for r in landed.pick_resources(spark.createDataFrame(rows, schema)).collect()] == [1]
    rows = [(1, "csv", False), (2, "CSV", None), (3, "JSON", True), (4, None, True)]
    assert sorted(r.id for r in landed.pick_resources(spark.createDataFrame(rows, schema)).collect()) == [1, 2]
    assert landed.pick_resources(spark.createDataFrame([], schema)).isEmpty()


def test_stack_fills_missing_columns(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, a string"), spark.createDataFrame([("y", 2)], "b string, k int")
    assert sorted(tuple(r) for r in landed.stack(a, b).collect()) == [(1, "x", None), (2, None, "y")]


def test_freshness(spark):
    rows = [("a", datetime(2024, 1, 1, 0), "old"), ("a", datetime(2024, 1, 2, 0), "new"), ("b", datetime(2024, 1, 1, 0), "b")]
    latest = landed.latest_landed(spark.createDataFrame(rows, "k string, fetched_at timestamp_ntz, path string"), "k")
    now = F.lit("2024-01-02 12:00:00").cast("timestamp_ntz")
    got = {r.k: (r.path, r.age_hours, r.is_fresh) for r in landed.freshness(latest, now, 24).collect()}
    assert got == {"a": ("new", 12.0, True), "b": ("b", 36.0, False)}


def test_replace_counts_and_overwrites(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.replace(spark.range(10), path) == 10
    assert sinks.replace(spark.range(4), path) == 4
    assert spark.read.parquet(path).count() == 4


def test_partition_replace_keeps_other_years(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(1, 2019), (2, 2020)], "v int, y int")
    sinks.replace_partitions(first, path, ["y"])
    sinks.replace_partitions(spark.createDataFrame([(9, 2020)], "v int, y int"), path, ["y"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, 2019), (9, 2020)]


def test_mart_prunes_years(spark, tmp_path):
    path = str(tmp_path / "m")
    sinks.save_mart(spark.range(100).selectExpr("id", "CAST(2019 + id % 4 AS INT) AS year_number"), path)
    df = spark.read.parquet(path).filter("year_number >= 2021")
    assert df.count() == 50
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "year_number" in plan.split("PartitionFilters")[1][:120]


def test_rebalanced_mart_has_the_same_rows_in_fewer_files(spark, tmp_path):
    df = spark.range(1000).repartition(8).selectExpr("id", "CAST(2019 + id % 4 AS INT) AS year_number")
    plain, gathered = str(tmp_path / "p"), str(tmp_path / "g")
    assert sinks.save_mart(df, plain) == sinks.save_mart(df, gathered, rebalance=True) == 1000
    a, b = spark.read.parquet(plain), spark.read.parquet(gathered)
    assert a.exceptAll(b).isEmpty() and len(b.inputFiles()) == 4 < len(a.inputFiles())


def test_shuffle_sizing():
    assert shuffle_partitions(1 << 30) == 200
    assert shuffle_partitions(10 << 40) == 20480
    assert shuffle_partitions(100 << 40) == 204_800


def test_csv_and_json_exports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.23456, None)], "k string, v double, n string")
    sinks.write_csv(df, str(tmp_path / "c"), digits=3, single_file=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().v == "1.235"
    sinks.write_json(df, str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first()[0]) == {"k": "a", "v": 1.23456, "n": None}
    assert json.loads(sinks.json_rows(df).first().json)["n"] is None


def test_registry(spark, tmp_path):
    sinks.replace(spark.range(3), str(tmp_path / "nums.parquet"))
    names = Sources.parquet_folder(str(tmp_path), ["nums"])
    names.register_views(spark)
    assert spark.sql("SELECT count(*) AS n FROM nums").first().n == 3
    with pytest.raises(KeyError):
        names.read(spark, "other")


def test_shared_folder_follows_the_session(spark):
    def session(folder, master):
        conf = SimpleNamespace(get=lambda key, default: folder or default)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    assert shared_folder(spark, "a") != shared_folder(spark, "a")
    assert shared_folder(session("s3://space/", "spark://m:7077"), "a").startswith("s3://space/a-")
    with pytest.raises(RuntimeError):
        shared_folder(session(None, "spark://m:7077"), "a")


def test_late_rows_count_once_and_in_their_day(spark, tmp_path):
    path, store, progress = (str(tmp_path / n) for n in ("in", "store", "progress"))
    schema = "id long, ts timestamp, k string, v long"

    def land(*rows):
        spark.createDataFrame([(i, datetime.fromisoformat(d), "x", v) for i, d, v in rows], schema).coalesce(1).write.mode("append").parquet(path)

    def run(files=None):
        stream = late.landed_stream(spark, path, spark.createDataFrame([], schema).schema, files)
        late.run_available(stream, store, progress, "ts", ["k"], "v", ["id"], 2)
        return {r.day.day: (r.n_rows, r.total, r.n_late) for r in late.daily_totals(spark, store, ["k"]).collect()}

    land((1, "2024-01-01 05:00", 10), (2, "2024-01-02 05:00", 1))
    assert run() == {1: (1, 10, 0), 2: (1, 1, 0)}
    # a row of the first day and a second delivery of a known row, both soon enough
    land((3, "2024-01-01 20:00", 5), (1, "2024-01-01 05:00", 10))
    land((4, "2024-01-05 05:00", 7))
    assert run(files=1) == {1: (2, 15, 0), 2: (1, 1, 0), 5: (1, 7, 0)}
    # far behind the newest day: counted in its day, and as late; a repeated delivery is neither
    land((5, "2024-01-01 06:00", 100), (1, "2024-01-01 05:00", 10))
    assert run() == {1: (3, 115, 1), 2: (1, 1, 0), 5: (1, 7, 0)}
    assert run() == {1: (3, 115, 1), 2: (1, 1, 0), 5: (1, 7, 0)}


def test_event_time_state_closes_days_counts_late_rows_and_goes_on_after_a_restart(spark, tmp_path):
    from datetime import datetime

    from daybook.streaming import late

    at = lambda day, hour=0: datetime(2024, 1, day, hour)
    landing, out, progress = (str(tmp_path / n) for n in ("landing", "out", "progress"))
    schema = "id long, ts timestamp, kind string, units long"

    def land(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
        stream = late.landed_stream(spark, landing, spark.createDataFrame([], schema).schema)
        dropped = late.run_event_time(late.event_time_totals(stream, "ts", ["kind"], "units", ["id"], "2 days"), out, progress)
        got = spark.read.schema("kind string, day date, n_rows long, total long").parquet(out).collect()
        return dropped, sorted((r.kind, r.day.day, r.n_rows, r.total) for r in got)

    assert land((1, at(1), "a", 5), (1, at(1), "a", 5), (2, at(1, 9), "b", 7), (3, at(4), "a", 1)) == (0, [("a", 1, 1, 5), ("b", 1, 1, 7)])
    # within the watermark (day 2 on): a copy of a known row, a new row of an open day; behind it: a row that counts nowhere
    late_rows, days = land((3, at(4), "a", 1), (4, at(3), "a", 2), (5, at(1), "a", 100), (6, at(9), "b", 3))
    assert late_rows == 1 and days == [("a", 1, 1, 5), ("a", 3, 1, 2), ("a", 4, 1, 1), ("b", 1, 1, 7)]
    assert land() == (0, days)
