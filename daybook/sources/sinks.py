"""Writers: idempotent replace with a row count, marts, CSV and JSON exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from daybook.functions.numbers import round_to

#: Files of a partitioned write that a task has open before it sorts its rows instead.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
YEARS_OPEN = 12


def replace(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> int:
    """Overwrite a Parquet folder; returns the rows written, counted during the write."""
    seen = Observation("load")
    writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return seen.get["n"]


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> int:
    """Overwrite only the partitions present in ``df``; the other ones stay."""
    seen = Observation("load")
    (
        df.observe(seen, F.count(F.lit(1)).alias("n"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )
    return seen.get["n"]


def save_mart(df: DataFrame, path: str, year: str = "year_number", rebalance: bool = False) -> int:
    """Write a fact partitioned by year, so that year predicates prune whole folders.

    Each task writes the years it holds, up to ``YEARS_OPEN`` of them side by side; it
    sorts its rows by year, and spills what it sorts, only if it meets more. Where every task holds every year, and
    files would come out small, ``rebalance`` gathers a year's rows first; the
    adaptive split of large years keeps a hot year from becoming one task.
    """
    if rebalance:
        df = df.hint("rebalance", year)
    seen = Observation("mart")
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(WRITERS)
    conf.set(WRITERS, str(YEARS_OPEN))
    try:
        (
            df.observe(seen, F.count(F.lit(1)).alias("n"))
            .write.mode("overwrite")
            .option("maxRecordsPerFile", 20_000_000)
            .partitionBy(year)
            .parquet(path)
        )
    finally:
        conf.set(WRITERS, before)
    return seen.get["n"]


def as_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def write_csv(df: DataFrame, path: str, digits: int | None = None, single_file: bool = False) -> None:
    """CSV with a header. ``single_file`` is for result tables that are already aggregates."""
    if digits is not None:
        df = df.select(*[round_to(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    if single_file:
        df = df.coalesce(1)
    df.write.mode("overwrite").option("header", True).csv(path)


def json_rows(df: DataFrame, *order: str) -> DataFrame:
    """One JSON document per row, keeping NULL fields."""
    return df.select(*order, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
