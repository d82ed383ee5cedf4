"""What all operators share: session limits, cut lineage, row places, single evaluation of an array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.session import shared_folder, ship_package

#: Rows and bytes that reach a Python worker at once; a worker never holds more than one batch of texts.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches and give the executors this package."""
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again.

    Cuts the lineage, so that a lost executor costs no more than its own
    tasks, and fixes row places and partition numbers for good.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def place() -> Column:
    """A number for each row of a scan; only stable once written (see ``cut``)."""
    return F.monotonically_increasing_id()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    The optimizer may move an expression into the lambda that uses it, where it
    runs once per element; a lambda's own argument can't be moved.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: White space between words: U+0020 and U+0009 to U+000D, nothing else.
SPACE = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; none for null or blank texts."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")
