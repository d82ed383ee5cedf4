"""Late daily rows, processed incrementally.

Rows for weekends and holidays land a few days after their day, and some land
twice. Each micro-batch of a stream is kept, and the totals of the days it
touches are computed anew from everything kept of those days; so no row is
dropped, however late, open days have totals too, and the work of a batch
follows the days it touches. Rows that come more than ``late_by`` days behind
the newest day of earlier batches are counted as late in their day's totals.

State is two tables below one folder, both written per batch and overwritten if
a batch is repeated: ``rows`` by batch and day, ``totals`` by batch. Nothing is
held in memory between batches. ``availableNow`` works off everything landed
since the last run and stops, so a scheduler can call it like a batch job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def landed_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def merge_batch(
    batch: DataFrame, number: int, store: str, ts: str, keys: Sequence[str], value: str, row_id: Sequence[str], late_by: int
) -> None:
    """Keep one batch and write the totals of the days it touches."""
    spark = batch.sparkSession
    newest = None
    if number:
        newest = spark.read.parquet(f"{store}/totals").filter(F.col("batch") < number).agg(F.max("day").alias("d")).first().d
    day = F.to_date(ts)
    late = F.lit(False) if newest is None else F.coalesce(day < F.date_sub(F.lit(newest), late_by), F.lit(False))
    rows = batch.select(*keys, F.col(value).alias("_value"), *row_id, late.alias("_late"), day.alias("day"))
    rows.write.mode("overwrite").partitionBy("day").parquet(f"{store}/rows/batch={number}")
    kept = spark.read.option("basePath", f"{store}/rows").parquet(f"{store}/rows").filter(F.col("batch") <= number)
    # One row per day of the batch, from folder names alone.
    touched = kept.filter(F.col("batch") == number).select(F.col("day").alias("_day")).distinct()
    known = kept.join(F.broadcast(touched), F.col("day").eqNullSafe(F.col("_day")))
    first = F.min(F.struct("batch", "_late", "_value", *keys, "day")).alias("r")
    once = known.groupBy(*row_id).agg(first).select(*[F.col(f"r.{c}") for c in (*keys, "day", "_late", "_value")])
    totals = once.groupBy(*keys, "day").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("_value").alias("total"), F.count_if("_late").alias("n_late")
    )
    totals.write.mode("overwrite").parquet(f"{store}/totals/batch={number}")


def run_available(
    stream: DataFrame, store: str, checkpoint: str, ts: str, keys: Sequence[str], value: str, row_id: Sequence[str], late_by: int = 3
) -> StreamingQuery:
    """Merge everything that has landed since the last run."""

    def merge(batch: DataFrame, number: int) -> None:
        merge_batch(batch, number, store, ts, keys, value, row_id, late_by)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def daily_totals(spark: SparkSession, store: str, keys: Sequence[str]) -> DataFrame:
    """(keys, day): distinct rows, their sum and how many came late, as of the last batch that touched the day."""
    totals = spark.read.parquet(f"{store}/totals")
    last = totals.groupBy(F.col("day").alias("_day")).agg(F.max("batch").alias("_last"))
    current = totals.join(last, F.col("day").eqNullSafe(F.col("_day")) & (F.col("batch") == F.col("_last")))
    return current.select(*keys, "day", "n_rows", "total", "n_late")


def event_time_totals(rows: DataFrame, ts: str, keys: Sequence[str], value: str, row_id: Sequence[str], delay: str = "3 days") -> DataFrame:
    """The same totals from event-time state: (keys, day) once the watermark has passed the day.

    A row's copies are dropped while its id is in the state store, days are summed there, and both leave it as
    the watermark, ``delay`` behind the newest row of earlier batches, moves on; so state is bounded by the delay, where the
    tables of ``merge_batch`` grow. Rows behind the watermark count in no total (see ``run_event_time``).
    """
    once = rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(row_id))
    totals = once.groupBy(F.window(ts, "1 day").alias("_w"), *keys).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(value).alias("total"))
    return totals.select(*keys, F.to_date("_w.start").alias("day"), "n_rows", "total")


def run_event_time(totals: DataFrame, out: str, checkpoint: str) -> int:
    """Append the days that are closed now; returns the rows that came behind the watermark.

    State, offsets and the watermark are in the checkpoint: a later run goes on where this one stopped, and a run that
    failed is repeated without a row twice.
    """
    writer = totals.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])
