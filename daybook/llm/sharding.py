"""Sharding by global byte-size prefix sums.

Rows are range-partitioned by key and written with their partition's number.
Each partition adds up its bytes and rows; a prefix sum over those totals, one
row per partition, gives every partition its global offset, and a running sum
inside the partition gives every row its own. Cutting the byte line at equal
targets yields contiguous shards whose sizes differ by a row's size at most.

Only keys, sizes and checksums move; texts stay where they are. The place of a
row in its scan completes the key, so repeated keys or rows, however many,
spread over partitions. Null keys sort first, null texts have no bytes, an
empty table gives an empty result; columns that aren't asked for are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.store import cut, place


def assign(rows: DataFrame, key: str, size: Column, shards: int, carry: dict[str, Column] | None = None) -> DataFrame:
    """``key``, ``size``, the carried columns, ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 in a shard)."""
    slim = rows.select(F.col(key).alias(key), size.cast("long").alias("size"), *[c.alias(n) for n, c in (carry or {}).items()], place().alias("_place"))
    ranged = cut(slim.repartitionByRange(key, "_place").withColumn("_part", F.spark_partition_id()), "shard-sizes")
    totals = ranged.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    # One row per partition: bounded by the number of partitions, whatever the data.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(Window.partitionBy()).alias("_all"),
    )
    inside = Window.partitionBy("_part").orderBy(key, "_place")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.withColumn("_end", F.sum("size").over(upto))
        .withColumn("_row", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "_part")
        .withColumn("_middle", 2 * (F.col("_bytes_before") + F.col("_end")) - F.col("size"))
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"(_middle * {int(shards)}) div greatest(2 * _all, 1)")).cast("int"))
        .withColumn("_row", F.col("_row") + F.col("_rows_before"))
    )
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(
        key, "size", *(carry or {}), "shard", (F.col("_row") - F.col("_first")).cast("long").alias("slot")
    )
