"""Lag, position and interpolation over one very long series, without a task that sees all of it.

A window without a key, or over one key that holds most rows, runs in one task.
Here rows are range-partitioned in their order and written with the number of
their partition; every window then runs inside partitions, and what it needs from
beyond a border (the last values before it, the next known one behind it, the rows
so far) is carried across by a scan over one row per partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daybook.session import shared_folder

PART, AT = "_part", "_at"


def lay_out(df: DataFrame, order: Sequence[str], name: str = "ordered") -> DataFrame:
    """The rows in ranges of ``order``, written, with the columns the functions below work by.

    ``order`` should tell rows apart: rows that are equal in it share a partition.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # A partition's number is above the low 33 bits, a row's place in it is in them.
    placed = ranged.withColumn(AT, F.monotonically_increasing_id()).withColumn(PART, F.shiftright(AT, 33).cast("int"))
    path = shared_folder(df.sparkSession, name)
    placed.write.parquet(path)
    return df.sparkSession.read.schema(placed.schema).parquet(path)


def _inside():
    return W.partitionBy(PART).orderBy(AT)


def _borders(rows: DataFrame, **of: Column) -> DataFrame:
    """One row per partition."""
    return rows.groupBy(PART).agg(*[c.alias(n) for n, c in of.items()])


def _join(rows: DataFrame, borders: DataFrame, *columns: Column) -> DataFrame:
    return rows.join(F.broadcast(borders.select(PART, *columns)), PART)


def indexed(rows: DataFrame, name: str = "idx") -> DataFrame:
    """Position from 0."""
    borders = _borders(rows, _n=F.count(F.lit(1)), _first=F.min(AT))
    before = F.sum("_n").over(W.orderBy(PART).rowsBetween(W.unboundedPreceding, -1))
    joined = _join(rows, borders, (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_base"))
    return joined.withColumn(name, F.col(AT) + F.col("_base")).drop("_base")


def lagged(rows: DataFrame, value: str, k: int, name: str) -> DataFrame:
    """The value ``k`` rows back, NULL on the first ``k`` rows."""
    behind = F.row_number().over(W.partitionBy(PART).orderBy(F.col(AT).desc()))
    tails = rows.select(PART, AT, F.struct(F.col(AT).alias("at"), F.col(value).alias("v")).alias("_z"), behind.alias("_b")).filter(F.col("_b") <= k)
    borders = _borders(tails, _tail=F.array_sort(F.collect_list("_z")))
    # Every partition has a row at least, so the last k of the k partitions before hold enough.
    carried = F.flatten(F.collect_list("_tail").over(W.orderBy(PART).rowsBetween(-k, -1)))
    joined = rows.withColumn("_i", F.row_number().over(_inside()) - 1).withColumn("_own", F.lag(value, k).over(_inside()))
    joined = _join(joined, borders, carried.alias("_carried"))
    from_end = F.size("_carried") - k + F.col("_i")
    other = F.when(from_end >= 0, F.get("_carried", from_end)["v"])
    return joined.withColumn(name, F.when(F.col("_i") >= k, F.col("_own")).otherwise(other)).drop("_i", "_own", "_carried")


def differenced(rows: DataFrame, value: str, name: str = "diff") -> DataFrame:
    """The step from the row before; NULL on the first row."""
    return lagged(rows, value, 1, "_before").withColumn(name, F.col(value) - F.col("_before")).drop("_before")


def changed(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Whether the value differs from the row before; NULL on the first row."""
    return lagged(rows, value, 1, "_before").withColumn(name, F.col(value) != F.col("_before")).drop("_before")


def interpolated(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Linear by position between known values; the tail repeats the last one; the head stays NULL."""
    out = indexed(rows, "_i")
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(value).cast("double").alias("v")))
    out = out.withColumn("_k", known)
    borders = _borders(out, _last=F.max_by("_k", F.when(F.col("_k").isNotNull(), F.col(AT))), _first=F.min_by("_k", F.when(F.col("_k").isNotNull(), F.col(AT))))
    back = W.orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    ahead = W.orderBy(F.col(PART).desc()).rowsBetween(W.unboundedPreceding, -1)
    upto = _inside().rowsBetween(W.unboundedPreceding, 0)
    onward = W.partitionBy(PART).orderBy(F.col(AT).desc()).rowsBetween(W.unboundedPreceding, 0)
    out = out.withColumns({"_lo": F.last("_k", True).over(upto), "_hi": F.last("_k", True).over(onward)})
    out = _join(out, borders, F.last("_last", True).over(back).alias("_before"), F.last("_first", True).over(ahead).alias("_after"))
    out = out.withColumns({"_lo": F.coalesce("_lo", "_before"), "_hi": F.coalesce("_hi", "_after")})
    lo, hi = F.col("_lo"), F.col("_hi")
    part = (F.col("_i") - lo["i"]) / (hi["i"] - lo["i"])
    filled = (
        F.when(F.col("_k").isNotNull(), F.col("_k.v"))
        .when(hi.isNull(), lo["v"])
        .when(lo.isNotNull(), lo["v"] + (hi["v"] - lo["v"]) * part)
    )
    return out.withColumn(name, filled).drop("_i", "_k", "_lo", "_hi", "_before", "_after")
