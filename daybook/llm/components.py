"""Connected components of links between 64-bit nodes, by hooking, pointer jumping and contraction.

Every table of a round is written to the shared folder, so a round costs its
own links only. A node that touches a large part of all links is never grouped
in one task: minima are partial aggregates, and joins against the written
parent table can split a hot key or broadcast the parents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.store import cut


def _canonical(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()


def _compressed(parents: DataFrame) -> DataFrame:
    """Every node's parent replaced by the end of its chain; parents are never above their nodes."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
        jumped = cut(
            parents.join(up, "parent").select("node", F.col("_up").alias("parent"), (F.col("_up") != F.col("parent")).alias("moved")),
            "parents",
        )
        parents = jumped.select("node", "parent")
        if jumped.where("moved").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node of the links ``a, b``; the root is the smallest node that can be reached."""
    links = cut(_canonical(links), "links")
    labels = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_least"))
        parents = _compressed(cut(parents.select("node", F.least("node", "_least").alias("parent")), "parents"))
        if labels is None:
            labels = parents.withColumnRenamed("parent", "root")
        else:
            up = parents.select(F.col("node").alias("root"), "parent")
            labels = cut(labels.join(up, "root", "left").select("node", F.coalesce("parent", "root").alias("root")), "labels")
        a = parents.select(F.col("node").alias("a"), F.col("parent").alias("_a"))
        b = parents.select(F.col("node").alias("b"), F.col("parent").alias("_b"))
        links = cut(_canonical(links.join(a, "a").join(b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))), "links")
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
