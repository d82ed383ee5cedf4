"""A Merkle manifest of a dataset: leaf, subtree and root digests, and a proof for every row.

A leaf is the digest of a row's columns. Rows of a group stand in key order, and
every ``FANOUT`` consecutive nodes become one parent until one node remains, the
group's subroot; subroots, in group order, become the root the same way.

Slot pivot: a parent's children are spread into ``FANOUT`` columns by conditional
aggregates, one group per parent, so no group has more rows than that, however
many rows a source holds. The columns in a row, concatenated, hash to the parent;
all but one of them are that child's siblings. On the way down each child takes
its siblings and its parent's path, so a leaf's path needs joins of parents only,
a sixteenth of the rows.

Places in a group come from range partitions: a row's place in its sorted
partition, moved by the counts of the group's earlier partitions, of which there
is one row per partition and group.

Null columns count as ``-``, a null group is a group of its own and comes first,
null keys sort first. Rows of one group and key stand in the order of their
digests; equal rows are leaves of their own, each with a proof. Texts of any
length are only hashed. An empty table gives an empty result. Columns that aren't
named are not read, so their names don't matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.store import cut, place

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:string,right:string>>"


def digest(values: Sequence[Column]) -> Column:
    """Lower-case hex SHA-256 of the values' concatenation, nulls left out."""
    return F.sha2(F.concat_ws("", *values), 256)


def field(value: Column) -> Column:
    """A value as part of a leaf: ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: Sequence[Column]) -> Column:
    return digest([field(c) for c in columns])


def ranked(rows: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """The rows with ``pos`` (from 0 in their group) and ``size`` (rows of the group)."""
    by = [group, *order, "_place"]
    ranged = rows.withColumn("_place", place()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_place")
    # The number of a row in its sorted partition is in the low 33 bits, the partition's number above them.
    written = cut(ranged.withColumn("_at", place()), name).withColumn("_part", F.shiftright("_at", 33))
    parts = written.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(group)
    earlier = F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(group, "_part", (F.coalesce(earlier, F.lit(0)) - F.col("_first")).alias("_base"), F.sum("_n").over(whole).alias("size"))
    return written.join(parts, [group, "_part"]).withColumn("pos", F.col("_at") + F.col("_base")).drop("_at", "_part", "_base")


# Expressions over the slot columns are built as text: hundreds of column objects would cost the driver seconds a level.
_SPREAD = [f"max(IF(pos % {FANOUT} = {i}, node, NULL)) AS c{i}" for i in range(FANOUT)]
_HASHES = [f"c{i}.hash" for i in range(FANOUT)]


def _joined(hashes: Sequence[str]) -> str:
    return f"concat_ws('', {', '.join(hashes)})" if hashes else "''"


_CHILDREN = [
    f"IF(c{i} IS NULL, NULL, named_struct('node', c{i}, 'sides', named_struct('left', {_joined(_HASHES[:i])}, 'right', {_joined(_HASHES[i + 1 :])})))"
    for i in range(FANOUT)
]


def families(nodes: DataFrame) -> DataFrame:
    """One row per parent: ``tree``, ``pos``, ``size`` of its level, its children as columns, its ``hash``."""
    parents = nodes.groupBy("tree", "size", F.expr(f"pos div {FANOUT}").alias("_parent")).agg(*map(F.expr, _SPREAD))
    return parents.selectExpr(
        "tree",
        "_parent AS pos",
        f"(size + {FANOUT - 1}) div {FANOUT} AS size",
        *[f"c{i}" for i in range(FANOUT)],
        f"sha2({_joined(_HASHES)}, 256) AS hash",
    )


def grow(nodes: DataFrame, largest: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """All levels of parents above the nodes, lowest first, and every tree's root with its height.

    ``nodes`` has ``tree``, ``pos``, ``size`` and ``node``, a struct with a ``hash``; ``largest`` is the most nodes of a tree.
    """
    levels: list[DataFrame] = []
    alone = nodes.where("size = 1")
    roots = alone.select("tree", F.col("node.hash").alias("hash"), F.lit(0).alias("height"))
    while largest > 1:
        level = cut(families(nodes.where("size > 1")), f"{name}-{len(levels) + 1}")
        levels.append(level)
        largest = -(-largest // FANOUT)
        nodes = level.select("tree", "pos", "size", F.struct("hash").alias("node"))
        roots = roots.unionByName(level.where("size = 1").select("tree", "hash", F.lit(len(levels)).alias("height")))
    return levels, roots


def descend(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Every leaf's ``node`` with its ``path``: siblings to its left and right, from its own level upwards.

    ``tops`` has ``tree``, ``height``, ``path`` (what follows above the tree's root) and the carried columns.
    """
    paths = None
    for k in range(len(levels), 0, -1):
        top = tops.where(F.col("height") == k).select("tree", F.lit(0).cast("long").alias("pos"), "path", *carry)
        above = top if paths is None else paths.select("tree", "pos", "path", *carry).unionByName(top)
        exploded = levels[k - 1].join(above, ["tree", "pos"]).selectExpr("tree", "pos", "path", *carry, f"posexplode(array({', '.join(_CHILDREN)})) AS (_slot, _child)")
        paths = exploded.where(F.col("_child").isNotNull()).select(
            "tree",
            (F.col("pos") * FANOUT + F.col("_slot")).alias("pos"),
            F.concat(F.array("_child.sides"), "path").cast(_PATH).alias("path"),
            F.col("_child.node").alias("node"),
            *carry,
        )
    alone = leaves.where("size = 1").join(tops.where("height = 0"), "tree").select("tree", "path", "node", *carry)
    return alone if paths is None else paths.select("tree", "path", "node", *carry).unionByName(alone)


def proof(path: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return digest([F.flatten(F.transform(path, lambda p: F.array(p["left"], p["right"])))])


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda node, p: F.sha2(F.concat(p["left"], node, p["right"]), 256))


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None, key: str = "doc_id", group: str = "source", columns: Sequence[str] = COLUMNS) -> DataFrame:
    """Per row its key, ``leaf``, ``subroot``, ``root``, ``path``, ``proof_sha256``, ``folded_root`` and ``verified``.

    ``tampered`` gives, by column, another value to fold the proof with; where all
    values stay the same, the leaf does, and the fold gives the root.
    """
    own = [F.col(f"`{c}`") for c in columns]
    other = [(tampered or {}).get(c, o) for c, o in zip(columns, own, strict=True)]
    # Null first, then the bytes' order.
    tree = F.coalesce(F.concat(F.lit("1"), F.col(f"`{group}`").cast("string")), F.lit("0"))
    leaves = cut(docs.select(F.col(f"`{key}`").alias("key"), tree.alias("tree"), leaf(own).alias("hash"), leaf(other).alias("altered")), "leaves")
    placed = ranked(leaves, "tree", ["key", "hash"], "leaf-places")
    nodes = placed.select("tree", "pos", "size", F.struct("hash", "key", "altered").alias("node"))
    # One number each for the driver: the height of the loops.
    sizes = leaves.groupBy("tree").count().agg(F.max("count"), F.count(F.lit(1))).first()
    levels, subroots = grow(nodes, sizes[0] or 0, "tree")
    subroots = subroots.select(F.col("tree").alias("group"), "hash", "height", F.lit(0).alias("tree"))
    stems = ranked(cut(subroots, "subroots"), "tree", ["group"], "subroot-places")
    stems = stems.select("tree", "pos", "size", F.struct("hash", "group", "height").alias("node"))
    upper, roots = grow(stems, sizes[1] or 0, "root")
    found = roots.first()
    root = F.lit(found.hash if found else None).cast("string")
    tops = descend(stems, upper, roots.select("tree", "height", F.array().cast(_PATH).alias("path")))
    tops = tops.select(F.col("node.group").alias("tree"), F.col("node.height").alias("height"), "path", F.col("node.hash").alias("subroot"))
    out = descend(nodes, levels, cut(tops, "subroot-paths"), ["subroot"])
    folded = out.select(
        F.col("node.key").alias(key),
        F.col("node.hash").alias("leaf"),
        "subroot",
        root.alias("root"),
        "path",
        proof(F.col("path")).alias("proof_sha256"),
        fold(F.col("node.altered"), F.col("path")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
