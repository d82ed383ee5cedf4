"""Versioned loads: a table of many resources that readers only ever see whole.

Every resource of a load goes to a folder of its own. A version is a manifest (one
row per resource: digest, folder, rows, the version that wrote it), written
last; it counts once Spark's committer has left its success file. A load that
fails, or is killed, leaves folders that no manifest names, and readers stay with
the version before. A resource whose digest is that of the version before is not
read again: its row is carried over.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.sources import sinks

MANIFEST = "resource string, digest string, folder string, n_rows long, version int"
Resource = tuple[str, Callable[[], DataFrame]]


def _paths(spark: SparkSession, pattern: str) -> list:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return list(found or [])


def file_digest(spark: SparkSession, pattern: str) -> str:
    """A digest of a landed resource from its listing alone: names, sizes and times of the files a pattern matches."""
    seen = sorted(f"{s.getPath().getName()}:{s.getLen()}:{s.getModificationTime()}" for s in _paths(spark, pattern))
    return hashlib.sha256("\n".join(seen).encode()).hexdigest()


def version(spark: SparkSession, root: str) -> int:
    """The newest whole version, 0 if there is none."""
    done = _paths(spark, f"{root}/manifest/version=*/_SUCCESS")
    return max((int(s.getPath().getParent().getName().partition("=")[2]) for s in done), default=0)


def manifest(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """One row per resource of a version, by default the newest."""
    number = version(spark, root) if number is None else number
    if not number:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest/version={number}")


def load(spark: SparkSession, root: str, resources: Mapping[str, Resource]) -> int:
    """Write a new version from digests and readers by resource name; returns its number, or the old one if nothing changed.

    Resources that are no longer named leave the table. Only readers of changed resources are called.
    """
    before = version(spark, root)
    old = {r.resource: r for r in manifest(spark, root, before).collect()}  # a row per resource
    rows = []
    for name, (digest, reader) in resources.items():
        if name in old and old[name].digest == digest:
            rows.append(tuple(old[name]))
            continue
        folder = f"data/{name}-{uuid.uuid4().hex}"
        rows.append((name, digest, folder, sinks.replace(reader(), f"{root}/{folder}"), before + 1))
    if before and {r[:3] for r in rows} == {tuple(r)[:3] for r in old.values()}:
        return before
    # A manifest that a killed load began has no success file; overwriting it is safe.
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/version={before + 1}")
    return before + 1


def read(spark: SparkSession, root: str, number: int | None = None) -> DataFrame | None:
    """The rows of a version, with their ``resource``; None if it has no resources."""
    rows = sorted(manifest(spark, root, number).collect())
    frames = [spark.read.parquet(f"{root}/{r.folder}").withColumn("resource", F.lit(r.resource)) for r in rows]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None
