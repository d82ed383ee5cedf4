"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call-site capture costs several driver round trips for every column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Wide text projections generate methods above 8,000 bytes of code, which the JVM
    # never compiles; below this limit Spark splits them into small functions instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


# A setting for runs over files of a single row group, which one task would read and project alone: rows are
# dealt out to so many tasks after the scan. Unset (the default), no shuffle is added.
INPUT_TASKS = "spark.daybook.inputTasks"

# For a cluster: larger splits and reduce tasks, merged by size rather than spread thin.
CLUSTER_SETTINGS = {
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
}


def shuffle_partitions(input_bytes: int, per_task: int = 512 << 20) -> int:
    """Reduce tasks for a shuffle of the whole input.

    Adaptive execution merges partitions that turn out small but cannot split
    large ones outside joins, so the starting number must fit the widest
    shuffle (the full-row dedupe), not the typical one.
    """
    return max(200, -(-input_bytes // per_task))


def get_session(master: str | None = None, app: str = "daybook", input_bytes: int | None = None, **extra: str) -> SparkSession:
    """A session; give ``input_bytes`` on a cluster to size its shuffles."""
    builder = SparkSession.builder.appName(app)
    if input_bytes is not None:
        extra = {**CLUSTER_SETTINGS, "spark.sql.shuffle.partitions": str(shuffle_partitions(input_bytes)), **extra}
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once a session: Python tasks import it by name.

    The zip lies in the driver's own temporary folder; Spark's file server hands it out.
    """
    context = spark.sparkContext
    if getattr(context, "_daybook_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(context._temp_dir, "daybook_package.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    archive.write(file, os.path.relpath(file, os.path.dirname(top)))
    context.addPyFile(path)
    context._daybook_shipped = True


def pin_session(spark: SparkSession) -> None:
    """The same run-time settings, and the package on the executors, in a session someone else built."""
    ship_package(spark)
    for key in ("spark.sql.session.timeZone", "spark.sql.codegen.hugeMethodLimit"):
        spark.conf.set(key, SETTINGS[key])


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the cluster's checkpoint folder.

    A machine-local folder is only ever used in local mode, where the driver
    and the executors are one process, and only if no folder is set. What a job
    leaves there is kept as long as the folder's own clean-up keeps it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = os.path.join(tempfile.gettempdir(), "daybook")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
