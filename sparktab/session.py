"""Session settings and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators rely on. Broadcasts are never hinted on data
# that grows: adaptive execution broadcasts a side only after measuring it, and
# splits partitions that one hot key makes too large.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.session.timeZone": "UTC",
}


_owned: set[str] = set()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings above to a session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. A temporary folder is used
    only on a local master, where every task sees the same disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = os.path.join(tempfile.gettempdir(), f"sparktab-{spark.sparkContext.applicationId}")
    os.makedirs(folder, exist_ok=True)
    return folder


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path for a written intermediate. All of an application's lie in one folder, which
    ``clear_scratch`` deletes; that happens by itself when the driver's Python ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/sparktab-{spark.sparkContext.applicationId}"
    if folder not in _owned:
        _owned.add(folder)
        atexit.register(_delete, spark, folder)
    return f"{folder}/{tag}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediates of the application; tables that were read from them are gone then."""
    for folder in list(_owned):
        _delete(spark, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    _owned.discard(folder)
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the session has ended; the folder's owner clears it
        pass


def materialize(df: DataFrame, tag: str = "stage", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage of iterative work; unlike cached blocks the table outlives
    lost executors.
    """
    path = scratch_path(df.sparkSession, tag)
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """At least one partition per core, for heavy per-row work on a few large files.

    For tables as read: asking a plan with shuffles for its partitions would run them.
    Never lowers the number: a scan with more splits than cores passes through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
