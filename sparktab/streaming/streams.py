"""Fitted transforms and experiment monitoring on unbounded input."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_stream(
    spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet", pattern: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """File source over a folder."""
    reader = spark.readStream.schema(schema).format(fmt)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def score_stream(stream: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Apply fitted transforms in order: row functions, fitted bins, static lookups.

    Everything is stateless; lookups are stream-static joins on fitted tables.
    """
    out = stream
    for step in steps:
        out = step(out)
    return out


def watch_experiments(
    stream: DataFrame, ts: str, key: str, score: str, group: str, width: str = "1 day", delay: str = "2 hours",
) -> DataFrame:
    """Score level per group and time window, duplicates dropped, late rows cut.

    State is bounded by the watermark: keys seen within ``delay`` and windows still open.
    ``ts`` is cast because a watermark needs a zoned timestamp.
    """
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return (
        timed.dropDuplicatesWithinWatermark([key])
        .groupBy(F.window(ts, width), group)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(score).alias("mean_score"),
            F.min(score).alias("min_score"),
            F.max(score).alias("max_score"),
        )
        .select(
            F.col("window.start").alias("start"), group, "n", "mean_score", "min_score", "max_score"
        )
    )


def run_to_table(stream: DataFrame, path: str, state: str, mode: str = "append") -> DataFrame:
    """Process everything available into the table at ``path`` and return the whole table.

    ``state`` is the checkpoint folder: a run with the same two folders continues where the last
    one stopped. In append mode windows that are still open when the input ends are not emitted;
    they come once later rows move the watermark past their end.
    """
    spark = stream.sparkSession
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", state)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
