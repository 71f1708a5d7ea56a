"""The long predictions table: write, read, version, turn into answers.

Layout: ``(model, split, seed, fold, id, y, p array<double>)``, partitioned on disk by
``run, model, split`` so that a reader prunes to the models it names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktab.functions.proba import SAVE_BOUNDS, argmax, normalize_proba
from sparktab.operators.joins import carry_over

SCHEMA = T.StructType(
    [
        T.StructField("seed", T.IntegerType()),
        T.StructField("fold", T.IntegerType()),
        T.StructField("id", T.LongType()),
        T.StructField("y", T.IntegerType()),
        T.StructField("p", T.ArrayType(T.DoubleType())),
        T.StructField("run", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("split", T.StringType()),
    ]
)


def ready_to_save(df: DataFrame, k: int, bounds=SAVE_BOUNDS) -> DataFrame:
    """Clipped and row-normalized probabilities."""
    return df.withColumn("p", normalize_proba("p", k, bounds))


def write_preds(df: DataFrame, path: str, k: int, run: str = "main", bounds=SAVE_BOUNDS) -> None:
    """Overwrite exactly the (run, model, split) partitions that ``df`` holds."""
    out = ready_to_save(df, k, bounds).withColumn("run", F.lit(run))
    for name, kind in (("seed", "int"), ("fold", "int"), ("y", "int")):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    (
        out.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMA.fields])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run", "model", "split")
        .parquet(path)
    )


def read_preds(spark: SparkSession, path: str, run: str = "main") -> DataFrame:
    table = spark.read.schema(SCHEMA).parquet(path)
    return table.where(F.col("run") == run).drop("run")


def load_preds(preds: DataFrame, models: Sequence[str], splits: Sequence[str] = ("oof", "test")) -> DataFrame:
    """Predictions of the named models that have every split and are not all-zero placeholders.

    Absent models are skipped. The check is one aggregation over (model, split).
    """
    picked = preds.where(F.col("model").isin(list(models)) & F.col("split").isin(list(splits)))
    largest = F.array_max(F.transform("p", lambda x: F.abs(x)))
    usable = (
        picked.groupBy("model", "split")
        .agg(F.max(largest).alias("top"))
        .where(F.col("top") > 0)
        .groupBy("model")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") == len(set(splits)))
    )
    # One row per model.
    names = [r["model"] for r in usable.select("model").collect()]
    return picked.where(F.col("model").isin(names))


def snapshot(spark: SparkSession, path: str, tag: str, run: str = "main") -> None:
    """Keep the current predictions under a name."""
    _copy(spark, path, run, tag)


def restore(spark: SparkSession, path: str, tag: str, run: str = "main") -> None:
    """Bring a named version back as the current one; models it lacks are left alone."""
    _copy(spark, path, tag, run)


def _copy(spark: SparkSession, path: str, source: str, target: str) -> None:
    rows = spark.read.schema(SCHEMA).parquet(path).where(F.col("run") == source)
    (
        rows.withColumn("run", F.lit(target))
        .select(*SCHEMA.fieldNames())
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run", "model", "split")
        .parquet(path)
    )


def carry_forward(new: DataFrame, old: DataFrame, expected_rows: int | None = None) -> DataFrame:
    """Models not trained this time keep their earlier predictions if their row count fits."""
    if expected_rows is not None:
        fits = (
            old.groupBy("model", "split").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") == expected_rows).select("model", "split")
        )
        old = old.join(fits, ["model", "split"], "left_semi")
    return carry_over(new, old, ["model"])


def to_answer(df: DataFrame, classes: Sequence[str], id_col: str = "id", target: str = "class") -> DataFrame:
    """Arg-max class as a label per key."""
    labels = F.array(*[F.lit(c) for c in classes])
    return df.select(id_col, labels[argmax("p", len(classes))].alias(target))


def write_answer(df: DataFrame, path: str, classes: Sequence[str], id_col: str = "id", target: str = "class") -> None:
    to_answer(df, classes, id_col, target).write.mode("overwrite").option("header", True).csv(path)
