"""Experiment records and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the flat experiment log, in order (fixed values).
LOG_COLUMNS = (
    "timestamp", "experiment", "seed", "feature_set", "models", "oof_balanced_accuracy",
    "oof_balanced_accuracy_before_bias", "per_class_recall_galaxy", "per_class_recall_qso",
    "per_class_recall_star", "lgb_oof_ba", "xgb_oof_ba", "cat_oof_ba", "blend_weights",
    "class_bias", "no_bias", "submission", "public_lb", "notes",
)

RECORD = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("experiment", T.StringType()),
        T.StructField("seed", T.LongType()),
        T.StructField("feature_set", T.StringType()),
        T.StructField("models", T.StringType()),
        T.StructField("oof_balanced_accuracy", T.DoubleType()),
        T.StructField("oof_balanced_accuracy_before_bias", T.DoubleType()),
        T.StructField("per_class_recall", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("lgb_oof_ba", T.DoubleType()),
        T.StructField("xgb_oof_ba", T.DoubleType()),
        T.StructField("cat_oof_ba", T.DoubleType()),
        T.StructField("weights", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("class_bias", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("no_bias", T.BooleanType()),
        T.StructField("submission", T.StringType()),
        T.StructField("public_lb", T.DoubleType()),
        T.StructField("notes", T.StringType()),
    ]
)


def append_experiment(records: DataFrame, path: str) -> None:
    """Append records as JSON lines; a missing timestamp becomes the current time."""
    if "timestamp" in records.columns:
        stamped = records.withColumn(
            "timestamp", F.coalesce("timestamp", F.current_timestamp().cast("string"))
        )
    else:
        stamped = records.withColumn("timestamp", F.current_timestamp().cast("string"))
    stamped.write.mode("append").json(path)


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).json(path)


def parse_experiments(df: DataFrame, col: str) -> DataFrame:
    """Records held as JSON text in a column."""
    return df.select(F.from_json(col, RECORD).alias("r")).select("r.*")


def flatten_experiments(df: DataFrame) -> DataFrame:
    """Nested records to the flat log columns; absent values become empty text."""

    def text(c):
        return F.coalesce(c.cast("string"), F.lit(""))

    special = {
        "per_class_recall_galaxy": text(F.col("per_class_recall")["GALAXY"]),
        "per_class_recall_qso": text(F.col("per_class_recall")["QSO"]),
        "per_class_recall_star": text(F.col("per_class_recall")["STAR"]),
        "blend_weights": F.when(F.size("weights") > 0, F.to_json("weights")).otherwise(""),
        "class_bias": F.coalesce(F.to_json("class_bias"), F.lit("{}")),
    }
    return df.select(
        *[special[c].alias(c) if c in special else text(F.col(c)).alias(c) for c in LOG_COLUMNS]
    )


def log_line(col: str | Column = "value") -> Column:
    """The ``data`` field of a JSON line, else the raw line."""
    value = F.col(col) if isinstance(col, str) else col
    trimmed = F.regexp_replace(F.trim(value), r"^\[|^,|,$|\]$", "")
    return F.coalesce(F.get_json_object(trimmed, "$.data"), value)


def log_lines(col: str = "value") -> Column:
    """All entries of one line: a JSON list gives one per member, anything else gives one."""
    value = F.trim(col)
    members = F.from_json(value, "array<string>")
    listed = value.startswith("[") & value.endswith("]") & (F.size(members) > 0)
    entries = F.transform(members, lambda m: F.coalesce(F.get_json_object(m, "$.data"), m))
    return F.when(listed, entries).otherwise(F.array(log_line(col)))


def read_mixed_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON console streams, JSON lines and plain text in one reader, one row per entry."""
    lines = spark.read.text(path)
    return lines.select(
        F.input_file_name().alias("file"), F.explode(log_lines()).alias("line")
    ).where(F.trim("line") != "")
