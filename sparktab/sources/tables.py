"""Labelled tables: reading, cleaning, contracts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktab.functions.codes import token
from sparktab.functions.exprs import finite, total


@dataclass(frozen=True)
class Roles:
    """Which column plays which part."""

    id: str = "id"
    target: str = "class"
    numerics: tuple[str, ...] = ()
    bands: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    classes: tuple[str, ...] = field(default_factory=tuple)

    def schema(self, labelled: bool = True) -> T.StructType:
        """Explicit read schema, so that no pass is spent on inference."""
        fields = [T.StructField(self.id, T.LongType())]
        fields += [T.StructField(c, T.DoubleType()) for c in self.numerics]
        fields += [T.StructField(c, T.StringType()) for c in self.categories]
        if labelled:
            fields.append(T.StructField(self.target, T.StringType()))
        return T.StructType(fields)


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str | None = None
) -> DataFrame:
    """Parquet, CSV or JSON by extension; text formats need a schema."""
    fmt = fmt or ("csv" if ".csv" in path else "json" if ".json" in path else "parquet")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt != "parquet":
        raise ValueError(f"{fmt} tables are read with an explicit schema")
    if fmt == "csv":
        return reader.option("header", True).csv(path)
    return reader.format(fmt).load(path)


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text to double; unreadable text, NaN and infinities to null."""
    return df.withColumns({c: finite(F.col(c).try_cast("double")) for c in cols})


def normalize_category(df: DataFrame, cols: Sequence[str], missing: str = "__NA__") -> DataFrame:
    return df.withColumns({c: token(F.col(c), missing) for c in cols})


def filter_classes(df: DataFrame, target: str, classes: Sequence[str]) -> DataFrame:
    """Upper-cased label, known classes only."""
    return df.withColumn(target, F.upper(target)).where(F.col(target).isin(list(classes)))


def drop_sentinels(df: DataFrame, cols: Sequence[str], lo: float = -100.0, hi: float = 100.0) -> DataFrame:
    """Rows whose ``cols`` all lie strictly inside (lo, hi); a missing value drops the row."""
    keep = F.lit(True)
    for c in cols:
        keep = keep & (F.col(c) > lo) & (F.col(c) < hi)
    return df.where(keep)


def count_sentinels(df: DataFrame, cols: Sequence[str], lo: float = -100.0, hi: float = 100.0) -> DataFrame:
    """Kept and dropped row counts of ``drop_sentinels``."""
    keep = F.lit(True)
    for c in cols:
        keep = keep & (F.col(c) > lo) & (F.col(c) < hi)
    kept = F.count_if(keep)
    return df.agg(kept.alias("kept"), (F.count(F.lit(1)) - kept).alias("dropped"))


def align_to(df: DataFrame, ids: DataFrame, id_col: str, on_missing: str = "null") -> DataFrame:
    """Rows for exactly the answer table's keys.

    ``on_missing='raise'`` makes the query fail when a key has no row; ``'null'`` keeps a
    null row.
    """
    marked = df.withColumn("__hit", F.lit(True))
    out = ids.select(id_col).join(marked, id_col, "left")
    if on_missing == "raise":
        missing = F.raise_error(F.concat(F.lit(f"no row for {id_col} "), F.col(id_col).cast("string")))
        out = out.where(F.when(F.col("__hit"), F.lit(True)).otherwise(missing.cast("boolean")))
    elif on_missing != "null":
        raise ValueError("on_missing must be 'null' or 'raise'")
    return out.drop("__hit")


def check_contract(
    df: DataFrame, key: str, p: str, k: int, by: Sequence[str] = (), tolerance: float = 1e-6,
    n_rows: int | None = None, equal_rows: bool = False,
) -> DataFrame:
    """Per group: rows, distinct keys, vector widths, null and row-sum violations.

    A group is valid if it has none and, where asked, holds ``n_rows`` rows or (``equal_rows``) as
    many as the largest group.

    Distinct keys are counted by a first aggregation on (group, key), which also carries the
    other figures, so a key may repeat any number of times.
    """
    s = F.aggregate(F.col(p), F.lit(0.0), lambda a, x: a + x)
    bad = F.col(p).isNull() | F.exists(F.col(p), lambda x: x.isNull() | F.isnan(x))
    first = df.groupBy(*by, key).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.size(p)).alias("lo"),
        F.max(F.size(p)).alias("hi"),
        F.count_if(bad).alias("bad"),
        F.count_if(~bad & (F.abs(s - 1) > tolerance)).alias("off"),
    )
    found = first.groupBy(*by).agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("keys"),
        F.min("lo").alias("min_width"),
        F.max("hi").alias("max_width"),
        F.sum("bad").alias("null_rows"),
        F.sum("off").alias("bad_sums"),
        ((F.min("lo") == k) & (F.max("hi") == k) & (F.sum("bad") == 0) & (F.sum("off") == 0)
         & (F.sum("n") == F.count(F.lit(1)))).alias("valid"),
    )
    if n_rows is not None:
        found = found.withColumn("valid", F.col("valid") & (F.col("rows") == n_rows))
    if equal_rows:
        most = found.agg(F.max("rows").alias("__most"))
        found = found.join(F.broadcast(most)).withColumn("valid", F.col("valid") & (F.col("rows") == F.col("__most"))).drop("__most")
    return found


def align_columns(a: DataFrame, b: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Columns of both frames that are not text, id or target, in the order of ``a``."""
    other = set(b.columns)
    skip = set(exclude)
    return [
        f.name
        for f in a.schema.fields
        if f.name in other and f.name not in skip and not isinstance(f.dataType, T.StringType)
    ]


def read_pseudo_labels(
    df: DataFrame, classes: Sequence[str], id_col: str = "id", target: str = "class",
    threshold: float = 0.995,
) -> DataFrame | None:
    """``(id, label, conf)`` from either layout; None for an unknown one. A table without ids would
    have to be matched by row order and is refused.

    One probability column per class: rows reaching ``threshold`` stay. ``(id, class)``: all
    rows of known classes stay with confidence 1.
    """
    if id_col not in df.columns:
        raise ValueError(f"pseudo labels need the key column {id_col}; rows have no order to match them by")
    if set(classes) <= set(df.columns):
        probs = [F.col(c).cast("double") for c in classes]
        s = total(probs)
        parts = [c / s for c in probs]
        conf = F.greatest(*parts)
        label = F.when(parts[0] == conf, classes[0])
        for c, e in zip(classes[1:], parts[1:]):
            label = label.when(e == conf, c)
        out = df.select(id_col, label.alias("label"), conf.alias("conf"))
        return out.where(F.col("conf") >= threshold)
    if target in df.columns:
        out = filter_classes(df, target, classes)
        return out.select(id_col, F.col(target).alias("label"), F.lit(1.0).alias("conf"))
    return None
