"""Registry and the derived views that several queries share.

The given tables hold no sky survey and no model predictions, so both are derived from
``orders`` by fixed arithmetic, in the same way on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BANDS = ["u", "g", "r", "i", "z"]
RAW = ["alpha", "delta", *BANDS, "redshift"]
CLASSES = ["GALAXY", "QSO", "STAR"]
MODELS = {"m1": (3, 1.5), "m2": (7, 2.0), "m3": (11, 1.0), "m4": (17, 0.5)}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles so that the order of additions does not show; turn -0.0 into 0.0.

    Both sides use the same floating-point steps, since built-in rounding differs on ties.
    """
    unit = F.lit(10.0**digits)
    return df.select(
        *[
            (F.floor(F.col(f.name) * unit + F.lit(0.5)) / unit).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    return f"floor(({expr}) * 1e{digits} + 5e-1) / 1e{digits} + 0e0 AS {name or expr}"


def rs(names, digits: int = 6) -> str:
    return ", ".join(r(n, n, digits) for n in names)


def photo(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled survey-like table over all orders; ``source`` splits it in three."""
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")

    def band(a: int, b: int, m: int, base: float):
        return F.lit(base) + ((k * a + c * b) % m) / F.lit(1000.0)

    return o.select(
        k.alias("id"),
        ((k * 7919) % 36000 / F.lit(100.0)).alias("alpha"),
        ((k * 4729) % 18000 / F.lit(100.0) - F.lit(90.0)).alias("delta"),
        band(31, 17, 6007, 16.0).alias("u"),
        band(37, 13, 5003, 15.5).alias("g"),
        band(41, 11, 4001, 15.0).alias("r"),
        band(43, 7, 3001, 14.75).alias("i"),
        band(47, 5, 2003, 14.5).alias("z"),
        (F.col("o_totalprice") / F.lit(200000.0) - F.lit(0.05)).alias("redshift"),
        F.when(c % 5 == 0, "M").when(c % 5 == 1, "G/K").when(c % 5 == 2, "A/F")
        .when(c % 5 == 3, "O/B").alias("spectral_type"),
        F.when(k % 50 != 0, F.when(c % 3 == 0, "Red_Sequence").otherwise("Blue_Cloud"))
        .alias("galaxy_population"),
        F.when(F.col("o_orderstatus") == "F", "GALAXY").when(F.col("o_orderstatus") == "O", "QSO")
        .otherwise("STAR").alias("class"),
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1)
        .otherwise(2).alias("y"),
        F.when(k % 10 < 6, "train").when(k % 10 < 9, "test").otherwise("aux").alias("source"),
    )


PHOTO = """photo AS (
  SELECT o_orderkey AS id,
    (o_orderkey * 7919) % 36000 / 100e0 AS alpha,
    (o_orderkey * 4729) % 18000 / 100e0 - 90e0 AS delta,
    16e0 + ((o_orderkey * 31 + o_custkey * 17) % 6007) / 1000e0 AS u,
    155e-1 + ((o_orderkey * 37 + o_custkey * 13) % 5003) / 1000e0 AS g,
    15e0 + ((o_orderkey * 41 + o_custkey * 11) % 4001) / 1000e0 AS r,
    1475e-2 + ((o_orderkey * 43 + o_custkey * 7) % 3001) / 1000e0 AS i,
    145e-1 + ((o_orderkey * 47 + o_custkey * 5) % 2003) / 1000e0 AS z,
    o_totalprice / 200000e0 - 5e-2 AS redshift,
    CASE o_custkey % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'G/K' WHEN 2 THEN 'A/F' WHEN 3 THEN 'O/B' END
      AS spectral_type,
    CASE WHEN o_orderkey % 50 <> 0 THEN
      CASE WHEN o_custkey % 3 = 0 THEN 'Red_Sequence' ELSE 'Blue_Cloud' END END AS galaxy_population,
    CASE o_orderstatus WHEN 'F' THEN 'GALAXY' WHEN 'O' THEN 'QSO' ELSE 'STAR' END AS class,
    CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y,
    CASE WHEN o_orderkey % 10 < 6 THEN 'train' WHEN o_orderkey % 10 < 9 THEN 'test' ELSE 'aux' END
      AS source
  FROM orders)"""


def preds(spark: SparkSession, sf: str) -> DataFrame:
    """Long prediction table of four stand-in models over all orders (three classes)."""
    o = table(spark, sf, "orders")
    members = F.explode(
        F.array(
            *[
                F.struct(F.lit(m).alias("model"), F.lit(a).alias("a"), F.lit(s).alias("s"))
                for m, (a, s) in MODELS.items()
            ]
        )
    ).alias("m")
    y = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    base = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"), y.alias("y"),
        (F.col("o_orderkey") % 5).cast("int").alias("fold"), members,
    )
    weights = [
        F.lit(1.0)
        + ((F.col("id") * F.col("m.a") + F.col("c") * 7 + 13 * i) % 101) / F.lit(25.0)
        + F.when(F.col("y") == i, F.col("m.s")).otherwise(F.lit(0.0))
        for i in range(3)
    ]
    w = base.select(
        "id", "y", "fold", F.col("m.model").alias("model"),
        *[e.alias(f"w{i}") for i, e in enumerate(weights)],
    )
    s = F.col("w0") + F.col("w1") + F.col("w2")
    return w.select(
        "model", F.lit("oof").alias("split"), F.lit(42).alias("seed"), "fold", "id", "y",
        F.array(*[F.col(f"w{i}") / s for i in range(3)]).alias("p"),
    )


PREDS = """raw_preds AS (
  SELECT o_orderkey AS id, CAST(o_orderkey % 5 AS INTEGER) AS fold,
    CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y, model,
    1e0 + ((o_orderkey * a + o_custkey * 7) % 101) / 25e0
      + CASE WHEN o_orderstatus = 'F' THEN s ELSE 0e0 END AS w0,
    1e0 + ((o_orderkey * a + o_custkey * 7 + 13) % 101) / 25e0
      + CASE WHEN o_orderstatus = 'O' THEN s ELSE 0e0 END AS w1,
    1e0 + ((o_orderkey * a + o_custkey * 7 + 26) % 101) / 25e0
      + CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN s ELSE 0e0 END AS w2
  FROM orders, (VALUES ('m1', 3, 15e-1), ('m2', 7, 2e0), ('m3', 11, 1e0), ('m4', 17, 5e-1))
    AS m(model, a, s)),
preds AS (
  SELECT model, fold, id, y, w0 / (w0 + w1 + w2) AS p0, w1 / (w0 + w1 + w2) AS p1,
    w2 / (w0 + w1 + w2) AS p2
  FROM raw_preds)"""


def spread(df: DataFrame, col: str = "p", k: int = 3, prefix: str = "p") -> DataFrame:
    """Array column to scalar columns, for comparison with SQL."""
    return df.withColumns({f"{prefix}{i}": F.col(col)[i] for i in range(k)}).drop(col)


def argmax_sql(cols: list[str]) -> str:
    """First position of the largest value."""
    top = f"greatest({', '.join(cols)})"
    cases = " ".join(f"WHEN {c} = {top} THEN {i}" for i, c in enumerate(cols[:-1]))
    return f"CASE {cases} ELSE {len(cols) - 1} END"
