"""Category vocabularies, frequencies and codes learned from one frame, applied to others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparktab.functions.codes import cross, token
from sparktab.operators.joins import lookup, lookup_values, packed_stats
from sparktab.operators.ranks import (
    ROWS_PER_BUCKET,
    range_bucket,
    running_sums,
    split_points,
    text_bucket,
    text_points,
)
from sparktab.session import materialize


def _union(frames: Sequence[DataFrame], col: str) -> DataFrame:
    out = frames[0].select(token(F.col(col)).alias(col))
    for f in frames[1:]:
        out = out.unionByName(f.select(token(F.col(col)).alias(col)))
    return out


def sorted_vocabulary(
    frames: Sequence[DataFrame], col: str, out: str = "code", rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Distinct values of all frames with codes 0.. in sorted order.

    The values are written once. Up to one bucket they are numbered directly; beyond it they
    are cut into even text ranges, each numbered on its own.
    """
    values = materialize(_union(frames, col).distinct(), "vocabulary")
    n = values.count()
    if n <= rows_per_bucket:
        place = F.row_number().over(Window.orderBy(col)).cast("long")
        return values.select(col, (place - 1).alias(out))
    points = text_points(values, col, n, rows_per_bucket)
    placed = values.withColumn("__b", text_bucket(col, points))
    return running_sums(placed, [], ["__b"], [col], {out: F.lit(1)}).select(
        col, (F.col(out) - 1).alias(out)
    )


def label_encode(
    frames: Sequence[DataFrame], col: str, out: str | None = None
) -> list[DataFrame]:
    """Shared sorted codes over all frames (train, validation, test)."""
    out = out or f"{col}_code"
    vocab = sorted_vocabulary(frames, col, out)
    return [apply_codes(f, vocab, col, out, -1) for f in frames]


def apply_codes(df: DataFrame, vocab: DataFrame, col: str, out: str, unknown: int) -> DataFrame:
    keyed = df.withColumn("__t", token(F.col(col)))
    return lookup(keyed, vocab.withColumnRenamed(col, "__t"), "__t", {out: unknown}).drop("__t")


def factorize(
    fit: DataFrame, apply: DataFrame, col: str, key: str, out: str | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Codes by first appearance (smallest key) in ``fit``; unseen values and nulls -1."""
    out = out or f"{col}_code"
    firsts = materialize(
        fit.where(F.col(col).isNotNull()).groupBy(col).agg(F.min(key).alias("__first")), "firsts"
    )
    n = firsts.count()
    if n <= rows_per_bucket:
        place = F.row_number().over(Window.orderBy("__first")).cast("long")
        codes = firsts.select(col, (place - 1).alias(out))
    else:
        timed = firsts.withColumn("__v", F.col("__first").cast("double"))
        placed = range_bucket(timed, "__v", split_points(timed, "__v", rows_per_bucket, n), "__b")
        codes = running_sums(placed, [], ["__b"], ["__first"], {out: F.lit(1)}).select(
            col, (F.col(out) - 1).alias(out)
        )
    return lookup(apply, codes, col, {out: -1})


def frequency_codes(
    fit: DataFrame, apply: DataFrame, col: str, min_count: int, out: str | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Codes 1.. by falling count (ties by value); rare and unseen values 0."""
    out = out or f"{col}_freq_code"
    counts = materialize(
        fit.groupBy(token(F.col(col)).alias(col))
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") >= min_count),
        "counts",
    )
    n = counts.count()
    if n <= rows_per_bucket:
        place = F.row_number().over(Window.orderBy(F.col("__n").desc(), col)).cast("long")
        ranked = counts.select(col, place.alias(out))
    else:
        # Small counts hold most values: one bucket per count, cut into text ranges. Larger
        # counts share logarithmic buckets, where the count itself orders the values.
        points = text_points(counts, col, n, rows_per_bucket)
        small = F.col("__n") < 64
        placed = counts.withColumns(
            {
                "__down": F.when(small, -F.col("__n")).otherwise(
                    -64 - F.floor(8 * F.log2(F.col("__n")))
                ),
                "__b": F.when(small, text_bucket(col, points)).otherwise(0),
            }
        )
        order = [F.col("__n").desc(), col]
        ranked = running_sums(placed, [], ["__down", "__b"], order, {out: F.lit(1)})
    return apply_codes(apply, ranked.select(col, out), col, out, 0)


def cardinality(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> DataFrame:
    """``(column, n_distinct)`` for many columns.

    Exact counts are one two-step aggregation over (column, value) pairs instead of one
    expanded aggregation per column.
    """
    if approximate:
        row = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols])
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_distinct")) for c in cols])
        return row.select(F.inline(pairs))
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols])
    ).alias("pair")
    return (
        df.select(pairs).select("pair.*").groupBy("column", "v").agg(F.lit(1).alias("one"))
        .groupBy("column").agg(F.count("v").alias("n_distinct"))
    )


# Name families of encodable categories: exact names, endings, parts (fixed values).
FAMILIES = {
    "core": (
        (
            "spectral_type", "galaxy_population", "spectral_type_calc", "galaxy_population_calc",
            "spectral_x_pop", "spectral_calc_x_pop_calc",
        ),
        ("_qbin16", "_qbin64"),
        ("_rkey", "__x__"),
    ),
    "qbin16": (
        ("spectral_type", "galaxy_population", "spectral_type_calc", "galaxy_population_calc"),
        ("_qbin16",),
        (),
    ),
}


def in_family(name: str, family: str | None) -> bool:
    """A named family, or any other text as a prefix; None takes every column."""
    if family is None:
        return True
    if family not in FAMILIES:
        return name.startswith(family)
    names, endings, inner = FAMILIES[family]
    return name in names or name.endswith(endings) or any(p in name for p in inner)


def cardinality_select(
    df: DataFrame, cols: Sequence[str], max_card: int, family: str | None = None,
    approximate: bool = False,
) -> list[str]:
    """Columns of a name family with at most ``max_card`` distinct values."""
    picked = [c for c in cols if c in df.columns and in_family(c, family)]
    if not picked:
        return []
    rows = cardinality(df, picked, approximate).where(F.col("n_distinct") <= max_card).collect()
    small = {r["column"] for r in rows}
    return [c for c in picked if c in small]


def frequency_encode(fit: DataFrame, apply: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Share of ``fit`` rows that hold the value; unseen values 0."""
    out = out or f"{col}_freq"
    rows = max(fit.count(), 1)
    shares = fit.groupBy(token(F.col(col)).alias("__t")).agg(
        (F.count(F.lit(1)) / F.lit(rows)).alias(out)
    )
    keyed = apply.withColumn("__t", token(F.col(col)))
    return lookup(keyed, materialize(shares, "stats"), "__t", {out: 0.0}).drop("__t")


def joint_frequency_encode(
    fit: DataFrame, apply: DataFrame, cols: Sequence[str], out: str
) -> DataFrame:
    """Frequency of the cross of ``cols``; the cross itself is dropped."""
    made = cross([F.col(c) for c in cols])
    return frequency_encode(
        fit.withColumn("__cross", made), apply.withColumn("__cross", made), "__cross", out
    ).drop("__cross")


def count_encode(
    frames: Sequence[DataFrame], apply: DataFrame, cols: Sequence[str], packed: bool | None = None
) -> DataFrame:
    """Count, log1p(count) and share over all ``frames``; unseen values 0.

    One aggregation counts all columns; columns too large to broadcast share one packed join.
    """
    rows = max(sum(f.count() for f in frames), 1)
    keys = {c: f"__t{i}" for i, c in enumerate(cols)}
    tokens = [f.select(*[token(F.col(c)).alias(k) for c, k in keys.items()]) for f in frames]
    every = tokens[0]
    for f in tokens[1:]:
        every = every.unionByName(f)
    counts = packed_stats(every, list(keys.values()), [F.count(F.lit(1)).alias("__n")])
    named = {k: counts[k].withColumnRenamed("__n", f"{c}_count") for c, k in keys.items()}
    keyed = apply.withColumns({k: token(F.col(c)) for c, k in keys.items()})
    out = lookup_values(keyed, named, {f"{c}_count": 0 for c in cols}, packed=packed).drop(*keys.values())
    made = {}
    for c in cols:
        made |= {
            f"{c}_count": F.col(f"{c}_count"),
            f"{c}_log_count": F.log1p(F.col(f"{c}_count")),
            f"{c}_share": F.col(f"{c}_count") / F.lit(rows),
        }
    return out.select(*[c for c in apply.columns if c not in made], *[v.alias(n) for n, v in made.items()])


def levels(df: DataFrame, col: str, max_levels: int = 10) -> list:
    """Sorted distinct values, refused when there are more than ``max_levels``."""
    found = df.select(col).where(F.col(col).isNotNull()).distinct().limit(max_levels + 1).collect()
    if len(found) > max_levels:
        raise ValueError(f"{col} has more than {max_levels} levels")
    return sorted(r[0] for r in found)


def value_ranks(df: DataFrame, col: str, out: str = "rank") -> DataFrame:
    """Dense rank of the distinct values on every row."""
    vocab = sorted_vocabulary([df], col, out)
    return apply_codes(df, vocab.withColumn(out, F.col(out) + 1), col, out, 0)


