"""Blending, averaging and diagnosing many models at once on the long predictions table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktab.functions.exprs import total
from sparktab.functions.proba import BLEND_BOUNDS, SAVE_BOUNDS, normalize_parts, parts
from sparktab.operators.ranks import exact_quantiles


def _model_weight(weights: dict[str, float]) -> Column:
    w = F.lit(None).cast("double")
    for model, value in weights.items():
        w = F.when(F.col("model") == model, F.lit(float(value))).otherwise(w)
    return w


def blend(
    preds: DataFrame, weights: dict[str, float], k: int, by: Sequence[str] = ("id",),
    keep: Sequence[str] = ("y",), bounds=BLEND_BOUNDS,
) -> DataFrame:
    """Weighted mean over models per key, clipped and normalized.

    A zero total weight means a plain mean. One aggregation of the long table; partial sums
    combine before the shuffle.
    """
    size = sum(weights.values())
    used = weights if size > 0 else dict.fromkeys(weights, 1.0)
    size = sum(used.values())
    used = {m: w for m, w in used.items() if w}
    rows = preds.where(F.col("model").isin(list(used)))
    w = _model_weight(used) / F.lit(size)
    sums = [F.sum(w * c).alias(f"__p{i}") for i, c in enumerate(parts("p", k))]
    mixed = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.first(c, ignorenulls=True).alias(c) for c in keep],
        *sums,
    )
    whole = mixed.where(F.col("__n") == len(used))
    p = normalize_parts([F.col(f"__p{i}") for i in range(k)], bounds)
    return whole.select(*by, *keep, F.array(*p).alias("p"))


def average(preds: DataFrame, k: int, by: Sequence[str] = ("model", "id"), keep: Sequence[str] = ("y",)) -> DataFrame:
    """Mean vector over everything not in ``by``: seeds, or folds of a test set."""
    means = preds.groupBy(*by).agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in keep],
        *[F.avg(c).alias(f"__p{i}") for i, c in enumerate(parts("p", k))],
    )
    return means.select(*by, *keep, F.array(*[F.col(f"__p{i}") for i in range(k)]).alias("p"))


def combine_binary(binary: DataFrame, k: int, by: Sequence[str] = ("id",), cls: str = "positive", p: str = "p1") -> DataFrame:
    """One-vs-rest rows ``(key, class, probability)`` to one normalized vector per key."""
    wide = binary.groupBy(*by).agg(
        *[F.max(F.when(F.col(cls) == c, F.col(p))).alias(f"__p{c}") for c in range(k)]
    )
    made = normalize_parts([F.col(f"__p{c}") for c in range(k)], SAVE_BOUNDS)
    return wide.select(*by, F.array(*made).alias("p"))


def disagreement(preds: DataFrame, k: int, by: Sequence[str] = ("id",)) -> DataFrame:
    """Mean over classes of the population variance across members."""
    spread = [F.var_pop(c).alias(f"__v{i}") for i, c in enumerate(parts("p", k))]
    return preds.groupBy(*by).agg(*spread).select(
        *by, (total([F.col(f"__v{i}") for i in range(k)]) / k).alias("u")
    )


def patch_tail(
    df: DataFrame, k: int, q: float, alpha: float, p: str = "p", fallback: str = "fallback", u: str = "u",
    cut: float | None = None,
) -> DataFrame:
    """Rows with ``u`` at or above its quantile ``q`` are mixed with the members' mean."""
    if cut is None:
        cut = exact_quantiles(df, [u], [q])[u][0]
    mix = [
        (1 - alpha) * a + alpha * b for a, b in zip(parts(p, k), parts(fallback, k))
    ]
    return df.withColumn(
        p, F.when(F.col(u) >= F.lit(cut), F.array(*mix)).otherwise(F.col(p))
    )
