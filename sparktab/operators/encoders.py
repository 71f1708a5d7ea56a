"""Supervised encoders: aggregate per category, join back. All joins go through ``lookup``."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktab.functions.exprs import hash_text
from sparktab.operators.joins import by_column, lookup, lookup_values, packed_stats, packed_table
from sparktab.session import materialize


def _mean(df: DataFrame, y: str) -> float:
    value = df.select(F.avg(F.col(y).cast("double"))).first()[0]
    return 0.0 if value is None else value


def class_shares(df: DataFrame, y: str, k: int) -> list[float]:
    row = df.select(*[F.avg((F.col(y) == c).cast("double")).alias(f"p{c}") for c in range(k)]).first()
    return [row[c] or 0.0 for c in range(k)]


def target_encode(
    fit: DataFrame, apply: DataFrame, cols: Sequence[str], y: str, smoothing: float = 1.0,
    noise: float = 0.0, seed: int = 0, suffix: str = "_te", key: str | None = None, packed: bool | None = None,
) -> DataFrame:
    """``(sum + s*g) / (n + s)`` per category; null and unseen categories get the mean ``g``.

    ``noise`` scales each value by a normal draw of its own, made from the row's ``key``, the
    column and the seed, so it doesn't depend on partitions.
    """
    if noise and key is None:
        raise ValueError("noise needs a key column")
    g = _mean(fit, y)
    stats = packed_stats(fit.select(*dict.fromkeys([*cols, y])), cols, [
        (
            (F.sum(F.col(y).cast("double")) + F.lit(smoothing * g))
            / (F.count(F.lit(1)) + F.lit(float(smoothing)))
        ).alias("__te")
    ])
    named = {c: stats[c].withColumnRenamed("__te", c + suffix) for c in cols}
    out = lookup_values(apply, named, {c + suffix: g for c in cols}, packed=packed)
    if noise:
        drawn = {c + suffix: F.col(c + suffix) * (1 + F.lit(noise) * normal_draw(key, seed + 2 * i)) for i, c in enumerate(cols)}
        out = out.withColumns(drawn)
    return out


def normal_draw(key: str, seed: int) -> Column:
    """A standard normal number for each key and seed, from two md5 values."""
    u, v = (
        (F.conv(F.substring(hash_text(key, s), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(16.0**13)
        for s in (seed, seed + 1)
    )
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.lit(math.pi) * v)


def leave_one_out_encode(
    df: DataFrame, col: str, y: str, smoothing: float = 1.0, out: str | None = None
) -> DataFrame:
    """``(sum - y + s*g) / (n - 1 + s)``: the row's own label is left out."""
    out = out or f"{col}_loo"
    g = _mean(df, y)
    stats = df.where(F.col(col).isNotNull()).groupBy(col).agg(
        F.sum(F.col(y).cast("double")).alias("__s"), F.count(F.lit(1)).alias("__n")
    )
    joined = lookup(df, materialize(stats, "stats"), col)
    value = F.try_divide(
        F.col("__s") - F.col(y) + F.lit(smoothing * g), F.col("__n") - 1 + F.lit(float(smoothing))
    )
    return joined.withColumn(out, F.coalesce(value, F.lit(g))).drop("__s", "__n")


def _class_sums(y: str, k: int) -> list[Column]:
    return [F.sum((F.col(y) == c).cast("double")).alias(f"__s{c}") for c in range(k)]


def _te_names(col: str, k: int, names: Sequence[str] | None) -> list[str]:
    labels = names or [str(c) for c in range(k)]
    return [f"TE_{col}_{label}" for label in labels]


def fold_safe_encode(
    train: DataFrame, cols: Sequence[str], y: str, k: int, fold: str = "inner",
    smooth: float = 16.0, apply: DataFrame | None = None, class_names: Sequence[str] | None = None,
    packed: bool | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Class rates per category that never see the row's own fold.

    Train rows: ``(S - s_f + a*g) / (N - n_f + a)``; apply rows: ``(S + a*g) / (N + a)``;
    null and unseen categories: the class share ``g``. One aggregation by (column, category,
    fold) covers all columns and classes and combines map-side; the totals are sums of that
    written result.
    """
    priors = class_shares(train, y, k)
    per_fold, totals = _per_fold(train, cols, y, k, fold, apply is not None)
    sums = [f"__s{c}" for c in range(k)]
    names = {col: _te_names(col, k, class_names) for col in cols}
    defaults = {name: g for col in cols for name, g in zip(names[col], priors)}
    others = {
        col: per_fold[col].select("__v", fold, *[
            (
                (F.col(f"{s}_all") - F.col(s) + F.lit(smooth * g))
                / (F.col("__n_all") - F.col("__n") + F.lit(float(smooth)))
            ).alias(name)
            for s, g, name in zip(sums, priors, names[col])
        ])
        for col in cols
    }
    encoded = lookup_values(train, others, defaults, [fold], packed)
    if apply is None:
        return encoded, None
    whole = {
        col: totals[col].select("__v", *[
            ((F.col(s) + F.lit(smooth * g)) / (F.col("__n") + F.lit(float(smooth)))).alias(name)
            for s, g, name in zip(sums, priors, names[col])
        ])
        for col in cols
    }
    return encoded, lookup_values(apply, whole, defaults, packed=packed)


def _per_fold(
    train: DataFrame, cols: Sequence[str], y: str, k: int, fold: str, whole: bool
) -> tuple[dict[str, DataFrame], dict[str, DataFrame] | None]:
    """column -> sums by value and fold beside the value's totals, and column -> totals by value.

    Totals of all columns come from one aggregate of the written sums.
    """
    sums = ["__n", *[f"__s{c}" for c in range(k)]]
    stats = packed_table(
        train.select(*dict.fromkeys([*cols, y, fold])), cols,
        [F.count(F.lit(1)).cast("double").alias("__n"), *_class_sums(y, k)], [fold],
    )
    over = Window.partitionBy("__c", "__v")  # a row per fold
    beside = stats.select("*", *[F.sum(c).over(over).alias(f"{c}_all") for c in sums])
    beside = by_column(materialize(beside, "beside", partition_by=["__c"]), cols)
    if not whole:
        return beside, None
    totals = stats.groupBy("__c", "__v").agg(*[F.sum(c).alias(c) for c in sums])
    return beside, by_column(materialize(totals, "totals", partition_by=["__c"]), cols)


def auto_smooth_encode(
    train: DataFrame, cols: Sequence[str], y: str, k: int, fold: str, apply: DataFrame | None = None,
    packed: bool | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Out-of-fold class rates shrunk by variance (empirical Bayes).

    Weight of the category mean: ``n*t2 / (n*t2 + s2)`` with ``t2`` the variance of the class
    flag over the fitting rows and ``s2`` its variance inside the category. For a 0/1 flag both
    follow from sums, so one aggregation by (category, fold) serves every fold.
    """
    base = train.groupBy(fold).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.sum((F.col(y) == c).cast("double")).alias(f"s{c}") for c in range(k)],
    ).collect()
    n_all = sum(r["n"] for r in base)
    s_all = [sum(r[f"s{c}"] for r in base) for c in range(k)]

    def shrunk(n: Column, s: Column, g: Column | float) -> Column:
        g = F.lit(g) if isinstance(g, float) else g
        mean = F.try_divide(s, n)
        inside = mean * (1 - mean)
        weight = F.try_divide(n * (g * (1 - g)), n * (g * (1 - g)) + inside)
        return F.coalesce(weight * mean + (1 - weight) * g, mean, g)

    per_fold, totals = _per_fold(train, cols, y, k, fold, apply is not None)
    sums = [f"__s{c}" for c in range(k)]
    names = {col: _te_names(col, k, None) for col in cols}
    prior = {}
    for c, s in enumerate(sums):
        g = F.lit(None).cast("double")
        for r in base:
            left = n_all - r["n"]
            share = (s_all[c] - r[f"s{c}"]) / left if left else 0.0
            g = F.when(F.col(fold) == F.lit(r[fold]), F.lit(share)).otherwise(g)
        prior[s] = g
    others = {
        col: per_fold[col].select("__v", fold, *[
            shrunk(F.col("__n_all") - F.col("__n"), F.col(f"{s}_all") - F.col(s), prior[s]).alias(name)
            for s, name in zip(sums, names[col])
        ])
        for col in cols
    }
    encoded = lookup_values(train, others, None, [fold], packed)
    encoded = encoded.withColumns(
        {name: F.coalesce(F.col(name), prior[s]) for col in cols for s, name in zip(sums, names[col])}
    )
    if apply is None:
        return encoded, None
    shares = [float(s / n_all) if n_all else 0.0 for s in s_all]
    whole = {
        col: totals[col].select("__v", *[
            shrunk(F.col("__n"), F.col(s), g).alias(name) for s, g, name in zip(sums, shares, names[col])
        ])
        for col in cols
    }
    defaults = {name: g for col in cols for name, g in zip(names[col], shares)}
    return encoded, lookup_values(apply, whole, defaults, packed=packed)


def encoders_needed(selected: Sequence[str], cols: Sequence[str], k: int, class_names=None) -> list[str]:
    """Source columns whose encodings are among the kept features."""
    wanted = set(selected)
    return [c for c in cols if wanted & set(_te_names(c, k, class_names))]


def aux_prior_encode(
    aux: DataFrame, apply: DataFrame, cols: Sequence[str], y: str, k: int, smooth: float = 30.0,
    packed: bool | None = None,
) -> DataFrame:
    """Class rates per value learned from the auxiliary table only, with counts."""
    priors = class_shares(aux, y, k)
    n = F.count(F.lit(1)).cast("double")
    found = packed_stats(aux.select(*dict.fromkeys([*cols, y])), cols, [
        *[
            (
                (F.sum((F.col(y) == c).cast("double")) + F.lit(smooth * priors[c]))
                / (n + F.lit(float(smooth)))
            ).alias(f"_aux_{c}")
            for c in range(k)
        ],
        F.count(F.lit(1)).alias("_aux_count"),
    ])
    kinds = [*range(k), "count"]
    stats = {col: found[col].select("__v", *[F.col(f"_aux_{c}").alias(f"{col}_aux_{c}") for c in kinds]) for col in cols}
    defaults: dict = {f"{col}_aux_{c}": priors[c] for col in cols for c in range(k)}
    defaults |= {f"{col}_aux_count": 0 for col in cols}
    out = lookup_values(apply, stats, defaults, packed=packed)
    logs = {f"{col}_aux_log_count": F.log1p(F.col(f"{col}_aux_count")) for col in cols}
    kept = [n for col in cols for n in [*[f"{col}_aux_{c}" for c in kinds], f"{col}_aux_log_count"]]
    return out.withColumns(logs).select(*[c for c in apply.columns if c not in kept], *kept)


def class_weights(
    df: DataFrame, y: str, power: float = 1.0, factors: dict | None = None,
    fixed: dict | None = None, out: str = "w",
) -> DataFrame:
    """``(n / (K*n_c)) ** power`` times an optional factor per class, or fixed weights."""
    if fixed is not None:
        weights = {label: float(w) for label, w in fixed.items()}
    else:
        # One row per class: classes are a fixed, small domain.
        sizes = {r[0]: r[1] for r in df.groupBy(y).agg(F.count(F.lit(1))).collect()}
        n, k = sum(sizes.values()), len(sizes)
        weights = {c: (n / (k * m)) ** power * (factors or {}).get(c, 1.0) for c, m in sizes.items()}
    w = F.lit(None).cast("double")
    for label, value in weights.items():
        w = F.when(F.col(y) == F.lit(label), F.lit(value)).otherwise(w)
    return df.withColumn(out, w)


def one_vs_rest_weight(df: DataFrame, y: str, positive, out: str = "w") -> DataFrame:
    """``n_neg / n_pos`` on positives, 1 on the rest."""
    row = df.select(F.sum((F.col(y) == F.lit(positive)).cast("long")), F.count(F.lit(1))).first()
    pos, n = row[0] or 0, row[1]
    ratio = (n - pos) / pos if pos else 1.0
    return df.withColumn(out, F.when(F.col(y) == F.lit(positive), F.lit(ratio)).otherwise(F.lit(1.0)))
