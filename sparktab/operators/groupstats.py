"""Group statistics, scalers, profiles and text/date summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktab.functions.exprs import finite, total
from sparktab.operators.gram import correlations
from sparktab.operators.joins import lookup_values, packed_stats
from sparktab.operators.ranks import exact_quantiles
from sparktab.session import materialize


def group_stats(df: DataFrame, keys: dict[str, str], cols: Sequence[str], packed: bool | None = None) -> DataFrame:
    """Count, mean, sample std (0 for one row) and deviation from the mean, per key.

    ``keys`` maps a prefix to its key column. One aggregation covers all keys, and keys too large to
    broadcast are looked up in one packed join.
    """
    aggs = [F.count(F.lit(1)).alias("count")]
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std")]
    made = ["count", *[f"{c}_{s}" for c in cols for s in ("mean", "std")]]
    # Several prefixes may share a key, and a key may be a column of ``cols`` too.
    keyed = df.withColumns({f"__k{i}": F.col(key) for i, key in enumerate(keys.values())})
    names = [f"__k{i}" for i in range(len(keys))]
    stats = packed_stats(keyed.select(*names, *dict.fromkeys(cols)), names, aggs)
    named = {
        n: stats[n].select("__v", *[F.col(m).alias(f"{prefix}_{m}") for m in made]) for n, prefix in zip(names, keys, strict=True)
    }
    out = lookup_values(keyed, named, packed=packed).drop(*names)
    out = out.withColumns({f"{p}_{c}_dev": F.col(c) - F.col(f"{p}_{c}_mean") for p in keys for c in cols})
    order = [f"{p}_{m}" for p in keys for m in [*made, *[f"{c}_dev" for c in cols]]]
    return out.select(*[c for c in df.columns if c not in order], *order)


class StandardScale:
    """z-scores with the population standard deviation; constant columns become 0."""

    def __init__(self, cols: Sequence[str]):
        self.cols = list(cols)
        self.stats: dict[str, tuple[float, float]] = {}

    def fit(self, df: DataFrame) -> StandardScale:
        row = df.select(
            *[F.avg(c).alias(f"m_{c}") for c in self.cols],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in self.cols],
        ).first()
        self.stats = {c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in self.cols}
        return self

    def column(self, c: str) -> Column:
        mean, std = self.stats[c]
        return (F.col(c) - F.lit(mean)) / F.lit(std)

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        return df.withColumns({c + suffix: self.column(c) for c in self.cols})


class RobustScale:
    """Median and IQR scaling, half range for a zero IQR, optional smooth clip and row norm."""

    def __init__(self, cols: Sequence[str], smooth_clip: bool = True, row_norm: bool = False):
        self.cols, self.smooth_clip, self.row_norm = list(cols), smooth_clip, row_norm
        self.stats: dict[str, tuple[float, float]] = {}

    def fit(self, df: DataFrame, **options) -> RobustScale:
        q = exact_quantiles(df, self.cols, [0.0, 0.25, 0.5, 0.75, 1.0], **options)
        for c in self.cols:
            lo, q1, med, q3, hi = q[c]
            spread = q3 - q1 if q3 != q1 else 0.5 * (hi - lo)
            self.stats[c] = (med, 1.0 / (spread + 1e-30) if spread else 0.0)
        return self

    def transform(self, df: DataFrame, suffix: str = "_rs") -> DataFrame:
        new: dict[str, Column] = {}
        for c, (med, factor) in self.stats.items():
            x = (F.col(c) - F.lit(med)) * F.lit(factor)
            new[c + suffix] = x / F.sqrt(1 + F.pow(x / 3, 2)) if self.smooth_clip else x
        if self.row_norm:
            df = df.withColumns({f"__{c}": e for c, e in new.items()})
            length = F.sqrt(total([F.pow(F.col(f"__{c}"), 2) for c in new]))
            safe = F.when(length == 0, 1.0).otherwise(length)
            df = df.withColumns({c: F.col(f"__{c}") / safe for c in new})
            return df.drop(*[f"__{c}" for c in new])
        return df.withColumns(new)


class MinMaxScale:
    def __init__(self, cols: Sequence[str]):
        self.cols = list(cols)
        self.stats: dict[str, tuple[float, float]] = {}

    def fit(self, df: DataFrame) -> MinMaxScale:
        row = df.select(
            *[F.min(c).alias(f"lo_{c}") for c in self.cols],
            *[F.max(c).alias(f"hi_{c}") for c in self.cols],
        ).first()
        self.stats = {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in self.cols}
        return self

    def transform(self, df: DataFrame, suffix: str = "_mm") -> DataFrame:
        return df.withColumns(
            {
                c + suffix: (F.col(c) - F.lit(lo)) / F.lit(hi - lo) if hi != lo else F.col(c) * 0.0
                for c, (lo, hi) in self.stats.items()
            }
        )


def log_transform(df: DataFrame, cols: Sequence[str], suffix: str = "_ln") -> DataFrame:
    return df.withColumns({c + suffix: F.log1p(F.greatest(F.col(c), F.lit(0.0))) for c in cols})


class Impute:
    """Fill nulls: ``mean``, ``median``, ``mode`` (smallest on ties) or a constant."""

    def __init__(self, cols: Sequence[str], how: str = "median", value=None):
        self.cols, self.how, self.value = list(cols), how, value
        self.fill: dict = {}

    def fit(self, df: DataFrame) -> Impute:
        if self.how == "constant":
            self.fill = dict.fromkeys(self.cols, self.value)
        elif self.how == "mean":
            self.fill = df.select(*[F.avg(c).alias(c) for c in self.cols]).first().asDict()
        elif self.how == "median":
            q = exact_quantiles(df, self.cols, [0.5])
            self.fill = {c: (q[c][0] if q[c] else None) for c in self.cols}
        elif self.how == "mode":
            for c in self.cols:
                top = (
                    df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
                    .orderBy(F.col("n").desc(), c).first()
                )
                self.fill[c] = top[0] if top else None
        else:
            raise ValueError("how must be 'constant', 'mean', 'median' or 'mode'")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.fill.items() if v is not None}
        )


def class_prototypes(
    aux: DataFrame, apply: DataFrame, cols: Sequence[str], y: str, k: int,
    gaps: dict[str, tuple[int, int]] | None = None,
) -> DataFrame:
    """Distances of every row to each class centre of the auxiliary table.

    Columns are standardized over both frames together (missing taken as 0). The k centres
    and spreads are k x columns numbers and enter the row expressions as literals.
    """
    zeroed = {c: F.coalesce(finite(F.col(c)), F.lit(0.0)) for c in cols}
    both = aux.select(*[e.alias(c) for c, e in zeroed.items()]).unionByName(
        apply.select(*[e.alias(c) for c, e in zeroed.items()])
    )
    scale = StandardScale(cols).fit(both)
    centres = (
        scale.transform(aux.withColumns(zeroed))
        .groupBy(y)
        .agg(
            *[F.avg(c).alias(f"m_{c}") for c in cols],
            *[(F.stddev_pop(c) + 0.05).alias(f"s_{c}") for c in cols],
        )
        .collect()
    )
    by_class = {r[y]: r for r in centres}
    names = [f"__z_{c}" for c in cols]
    work = apply.withColumns(
        {
            n: (zeroed[c] - F.lit(scale.stats[c][0])) / F.lit(scale.stats[c][1])
            for n, c in zip(names, cols)
        }
    )
    new: dict[str, Column] = {}
    m = len(cols)
    for label in range(k):
        r = by_class[label]
        diff = [F.col(n) - F.lit(r[f"m_{c}"]) for n, c in zip(names, cols)]
        part = [d / F.lit(r[f"s_{c}"]) for d, c in zip(diff, cols)]
        new[f"proto_euclid_{label}"] = F.sqrt(total([d * d for d in diff]) / m)
        new[f"proto_diag_{label}"] = F.sqrt(total([d * d for d in part]) / m)
        new[f"proto_absmean_{label}"] = total([F.abs(d) for d in part]) / m
    work = work.withColumns(new).drop(*names)
    best: dict[str, Column] = {}
    for kind in ("euclid", "diag"):
        ranked = F.sort_array(F.array(*[F.col(f"proto_{kind}_{c}") for c in range(k)]))
        best[f"proto_{kind}_min"] = ranked[0]
        best[f"proto_{kind}_gap12"] = ranked[1] - ranked[0]
    for name, (a, b) in (gaps or {}).items():
        best[name] = F.col(f"proto_euclid_{a}") - F.col(f"proto_euclid_{b}")
    return work.withColumns(best)


def value_shares(df: DataFrame, col: str) -> DataFrame:
    n = df.count()
    return df.groupBy(col).agg(
        F.count(F.lit(1)).alias("n"), F.try_divide(F.count(F.lit(1)), F.lit(n)).alias("share")
    )


def profile(df: DataFrame, numeric: Sequence[str], other: Sequence[str], sentinels: Sequence[float] = (-9999.0,)) -> DataFrame:
    """One row per column: rows, nulls, sentinels, distinct values, min, mean, max, std, and the exact
    quartiles q25, q50, q75 of the finite values.

    Distinct values come from a second aggregation over (column, value) pairs, so no task
    holds a set of values.
    """
    from sparktab.operators.categories import cardinality

    cols = [*numeric, *other]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in cols:
        aggs.append(F.sum(F.col(c).isNull().cast("long")).alias(f"nulls_{c}"))
    for c in numeric:
        marked = F.col(c).isin([float(s) for s in sentinels])
        aggs += [
            F.sum(F.coalesce(marked, F.lit(False)).cast("long")).alias(f"sent_{c}"),
            F.min(c).cast("double").alias(f"min_{c}"),
            F.avg(c).alias(f"mean_{c}"),
            F.max(c).cast("double").alias(f"max_{c}"),
            F.stddev_samp(c).alias(f"std_{c}"),
        ]
    quartiles = exact_quantiles(df, numeric, [0.25, 0.5, 0.75]) if numeric else {}
    none = F.lit(None).cast("double")
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col("rows"),
                F.col(f"nulls_{c}").alias("nulls"),
                (F.col(f"sent_{c}") if c in numeric else F.lit(0).cast("long")).alias("sentinels"),
                (F.col(f"min_{c}") if c in numeric else none).alias("min"),
                (F.col(f"mean_{c}") if c in numeric else none).alias("mean"),
                (F.col(f"max_{c}") if c in numeric else none).alias("max"),
                (F.col(f"std_{c}") if c in numeric else none).alias("std"),
                *[
                    F.lit(quartiles[c][i] if c in numeric and quartiles[c] else None).cast("double").alias(n)
                    for i, n in enumerate(["q25", "q50", "q75"])
                ],
            )
            for c in cols
        ]
    )
    return df.agg(*aggs).select(F.inline(rows)).join(cardinality(df, cols), "column")


def duplicate_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return (
        df.groupBy(*cols).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    )


def class_means(df: DataFrame, y: str, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(y).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in cols])


def mean_importance(df: DataFrame, n: int) -> DataFrame:
    """Features by mean gain over folds, the top ``n`` (ties by name)."""
    return (
        df.groupBy("feature").agg(F.avg("gain").alias("mean_gain"))
        .orderBy(F.col("mean_gain").desc(), "feature").limit(n)
    )


def column_correlation(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair, from one scan whatever their number (``gram``)."""
    if len(cols) < 2:
        raise ValueError("at least two columns are needed")
    return correlations(df, cols)


def date_parts(df: DataFrame, col: str, reference: str = "1970-01-01") -> DataFrame:
    """Year, month, day, weekday (Monday 0), hour, weekend flag, days since a date."""
    c = F.col(col)
    return df.withColumns(
        {
            f"{col}_year": F.year(c),
            f"{col}_month": F.month(c),
            f"{col}_day": F.dayofmonth(c),
            f"{col}_weekday": F.weekday(c),
            f"{col}_hour": F.hour(c),
            f"{col}_is_weekend": (F.weekday(c) >= 5).cast("int"),
            f"{col}_days": F.datediff(c.cast("date"), F.lit(reference).cast("date")),
        }
    )


def text_stats(df: DataFrame, col: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """Characters, words (runs of non-space) and pattern flags of whole texts."""
    c = F.col(col)
    new = {
        f"{col}_chars": F.char_length(c),
        f"{col}_words": F.regexp_count(c, F.lit("[^ \\t\\n\\r\\f\\x0B]+")),
    }
    for name, pattern in (patterns or {}).items():
        new[f"{col}_{name}"] = c.rlike(pattern).cast("int")
    return df.withColumns(new)
