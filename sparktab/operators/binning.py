"""Fitted binning. One operator with explicit edge rules replaces the many variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktab.functions.exprs import edges_below, finite, is_finite
from sparktab.operators.ranks import exact_quantiles, value_rank


class EqualWidthBinner:
    """``n`` equal bins over the fitted range, right-closed, lowest value included."""

    def __init__(self, cols: Sequence[str], n: int):
        self.cols, self.n = list(cols), n
        self.range: dict[str, tuple[float, float]] = {}

    def fit(self, df: DataFrame) -> EqualWidthBinner:
        row = df.select(
            *[F.min(finite(F.col(c))).alias(f"lo_{c}") for c in self.cols],
            *[F.max(finite(F.col(c))).alias(f"hi_{c}") for c in self.cols],
        ).first()
        self.range = {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in self.cols}
        return self

    def edges(self, col: str) -> list[float]:
        lo, hi = self.range[col]
        if lo == hi:
            pad = 0.001 * abs(lo) if lo else 0.001
            lo, hi = lo - pad, hi + pad
        return [lo + (hi - lo) * i / self.n for i in range(1, self.n)]

    def code(self, col: str) -> Column:
        lo, hi = self.range[col]
        value = F.col(col)
        inside = value.between(F.lit(lo), F.lit(hi))
        return F.when(inside, edges_below(value, self.edges(col), "right"))

    def transform(self, df: DataFrame, suffix: str = "_bin") -> DataFrame:
        return df.withColumns({c + suffix: self.code(c) for c in self.cols})

    def cell(self, df: DataFrame, a: str, b: str, out: str) -> DataFrame:
        """Grid cell number ``bin(a) * n + bin(b)``."""
        return df.withColumn(out, self.code(a) * self.n + self.code(b))


class QuantileBinner:
    """Quantile bins with explicit rules.

    ``closed``: ``'right'`` for ``(a, b]`` with the first edge included, ``'left'`` for
    ``[a, b)``. ``inner``: edges from all q+1 quantiles, duplicates merged, then the two
    outer ones dropped (``'trim'``), or from the interior quantiles only (``'interior'``).
    ``missing`` is the code of null or non-finite values (None keeps null), ``outside`` the
    code of values beyond the fitted range (None: they join the outer bins), ``offset`` is
    added to every code.
    """

    def __init__(
        self,
        cols: Sequence[str],
        q: int,
        closed: str = "left",
        inner: str = "trim",
        missing: int | None = -1,
        outside: int | None = None,
        offset: int = 0,
    ):
        self.cols, self.q, self.closed, self.inner = list(cols), q, closed, inner
        self.missing, self.outside, self.offset = missing, outside, offset
        self.quantiles: dict[str, list[float]] = {}

    def fit(self, df: DataFrame, **options) -> QuantileBinner:
        probs = [i / self.q for i in range(self.q + 1)]
        self.quantiles = exact_quantiles(df, self.cols, probs, **options)
        return self

    def edges(self, col: str) -> list[float]:
        points = self.quantiles[col]
        if self.inner == "interior":
            return sorted(set(points[1:-1]))
        return sorted(set(points))[1:-1]

    def code(self, col: str, source: Column | None = None) -> Column:
        value = F.col(col) if source is None else source
        points = sorted(set(self.quantiles[col]))
        code = edges_below(value, self.edges(col), self.closed) + F.lit(self.offset)
        if self.outside is not None:
            if len(points) < 2:
                code = F.lit(self.outside)
            else:
                out = (value < F.lit(points[0])) | (value > F.lit(points[-1]))
                code = F.when(out, F.lit(self.outside)).otherwise(code)
        # One guard around the tree instead of one per comparison.
        code = F.when(is_finite(value), code)
        if self.missing is not None:
            code = F.coalesce(code, F.lit(self.missing))
        return code.cast("int")

    def transform(self, df: DataFrame, suffix: str | None = None) -> DataFrame:
        suffix = suffix or f"_q{self.q}"
        return df.withColumns({c + suffix: self.code(c) for c in self.cols})

    def state(self, spark) -> DataFrame:
        """Fitted edges as a table: columns x (q+1) rows."""
        rows = [(c, i, float(v)) for c, vs in self.quantiles.items() for i, v in enumerate(vs)]
        return spark.createDataFrame(rows, "column string, position int, edge double")

    def load(self, state: DataFrame) -> QuantileBinner:
        self.quantiles = {}
        for r in state.orderBy("column", "position").collect():
            self.quantiles.setdefault(r["column"], []).append(r["edge"])
        return self


def fold_quantile_codes(
    df: DataFrame, col: str, levels: Sequence[int], k: int, fold: str = "fold"
) -> DataFrame:
    """Bins fitted per outer fold on the other folds, several levels side by side.

    Codes start at 1, 0 marks a missing value. All folds' edges come from one pass: fold f's
    training values are a column of their own. The row's own fold picks its edges.
    """
    views = df.select(*[F.when(F.col(fold) != f, F.col(col)).alias(f"f{f}") for f in range(k)])
    probs = {q: [i / q for i in range(1, q)] for q in levels}
    together = sorted({p for ps in probs.values() for p in ps})
    found = exact_quantiles(views, views.columns, together)
    new: dict[str, Column] = {}
    for q in levels:
        code = F.lit(None).cast("int")
        for f in range(k):
            at = dict(zip(together, found[f"f{f}"]))
            edges = sorted({at[p] for p in probs[q]}) if at else []
            own = edges_below(F.col(col), edges, "left") + 1
            code = F.when(F.col(fold) == f, own).otherwise(code)
        new[f"{col}_q{q}"] = F.when(is_finite(F.col(col)), code).otherwise(0).cast("int")
    return df.withColumns(new)


def shared_rank_edges(
    frames: Sequence[DataFrame], col: str, q: int, missing: int = -1
) -> QuantileBinner:
    """Interior edges fitted on all frames together. Missing values get a code of their own."""
    together = frames[0].select(col)
    for f in frames[1:]:
        together = together.unionByName(f.select(col))
    return QuantileBinner([col], q, "left", "interior", missing=missing).fit(together)


def rank_bin(
    df: DataFrame, col: str, q: int, key: str, out: str, rows_per_bucket: int = 2_000_000
) -> DataFrame:
    """Equal-frequency bins by rank; ties are broken by the key's hash.

    Sizes differ by at most one, the first ``n mod q`` bins being the larger ones. Missing
    values have no bin (null) and aren't counted.
    """
    row = df.select(F.count(col), F.count(F.lit(1)) - F.count(col)).first()
    n, missing = row[0], row[1]
    ranked = value_rank(df, [], col, key, "__rank", rows_per_bucket=rows_per_bucket)
    size, extra = divmod(n, q)
    head = extra * (size + 1)
    r = F.col("__rank") - 1 - F.lit(missing)  # nulls rank first
    tail = F.when(r < head, F.floor(r / F.lit(size + 1))).otherwise(
        F.lit(extra) + F.floor((r - head) / F.lit(max(size, 1)))
    )
    return ranked.withColumn(out, F.when(F.col(col).isNotNull(), tail.cast("int"))).drop("__rank")
