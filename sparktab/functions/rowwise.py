"""Row-wise feature functions: ``DataFrame -> DataFrame`` by one projection each."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktab.functions.exprs import clip, finite, total, weighted

EPS = 1e-6
# ln(10) * 0.4, rounded to six digits (fixed value).
MAG_LN = 0.921034


def pairwise_diff(df: DataFrame, cols: Sequence[str], absolute: bool = False) -> DataFrame:
    """``a_b = a - b`` for every pair in list order, and its absolute value on request."""
    new: dict[str, Column] = {}
    for a, b in combinations(cols, 2):
        new[f"{a}_{b}"] = F.col(a) - F.col(b)
        if absolute:
            new[f"abs_{a}_{b}"] = F.abs(F.col(a) - F.col(b))
    return df.withColumns(new)


def second_order_diff(df: DataFrame, pairs: Iterable[tuple[str, str, str]]) -> DataFrame:
    """``(name, left, right)`` triples: difference of two difference columns."""
    return df.withColumns({name: F.col(a) - F.col(b) for name, a, b in pairs})


def ratio(a: Column, b: Column, mode: str = "abs", eps: float = EPS) -> Column:
    """``abs``: ``a/(|b|+eps)``; ``plain``: ``a/(b+eps)`` with non-finite results 0;
    ``signed``: denominator kept at least ``eps`` away from 0 on its own side."""
    if mode == "abs":
        return a / (F.abs(b) + F.lit(eps))
    if mode == "plain":
        return F.coalesce(finite(F.try_divide(a, b + F.lit(eps))), F.lit(0.0))
    if mode == "signed":
        safe = F.when(F.abs(b) < eps, F.when(b < 0, F.lit(-eps)).otherwise(F.lit(eps))).otherwise(b)
        return a / safe
    raise ValueError("mode must be 'abs', 'plain' or 'signed'")


def safe_ratio(
    df: DataFrame, pairs: Iterable[tuple[str, str]], mode: str = "abs", eps: float = EPS
) -> DataFrame:
    return df.withColumns(
        {f"ratio_{a}_{b}": ratio(F.col(a), F.col(b), mode, eps) for a, b in pairs}
    )


def row_stats(df: DataFrame, cols: Sequence[str], prefix: str, ddof: int = 0) -> DataFrame:
    """Row mean, sum, std, min, max, range, median and positions of min and max.

    Missing cells are skipped, as column-wise tools do; a row without values gives nulls.
    """
    cs = [finite(F.col(c)) for c in cols]
    n = total([F.when(c.isNotNull(), 1).otherwise(0) for c in cs])
    filled = [F.coalesce(c, F.lit(0.0)) for c in cs]
    names = [f"__v{i}" for i in range(len(cs))]
    df = df.withColumns({**dict(zip(names, cs)), "__n": n, "__sum": total(filled)})
    vals = [F.col(v) for v in names]
    some = F.col("__n") > 0
    df = df.withColumn("__mean", F.when(some, F.col("__sum") / F.col("__n")))
    square = total([F.coalesce(F.pow(v - F.col("__mean"), 2), F.lit(0.0)) for v in vals])
    room = F.col("__n") - ddof
    ranked = F.array_sort(F.filter(F.array(*vals), lambda v: v.isNotNull()))
    half = (F.col("__n") / 2).cast("int")
    middle = F.when(
        F.col("__n") % 2 == 1, F.get(ranked, half)
    ).otherwise((F.get(ranked, half - 1) + F.get(ranked, half)) / 2)
    low, high = F.least(*vals), F.greatest(*vals)

    def place(target: Column) -> Column:
        spot = F.when(vals[0] == target, 0)
        for i, v in enumerate(vals[1:], start=1):
            spot = spot.when(v == target, i)
        return spot

    return df.withColumns(
        {
            f"{prefix}_mean": F.col("__mean"),
            f"{prefix}_sum": F.when(some, F.col("__sum")),
            f"{prefix}_std": F.when(room > 0, F.sqrt(square / room)),
            f"{prefix}_min": low,
            f"{prefix}_max": high,
            f"{prefix}_range": high - low,
            f"{prefix}_median": middle,
            f"{prefix}_argmin": place(low),
            f"{prefix}_argmax": place(high),
        }
    ).drop(*names, "__n", "__sum", "__mean")


def row_slope_curvature(
    df: DataFrame,
    cols: Sequence[str],
    prefix: str,
    curves: dict[str, tuple[str, str, str]] | None = None,
) -> DataFrame:
    """Least-squares slope over centred positions, mean second difference, and named
    three-point curvatures ``a - 2b + c``."""
    k = len(cols)
    centre = (k - 1) / 2
    positions = [i - centre for i in range(k)]
    norm = sum(x * x for x in positions)
    cs = [F.col(c) for c in cols]
    new = {f"{prefix}_slope": weighted(cs, [x / norm for x in positions])}
    seconds = [cs[i] - 2 * cs[i + 1] + cs[i + 2] for i in range(k - 2)]
    if seconds:
        new[f"{prefix}_curvature"] = total(seconds) / len(seconds)
    for name, (a, b, c) in (curves or {}).items():
        new[name] = F.col(a) - 2 * F.col(b) + F.col(c)
    return df.withColumns(new)


def mag_to_flux(df: DataFrame, cols: Sequence[str], stats: bool = False) -> DataFrame:
    """``10^(-0.4 m)`` with ``m`` clipped to ±30, its log1p, adjacent flux ratios, and row
    statistics of the fluxes on request."""
    flux = {f"flux_{c}": F.pow(F.lit(10.0), -0.4 * clip(F.col(c), -30, 30)) for c in cols}
    df = df.withColumns(flux)
    new = {f"log1p_flux_{c}": F.log1p(F.col(f"flux_{c}")) for c in cols}
    for a, b in zip(cols, cols[1:]):
        new[f"flux_ratio_{a}_{b}"] = ratio(F.col(f"flux_{a}"), F.col(f"flux_{b}"), "abs", 1e-12)
        new[f"color_flux_{a}_{b}"] = F.exp(-MAG_LN * clip(F.col(a) - F.col(b), -20, 20))
    df = df.withColumns(new)
    return row_stats(df, list(flux), "flux") if stats else df


def signed_transforms(
    df: DataFrame, col: str, thresholds: Sequence[float] = (), eps: float = EPS
) -> DataFrame:
    c = F.col(col)
    new = {
        f"{col}_abs": F.abs(c),
        f"{col}_log1p": F.log1p(F.abs(c)),
        f"{col}_sqrt": F.sqrt(F.abs(c)),
        f"{col}_cbrt": F.cbrt(c),
        f"{col}_sq": c * c,
        f"{col}_is_neg": (c < 0).cast("int"),
        f"{col}_inv": 1 / (F.abs(c) + F.lit(eps)),
    }
    for i, t in enumerate(thresholds):
        new[f"{col}_below_{i}"] = (c < F.lit(float(t))).cast("int")
    return df.withColumns(new)


def interactions(
    df: DataFrame, left: str, rights: Sequence[str], quotients: bool = True
) -> DataFrame:
    """Products, and guarded quotients, of one column with many."""
    new = {f"{left}_x_{r}": F.col(left) * F.col(r) for r in rights}
    if quotients:
        new.update({f"{left}_over_{r}": ratio(F.col(left), F.col(r), "abs") for r in rights})
    return df.withColumns(new)


def share_times_bin(df: DataFrame, share: str, bin_col: str, out: str) -> DataFrame:
    """Encoded share times bin code; a missing bin counts as -1."""
    return df.withColumn(out, F.col(share) * F.coalesce(F.col(bin_col), F.lit(-1)))


def sky_position(df: DataFrame, ra: str, dec: str) -> DataFrame:
    a, d = F.radians(ra), F.radians(dec)
    return df.withColumns(
        {
            f"{ra}_{dec}": F.col(ra) * F.col(dec),
            f"sin_{ra}": F.sin(a),
            f"cos_{ra}": F.cos(a),
            f"sin_{dec}": F.sin(d),
            f"cos_{dec}": F.cos(d),
            "sky_x": F.cos(d) * F.cos(a),
            "sky_y": F.cos(d) * F.sin(a),
            "sky_z": F.sin(d),
        }
    )


def polar_pair(df: DataFrame, x: str, y: str, eps: float = EPS) -> DataFrame:
    return df.withColumns(
        {
            f"{x}_{y}_radius": F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y)),
            f"{x}_{y}_angle": F.atan2(F.col(x), F.col(y) + F.lit(eps)),
        }
    )


def linear_scores(df: DataFrame, scores: dict[str, dict]) -> DataFrame:
    """Named linear combinations: ``{name: {column: weight, ..., 'const': value}}``."""
    new = {}
    for name, spec in scores.items():
        cols = [c for c in spec if c != "const"]
        new[name] = weighted([F.col(c) for c in cols], [spec[c] for c in cols], spec.get("const", 0.0))
    return df.withColumns(new)


def soft_indicator(
    df: DataFrame, col: str, kind: str, centre: float, scale: float, out: str,
    lo: float = -1e6, hi: float = 1e6,
) -> DataFrame:
    """``peak``: exp(-|x-c|/s); ``gauss``: exp(-((x-c)/s)^2); ``ramp``: logistic((x-c)/s)."""
    z = (clip(F.col(col), lo, hi) - F.lit(float(centre))) / F.lit(float(scale))
    if kind == "peak":
        value = F.exp(-F.abs(z))
    elif kind == "gauss":
        value = F.exp(-z * z)
    elif kind == "ramp":
        value = 1 / (1 + F.exp(-z))
    else:
        raise ValueError("kind must be 'peak', 'gauss' or 'ramp'")
    return df.withColumn(out, value)


class LogShift:
    """``log1p(x - min(0, min x) + 1e-4)`` with the minimum fitted once and reused."""

    def __init__(self, cols: Sequence[str]):
        self.cols = list(cols)
        self.shift: dict[str, float] = {}

    def fit(self, df: DataFrame) -> LogShift:
        row = df.select(*[F.min(finite(F.col(c))).alias(c) for c in self.cols]).first()
        self.shift = {c: min(0.0, row[c] if row[c] is not None else 0.0) for c in self.cols}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {f"{c}_log": F.log1p(F.col(c) - F.lit(s) + F.lit(1e-4)) for c, s in self.shift.items()}
        )


def clean_nonfinite(df: DataFrame, cols: Sequence[str], fill: float | None = None) -> DataFrame:
    """NaN and infinities to null, then null to ``fill`` when one is given."""
    new = {}
    for c in cols:
        value = finite(F.col(c))
        new[c] = value if fill is None else F.coalesce(value, F.lit(float(fill)))
    return df.withColumns(new)


def source_flags(df: DataFrame, tag: str = "source", aux: str = "aux", test: str = "test") -> DataFrame:
    return df.withColumns(
        {
            "is_orig": (F.col(tag) == aux).cast("int"),
            "is_test": (F.col(tag) == test).cast("int"),
        }
    )


def polynomial(df: DataFrame, cols: Sequence[str], degree: int = 2) -> DataFrame:
    """All monomials of degree 2..``degree``."""
    new = {}
    for d in range(2, degree + 1):
        for combo in combinations_with_replacement(cols, d):
            value = F.col(combo[0])
            for c in combo[1:]:
                value = value * F.col(c)
            new["poly_" + "_".join(combo)] = value
    return df.withColumns(new)
