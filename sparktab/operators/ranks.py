"""Exact ranks, running sums and quantiles without a single-task sort.

``row_number`` over one class puts that class on one task. Here the order is cut
into buckets that respect it: rows are counted per bucket (combined map-side),
the small count table gets running offsets, and only then are rows numbered inside
their own bucket. The result equals the plain window for any bucket choice; the
buckets only decide how evenly the work spreads.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktab.functions.exprs import edges_below, finite, hash_text, is_finite, number_array

ROWS_PER_BUCKET = 2_000_000
ROWS_PER_HASH = 100_000
MAX_BUILTIN_PROBS = 20


def running_sums(
    df: DataFrame,
    by: Sequence[str],
    buckets: Sequence[str],
    order: Sequence[Column | str],
    measures: dict[str, Column],
) -> DataFrame:
    """Inclusive running sums of ``measures`` per ``by`` group in ``buckets + order`` order.

    ``buckets`` are columns whose own order agrees with the wanted row order.
    """
    by, buckets = list(by), list(buckets)
    keys = by + buckets
    local = {name: f"__{name}_part" for name in measures}
    offset = {name: f"__{name}_before" for name in measures}
    parts = df.groupBy(*keys).agg(*[F.sum(m).alias(local[n]) for n, m in measures.items()])
    earlier = (
        Window.partitionBy(*by).orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = parts.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        *[F.coalesce(F.sum(local[n]).over(earlier), F.lit(0)).alias(offset[n]) for n in measures],
    )
    same = [df[k].eqNullSafe(starts[f"__{k}"]) for k in keys]
    inside = (
        Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return df.join(starts, same, "left").select(
        *[df[c] for c in df.columns],
        *[(F.sum(m).over(inside) + F.col(offset[n])).alias(n) for n, m in measures.items()],
    )


def best_before(
    df: DataFrame,
    by: Sequence[str],
    buckets: Sequence[str],
    order: Sequence[Column | str],
    value: str,
    out: str,
) -> DataFrame:
    """Largest ``value`` among the earlier rows of the group, null for the first row.

    Same two levels as ``running_sums``: the best of earlier buckets comes from the small
    per-bucket table, the best inside the bucket from a local window.
    """
    keys = [*by, *buckets]
    parts = df.groupBy(*keys).agg(F.max(value).alias("__top"))
    earlier = (
        Window.partitionBy(*by).orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = parts.select(
        *[F.col(k).alias(f"__{k}") for k in keys], F.max("__top").over(earlier).alias("__before")
    )
    same = [df[k].eqNullSafe(starts[f"__{k}"]) for k in keys]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(starts, same, "left").select(
        *[df[c] for c in df.columns],
        F.greatest(F.max(df[value]).over(inside), F.col("__before")).alias(out),
    )


def hash_digits(df: DataFrame, by: Sequence[str], rows: int = ROWS_PER_HASH) -> int:
    """Hex digits of a hash that cut the largest ``by`` group into buckets of about ``rows`` rows."""
    most = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).agg(F.max("__n")).first()[0] or 0
    return _digits(most, rows)


def _digits(n: int, rows: int) -> int:
    digits = 0
    while n > rows * 16**digits:
        digits += 1
    return digits


def hash_rank(
    df: DataFrame, by: Sequence[str], key: str, seed: int, out: str = "rank", rows: int = ROWS_PER_HASH
) -> DataFrame:
    """1-based rank by ``(md5(seed:key), key)`` inside each ``by`` group.

    The first digits of the hash are the bucket; their number follows the largest group's size.
    """
    hashed = df.withColumn("__h", hash_text(key, seed)).withColumn(
        "__b", F.substring("__h", 1, hash_digits(df, by, rows))
    )
    return running_sums(hashed, by, ["__b"], ["__h", key], {out: F.lit(1)}).drop("__h", "__b")


def split_points(
    df: DataFrame, value: str, rows_per_bucket: int = ROWS_PER_BUCKET, n_rows: int | None = None
) -> list[float]:
    """Values that cut ``value`` into about ``rows/rows_per_bucket`` even ranges.

    They come from a sample, which is enough: they steer balance, never the answer.
    Their number is rows / rows_per_bucket, about 8 MB for 2e12 rows.
    """
    col = F.col(value)
    n = df.select(F.count(col)).first()[0] if n_rows is None else n_rows
    wanted = math.ceil(n / rows_per_bucket)
    if wanted < 2:
        return []
    fraction = min(1.0, max(20.0 * wanted, 20_000.0) / n)
    probe = df.sample(fraction=fraction, seed=17) if fraction < 1 else df
    probs = [i / wanted for i in range(1, wanted)]
    points = probe.select(
        F.percentile_approx(col, [float(p) for p in probs], F.lit(max(10_000, 10 * wanted)))
    ).first()[0]
    return sorted({p for p in points or [] if math.isfinite(p)})


def range_bucket(df: DataFrame, value: str, points: Sequence[float], out: str) -> DataFrame:
    """Bucket number that grows with ``value``; each split point has a bucket of its own.

    A value held by a large share of all rows is always a split point, so its rows sit
    in an odd bucket that needs no sorting by value.
    """
    if not points:
        return df.withColumn(out, F.lit(0))
    placed = df.withColumn("__n", edges_below(F.col(value), points, "left"))
    at_edge = F.get(number_array(points), F.col("__n") - 1) == F.col(value)
    return placed.withColumn(
        out,
        F.when(F.col("__n") == 0, 0).otherwise(
            2 * F.col("__n") - F.when(at_edge, 1).otherwise(0)
        ),
    ).drop("__n")


def value_rank(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    key: str,
    out: str = "rank",
    descending: bool = False,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    seed: int = 0,
) -> DataFrame:
    """1-based rank by ``value``, ties by ``(md5(seed:key), key)``, inside ``by`` groups.

    Nulls come first, and last if ``descending``. A value shared by very many rows is spread
    over hash sub-buckets, as many as its measured count needs.
    """
    points = split_points(df, value, rows_per_bucket)
    order = F.col(value).desc() if descending else F.col(value).asc()
    if not points:
        # The whole frame fits one bucket.
        whole = Window.partitionBy(*by).orderBy(order, hash_text(key, seed), key)
        return df.withColumn(out, F.row_number().over(whole).cast("long"))
    placed = range_bucket(df, value, points, "__r")
    placed = placed.withColumn("__h", hash_text(key, seed))
    turned = -F.col("__r") if descending else F.col("__r")
    edge = 2 * len(points) + 1
    placed = placed.withColumn("__r", F.coalesce(turned, F.lit(edge if descending else -edge)))
    # Nulls and values at a split point sit in odd buckets, which need no order by value.
    repeated = placed.where(F.col("__r") % 2 != 0).groupBy(*by, "__r").agg(F.count(F.lit(1)).alias("__n"))
    digits = _digits(repeated.agg(F.max("__n")).first()[0] or 0, rows_per_bucket)
    placed = placed.withColumn(
        "__s", F.when(F.col("__r") % 2 != 0, F.substring("__h", 1, digits)).otherwise("")
    )
    return running_sums(
        placed, by, ["__r", "__s"], [order, F.col("__h"), F.col(key)], {out: F.lit(1)}
    ).drop("__r", "__s", "__h")


def _ranks_wanted(n: int, probs: Sequence[float]) -> list[tuple[int, int, float]]:
    spots = []
    for p in probs:
        h = p * (n - 1)
        lo = math.floor(h)
        spots.append((lo, min(lo + 1, n - 1), h - lo))
    return spots


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    exact_rows: int = 5_000_000,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> dict[str, list[float]]:
    """Linear-interpolated quantiles of finite values, exact at any size.

    The built-in exact percentile keeps every distinct value in one buffer, so it is used
    only up to ``exact_rows`` rows. Beyond that the wanted ranks of all columns are looked up
    together (``values_at_ranks``), in four passes whatever the number of columns.
    """
    cols, probs = list(dict.fromkeys(cols)), [float(p) for p in probs]
    clean = df.select(*[finite(F.col(c).cast("double")).alias(c) for c in cols])
    counts = clean.select(*[F.count(c).alias(c) for c in cols]).first().asDict()
    # The built-in pays a pass over the distinct values per probability.
    few = len(probs) <= MAX_BUILTIN_PROBS
    small = [c for c in cols if counts[c] == 0 or (few and counts[c] <= exact_rows)]
    found: dict[str, list[float]] = {}
    if small:
        arr = F.array(*[F.lit(p) for p in probs])
        row = clean.select(*[F.percentile(c, arr).alias(c) for c in small]).first()
        found.update({c: list(row[c]) if row[c] is not None else [] for c in small})
    spots = {c: _ranks_wanted(counts[c], probs) for c in cols if c not in found}
    if spots:
        ranks = {c: sorted({k for lo, hi, _ in x for k in (lo, hi)}) for c, x in spots.items()}
        at = values_at_ranks(clean.select(*spots), ranks, counts, rows_per_bucket)
        for c, x in spots.items():
            found[c] = [
                at[c][lo] + (at[c][hi] - at[c][lo]) * part if part else at[c][lo] for lo, hi, part in x
            ]
    return found


#: Split points of a column in one round; buckets that are still too large are split in a next one.
POINTS = 256


def _even_points(df: DataFrame, counts: dict[str, int], rows_per_bucket: int) -> dict[str, list[float]]:
    """Split points of all columns from one pass over a sample; they steer balance, never the answer."""
    wanted = {c: min(POINTS, math.ceil(n / rows_per_bucket)) for c, n in counts.items()}
    split = {c: w for c, w in wanted.items() if w > 1}
    if not split:
        return {c: [] for c in counts}
    fraction = min(1.0, max(100.0 * max(split.values()), 20_000.0) / min(counts[c] for c in split))
    probe = df.sample(fraction=fraction, seed=17) if fraction < 1 else df
    row = probe.select(*[
        F.percentile_approx(c, [float(i / w) for i in range(1, w)], F.lit(10_000)).alias(c) for c, w in split.items()
    ]).first()
    return {c: sorted(set(row[c] or [])) if c in split else [] for c in counts}


def values_at_ranks(
    df: DataFrame, ranks: dict[str, list[int]], counts: dict[str, int], rows_per_bucket: int = ROWS_PER_BUCKET
) -> dict[str, dict[int, float]]:
    """The values at the given 0-based ranks (sorted) of several columns without NaN; nulls don't count.

    Whatever the number of columns, a round takes three passes: split points from a sample, counts of
    the buckets of all columns in one aggregate, and ranks inside the buckets that hold a wanted one.
    Buckets of one repeated value are answered by their counts; wanted buckets that are still too
    large become columns of a next round, so neither tasks, plans nor the driver grow with the rows.
    """
    cols = list(ranks)
    points = _even_points(df, {c: counts[c] for c in cols}, rows_per_bucket)
    placed = df.select(*cols)
    for i, c in enumerate(cols):
        placed = range_bucket(placed, c, points[c], f"__r{i}")
    each = F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"__r{i}").alias("r"), F.col(c).alias("x")) for i, c in enumerate(cols)])
    cells = placed.select(F.inline(each)).where(F.col("x").isNotNull())
    sizes = cells.groupBy("c", "r").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    value_at: dict[str, dict[int, float]] = {c: {} for c in cols}
    inside, large = [], {}
    before, spot = [0] * len(cols), [0] * len(cols)
    # At most 2 * POINTS + 1 rows a column.
    for i, r, n, lo, hi in sorted(map(tuple, sizes.collect())):
        c, wanted = cols[i], ranks[cols[i]]
        held = []
        while spot[i] < len(wanted) and wanted[spot[i]] < before[i] + n:
            held.append(wanted[spot[i]])
            spot[i] += 1
        if held and lo == hi:
            value_at[c] |= dict.fromkeys(held, lo)
        elif held and n > 2 * rows_per_bucket:
            large[f"{i}_{r}"] = (c, lo, hi, n, before[i], held)
        else:
            inside += [(i, r, k - before[i] + 1, k) for k in held]
        before[i] += n
    if inside:
        spark = df.sparkSession
        # Two ranks for each probability at most.
        marks = F.broadcast(spark.createDataFrame([m[:3] for m in inside], "c int, r int, k int"))
        buckets = F.broadcast(spark.createDataFrame(sorted({m[:2] for m in inside}), "c int, r int"))
        order = F.row_number().over(Window.partitionBy("c", "r").orderBy("x")).alias("k")
        found = {
            (i, r, k): x
            for i, r, k, x in cells.join(buckets, ["c", "r"]).select("c", "r", order, "x").join(marks, ["c", "r", "k"]).collect()
        }
        for i, r, k, rank in inside:
            value_at[cols[i]][rank] = found[i, r, k]
    if large:
        part = df.select(*[F.when(F.col(c).between(lo, hi), F.col(c)).alias(name) for name, (c, lo, hi, *_) in large.items()])
        local = {name: [k - start for k in held] for name, (*_, start, held) in large.items()}
        deeper = values_at_ranks(part, local, {name: x[3] for name, x in large.items()}, rows_per_bucket)
        for name, (c, *_, start, held) in large.items():
            value_at[c] |= {k: deeper[name][k - start] for k in held}
    return value_at


def text_points(df: DataFrame, col: str, n: int, rows_per_bucket: int) -> list[str]:
    """Texts that cut ``col`` into about even ranges, from a sample; they steer balance only."""
    wanted = math.ceil(n / rows_per_bucket)
    if wanted < 2:
        return []
    fraction = min(1.0, max(20.0 * wanted, 2_000.0) / n)
    probe = df.sample(fraction=fraction, seed=17) if fraction < 1 else df
    found = sorted({r[0] for r in probe.select(col).collect() if r[0]}, key=lambda t: t.encode())
    step = max(1, len(found) // wanted)
    return found[step::step]


def text_bucket(col: str, points: Sequence[str]) -> Column:
    """Number of sorted ``points`` not above the text: a binary search over a constant array."""
    if not points:
        return F.lit(0)
    table = F.array(*[F.lit(p) for p in points])
    strides = [1 << i for i in reversed(range(len(points).bit_length()))]

    def step(found: Column, stride: Column) -> Column:
        return F.when(F.get(table, found + stride - 1) <= F.col(col), found + stride).otherwise(found)

    return F.aggregate(F.array(*[F.lit(x) for x in strides]), F.lit(0), step)
