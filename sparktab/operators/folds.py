"""Folds and samples by key: seeded, exact, independent of row order and partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparktab.functions.exprs import hash_text
from sparktab.operators.encoders import class_weights
from sparktab.operators.ranks import hash_digits, hash_rank
from sparktab.session import materialize

SAMPLE_ROWS = 2_000


def stratified_folds(
    df: DataFrame, key: str, y: str, k: int, seed: int, out: str = "fold", by: Sequence[str] = ()
) -> DataFrame:
    """Fold number 0..k-1; per class the fold sizes differ by at most one."""
    ranked = hash_rank(df, [*by, y], key, seed, "__rank")
    return ranked.withColumn(out, ((F.col("__rank") - 1) % k).cast("int")).drop("__rank")


def inner_folds(
    df: DataFrame, key: str, y: str, fold: str, k_outer: int, k_inner: int, seed: int
) -> DataFrame:
    """Stratified folds inside every outer-train block.

    Each row appears once per outer fold other than its own: ``outer`` names the block,
    ``inner`` the fold inside it.
    """
    others = F.filter(F.array(*[F.lit(i) for i in range(k_outer)]), lambda f: f != F.col(fold))
    spread = df.withColumn("outer", F.explode(others))
    return stratified_folds(spread, key, y, k_inner, seed, "inner", by=["outer"])


def kfold(df: DataFrame, key: str, k: int, seed: int, out: str = "fold") -> DataFrame:
    """Plain folds from the key hash: no shuffle, sizes even in expectation."""
    digits = F.conv(F.substring(hash_text(key, seed), 1, 8), 16, 10).cast("long")
    return df.withColumn(out, (digits % k).cast("int"))


def group_kfold(df: DataFrame, group: str, k: int, seed: int, out: str = "fold") -> DataFrame:
    """All rows of a group share one fold."""
    return kfold(df, group, k, seed, out)


def time_split(df: DataFrame, ts: str, cut: str, out: str = "split") -> DataFrame:
    return df.withColumn(out, F.when(F.col(ts) < F.lit(cut).cast("timestamp"), "train").otherwise("valid"))


def lowest_hashes(df: DataFrame, by: Sequence[str], key: str, seed: int, take: DataFrame) -> DataFrame:
    """The ``take`` rows with the smallest hash per group, exactly.

    ``take`` has the ``by`` columns and ``__take``. Hash-prefix counts show in which prefix
    the cut falls. Rows of later prefixes are dropped before any shuffle by a join with that
    small table, so only about ``take`` rows are ranked.
    """
    by = list(by)
    hashed = df.withColumn("__h", hash_text(key, seed)).withColumn(
        "__b", F.substring("__h", 1, hash_digits(df, by, SAMPLE_ROWS))
    )
    counts = hashed.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*by).orderBy("__b"))
    need = (
        counts.withColumn("__upto", upto)
        .join(take, by)
        .where(F.col("__upto") - F.col("__n") < F.col("__take"))
        .select(*by, "__b", (F.col("__take") - (F.col("__upto") - F.col("__n"))).alias("__need"))
    )
    place = F.row_number().over(Window.partitionBy(*by, "__b").orderBy("__h", key))
    ranked = hashed.join(need, [*by, "__b"]).withColumn("__k", place)
    return ranked.where(F.col("__k") <= F.col("__need")).select(*df.columns)


def stratified_sample(df: DataFrame, key: str, y: str, n: int, seed: int) -> DataFrame:
    """``round(n * n_c / N)`` rows per class, at least one; everything when ``n >= N``."""
    sizes = df.groupBy(y).agg(F.count(F.lit(1)).alias("__c"))
    rows = df.count()
    share = F.rint(F.lit(float(n)) * F.col("__c") / F.lit(rows)).cast("long")
    wanted = F.col("__c") if n >= rows else F.least(F.greatest(share, F.lit(1)), "__c")
    return lowest_hashes(df, [y], key, seed, sizes.select(y, wanted.alias("__take")))


def balanced_sample(
    df: DataFrame, key: str, y: str, per_class: int, seed: int, by: Sequence[str] = ()
) -> DataFrame:
    """At most ``per_class`` rows of every class (per ``by`` group)."""
    groups = [*by, y]
    take = df.select(*groups).distinct().withColumn("__take", F.lit(per_class))
    return lowest_hashes(df, groups, key, seed, take)


def fit_pool(
    train: DataFrame,
    fold: int,
    y: str,
    aux: DataFrame | None = None,
    aux_weight: float = 0.3,
    pseudo: DataFrame | None = None,
    pseudo_weight: float = 0.1,
    fold_col: str = "fold",
    balanced: bool = True,
) -> DataFrame:
    """Rows a model of fold ``fold`` may learn from, with weights.

    Other folds, pseudo-labelled rows and auxiliary rows are pooled; class-balanced
    weights come from the pooled labels and are then scaled by source (``balanced=False``
    leaves the class part to the learner). Auxiliary and pseudo rows never take part in
    validation.
    """
    pool = train.where(F.col(fold_col) != fold).withColumn("source", F.lit("train"))
    if pseudo is not None:
        pool = pool.unionByName(pseudo.withColumn("source", F.lit("pseudo")), allowMissingColumns=True)
    if aux is not None:
        pool = pool.unionByName(aux.withColumn("source", F.lit("aux")), allowMissingColumns=True)
    scale = (
        F.when(F.col("source") == "aux", aux_weight)
        .when(F.col("source") == "pseudo", pseudo_weight)
        .otherwise(1.0)
    )
    if not balanced:
        return pool.withColumn("w", scale)
    return class_weights(pool, y, out="w").withColumn("w", F.col("w") * scale)


#: Intervals of the score that one round of ``top_rows`` counts.
INTERVALS = 1024


def top_rows(
    df: DataFrame, by: Sequence[str], score: str, key: str, n: int, low: float, high: float,
    rows_at_cut: int = 1_000_000, seed: int = 0,
) -> DataFrame:
    """The ``n`` rows of highest ``score`` of each ``by`` group; ties by ``(md5(seed:key), key)``.

    ``low`` and ``high`` say where scores are expected; others are right too, only less evenly cut.
    Scores are counted in intervals first. Rows above the interval that holds the cut stay where
    they are, and only those inside it are ranked. An interval of more than ``rows_at_cut`` rows
    is counted again in finer ones, or cut by hash if it holds one score. NaN is the highest score;
    rows without a score are left out; null groups are groups.
    """
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("one"))
    rows = df.where(F.col(score).isNotNull()).withColumn("__g", group)
    asked = rows.select("__g", F.col(score).alias("__x"))
    state = None
    while True:
        seen = asked if state is None else asked.join(state, "__g").where(F.col("__x").between(F.col("__lo"), F.col("__hi")))
        lo, hi = (F.lit(float(low)), F.lit(float(high))) if state is None else (F.col("__lo"), F.col("__hi"))
        share = F.when(hi > lo, (F.col("__x") - lo) / (hi - lo)).otherwise(F.lit(0.0))
        inner = F.greatest(F.lit(0), F.least(F.lit(INTERVALS - 1), F.floor(share * INTERVALS)))
        endless = F.lit(float("inf"))
        place = (
            F.when(F.isnan("__x"), INTERVALS + 1).when(F.col("__x") == endless, INTERVALS)
            .when(F.col("__x") == -endless, -1).otherwise(inner)
        )
        start = F.lit(0).cast("long") if state is None else F.min("__above")
        counts = seen.groupBy("__g", place.cast("int").alias("__i")).agg(
            F.count(F.lit(1)).alias("__n"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"), start.alias("__start")
        )
        upto = F.col("__start") + F.sum("__n").over(Window.partitionBy("__g").orderBy(F.col("__i").desc()))
        cut = counts.withColumn("__above", upto - F.col("__n")).where((F.col("__above") < n) & (F.col("__above") + F.col("__n") >= n))
        found = cut.select("__g", "__lo", "__hi", "__above", "__n", (F.col("__lo") < F.col("__hi")).alias("__wide"))
        found = materialize(found, "cuts")
        settled = found.where(~F.col("__wide") | (F.col("__n") <= rows_at_cut))
        again = found.where(F.col("__wide") & (F.col("__n") > rows_at_cut))
        done = settled if state is None else done.unionByName(settled)
        if again.isEmpty():
            break
        state = again.select("__g", "__lo", "__hi", "__above")
    done = materialize(done, "cuts")
    joined = rows.join(done, "__g", "left")
    x = F.col(score)
    inside = x.between(F.col("__lo"), F.col("__hi"))
    # Groups without a cut have no more than n rows.
    above = joined.where(F.col("__lo").isNull() | (x > F.col("__hi"))).select(*df.columns)
    at_cut = joined.where(inside)
    order = Window.partitionBy("__g").orderBy(x.desc(), hash_text(key, seed), key)
    few = at_cut.where(F.col("__n") <= rows_at_cut).withColumn("__k", F.row_number().over(order))
    kept = above.unionByName(few.where(F.col("__k") <= n - F.col("__above")).select(*df.columns))
    many = done.where(F.col("__n") > rows_at_cut)
    if many.isEmpty():
        return kept
    take = many.select("__g", (n - F.col("__above")).alias("__take"))
    ties = lowest_hashes(at_cut.where(F.col("__n") > rows_at_cut).select(*df.columns, "__g"), ["__g"], key, seed, take)
    return kept.unionByName(ties.select(*df.columns))


def confident_rows(
    preds: DataFrame, key: str, p: str, k: int, threshold: float = 0.995, cap: int | None = None,
    by: Sequence[str] = (), rows_at_cut: int = 1_000_000,
) -> DataFrame:
    """Pseudo labels: rows whose top probability reaches ``threshold``.

    Above ``cap`` rows per group only the most confident stay. The confident rows are written
    once; where the cut lies is found from counts of score intervals (``top_rows``).
    """
    from sparktab.functions.proba import argmax, parts

    top = preds.withColumn("conf", F.greatest(*parts(p, k))).withColumn("label", argmax(p, k))
    top = top.where(F.col("conf") >= threshold)
    if cap is None:
        return top
    return top_rows(materialize(top, "confident"), by, "conf", key, cap, threshold, 1.0, rows_at_cut)


def bootstrap_members(spark, models: Sequence[str], bags: int, seed: int) -> DataFrame:
    """``(bag, slot, model)``: the model list drawn with replacement, once per bag."""
    import random

    rng = random.Random(seed)
    rows = [
        (bag, slot, rng.choice(list(models))) for bag in range(bags) for slot in range(len(models))
    ]
    return spark.createDataFrame(rows, "bag int, slot int, model string")


def swap_noise(df: DataFrame, key: str, cols: Sequence[str], p: float, seed: int) -> DataFrame:
    """With probability ``p`` replace a cell by the same column's value in another row.

    The donor is the next row in a hashed order of the keys (the last takes the first), a
    different order per column. The next row is found inside the hash prefix; the last row of
    a prefix takes the first of the following one, from a table with a row per prefix; their
    number follows the row count. One shuffle per column.
    """
    limit = int(p * 16**7)
    digits = hash_digits(df, [])
    out = df
    for i, c in enumerate(cols):
        hashed = out.withColumn("__h", hash_text(key, seed + 2 * i)).withColumn(
            "__b", F.substring("__h", 1, digits)
        )
        heads = hashed.groupBy("__b").agg(
            F.min_by(F.struct(c), F.struct("__h", key)).alias("__head")
        )
        every = Window.orderBy("__b")
        following = heads.select(
            "__b",
            F.coalesce(
                F.lead("__head").over(every),
                F.first("__head").over(every.rowsBetween(Window.unboundedPreceding, 0)),
            ).alias("__next"),
        )
        inside = F.lead(F.struct(c)).over(Window.partitionBy("__b").orderBy("__h", key))
        drawn = F.conv(F.substring(hash_text(key, seed + 2 * i + 1), 1, 7), 16, 10).cast("long")
        donor = F.coalesce(F.col("__inside"), F.col("__next"))[c]
        out = (
            hashed.withColumn("__inside", inside)
            .join(following, "__b", "left")
            .withColumn(c, F.when(drawn < limit, donor).otherwise(F.col(c)))
            .select(*df.columns)
        )
    return out


def swap_cells(df: DataFrame, key: str, cols: Sequence[str], p: float, seed: int) -> DataFrame:
    """Swap noise for many columns: as ``swap_noise``, with one hashed order for all of them.

    Rows are ranked once in a hashed order of the keys. The donors of a column are the rows a fixed
    number of ranks further, in a circle; the number differs from column to column, so a row that
    takes several cells takes them from different rows, and with ``p`` = 1 every value is used as
    often as before. Donors send their cells to the rows that drew them, so a row moves once and a
    drawn cell once, whatever the number of columns. Nulls are swapped like other values; repeated
    and null keys are rows of their own. A single row keeps its values.
    """
    cols = list(dict.fromkeys(cols))
    ranked = materialize(hash_rank(df, [], key, seed, "__k").withColumn("__k", F.col("__k") - 1), "ranked")
    n = ranked.count()
    if n < 2 or not cols:
        return ranked.select(*df.columns)
    kinds = [ranked.schema[c].dataType for c in cols]
    # One field for each type of value.
    fields = {kind.simpleString(): (f"v{i}", kind) for i, kind in enumerate(kinds)}
    limit = int(p * 16**7)
    cells = []
    for i, c in enumerate(cols):
        shift = 1 + (seed * 1_000_003 + i) % (n - 1)
        to = F.pmod(F.col("__k") - F.lit(shift), F.lit(n))
        drawn = F.conv(F.substring(hash_text(to, seed + 1 + i), 1, 7), 16, 10).cast("long") < limit
        held = [
            (F.col(c) if name == kinds[i].simpleString() else F.lit(None).cast(kind)).alias(field)
            for name, (field, kind) in fields.items()
        ]
        cells.append(F.struct(F.when(drawn, to).alias("to"), F.lit(i).alias("i"), F.struct(*held).alias("v")))
    sent = ranked.select(F.inline(F.array(*cells))).where(F.col("to").isNotNull())
    # At most one cell for each column.
    taken = sent.groupBy("to").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("__taken"))
    joined = ranked.join(taken.withColumnRenamed("to", "__k"), "__k", "left")
    new = {}
    for i, c in enumerate(cols):
        cell = F.try_element_at("__taken", F.lit(i))
        new[c] = F.when(cell.isNotNull(), cell[fields[kinds[i].simpleString()][0]]).otherwise(F.col(c)).alias(c)
    return joined.select(*[new.get(c, F.col(c)) for c in df.columns])
