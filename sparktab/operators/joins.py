"""Joins that every encoder, blend and diagnostic shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktab.session import materialize


def lookup(
    df: DataFrame,
    stats: DataFrame,
    on: str | Sequence[str],
    defaults: dict[str, float | int | str | None] | None = None,
    salts: int = 1,
) -> DataFrame:
    """Left join of per-key ``stats`` with defaults for keys that were never seen.

    No broadcast is hinted: ``stats`` may grow with the data, and adaptive execution
    broadcasts it when its measured size allows. ``salts > 1`` copies the stats and
    spreads every key over that many tasks, for hot keys beyond a broadcast.
    """
    on = [on] if isinstance(on, str) else list(on)
    keys = on
    if salts > 1:
        spread = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts)).cast("int")
        df = df.withColumn("__salt", spread)
        copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
        stats = stats.withColumn("__salt", copies)
        keys = on + ["__salt"]
    out = df.join(stats, keys, "left")
    if salts > 1:
        out = out.drop("__salt")
    for name, value in (defaults or {}).items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return out


def key_text(col: str, df: DataFrame) -> Column:
    """A value as text, for tables that hold the values of several columns; -0.0 reads as 0.0."""
    kind = df.schema[col].dataType.typeName()
    return (F.col(col) + F.lit(0.0) if kind in ("double", "float") else F.col(col)).cast("string")


def packed_table(
    frames: DataFrame, cols: Sequence[str], aggregates: Sequence[Column], extra: Sequence[str] = ()
) -> DataFrame:
    """(``__c``, ``__v``, extra, aggregates): per-value aggregates of several columns from one pass.

    Rows are unpivoted and combined map-side. The table is written once, a folder for each column,
    so that a later join knows its size: small statistics are broadcast and no fact row moves.
    Nulls are left out.
    """
    cols = list(cols)
    needed = [c for c in frames.columns if c not in cols or c in extra]
    cells = F.array(*[F.struct(F.lit(i).alias("__c"), key_text(c, frames).alias("__v")) for i, c in enumerate(cols)])
    long = frames.select(*needed, *[F.col(c) for c in cols if c not in needed], F.inline(cells))
    table = long.where(F.col("__v").isNotNull()).groupBy("__c", "__v", *extra).agg(*aggregates)
    return materialize(table, "packed", partition_by=["__c"])


def by_column(table: DataFrame, cols: Sequence[str]) -> dict[str, DataFrame]:
    """The part of a written packed table that belongs to each column."""
    return {c: table.where(F.col("__c") == i).drop("__c") for i, c in enumerate(cols)}


def packed_stats(
    frames: DataFrame, cols: Sequence[str], aggregates: Sequence[Column], extra: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """``packed_table`` by column: column -> (``__v``, extra, aggregates)."""
    return by_column(packed_table(frames, cols, aggregates, extra), cols)


def lookup_value(
    df: DataFrame, col: str, stats: DataFrame, defaults: dict | None = None, also: Sequence[str] = ()
) -> DataFrame:
    """``lookup`` of a column's ``packed_stats`` (and of the same-named columns ``also``)."""
    keyed = df.withColumn("__v", key_text(col, df))
    return lookup(keyed, stats, ["__v", *also], defaults).drop("__v")


#: Rows of one value that a task of a packed join may hold; a value with more is spread.
ROWS_PER_SALT = 1_000_000
#: Values of a column that the sketch of frequent values keeps, and those it reports.
TRACKED, REPORTED = 10_000, 100


def fits_broadcast(stats: DataFrame) -> bool:
    """Whether Spark's own size for a written table lies below its broadcast threshold."""
    size = int(str(stats._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size <= stats.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def lookup_values(
    df: DataFrame, stats: dict[str, DataFrame], defaults: dict | None = None,
    also: Sequence[str] = (), packed: bool | None = None,
) -> DataFrame:
    """Left join of the statistics of several columns: column -> (``__v``, ``also``, own value columns).

    Statistics that Spark can broadcast are joined one by one, and no fact row moves. All others go
    through one ``packed_join``, so facts move once for any number of large keys. ``packed``
    forces one way; None follows the measured sizes. New columns follow the order of ``stats``.
    """
    large = [c for c in stats if (packed if packed is not None else not fits_broadcast(stats[c]))]
    if packed is None and len(large) < 2:
        large = []
    out = packed_join(df, {c: stats[c] for c in large}, also) if large else df
    for c in stats:
        if c not in large:
            out = lookup_value(out, c, stats[c], None, also)
    made = [v for c in stats for v in stats[c].columns if v != "__v" and v not in also]
    values = [F.coalesce(F.col(v), F.lit(defaults[v])).alias(v) if v in (defaults or {}) else F.col(v) for v in made]
    return out.select(*[F.col(c) for c in df.columns if c not in made], *values)


def heavy_values(cells: DataFrame, rows_per_salt: int) -> DataFrame:
    """(__c, __v, __salts) of the values that more than ``rows_per_salt`` cells hold, by a frequency sketch.

    At most ``REPORTED`` rows a column. An estimate that is off costs balance, never a row.
    """
    top = F.call_function("approx_top_k", F.col("__v"), F.lit(REPORTED), F.lit(TRACKED))
    found = cells.groupBy("__c").agg(top.alias("__top")).select("__c", F.inline("__top"))
    found = found.select("__c", F.col("item").alias("__v"), F.ceil(F.col("count") / rows_per_salt).cast("int").alias("__salts"))
    return found.where(F.col("__salts") > 1)


def packed_join(
    df: DataFrame, stats: dict[str, DataFrame], also: Sequence[str] = (), rows_per_salt: int | None = None
) -> DataFrame:
    """``df`` with the statistics of several columns (all with value columns of the same types, in order).

    Facts are written once with a number for each row and unpivoted to cells (row, column, value).
    The cells of all columns meet their statistics in one exchange, come back by row in a second, and
    the facts themselves move once. Frequent values are spread over as many tasks as a sketch
    of their counts asks for. Nulls and unseen values give nulls.
    """
    cols, also = list(stats), list(also)
    values = {c: [v for v in stats[c].columns if v != "__v" and v not in also] for c in cols}
    rows = materialize(df.withColumn("__row", F.monotonically_increasing_id()), "facts")
    pairs = F.array(*[F.struct(F.lit(i).alias("__c"), key_text(c, df).alias("__v")) for i, c in enumerate(cols)])
    cells = rows.select("__row", *also, F.inline(pairs)).where(F.col("__v").isNotNull())
    table = None
    for i, c in enumerate(cols):
        named = [F.col(v).alias(f"__x{j}") for j, v in enumerate(values[c])]
        part = stats[c].select(F.lit(i).alias("__c"), "__v", *also, F.struct(*named).alias("__x"))
        table = part if table is None else table.unionByName(part)
    # Bounded by REPORTED rows a column; written, so that the cells are sketched once for both sides.
    heavy = F.broadcast(materialize(heavy_values(cells, rows_per_salt or ROWS_PER_SALT), "heavy"))
    salts = F.coalesce("__salts", F.lit(1))
    cells = cells.join(heavy, ["__c", "__v"], "left").withColumn("__s", F.pmod(F.xxhash64("__row"), salts).cast("int")).drop("__salts")
    table = table.join(heavy, ["__c", "__v"], "left").withColumn("__s", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    # The value comes first: its leading bytes decide most comparisons of the sort, a column number hardly any. The hint
    # keeps the plan one for all sizes: statistics that fit a broadcast are not packed unless asked for.
    met = cells.join(table.hint("merge"), ["__v", "__c", *also, "__s"]).select("__row", "__c", "__x")
    # One value for each row and name, so the largest is that value. Numbers are hashed in place, lists would be
    # sorted by row. The exchange comes first: there is nothing to combine before it.
    found = [
        F.max(F.when(F.col("__c") == i, F.col("__x")[f"__x{j}"])).alias(f"__x{i}_{j}")
        for i, c in enumerate(cols) for j, _ in enumerate(values[c])
    ]
    wide = met.repartition("__row").groupBy("__row").agg(*found)
    back = rows.join(wide, "__row", "left")
    return back.select(
        *[F.col(c) for c in df.columns],
        *[F.col(f"__x{i}_{j}").alias(v) for i, c in enumerate(cols) for j, v in enumerate(values[c])],
    )


def predictions_by_model(preds: DataFrame, by: Sequence[str] = ("id",)) -> DataFrame:
    """One row per key with ``map(model -> p)``, from one aggregation of the long table.

    Only keys that every model covers are kept, as an inner join of all models would. Several
    predictions of one model for a key (seeds) are averaged element by element.
    """
    by = list(by)
    n_models = preds.select(F.count_distinct("model")).first()[0]
    entries, named = F.col("__e"), F.array_distinct(F.transform("__e", lambda e: e["model"]))
    averaged = F.transform(
        named, lambda m: F.struct(m.alias("model"), _mean_vector(F.filter("__e", lambda e: e["model"] == m)).alias("p"))
    )
    return (
        preds.groupBy(*by)
        .agg(F.collect_list(F.struct("model", "p")).alias("__e"))
        .where(F.size(named) == n_models)
        .select(
            *by, F.map_from_entries(F.when(F.size(entries) > n_models, averaged).otherwise(entries)).alias("models")
        )
    )


def _mean_vector(entries: Column) -> Column:
    """Element-wise mean of the vectors ``p`` of several entries."""
    return F.transform(
        F.sequence(F.lit(0), F.size(entries[0]["p"]) - 1),
        lambda i: F.aggregate(entries, F.lit(0.0), lambda s, e: s + e["p"][i]) / F.size(entries),
    )


def model_cells(models: Sequence[str], k: int | None = None) -> tuple[list[Column], list[Column]]:
    """Aggregates of a long table, and the array column of each model made from their results.

    Each model's array is that of one of its rows, null without one. With ``k``, the length of the arrays, numbers are
    aggregated, which hashing can do; arrays would be sorted by key before and after they move.
    """
    if k is None or k > 31:
        whole = [F.first(F.when(F.col("model") == m, F.col("p")), ignorenulls=True).alias(m) for m in models]
        return whole, [F.col(f"`{m}`") for m in models]
    gaps = sum((F.when(F.col("p")[i].isNull(), 1 << i).otherwise(0) for i in range(k)), F.lit(0))
    aggs, made = [], []
    for j, m in enumerate(models):
        own = (F.col("model") == m) & F.col("p").isNotNull()
        aggs.append(F.first(F.when(own, gaps), ignorenulls=True).alias(f"__gaps{j}"))
        cells = []
        for i in range(k):
            # A missing number is kept as 0 and a bit, so that all numbers come from the same row.
            held = F.when(own, F.coalesce(F.col("p")[i], F.lit(0.0)))
            aggs.append(F.first(held, ignorenulls=True).alias(f"__cell{j}_{i}"))
            cells.append(F.when(F.col(f"__gaps{j}").bitwiseAND(F.lit(1 << i)) == 0, F.col(f"__cell{j}_{i}")))
        made.append(F.when(F.col(f"__gaps{j}").isNotNull(), F.array(*cells)).alias(m))
    return aggs, made


def model_columns(
    preds: DataFrame, models: Sequence[str], keep: Sequence[str] = ("y",), by: Sequence[str] = ("id",),
    k: int | None = None,
) -> DataFrame:
    """One row per key with one array column per named model (inner on key); ``k`` as in ``model_cells``."""
    picked = preds.where(F.col("model").isin(list(models)))
    aggs, made = model_cells(models, k)
    wide = picked.groupBy(*by).agg(*[F.first(c, ignorenulls=True).alias(c) for c in keep], *aggs)
    return wide.select(*by, *keep, *made).dropna(subset=list(models))


def attach_pseudo(test: DataFrame, pseudo: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of ``test`` that have a pseudo label, joined on the key."""
    return test.join(pseudo, id_col, "inner")


def carry_over(new: DataFrame, old: DataFrame, on: Sequence[str] = ("model",)) -> DataFrame:
    """Rows of ``old`` whose ``on`` values are absent from ``new``, followed by ``new``."""
    return old.join(new.select(*on).distinct(), list(on), "left_anti").unionByName(new)


def stack_sources(frames: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """Union of frames by column name with a source tag; absent columns become null."""
    out: DataFrame | None = None
    for name, frame in frames.items():
        tagged = frame.withColumn(tag, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no frames given")
    return out


def overlap(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct rows over ``cols`` that occur in both frames."""
    return a.select(*cols).intersect(b.select(*cols))


def only_in(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows over ``cols`` of ``a`` that ``b`` lacks, with multiplicity."""
    return a.select(*cols).exceptAll(b.select(*cols))


def label_changes(a: DataFrame, b: DataFrame, id_col: str, label: str) -> DataFrame:
    """Keys whose label differs between two answer tables."""
    return (
        a.select(id_col, F.col(label).alias("label_a"))
        .join(b.select(id_col, F.col(label).alias("label_b")), id_col)
        .where(F.col("label_a") != F.col("label_b"))
    )


def score_against_candidates(
    df: DataFrame, exprs: dict[str, Column], by: Sequence[str]
) -> DataFrame:
    """Sum one numeric expression per candidate and group: rows x candidates without a join.

    The candidates are literals inside the expressions, so rows are never multiplied and
    one partial aggregate per task leaves the map side.
    """
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(e).alias(name) for name, e in exprs.items()]
    )
