"""Classification metrics and diagnostics from one aggregate per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktab.functions.exprs import clip, total
from sparktab.functions.proba import METRIC_BOUNDS, argmax_of, normalize_parts, parts, rule_scores
from sparktab.operators.gram import agreement_pairs, named_pairs
from sparktab.operators.ranks import range_bucket, running_sums, split_points


def confusion(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, y, pred).agg(F.count(F.lit(1)).alias("n"))


def class_counts(
    df: DataFrame, y: str, pred: str, k: int, by: Sequence[str] = (), extra: dict[str, Column] | None = None
) -> DataFrame:
    """Per group: ``n_c`` true rows, ``hit_c`` right rows, ``said_c`` predicted rows."""
    aggs = []
    for c in range(k):
        aggs += [
            F.sum((F.col(y) == c).cast("long")).alias(f"n_{c}"),
            F.sum(((F.col(y) == c) & (F.col(pred) == c)).cast("long")).alias(f"hit_{c}"),
            F.sum((F.col(pred) == c).cast("long")).alias(f"said_{c}"),
        ]
    aggs += [e.alias(name) for name, e in (extra or {}).items()]
    aggs.append(F.count(F.lit(1)).alias("rows"))
    return df.groupBy(*by).agg(*aggs)


def recall_of(c: int) -> Column:
    return F.when(F.col(f"n_{c}") > 0, F.col(f"hit_{c}") / F.col(f"n_{c}")).otherwise(0.0)


def balanced_accuracy(k: int, absent: str = "skip") -> Column:
    """Mean class recall over classes present in the truth, or over all with ``'zero'``."""
    s = total([recall_of(c) for c in range(k)])
    if absent == "zero":
        return s / k
    present = total([(F.col(f"n_{c}") > 0).cast("int") for c in range(k)])
    return F.when(present > 0, s / present).otherwise(0.0)


def _labels_seen(k: int) -> Column:
    return total([((F.col(f"n_{c}") + F.col(f"said_{c}")) > 0).cast("int") for c in range(k)])


def macro_f1(k: int) -> Column:
    """Labels are the union of truth and prediction; zero division counts 0."""
    f1 = [
        F.when(
            F.col(f"n_{c}") + F.col(f"said_{c}") > 0,
            2 * F.col(f"hit_{c}") / (F.col(f"n_{c}") + F.col(f"said_{c}")),
        ).otherwise(0.0)
        for c in range(k)
    ]
    seen = _labels_seen(k)
    return F.when(seen > 0, total(f1) / seen).otherwise(0.0)


def macro_recall(k: int) -> Column:
    seen = _labels_seen(k)
    return F.when(seen > 0, total([recall_of(c) for c in range(k)]) / seen).otherwise(0.0)


def accuracy(k: int) -> Column:
    return F.when(F.col("rows") > 0, total([F.col(f"hit_{c}") for c in range(k)]) / F.col("rows"))


def log_loss(y: str, p: str, k: int) -> Column:
    """Aggregate: mean of ``-ln p[y]`` after clipping and normalizing."""
    probs = normalize_parts(parts(p, k))
    chosen = F.when(F.col(y) == 0, probs[0])
    for c in range(1, k):
        chosen = chosen.when(F.col(y) == c, probs[c])
    return F.avg(-F.ln(chosen))


def evaluate(
    df: DataFrame,
    y: str,
    p: str,
    k: int,
    by: Sequence[str] = (),
    bias: Sequence[float] | None = None,
) -> DataFrame:
    """Balanced accuracy, macro F1, macro recall, accuracy, log loss and class recalls."""
    logs = [F.ln(clip(c, *METRIC_BOUNDS)) for c in normalize_parts(parts(p, k))]
    scores = rule_scores(logs, "bias", bias) if bias is not None else parts(p, k)
    scored = df.withColumn("__pred", argmax_of(scores))
    counts = class_counts(scored, y, "__pred", k, by, {"log_loss": log_loss(y, p, k)})
    return counts.select(
        *by,
        balanced_accuracy(k).alias("balanced_accuracy"),
        macro_f1(k).alias("macro_f1"),
        macro_recall(k).alias("macro_recall"),
        accuracy(k).alias("accuracy"),
        "log_loss",
        *[recall_of(c).alias(f"recall_{c}") for c in range(k)],
        "rows",
    )


def score_labels(
    df: DataFrame, y: str, pred: str, k: int, by: Sequence[str] = (), absent: str = "skip"
) -> DataFrame:
    """Label metrics when only predicted classes exist."""
    return class_counts(df, y, pred, k, by).select(
        *by,
        balanced_accuracy(k, absent).alias("balanced_accuracy"),
        macro_f1(k).alias("macro_f1"),
        macro_recall(k).alias("macro_recall"),
        accuracy(k).alias("accuracy"),
        *[recall_of(c).alias(f"recall_{c}") for c in range(k)],
        "rows",
    )


def fold_report(df: DataFrame, y: str, p: str, k: int, by: Sequence[str] = (), fold: str = "fold") -> DataFrame:
    """Balanced accuracy mean and spread over folds, fold sizes, and the pooled score.

    Fold counts add up to the pooled counts, so the rows are read once.
    """
    scored = df.withColumn("__pred", argmax_of(parts(p, k)))
    per_fold = class_counts(scored, y, "__pred", k, [*by, fold]).withColumn(
        "__ba", balanced_accuracy(k)
    )
    pooled = per_fold.groupBy(*by).agg(
        F.count(F.lit(1)).alias("folds"),
        F.avg("__ba").alias("mean_score"),
        F.stddev_pop("__ba").alias("std_score"),
        F.min("rows").alias("min_rows"),
        F.max("rows").alias("max_rows"),
        *[F.sum(c).alias(c) for c in per_fold.columns if c.startswith(("n_", "hit_", "said_"))],
    )
    return pooled.select(
        *by, "folds", "mean_score", "std_score", "min_rows", "max_rows",
        balanced_accuracy(k).alias("oof_score"),
    )


def auc(
    df: DataFrame, y: str, score: str, by: Sequence[str] = (), rows_per_bucket: int = 2_000_000
) -> DataFrame:
    """Exact ROC area with ties averaged, per group.

    Rows are first combined per distinct score; the running count of negatives uses range
    buckets, so no task sorts a whole group.
    """
    pos = F.sum((F.col(y) == 1).cast("long")).alias("pos")
    neg = F.sum((F.col(y) != 1).cast("long")).alias("neg")
    points = split_points(df, score, rows_per_bucket)
    grouped = range_bucket(
        df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(*by, score).agg(pos, neg),
        score, points, "__b",
    )
    ran = running_sums(grouped, by, ["__b"], [score], {"neg_upto": F.col("neg")})
    below = F.col("neg_upto") - F.col("neg") / 2
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return ran.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("pos") * below), pairs).alias("auc"),
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
    )


def pairwise_agreement(wide: DataFrame, models: Sequence[str], y: str = "y") -> DataFrame:
    """Per model pair: share of equal predictions, and errors in common over errors in either.

    ``wide`` holds one predicted-class column per model. One scan serves all pairs: tasks multiply
    matrices of indicators (``gram``).
    """
    if len(models) < 2:
        raise ValueError("at least two models are needed")
    sums = named_pairs(agreement_pairs(wide, models, y), models, "model_a", "model_b")
    return sums.select(
        "model_a", "model_b", F.try_divide("same", "n").alias("agreement"),
        F.coalesce(F.try_divide("both", "either"), F.lit(0.0)).alias("error_jaccard"),
    )


def oracle_coverage(wide: DataFrame, models: Sequence[str], k: int, y: str = "y") -> DataFrame:
    """Accuracy and mean class recall if any model's right answer counted."""
    right = F.greatest(*[(F.col(m) == F.col(y)).cast("int") for m in models])
    marked = wide.withColumn("__pred", F.when(right == 1, F.col(y)).otherwise(-1))
    return class_counts(marked, y, "__pred", k).select(
        accuracy(k).alias("any_right"), balanced_accuracy(k).alias("any_right_recall")
    )


def compare_sets(
    a: DataFrame, b: DataFrame, coverage_a: DataFrame | None = None, coverage_b: DataFrame | None = None
) -> DataFrame:
    """Differences of mean agreement and mean error overlap between two model sets (``pairwise_agreement``),
    and with both sets' ``oracle_coverage`` of its two figures."""

    def summary(pairs: DataFrame, tag: str) -> DataFrame:
        return pairs.agg(
            F.avg("agreement").alias("agreement"), F.avg("error_jaccard").alias("jaccard")
        ).withColumn("which", F.lit(tag))

    both = summary(a, "a").unionByName(summary(b, "b"))

    def pick(col: str, tag: str) -> Column:
        return F.max(F.when(F.col("which") == tag, F.col(col)))

    out = both.agg(
        (pick("agreement", "b") - pick("agreement", "a")).alias("agreement_delta"),
        (pick("jaccard", "b") - pick("jaccard", "a")).alias("jaccard_delta"),
    )
    if coverage_a is None or coverage_b is None:
        return out
    names = ["any_right", "any_right_recall"]
    tagged = coverage_a.withColumn("which", F.lit("a")).unionByName(coverage_b.withColumn("which", F.lit("b")))
    deltas = tagged.agg(*[(pick(n, "b") - pick(n, "a")).alias(f"{n}_delta") for n in names])
    # One row on either side.
    return out.withColumn("__one", F.lit(1)).join(deltas.withColumn("__one", F.lit(1)), "__one").drop("__one")


def optimism_gap(naive: DataFrame, nested: DataFrame, on: Sequence[str], score: str = "score") -> DataFrame:
    """Naive minus nested score per key."""
    return (
        naive.select(*on, F.col(score).alias("naive"))
        .join(nested.select(*on, F.col(score).alias("nested")), list(on))
        .withColumn("gap", F.col("naive") - F.col("nested"))
    )


def paired_delta(
    scores: DataFrame, base: DataFrame, by: Sequence[str], on: Sequence[str] = ("fold",), score: str = "score"
) -> DataFrame:
    """Mean and population spread of per-fold differences against a baseline."""
    paired = scores.join(base.select(*on, F.col(score).alias("__base")), list(on))
    delta = F.col(score) - F.col("__base")
    return paired.groupBy(*by).agg(
        F.avg(delta).alias("mean_delta"),
        F.stddev_pop(delta).alias("std_delta"),
        F.sum((delta > 0).cast("long")).alias("wins"),
    )


def answer_diff(a: DataFrame, b: DataFrame, id_col: str, label: str) -> DataFrame:
    """Counts of changed answers per (old label, new label)."""
    return (
        a.select(id_col, F.col(label).alias("label_a"))
        .join(b.select(id_col, F.col(label).alias("label_b")), id_col)
        .where(F.col("label_a") != F.col("label_b"))
        .groupBy("label_a", "label_b")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def regression_scores(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE and RMSLE (negative values clipped to 0 for the logarithm)."""
    err = F.col(pred) - F.col(y)
    log_err = F.log1p(F.greatest(F.col(pred), F.lit(0.0))) - F.log1p(
        F.greatest(F.col(y), F.lit(0.0))
    )
    return df.groupBy(*by).agg(
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(log_err * log_err)).alias("rmsle"),
    )
