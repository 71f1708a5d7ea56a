"""Roll-ups of experiments, submissions, usage and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktab.operators.ranks import ROWS_PER_BUCKET, best_before, range_bucket, running_sums, split_points


def time_ranges(df: DataFrame, ts: str, rows_per_bucket: int) -> DataFrame:
    """``__t``: number of the measured range of time that holds the row; null times come first."""
    timed = df.withColumn("__u", F.unix_micros(F.col(ts).cast("timestamp")).cast("double"))
    points = split_points(timed, "__u", rows_per_bucket)
    placed = range_bucket(timed, "__u", points, "__t")
    return placed.withColumn("__t", F.coalesce("__t", F.lit(-1))).drop("__u")


def running_best(
    df: DataFrame, group: str, ts: str, key: str, score: str, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Best earlier score per group and whether the row is a new best (strictly greater).

    A missing score never becomes the best. Ranges of time, cut so that each holds about
    ``rows_per_bucket`` rows, keep one busy group off one task.
    """
    placed = time_ranges(df, ts, rows_per_bucket)
    out = best_before(placed, [group], ["__t"], [ts, key], score, "best_before").drop("__t")
    is_best = F.col(score).isNotNull() & (
        F.col("best_before").isNull() | (F.col(score) > F.col("best_before"))
    )
    return out.withColumn("is_best", is_best)


def last_n(df: DataFrame, group: str, ts: str, key: str, n: int) -> DataFrame:
    """Newest ``n`` rows per group. The rank filter is applied before the shuffle as well,
    so a busy group ships ``n`` rows per task."""
    newest = Window.partitionBy(group).orderBy(F.col(ts).desc(), F.col(key).desc())
    return df.withColumn("__k", F.row_number().over(newest)).where(F.col("__k") <= n).drop("__k")


def top_k(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """Ranked leaderboard: best score first, ties by key."""
    return df.orderBy(F.col(score).desc(), F.col(key).asc()).limit(k)


def shorten(c: Column, width: int = 50) -> Column:
    return F.when(F.char_length(c) > width, F.concat(F.substring(c, 1, width), F.lit("..."))).otherwise(c)


def experiment_summary(df: DataFrame, group: str, key: str, score: str, success: str) -> DataFrame:
    """Per group: number of experiments, successes, the best one and its score."""
    best = F.max(F.when(F.col(score).isNotNull(), F.struct(F.col(score), (-F.col(key)).alias("k"))))
    return (
        df.groupBy(group)
        .agg(
            F.count(F.lit(1)).alias("total_experiments"),
            F.count_if(F.col(success)).alias("successful"),
            best.alias("__best"),
        )
        .select(
            group, "total_experiments", "successful",
            (-F.col("__best.k")).alias("best_experiment"),
            F.col(f"__best.{score}").alias("best_cv_score"),
        )
    )


def experiment_list(df: DataFrame, key: str, text: str, cols: Sequence[str]) -> DataFrame:
    """One line per experiment with a shortened hypothesis."""
    return df.select(key, shorten(F.col(text)).alias(text), *cols)


def cv_lb_monitor(df: DataFrame, group: str, ts: str, key: str, cv: str, lb: str, threshold: float) -> DataFrame:
    """Gap between validation and leaderboard score, alarm above ``threshold``, and whether
    the validation score beat everything before it (only then a submission is due)."""
    out = running_best(df, group, ts, key, cv)
    gap = F.col(cv) - F.col(lb)
    return out.select(
        group, key, cv, lb, gap.alias("gap"),
        F.coalesce(F.abs(gap) > threshold, F.lit(False)).alias("alarm"),
        F.col("is_best").alias("submit"),
    )


def shakedown(df: DataFrame, key: str, cv: str, public: str, private: str, n: int) -> DataFrame:
    """Entries by public-private drop, largest first, with the excess of public over CV."""
    out = df.select(
        key,
        (F.col(public) - F.col(private)).alias("drop"),
        (F.col(public) - F.col(cv)).alias("excess"),
    )
    return out.orderBy(F.col("drop").desc(), key).limit(n)


def shakedown_correlation(df: DataFrame, cv: str, public: str, private: str) -> DataFrame:
    """How well the excess of public over CV predicts the drop."""
    return df.agg(
        F.corr(F.col(public) - F.col(private), F.col(public) - F.col(cv)).alias("corr"),
        F.avg(F.col(public) - F.col(private)).alias("mean_drop"),
    )


def usage_rollup(df: DataFrame, provider: str, prompt: str, completion: str, cost: str) -> DataFrame:
    """Tokens and cost per provider and in total (provider ``ALL``)."""
    sums = [
        F.count(F.lit(1)).alias("calls"),
        F.sum(prompt).alias("prompt_tokens"),
        F.sum(completion).alias("completion_tokens"),
        F.sum(F.col(prompt) + F.col(completion)).alias("total_tokens"),
        F.sum(cost).alias("cost_usd"),
    ]
    per = df.groupBy(provider).agg(*sums)
    names = ["calls", "prompt_tokens", "completion_tokens", "total_tokens", "cost_usd"]
    return per.rollup(provider).agg(*[F.sum(c).alias(c) for c in names]).select(
        F.coalesce(provider, F.lit("ALL")).alias(provider), *names
    )


def within_budget(
    df: DataFrame, ts: str, key: str, cost: str, budget: float, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Calls made while the money spent before them was below ``budget``."""
    placed = time_ranges(df, ts, rows_per_bucket)
    ran = running_sums(placed, [], ["__t"], [ts, key], {"spent": F.col(cost)})
    return ran.where(F.col("spent") - F.col(cost) < budget).drop("__t")


def validation_rollup(df: DataFrame, skill: str, competition: str, gain: str, needed: int = 3) -> DataFrame:
    """Distinct competitions, mean gain over all observations, validated at ``needed``."""
    per = df.groupBy(skill, competition).agg(
        F.sum(gain).alias("__s"), F.count(gain).alias("__n")
    )
    return per.groupBy(skill).agg(
        F.count(F.lit(1)).alias("competitions"),
        F.try_divide(F.sum("__s"), F.sum("__n")).alias("avg_gain"),
        (F.count(F.lit(1)) >= needed).alias("validated"),
    )


def rank_techniques(
    df: DataFrame, kind: str, words: Sequence[str], n: int, types: str = "types",
    conditions: str = "conditions", validated: str = "validated", gain: str = "avg_gain", name: str = "name",
) -> DataFrame:
    """Techniques of a type whose conditions mention any word: validated first, then by gain."""
    hit = F.array_contains(types, kind)
    if words:
        any_word = F.lit(False)
        for w in words:
            any_word = any_word | F.lower(conditions).contains(w.lower())
        hit = hit & any_word
    return (
        df.where(hit)
        .orderBy(
            F.col(validated).cast("int").desc(), F.coalesce(gain, F.lit(0.0)).desc(), F.col(name)
        )
        .limit(n)
    )


# Failure signatures in order of precedence: the first match wins (fixed values).
SIGNATURES = (
    ("no_kernel_image", r"no kernel image is available|no kernel image"),
    ("cudf_pascal_dropped", r"invalid device ordinal"),
    ("slug_poisoned", r"notebook not found"),
    (
        "catboost_float_cat_features",
        r"cat_features.*float|float.*cat_features|floating point|"
        r"cat_feature.*must be (?:integer|int)|"
        r"categorical.*not of type int|not of type int.*categor",
    ),
    (
        "bad_oof_shape",
        r"is not divisible by 3|cannot reshape|shape mismatch|could not broadcast",
    ),
    ("oom", r"out of memory|outofmemoryerror|killed"),
)

# Keywords that type a task description (fixed values).
TASK_WORDS = (
    ("cv", ("image", "photo", "picture", "vision")),
    ("nlp", ("text", "nlp", "language", "sentence")),
)


def diagnosis(c: Column) -> Column:
    """Name of the first matching failure signature, else ``unknown``."""
    out = F.lit("unknown")
    for name, pattern in reversed(SIGNATURES):
        out = F.when(c.rlike(f"(?i){pattern}"), name).otherwise(out)
    return F.when(c.isNotNull(), out).otherwise("unknown")


def diagnose_logs(df: DataFrame, group: str, line: str, order: str) -> DataFrame:
    """Diagnosis per run from its lines.

    Each line is matched where it lies; a run takes the signature of the highest precedence
    over its lines, so no task ever joins the lines of a run together.
    """
    rank = F.lit(len(SIGNATURES))
    for i, (_, pattern) in reversed(list(enumerate(SIGNATURES))):
        rank = F.when(F.col(line).rlike(f"(?i){pattern}"), i).otherwise(rank)
    names = F.array(*[F.lit(n) for n, _ in SIGNATURES], F.lit("unknown"))
    seen = df.select(group, rank.alias("__r"), order)
    return seen.groupBy(group).agg(
        names[F.min("__r")].alias("diagnosis"), F.count(F.lit(1)).alias("lines")
    )


def error_kinds(c: Column) -> Column:
    """Kinds of trouble named in an error text, in fixed order."""
    low = F.lower(c)

    def has(word: str) -> Column:
        return low.contains(word)

    kinds = [
        F.when(has("error"), "runtime_error"),
        F.when(has("import") & has("error"), "import_error"),
        F.when(has("memory"), "memory_error"),
        F.when(has("timeout"), "timeout"),
    ]
    return F.concat_ws(",", *kinds)


def task_type(c: Column) -> Column:
    """``cv``, ``nlp`` or ``tabular`` by keywords of a description."""
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit("tabular")
    for name, words in reversed(TASK_WORDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def extract_score(c: Column) -> Column:
    """First number after ``CV score``, else after ``score``; null when absent."""
    first = F.regexp_extract(c, r"(?i)CV score[:\s]+([\d.]+)", 1)
    other = F.regexp_extract(c, r"(?i)score[:\s]+([\d.]+)", 1)
    found = F.when(first != "", first).otherwise(other)
    return F.when(found != "", found.try_cast("double"))


def status_counts(df: DataFrame, processed: str, adopted: str, by: Sequence[str] = ()) -> DataFrame:
    """Pending, processed, adopted and rejected counts; adoption rate 0 when none is processed."""
    done = F.col(processed)
    counts = df.groupBy(*by).agg(
        F.count_if(~done).alias("pending"),
        F.count_if(done).alias("processed"),
        F.count_if(done & F.col(adopted)).alias("adopted"),
        F.count_if(done & ~F.col(adopted)).alias("rejected"),
    )
    rate = F.coalesce(F.try_divide(F.col("adopted"), F.col("processed")), F.lit(0.0))
    return counts.withColumn("adoption_rate", rate)
