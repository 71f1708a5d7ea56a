"""Metrics and ensemble diagnostics over the derived predictions."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from sparktab.functions.proba import argmax
from sparktab.operators import metrics as M
from suite.common import MODELS, PREDS, argmax_sql, preds, query, r, rounded

_ARG = argmax_sql(["p0", "p1", "p2"])
_LAB = f"{PREDS}, lab AS (SELECT model, fold, id, y, {_ARG} AS pred FROM preds)"


def _counts(by: str, src: str = "lab") -> str:
    cols = ", ".join(
        f"CAST(sum(CASE WHEN y = {c} THEN 1 ELSE 0 END) AS BIGINT) AS n{c}, CAST(sum(CASE WHEN y = {c} AND pred = {c} THEN 1 ELSE 0 END) AS BIGINT) AS h{c}, "
        f"CAST(sum(CASE WHEN pred = {c} THEN 1 ELSE 0 END) AS BIGINT) AS s{c}" for c in range(3))
    return f"SELECT {by + ', ' if by else ''}{cols}, count(*) AS n FROM {src} {'GROUP BY ' + by if by else ''}"


def _rec(c: int) -> str:
    return f"CASE WHEN n{c} > 0 THEN h{c} / n{c} ELSE 0e0 END"


_REC = " + ".join(_rec(c) for c in range(3))
_PRESENT = " + ".join(f"CAST(n{c} > 0 AS INTEGER)" for c in range(3))
_SEEN = " + ".join(f"CAST(n{c} + s{c} > 0 AS INTEGER)" for c in range(3))
_F1 = " + ".join(f"CASE WHEN n{c} + s{c} > 0 THEN 2 * h{c} / (n{c} + s{c}) ELSE 0e0 END" for c in range(3))
_BA = f"({_REC}) / ({_PRESENT})"


def labelled(spark, sf):
    return preds(spark, sf).withColumn("pred", argmax("p", 3))


@query("m1_confusion", f"WITH {_LAB} SELECT model, y, pred, count(*) AS n FROM lab GROUP BY ALL")
def m1(spark, sf):
    return M.confusion(labelled(spark, sf), "y", "pred", ["model"])


@query(
    "m2_per_class_recall",
    f"WITH {_LAB}, part AS (SELECT * FROM lab WHERE y <> 2), c AS ({_counts('model', 'part')}) SELECT model, "
    + ", ".join(r(_rec(c), f"recall_{c}") for c in range(3)) + " FROM c",
)
def m2(spark, sf):
    """Class 2 is taken out of the truth: its recall is 0."""
    part = labelled(spark, sf).where("y <> 2")
    out = M.score_labels(part, "y", "pred", 3, ["model"])
    return rounded(out.select("model", "recall_0", "recall_1", "recall_2"))


@query(
    "m3_balanced_accuracy",
    f"WITH {_LAB}, part AS (SELECT * FROM lab WHERE y <> 2), c AS ({_counts('model', 'part')}) "
    f"SELECT model, {r(_BA, 'skip')}, {r(f'({_REC}) / 3', 'zero')} FROM c",
)
def m3(spark, sf):
    part = labelled(spark, sf).where("y <> 2")
    counts = M.class_counts(part, "y", "pred", 3, ["model"])
    return rounded(counts.select(
        "model", M.balanced_accuracy(3).alias("skip"), M.balanced_accuracy(3, "zero").alias("zero")))


@query(
    "m4_macro_f1_recall",
    f"WITH {_LAB}, part AS (SELECT * FROM lab WHERE y <> 2), c AS ({_counts('model', 'part')}) "
    f"SELECT model, {r(f'({_F1}) / ({_SEEN})', 'macro_f1')}, {r(f'({_REC}) / ({_SEEN})', 'macro_recall')} FROM c",
)
def m4(spark, sf):
    part = labelled(spark, sf).where("y <> 2")
    return rounded(M.score_labels(part, "y", "pred", 3, ["model"]).select("model", "macro_f1", "macro_recall"))


@query(
    "m5_log_loss",
    f"WITH {PREDS} SELECT model, {r('avg(-ln(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END))', 'log_loss')} FROM preds GROUP BY model",
)
def m5(spark, sf):
    return rounded(preds(spark, sf).groupBy("model").agg(M.log_loss("y", "p", 3).alias("log_loss")))


@query(
    "m6_auc",
    f"""WITH {PREDS}, s AS (SELECT model, CAST(y = 1 AS INTEGER) AS t, floor(p1 * 1000) / 1000 AS s FROM preds),
    g AS (SELECT model, s, sum(t) AS pos, sum(1 - t) AS neg FROM s GROUP BY ALL),
    k AS (SELECT *, sum(neg) OVER (PARTITION BY model ORDER BY s) - neg / 2 AS b FROM g)
    SELECT model, {r('sum(pos * b) / (CAST(sum(pos) AS DOUBLE) * sum(neg))', 'auc')},
      CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives FROM k GROUP BY model""",
)
def m6(spark, sf):
    s = preds(spark, sf).select(
        "model", (F.col("y") == 1).cast("int").alias("t"),
        (F.floor(F.col("p")[1] * 1000) / 1000).alias("s"),
    )
    return rounded(M.auc(s, "t", "s", ["model"], rows_per_bucket=5000))


@query(
    "m7_evaluate",
    f"""WITH {PREDS}, lab AS (SELECT model, fold, id, y, p0, p1, p2,
      {argmax_sql(['round(ln(p0) + 1e-1, 9)', 'round(ln(p1), 9)', 'round(ln(p2) - 5e-2, 9)'])} AS pred FROM preds),
    c AS ({_counts('model')}),
    l AS (SELECT model, avg(-ln(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)) AS ll FROM lab GROUP BY model)
    SELECT model, {r(_BA, 'balanced_accuracy')}, {r(f'({_F1}) / ({_SEEN})', 'macro_f1')},
      {r(f'({_REC}) / ({_SEEN})', 'macro_recall')}, {r('(h0 + h1 + h2) / n', 'accuracy')}, {r('ll', 'log_loss')},
      {', '.join(r(_rec(c), f'recall_{c}') for c in range(3))}, n AS "rows" FROM c JOIN l USING (model)""",
)
def m7(spark, sf):
    return rounded(M.evaluate(preds(spark, sf), "y", "p", 3, ["model"], [0.1, 0.0, -0.05]))


@query(
    "m8_fold_report",
    f"""WITH {_LAB}, c AS ({_counts('model, fold')}), f AS (SELECT *, {_BA} AS ba FROM c),
    o AS ({_counts('model')}), oo AS (SELECT model, {_BA} AS ba FROM o)
    SELECT f.model, count(*) AS folds, {r('avg(f.ba)', 'mean_score')}, {r('stddev_pop(f.ba)', 'std_score')},
      min(n) AS min_rows, max(n) AS max_rows, {r('any_value(oo.ba)', 'oof_score')}
    FROM f JOIN oo USING (model) GROUP BY f.model""",
)
def m8(spark, sf):
    return rounded(M.fold_report(preds(spark, sf), "y", "p", 3, ["model"]))


def wide_labels(spark, sf, models=tuple(MODELS)):
    return labelled(spark, sf).groupBy("id").agg(
        F.first("y").alias("y"),
        *[F.max(F.when(F.col("model") == m, F.col("pred"))).alias(m) for m in models],
    )


_WIDE = f"{_LAB}, wide AS (SELECT id, y, {', '.join(f'max(CASE WHEN model = {chr(39)}{m}{chr(39)} THEN pred END) AS {m}' for m in MODELS)} FROM lab GROUP BY id, y)"


def _pairs(models) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS model_a, '{b}' AS model_b, {r(f'avg(CAST({a} = {b} AS INTEGER))', 'agreement')},
        {r(f'coalesce(sum(CAST({a} <> y AND {b} <> y AS INTEGER)) / nullif(sum(CAST({a} <> y OR {b} <> y AS INTEGER)), 0), 0e0)', 'error_jaccard')}
        FROM wide""" for a, b in combinations(models, 2))


@query("m9_pairwise_agreement", f"WITH {_WIDE} {_pairs(MODELS)}")
def m9(spark, sf):
    return rounded(M.pairwise_agreement(wide_labels(spark, sf), list(MODELS)))


@query(
    "m10_oracle_coverage",
    f"""WITH {_WIDE}, h AS (SELECT y, CAST(m1 = y OR m2 = y OR m3 = y OR m4 = y AS INTEGER) AS ok FROM wide),
    c AS (SELECT y, avg(ok) AS r FROM h GROUP BY y)
    SELECT {r('(SELECT avg(ok) FROM h)', 'any_right')}, {r('avg(r)', 'any_right_recall')} FROM c""",
)
def m10(spark, sf):
    return rounded(M.oracle_coverage(wide_labels(spark, sf), list(MODELS), 3))


@query(
    "m11_compare_sets",
    f"""WITH {_WIDE}, a AS ({_pairs(['m1', 'm2', 'm3'])}), b AS ({_pairs(['m2', 'm3', 'm4'])}),
    h AS (SELECT y, CAST(m1 = y OR m2 = y OR m3 = y AS INTEGER) AS p, CAST(m2 = y OR m3 = y OR m4 = y AS INTEGER) AS q FROM wide),
    c AS (SELECT y, avg(p) AS p, avg(q) AS q FROM h GROUP BY y)
    SELECT {r('(SELECT avg(q) - avg(p) FROM h)', 'any_right_delta', 4)}, {r('(SELECT avg(q) - avg(p) FROM c)', 'any_right_recall_delta', 4)},
      {r('(SELECT avg(agreement) FROM b) - (SELECT avg(agreement) FROM a)', 'agreement_delta', 4)},
      {r('(SELECT avg(error_jaccard) FROM b) - (SELECT avg(error_jaccard) FROM a)', 'jaccard_delta', 4)}""",
)
def m11(spark, sf):
    wide = wide_labels(spark, sf)
    a = M.pairwise_agreement(wide, ["m1", "m2", "m3"])
    b = M.pairwise_agreement(wide, ["m2", "m3", "m4"])
    cover = [M.oracle_coverage(wide, m, 3) for m in (["m1", "m2", "m3"], ["m2", "m3", "m4"])]
    return rounded(M.compare_sets(a, b, *cover), 4)


_FOLD = f"{_LAB}, c AS ({_counts('model, fold')}), s AS (SELECT model, fold, {_BA} AS score FROM c)"


def fold_scores(spark, sf):
    out = M.score_labels(labelled(spark, sf), "y", "pred", 3, ["model", "fold"])
    return out.select("model", "fold", F.col("balanced_accuracy").alias("score"))


@query(
    "m12_paired_delta",
    f"""WITH {_FOLD} SELECT s.model, {r('avg(s.score - b.score)', 'mean_delta')},
      {r('stddev_pop(s.score - b.score)', 'std_delta')}, CAST(sum(CAST(s.score > b.score AS INTEGER)) AS BIGINT) AS wins
    FROM s JOIN s b ON s.fold = b.fold AND b.model = 'm4' WHERE s.model <> 'm4' GROUP BY s.model""",
)
def m12(spark, sf):
    s = fold_scores(spark, sf)
    base = s.where("model = 'm4'").drop("model")
    return rounded(M.paired_delta(s.where("model <> 'm4'"), base, ["model"]))


@query(
    "m12_optimism_gap",
    f"""WITH {_FOLD} SELECT s.fold, {r('s.score', 'naive')}, {r('b.score', 'nested')}, {r('s.score - b.score', 'gap')}
    FROM s JOIN s b ON s.fold = b.fold WHERE s.model = 'm2' AND b.model = 'm1'""",
)
def m12_gap(spark, sf):
    s = fold_scores(spark, sf)
    return rounded(M.optimism_gap(s.where("model = 'm2'"), s.where("model = 'm1'"), ["fold"]))


@query(
    "m13_answer_diff",
    f"""WITH {_LAB} SELECT a.pred AS label_a, b.pred AS label_b, count(*) AS n FROM lab a JOIN lab b ON a.id = b.id
    WHERE a.model = 'm1' AND b.model = 'm2' AND a.pred <> b.pred GROUP BY ALL""",
)
def m13(spark, sf):
    lab = labelled(spark, sf)
    return M.answer_diff(lab.where("model = 'm1'"), lab.where("model = 'm2'"), "id", "pred")


@query(
    "m14_regression_scores",
    f"""WITH {PREDS} SELECT model, {r('sqrt(avg(pow(10 * p1 - y, 2)))', 'rmse')}, {r('avg(abs(10 * p1 - y))', 'mae')},
      {r('sqrt(avg(pow(ln(1 + greatest(10 * p1, 0e0)) - ln(1 + greatest(CAST(y AS DOUBLE), 0e0)), 2)))', 'rmsle')} FROM preds GROUP BY model""",
)
def m14(spark, sf):
    p = preds(spark, sf).withColumns({"guess": F.col("p")[1] * 10, "t": F.col("y").cast("double")})
    return rounded(M.regression_scores(p, "t", "guess", ["model"]))
