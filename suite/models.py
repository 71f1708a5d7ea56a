"""Model protocols on the derived survey and the embeddings. Fits are kept short."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sparktab.operators.folds import stratified_folds
from sparktab.operators.metrics import evaluate, score_labels
from sparktab.plans import learners as T
from sparktab.plans import protocols as Q
from sparktab.plans.neighbors import knn_classify
from sparktab.plans.recipes import FeatureRecipe
from sparktab.session import materialize, scratch_path, spread
from sparktab.sources.predictions import read_preds
from sparktab.sources.records import flatten_experiments, read_experiments
from suite.common import BANDS, PHOTO, PREDS, photo, preds, query, r, rounded, table
from suite.search import NAMES

COLS = [*BANDS, "redshift"]


def frame(spark, sf, cols=tuple(COLS), folds=3):
    """All rows of the survey with a label that follows the features; without ``folds`` no fold numbers."""
    ph = photo(spark, sf).where("source <> 'test'")
    y = F.when(F.col("redshift") + (F.col("u") - F.col("r")) / 4 > 2.0, 1).when(
        F.col("g") - F.col("i") > 2.0, 2).otherwise(0)
    noisy = F.when(F.col("id") % 11 == 0, F.col("y")).otherwise(y)
    rows = ph.withColumn("y", noisy).select("id", "y", *cols)
    if folds is None:
        return spread(materialize(T.with_features(rows, list(cols), ["id", "y"]), "frame"))
    rows = stratified_folds(rows, "id", "y", folds, 42)
    return spread(materialize(T.with_features(rows, list(cols), ["id", "y", "fold"]), "frame"))


def _report(df, by=()):
    return rounded(evaluate(df, "y", "p", 3, list(by)).drop("macro_recall"))


def _oof(spark, sf, learner, name):
    return _report(Q.oof_predict(frame(spark, sf), learner, 3, name), ["fold"])


@query("t1_logistic")
def t1(spark, sf):
    return _oof(spark, sf, T.Logistic(3, c=1.0, scale=True, iters=25), "logistic")


@query("t2_boosted_multiclass")
def t2(spark, sf):
    rows = frame(spark, sf, folds=2)
    learner = T.boosted(3, "medium", rounds=3, depth=3)
    return _report(Q.oof_predict(rows, learner, 3, "boosted"), ["fold"])


@query("t3_random_forest")
def t3(spark, sf):
    return _oof(spark, sf, T.Forest(3, trees=10, depth=5), "forest")


@query("t3_extra_random_trees")
def t3_extra(spark, sf):
    return _oof(spark, sf, T.Forest(3, trees=10, depth=5, extra=True), "extra")


@query("t4_mlp")
def t4(spark, sf):
    return _oof(spark, sf, T.Perceptron(3, hidden=(8,), iters=20, per_class=800), "mlp")


_KNN = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    n AS (SELECT q.vec_id, r.label, list_distance(q.v, r.v) AS d FROM e q, e r WHERE q.vec_id % 4 = 0 AND r.vec_id % 4 <> 0
      QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, r.v), r.vec_id) <= 15),
    w AS (SELECT vec_id, label, CASE WHEN min(d) OVER (PARTITION BY vec_id) = 0 THEN CAST(d = 0 AS INTEGER) ELSE 1 / d END AS w FROM n)"""


@query(
    "t5_knn_classify",
    f"WITH {_KNN} SELECT vec_id, {', '.join(r(f'coalesce(sum(CASE WHEN label = {c} THEN w END), 0e0) / sum(w)', f'p{c}') for c in range(10))} FROM w GROUP BY vec_id",
)
def t5(spark, sf):
    """A quarter of the vectors ask the rest; small blocks, so that cells are split."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("y"), "embedding")
    out = knn_classify(e.where("vec_id % 4 <> 0"), e.where("vec_id % 4 = 0"), "vec_id", "embedding", 10, 15, block_rows=100)
    return rounded(out.select("vec_id", *[F.col("p")[c].alias(f"p{c}") for c in range(10)]))


@query("t6_one_vs_rest")
def t6(spark, sf):
    learner = T.OneVsRest(3, T.Binary(rounds=3, depth=3), weights="ratio")
    return _report(Q.oof_predict(frame(spark, sf, folds=2), learner, 3, "ovr"), ["fold"])


@query("t7_cascade")
def t7(spark, sf):
    learner = T.Cascade(binary=T.Binary(rounds=3, depth=3), probe_rounds=2)
    return _report(Q.oof_predict(frame(spark, sf, folds=2), learner, 3, "cascade"), ["fold"])


@query("t8_specialist")
def t8(spark, sf):
    learner = T.specialist(3, {0: 2.0, 1: 0.25, 2: 2.0}, rounds=3, depth=3)
    return _report(Q.oof_predict(frame(spark, sf, folds=2), learner, 3, "specialist"), ["fold"])


_LABEL = """CASE WHEN id % 11 = 0 THEN y WHEN redshift + (u - r) / 4 > 2 THEN 1 WHEN g - i > 2 THEN 2 ELSE 0 END"""


@query(
    "t9_oof_predict",
    f"""WITH {PHOTO}, l AS (SELECT id, {_LABEL} AS y FROM photo WHERE source <> 'test'),
    f AS (SELECT CAST((row_number() OVER (PARTITION BY y ORDER BY md5('42:' || id), id) - 1) % 3 AS INTEGER) AS fold FROM l)
    SELECT 'logistic' AS model, 'oof' AS split, fold, count(*) AS n, count(*) AS ids, 1e0 AS mean_sum FROM f GROUP BY fold
    UNION ALL SELECT 'logistic', 'test', -1, count(*), count(*), 1e0 FROM photo WHERE source = 'test'""",
)
def t9(spark, sf):
    """Every labelled row once, every test row once (mean over fold models)."""
    ph = photo(spark, sf).where("source = 'test'").withColumn("y", F.lit(None).cast("int"))
    test = T.with_features(ph, COLS, ["id", "y"])
    out = Q.oof_predict(frame(spark, sf), T.Logistic(3, iters=15), 3, "logistic", test)
    sums = F.col("p")[0] + F.col("p")[1] + F.col("p")[2]
    fold = F.coalesce("fold", F.lit(-1)).alias("fold")
    return rounded(out.groupBy("model", "split", fold).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.avg(sums).alias("mean_sum")))


@query("t10_refit_rounds")
def t10(spark, sf):
    """Rounds kept by early stopping decide the length of the refit."""
    rows = frame(spark, sf, folds=2)
    binary = T.Binary(rounds=4, depth=2, step=0.3)
    kept = T.OneVsRest(3, binary).fit(rows.where("fold <> 0")).rounds
    rounds = T.refit_rounds(kept, cap=5, default=4)
    final = T.OneVsRest(3, T.Binary(rounds=rounds, depth=2, step=0.3, stop_share=0.0)).fit(rows)
    return _report(final.proba(rows)).withColumn("rounds", F.lit(rounds))


def _logistic(seed):
    return T.Logistic(3, c=3.0, scale=True, iters=15, seed=seed)


_QUICK = {"generations": 1, "population": 10}


@query("t11_stack")
def t11(spark, sf):
    p = preds(spark, sf)
    oof, bias, tested = Q.stack(
        p, NAMES, _logistic, 3, "logit", (42, 43), 3, test=p.where("id % 5 = 0").drop("y", "fold"), **_QUICK)
    both = evaluate(oof, "y", "p", 3, bias=bias).withColumn("part", F.lit("oof")).select("part", "balanced_accuracy", "rows")
    rows = tested.agg(F.lit("test").alias("part"), F.lit(None).cast("double").alias("balanced_accuracy"), F.count(F.lit(1)).alias("rows"))
    return rounded(both.unionByName(rows))


def meta(spark, sf):
    rows = Q.meta_frame(preds(spark, sf), NAMES, 3, "logit").withColumn("fold", F.col("fold") % 2)
    # A network weighs its blocks of rows alike, also short ones, so the order of the rows counts.
    return materialize(rows.sortWithinPartitions("fold", "id"), "meta", ["fold"])


_PIVOT = ", ".join(
    f"max(CASE WHEN model = '{m}' THEN p{c} END) AS {m}_{c}" for m in NAMES for c in range(3))


def _clipped(x: str, lo: str, hi: str) -> str:
    return f"least(greatest({x}, {lo}), {hi})"


def _as_logit(x: str) -> str:
    c = _clipped(x, "1e-7", "1e0 - 1e-7")
    return _clipped(f"ln({c} / (1 - {c}))", "-30e0", "30e0")


@query(
    "t11_meta_frame",
    f"""WITH {PREDS}, w AS (SELECT id, y, fold, {_PIVOT} FROM preds GROUP BY id, y, fold)
    SELECT id, y, fold, {', '.join(r(_as_logit(f'{m}_{c}'), f'logit_{m}_{c}') for m in NAMES for c in range(3))},
      {', '.join(r(f'ln({m}_{c})', f'log_{m}_{c}') for m in NAMES[:2] for c in range(3))} FROM w""",
)
def t11_frame(spark, sf):
    """The meta features of every row: logits of all models, log probabilities of two."""
    p = preds(spark, sf)
    logits = Q.meta_frame(p, NAMES, 3, "logit").withColumn("a", vector_to_array("features"))
    logs = Q.meta_frame(p, NAMES[:2], 3, "log").withColumn("b", vector_to_array("features"))
    both = logits.join(logs.select("id", "b"), "id")
    return rounded(both.select(
        "id", "y", "fold",
        *[F.col("a")[3 * i + c].alias(f"logit_{m}_{c}") for i, m in enumerate(NAMES) for c in range(3)],
        *[F.col("b")[3 * i + c].alias(f"log_{m}_{c}") for i, m in enumerate(NAMES[:2]) for c in range(3)]))


@query("t12_nested_cv")
def t12(spark, sf):
    labels = Q.nested_cv(meta(spark, sf), _logistic, 3, "bias", inner=2, **_QUICK)
    return rounded(score_labels(labels, "y", "pred", 3, ["fold"]))


@query("t13_multi_level")
def t13(spark, sf):
    p = materialize(preds(spark, sf).withColumn("fold", F.col("fold") % 2), "preds")
    metas = {
        "lin": ("logit", lambda s: T.Logistic(3, c=3.0, scale=True, iters=10, seed=s)),
        "hc": ("climb", {"bags": 2, "iters": 2}),
    }
    out = Q.multi_level(p, NAMES, metas, 3, level2=("mean", 1.0), rules=("bias",), inner=2, **_QUICK)
    return rounded(spark.createDataFrame(out))


@query("t14_pseudo_label_train")
def t14(spark, sf):
    ph = photo(spark, sf)
    test = T.with_features(ph.where("source = 'test'"), COLS, ["id"])
    rows = frame(spark, sf, folds=2)
    out = Q.pseudo_label_train(rows, test, T.Logistic(3, scale=True, iters=10), 3, 0.9, 2000)
    return _report(out, ["fold", "optimistic"])


@query("t15_tune_meta")
def t15(spark, sf):
    out = Q.tune_meta(meta(spark, sf), 3, Q.META_GRID, iters=10, **_QUICK)
    return rounded(spark.createDataFrame(out))


@query("t16_preset_for_size")
def t16(spark, sf):
    rows = frame(spark, sf, folds=2)
    chosen = T.preset("small")
    fitted = T.boosted(3, "small", rounds=2, depth=2).fit(rows)
    return _report(fitted.proba(rows)).withColumn("step", F.lit(chosen["step"]))


@query("t17_ablation")
def t17(spark, sf):
    base = photo(spark, sf).where("source <> 'test'")
    out = {}
    for name, coords in (("no_coords", False), ("with_coords", True)):
        recipe = FeatureRecipe("color", coords).fit(base)
        made = recipe.transform(base.drop("source", "spectral_type", "galaxy_population", "class"))
        cols = [c for c in made.columns if c not in ("id", "y")]
        folded = stratified_folds(made, "id", "y", 2, 42)
        out[name] = materialize(T.with_features(folded, cols, ["id", "y", "fold"]), "variant")
    found = Q.ablation(out, lambda: T.Logistic(3, scale=True, iters=10), 3)
    return rounded(spark.createDataFrame(found))


@query(
    "t18_pipeline",
    f"""WITH {PHOTO} SELECT name, 'preds' AS kind, count(*) AS n FROM photo, (VALUES ('lr'), ('rf')) AS m(name) WHERE source <> 'test' GROUP BY name
    UNION ALL SELECT 'seed' || s, 'log', 1 FROM (VALUES (42), (43)) AS v(s)""",
)
def t18(spark, sf):
    path, log = scratch_path(spark, "pipeline"), scratch_path(spark, "pipeline-log")
    learners = {
        "lr": lambda s: T.Logistic(3, scale=True, iters=10, seed=s),
        "rf": lambda s: T.Forest(3, trees=5, depth=4, seed=s),
    }
    Q.pipeline(frame(spark, sf, folds=None), learners, 3, path, (42, 43), 2, 4, log)
    kept = read_preds(spark, path, "seed43").groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    logged = flatten_experiments(read_experiments(spark, log)).select("experiment", "models")
    return kept.withColumn("kind", F.lit("preds")).withColumnRenamed("model", "name").unionByName(
        logged.groupBy(F.col("experiment").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("log")))


@query("h9_select_subset")
def h9(spark, sf):
    subsets = {"strong": ["m1", "m2"], "all": NAMES, "weak": ["m3", "m4"]}
    out = Q.select_subset(preds(spark, sf), subsets, 3, _logistic, folds=2, **_QUICK)
    return rounded(spark.createDataFrame(out))


@query("h11_random_search")
def h11(spark, sf):
    space = {"c": ("log", 0.1, 10.0), "iters": ("int", 5, 12)}
    out = Q.random_search(frame(spark, sf, folds=None), 3, lambda s: T.Logistic(3, scale=True, **s), space, 3, 2, 5000)
    return rounded(spark.createDataFrame(out[["trial", "score"]]))
