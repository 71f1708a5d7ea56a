"""Guarantees that no SQL twin shows: leakage, balance, ties, edges, hot keys."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparktab.functions import codes, proba
from sparktab.functions.exprs import edges_below
from sparktab.operators import binning, categories, encoders, folds, joins, metrics, ranks, search
from sparktab.plans import learners, protocols
from sparktab.plans.neighbors import nearest
from sparktab.plans.recipes import FeatureRecipe
from sparktab.sources import predictions, records, tables
from sparktab.streaming import streams

INF, NAN = float("inf"), float("nan")


def skewed(spark, n=6000):
    """One value and one class hold most of the rows."""
    return spark.range(n).select(
        "id",
        F.when(F.col("id") % 20 < 19, 0).otherwise((F.col("id") % 3 + 1).cast("int")).alias("y"),
        F.when(F.col("id") % 3 == 0, 5.0).otherwise((F.col("id") * 7919 % 1009) / 100.0).alias("x"),
    )


# --- ranks and quantiles ------------------------------------------------------------------


@pytest.mark.parametrize("rows_per_bucket", [10, 300, 10**6])
@pytest.mark.parametrize("descending", [False, True])
def test_value_rank_equals_window(spark, rows_per_bucket, descending):
    df = skewed(spark)
    got = ranks.value_rank(df, ["y"], "x", "id", descending=descending, rows_per_bucket=rows_per_bucket)
    pdf = got.toPandas()
    import hashlib

    pdf["h"] = [hashlib.md5(f"0:{i}".encode()).hexdigest() for i in pdf["id"]]
    pdf = pdf.sort_values(["y", "x", "h"], ascending=[True, not descending, True])
    assert (pdf.groupby("y").cumcount() + 1 == pdf["rank"]).all()


@pytest.mark.parametrize("rows_per_bucket", [50, 10**6])
@pytest.mark.parametrize("exact_rows", [0, 10**6])
def test_exact_quantiles(spark, rows_per_bucket, exact_rows):
    df = skewed(spark).withColumn("x", F.when(F.col("id") % 50 == 1, F.lit(NAN)).otherwise(F.col("x")))
    probs = [0.0, 0.001, 0.25, 1 / 3, 0.5, 0.9, 1.0]
    got = ranks.exact_quantiles(df, ["x"], probs, exact_rows, rows_per_bucket)["x"]
    x = df.toPandas()["x"].dropna()
    assert np.allclose(got, np.quantile(x, probs), rtol=0, atol=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (NAN,)], "x double")
    assert ranks.exact_quantiles(df, ["x"], [0.5]) == {"x": []}


@pytest.mark.parametrize("n", [1, 3, 64, 65, 300])
@pytest.mark.parametrize("closed", ["left", "right"])
def test_edges_below(spark, n, closed):
    edges = [i * 1.5 for i in range(n)]
    values = [-1.0, 0.0, 0.7, 1.5, 3.0, 95.0, 96.0, 1e9, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(edges_below(F.col("x"), edges, closed)).collect()]
    side = "right" if closed == "left" else "left"
    want = [None if v is None else int(np.searchsorted(edges, v, side=side)) for v in values]
    assert got == want


# --- folds --------------------------------------------------------------------------------


def test_fold_sizes_and_partitioning(spark):
    df = skewed(spark)
    a = folds.stratified_folds(df, "id", "y", 5, 42)
    b = folds.stratified_folds(df.repartition(13).orderBy(F.rand(1)), "id", "y", 5, 42)
    sizes = a.groupBy("y", "fold").count().toPandas()
    assert (sizes.groupby("y")["count"].agg(lambda c: c.max() - c.min()) <= 1).all()
    assert a.exceptAll(b.select(a.columns)).count() == 0 and a.count() == df.count()
    other = folds.stratified_folds(df, "id", "y", 5, 43)
    assert a.exceptAll(other.select(a.columns)).count() > 0


def test_samples(spark):
    df = skewed(spark)
    some = folds.stratified_sample(df, "id", "y", 100, 1).groupBy("y").count().toPandas()
    assert some["count"].min() >= 1 and abs(some["count"].sum() - 100) <= 3
    assert folds.stratified_sample(df, "id", "y", 10**6, 1).count() == df.count()
    even = folds.balanced_sample(df, "id", "y", 50, 1).groupBy("y").count().toPandas()
    assert (even["count"] == 50).all()


def test_swap_noise_keeps_multiset_of_donors(spark):
    df = skewed(spark, 1000)
    out = folds.swap_noise(df, "id", ["x"], 0.3, 5)
    assert out.count() == 1000
    values = {r[0] for r in df.select("x").distinct().collect()}
    assert {r[0] for r in out.select("x").distinct().collect()} <= values
    same = df.join(out.withColumnRenamed("x", "x2"), "id").where("x = x2").count()
    assert 650 < same < 1000


# --- encoders -----------------------------------------------------------------------------


def example(spark):
    rows = [(0, "p", 1), (1, "q", 1), (2, "q", 0), (3, "p", 1), (4, "r", 0), (5, "q", 0), (6, "p", 0), (7, "p", 1), (8, "q", 0), (9, "p", 0)]
    return spark.createDataFrame(rows, "id int, c string, y int")


def test_target_encoding_example(spark):
    fit = example(spark)
    apply = spark.createDataFrame([("p",), ("q",), ("r",), ("new",), (None,)], "c string")
    got = {r["c"]: r["c_te"] for r in encoders.target_encode(fit, apply, ["c"], "y", 1.0).collect()}
    # The mean is 4 / 10; p has 3 of 5, q 1 of 4, r 0 of 1.
    assert abs(got["p"] - 3.4 / 6) < 1e-12 and abs(got["q"] - 1.4 / 5) < 1e-12 and abs(got["r"] - 0.2) < 1e-12
    assert got["new"] == 0.4 and got[None] == 0.4


def test_leave_one_out_example(spark):
    got = {r["id"]: r["c_loo"] for r in encoders.leave_one_out_encode(example(spark), "c", "y", 1.0).collect()}
    assert abs(got[0] - 2.4 / 5) < 1e-12 and abs(got[2] - 1.4 / 4) < 1e-12


def test_leave_one_out_single_row_group(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 0), (3, "b", 1)], "id int, c string, y int")
    got = {r["id"]: r["c_loo"] for r in encoders.leave_one_out_encode(df, "c", "y", 0.0).collect()}
    assert abs(got[1] - 2 / 3) < 1e-12


def test_fold_safe_ignores_own_fold(spark):
    df = spark.range(400).select(
        "id", (F.col("id") % 7).alias("c"), (F.col("id") * 31 % 3).cast("int").alias("y"),
        (F.col("id") % 5).cast("int").alias("inner"),
    )
    # Without smoothing the class shares play no part: only labels of fold 0 change.
    swap = F.when(F.col("id") == 0, 1).when(F.col("id") == 35, 0).otherwise(F.col("y"))
    a, _ = encoders.fold_safe_encode(df, ["c"], "y", 3)
    b, _ = encoders.fold_safe_encode(df.withColumn("y", swap), ["c"], "y", 3, smooth=0.0)
    c, _ = encoders.fold_safe_encode(df, ["c"], "y", 3, smooth=0.0)
    names = ["id", "TE_c_0", "TE_c_1", "TE_c_2"]
    own = "inner = 0"
    assert b.where(own).select(names).exceptAll(c.where(own).select(names)).count() == 0
    assert b.select(names).exceptAll(c.select(names)).count() > 0
    assert a.count() == 400


def test_null_category_gets_prior(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else "a", i % 2, i % 3) for i in range(24)],
                               "id int, c string, y int, inner int")
    out, applied = encoders.fold_safe_encode(df, ["c"], "y", 2, apply=df.drop("inner"))
    assert {r[0] for r in out.where("c IS NULL").select("TE_c_1").collect()} == {0.5}
    assert {r[0] for r in applied.where("c IS NULL").select("TE_c_1").collect()} == {0.5}


def test_salted_lookup_is_the_same(spark):
    df = skewed(spark)
    stats = df.where("y < 3").groupBy("y").agg(F.avg("x").alias("m"))
    a = joins.lookup(df, stats, "y", {"m": -1.0})
    b = joins.lookup(df, stats, "y", {"m": -1.0}, salts=5)
    assert a.exceptAll(b.select(a.columns)).count() == 0 and b.count() == df.count()


# --- binning and codes --------------------------------------------------------------------


def test_binner_edges(spark):
    xs = [0.0, 0.0, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0, None, NAN, INF, -INF]
    df = spark.createDataFrame(list(enumerate(xs)), "id int, x double")
    left = binning.QuantileBinner(["x"], 4, "left", missing=-1).fit(df).transform(df)
    finite = np.array([x for x in xs[:8]])
    edges = np.unique(np.quantile(finite, np.linspace(0, 1, 5)))[1:-1]
    want = [int(np.searchsorted(edges, x, side="right")) for x in finite] + [-1] * 4
    assert [r["x_q4"] for r in left.orderBy("id").collect()] == want
    cut = binning.QuantileBinner(["x"], 4, "right", missing=None).fit(df).transform(df)
    codes_ = pd.qcut(pd.Series(finite), 4, labels=False, duplicates="drop").tolist()
    assert [r["x_q4"] for r in cut.orderBy("id").collect()] == codes_ + [None] * 4


def test_outside_code(spark):
    fit = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    df = spark.createDataFrame([(-1.0,), (0.0,), (10.0,), (11.0,)], "x double")
    b = binning.QuantileBinner(["x"], 5, "right", missing=-1, outside=-1).fit(fit)
    assert [r[1] for r in b.transform(df).orderBy("x").collect()] == [-1, 0, 4, -1]


def test_equal_width_matches_cut(spark):
    xs = [0.0, 0.5, 1.0, 1.5, 2.0, 9.99, 10.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r["x_bin"] for r in binning.EqualWidthBinner(["x"], 20).fit(df).transform(df).orderBy("x").collect()]
    assert got == pd.cut(pd.Series(xs), bins=20, labels=False).tolist()


def test_half_even(spark):
    df = spark.createDataFrame([(x,) for x in (0.5, -0.5, 1.5, -1.5, 2.5, -2.5)], "x double")
    got = [r[0] for r in df.select(codes.round_code(F.col("x"), 0)).collect()]
    assert got == [0, 0, 2, -2, 2, -2]


def test_hash_cross_matches_formula(spark):
    pairs = [(-1, -1, -1), (0, 5, 7), (2147483647, -2147483648, 2147483647)]
    df = spark.createDataFrame(pairs, "a int, b int, c int")
    got = df.select(
        codes.hash_cross2(F.col("a"), F.col("b")), codes.hash_cross3(F.col("a"), F.col("b"), F.col("c"))
    ).collect()
    for (a, b, c), r in zip(pairs, got):
        two = (a + 1_000_003) * 1_000_003 + (b + 9_176)
        assert r[0] == two % 2_147_483_647
        assert r[1] == (two * 1_000_003 + (c + 17_191)) % 2_147_483_647


def test_unknown_recipe():
    with pytest.raises(ValueError):
        FeatureRecipe("no_such_set")


@pytest.mark.parametrize("rows_per_bucket", [20, 10**6])
def test_codes_do_not_depend_on_buckets(spark, rows_per_bucket):
    df = spark.range(3000).select(
        "id", F.concat(F.lit("user_é"), F.pmod(F.xxhash64("id"), F.pmod("id", F.lit(700)) + 1)).alias("c")
    )
    pdf = df.toPandas()
    vocab = categories.sorted_vocabulary([df], "c", "code", rows_per_bucket).toPandas()
    assert vocab.sort_values("c")["code"].tolist() == list(range(pdf["c"].nunique()))
    got = categories.factorize(df, df, "c", "id", "code", rows_per_bucket).toPandas().sort_values("id")
    assert (got["code"].to_numpy() == pd.factorize(pdf.sort_values("id")["c"])[0]).all()
    freq = categories.frequency_codes(df, df, "c", 2, "code", rows_per_bucket).toPandas()
    n = pdf["c"].value_counts()
    order = sorted([v for v in n.index if n[v] >= 2], key=lambda v: (-n[v], v.encode()))
    want = {v: i + 1 for i, v in enumerate(order)}
    assert all(want.get(c, 0) == code for c, code in zip(freq["c"], freq["code"]))


def test_families():
    names = ["spectral_type", "u_qbin16", "u_qbin64", "z_rkey4", "a__x__b", "u_floor"]
    assert [categories.in_family(n, "core") for n in names] == [True] * 5 + [False]
    assert [categories.in_family(n, "qbin16") for n in names] == [True, True] + [False] * 4
    assert categories.in_family("u_floor", "u_") and categories.in_family("u_floor", None)


# --- probabilities and metrics ------------------------------------------------------------


def test_normalize_and_ties(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2],), ([0.0, 0.0, 0.0],), ([0.1, 0.2, 0.9],)], "p array<double>")
    sums = df.select(proba.normalize_proba("p", 3).alias("q")).select(
        (F.col("q")[0] + F.col("q")[1] + F.col("q")[2]).alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-12 for r in sums)
    assert [r[0] for r in df.select(proba.argmax("p", 3)).collect()] == [0, 0, 2]


@pytest.mark.parametrize("rows_per_bucket", [40, 10**6])
def test_auc_brute_force(spark, rows_per_bucket):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 500), rng.integers(0, 40, 500) / 40
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    assert abs(metrics.auc(df, "y", "s", rows_per_bucket=rows_per_bucket).first()["auc"] - want) < 1e-12


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.4)], "y int, s double")
    assert metrics.auc(df, "y", "s").first()["auc"] is None


def test_error_jaccard_without_errors(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 1, 1)], "y int, a int, b int")
    row = metrics.pairwise_agreement(df, ["a", "b"]).first()
    assert row["agreement"] == 1.0 and row["error_jaccard"] == 0.0


# --- searches -----------------------------------------------------------------------------


def wide(spark, n=900, models=4):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, n)
    rows = []
    for i in range(n):
        ps = []
        for m in range(models):
            w = rng.random(3) + (0.3 + 0.1 * m) * (np.arange(3) == y[i])
            ps.append([float(v) for v in w / w.sum()])
        rows.append((i, int(y[i]), i % 3, *ps))
    names = [f"m{m}" for m in range(models)]
    return spark.createDataFrame(rows, "id long, y int, fold int, " + ", ".join(f"{m} array<double>" for m in names)), names


def test_both_scoring_forms_agree(spark):
    df, names = wide(spark)
    cands = [search.blend_candidate(w, 3) for w in search.simplex_grid(4, 3)]
    features = search.model_features(names, 3)
    a = search.score_candidates(df, features, cands, "y", 3, "fold", "sums")
    b = search.score_candidates(df, features, cands, "y", 3, "fold", "arrays")
    key = ["cand", "fold", "y", "n", "hit"]
    pa = a.select(*[F.col(c).cast("long") for c in key])
    pb = b.select(*[F.col(c).cast("long") for c in key])
    assert pa.exceptAll(pb).count() == 0 and pa.count() == pb.count() == 20 * 9


def test_climb_never_falls_below_best_single(spark):
    df, names = wide(spark)
    singles = [search.blend_candidate([float(i == m) for i in range(4)], 3) for m in range(4)]
    found = search.collect_scores(
        search.score_candidates(df, search.model_features(names, 3), singles, "y", 3), 4, 3, "y", None)
    weights, score = search.hill_climb(df, names, "y", 3, 8)
    assert score >= search.balanced(found.recalls()).max() and abs(sum(weights) - 1) < 1e-12
    _, grid = search.search_blend_weights(df, names, "y", 3, 4, 2)
    assert grid >= search.balanced(found.recalls()).max()


def test_rule_search_never_below_identity(spark):
    df, names = wide(spark)
    df = df.withColumn("p", F.col(names[0]))
    base = metrics.evaluate(df, "y", "p", 3).first()["balanced_accuracy"]
    for rule in ("bias", "scale_shift", "temperature"):
        params, score = search.search_rule(df, "p", "y", 3, rule, generations=2, population=8)
        assert score >= base - 1e-12
        got = metrics.score_labels(
            df.withColumn("pred", proba.apply_rule("p", 3, rule, params)), "y", "pred", 3).first()
        assert abs(got["balanced_accuracy"] - score) < 0.01


def test_nested_weights_ignore_held_out_labels(spark):
    df, names = wide(spark)
    a, _, _ = search.nested_climb(df, names, "y", 3, "fold", 2, 4)
    shuffled = df.withColumn("y", F.when(F.col("fold") == 1, (F.col("y") + 1) % 3).otherwise(F.col("y")))
    b, _, _ = search.nested_climb(shuffled, names, "y", 3, "fold", 2, 4)
    assert a[1] == b[1]


# --- models -------------------------------------------------------------------------------


def test_nearest_brute_force_with_crowded_cell(spark):
    rng = np.random.default_rng(5)
    ref = np.vstack([np.zeros((150, 4)), rng.normal(size=(250, 4))])
    query = np.vstack([np.zeros((3, 4)), rng.normal(size=(40, 4))])
    r = spark.createDataFrame([(i, i % 3, [float(v) for v in x]) for i, x in enumerate(ref)], "id long, y int, v array<double>")
    q = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(query)], "id long, v array<double>")
    got = nearest(r, q, "id", "v", 5, block_rows=30).toPandas()
    d = np.sqrt(((query[:, None, :] - ref[None]) ** 2).sum(2))
    for i in range(len(query)):
        want = sorted(range(len(ref)), key=lambda j: (d[i, j], j))[:5]
        mine = got[got["id"] == i].sort_values(["distance", "ref_key"])["ref_key"].tolist()
        assert mine == want


def test_nested_cv_ignores_outer_labels(spark):
    df, names = wide(spark, 600, 2)
    cols = [F.col(m)[c] for m in names for c in range(3)]
    frame = learners.with_features(df.withColumn("fold", F.col("fold") % 2), cols, ["id", "y", "fold"])
    options = {"inner": 2, "generations": 1, "population": 6}
    make = lambda s: learners.Logistic(3, iters=8, seed=s)
    a = protocols.nested_cv(frame, make, 3, **options).where("fold = 0")
    other = frame.withColumn("y", F.when(F.col("fold") == 0, (F.col("y") + 1) % 3).otherwise(F.col("y")))
    b = protocols.nested_cv(other, make, 3, **options).where("fold = 0")
    assert a.select("id", "pred").exceptAll(b.select("id", "pred")).count() == 0


def test_refit_rounds_and_presets():
    assert learners.refit_rounds([10, 20], 100, 7) == 16
    assert learners.refit_rounds([1000], 300, 7) == 300 and learners.refit_rounds([], 300, 7) == 7
    assert [learners.preset(n)["step"] for n in ("small", "medium", "large")] == [0.05, 0.05, 0.1]


# --- sources, records, streams ------------------------------------------------------------


def test_align_to_raises(spark):
    ids = spark.range(3)
    have = spark.createDataFrame([(0, 1.0), (1, 2.0)], "id long, v double")
    assert tables.align_to(have, ids, "id").where("v IS NULL").count() == 1
    with pytest.raises(Exception, match="no row for id"):
        tables.align_to(have, ids, "id", "raise").collect()


def test_empty_frames(spark):
    empty = spark.createDataFrame([], "id long, y int, x double, p array<double>")
    assert folds.stratified_folds(empty, "id", "y", 3, 1).count() == 0
    assert metrics.evaluate(empty, "y", "p", 3, ["y"]).count() == 0
    assert binning.QuantileBinner(["x"], 4).fit(empty).transform(empty).count() == 0


def test_append_twice(spark, tmp_path):
    path = str(tmp_path / "log")
    one = spark.createDataFrame([("a", 1)], "experiment string, seed long")
    records.append_experiment(one, path)
    records.append_experiment(one.withColumn("experiment", F.lit("b")), path)
    flat = records.flatten_experiments(records.read_experiments(spark, path))
    assert flat.columns == list(records.LOG_COLUMNS)
    assert sorted(r["experiment"] for r in flat.collect()) == ["a", "b"]
    assert all(r["timestamp"] for r in flat.collect())


def test_restore_leaves_other_models(spark, tmp_path):
    path = str(tmp_path / "preds")
    rows = [("a", "oof", 1, [0.2, 0.8]), ("b", "oof", 1, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "model string, split string, id long, p array<double>")
    predictions.write_preds(df.where("model = 'a'"), path, 2)
    predictions.snapshot(spark, path, "v1")
    predictions.write_preds(df.withColumn("p", F.array(F.lit(1.0), F.lit(0.0))), path, 2)
    predictions.restore(spark, path, "v1")
    got = {r["model"]: r["p"][0] for r in predictions.read_preds(spark, path).collect()}
    assert abs(got["a"] - 0.2) < 1e-6 and got["b"] > 0.99


def test_stream_drops_duplicates_and_late_rows(spark, tmp_path):
    folder = tmp_path / "in"
    schema = "id long, ts timestamp, v double, g string"

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))

    day = lambda d, h: datetime(2024, 1, d, h)
    put([(1, day(1, 1), 1.0, "a"), (1, day(1, 1), 1.0, "a"), (2, day(1, 2), 3.0, "a")])
    stream = streams.read_stream(spark, str(folder), spark.read.parquet(str(folder)).schema)
    watched = streams.watch_experiments(stream, "ts", "id", "v", "g")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def go():
        q = (watched.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()

    go()
    put([(3, day(3, 0), 5.0, "a")])
    go()
    put([(4, day(1, 3), 100.0, "a"), (5, day(9, 0), 1.0, "a")])
    go()
    rows = spark.read.parquet(out).orderBy("start").collect()
    assert (rows[0]["n"], rows[0]["mean_score"]) == (2, 2.0)
