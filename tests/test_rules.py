"""Rules that must hold in every plan and at every size: nulls, ties, types, noise, restarts, joins without shuffles."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparktab.operators import binning, encoders, folds, groupstats, joins, ledger, ranks, search
from sparktab.plans import learners as T
from sparktab.plans import neighbors
from sparktab.session import scratch_path
from sparktab.sources import tables
from sparktab.streaming import streams


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("group", ["text", "number"])
def test_both_scoring_forms_agree_on_nulls_ties_and_types(spark, group):
    df = spark.range(200).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("text"), (F.col("id") % 3).cast("int").alias("number"),
        (F.col("id") % 3).cast("short").alias("y"),
        F.when(F.col("id") % 5 != 0, (F.col("id") % 4) / 4.0).alias("p0"), ((F.col("id") + 1) % 4 / 4.0).alias("p1"),
        F.when(F.col("id") % 7 == 0, float("nan")).otherwise(0.25).alias("p2"),
    )
    feats = [F.col(c) for c in ("p0", "p1", "p2")]
    cands = [search.Candidate(((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)), (0.0, b, 0.0)) for b in (0.0, 0.25, -0.5)]
    sums, arrays = (search.score_candidates(df, feats, cands, "y", 3, group, form) for form in ("sums", "arrays"))
    assert sums.schema == arrays.schema or [f.dataType for f in sums.schema] == [f.dataType for f in arrays.schema]
    assert rows(sums) == rows(arrays)
    whole = df.where("p0 IS NOT NULL AND NOT isnan(p2)").count()
    assert sums.agg(F.sum("n")).first()[0] == 3 * 200
    assert sums.groupBy("cand").agg(F.sum("hit").alias("h")).agg(F.max("h")).first()[0] <= whole


@pytest.mark.parametrize("descending", [False, True])
def test_value_rank_with_nulls_in_any_buckets(spark, descending):
    df = spark.range(400).select("id", F.when(F.col("id") % 10 != 0, F.col("id") % 7).cast("double").alias("v"))
    one, many = (rows(ranks.value_rank(df, [], "v", "id", descending=descending, rows_per_bucket=n).select("id", "rank")) for n in (10_000, 20))
    assert one == many
    nulls = sorted(r for i, r in one if i % 10 == 0)
    assert nulls == (list(range(361, 401)) if descending else list(range(1, 41)))


def test_hash_digits_follow_the_largest_group(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") < 4750, "x").otherwise("y").alias("c"))
    assert ranks.hash_digits(df, ["c"], 100_000) == 0 and ranks.hash_digits(df, ["c"], 100) == 2
    a, b = (rows(ranks.hash_rank(df, ["c"], "id", 1, rows=n)) for n in (100_000, 10))
    assert a == b
    found = folds.stratified_folds(df, "id", "c", 5, 3).groupBy("c", "fold").count().collect()
    assert {r["count"] for r in found} == {950, 50}


def test_time_ranges_hold_no_more_than_asked(spark):
    df = spark.range(3000).select(
        "id", F.lit("g").alias("g"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 977).alias("ts"),
        F.when(F.col("id") % 9 != 0, F.col("id") * 31 % 101).alias("s"),
    )
    a, b = (rows(ledger.running_best(df, "g", "ts", "id", "s", n)) for n in (10**9, 100))
    assert a == b
    assert ledger.time_ranges(df, "ts", 100).groupBy("__t").count().agg(F.max("count")).first()[0] <= 400


def test_rank_bin_leaves_nulls_out(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 4 != 0, F.col("id")).alias("v"))
    got = {r["b"]: r["count"] for r in binning.rank_bin(df, "v", 4, "id", "b").groupBy("b").count().collect()}
    assert got == {None: 25, 0: 19, 1: 19, 2: 19, 3: 18}


def test_noise_belongs_to_the_row_and_the_column(spark):
    df = spark.range(2000).select("id", (F.col("id") % 5).alias("a"), (F.col("id") % 7).alias("b"), (F.col("id") % 2).alias("y"))
    made = [encoders.target_encode(df.repartition(n), df.repartition(n), ["a", "b"], "y", noise=0.1, seed=4, key="id") for n in (1, 7)]
    assert rows(made[0].select("id", "a_te", "b_te")) == rows(made[1].select("id", "a_te", "b_te"))
    plain = encoders.target_encode(df, df, ["a", "b"], "y").select("id", F.col("a_te").alias("pa"), F.col("b_te").alias("pb"))
    both = made[0].join(plain, "id").select((F.col("a_te") / F.col("pa") - 1).alias("u"), (F.col("b_te") / F.col("pb") - 1).alias("v"))
    u, v, r = both.agg(F.stddev("u"), F.avg("v"), F.corr("u", "v")).first()
    assert abs(u - 0.1) < 0.01 and abs(v) < 0.02 and abs(r) < 0.1


def test_small_statistics_move_no_fact_row(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20KB")
    try:
        df = spark.range(3000).select(
            "id", *[(F.col("id") * (i + 3) % (i + 2)).alias(f"c{i}") for i in range(10)],
            (F.col("id") % 3).cast("int").alias("y"), (F.col("id") % 5).cast("int").alias("fold"),
        )
        cols = [f"c{i}" for i in range(10)]
        encoded, _ = encoders.fold_safe_encode(df, cols, "y", 3, "fold")
        stats = groupstats.group_stats(df, {"g": "c4"}, ["id"])
        aux = encoders.aux_prior_encode(df, df, cols, "y", 3)
        for frame in (encoded, stats, aux, encoders.target_encode(df, df, cols, "y")):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        shuffled, _ = encoders.fold_safe_encode(df, cols, "y", 3, "fold")
        assert rows(shuffled) == rows(encoded)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_seeds_of_a_model_are_averaged(spark):
    data = [(1, "a", 1, [0.2, 0.8]), (1, "a", 2, [0.4, 0.6]), (1, "b", 1, [1.0, 0.0]), (2, "a", 1, [0.5, 0.5])]
    preds = spark.createDataFrame(data, "id int, model string, seed int, p array<double>")
    got = joins.predictions_by_model(preds).collect()
    assert len(got) == 1 and got[0]["id"] == 1
    assert got[0]["models"]["a"] == pytest.approx([0.3, 0.7]) and got[0]["models"]["b"] == [1.0, 0.0]


def test_contract_counts_rows(spark):
    data = [("a", i, [0.5, 0.5]) for i in range(4)] + [("b", i, [1.0, 0.0]) for i in range(3)]
    df = spark.createDataFrame(data, "model string, id int, p array<double>")
    check = lambda **k: dict(tables.check_contract(df, "id", "p", 2, ["model"], **k).select("model", "valid").collect())
    assert check() == {"a": True, "b": True}
    assert check(n_rows=4) == {"a": True, "b": False} == check(equal_rows=True)


def test_blend_search_of_many_models_beats_its_start(spark):
    models = [f"m{i}" for i in range(12)]
    df = spark.range(300).select(
        "id", (F.col("id") % 3).cast("int").alias("y"),
        *[F.array(*[F.pmod(F.xxhash64("id", F.lit(i), F.lit(c)), F.lit(100)) / 100.0 + F.when(F.col("id") % 3 == c, 0.02 * i).otherwise(0.0) for c in range(3)]).alias(m)
          for i, m in enumerate(models)],
    )
    weights, score = search.search_blend_weights(df, models, "y", 3, steps=2, rounds=0)
    starts = [tuple(float(i == j) for j in range(12)) for i in range(12)] + [(1 / 12,) * 12]
    table = search.score_candidates(df, search.model_features(models, 3), [search.blend_candidate(w, 3) for w in starts], "y", 3)
    best = search.balanced(search.collect_scores(table, len(starts), 3, "y", None).recalls()).max()
    assert abs(sum(weights) - 1) < 1e-9 and min(weights) >= 0 and score >= best


def test_neighbours_of_a_sorted_frame(spark):
    df = spark.range(400).select("id", F.array((F.col("id") % 20).cast("double"), F.floor(F.col("id") / 20).cast("double")).alias("x"), (F.col("id") % 2).cast("int").alias("y"))
    got = neighbors.nearest(df.coalesce(1), df.where("id % 50 = 0"), "id", "x", 5, block_rows=37).collect()
    points = {r["id"]: r["x"] for r in df.collect()}
    for q in range(0, 400, 50):
        want = sorted((sum((a - b) ** 2 for a, b in zip(points[q], p)) ** 0.5, i) for i, p in points.items())[:5]
        found = sorted((r["distance"], r["ref_key"]) for r in got if r["id"] == q)
        assert [i for _, i in found] == [i for _, i in want] and [d for d, _ in found] == pytest.approx([d for d, _ in want])


def test_stream_continues_where_it_stopped(spark):
    source, out, state = (scratch_path(spark, t) for t in ("in", "out", "state"))
    def run():
        return streams.run_to_table(streams.read_stream(spark, source, spark.range(1).schema), out, state).count()
    spark.range(5).write.parquet(source)
    assert run() == 5 and run() == 5
    spark.range(5, 8).write.mode("append").parquet(source)
    assert run() == 8


def test_features_are_finite(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, None), (4, 2.0)], "id int, v double")
    got = {r["id"]: r["features"][0] for r in T.with_features(df, ["v"], ["id"]).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 0.0, 4: 2.0}


@pytest.mark.parametrize("make", [
    lambda: T.Logistic(3, iters=20), lambda: T.Forest(3, trees=8, depth=4), lambda: T.Perceptron(3, hidden=(8,), iters=60, per_class=60),
    lambda: T.boosted(3, "small", rounds=3), lambda: T.specialist(3, {0: 2.0, 1: 0.5, 2: 1.0}, rounds=3, depth=3),
])
def test_learners_find_separable_classes(spark, make):
    df = spark.range(240).select("id", (F.col("id") % 3).cast("int").alias("y"), (F.col("id") % 3 * 2.0 + F.col("id") % 5 / 10.0).alias("a"), (F.col("id") % 7 / 7.0).alias("b"))
    frame = T.with_features(df, ["a", "b"], ["id", "y"])
    scored = make().fit(frame).proba(frame)
    top = F.array_position("p", F.array_max("p")) - 1
    assert scored.agg(F.avg((top == F.col("y")).cast("double"))).first()[0] > 0.95
    assert scored.agg(F.max(F.abs(F.aggregate("p", F.lit(0.0), lambda s, v: s + v) - 1))).first()[0] < 1e-9
