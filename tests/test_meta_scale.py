"""Meta protocols: what settings, folds and searches share, and that sharing changes no result."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparktab.operators.joins import model_columns
from sparktab.plans import learners, protocols
from sparktab.plans.learners import Forest, Logistic

SHAPE = "model string, id long, y int, fold int, p array<double>"
MODELS = ["a", "b", "c"]


def long_rows(n=60):
    rows = []
    for i in range(n):
        for j, m in enumerate(MODELS):
            w = [1.0 + (i * (j + 2) + 3 * c) % 7 + (i % 3 == c) for c in range(3)]
            rows.append((m, i, i % 3, i % 2, [x / sum(w) for x in w]))
    return rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_columns_of_numbers_are_those_of_arrays(spark):
    rows = [r for r in long_rows(20) if (r[0], r[1]) not in (("a", 3), ("c", 5))]
    rows += [("a", 30, 0, 0, [0.5, None, 0.5]), ("b", 30, 0, 0, [None, None, None]), ("c", 30, 0, 0, [0.1, 0.2, 0.7])]
    rows += [("a", 31, 1, 0, None), ("b", 31, 1, 0, [0.1, 0.2, 0.7]), ("c", 31, 1, 0, [0.1, 0.2, 0.7])]
    rows += [(m, None, 2, 1, [0.2, 0.2, float("nan")]) for m in MODELS]
    df = spark.createDataFrame(rows, SHAPE)
    arrays, cells = model_columns(df, MODELS, ["y", "fold"]), model_columns(df, MODELS, ["y", "fold"], k=3)
    assert repr(table(cells)) == repr(table(arrays)) and cells.schema == arrays.schema
    assert {r["id"] for r in cells.collect()} == {*range(20), 30, None} - {3, 5}
    assert "SortAggregate" not in plan(cells)


def training(spark, classes=3, n=90):
    rows = [(i, i % classes, i % 2, float(i % 7), float((i * i) % 11) + i % classes, 4.0) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, y int, fold int, a double, b double, c double")
    return learners.with_features(df, ["a", "b", "c"], ["id", "y", "fold"])


@pytest.mark.parametrize("scale", [False, True])
@pytest.mark.parametrize("classes", [1, 2, 3])
def test_logistic_scores_as_its_model(spark, scale, classes):
    rows = training(spark, classes)
    fitted = Logistic(4, scale=scale, iters=5).fit(rows)
    got, want = fitted.proba(rows), learners._Fitted.proba(fitted, rows)
    assert got.columns == want.columns
    pairs = zip(got.orderBy("id").collect(), want.orderBy("id").collect(), strict=True)
    assert all(a["p"] == pytest.approx(b["p"], abs=1e-12) and len(a["p"]) == 4 for a, b in pairs)


def test_logistic_builds_no_vectors(spark):
    rows = training(spark)
    scored = Logistic(3, scale=True, iters=2).fit(rows).proba(rows).select("id", "p")
    source = plan(rows.select("id", "features")).count("UDF")
    assert plan(scored).count("UDF") <= source + 1


def test_settings_share_the_scaling(spark, monkeypatch):
    rows = protocols.materialize(training(spark), "test")
    grid = (("logistic", True, 1.0), ("logistic", True, 3.0), ("logistic", False, 1.0), ("mlp", True, 1e-3))
    quick = {"iters": 2, "generations": 0, "population": 4}
    made = []
    whole = learners.StandardScaler
    monkeypatch.setattr(learners, "StandardScaler", lambda **o: made.append(1) or whole(**o))
    got = protocols.tune_meta(rows, 3, grid, **quick)
    assert len(made) == 2
    shared = protocols.oof_predict
    monkeypatch.setattr(protocols, "oof_predict", lambda *a, known=None, **o: shared(*a, **o))
    apart = protocols.tune_meta(rows, 3, grid, **quick)
    assert len(made) == 8
    assert got.round(9).values.tolist() == apart.round(9).values.tolist()


def test_folds_of_a_stack_lie_apart(spark, monkeypatch):
    kept = {}
    whole = protocols.materialize

    def watch(df, tag="stage", partition_by=None):
        kept[tag] = whole(df, tag, partition_by)
        return kept[tag]

    monkeypatch.setattr(protocols, "materialize", watch)
    df = spark.createDataFrame(long_rows(), SHAPE)
    oof, _, tested = protocols.stack(
        df, MODELS, lambda s: Logistic(3, scale=True, iters=3), 3, seeds=(1, 2), folds=3,
        test=df.where("id < 9").drop("y", "fold"), generations=0, population=4)
    assert oof.count() == 60 and tested.count() == 9
    one = kept["meta-folds"].where(F.col("fold") != 1)
    assert "PartitionFilters: [isnotnull(fold" in plan(one)
    assert one.count() == 60 - 3 * 7


def test_pipeline_searches_one_table(spark, monkeypatch, tmp_path):
    learned = {"lr": lambda s: Logistic(3, scale=True, iters=3), "rf": lambda s: Forest(3, trees=2, depth=2, seed=s)}
    rows = protocols.materialize(training(spark).drop("fold"), "test").coalesce(1)

    def run(name, df):
        return protocols.pipeline(df, learned, 3, str(tmp_path / name), (7,), 2, 2)

    made = []
    whole = protocols.blend
    monkeypatch.setattr(protocols, "blend", lambda *a: made.append(1) or whole(*a))
    got = run("one", rows)
    assert not made
    wide = protocols._one_row_each
    monkeypatch.setattr(protocols, "_one_row_each", lambda *a: None)
    long = run("two", rows)
    assert made and got[["before_bias", "after_bias"]].round(9).equals(long[["before_bias", "after_bias"]].round(9))
    assert got["weights"].tolist() == long["weights"].tolist()
    # Ids with two rows take the long path, whose blend leaves them out.
    monkeypatch.setattr(protocols, "_one_row_each", wide)
    made.clear()
    run("three", rows.unionByName(rows.where("id < 3")))
    assert len(made) == 1
