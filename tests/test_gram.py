"""Pair sums from one scan against pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sparktab.operators import gram, groupstats, metrics


def test_correlation_of_many_columns_with_gaps(spark):
    rng = np.random.default_rng(2)
    n, p = 700, 40
    x = rng.normal(size=(n, p)) + rng.normal(size=(n, 1))
    x[:, 0] += 1e9
    x[:, 1] = 5.5
    gaps = rng.random((n, p)) < 0.2
    gaps[:, 2] = True
    cols = [f"f{i}" for i in range(p)]
    rows = [[None if g else float(v) for v, g in zip(r, m)] for r, m in zip(x, gaps)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(5)
    want = pd.DataFrame(np.where(gaps, np.nan, x), columns=cols).corr(min_periods=2)
    got = {(r["a"], r["b"]): r["corr"] for r in groupstats.column_correlation(df, cols).collect()}
    assert len(got) == p * (p - 1) // 2
    for (a, b), v in got.items():
        if a in ("f1", "f2") or b in ("f1", "f2"):
            assert v is None
        else:
            assert abs(v - want.loc[a, b]) < (1e-6 if a == "f0" else 1e-9)
    plan = groupstats.column_correlation(df, cols)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_correlation_of_no_rows_and_nan(spark):
    df = spark.createDataFrame([], "a double, b int")
    assert groupstats.column_correlation(df, ["a", "b"]).collect() in ([], [("a", "b", None)])
    df = spark.createDataFrame([(float("nan"), 1, 3), (1.0, 2, 4), (2.0, 5, 9)], "a double, b int, c int")
    got = {(r["a"], r["b"]): r["corr"] for r in groupstats.column_correlation(df, ["a", "b", "c"]).collect()}
    assert np.isnan(got["a", "b"]) and np.isnan(got["a", "c"]) and 0.9 < got["b", "c"] <= 1


def test_agreement_of_many_models(spark):
    rng = np.random.default_rng(4)
    n, p = 500, 12
    y = rng.integers(0, 4, n)
    said = np.where(rng.random((n, p)) < 0.6, y[:, None], rng.integers(0, 4, (n, p)))
    gaps = rng.random((n, p)) < 0.05
    names = [f"m{i}" for i in range(p)]
    rows = [[int(y[i]), *[None if g else f"k{v}" for v, g in zip(said[i], gaps[i])]] for i in range(n)]
    df = spark.createDataFrame(rows, "y int, " + ", ".join(f"{m} string" for m in names)).withColumn("y", F.concat(F.lit("k"), "y"))
    got = {(r["model_a"], r["model_b"]): (r["agreement"], r["error_jaccard"]) for r in metrics.pairwise_agreement(df.repartition(3), names).collect()}
    assert len(got) == p * (p - 1) // 2
    for i in range(p):
        for j in range(i + 1, p):
            wrong = [(said[:, k] != y) & ~gaps[:, k] for k in (i, j)]
            same = ((said[:, i] == said[:, j]) & ~gaps[:, i] & ~gaps[:, j]).mean()
            share = (wrong[0] & wrong[1]).sum() / (wrong[0] | wrong[1]).sum()
            assert np.allclose(got[f"m{i}", f"m{j}"], (same, share))


def test_blocks_do_not_matter(spark, monkeypatch):
    df = spark.range(1000).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"), (F.col("id") % 11).alias("c"))
    want = sorted(gram.moment_pairs(df, ["a", "b", "c"]).collect())
    monkeypatch.setattr(gram, "ROWS_AT_ONCE", 3)
    assert sorted(gram.moment_pairs(df, ["a", "b", "c"]).collect()) == want
