"""Quantiles of many columns at once, and the best rows by counts of score intervals."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktab.operators import folds, ranks


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(8)
    n = 4000
    x = {
        "even": rng.random(n), "skewed": np.exp(20 * rng.random(n)) - 5, "tied": rng.integers(0, 5, n).astype(float),
        "hot": np.where(rng.random(n) < 0.4, 3.25, rng.normal(size=n)), "one": np.full(n, 7.0), "huge": rng.normal(size=n) * 1e300,
        "few": np.where(np.arange(n) < 3, np.arange(n), np.nan), "odd": np.where(rng.random(n) < 0.1, np.inf, rng.random(n)),
    }
    rows = [[None if np.isnan(v[i]) and k == "few" else float(v[i]) for k, v in x.items()] for i in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"{k} double" for k in x)).repartition(4), x


@pytest.mark.parametrize("rows, points", [(50, 256), (30, 4), (100_000, 256)])
def test_quantiles_of_all_columns(numbers, monkeypatch, rows, points):
    df, x = numbers
    monkeypatch.setattr(ranks, "POINTS", points)
    probs = [0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = ranks.exact_quantiles(df, list(x), probs, exact_rows=0, rows_per_bucket=rows)
    for c, v in x.items():
        want = np.quantile(v[np.isfinite(v)], probs)
        assert np.allclose(got[c], want, rtol=1e-12), c


def test_quantiles_without_values(spark):
    df = spark.createDataFrame([(None, float("nan"))], "a double, b double")
    assert ranks.exact_quantiles(df, ["a", "b"], [0.5], exact_rows=0) == {"a": [], "b": []}


def best(rows, n):
    """rows (id, group, score): the ids kept, by plain sorting."""
    out = set()
    for g in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == g and r[2] is not None]
        own.sort(key=lambda r: (-(np.inf if np.isnan(r[2]) else r[2]), not np.isnan(r[2]), hashlib.md5(f"0:{r[0]}".encode()).hexdigest(), r[0]))
        out |= {r[0] for r in own[:n]}
    return out


@pytest.mark.parametrize("at_cut", [1_000_000, 6])
@pytest.mark.parametrize("n", [1, 25, 500])
def test_top_rows(spark, at_cut, n):
    rng = np.random.default_rng(n)
    rows = []
    for i in range(900):
        g = ["a", "b", None, "tiny"][min(3, i % 4 if i < 880 else 3)]
        score = [rng.random(), 0.75, round(rng.random(), 2), 0.5 + 1e-13 * rng.random()][i % 4]
        score = {3: None, 7: float("inf"), 11: float("nan"), 15: -2.0, 19: float("-inf")}.get(i, float(score))
        rows.append((i, g, score))
    df = spark.createDataFrame(rows, "id int, g string, s double")
    got = [r["id"] for r in folds.top_rows(df, ["g"], "s", "id", n, 0.0, 1.0, at_cut).collect()]
    assert len(got) == len(set(got)) and set(got) == best(rows, n)


def test_top_rows_move_only_the_cut(spark):
    df = spark.range(2000).select("id", (F.col("id") / 2000.0).alias("s"))
    out = folds.top_rows(df, [], "s", "id", 300, 0.0, 1.0)
    assert sorted(r["id"] for r in out.collect()) == list(range(1700, 2000))
    assert folds.top_rows(df, [], "s", "id", 5000, 0.0, 1.0).count() == 2000
