"""Nearest rows through a tree of cells against brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from sparktab.plans import neighbors


def brute(ref, query, k):
    out = set()
    for q, x in query:
        d = sorted((float(np.sqrt(np.sum((np.array(x) - np.array(v)) ** 2))), r) for r, _, v in ref)
        out |= {(q, r, round(dist, 9)) for dist, r in d[:k]}
    return out


def found(spark, ref, query, k, **options):
    r = spark.createDataFrame(ref, "id long, y int, v array<double>").repartition(3)
    q = spark.createDataFrame(query, "id long, v array<double>").repartition(2)
    got = neighbors.nearest(r, q, "id", "v", k, **options).collect()
    assert len(got) == len(query) * min(k, len(ref))
    return {(g["id"], g["ref_key"], round(g["distance"], 9)) for g in got}


def points(n, dim, seed, crowded=0.34):
    """Clusters of unequal size; a third of the rows are one and the same point."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim)) * 10
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dim))
    x[rng.random(n) < crowded] = centres[0]
    return x


@pytest.mark.parametrize("dim, numbers", [(2, 4_000_000), (6, 500)])
def test_tree_of_cells_keeps_every_neighbour(spark, monkeypatch, dim, numbers):
    monkeypatch.setattr(neighbors, "NUMBERS_AT_ONCE", numbers)
    monkeypatch.setattr(neighbors, "_pivots", lambda ref, features, n, wanted: np.unique(points(90, dim, 9, 0.0), axis=0))
    ref = [(i, i % 3, v.tolist()) for i, v in enumerate(points(1500, dim, 1))]
    query = [(i, v.tolist()) for i, v in enumerate(points(60, dim, 2))]
    # One query far from everything.
    query.append((60, [1e4] * dim))
    assert found(spark, ref, query, 7, block_rows=40) == brute(ref, query, 7)


def test_few_rows_and_ties(spark):
    ref = [(i, 0, [0.0, 0.0]) for i in range(5)] + [(9, 1, [1.0, 0.0])]
    query = [(1, [0.0, 0.0]), (2, [1.0, 0.0])]
    for k in (1, 5, 6, 20):
        assert found(spark, ref, query, k) == brute(ref, query, k)


def test_groups_cover_all_pivots():
    x = points(400, 3, 4, 0.0)
    tree = neighbors.PivotTree.of(x)
    assert len(tree.chiefs) == 20 and tree.starts[-1] == 400 and (np.diff(tree.starts) > 0).all()
    assert {tuple(r) for r in tree.pivots} == {tuple(r) for r in x}


def test_plan_holds_no_literal_for_each_cell(spark):
    ref = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(points(2000, 2, 3))], "id long, y int, v array<double>")
    plan = neighbors.nearest(ref, ref.select("id", "v").where("id < 20"), "id", "v", 3)._jdf.queryExecution().toString()
    assert "array(1, 1" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_queries_move_once_a_bin_in_bounded_batches(spark, monkeypatch):
    """Far points in many dimensions rule no cell out: a query must not be copied for each small block."""
    moved = []
    written = neighbors.materialize

    def counted(df, tag="stage", **options):
        out = written(df, tag, **options)
        if tag == "knn-asked":
            moved.append(out.count())
        return out

    monkeypatch.setattr(neighbors, "materialize", counted)
    rng = np.random.default_rng(11)
    ref = [(i, i % 3, v.tolist()) for i, v in enumerate(rng.normal(size=(1200, 24)))]
    query = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 24)))]
    assert found(spark, ref, query, 5, block_rows=10) == brute(ref, query, 5)
    # Of at least 120 blocks; bins have isqrt(1200 * 300 / 16) = 150 rows.
    assert moved[0] <= 300 * 20

    tree = neighbors.PivotTree.of(points(30, 2, 9, 0.0))
    monkeypatch.setattr(neighbors, "NUMBERS_AT_ONCE", 4_000)
    x = pd.DataFrame({"id": range(500), "v": list(points(500, 2, 5))})
    m, g = len(tree.pivots), len(tree.chiefs)
    groups = (np.arange(g), np.zeros(g), np.full(g, 1e9))
    cells = (np.arange(m), np.zeros(m), np.full(m, 1e9))
    first = np.arange(m + 1) * 40
    visits = neighbors._visitor(tree, "v", 3, 10**6, groups, cells, first, np.arange(m * 40, dtype="int32") // 5)
    out = list(visits(iter([x])))
    assert sum(b["blocks"].map(len).sum() for b in out) > 500 * 40
    assert max(len(b) for b in out) <= 4_000
