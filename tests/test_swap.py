"""Swap noise of many columns through one order."""

from __future__ import annotations

from collections import Counter

from sparktab.operators import folds

SHAPE = "id long, x double, t string, a array<int>, x2 double"


def rows(n):
    return [(i if i % 9 else None, float(i), None if i % 5 == 0 else f"t{i}", [i], -float(i)) for i in range(n)] + [(1, -1.0, "t1", None, 0.5)]


def test_all_cells_swapped_are_a_permutation(spark):
    data = rows(300)
    frame = spark.createDataFrame(data, SHAPE).repartition(4)
    got = [tuple(r) for r in folds.swap_cells(frame, "id", ["x", "t", "a", "x2"], 1.0, 5).collect()]
    assert Counter(r[0] for r in got) == Counter(r[0] for r in data)
    for j in range(1, 5):
        assert Counter(map(str, (r[j] for r in got))) == Counter(map(str, (r[j] for r in data)))
    own = {r[1]: r for r in data}
    # No row keeps a cell of its own, and no row takes two cells from one donor.
    assert all(own[r[1]][4] != r[4] for r in got)
    single = {r[0]: r for r in data if r[0] not in (None, 1)}
    assert all(single[r[0]][1] != r[1] for r in got if r[0] in single)


def test_share_of_cells_and_other_columns(spark):
    data = [(i, float(i), f"t{i}", [i], float(i)) for i in range(2000)]
    frame = spark.createDataFrame(data, SHAPE).repartition(3)
    got = [tuple(r) for r in folds.swap_cells(frame, "id", ["x", "t"], 0.25, 2).collect()]
    assert sorted((r[0], r[3], r[4]) for r in got) == [(r[0], r[3], r[4]) for r in data]
    for j in (1, 2):
        moved = sum(r[j] != data[r[0]][j] for r in got)
        assert 400 < moved < 600
    none = folds.swap_cells(frame, "id", ["x", "t"], 0.0, 2)
    assert sorted(map(tuple, none.collect())) == data


def test_one_row_and_none(spark):
    for data in ([(1, 2.0, "b", [3], 4.0)], []):
        got = folds.swap_cells(spark.createDataFrame(data, SHAPE), "id", ["x", "t"], 1.0, 1)
        assert got.columns == ["id", "x", "t", "a", "x2"] and [tuple(r) for r in got.collect()] == data


def test_exchanges_do_not_grow_with_columns(spark):
    def exchanges(k):
        data = [(i, *[float(i + j) for j in range(k)]) for i in range(50)]
        frame = spark.createDataFrame(data, "id long, " + ", ".join(f"c{j} double" for j in range(k)))
        out = folds.swap_cells(frame, "id", [f"c{j}" for j in range(k)], 0.5, 1)
        return out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    assert exchanges(1) == exchanges(12) <= 2
