"""Protocols on a table with a column for each model against the long table."""

from __future__ import annotations

import pytest

from sparktab.operators.ensemble import blend
from sparktab.plans import protocols

SHAPE = "model string, id long, y int, fold int, p array<double>"
MODELS = ["a", "b", "c"]


def long_rows():
    rows = []
    for i in range(40):
        for j, m in enumerate(MODELS):
            if (i, m) not in ((3, "a"), (5, "c"), (8, "b")):
                w = [1.0 + (i * (j + 2) + 3 * c) % 7 + (i % 3 == c) for c in range(3)]
                rows.append((m, i, i % 3, i % 2, [x / sum(w) for x in w]))
    return rows


def vectors(df):
    return {r["id"]: (r["y"], tuple(round(x, 12) for x in r["p"])) for r in df.collect()}


@pytest.mark.parametrize("weights", [(0.5, 0.25, 0.25), (1.0, 0.0, 2.0), (0.0, 0.0, 0.0)])
def test_blend_of_columns(spark, weights):
    df = spark.createDataFrame(long_rows(), SHAPE)
    wide = protocols._one_row_each(df, MODELS, "fold")
    used = dict(zip(MODELS, weights))
    got = protocols._blend_columns(wide, used, 3)
    assert vectors(got) == vectors(blend(df, used, 3))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_other_tables_stay_long(spark):
    rows = long_rows()
    m, i, y, f, p = rows[0]
    for more in ((m, i, y, f, p), ("c", 5, 2, 0, p), ("c", 5, 1, 1, p), ("c", 5, 2, None, p), ("c", 5, 2, 1, None)):
        assert protocols._one_row_each(spark.createDataFrame([*rows, more], SHAPE), MODELS, "fold") is None
    assert protocols._one_row_each(spark.createDataFrame([*rows, ("c", 5, 2, 1, p)], SHAPE), MODELS, "fold") is not None


def test_levels_and_subsets_meet_models_once(spark, monkeypatch):
    df = spark.createDataFrame(long_rows(), SHAPE)

    def logistic(seed):
        return protocols.Logistic(3, iters=3)

    def results():
        quick = {"generations": 0, "population": 4}
        metas = {"lin": ("logit", logistic), "hc": ("climb", {"bags": 1, "iters": 1})}
        levels = protocols.multi_level(df, MODELS, metas, 3, ("mean",), ("bias",), inner=2, **quick)
        chosen = protocols.select_subset(df, {"two": ["a", "b"], "all": MODELS}, 3, logistic, folds=2, **quick)
        return levels.round(9).values.tolist(), chosen.round(9).values.tolist()

    made = []
    whole = protocols.model_columns
    monkeypatch.setattr(protocols, "model_columns", lambda rows, models, **o: made.append(list(models)) or whole(rows, models, **o))
    got = results()
    assert MODELS not in made and ["a", "b"] not in made
    monkeypatch.setattr(protocols, "_one_row_each", lambda *a: None)
    assert results() == got and MODELS in made
