"""Decision rules that callers add, through the same search, scores and comparison as the built-in ones."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktab.functions import proba
from sparktab.operators import search
from tests.test_climb import predictions


def lean(judge="balanced"):
    """Scores of a class are moved towards those of the class before it: not diagonal."""
    return proba.Rule(
        "lean", lambda k: [(-0.5, 0.5), (-1.0, 1.0)], lambda k: [0.0, 0.0],
        lambda v, k: ([[1.0 if i == c else v[0] if i == (c - 1) % k else 0.0 for i in range(k)] for c in range(k)], [v[1]] + [0.0] * (k - 1)),
        text=lambda v: f"lean {v[0]:.2f}, first {v[1]:+.2f}", judge=judge,
    )


@pytest.fixture()
def named():
    rule = proba.add_rule(lean())
    yield rule
    del proba.RULES["lean"]


def expected(rows, params, k=3):
    logs = np.log(np.clip([r[2] for r in rows], *proba.METRIC_BOUNDS))
    moved = logs + params[0] * np.roll(logs, 1, axis=1)
    moved[:, 0] += params[1]
    return moved.argmax(1)


def test_an_added_rule_is_scored_searched_and_applied(spark, named):
    df, rows, _ = predictions(spark, 1)
    params = [0.3, -0.4]
    applied = df.withColumn("pred", proba.apply_rule("m0", 3, "lean", params))
    assert [r["pred"] for r in applied.collect()] == expected(rows, params).tolist()
    y = np.array([r[0] for r in rows])
    for form in ("sums", "arrays"):
        table = search.score_candidates(df, search.log_features("m0", 3), [search.rule_candidate("lean", params, 3)], "y", 3, form=form)
        hits = {r["y"]: r["hit"] for r in table.collect()}
        assert hits == {c: int((expected(rows, params)[y == c] == c).sum()) for c in range(3)}
    found, score = search.search_rule(df, "m0", "y", 3, "lean", generations=2, population=6)
    said = expected(rows, found)
    assert score == pytest.approx(np.mean([(said[y == c] == c).mean() for c in range(3)]))
    table = search.compare_rules(df, "m0", "y", 3, ["bias", named], generations=1, population=4)
    assert table["rule"].tolist() == ["bias", "lean"] and table["nested"].between(0, 1).all()
    assert named.describe(params) == "lean 0.30, first -0.40"


def test_a_rule_needs_no_name_and_may_raise_the_lowest_recall(spark):
    df, rows, _ = predictions(spark, 1)
    y = np.array([r[0] for r in rows])
    found, score = search.search_rule(df, "m0", "y", 3, lean("equal_recall"), generations=1, population=6)
    recalls = [(expected(rows, found)[y == c] == c).mean() for c in range(3)]
    assert score == pytest.approx(min(recalls) + 1e-4 * np.mean(recalls))


def test_names_are_given_once_and_unknown_ones_refused(named):
    with pytest.raises(ValueError, match="already"):
        proba.add_rule(lean())
    with pytest.raises(ValueError, match="unknown rule 'other'"):
        proba.rule_of("other")
    assert proba.rule_of("temperature").describe([1.5, 0.0, 0.25]) == "temperature(1.5, 0, 0.25)"


def test_columns_and_candidates_of_each_rule_agree(spark):
    logs = [F.lit(float(x)) for x in (-0.2, -1.9, -3.1)]
    for rule in proba.RULES.values():
        params = [a + 0.3 * (b - a) for a, b in rule.bounds(3)]
        cand = search.rule_candidate(rule, params, 3)
        want = [sum(w * x for w, x in zip(row, (-0.2, -1.9, -3.1))) + b for row, b in zip(cand.weights, cand.bias)]
        got = spark.range(1).select(*[c.alias(f"s{i}") for i, c in enumerate(proba.rule_scores(logs, rule, params))]).first()
        assert np.allclose(list(got), want)
        assert rule.linear(rule.start(3), 3) == (proba.diagonal([1.0] * 3), (0.0,) * 3)
