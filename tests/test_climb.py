"""Greedy selection against a climb that scores every step by itself, and the number of its scans."""

from __future__ import annotations

import numpy as np
import pytest

from sparktab.operators import search


def predictions(spark, models, n=240, k=3, seed=5):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, k, n)
    rows, cols = [], []
    for i in range(n):
        cells = []
        for m in range(models):
            p = rng.dirichlet(np.ones(k)) + 0.35 * (np.arange(k) == y[i]) * (m % 3 + 1) / 3
            cells.append([float(x) for x in np.round(p / p.sum(), 3)])
        rows.append((int(y[i]), i % 3, *cells))
    names = [f"m{m}" for m in range(models)]
    cols = ", ".join(f"{m} array<double>" for m in names)
    return spark.createDataFrame(rows, f"y int, fold int, {cols}").coalesce(2), rows, names


def climb(rows, allowed, width, iters, left_out=None, k=3):
    """One step at a time, by plain numpy."""
    kept = [r for r in rows if r[1] != left_out]
    y = np.array([r[0] for r in kept])
    p = np.array([r[2:] for r in kept])

    def score(counts):
        mixed = np.zeros((len(y), k))
        for m, c in enumerate(counts):
            mixed += p[:, m] * (c / sum(counts))
        said = mixed.argmax(1)
        return np.mean([(said[y == c] == c).mean() for c in range(k)])

    counts, best = (0,) * width, -1.0
    for _ in range(iters):
        trials = [tuple(n + (i == m) for i, n in enumerate(counts)) for m in dict.fromkeys(allowed)]
        scores = [score(t) for t in trials]
        top = int(np.argmax(scores))
        if not scores[top] > best:
            break
        counts, best = trials[top], scores[top]
    return counts, best


@pytest.mark.parametrize("models", [1, 4, 12])
def test_same_climb_in_half_the_scans(spark, monkeypatch, models):
    df, rows, names = predictions(spark, models)
    df.cache()
    scans = []
    plain = search.score_candidates
    monkeypatch.setattr(search, "score_candidates", lambda *a, **b: scans.append(len(a[2])) or plain(*a, **b))
    climbers = {"all": (range(models), None), "bag": ([models - 1, 0, models - 1], None), "fold": (range(models), 1), "none": ([], None)}
    got = search.climb_together(df, names, "y", 3, climbers, 9, "fold")
    assert got.pop("none") == ((0,) * models, -1.0)
    steps = 0
    for name, found in got.items():
        want = climb(rows, *[climbers[name][0], models, 9, climbers[name][1]])
        assert found[0] == want[0] and abs(found[1] - want[1]) < 1e-12
        steps = max(steps, min(9, sum(want[0]) + 1))
    # Few models: every second step is known. Many: unless a guess fails.
    assert len(scans) <= (steps + 1) // 2 if models <= 4 else len(scans) < steps


def test_climb_of_one_step_and_of_equal_models(spark):
    df, rows, names = predictions(spark, 2)
    same = df.withColumn("m1", df["m0"])
    weights, score = search.hill_climb(same, names, "y", 3, 5)
    assert weights == [1.0, 0.0]
    assert search.hill_climb(df, names, "y", 3, 1)[1] == pytest.approx(climb(rows, [0, 1], 2, 1)[1])
