"""Searches over an ensemble: many candidates scored by one distributed job.

Every candidate is linear in row features before the arg max: class scores are
``x . W + b``. Blend weights, class biases, temperatures and scale-shift rules are all of
this form. A job returns hits per (candidate, group, true class); because hits add up,
"all rows but fold f" is the total minus fold f, so leave-one-fold-out scores cost nothing
extra. The driver sees candidates x folds x classes numbers and proposes the next batch.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktab.functions.exprs import clip, weighted
from sparktab.functions.proba import METRIC_BOUNDS, Rule, argmax_of, parts, rule_of

# Up to this many candidates are conditional sums in one aggregate; larger batches are
# matrix products per Arrow batch with partial sums per task.
MAX_SUM_COLUMNS = 48


@dataclass(frozen=True)
class Candidate:
    """``weights[class][feature]`` and ``bias[class]``."""

    weights: tuple[tuple[float, ...], ...]
    bias: tuple[float, ...]


@dataclass
class Scores:
    """Hits of every candidate, as arrays over (candidate, group, class)."""

    groups: list
    n: np.ndarray
    hit: np.ndarray
    _cache: dict = field(default_factory=dict)

    def recalls(self, without=None, only=None) -> np.ndarray:
        """Class recalls per candidate over all groups, all but one, or one."""
        n, hit = self.n, self.hit
        if only is not None:
            i = self.groups.index(only)
            n, hit = n[i], hit[:, i]
        elif without is not None:
            i = self.groups.index(without)
            n, hit = n.sum(0) - n[i], hit.sum(1) - hit[:, i]
        else:
            n, hit = n.sum(0), hit.sum(1)
        return np.where(n > 0, hit / np.maximum(n, 1), np.nan)


def balanced(recalls: np.ndarray) -> np.ndarray:
    """Mean recall over the classes that occur."""
    return np.nanmean(recalls, axis=1)


def equal_recall(recalls: np.ndarray) -> np.ndarray:
    """Lowest class recall, ties by the mean."""
    return np.nanmin(recalls, axis=1) + 1e-4 * np.nanmean(recalls, axis=1)


def score_candidates(
    df: DataFrame, features: Sequence[Column], candidates: Sequence[Candidate], y: str, k: int,
    by: str | None = None, form: str = "auto",
) -> DataFrame:
    """``(cand, [by], y, n, hit)``: rows and right answers per candidate, group and class.

    Two forms with one result: JVM sums for few candidates, NumPy batches for many. A row with a
    missing feature counts in ``n`` and is nobody's hit; of equal scores the first class wins;
    groups and classes keep their types.
    """
    if form == "auto":
        form = "sums" if len(candidates) <= MAX_SUM_COLUMNS else "arrays"
    if form == "sums":
        return _score_by_sums(df, features, candidates, y, by)
    return _score_by_arrays(df, features, candidates, y, by)


def _score_by_sums(df, features, candidates, y, by) -> DataFrame:
    names = [f"__x{i}" for i in range(len(features))]
    keep = ([by] if by else []) + [y]
    base = df.select(*keep, *[e.alias(n) for n, e in zip(names, features)])
    xs = [F.col(n) for n in names]
    whole = F.lit(True)
    for x in xs:
        whole = whole & x.isNotNull() & ~F.isnan(x)
    hits = [
        F.sum(
            F.coalesce(
                whole & (argmax_of([weighted(xs, w, b) for w, b in zip(c.weights, c.bias)]) == F.col(y)),
                F.lit(False),
            ).cast("long")
        ).alias(f"h{j}")
        for j, c in enumerate(candidates)
    ]
    wide = base.groupBy(*keep).agg(F.count(F.lit(1)).alias("n"), *hits)
    rows = F.array(
        *[
            F.struct(F.lit(j).alias("cand"), F.col(f"h{j}").alias("hit"))
            for j in range(len(candidates))
        ]
    )
    return wide.select(*keep, "n", F.inline(rows)).select("cand", *keep, "n", "hit")


def _score_by_arrays(df, features, candidates, y, by) -> DataFrame:
    weights = np.array([c.weights for c in candidates], dtype="float64")
    bias = np.array([c.bias for c in candidates], dtype="float64")
    n_cand, k, width = weights.shape
    matrix = weights.reshape(n_cand * k, width).T
    keys = ([by] if by else []) + [y]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows_at_once = max(256, 4_000_000 // (n_cand * k))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[tuple, np.ndarray] = {}
        sizes: dict[tuple, int] = {}
        for pdf in batches:
            x = np.stack(pdf["x"].to_numpy())
            x = x.astype("float64")
            whole = ~np.isnan(x).any(1)
            truth = pdf[y].to_numpy()
            codes, groups = pd.factorize(pd.MultiIndex.from_frame(pdf[keys]))
            for start in range(0, len(pdf), rows_at_once):
                part = slice(start, start + rows_at_once)
                # Features are added one after another, as an expression adds them.
                s = np.zeros((len(x[part]), n_cand * k))
                for j in np.flatnonzero(matrix.any(1)):
                    s += np.nan_to_num(x[part, j, None]) * matrix[j]
                s = s.reshape(-1, n_cand, k) + bias
                right = (s.argmax(2) == truth[part, None]) & whole[part, None]
                for g in np.unique(codes[part]):
                    inside = codes[part] == g
                    key = tuple(groups[g])
                    counts[key] = counts.get(key, 0) + right[inside].sum(0)
                    sizes[key] = sizes.get(key, 0) + int(inside.sum())
        for key, hit in counts.items():
            out = pd.DataFrame({"cand": np.arange(n_cand, dtype="int32")})
            for name, value in zip(keys, key):
                out[name] = value
            out["n"], out["hit"] = sizes[key], hit.astype("int64")
            yield out

    fields = ", ".join(["cand int", *[f"`{c}` {types[c]}" for c in keys], "n long", "hit long"])
    ready = df.select(*keys, F.array(*features).alias("x"))
    return (
        ready.mapInPandas(partial, fields)
        .groupBy("cand", *keys)
        .agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"))
    )


def collect_scores(table: DataFrame, n_candidates: int, k: int, y: str, by: str | None) -> Scores:
    """Bring the score table to the driver: candidates x groups x classes numbers."""
    pdf = table.toPandas()
    groups = sorted(pdf[by].unique().tolist()) if by else [None]
    n = np.zeros((len(groups), k))
    hit = np.zeros((n_candidates, len(groups), k))
    spot = {g: i for i, g in enumerate(groups)}
    where = pdf[by].map(spot).to_numpy() if by else np.zeros(len(pdf), dtype=int)
    cls, cand = pdf[y].to_numpy().astype(int), pdf["cand"].to_numpy().astype(int)
    n[where, cls] = pdf["n"].to_numpy()
    hit[cand, where, cls] = pdf["hit"].to_numpy()
    return Scores(groups, n, hit)


def candidate_recalls(table: DataFrame, k: int, y: str, by: str | None = None) -> DataFrame:
    """Recalls and balanced accuracy per candidate (and group), still as a DataFrame."""
    keys = ["cand"] + ([by] if by else [])
    recall = [
        F.try_divide(F.sum(F.when(F.col(y) == c, F.col("hit"))), F.sum(F.when(F.col(y) == c, F.col("n"))))
        for c in range(k)
    ]
    out = table.groupBy(*keys).agg(*[r.alias(f"recall_{c}") for c, r in enumerate(recall)])
    some = F.filter(F.array(*[F.col(f"recall_{c}") for c in range(k)]), lambda v: v.isNotNull())
    mean = F.aggregate(some, F.lit(0.0), lambda a, v: a + v) / F.size(some)
    least = F.array_min(some)
    return out.withColumns(
        {"balanced_accuracy": mean, "equal_recall": least + F.lit(1e-4) * mean}
    )


# --- candidate builders -----------------------------------------------------------------


def log_features(p: str, k: int) -> list[Column]:
    return [F.ln(clip(c, *METRIC_BOUNDS)) for c in parts(p, k)]


def model_features(models: Sequence[str], k: int) -> list[Column]:
    return [c for m in models for c in parts(m, k)]


def rule_candidate(rule: Rule | str, params: Sequence[float], k: int) -> Candidate:
    """A decision rule on log probabilities as a linear candidate."""
    weights, bias = rule_of(rule).linear([float(x) for x in params], k)
    return Candidate(tuple(tuple(float(x) for x in w) for w in weights), tuple(float(b) for b in bias))


def blend_candidate(weights: Sequence[float], k: int) -> Candidate:
    """Model weights as a linear candidate over the flattened model probabilities."""
    size = float(sum(weights)) or 1.0
    rows = tuple(
        tuple(w / size if i == c else 0.0 for w in weights for i in range(k)) for c in range(k)
    )
    return Candidate(rows, (0.0,) * k)


def simplex_grid(n: int, steps: int) -> list[tuple[float, ...]]:
    """All weight vectors whose entries are multiples of ``1/steps`` and add up to 1."""

    def fill(slots: int, left: int) -> Iterator[tuple[int, ...]]:
        if slots == 1:
            yield (left,)
            return
        for i in range(left, -1, -1):
            for rest in fill(slots - 1, left - i):
                yield (i, *rest)

    return [tuple(v / steps for v in point) for point in fill(n, steps)]


# --- searches ---------------------------------------------------------------------------


def search_blend_weights(
    wide: DataFrame, models: Sequence[str], y: str, k: int, steps: int = 10, rounds: int = 2
) -> tuple[list[float], float]:
    """Model weights on the simplex with the best balanced accuracy.

    The first candidates are the single models, the even blend, and the even blends of two. Then
    weight (a step, or all there is) moves from one model to another, n**2 moves in each of ``rounds`` rounds for each step
    size from 1/2 down to 1/(4 * steps), so the number of candidates grows with the square of the
    number of models. The result is never below the best single model or the even blend. Ties
    go to the earlier candidate.
    """
    features = model_features(models, k)
    n = len(models)
    points = [tuple(float(i == j) for j in range(n)) for i in range(n)] + [(1.0 / n,) * n]
    points += [tuple(0.5 * ((i in pair) - 0.0) for i in range(n)) for pair in combinations(range(n), 2)]
    best: list[float] = []
    score = -1.0
    step, turn = 0.5, 0
    while True:
        cands = [blend_candidate(p, k) for p in points]
        found = collect_scores(
            score_candidates(wide, features, cands, y, k), len(cands), k, y, None
        )
        values = balanced(found.recalls())
        top = int(np.argmax(values))
        better = values[top] > score
        if better:
            best, score = list(points[top]), float(values[top])
        turn += 1
        if not better or turn > rounds:
            step, turn = step / 2, 0
        if step < 0.25 / steps:
            return best, score
        near = set()
        for i, j in product(range(len(models)), repeat=2):
            moving = min(step, best[j])
            if i != j and moving > 1e-12:
                moved = list(best)
                moved[i] += moving
                moved[j] -= moving
                near.add(tuple(moved))
        points = sorted(near)
        if not points:  # one model alone
            return best, score


def search_rules(
    df: DataFrame, p: str, y: str, k: int, rule: Rule | str, views: Sequence, by: str | None = None,
    generations: int = 6, population: int = 24, seed: int = 42,
    objective: Callable[[np.ndarray], np.ndarray] | None = None,
) -> dict:
    """Best parameters of a rule for several views of the rows at once.

    A view is ``None`` (all rows) or a group of ``by`` that is left out. Differential
    evolution: every generation of every view is scored in one job. The unchanged arg max is
    in the first generation, so no view ends below it.
    """
    rule = rule_of(rule)
    objective = objective or {"balanced": balanced, "equal_recall": equal_recall}[rule.judge]
    bounds = rule.bounds(k)
    features = log_features(p, k)
    rng = {v: random.Random(f"{seed}:{v}") for v in views}

    def drawn(v):
        return [rng[v].uniform(lo, hi) for lo, hi in bounds]

    people = {v: [rule.start(k)] + [drawn(v) for _ in range(population - 1)] for v in views}
    values: dict = {}
    for generation in range(generations + 1):
        trials = people if generation == 0 else {v: _evolve(people[v], values[v], bounds, rng[v]) for v in views}
        cands = [rule_candidate(rule, t, k) for v in views for t in trials[v]]
        found = collect_scores(
            score_candidates(df, features, cands, y, k, by), len(cands), k, y, by
        )
        for i, v in enumerate(views):
            own = objective(found.recalls(without=v))[i * population : (i + 1) * population]
            if generation == 0:
                values[v] = own.copy()
                continue
            for j in range(population):
                if own[j] >= values[v][j]:
                    people[v][j], values[v][j] = trials[v][j], own[j]
    out = {}
    for v in views:
        top = int(np.argmax(values[v]))
        out[v] = (people[v][top], float(values[v][top]))
    return out


def _evolve(people, values, bounds, rng: random.Random, scale: float = 0.7, mix: float = 0.7):
    best = people[int(np.argmax(values))]
    trials = []
    for own in people:
        a, b = rng.sample(range(len(people)), 2)
        keep = rng.randrange(len(bounds))
        trial = []
        for i, (lo, hi) in enumerate(bounds):
            moved = best[i] + scale * (people[a][i] - people[b][i])
            use = rng.random() < mix or i == keep
            trial.append(min(max(moved, lo), hi) if use else own[i])
        trials.append(trial)
    return trials


def search_rule(df: DataFrame, p: str, y: str, k: int, rule: Rule | str, **options) -> tuple[list[float], float]:
    """Best parameters of one rule over all rows."""
    return search_rules(df, p, y, k, rule, [None], None, **options)[None]


def compare_rules(
    df: DataFrame, p: str, y: str, k: int, rules: Sequence[Rule | str], fold: str = "fold", **options
) -> pd.DataFrame:
    """Naive and nested balanced accuracy per rule on shared predictions.

    Nested: parameters chosen without fold f, scored on f, averaged over folds.
    """
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    rows = []
    for rule in rules:
        fitted = search_rules(df, p, y, k, rule, [None, *folds], fold, **options)
        cands = [rule_candidate(rule, fitted[v][0], k) for v in (None, *folds)]
        found = collect_scores(
            score_candidates(df, log_features(p, k), cands, y, k, fold), len(cands), k, y, fold
        )
        nested = [float(balanced(found.recalls(only=f))[i + 1]) for i, f in enumerate(folds)]
        rows.append((rule_of(rule).name, float(balanced(found.recalls())[0]), float(np.mean(nested))))
    return pd.DataFrame(rows, columns=["rule", "naive", "nested"])


def _score_counts(
    wide: DataFrame, models: Sequence[str], y: str, k: int, trials: list[tuple[int, ...]], by: str | None
) -> Scores:
    """One job for all count vectors."""
    cands = [blend_candidate(t, k) for t in trials]
    return collect_scores(
        score_candidates(wide, model_features(models, k), cands, y, k, by), len(cands), k, y, by
    )


def _with_one_more(counts: tuple[int, ...], m: int) -> tuple[int, ...]:
    return tuple(n + (i == m) for i, n in enumerate(counts))


def climb_together(
    wide: DataFrame, models: Sequence[str], y: str, k: int,
    climbers: dict, iters: int, by: str | None = None,
) -> dict:
    """Greedy selection with replacement for many climbers, about one job for two steps.

    ``climbers`` maps a name to ``(allowed model positions, left-out group or None)``. Each
    starts at its best single model, adds the model that raises balanced accuracy most, and
    stops without a strict gain; ties go to the first allowed model.

    A job scores the count vectors that the climbers ask for and, ahead of time, their successors:
    all while they are few, else those of the models that scored best one step before. Scores are
    kept, so a step whose vectors are known needs no scan; guesses change the number of jobs only.
    """
    width = len(models)
    counts = {c: (0,) * width for c in climbers}
    value = dict.fromkeys(climbers, -1.0)
    # Scores of the models that a climber could add, from its last step.
    liked = {c: dict.fromkeys(climbers[c][0], 0.0) for c in climbers}
    active = [c for c in climbers if climbers[c][0]]
    known: dict[tuple[int, ...], Scores] = {}
    for step in range(iters):
        if not active:
            break
        asked = {(c, m): _with_one_more(counts[c], m) for c in active for m in liked[c]}
        wanted = dict.fromkeys(t for t in asked.values() if t not in known)
        if wanted:
            if step + 1 < iters:
                room = max(MAX_SUM_COLUMNS, 4 * len(wanted))
                for c, m in sorted(asked, key=lambda cm: -liked[cm[0]][cm[1]]):
                    nexts = dict.fromkeys(_with_one_more(asked[c, m], n) for n in liked[c])
                    fresh = [t for t in nexts if t not in known and t not in wanted]
                    if len(wanted) + len(fresh) <= room:
                        wanted.update(dict.fromkeys(fresh))
            found = _score_counts(wide, models, y, k, list(wanted), by)
            known.update({t: Scores(found.groups, found.n, found.hit[i : i + 1]) for i, t in enumerate(wanted)})
        still = []
        for c in active:
            left_out = climbers[c][1]
            liked[c] = {m: float(balanced(known[asked[c, m]].recalls(without=left_out))[0]) for m in liked[c]}
            top = max(liked[c], key=liked[c].get)
            if liked[c][top] > value[c]:
                counts[c], value[c] = asked[c, top], liked[c][top]
                still.append(c)
        active = still
    return {c: (counts[c], value[c]) for c in climbers}


def hill_climb(
    wide: DataFrame, models: Sequence[str], y: str, k: int, iters: int = 30
) -> tuple[list[float], float]:
    """Model weights from greedy selection with replacement, and their score."""
    found = climb_together(wide, models, y, k, {"one": (range(len(models)), None)}, iters)["one"]
    return _as_weights([found[0]], len(models)), found[1]


def _as_weights(counts: Sequence[Sequence[int]], width: int) -> list[float]:
    total = [sum(c[i] for c in counts) for i in range(width)]
    size = sum(total)
    return [t / size for t in total] if size else [1.0 / width] * width


def bag_lists(n_models: int, bags: int, seed: int) -> list[list[int]]:
    """Model positions drawn with replacement, one list per bag."""
    rng = random.Random(seed)
    return [[rng.randrange(n_models) for _ in range(n_models)] for _ in range(bags)]


def bagged_climb(
    wide: DataFrame, models: Sequence[str], y: str, k: int, bags: int = 20, iters: int = 30, seed: int = 42
) -> list[float]:
    """Hill climbs on bootstrapped model lists, their counts added up and normalized."""
    climbers = {b: (lst, None) for b, lst in enumerate(bag_lists(len(models), bags, seed))}
    found = climb_together(wide, models, y, k, climbers, iters)
    return _as_weights([c for c, _ in found.values()], len(models))


def nested_climb(
    wide: DataFrame, models: Sequence[str], y: str, k: int, fold: str = "fold",
    bags: int = 5, iters: int = 15, seed: int = 42,
) -> tuple[dict, float, float]:
    """Weights per fold chosen without it, the mean score on the left-out folds, and the
    naive score of weights chosen on everything."""
    folds = sorted(r[0] for r in wide.select(fold).distinct().collect())
    lists = bag_lists(len(models), bags, seed)
    climbers = {(v, b): (lst, v) for v in (None, *folds) for b, lst in enumerate(lists)}
    found = climb_together(wide, models, y, k, climbers, iters, fold)
    weights = {
        v: _as_weights([found[(v, b)][0] for b in range(bags)], len(models)) for v in (None, *folds)
    }
    cands = [blend_candidate(weights[v], k) for v in (None, *folds)]
    scores = collect_scores(
        score_candidates(wide, model_features(models, k), cands, y, k, fold), len(cands), k, y, fold
    )
    nested = float(np.mean([balanced(scores.recalls(only=f))[i + 1] for i, f in enumerate(folds)]))
    return weights, nested, float(balanced(scores.recalls())[0])


def grid_patch(
    df: DataFrame, k: int, cuts: dict[float, float], alphas: Sequence[float],
    biases: Sequence[Sequence[float]], y: str, p: str = "p", fallback: str = "fallback", u: str = "u",
) -> DataFrame:
    """Every (quantile, alpha) patch of uncertain rows, each with its best class bias.

    ``cuts`` maps quantiles to fitted values of ``u``. All patched vectors are features of one
    job; a candidate reads the block of its (quantile, alpha).
    """
    blocks = [(q, a) for q in cuts for a in alphas]
    features: list[Column] = []
    for q, a in blocks:
        for own, other in zip(parts(p, k), parts(fallback, k)):
            mixed = F.when(F.col(u) >= F.lit(cuts[q]), (1 - a) * own + a * other).otherwise(own)
            features.append(F.ln(clip(mixed, *METRIC_BOUNDS)))
    cands, owner = [], []
    for i, block in enumerate(blocks):
        for b in biases:
            rows = tuple(
                tuple(1.0 if j == i * k + c else 0.0 for j in range(len(features))) for c in range(k)
            )
            cands.append(Candidate(rows, tuple(float(x) for x in b)))
            owner.append(block)
    scored = candidate_recalls(score_candidates(df, features, cands, y, k), k, y)
    q_of = F.array(*[F.lit(q) for q, _ in owner])
    a_of = F.array(*[F.lit(float(a)) for _, a in owner])
    named = scored.select(
        q_of[F.col("cand")].alias("q"), a_of[F.col("cand")].alias("alpha"), "balanced_accuracy"
    )
    return named.groupBy("q", "alpha").agg(F.max("balanced_accuracy").alias("balanced_accuracy"))
