"""Ensemble searches over the derived predictions."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import functions as F

from sparktab.operators import ensemble as N
from sparktab.operators import search as H
from sparktab.operators.joins import model_columns
from sparktab.operators.ranks import exact_quantiles
from sparktab.session import materialize
from suite.common import MODELS, PREDS, argmax_sql, preds, query, r, rounded

NAMES = list(MODELS)
BIASES = [b for b in product((-0.2, 0.0, 0.2), repeat=3)]


def wide(spark, sf, models=tuple(MODELS)):
    return materialize(model_columns(preds(spark, sf), list(models), keep=["y", "fold"]), "wide")


def best(spark, sf):
    """Predictions of one model, written once because searches read them every generation."""
    return materialize(preds(spark, sf).where("model = 'm2'").select("id", "y", "fold", "p"), "best")


def _values(rows, names: str) -> str:
    body = ", ".join("(" + ", ".join(f"{x!r}e0" if isinstance(x, float) else str(x) for x in row) + ")" for row in rows)
    return f"cand({names}) AS (VALUES {body})"


_HITS = "h AS (SELECT cand, y, avg(CAST(pred = y AS INTEGER)) AS rec FROM s GROUP BY cand, y)"
_BIAS_S = "s AS (SELECT cand, y, " + argmax_sql(["ln(p0) + a", "ln(p1) + b", "ln(p2) + c"]) + " AS pred FROM preds, cand WHERE model = 'm2')"
_BIAS_ROWS = [(i, *b) for i, b in enumerate(BIASES)]


def _recalls() -> str:
    return ", ".join(r(f"max(CASE WHEN y = {c} THEN rec END)", f"recall_{c}") for c in range(3))


@query(
    "h1_score_candidates",
    f"WITH {PREDS}, {_values(_BIAS_ROWS, 'cand, a, b, c')}, {_BIAS_S}, {_HITS} "
    f"SELECT cand, {_recalls()}, {r('avg(rec)', 'balanced_accuracy')} FROM h GROUP BY cand",
)
def h1(spark, sf):
    cands = [H.rule_candidate("bias", b, 3) for b in BIASES]
    scored = H.score_candidates(best(spark, sf), H.log_features("p", 3), cands, "y", 3)
    return rounded(H.candidate_recalls(scored, 3, "y").drop("equal_recall"))


@query(
    "h1_score_candidates_by_fold",
    f"WITH {PREDS}, {_values(_BIAS_ROWS, 'cand, a, b, c')}, "
    "s AS (SELECT cand, fold, y, " + argmax_sql(["ln(p0) + a", "ln(p1) + b", "ln(p2) + c"]) + " AS pred FROM preds, cand WHERE model = 'm2') "
    "SELECT cand, fold, y, count(*) AS n, CAST(sum(CAST(pred = y AS INTEGER)) AS BIGINT) AS hit FROM s GROUP BY ALL",
)
def h1_fold(spark, sf):
    """The array form, which larger batches use."""
    cands = [H.rule_candidate("bias", b, 3) for b in BIASES]
    return H.score_candidates(best(spark, sf), H.log_features("p", 3), cands, "y", 3, "fold", "arrays")


_GRID = H.simplex_grid(4, 6)
_PIV = "w AS (SELECT id, y, " + ", ".join(
    f"max(CASE WHEN model = '{m}' THEN p{c} END) AS {m}_{c}" for m in MODELS for c in range(3)) + " FROM preds GROUP BY id, y)"


def _mix(c: int) -> str:
    return "round(" + " + ".join(f"w{i} * {m}_{c}" for i, m in enumerate(MODELS)) + ", 12)"


@query(
    "h2_search_blend_weights",
    f"WITH {PREDS}, {_PIV}, {_values([(i, *g) for i, g in enumerate(_GRID)], 'cand, w0, w1, w2, w3')}, "
    f"s AS (SELECT cand, y, {argmax_sql([_mix(c) for c in range(3)])} AS pred FROM w, cand), {_HITS} "
    f"SELECT cand, {r('avg(rec)', 'balanced_accuracy', 4)} FROM h GROUP BY cand",
)
def h2_grid(spark, sf):
    """The first grid of the weight search: 84 points of the simplex in one job."""
    cands = [H.blend_candidate(g, 3) for g in _GRID]
    scored = H.score_candidates(wide(spark, sf), H.model_features(NAMES, 3), cands, "y", 3)
    return rounded(H.candidate_recalls(scored, 3, "y").select("cand", "balanced_accuracy"), 4)


@query("h2_search_blend_weights_refined")
def h2(spark, sf):
    """Search, then the blend with the weights found."""
    from sparktab.operators.metrics import evaluate

    weights, _ = H.search_blend_weights(wide(spark, sf), NAMES, "y", 3, 6, 3)
    mixed = N.blend(preds(spark, sf), dict(zip(NAMES, weights)), 3)
    return rounded(evaluate(mixed, "y", "p", 3))


_TEMPS = [(i, t, b) for i, (t, b) in enumerate(product((0.5, 1.0, 2.0), (-0.3, 0.0, 0.3)))]
_SCALES = [(i, a, b) for i, (a, b) in enumerate(product((0.5, 1.0, 1.5), (-0.2, 0.0, 0.2)))]


@query(
    "h3_search_rules",
    f"WITH {PREDS}, {_values(_TEMPS, 'cand, t, b')}, sc AS (SELECT * FROM (VALUES {', '.join(f'({i}, {a!r}e0, {b!r}e0)' for i, a, b in _SCALES)}) AS v(cand, a, b)), "
    "s AS (SELECT 'temperature' AS rule, cand, y, " + argmax_sql(["round(ln(p0) / t + b, 9)", "round(ln(p1) / t, 9)", "round(ln(p2) / t, 9)"]) + " AS pred FROM preds, cand WHERE model = 'm2' "
    "UNION ALL SELECT 'scale_shift', cand, y, " + argmax_sql(["round(ln(p0) * a, 9)", "round(ln(p1) + b, 9)", "round(ln(p2), 9)"]) + " FROM preds, sc WHERE model = 'm2'), "
    "h AS (SELECT rule, cand, y, avg(CAST(pred = y AS INTEGER)) AS rec FROM s GROUP BY ALL) "
    f"SELECT rule, cand, {r('avg(rec)', 'balanced_accuracy', 3)} FROM h GROUP BY rule, cand",
)
def h3_grid(spark, sf):
    temps = [H.rule_candidate("temperature", [t, b, 0.0, 0.0], 3) for _, t, b in _TEMPS]
    scales = [H.rule_candidate("scale_shift", [a, 1.0, 1.0, 0.0, b, 0.0], 3) for _, a, b in _SCALES]
    scored = H.score_candidates(best(spark, sf), H.log_features("p", 3), temps + scales, "y", 3)
    out = H.candidate_recalls(scored, 3, "y")
    second = F.col("cand") >= len(temps)
    return rounded(out.select(
        F.when(second, "scale_shift").otherwise("temperature").alias("rule"),
        F.when(second, F.col("cand") - len(temps)).otherwise(F.col("cand")).alias("cand"),
        "balanced_accuracy"), 3)


def _searched(spark, df, rules, **options):
    """Each searched rule applied to all rows and scored."""
    from sparktab.functions.proba import apply_rule
    from sparktab.operators.metrics import score_labels

    out = None
    for rule in rules:
        params, _ = H.search_rule(df, "p", "y", 3, rule, **options)
        scored = score_labels(df.withColumn("pred", apply_rule("p", 3, rule, params)), "y", "pred", 3)
        row = scored.select(F.lit(rule).alias("rule"), "balanced_accuracy", "recall_0", "recall_1", "recall_2")
        out = row if out is None else out.unionByName(row)
    return rounded(out)


@query("h3_search_rules_evolved")
def h3(spark, sf):
    return _searched(spark, best(spark, sf), ["bias", "scale_shift", "temperature"], generations=3, population=16)


@query(
    "h4_search_equal_recall",
    f"WITH {PREDS}, {_values(_BIAS_ROWS, 'cand, a, b, c')}, {_BIAS_S}, {_HITS} "
    f"SELECT cand, {r('min(rec) + 1e-4 * avg(rec)', 'equal_recall')} FROM h GROUP BY cand",
)
def h4_grid(spark, sf):
    cands = [H.rule_candidate("equal_recall", b, 3) for b in BIASES]
    scored = H.score_candidates(best(spark, sf), H.log_features("p", 3), cands, "y", 3)
    return rounded(H.candidate_recalls(scored, 3, "y").select("cand", "equal_recall"))


@query("h4_search_equal_recall_evolved")
def h4(spark, sf):
    return _searched(spark, best(spark, sf), ["equal_recall"], generations=3, population=16)


_STEP = [(i, 1 + (i == 0), int(i == 1), int(i == 2), int(i == 3)) for i in range(4)]


@query(
    "h5_hill_climb_step",
    f"WITH {PREDS}, {_PIV}, cand(cand, w0, w1, w2, w3) AS (VALUES {', '.join(map(str, _STEP))}), "
    f"s AS (SELECT cand, y, {argmax_sql([_mix(c) for c in range(3)])} AS pred FROM w, cand), {_HITS} "
    f"SELECT cand, {r('avg(rec)', 'balanced_accuracy', 4)} FROM h GROUP BY cand",
)
def h5_step(spark, sf):
    """One step: every model added to the counts (1, 0, 0, 0)."""
    cands = [H.blend_candidate(s[1:], 3) for s in _STEP]
    scored = H.score_candidates(wide(spark, sf), H.model_features(NAMES, 3), cands, "y", 3)
    return rounded(H.candidate_recalls(scored, 3, "y").select("cand", "balanced_accuracy"), 4)


def _weights(spark, rows):
    return rounded(spark.createDataFrame(rows, "kind string, model string, weight double, score double"))


def _climb_sql(steps: int) -> str:
    """The greedy selection unrolled; a step without a gain repeats the state."""
    out = [f"WITH {PREDS}, {_PIV}, b0 AS (SELECT 0 AS c0, 0 AS c1, 0 AS c2, 0 AS c3, -1e0 AS score)"]
    for t in range(1, steps + 1):
        grown = ", ".join(f"c{i} + CAST(m = {i} AS INTEGER) AS c{i}" for i in range(4))
        mix = [
            "round((" + " + ".join(f"c{i} * {m}_{c}" for i, m in enumerate(MODELS)) + ") / (c0 + c1 + c2 + c3), 12)"
            for c in range(3)
        ]
        out.append(
            f"t{t} AS (SELECT m, {grown}, score AS old FROM b{t - 1}, (VALUES (0), (1), (2), (3)) AS v(m)), "
            f"s{t} AS (SELECT m, c0, c1, c2, c3, old, y, avg(CAST({argmax_sql(mix)} = y AS INTEGER)) AS rec FROM w, t{t} GROUP BY ALL), "
            f"r{t} AS (SELECT m, c0, c1, c2, c3, old, round(avg(rec), 12) AS score FROM s{t} GROUP BY ALL), "
            f"g{t} AS (SELECT * FROM r{t} WHERE score > old ORDER BY score DESC, m LIMIT 1), "
            f"b{t} AS (SELECT c0, c1, c2, c3, score FROM g{t} UNION ALL SELECT * FROM b{t - 1} WHERE NOT EXISTS (SELECT * FROM g{t}))"
        )
    last = " UNION ALL ".join(
        f"SELECT 'hill' AS kind, '{m}' AS model, {r(f'c{i} / (c0 + c1 + c2 + c3)', 'weight')}, {r('score', 'score', 4)} FROM b{steps}"
        for i, m in enumerate(MODELS))
    return ", ".join(out) + " " + last


@query("h5_hill_climb", _climb_sql(5))
def h5(spark, sf):
    weights, score = H.hill_climb(wide(spark, sf), NAMES, "y", 3, 5)
    score = math.floor(score * 1e4 + 0.5) / 1e4
    return _weights(spark, [("hill", m, float(w), score) for m, w in zip(NAMES, weights)])


def _climbs_sql(lists, steps: int, views: str) -> str:
    """Greedy selections unrolled, one row of state for each (view, bag).

    ``views`` selects the groups to leave out; ``lists`` holds the model positions of each bag.
    """
    allowed = [(b, m, at) for b, lst in enumerate(lists) for at, m in enumerate(dict.fromkeys(lst))]
    state = "view, bag, c0, c1, c2, c3"
    mix = ["round((" + " + ".join(f"c{i} * {m}_{c}" for i, m in enumerate(MODELS)) + ") / (c0 + c1 + c2 + c3), 12)" for c in range(3)]
    out = [
        f"WITH {PREDS}, " + _PIV.replace("id, y", "id, y, fold"), f"vw AS ({views})",
        f"al(bag, m, pos) AS (VALUES {', '.join(map(str, allowed))})",
        "b0 AS (SELECT DISTINCT view, bag, 0 AS c0, 0 AS c1, 0 AS c2, 0 AS c3, -1e0 AS score, TRUE AS on_ FROM vw, al)",
    ]
    for t in range(1, steps + 1):
        grown = ", ".join(f"c{i} + CAST(m = {i} AS INTEGER) AS c{i}" for i in range(4))
        out.append(
            f"t{t} AS MATERIALIZED (SELECT view, bag, pos, {grown}, score AS old FROM b{t - 1} JOIN al USING (bag) WHERE on_), "
            f"s{t} AS (SELECT {state}, pos, old, y, avg(CAST({argmax_sql(mix)} = y AS INTEGER)) AS rec FROM w, t{t} WHERE view = '' OR CAST(fold AS VARCHAR) <> view GROUP BY ALL), "
            f"r{t} AS (SELECT {state}, pos, old, round(avg(rec), 12) AS score FROM s{t} GROUP BY ALL), "
            f"g{t} AS MATERIALIZED (SELECT * FROM r{t} WHERE score > old QUALIFY row_number() OVER (PARTITION BY view, bag ORDER BY score DESC, pos) = 1), "
            f"b{t} AS MATERIALIZED (SELECT {state}, score, TRUE AS on_ FROM g{t} UNION ALL SELECT {state}, score, FALSE FROM b{t - 1} ANTI JOIN g{t} USING (view, bag))"
        )
    size = "sum(c0 + c1 + c2 + c3)"
    out.append(f"ws AS MATERIALIZED (SELECT view, {', '.join(f'sum(c{i}) / {size} AS w{i}' for i in range(4))} FROM b{steps} GROUP BY view)")
    return ", ".join(out)


def _by_model(view: str, score: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {view} AS kind, '{m}' AS model, {r(f'w{i}', 'weight')}, {r(score, 'score')} FROM ws" for i, m in enumerate(MODELS))


@query("h6_bagged_climb")
def h6(spark, sf):
    from sparktab.operators.metrics import evaluate

    weights = H.bagged_climb(wide(spark, sf), NAMES, "y", 3, 5, 8)
    mixed = N.blend(preds(spark, sf), dict(zip(NAMES, weights)), 3)
    return rounded(evaluate(mixed, "y", "p", 3))


@query("h6_bagged_weights", _climbs_sql(H.bag_lists(4, 20, 42), 30, "SELECT '' AS view") + " " + _by_model("'bags'", "0e0"))
def h6_weights(spark, sf):
    """The weights of twenty bags of up to thirty steps."""
    weights = H.bagged_climb(wide(spark, sf), NAMES, "y", 3)
    return _weights(spark, [("bags", m, float(w), 0.0) for m, w in zip(NAMES, weights)])


_WMIX = ["round(" + " + ".join(f"w{i} * {m}_{c}" for i, m in enumerate(MODELS)) + ", 12)" for c in range(3)]


@query(
    "h7_nested_climb",
    _climbs_sql(H.bag_lists(4, 3, 42), 6, "SELECT '' AS view UNION SELECT CAST(fold AS VARCHAR) FROM preds")
    + f", e AS (SELECT view, y, avg(CAST({argmax_sql(_WMIX)} = y AS INTEGER)) AS rec FROM w, ws WHERE view = '' OR CAST(fold AS VARCHAR) = view GROUP BY ALL), "
    "f AS (SELECT view, avg(rec) AS ba FROM e GROUP BY view), "
    "two AS (SELECT max(CASE WHEN view = '' THEN ba END) AS naive, avg(CASE WHEN view <> '' THEN ba END) AS nested FROM f) "
    + _by_model("CASE WHEN view = '' THEN 'None' ELSE view END", "CASE WHEN view = '' THEN (SELECT naive FROM two) ELSE (SELECT nested FROM two) END"),
)
def h7(spark, sf):
    weights, nested, naive = H.nested_climb(wide(spark, sf), NAMES, "y", 3, "fold", 3, 6)
    rows = [(str(v), m, float(w), naive if v is None else nested) for v, ws in weights.items() for m, w in zip(NAMES, ws)]
    return _weights(spark, rows)


@query("h8_compare_rules")
def h8(spark, sf):
    table = H.compare_rules(best(spark, sf), "p", "y", 3, ["bias", "temperature"], generations=2, population=12)
    return rounded(spark.createDataFrame(table))


_U = "floor((var_pop(p0) + var_pop(p1) + var_pop(p2)) / 3 * 1e9)"
_PATCH = [(i, q, a) for i, (q, a) in enumerate(product((0.5, 0.8), (0.25, 0.5)))]
_PB = [(0.0, 0.0, 0.0), (0.1, 0.0, -0.1), (-0.1, 0.1, 0.0)]


def _patched(c: int) -> str:
    return f"round(ln(CASE WHEN u >= cut THEN (1 - alpha) * p{c} + alpha * a{c} ELSE p{c} END) + b{c}, 9)"


@query(
    "h10_grid_patch",
    f"WITH {PREDS}, m AS (SELECT id, {_U} AS u, avg(p0) AS a0, avg(p1) AS a1, avg(p2) AS a2 FROM preds GROUP BY id), "
    f"g(i, q, alpha) AS (VALUES {', '.join(f'({i}, {q!r}e0, {a!r}e0)' for i, q, a in _PATCH)}), "
    "cut AS (SELECT q, quantile_cont(u, 5e-1) AS cut FROM m, (SELECT 5e-1 AS q) GROUP BY q UNION ALL SELECT 8e-1, quantile_cont(u, 8e-1) FROM m), "
    f"b(j, b0, b1, b2) AS (VALUES {', '.join('(' + ', '.join([str(j), *[f'{x!r}e0' for x in b]]) + ')' for j, b in enumerate(_PB))}), "
    f"s AS (SELECT i, q, alpha, j, y, {argmax_sql([_patched(c) for c in range(3)])} AS pred FROM preds JOIN m USING (id), g JOIN cut USING (q), b WHERE model = 'm2'), "
    "h AS (SELECT q, alpha, j, y, avg(CAST(pred = y AS INTEGER)) AS rec FROM s GROUP BY ALL), t AS (SELECT q, alpha, j, avg(rec) AS ba FROM h GROUP BY ALL) "
    f"SELECT q, alpha, {r('max(ba)', 'balanced_accuracy', 4)} FROM t GROUP BY q, alpha",
)
def h10(spark, sf):
    p = preds(spark, sf)
    u = N.disagreement(p, 3).withColumn("u", F.floor(F.col("u") * 1e9).cast("double"))
    mean = N.average(p, 3, by=["id"], keep=[]).withColumnRenamed("p", "fallback")
    rows = best(spark, sf).join(u, "id").join(mean, "id")
    qs = [0.5, 0.8]
    cuts = dict(zip(qs, exact_quantiles(u, ["u"], qs)["u"]))
    return rounded(H.grid_patch(rows, 3, cuts, [0.25, 0.5], _PB, "y"), 4)
