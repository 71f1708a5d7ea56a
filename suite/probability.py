"""Probability-vector functions and blends over the derived predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktab.functions import proba as V
from sparktab.operators import ensemble as N
from suite.common import PREDS, argmax_sql, preds, query, r, rounded, rs, spread

P = ["p0", "p1", "p2"]


def _clip(x: str, lo: str, hi: str | None) -> str:
    return f"least(greatest({x}, {lo}), {hi})" if hi else f"greatest({x}, {lo})"


_S = "(" + " + ".join(_clip(f"(p{i} - 25e-2)", "1e-7", "1e0") for i in range(3)) + ")"


@query(
    "v1_normalize_proba",
    f"WITH {PREDS} SELECT model, id, "
    + ", ".join(r(f"{_clip(f'(p{i} - 25e-2)', '1e-7', '1e0')} / {_S}", f"p{i}") for i in range(3)) + " FROM preds",
)
def v1(spark, sf):
    """Shifted below zero first, so that clipping matters."""
    p = preds(spark, sf).withColumn("p", F.array(*[F.col("p")[i] - 0.25 for i in range(3)]))
    out = p.select("model", "id", V.normalize_proba("p", 3, V.SAVE_BOUNDS).alias("p"))
    return rounded(spread(out))


@query("v2_log_proba", f"WITH {PREDS} SELECT model, id, " + ", ".join(
    r(f"ln({_clip(f'p{i}', '1e-15', '1e0 - 1e-15')})", f"p{i}") for i in range(3)) + " FROM preds")
def v2(spark, sf):
    return rounded(spread(preds(spark, sf).select("model", "id", V.log_proba("p", 3).alias("p"))))


def _logit(x: str) -> str:
    c = _clip(x, "1e-7", "1e0 - 1e-7")
    return f"least(greatest(ln({c} / (1 - {c})), -30e0), 30e0)"


@query("v3_logit", f"WITH {PREDS} SELECT model, id, " + ", ".join(
    r(_logit(f"p{i}"), f"p{i}") for i in range(3)) + " FROM preds")
def v3(spark, sf):
    return rounded(spread(preds(spark, sf).select("model", "id", V.logit("p", 3).alias("p"))))


@query(
    "v4_argmax",
    f"WITH {PREDS}, t AS (SELECT model, id, floor(p0 * 10) AS a, floor(p1 * 10) AS b, floor(p2 * 10) AS c FROM preds) "
    f"SELECT model, id, {argmax_sql(['a', 'b', 'c'])} AS pred FROM t",
)
def v4(spark, sf):
    """Coarse scores, so that ties are common."""
    t = preds(spark, sf).withColumn("t", F.array(*[F.floor(F.col("p")[i] * 10) for i in range(3)]))
    return t.select("model", "id", V.argmax("t", 3).alias("pred"))


_L = [f"ln({p})" for p in P]


@query(
    "v5_apply_rule",
    f"WITH {PREDS} SELECT model, id, "
    + argmax_sql([f"round({_L[0]} + 1e-1, 9)", f"round({_L[1]} - 2e-1, 9)", f"round({_L[2]} + 5e-2, 9)"]) + " AS bias, "
    + argmax_sql([f"round(12e-1 * {_L[0]} + 1e-1, 9)", f"round(9e-1 * {_L[1]} - 1e-1, 9)", f"round({_L[2]} + 0e0, 9)"]) + " AS scale_shift, "
    + argmax_sql([f"round({_L[0]} / 15e-1 + 2e-1, 9)", f"round({_L[1]} / 15e-1, 9)", f"round({_L[2]} / 15e-1 - 1e-1, 9)"])
    + " AS temperature FROM preds",
)
def v5(spark, sf):
    p = preds(spark, sf)
    return p.select(
        "model", "id",
        V.apply_rule("p", 3, "bias", [0.1, -0.2, 0.05]).alias("bias"),
        V.apply_rule("p", 3, "scale_shift", [1.2, 0.9, 1.0, 0.1, -0.1, 0.0]).alias("scale_shift"),
        V.apply_rule("p", 3, "temperature", [1.5, 0.2, 0.0, -0.1]).alias("temperature"),
    )


_W = {"m1": 0.5, "m2": 0.3, "m3": 0.2, "m4": 0.0}
_WSQL = "(VALUES ('m1', 5e-1), ('m2', 3e-1), ('m3', 2e-1), ('m4', 0e0)) AS w(model, w)"


@query(
    "v6_blend",
    f"WITH {PREDS}, b AS (SELECT id, y, {', '.join(f'greatest(sum(w * {p}) / sum(w), 1e-15) AS {p}' for p in P)} "
    f"FROM preds JOIN {_WSQL} USING (model) GROUP BY id, y) "
    f"SELECT id, y, {', '.join(r(f'{p} / (p0 + p1 + p2)', p) for p in P)} FROM b",
)
def v6(spark, sf):
    return rounded(spread(N.blend(preds(spark, sf), _W, 3)))


@query(
    "v6_blend_zero_weights",
    f"WITH {PREDS} SELECT id, y, {', '.join(r(f'avg({p})', p) for p in P)} FROM preds GROUP BY id, y",
)
def v6_zero(spark, sf):
    return rounded(spread(N.blend(preds(spark, sf), dict.fromkeys(_W, 0.0), 3)))


@query(
    "v7_average",
    f"WITH {PREDS} SELECT CASE WHEN model IN ('m1', 'm2') THEN 'a' ELSE 'b' END AS model, id, y, "
    f"{', '.join(r(f'avg({p})', p) for p in P)} FROM preds GROUP BY ALL",
)
def v7(spark, sf):
    """Two models stand for two seeds of one."""
    p = preds(spark, sf)
    family = F.when(F.col("model").isin("m1", "m2"), "a").otherwise("b")
    return rounded(spread(N.average(p.withColumn("model", family), 3)))


@query(
    "v8_ovr_combine",
    f"WITH {PREDS}, b AS (SELECT id, "
    + ", ".join(f"least(greatest(max(CASE WHEN model = 'm{i + 1}' THEN p{i} END), 1e-7), 1e0) AS q{i}" for i in range(3))
    + " FROM preds GROUP BY id) SELECT id, " + ", ".join(r(f"q{i} / (q0 + q1 + q2)", f"p{i}") for i in range(3)) + " FROM b",
)
def v8(spark, sf):
    """Model i+1 plays the binary model of class i."""
    cls = F.when(F.col("model") == "m1", 0).when(F.col("model") == "m2", 1).when(F.col("model") == "m3", 2)
    b = preds(spark, sf).withColumn("positive", cls).where("positive IS NOT NULL")
    b = b.select("id", "positive", F.element_at("p", F.col("positive") + 1).alias("p1"))
    return rounded(spread(N.combine_binary(b, 3)))


@query(
    "v9_cascade_compose",
    f"WITH {PREDS}, c AS (SELECT model, id, p0 AS q1, p1 / (p1 + p2) AS q2 FROM preds), "
    "d AS (SELECT model, id, least(greatest((1 - q1) * q2, 1e-7), 1e0) AS a, least(greatest(q1, 1e-7), 1e0) AS f, "
    "least(greatest((1 - q1) * (1 - q2), 1e-7), 1e0) AS b FROM c) "
    f"SELECT model, id, {r('a / (a + f + b)', 'p0')}, {r('f / (a + f + b)', 'p1')}, {r('b / (a + f + b)', 'p2')} FROM d",
)
def v9(spark, sf):
    q1, q2 = F.col("p")[0], F.col("p")[1] / (F.col("p")[1] + F.col("p")[2])
    p = preds(spark, sf).select("model", "id", V.cascade_compose(q1, q2, 1, 0, 2).alias("p"))
    return rounded(spread(p))


_U = "(var_pop(p0) + var_pop(p1) + var_pop(p2)) / 3"


@query("v10_disagreement", f"WITH {PREDS} SELECT id, {r(_U, 'u', 8)} FROM preds GROUP BY id")
def v10(spark, sf):
    return rounded(N.disagreement(preds(spark, sf), 3), 8)


@query(
    "v11_patch_tail",
    f"WITH {PREDS}, m AS (SELECT id, floor(({_U}) * 1e9) AS u, {', '.join(f'avg({p}) AS a{i}' for i, p in enumerate(P))} FROM preds GROUP BY id), "
    "q AS (SELECT quantile_cont(u, 9e-1) AS c FROM m) "
    f"SELECT id, {', '.join(r(f'CASE WHEN u >= c THEN 5e-1 * {p} + 5e-1 * a{i} ELSE {p} END', p) for i, p in enumerate(P))} "
    "FROM preds JOIN m USING (id), q WHERE model = 'm2'",
)
def v11(spark, sf):
    p = preds(spark, sf)
    u = N.disagreement(p, 3).withColumn("u", F.floor(F.col("u") * 1e9).cast("double"))
    mean = N.average(p, 3, by=["id"], keep=[]).withColumnRenamed("p", "fallback")
    best = p.where("model = 'm2'").select("id", "p").join(u, "id").join(mean, "id")
    return rounded(spread(N.patch_tail(best, 3, 0.9, 0.5).select("id", "p")))
