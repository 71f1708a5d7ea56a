"""Join and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktab.functions.proba import argmax_of, parts
from sparktab.operators import joins as J
from sparktab.operators.groupstats import class_prototypes
from suite.common import MODELS, PHOTO, PREDS, argmax_sql, photo, preds, query, r, rounded, spread, table
from suite.metrics import labelled


@query(
    "j1_lookup",
    f"""WITH s AS (SELECT l_suppkey, avg(l_extendedprice) AS a, count(*) AS n FROM lineitem WHERE l_suppkey % 7 <> 0 GROUP BY 1)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {r('coalesce(a, -1e0)', 'mean_price', 4)}, coalesce(n, 0) AS n
    FROM lineitem LEFT JOIN s USING (l_suppkey)""",
)
def j1(spark, sf):
    """Salted form: every key is spread over four tasks."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    stats = li.where("l_suppkey % 7 <> 0").groupBy("l_suppkey").agg(
        F.avg("l_extendedprice").alias("mean_price"), F.count(F.lit(1)).alias("n"))
    out = J.lookup(li, stats, "l_suppkey", {"mean_price": -1.0, "n": 0}, salts=4)
    return rounded(out.drop("l_extendedprice"), 4)


@query(
    "j2_predictions_by_model",
    f"WITH {PREDS} SELECT id, " + ", ".join(
        r(f"max(CASE WHEN model = '{m}' THEN p{c} END)", f"{m}_p{c}") for m in MODELS for c in range(3))
    + " FROM preds GROUP BY id HAVING count(*) = 4",
)
def j2(spark, sf):
    wide = J.predictions_by_model(preds(spark, sf))
    return rounded(wide.select(
        "id", *[F.col("models")[m][c].alias(f"{m}_p{c}") for m in MODELS for c in range(3)]))


@query(
    "j2_model_columns",
    f"WITH {PREDS} SELECT id, y, " + ", ".join(
        r(f"max(CASE WHEN model = '{m}' THEN p{c} END)", f"{m}_p{c}") for m in ("m1", "m3") for c in range(3))
    + " FROM preds GROUP BY id, y",
)
def j2_columns(spark, sf):
    wide = J.model_columns(preds(spark, sf), ["m1", "m3"])
    return rounded(wide.select("id", "y", *[F.col(m)[c].alias(f"{m}_p{c}") for m in ("m1", "m3") for c in range(3)]))


@query(
    "j3_attach_pseudo",
    f"""WITH {PHOTO} SELECT id, {r('redshift')}, CASE id % 3 WHEN 0 THEN 'GALAXY' WHEN 1 THEN 'QSO' ELSE 'STAR' END AS label
    FROM photo WHERE source = 'test' AND id % 4 = 2""",
)
def j3(spark, sf):
    ph = photo(spark, sf)
    label = F.when(F.col("id") % 3 == 0, "GALAXY").when(F.col("id") % 3 == 1, "QSO").otherwise("STAR")
    pseudo = ph.where("id % 4 = 2").select("id", label.alias("label"))
    return rounded(J.attach_pseudo(ph.where("source = 'test'").select("id", "redshift"), pseudo))


@query(
    "j4_carry_over",
    f"WITH {PREDS} SELECT model, fold, id, {r('CASE WHEN model IN (' + chr(39) + 'm1' + chr(39) + ', ' + chr(39) + 'm2' + chr(39) + ') THEN p1 ELSE p0 END', 'v')} FROM preds",
)
def j4(spark, sf):
    p = preds(spark, sf)
    new = p.where("model IN ('m1', 'm2')").select("model", "fold", "id", F.col("p")[1].alias("v"))
    old = p.select("model", "fold", "id", F.col("p")[0].alias("v"))
    return rounded(J.carry_over(new, old))


_CAND = [(0.0, 0.0, 0.0), (0.3, 0.0, -0.1), (-0.2, 0.1, 0.25)]


@query(
    "j5_rows_by_candidates",
    f"""WITH {PREDS}, c(i, a, b, d) AS (VALUES (0, 0e0, 0e0, 0e0), (1, 3e-1, 0e0, -1e-1), (2, -2e-1, 1e-1, 25e-2)),
    h AS (SELECT model, y, i, CAST({argmax_sql(['round(ln(p0) + a, 9)', 'round(ln(p1) + b, 9)', 'round(ln(p2) + d, 9)'])} = y AS INTEGER) AS hit FROM preds, c)
    SELECT model, y, count(*) // 3 AS n, {', '.join(f'CAST(sum(CASE WHEN i = {i} THEN hit END) AS BIGINT) AS hit_{i}' for i in range(3))} FROM h GROUP BY model, y""",
)
def j5(spark, sf):
    p = preds(spark, sf)
    logs = [F.ln(c) for c in parts("p", 3)]
    exprs = {
        f"hit_{i}": (argmax_of([F.round(lp + F.lit(b), 9) for lp, b in zip(logs, cand)]) == F.col("y")).cast("long")
        for i, cand in enumerate(_CAND)
    }
    return J.score_against_candidates(p, exprs, ["model", "y"])


_PC = ["u", "g", "redshift"]
_Z = ", ".join(f"(({c} - m_{c}) / s_{c}) AS z_{c}" for c in _PC)


@query(
    "j6_rows_by_prototypes",
    f"""WITH {PHOTO}, st AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _PC)} FROM photo),
    z AS (SELECT id, y, source, {_Z} FROM photo, st),
    p AS (SELECT y AS k, {', '.join(f'avg(z_{c}) AS c_{c}, stddev_pop(z_{c}) + 5e-2 AS w_{c}' for c in _PC)} FROM z WHERE source = 'aux' GROUP BY y),
    d AS (SELECT id, k, sqrt(({' + '.join(f'pow(z_{c} - c_{c}, 2)' for c in _PC)}) / 3) AS e,
      sqrt(({' + '.join(f'pow((z_{c} - c_{c}) / w_{c}, 2)' for c in _PC)}) / 3) AS g FROM z, p WHERE source <> 'aux')
    SELECT id, {', '.join(r(f'max(CASE WHEN k = {k} THEN e END)', f'proto_euclid_{k}') for k in range(3))},
      {r('min(g)', 'proto_diag_min')} FROM d GROUP BY id""",
)
def j6(spark, sf):
    ph = photo(spark, sf).select("id", "y", "source", *_PC)
    out = class_prototypes(ph.where("source = 'aux'"), ph.where("source <> 'aux'"), _PC, "y", 3)
    return rounded(out.select("id", *[f"proto_euclid_{k}" for k in range(3)], "proto_diag_min"))


@query(
    "j7_stack_sources",
    f"""WITH {PHOTO} SELECT source, count(*) AS n, count(class) AS labelled, count(spectral_type) AS typed FROM (
      SELECT source, class, spectral_type FROM photo WHERE source = 'train'
      UNION ALL SELECT source, NULL, spectral_type FROM photo WHERE source = 'test'
      UNION ALL SELECT source, class, NULL FROM photo WHERE source = 'aux') GROUP BY source""",
)
def j7(spark, sf):
    ph = photo(spark, sf).select("id", "class", "spectral_type", "source")
    part = {s: ph.where(F.col("source") == s).drop("source") for s in ("train", "test", "aux")}
    both = J.stack_sources(
        {"train": part["train"], "test": part["test"].drop("class"), "aux": part["aux"].drop("spectral_type")}
    )
    return both.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count("class").alias("labelled"), F.count("spectral_type").alias("typed"))


@query(
    "j8_overlap",
    """SELECT user_id, event_type FROM events WHERE event_id % 2 = 0 INTERSECT
    SELECT user_id, event_type FROM events WHERE event_id % 9 = 1""",
)
def j8(spark, sf):
    ev = table(spark, sf, "events")
    return J.overlap(ev.where("event_id % 2 = 0"), ev.where("event_id % 9 = 1"), ["user_id", "event_type"])


@query(
    "j8_only_in",
    """SELECT user_id, event_type FROM events WHERE event_id % 2 = 0 EXCEPT ALL
    SELECT user_id, event_type FROM events WHERE event_id % 3 = 1""",
)
def j8_only(spark, sf):
    ev = table(spark, sf, "events")
    return J.only_in(ev.where("event_id % 2 = 0"), ev.where("event_id % 3 = 1"), ["user_id", "event_type"])


@query(
    "j8_label_changes",
    f"""WITH {PREDS}, lab AS (SELECT model, id, {argmax_sql(['p0', 'p1', 'p2'])} AS pred FROM preds)
    SELECT a.id, a.pred AS label_a, b.pred AS label_b FROM lab a JOIN lab b ON a.id = b.id
    WHERE a.model = 'm3' AND b.model = 'm4' AND a.pred <> b.pred""",
)
def j8_labels(spark, sf):
    lab = labelled(spark, sf)
    return J.label_changes(lab.where("model = 'm3'"), lab.where("model = 'm4'"), "id", "pred")
