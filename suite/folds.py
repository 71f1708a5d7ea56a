"""Folds, samples and the flagship query."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from sparktab.functions.proba import argmax
from sparktab.operators import encoders, folds, metrics
from sparktab.session import materialize
from suite.common import PHOTO, PREDS, argmax_sql, photo, preds, query, r, rounded, rs, spread, table

EVENT_CLASSES = ["click", "error", "purchase", "signup", "view"]
_CODE = "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"


def coded_events(spark, sf):
    y = F.lit(4)
    for i, c in enumerate(EVENT_CLASSES[:4]):
        y = F.when(F.col("event_type") == c, i).otherwise(y)
    return table(spark, sf, "events").withColumn("y", y)


def _folds_sql(seed: int, k: int, src: str, key: str, y: str, name: str = "fold") -> str:
    return (
        f"CAST((row_number() OVER (PARTITION BY {y} ORDER BY md5('{seed}:' || {key}), {key}) - 1)"
        f" % {k} AS INTEGER) AS {name}"
    )


_FLAG_SUMS = ", ".join(f"sum(CASE WHEN y = {c} THEN 1e0 ELSE 0e0 END) AS s{c}" for c in range(5))
_FLAG_ENC = ", ".join(
    f"(t.s{c} - f.s{c} + 16e0 * g.g{c}) / (t.n - f.n + 16e0) AS p{c}" for c in range(5)
)
_FLAG_PRIOR = ", ".join(f"avg(CASE WHEN y = {c} THEN 1e0 ELSE 0e0 END) AS g{c}" for c in range(5))


@query(
    "flagship_oof_encoding_report",
    f"""WITH ev AS (SELECT event_id, user_id, {_CODE} AS y FROM events),
    fo AS (SELECT *, {_folds_sql(42, 5, 'ev', 'event_id', 'y')} FROM ev),
    f AS (SELECT user_id, fold, count(*) AS n, {_FLAG_SUMS} FROM fo GROUP BY ALL),
    t AS (SELECT user_id, sum(n) AS n, {', '.join(f'sum(s{c}) AS s{c}' for c in range(5))} FROM f GROUP BY ALL),
    g AS (SELECT {_FLAG_PRIOR} FROM fo),
    e AS (SELECT fo.event_id, fo.fold, fo.y, {_FLAG_ENC}
      FROM fo JOIN f USING (user_id, fold) JOIN t USING (user_id), g),
    s AS (SELECT fold, y, {argmax_sql([f'round(p{c}, 9)' for c in range(5)])} AS pred FROM e),
    c AS (SELECT fold, y, count(*) AS n, sum(CASE WHEN y = pred THEN 1 ELSE 0 END) AS hit
      FROM s GROUP BY ALL)
    SELECT fold, {r('avg(hit / n)', 'balanced_accuracy')}, {r('sum(hit) / sum(n)', 'accuracy')},
      CAST(sum(n) AS BIGINT) AS "rows" FROM c GROUP BY fold""",
)
def flagship(spark, sf):
    ev = coded_events(spark, sf).select("event_id", "user_id", "y")
    folded = materialize(folds.stratified_folds(ev, "event_id", "y", 5, 42), "folds")
    encoded, _ = encoders.fold_safe_encode(folded, ["user_id"], "y", 5, "fold", 16.0)
    p = F.array(*[F.round(f"TE_user_id_{c}", 9) for c in range(5)])
    scored = encoded.withColumn("pred", argmax(p, 5))
    report = metrics.score_labels(scored, "y", "pred", 5, by=["fold"])
    return rounded(report.select("fold", "balanced_accuracy", "accuracy", "rows"))


@query(
    "f1_stratified_folds",
    f"SELECT event_id, event_type, {_folds_sql(42, 5, 'events', 'event_id', 'event_type')} FROM events",
)
def f1(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type")
    return folds.stratified_folds(ev, "event_id", "event_type", 5, 42)


@query(
    "f2_inner_folds",
    f"""WITH fo AS (SELECT event_id, event_type,
      {_folds_sql(42, 3, 'events', 'event_id', 'event_type')} FROM events),
    sp AS (SELECT fo.*, o.o AS "outer" FROM fo, (VALUES (0), (1), (2)) AS o(o) WHERE fo.fold <> o.o)
    SELECT event_id, event_type, fold, "outer",
      CAST((row_number() OVER (PARTITION BY "outer", event_type ORDER BY md5('219:' || event_id), event_id) - 1)
        % 7 AS INTEGER) AS "inner" FROM sp""",
)
def f2(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type")
    folded = folds.stratified_folds(ev, "event_id", "event_type", 3, 42)
    return folds.inner_folds(folded, "event_id", "event_type", "fold", 3, 7, 219)


_HASH8 = "CAST(('0x' || substr(md5('{seed}:' || {key}), 1, 8)) AS BIGINT)"


@query(
    "f3_kfold_group_time",
    f"""SELECT event_id, CAST({_HASH8.format(seed=7, key='event_id')} % 5 AS INTEGER) AS fold,
      CAST({_HASH8.format(seed=7, key='user_id')} % 5 AS INTEGER) AS group_fold,
      CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN 'train' ELSE 'valid' END AS split
    FROM events""",
)
def f3(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts")
    out = folds.group_kfold(folds.kfold(ev, "event_id", 5, 7), "user_id", 5, 7, "group_fold")
    return folds.time_split(out, "ts", "2024-01-15 00:00:00").drop("user_id", "ts")


@query(
    "f4_stratified_sample",
    """WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL),
    k AS (SELECT o_orderkey, o_orderpriority,
      row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('5:' || o_orderkey), o_orderkey) AS k
      FROM orders)
    SELECT o_orderkey, o_orderpriority FROM k JOIN c USING (o_orderpriority)
    WHERE k <= least(greatest(CAST(round_even(1000e0 * n / (SELECT count(*) FROM orders), 0) AS BIGINT), 1), n)""",
)
def f4(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return folds.stratified_sample(o, "o_orderkey", "o_orderpriority", 1000, 5)


@query(
    "f5_balanced_sample",
    """SELECT o_orderkey, o_orderstatus, fold FROM (
      SELECT o_orderkey, o_orderstatus, CAST(o_orderkey % 4 AS INTEGER) AS fold,
        row_number() OVER (PARTITION BY o_orderkey % 4, o_orderstatus
          ORDER BY md5('9:' || o_orderkey), o_orderkey) AS k FROM orders) WHERE k <= 150""",
)
def f5(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", (F.col("o_orderkey") % 4).cast("int").alias("fold")
    )
    return folds.balanced_sample(o, "o_orderkey", "o_orderstatus", 150, 9, by=["fold"])


@query(
    "f6_fit_pool",
    f"""WITH {PHOTO}, tr AS (
      SELECT id, y, 'train' AS source, CAST(id % 5 AS INTEGER) AS fold FROM photo WHERE source = 'train'),
    pool AS (SELECT id, y, source FROM tr WHERE fold <> 2
      UNION ALL SELECT id, y, 'pseudo' FROM photo WHERE source = 'test' AND id % 3 = 0
      UNION ALL SELECT id, y, 'aux' FROM photo WHERE source = 'aux'),
    n AS (SELECT y, count(*) AS c FROM pool GROUP BY y)
    SELECT source, y, count(*) AS "rows", {r('sum(w)', 'weight', 4)} FROM (
      SELECT source, pool.y, (SELECT count(*) FROM pool) / (3e0 * c)
        * CASE source WHEN 'aux' THEN 3e-1 WHEN 'pseudo' THEN 1e-1 ELSE 1e0 END AS w
      FROM pool JOIN n USING (y)) GROUP BY source, y""",
)
def f6(spark, sf):
    ph = photo(spark, sf).select("id", "y", "source")
    train = ph.where("source = 'train'").withColumn("fold", (F.col("id") % 5).cast("int"))
    pool = folds.fit_pool(
        train, 2, "y",
        aux=ph.where("source = 'aux'"), aux_weight=0.3,
        pseudo=ph.where("source = 'test' AND id % 3 = 0"), pseudo_weight=0.1,
    )
    out = pool.groupBy("source", "y").agg(F.count(F.lit(1)).alias("rows"), F.sum("w").alias("weight"))
    return rounded(out, 4)


@query(
    "f7_confident_rows",
    f"""WITH {PREDS}, t AS (SELECT id, fold, greatest(p0, p1, p2) AS conf,
      {argmax_sql(['p0', 'p1', 'p2'])} AS label FROM preds WHERE model = 'm2'),
    k AS (SELECT *, row_number() OVER (PARTITION BY fold
      ORDER BY conf DESC, md5('0:' || id), id) AS k FROM t WHERE conf >= 6e-1)
    SELECT id, fold, label, {r('conf')} FROM k WHERE k <= 200""",
)
def f7(spark, sf):
    p = preds(spark, sf).where("model = 'm2'")
    top = folds.confident_rows(p, "id", "p", 3, 0.6, 200, by=["fold"])
    return rounded(top.select("id", "fold", "label", "conf"))


def _bags(models, bags: int, seed: int):
    rng = random.Random(seed)
    return [(b, s, rng.choice(models)) for b in range(bags) for s in range(len(models))]


@query(
    "f8_bootstrap_members",
    f"""WITH {PREDS}, lab AS (SELECT model, y, {argmax_sql(['p0', 'p1', 'p2'])} AS pred FROM preds),
    c AS (SELECT model, y, avg(CAST(pred = y AS INTEGER)) AS rec FROM lab GROUP BY ALL),
    m AS (SELECT model, avg(rec) AS ba FROM c GROUP BY model),
    b(bag, slot, model) AS (VALUES {', '.join(map(str, _bags(['m1', 'm2', 'm3', 'm4'], 5, 11)))})
    SELECT bag, count(*) AS slots, {r('avg(ba)', 'mean_score')} FROM b JOIN m USING (model) GROUP BY bag""",
)
def f8(spark, sf):
    """Score of every bag's mean vote: the bags are drawn by the operator."""
    models = ["m1", "m2", "m3", "m4"]
    bags = folds.bootstrap_members(spark, models, 5, 11)
    per_model = metrics.evaluate(preds(spark, sf), "y", "p", 3, by=["model"])
    return rounded(
        bags.join(per_model, "model").groupBy("bag").agg(
            F.count(F.lit(1)).alias("slots"), F.avg("balanced_accuracy").alias("mean_score")
        )
    )


_SWAP = """r{i} AS (SELECT id, {c}, row_number() OVER (ORDER BY md5('{s}:' || id), id) AS k FROM ph),
    d{i} AS (SELECT t.id, CASE WHEN CAST(('0x' || substr(md5('{s2}:' || t.id), 1, 7)) AS BIGINT) < {lim}
      THEN d.{c} ELSE t.{c} END AS {c} FROM r{i} t JOIN r{i} d
      ON d.k = CASE WHEN t.k = (SELECT count(*) FROM ph) THEN 1 ELSE t.k + 1 END)"""


@query(
    "f9_swap_noise",
    f"""WITH {PHOTO}, ph AS (SELECT id, u, redshift FROM photo),
    {_SWAP.format(i=0, c='u', s=3, s2=4, lim=int(0.15 * 16**7))},
    {_SWAP.format(i=1, c='redshift', s=5, s2=6, lim=int(0.15 * 16**7))}
    SELECT id, {rs(['u', 'redshift'])} FROM d0 JOIN d1 USING (id)""",
)
def f9(spark, sf):
    ph = photo(spark, sf).select("id", "u", "redshift")
    return rounded(folds.swap_noise(ph, "id", ["u", "redshift"], 0.15, 3))


def _swapped(i: int, c: str) -> str:
    draw = f"CAST(('0x' || substr(md5('{8 + i}:' || t.k), 1, 7)) AS BIGINT) < {int(0.3 * 16**7)}"
    return f"CASE WHEN {draw} THEN d{i}.{c} ELSE t.{c} END"


@query(
    "f9_swap_cells",
    f"""WITH {PHOTO}, k AS (SELECT id, u, redshift, spectral_type, row_number() OVER (ORDER BY md5('7:' || id), id) - 1 AS k, count(*) OVER () AS n FROM photo)
    SELECT t.id, {r(_swapped(0, 'u'), 'u')}, {r(_swapped(1, 'redshift'), 'redshift')}, {_swapped(2, "spectral_type")} AS spectral_type FROM k t
    JOIN k d0 ON d0.k = (t.k + 1 + 7000021 % (t.n - 1)) % t.n JOIN k d1 ON d1.k = (t.k + 1 + 7000022 % (t.n - 1)) % t.n
    JOIN k d2 ON d2.k = (t.k + 1 + 7000023 % (t.n - 1)) % t.n""",
)
def f9_cells(spark, sf):
    ph = photo(spark, sf).select("id", "u", "redshift", "spectral_type")
    return rounded(folds.swap_cells(ph, "id", ["u", "redshift", "spectral_type"], 0.3, 7))
