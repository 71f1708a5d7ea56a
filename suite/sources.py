"""Readers, writers and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktab.session import scratch_path
from sparktab.sources import predictions as P
from sparktab.sources import records as R
from sparktab.sources import tables as T
from suite.common import BANDS, CLASSES, PHOTO, PREDS, RAW, argmax_sql, photo, preds, query, r, rounded, rs, spread, table

ROLES = T.Roles("id", "class", tuple(RAW), tuple(BANDS), ("spectral_type", "galaxy_population"), tuple(CLASSES))
_COLS = ["id", *RAW, "spectral_type", "galaxy_population", "class"]


@query("s1_read_table", f"WITH {PHOTO} SELECT id, {rs(RAW)}, spectral_type, galaxy_population, class FROM photo")
def s1(spark, sf):
    """Write the labelled table as CSV, read it back with the roles' schema."""
    path = scratch_path(spark, "train.csv")
    photo(spark, sf).select(*_COLS).write.option("header", True).csv(path)
    return rounded(T.read_table(spark, path, ROLES.schema()))


@query(
    "s2_coerce_numeric",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1, 2) THEN NULL ELSE o_totalprice END AS v FROM orders""",
)
def s2(spark, sf):
    k = F.col("o_orderkey") % 5
    text = (F.when(k == 0, "n/a").when(k == 1, "NaN").when(k == 2, "-Infinity")
            .otherwise(F.col("o_totalprice").cast("string")))
    return T.coerce_numeric(table(spark, sf, "orders").select("o_orderkey", text.alias("v")), ["v"])


@query(
    "s3_normalize_category",
    f"WITH {PHOTO} SELECT id, coalesce(spectral_type, '__NA__') AS spectral_type, coalesce(galaxy_population, '__NA__') AS galaxy_population FROM photo",
)
def s3(spark, sf):
    cats = ["spectral_type", "galaxy_population"]
    return T.normalize_category(photo(spark, sf).select("id", *cats), cats)


@query(
    "s4_filter_classes",
    "SELECT event_id, upper(event_type) AS event_type FROM events WHERE upper(event_type) IN ('CLICK', 'VIEW')",
)
def s4(spark, sf):
    return T.filter_classes(table(spark, sf, "events").select("event_id", "event_type"), "event_type", ["CLICK", "VIEW"])


_SENT = "CASE WHEN id % 17 = 0 THEN -9999e0 WHEN id % 19 = 0 THEN NULL ELSE u END"


@query("s5_drop_sentinels", f"WITH {PHOTO}, s AS (SELECT id, {_SENT} AS u, g FROM photo) SELECT id, {rs(['u', 'g'])} FROM s WHERE u > -100 AND u < 100 AND g > -100 AND g < 100")
def s5(spark, sf):
    return rounded(T.drop_sentinels(_sentinel(spark, sf), ["u", "g"]))


def _sentinel(spark, sf):
    k = F.col("id")
    u = F.when(k % 17 == 0, -9999.0).when(k % 19 == 0, F.lit(None)).otherwise(F.col("u"))
    return photo(spark, sf).select("id", u.alias("u"), "g")


@query(
    "s5_count_sentinels",
    f"""WITH {PHOTO}, s AS (SELECT {_SENT} AS u, g FROM photo)
    SELECT count(*) FILTER (u > -100 AND u < 100) AS kept, count(*) - count(*) FILTER (u > -100 AND u < 100) AS dropped FROM s""",
)
def s5_count(spark, sf):
    return T.count_sentinels(_sentinel(spark, sf), ["u", "g"])


@query(
    "s6_align_to",
    f"WITH {PREDS}, m AS (SELECT * FROM preds WHERE model = 'm1' AND id % 3 <> 0) SELECT o_orderkey AS id, {rs(['p0', 'p1', 'p2'])} FROM orders LEFT JOIN m ON o_orderkey = id",
)
def s6(spark, sf):
    m = preds(spark, sf).where("model = 'm1' AND id % 3 <> 0").select("id", "p")
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return rounded(spread(T.align_to(m, ids, "id")))


@query(
    "s7_check_contract",
    """WITH n AS (SELECT count(*) AS n FROM orders) SELECT model, n AS "rows", n AS keys, 3 AS min_width, 3 AS max_width,
      0 AS null_rows, CASE WHEN model = 'm4' THEN n ELSE 0 END AS bad_sums, model <> 'm4' AS valid
    FROM n, (VALUES ('m1'), ('m2'), ('m3'), ('m4')) AS m(model)""",
)
def s7(spark, sf):
    p = preds(spark, sf)
    broken = F.when(F.col("model") == "m4", F.transform("p", lambda x: x * 2)).otherwise(F.col("p"))
    return T.check_contract(p.withColumn("p", broken), "id", "p", 3, ["model"])


@query(
    "s8_write_preds",
    f"""WITH {PREDS}, c AS (SELECT model, id, fold, y, {', '.join(f'least(greatest(p{i} - 25e-2, 1e-7), 1e0) AS q{i}' for i in range(3))} FROM preds WHERE model IN ('m1', 'm2'))
    SELECT model, id, fold, y, {', '.join(r(f'q{i} / (q0 + q1 + q2)', f'p{i}') for i in range(3))} FROM c""",
)
def s8(spark, sf):
    """m1 is written twice: the second write replaces its partition and leaves m2 alone."""
    path = scratch_path(spark, "preds")
    shifted = preds(spark, sf).withColumn("p", F.transform("p", lambda x: x - 0.25))
    P.write_preds(shifted.where("model IN ('m1', 'm2')"), path, 3)
    P.write_preds(shifted.where("model = 'm1'"), path, 3)
    out = P.read_preds(spark, path)
    return rounded(spread(out.select("model", "id", "fold", "y", "p")))


@query(
    "s9_load_preds",
    f"WITH {PREDS} SELECT model, split, id, {r('CASE WHEN split = ' + chr(39) + 'oof' + chr(39) + ' THEN p0 ELSE p1 END', 'v')} FROM preds, (VALUES ('oof'), ('test')) AS s(split) WHERE model = 'm1'",
)
def s9(spark, sf):
    """m2 lacks the test split, m3 is all zeros, m9 does not exist."""
    p = preds(spark, sf).select("model", "split", "id", "p")
    zero = F.when(F.col("model") == "m3", F.transform("p", lambda x: x * 0)).otherwise(F.col("p"))
    oof = p.withColumn("p", zero)
    rolled = F.array(F.col("p")[1], F.col("p")[2], F.col("p")[0])
    test = oof.where("model <> 'm2'").withColumns({"split": F.lit("test"), "p": rolled})
    kept = P.load_preds(oof.unionByName(test), ["m1", "m2", "m3", "m9"])
    return rounded(kept.select("model", "split", "id", F.col("p")[0].alias("v")))


@query(
    "s10_snapshot_restore",
    f"WITH {PREDS} SELECT model, count(*) AS n, {r('avg(p0)', 'mean_p0')} FROM preds WHERE model IN ('m1', 'm2') GROUP BY model",
)
def s10(spark, sf):
    """A version is kept, the current one overwritten, the version brought back."""
    path = scratch_path(spark, "versions")
    p = preds(spark, sf).where("model IN ('m1', 'm2')")
    P.write_preds(p, path, 3)
    P.snapshot(spark, path, "seed42")
    P.write_preds(p.withColumn("p", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))), path, 3)
    P.restore(spark, path, "seed42")
    out = P.read_preds(spark, path).groupBy("model")
    return rounded(out.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("p")[0]).alias("mean_p0")))


@query(
    "s11_carry_forward",
    f"WITH {PREDS} SELECT model, split, id, {r('CASE WHEN model = ' + chr(39) + 'm1' + chr(39) + ' THEN p1 ELSE p0 END', 'v')} FROM preds, (SELECT 'oof' AS split) WHERE model <> 'm4'",
)
def s11(spark, sf):
    """m1 is new, m2 and m3 are carried over, m4's row count no longer fits."""
    p = preds(spark, sf)
    new = p.where("model = 'm1'").select("model", "split", "id", F.col("p")[1].alias("v"))
    old = p.where("model <> 'm4' OR id % 2 = 0").select("model", "split", "id", F.col("p")[0].alias("v"))
    return rounded(P.carry_forward(new, old, table(spark, sf, "orders").count()))


@query(
    "s12_write_answer",
    f"WITH {PREDS} SELECT id, ['GALAXY', 'QSO', 'STAR'][{argmax_sql(['p0', 'p1', 'p2'])} + 1] AS class FROM preds WHERE model = 'm2'",
)
def s12(spark, sf):
    path = scratch_path(spark, "answer.csv")
    P.write_answer(preds(spark, sf).where("model = 'm2'"), path, CLASSES)
    return spark.read.schema("id long, class string").option("header", True).csv(path)


@query(
    "s13_read_pseudo_labels",
    f"""WITH {PREDS} SELECT 'proba' AS layout, id, ['GALAXY', 'QSO', 'STAR'][{argmax_sql(['p0', 'p1', 'p2'])} + 1] AS label, {r('greatest(p0, p1, p2)', 'conf')}
      FROM preds WHERE model = 'm2' AND greatest(p0, p1, p2) >= 55e-2
    UNION ALL SELECT 'label', o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'GALAXY' ELSE 'QSO' END, 1e0 FROM orders WHERE o_orderstatus <> 'P'""",
)
def s13(spark, sf):
    p = preds(spark, sf).where("model = 'm2'")
    wide = p.select("id", *[F.col("p")[i].alias(c) for i, c in enumerate(CLASSES)])
    o = table(spark, sf, "orders")
    named = F.when(F.col("o_orderstatus") == "F", "galaxy").when(F.col("o_orderstatus") == "O", "qso").otherwise("other")
    a = T.read_pseudo_labels(wide, CLASSES, threshold=0.55).withColumn("layout", F.lit("proba"))
    b = T.read_pseudo_labels(o.select(F.col("o_orderkey").alias("id"), named.alias("class")), CLASSES)
    assert T.read_pseudo_labels(o.select(F.col("o_orderkey").alias("id")), CLASSES) is None
    return rounded(a.unionByName(b.withColumn("layout", F.lit("label"))))


def _records(spark, sf):
    ev = table(spark, sf, "events")
    pair = F.create_map(F.lit("lgb"), F.col("value"), F.lit("xgb"), F.lit(0.5))
    return ev.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.concat(F.lit("exp_"), "event_id").alias("experiment"),
        F.col("user_id").alias("seed"),
        F.col("event_type").alias("feature_set"),
        F.create_map(F.lit("GALAXY"), F.col("value")).alias("per_class_recall"),
        F.when(F.col("event_id") % 2 == 0, pair).alias("weights"),
        (F.col("event_id") % 3 == 0).alias("no_bias"),
    )


@query(
    "s14_flatten_experiments",
    """SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, 'exp_' || event_id AS experiment, CAST(user_id AS VARCHAR) AS seed,
      event_type AS feature_set, '' AS models, '' AS oof_balanced_accuracy, '' AS oof_balanced_accuracy_before_bias,
      CAST(value AS VARCHAR) AS per_class_recall_galaxy, '' AS per_class_recall_qso, '' AS per_class_recall_star,
      '' AS lgb_oof_ba, '' AS xgb_oof_ba, '' AS cat_oof_ba,
      CASE WHEN event_id % 2 = 0 THEN '{"lgb":' || CAST(value AS VARCHAR) || ',"xgb":0.5}' ELSE '' END AS blend_weights,
      '{}' AS class_bias, CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END AS no_bias, '' AS submission, '' AS public_lb, '' AS notes FROM events""",
)
def s14(spark, sf):
    """Records are appended in two writes, read back and flattened."""
    path = scratch_path(spark, "experiments.jsonl")
    records = _records(spark, sf)
    R.append_experiment(records.where(F.col("seed") % 2 == 0), path)
    R.append_experiment(records.where(F.col("seed") % 2 != 0), path)
    return R.flatten_experiments(R.read_experiments(spark, path))


@query(
    "s15_read_mixed_log",
    """SELECT 'event ' || event_id || ' ' || event_type AS line FROM events
    UNION ALL SELECT '[' || event_id || '] not json' FROM events WHERE event_id % 6 = 4
    UNION ALL SELECT 'after ' || event_id FROM events WHERE event_id % 6 = 5""",
)
def s15(spark, sf):
    """JSON lines, list members over several lines, whole lists, plain and bracketed text."""
    path = scratch_path(spark, "log")
    text = F.concat(F.lit("event "), "event_id", F.lit(" "), "event_type")
    plain = F.to_json(F.struct(text.alias("data")))
    named = F.to_json(F.struct(F.lit("stdout").alias("stream_name"), text.alias("data")))
    after = F.to_json(F.struct(F.concat(F.lit("after "), "event_id").alias("data")))
    listed = F.concat(F.lit("["), named, F.lit(", "), after, F.lit("]"))
    k = F.col("event_id") % 6
    line = (F.when(k == 0, plain).when(k == 1, named).when(k == 2, F.concat(F.lit(","), plain))
            .when(k == 5, listed).otherwise(text))
    extra = F.when(k == 4, F.concat(F.lit("["), "event_id", F.lit("] not json")))
    rows = F.explode(F.filter(F.array(line, extra), lambda x: x.isNotNull()))
    table(spark, sf, "events").select(rows.alias("value")).write.text(path)
    return R.read_mixed_log(spark, path).select("line")


@query("s16_align_columns", "SELECT l_orderkey, l_quantity, l_tax FROM lineitem")
def s16(spark, sf):
    li = table(spark, sf, "lineitem")
    other = li.select("l_tax", "l_quantity", "l_returnflag", "l_orderkey", "l_suppkey")
    return other.select(*T.align_columns(li, other, exclude=["l_suppkey"]))
