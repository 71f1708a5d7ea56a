"""Ledger roll-ups; events play experiments, calls and log lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktab.operators import ledger as L
from sparktab.operators.categories import value_ranks
from sparktab.operators.groupstats import group_stats
from sparktab.sources.records import log_line
from suite.common import query, r, rounded, table

_EXP = """x AS (SELECT event_id, ts, user_id % 20 AS competition, CASE WHEN event_id % 13 <> 0 THEN value END AS cv,
    value - (event_id % 7 - 3) / 2e0 AS lb, value - (event_id % 11) / 10e0 AS pv, event_type FROM events)"""


def experiments(spark, sf):
    k = F.col("event_id")
    return table(spark, sf, "events").select(
        "event_id", "ts", (F.col("user_id") % 20).alias("competition"),
        F.when(k % 13 != 0, F.col("value")).alias("cv"),
        (F.col("value") - (k % 7 - 3) / F.lit(2.0)).alias("lb"),
        (F.col("value") - (k % 11) / F.lit(10.0)).alias("pv"),
        "event_type",
    )


_BB = "max(cv) OVER (PARTITION BY competition ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(
    "w1_running_best",
    f"WITH {_EXP}, b AS (SELECT *, {_BB} AS best_before FROM x) SELECT event_id, competition, best_before, cv IS NOT NULL AND (best_before IS NULL OR cv > best_before) AS is_best FROM b",
)
def w1(spark, sf):
    out = L.running_best(experiments(spark, sf), "competition", "ts", "event_id", "cv")
    return out.select("event_id", "competition", "best_before", "is_best")


@query(
    "w2_last_n",
    f"WITH {_EXP} SELECT competition, event_id FROM x QUALIFY row_number() OVER (PARTITION BY competition ORDER BY ts DESC, event_id DESC) <= 5",
)
def w2(spark, sf):
    return L.last_n(experiments(spark, sf).select("competition", "event_id", "ts"), "competition", "ts", "event_id", 5).drop("ts")


@query("w3_top_k", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def w3(spark, sf):
    return L.top_k(table(spark, sf, "events").select("event_id", "value"), "value", "event_id", 25)


@query(
    "w4_value_ranks",
    "SELECT p_partkey, dense_rank() OVER (ORDER BY p_name) AS name_rank FROM part",
)
def w4(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    return value_ranks(part, "p_name", "name_rank").drop("p_name")


@query(
    "w5_group_transform",
    f"""SELECT event_id, count(*) OVER w AS by_user_count, {r('avg(value) OVER w', 'by_user_value_mean')},
      {r('coalesce(stddev_samp(value) OVER w, 0e0)', 'by_user_value_std')}, {r('value - avg(value) OVER w', 'by_user_value_dev')}
    FROM events WINDOW w AS (PARTITION BY user_id)""",
)
def w5(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "value")
    return rounded(group_stats(ev, {"by_user": "user_id"}, ["value"]).drop("user_id", "value"))


@query(
    "l1_experiment_summary",
    f"""WITH {_EXP} SELECT competition, count(*) AS total_experiments, count(*) FILTER (event_type <> 'error') AS successful,
      (SELECT event_id FROM x y WHERE y.competition = x.competition AND cv IS NOT NULL ORDER BY cv DESC, event_id LIMIT 1) AS best_experiment,
      max(cv) AS best_cv_score FROM x GROUP BY competition""",
)
def l1(spark, sf):
    x = experiments(spark, sf).withColumn("ok", F.col("event_type") != "error")
    return L.experiment_summary(x, "competition", "event_id", "cv", "ok")


@query(
    "l1_experiment_list",
    "SELECT conv_id, turn, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS text, role FROM conversations",
)
def l1_list(spark, sf):
    c = table(spark, sf, "conversations")
    return L.experiment_list(c, "conv_id", "text", ["turn", "role"])


@query(
    "l2_cv_lb_monitor",
    f"""WITH {_EXP}, b AS (SELECT *, {_BB} AS bb FROM x) SELECT competition, event_id, cv, {r('lb')}, {r('cv - lb', 'gap')},
      coalesce(abs(round(cv - lb, 6)) > 1, false) AS alarm, cv IS NOT NULL AND (bb IS NULL OR cv > bb) AS submit FROM b""",
)
def l2(spark, sf):
    x = experiments(spark, sf).withColumn("lb", F.round("lb", 6))
    return rounded(L.cv_lb_monitor(x, "competition", "ts", "event_id", "cv", "lb", 1.0000001))


@query(
    "l3_shakedown",
    f"WITH {_EXP} SELECT event_id, {r('round(lb - pv, 6)', 'drop')}, {r('round(lb - cv, 6)', 'excess')} FROM x ORDER BY round(lb - pv, 6) DESC, event_id LIMIT 40",
)
def l3(spark, sf):
    x = experiments(spark, sf).withColumns({c: F.round(c, 3) for c in ("cv", "lb", "pv")})
    units = x.select("event_id", *[F.rint(F.col(c) * 1000).cast("long").alias(c) for c in ("cv", "lb", "pv")])
    out = L.shakedown(units, "event_id", "cv", "lb", "pv", 40)
    return rounded(out.withColumns({c: F.col(c) / F.lit(1000.0) for c in ("drop", "excess")}))


@query(
    "l3_shakedown_correlation",
    f"WITH {_EXP} SELECT {r('corr(lb - pv, lb - cv)', 'corr')}, {r('avg(lb - pv)', 'mean_drop')} FROM x",
)
def l3_corr(spark, sf):
    return rounded(L.shakedown_correlation(experiments(spark, sf), "cv", "lb", "pv"))


_USE = "u AS (SELECT event_id, ts, event_type AS provider, user_id * 10 AS prompt, event_id % 50 AS completion, value / 1000 AS cost FROM events)"


def usage(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", "ts", F.col("event_type").alias("provider"), (F.col("user_id") * 10).alias("prompt"),
        (F.col("event_id") % 50).alias("completion"), (F.col("value") / 1000).alias("cost"))


_USUM = f"""count(*) AS calls, CAST(sum(prompt) AS BIGINT) AS prompt_tokens, CAST(sum(completion) AS BIGINT) AS completion_tokens,
    CAST(sum(prompt + completion) AS BIGINT) AS total_tokens, {r('sum(cost)', 'cost_usd')}"""


@query(
    "l4_usage_rollup",
    f"WITH {_USE} SELECT provider, {_USUM} FROM u GROUP BY provider UNION ALL SELECT 'ALL', {_USUM} FROM u",
)
def l4(spark, sf):
    return rounded(L.usage_rollup(usage(spark, sf), "provider", "prompt", "completion", "cost"))


@query(
    "l4_within_budget",
    f"WITH {_USE}, s AS (SELECT event_id, cost, sum(cost) OVER (ORDER BY ts, event_id) AS spent FROM u) SELECT event_id, {r('spent')} FROM s WHERE spent - cost < 20",
)
def l4_budget(spark, sf):
    u = usage(spark, sf)
    return rounded(L.within_budget(u, "ts", "event_id", "cost", 20.0).select("event_id", "spent"))


@query(
    "l5_validation_rollup",
    f"""SELECT user_id AS skill, count(DISTINCT event_type) AS competitions, {r('avg(CASE WHEN event_id % 3 <> 0 THEN value END)', 'avg_gain')},
      count(DISTINCT event_type) >= 3 AS validated FROM events GROUP BY user_id""",
)
def l5(spark, sf):
    ev = table(spark, sf, "events").select(
        F.col("user_id").alias("skill"), F.col("event_type").alias("competition"),
        F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("gain"))
    return rounded(L.validation_rollup(ev, "skill", "competition", "gain"))


@query(
    "l6_rank_techniques",
    """SELECT p_partkey AS name, p_size >= 25 AS validated, CASE WHEN p_size % 4 <> 0 THEN p_retailprice END AS avg_gain FROM part
    WHERE p_type IN ('ECONOMY', 'PROMO') AND (contains(lower(p_name), 'red') OR contains(lower(p_name), 'ring'))
    ORDER BY CAST(p_size >= 25 AS INTEGER) DESC, coalesce(avg_gain, 0) DESC, name LIMIT 10""",
)
def l6(spark, sf):
    t = table(spark, sf, "part").select(
        F.col("p_partkey").alias("name"),
        F.when(F.col("p_type").isin("ECONOMY", "PROMO"), F.array(F.lit("tabular"), F.lit("nlp")))
        .otherwise(F.array(F.lit("cv"))).alias("types"),
        F.col("p_name").alias("conditions"), (F.col("p_size") >= 25).alias("validated"),
        F.when(F.col("p_size") % 4 != 0, F.col("p_retailprice")).alias("avg_gain"))
    out = L.rank_techniques(t, "tabular", ["RED", "ring"], 10)
    return out.select("name", "validated", "avg_gain")


# One message per remainder of the event number, cycling through every signature.
_MESSAGES = [
    "RuntimeError: no kernel image is available for execution",
    "cudaError invalid device ordinal while casting",
    "404 Notebook not found",
    "column x has dtype float64 but is in cat_features list; float in cat_features",
    "ValueError: cannot reshape array of size 7",
    "process Killed by signal 9",
    "ImportError: no module named x; import error",
    "finished: CV score: 0.9653",
    "timeout while waiting, memory low",
    "epoch done, score 0.91 ok",
    "all fine",
]


def _message(k):
    out = F.lit(_MESSAGES[-1])
    for i, m in enumerate(_MESSAGES[:-1]):
        out = F.when(k == i, F.lit(m)).otherwise(out)
    return out


_MSG = ("m AS (SELECT event_id, user_id, CASE event_id % 11 "
        + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MESSAGES[:-1])) + f" ELSE '{_MESSAGES[-1]}' END || ' [' || event_type || ']' AS line FROM events)")
_DIAG = "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}', 'i') THEN {i}" for i, (_, p) in enumerate(L.SIGNATURES)) + f" ELSE {len(L.SIGNATURES)} END"
_NAMES = "[" + ", ".join(f"'{n}'" for n, _ in L.SIGNATURES) + ", 'unknown']"


def lines(spark, sf):
    msg = F.concat(_message(F.col("event_id") % 11), F.lit(" ["), "event_type", F.lit("]"))
    return table(spark, sf, "events").select("event_id", "user_id", msg.alias("line"))


@query("l7_diagnose_lines", f"WITH {_MSG} SELECT event_id, {_NAMES}[{_DIAG} + 1] AS diagnosis FROM m")
def l7_lines(spark, sf):
    """Half of the lines arrive wrapped as JSON."""
    raw = lines(spark, sf)
    wrapped = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.col("line").alias("data")))).otherwise(F.col("line"))
    read = raw.select("event_id", wrapped.alias("value")).select("event_id", log_line().alias("line"))
    return read.select("event_id", L.diagnosis(F.col("line")).alias("diagnosis"))


@query(
    "l7_diagnose_logs",
    f"WITH {_MSG} SELECT run, {_NAMES}[min({_DIAG}) + 1] AS diagnosis, count(*) AS \"lines\" FROM (SELECT line, user_id * 10 + event_id % 11 % 6 AS run FROM m) GROUP BY run",
)
def l7(spark, sf):
    runs = lines(spark, sf).withColumn("run", F.col("user_id") * 10 + F.col("event_id") % 11 % 6)
    return L.diagnose_logs(runs, "run", "line", "event_id")


@query(
    "l7_error_kinds_and_types",
    f"""WITH {_MSG} SELECT event_id, concat_ws(',', CASE WHEN contains(lower(line), 'error') THEN 'runtime_error' END,
      CASE WHEN contains(lower(line), 'import') AND contains(lower(line), 'error') THEN 'import_error' END,
      CASE WHEN contains(lower(line), 'memory') THEN 'memory_error' END, CASE WHEN contains(lower(line), 'timeout') THEN 'timeout' END) AS kinds,
      CASE WHEN contains(lower(line), 'image') OR contains(lower(line), 'photo') OR contains(lower(line), 'picture') OR contains(lower(line), 'vision') THEN 'cv'
        WHEN contains(lower(line), 'text') OR contains(lower(line), 'nlp') OR contains(lower(line), 'language') OR contains(lower(line), 'sentence') THEN 'nlp'
        ELSE 'tabular' END AS task FROM m""",
)
def l7_kinds(spark, sf):
    m = lines(spark, sf)
    return m.select("event_id", L.error_kinds(F.col("line")).alias("kinds"), L.task_type(F.col("line")).alias("task"))


@query(
    "l8_extract_score",
    rf"""WITH {_MSG}, e AS (SELECT event_id, regexp_extract(line, '(?i)CV score[:\s]+([\d.]+)', 1) AS a,
      regexp_extract(line, '(?i)score[:\s]+([\d.]+)', 1) AS b FROM m)
    SELECT event_id, TRY_CAST(nullif(CASE WHEN a <> '' THEN a ELSE b END, '') AS DOUBLE) AS score FROM e""",
)
def l8(spark, sf):
    return lines(spark, sf).select("event_id", L.extract_score(F.col("line")).alias("score"))


@query(
    "l9_status_counts",
    f"""WITH s AS (SELECT event_type, event_id % 3 <> 0 AS done, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS ok FROM events)
    SELECT event_type, count(*) FILTER (NOT done) AS pending, count(*) FILTER (done) AS processed, count(*) FILTER (done AND ok) AS adopted,
      count(*) FILTER (done AND NOT ok) AS rejected, {r('count(*) FILTER (done AND ok) / count(*) FILTER (done)', 'adoption_rate')} FROM s GROUP BY event_type""",
)
def l9(spark, sf):
    k = F.col("event_id")
    ok = F.when(k % 5 == 0, F.lit(None).cast("boolean")).when(k % 5 == 1, False).otherwise(True)
    s = table(spark, sf, "events").select("event_type", (k % 3 != 0).alias("done"), ok.alias("ok"))
    return rounded(L.status_counts(s, "done", "ok", ["event_type"]))
