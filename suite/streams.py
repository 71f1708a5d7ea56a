"""Streams over the events file, run to completion and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktab.operators.binning import QuantileBinner
from sparktab.operators.joins import lookup
from sparktab.session import materialize, scratch_path
from sparktab.streaming import streams as X
from suite.common import query, r, rounded, table
from suite.binning import _below, _cont, _TRIM


def _stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return X.read_stream(spark, sf, schema, pattern="events.parquet")


@query(
    "x1_score_stream",
    f"""WITH q AS (SELECT {_TRIM.format(q=_cont('value', 10))} AS e FROM events WHERE event_id % 2 = 0),
    s AS (SELECT user_id, avg(value) AS m FROM events WHERE event_id % 2 = 0 AND user_id % 10 <> 0 GROUP BY 1)
    SELECT event_id, {r('ln(1 + value)', 'value_log')}, {_below('e', 'value', '<=')} AS value_q10, {r('coalesce(m, 0e0)', 'user_mean')}
    FROM events LEFT JOIN s USING (user_id), q""",
)
def x1(spark, sf):
    ev = table(spark, sf, "events")
    half = ev.where("event_id % 2 = 0")
    bins = QuantileBinner(["value"], 10).fit(half)
    means = half.where("user_id % 10 <> 0").groupBy("user_id").agg(F.avg("value").alias("user_mean"))
    means = materialize(means, "means")  # once, not in every micro-batch
    scored = X.score_stream(
        _stream(spark, sf).select("event_id", "user_id", "value"),
        [
            lambda d: d.withColumn("value_log", F.log1p("value")),
            bins.transform,
            lambda d: lookup(d, means, "user_id", {"user_mean": 0.0}),
        ],
    )
    picked = scored.select("event_id", "value_log", "value_q10", "user_mean")
    return rounded(X.run_to_table(picked, scratch_path(spark, "scored"), scratch_path(spark, "scored-state")))


@query(
    "x2_watch_experiments",
    f"""WITH w AS (SELECT max(ts) - INTERVAL 2 HOUR AS mark FROM events),
    d AS (SELECT date_trunc('day', ts) AS start, event_type, value FROM events)
    SELECT strftime(d.start, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, {r('avg(value)', 'mean_score')}, {r('min(value)', 'min_score')}, {r('max(value)', 'max_score')}
    FROM d WHERE d.start + INTERVAL 1 DAY <= (SELECT mark FROM w) GROUP BY d.start, event_type""",
)
def x2(spark, sf):
    """Every row arrives twice; windows are emitted once the watermark passes their end."""
    twice = _stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    watched = X.watch_experiments(twice, "ts", "event_id", "value", "event_type")
    out = X.run_to_table(watched, scratch_path(spark, "watched"), scratch_path(spark, "watched-state"))
    return rounded(out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")))
