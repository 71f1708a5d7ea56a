"""The packed join of large keys gives what joins column by column give, with a fixed number of exchanges."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktab.operators import categories, encoders, groupstats, joins

COLS = [f"c{i}" for i in range(10)]


@pytest.fixture(scope="module")
def facts(spark):
    """Ten keys: one value of the first holds a third of the rows, some are null, some double."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        cells = [int(v) for v in rng.integers(0, 200, 10)]
        cells[0] = 7 if i % 3 == 0 else cells[0]
        cells[1] = None if i % 10 == 0 else cells[1]
        rows.append((i % 4, int(rng.integers(0, 3)), float(rng.random()), f"v{cells[2]}", *cells))
    names = "fold int, y int, x double, other string, " + ", ".join(f"{c} int" for c in COLS)
    return spark.createDataFrame(rows, names).withColumn("c3", F.col("c3") / 8 - 2.0)


def same(a, b):
    assert a.columns == b.columns and a.dtypes == b.dtypes
    order = a.columns
    one, two = (sorted(map(str, ([None if v is None else round(v, 9) if isinstance(v, float) else v for v in r] for r in d.collect()))) for d in (a, b))
    assert order and one == two


def test_encoders_by_packed_join(facts, monkeypatch):
    monkeypatch.setattr(joins, "ROWS_PER_SALT", 20)
    fit, new = facts.where("x < 0.7"), facts.where("x >= 0.5")
    for way in (True, False):
        out = [
            *encoders.fold_safe_encode(fit, COLS[:4], "y", 3, "fold", 4.0, new, packed=way),
            encoders.auto_smooth_encode(fit, COLS[:2], "y", 3, "fold", packed=way)[0],
            encoders.target_encode(fit, new, COLS[:4], "y", 2.0, packed=way),
            encoders.aux_prior_encode(fit, new, COLS[:2], "y", 3, packed=way),
            groupstats.group_stats(fit, {"a": "c0", "b": "c1", "d": "other"}, ["x", "c4"], packed=way),
            categories.count_encode([fit, new], new, COLS[:3], packed=way),
        ]
        if way:
            packed = out
    for a, b in zip(packed, out, strict=True):
        same(a, b)


def test_one_exchange_of_facts_for_any_number_of_keys(facts, spark):
    seen = {}
    for n in (2, 5, 10):
        stats = joins.packed_stats(facts.select(*COLS[:n], "x"), COLS[:n], [F.avg("x").alias("m"), F.count("x").alias("n")])
        named = {c: s.select("__v", F.col("m").alias(f"{c}_m"), F.col("n").alias(f"{c}_n")) for c, s in stats.items()}
        plan = joins.lookup_values(facts, named, packed=True)._jdf.queryExecution().executedPlan().toString()
        seen[n] = len(re.findall(r"Exchange hashpartitioning", plan))
    # Cells, statistics, cells by row, facts, and the two sides of the sketch of frequent values.
    assert len(set(seen.values())) == 1 and seen[10] <= 6


def test_small_statistics_are_not_packed(facts):
    stats = joins.packed_stats(facts.select("c0", "c1", "x"), ["c0", "c1"], [F.avg("x").alias("m")])
    named = {c: s.withColumnRenamed("m", f"{c}_m") for c, s in stats.items()}
    assert all(joins.fits_broadcast(s) for s in named.values())
    plan = joins.lookup_values(facts, named)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_heavy_values_are_found(facts):
    cells = facts.select(F.lit(0).alias("__c"), F.col("c0").cast("string").alias("__v"))
    found = {r["__v"]: r["__salts"] for r in joins.heavy_values(cells, 100).collect()}
    assert set(found) == {"7"} and found["7"] >= 3


def test_packed_join_of_an_empty_table(facts):
    none = facts.where("false")
    out, _ = encoders.fold_safe_encode(none, COLS, "y", 3, "fold", packed=True)
    assert out.count() == 0 and "TE_c9_2" in out.columns


def test_packed_join_hashes_rows_and_sketches_once(facts):
    """Rows come back by a hashed aggregate, not by sorted lists; the sketch of frequent values is written, not planned twice."""
    out, _ = encoders.fold_safe_encode(facts, COLS[:4], "y", 3, "fold", packed=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "ObjectHashAggregate" not in plan
    assert "collect_list" not in plan and "approx_top_k" not in plan


def test_packed_join_of_texts_and_dates(facts, monkeypatch):
    """Looked-up values need not be numbers; nulls among them stay null."""
    monkeypatch.setattr(joins, "ROWS_PER_SALT", 20)
    seen = F.when(F.col("n") % 2 == 0, F.concat(F.lit("n"), F.col("n")))
    stats = joins.packed_stats(facts.select(*COLS[:3]), COLS[:3], [F.count(F.lit(1)).alias("n")])
    named = {c: s.select("__v", seen.alias(f"{c}_t"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("n").cast("int")).alias(f"{c}_d"),
                         F.array(F.col("n"), F.lit(None).cast("long")).alias(f"{c}_a")) for c, s in stats.items()}
    same(*(joins.lookup_values(facts, named, packed=way) for way in (True, False)))
