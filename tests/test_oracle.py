"""Every registered query with a SQL twin gives the same rows; the others give some rows."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from suite.check import differences
from tests.conftest import SF

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# Model protocols without a twin take long; ``python -m suite.check t`` runs them.
ROWS_ONLY = ["h8_compare_rules", "t1_logistic", "t7_cascade", "e20_tfidf_components"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert differences(got, duck.execute(ORACLES[name]).df()) is None


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_flagship_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["fold", "balanced_accuracy", "accuracy", "rows"]
    assert out.count() == 5


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
