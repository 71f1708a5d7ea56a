"""Pipeline stages on odd tables: clashing columns, null ids, empty texts, repeated rows, no rows."""

from __future__ import annotations

import pytest

import corpus_pipeline
from tests.conftest import SF

STAGES = dict(corpus_pipeline.STAGES)
CLASHES = [
    "score", "predicted", "held_out", "n_bytes", "n_removed", "n_spans", "kept", "_sig", "_id", "_size", "_first", "n_words", "n_hit",
    "items", "hit_words", "contaminated", "component_id", "n_shingles", "sig", "part", "kept_id", "text_to_search", "own0",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with a value of their own in each column that an operator adds."""
    taken = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(40).collect()]
    rows = [*taken, (None, taken[0][1]), (None, None), (900001, None), (900002, ""), (900003, "  "), taken[1], taken[1], (None, taken[2][1] + " end")]
    names = "doc_id long, text string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(i, t, -1, *[f"{c}-{n}" for c in CLASHES]) for n, (i, t) in enumerate(rows)], names)


@pytest.mark.parametrize("name", [n for n in STAGES if n != "tokens"])
def test_stage_keeps_columns_and_values(spark, odd, name):
    out = STAGES[name](spark, odd, SF)
    assert out.dtypes == odd.dtypes
    before = {r["own0"]: r for r in odd.collect()}
    rows = out.collect()
    assert len({r["own0"] for r in rows}) == len(rows) and 0 < len(rows) <= len(before)
    for r in rows:
        own = before[r["own0"]]
        assert r["doc_id"] == own["doc_id"] and all(r[c] == own[c] for c in CLASHES)
        if name != "repeated_passages":
            assert r == own
        else:
            assert r["n_chars"] == len(r["text"]) and len(r["text"]) <= len(own["text"] or "")
    if name == "repeated_passages":
        assert len(rows) == len(before)
    if name == "near_duplicates":
        assert sum(r["doc_id"] is None for r in rows) == sum(r["doc_id"] is None for r in before.values())
        assert {900001, 900002, 900003} <= {r["doc_id"] for r in rows}
    if name == "decontamination":
        assert {900001, 900002, 900003} <= {r["doc_id"] for r in rows}


def test_tokens_of_odd_rows(spark, odd):
    rows = STAGES["tokens"](spark, odd, SF).collect()
    assert len(rows) == odd.count()
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (900001, 900002, 900003)} == {0}


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_without_rows(spark, odd, name):
    assert STAGES[name](spark, odd.where("false"), SF).count() == 0
