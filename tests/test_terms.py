"""Vocabularies and components of texts against numpy."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparktab.operators import terms


def texts(n=150, seed=3):
    rng = np.random.default_rng(seed)
    words = [f"w{i:02d}" for i in range(60)]
    share = [np.roll(1 / np.arange(1, 61), s) for s in (0, 17, 41)]
    rows = []
    for i in range(n):
        p = share[i % 3] / share[i % 3].sum()
        rows.append((i, " ".join(rng.choice(words, int(rng.integers(3, 60)), p=p)).title()))
    # A long one over several slices of cells, one without words, an empty and a null one.
    return rows + [(n, "w00 w59 " * 3000), (n + 1, "? !"), (n + 2, ""), (n + 3, None)]


def weighed(rows, max_terms):
    """Vocabulary and matrix by plain loops."""
    import hashlib

    each = [Counter(re.findall(r"\w{2,}", (t or "").lower())) for _, t in rows]
    n, df = Counter(), Counter()
    for c in each:
        n.update(c)
        df.update(c.keys())
    kept = sorted(n, key=lambda t: (-n[t], hashlib.md5(f"0:{t}".encode()).hexdigest()))[:max_terms]
    kept.sort(key=lambda t: (-n[t], t))
    idf = {t: math.log((1 + len(rows)) / (1 + df[t])) + 1 for t in kept}
    return kept, n, df, np.array([[c[t] * idf[t] for t in kept] for c in each])


def up_to_sign(got, want):
    return max(min(np.abs(g - w).max(), np.abs(g + w).max()) for g, w in zip(got.T, want.T))


@pytest.mark.parametrize("centre", [True, False])
@pytest.mark.parametrize("max_terms", [1000, 25])
def test_components_are_eigenpairs(spark, centre, max_terms):
    rows = texts()
    kept, n, df, a = weighed(rows, max_terms)
    frame = spark.createDataFrame(rows, "id long, text string").repartition(5)
    model = terms.TermComponents("id", "text", 3, max_terms, centre=centre)
    got = sorted(map(tuple, model.fit_transform(frame).collect()))
    assert [g[0] for g in got] == [r[0] for r in rows]
    found = {r["term"]: (r["id"], r["n"], r["df"]) for r in model.words.collect()}
    assert found == {t: (i, n[t], df[t]) for i, t in enumerate(kept)}
    b = a - a.mean(0) if centre else a
    values, vectors = np.linalg.eigh(b.T @ b)
    assert np.allclose(model.values, values[::-1][:3], rtol=1e-8)
    assert up_to_sign(model.loadings, vectors[:, ::-1][:, :3]) < 1e-5
    scores = np.array([g[1:] for g in got])
    assert np.allclose(scores, a @ model.loadings, atol=1e-6)
    assert not scores[-3:].any()
    # New documents, also with unknown words and a key of another order.
    new = spark.createDataFrame([(7, "w01 unknown w03"), (8, "nothing")], "id long, text string")
    placed = sorted(map(tuple, model.transform(new).collect()))
    row = np.zeros(len(kept))
    idf = {t: math.log((1 + len(rows)) / (1 + df[t])) + 1 for t in kept}
    for t in ("w01", "w03"):
        if t in idf:
            row[kept.index(t)] = idf[t]
    assert np.allclose(placed[0][1:], row @ model.loadings, atol=1e-6) and not any(placed[1][1:])


def test_fewer_terms_than_components_and_no_rows(spark):
    frame = spark.createDataFrame([(1, "aa aa bb"), (1, "bb"), (2, "aa")], "id long, text string")
    got = sorted(map(tuple, terms.tfidf_components(frame, "id", "text", 4).collect()))
    assert [g[0] for g in got] == [1, 2] and all(len(g) == 5 for g in got)
    assert all(g[3] == g[4] == 0 for g in got)
    empty = terms.tfidf_components(spark.createDataFrame([], "id long, text string"), "id", "text", 2)
    assert empty.columns == ["id", "text_pc0", "text_pc1"] and empty.collect() == []
    blank = spark.createDataFrame([(None, "aa"), (3, None)], "id long, text string")
    assert sorted((g[0] or 0) for g in terms.tfidf_components(blank, "id", "text", 2).collect()) == [0, 3]


def split(rows):
    """The same documents over several rows of one key: every fifth text cut at a space, one into very many rows."""
    out = []
    for i, text in rows:
        words = (text or "").split(" ")
        if i % 5 == 0 and len(words) > 2:
            step = 1 if i == 0 else 7
            out += [(i, " ".join(words[j : j + step])) for j in range(0, len(words), step)]
        else:
            out.append((i, text))
    return out + [(None, "w01 w02"), (None, None), (None, "w02 w05")]


@pytest.mark.parametrize("held", [1 << 20, 1])
def test_keys_that_repeat_and_large_vocabularies(spark, monkeypatch, held):
    """Rows of one key are one document; a vocabulary beyond the bound meets its terms by an exchange."""
    monkeypatch.setattr(terms, "VOCABULARY_BYTES", held)
    rows = split(texts(60))
    frame = spark.createDataFrame(rows, "id long, text string").repartition(4)
    model = terms.TermComponents("id", "text", 2, 40).fit(frame)
    got = {r[0]: r[1:] for r in model.transform(frame).collect()}
    whole = {}
    for i, text in rows:
        whole[i] = f"{whole.get(i, '')} {text or ''}"
    assert set(got) == set(whole)
    words = {r["term"]: r for r in model.words.collect()}
    each = {i: Counter(re.findall(r"\w{2,}", t.lower())) for i, t in whole.items()}
    for t, r in words.items():
        df = sum(t in c for c in each.values())
        assert (r["n"], r["df"]) == (sum(c[t] for c in each.values()), df)
        assert math.isclose(r["idf"], math.log((1 + len(rows)) / (1 + df)) + 1)
    a = np.array([[c[t] * words[t]["idf"] for t in words] for c in each.values()])
    b = a - a.mean(0)
    assert np.allclose(model.values, np.linalg.eigvalsh(b.T @ b)[::-1][:2], rtol=1e-8)
    place = np.array([words[t]["id"] for t in words])
    want = a @ model.loadings[place]
    assert np.allclose([got[i] for i in each], want, atol=1e-6)


def test_documents_of_one_row_do_not_move(spark):
    frame = spark.createDataFrame(texts(40), "id long, text string")
    model = terms.TermComponents("id", "text", 2).fit(frame)
    plan = model.transform(frame)._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_tasks_send_sums_and_plans_hold_no_terms(spark):
    rows = texts(40)
    frame = spark.createDataFrame(rows, "id long, text string")
    model = terms.TermComponents("id", "text", 2).fit(frame)
    plan = model.transform(frame)._jdf.queryExecution().toString()
    assert "w07" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_components_that_do_not_settle_raise(spark):
    frame = spark.createDataFrame(texts(), "id long, text string")
    counts = terms.term_counts(frame, "id", "text")
    words = terms.vocabulary(counts, frame.count(), 1000)
    vectors = terms.term_vectors(counts, "id", words)
    with pytest.raises(RuntimeError, match="not settled"):
        terms.principal_directions(vectors, words.count(), 3, max_scans=1)


def test_batches_of_terms_are_cut(monkeypatch):
    """Tasks work on a bounded number of words at once, whatever the size of a batch of rows."""
    monkeypatch.setattr(terms, "CELLS_AT_ONCE", 50)
    words = [["a", "b", "a"] * (i % 5) for i in range(300)] + [None, ["x"] * 80, []]
    batch = pa.RecordBatch.from_arrays([pa.array(range(303)), pa.array(words, pa.list_(pa.string()))], names=["id", "w"])
    out = list(terms._counter("id")(iter([batch])))
    assert max(sum(map(len, b["terms"].to_pylist())) for b in out) <= 50 and len(out) > 20
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["id"] for r in rows] == list(range(303))
    assert [dict(zip(r["terms"], r["tfs"])) for r in rows] == [dict(Counter(w or [])) for w in words]


def test_weights_of_repeated_keys_and_plan(spark, monkeypatch):
    docs = [(1, "aa bb aa"), (2, "bb cc"), (2, "cc dd"), (None, "aa"), (None, "ee aa"), (4, None), (5, "")]
    df = spark.createDataFrame(docs, "id long, t string")
    want = {(1, "aa", 2, 2), (1, "bb", 1, 2), (2, "bb", 1, 2), (2, "cc", 2, 1), (2, "dd", 1, 1), (None, "aa", 2, 2), (None, "ee", 1, 1)}
    for size in (1 << 20, 0):
        monkeypatch.setattr(terms, "VOCABULARY_BYTES", size)
        got = terms.term_weights(df, "id", "t").collect()
        assert {tuple(r)[:4] for r in got} == want and len(got) == len(want)
        assert all(abs(r["weight"] - r["tf"] * (np.log(8 / (1 + r["df"])) + 1)) < 1e-12 for r in got)
    monkeypatch.setattr(terms, "VOCABULARY_BYTES", 1 << 20)
    one = terms.term_weights(df.where("id = 1 or id > 3"), "id", "t")
    one.collect()
    # Counts meet their frequencies where they lie.
    assert "Exchange hashpartitioning" not in one._jdf.queryExecution().executedPlan().toString()
