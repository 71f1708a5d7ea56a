"""The registered queries against brute force, the tokenizers library, or held-out labels."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
import sparktab.llm as llm
from suite.check import differences
from tests.conftest import SF

llm.load_all()
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def documents(duck):
    rows = duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    return {i: t or "" for i, t in rows}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def result(spark, name):
    return llm.QUERIES[name](spark, SF).toPandas()


@pytest.mark.parametrize("name", ["op1_warc", "op2_sharding", "op7_suffix_dedup", "op8_similar", "op10_decontaminate"])
def test_same_as_sql(spark, duck, name):
    assert differences(result(spark, name), duck.execute(llm.ORACLES[name]).df()) is None


def test_sharding(spark, documents):
    got = result(spark, "op2_sharding").sort_values("doc_id")
    assert got["doc_id"].tolist() == list(documents)
    assert got["size"].tolist() == [len(t.encode()) + 8 for t in documents.values()]
    assert got["text_crc32"].tolist() == [zlib.crc32(t.encode()) for t in documents.values()]
    assert set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all()
    assert got["shard"].is_monotonic_increasing and got["shard"].between(0, 23).all()
    for _, part in got.groupby("shard"):
        assert part["slot"].tolist() == list(range(len(part)))
    sums = got.groupby("shard")["size"].sum().reindex(range(24), fill_value=0)
    assert (sums - got["size"].sum() / 24).abs().max() <= got["size"].max()


def test_quality_on_held_out_labels(spark, duck):
    got = result(spark, "op3_quality")
    labels = duck.execute("SELECT doc_id, quality FROM labels").df()
    out = [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]
    assert got["held_out"].tolist() == out
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
    seen = got.merge(labels, on="doc_id")
    seen = seen[seen["held_out"]]
    good, bad = seen[seen["quality"] == 1]["score"], seen[seen["quality"] == 0]["score"]
    assert (seen["predicted"] == seen["quality"]).mean() >= 0.85
    assert (good.to_numpy()[:, None] > bad.to_numpy()[None, :]).mean() > 0.9


def test_licenses_without_the_bound(spark, documents):
    from sparktab.llm import licenses as L

    got = result(spark, "op4_licenses").set_index("doc_id")
    assert got["license"].notna().sum() > 0
    words = lambda t: re.findall(r"[0-9a-z\u0080-\U0010FFFF]+", t.translate(AZ))
    for i, text in documents.items():
        a, found = words(text), []
        for name, template in L.TEMPLATES.items():
            b = words(template)
            pairs = L.patience(a, b)
            assert all(a[x] == b[y] for x, y in pairs)
            if len(pairs) / len(b) >= L.COVERAGE:
                found.append((-len(pairs) / len(b), -len(b), name, len(pairs), pairs[0][0], pairs[-1][0]))
        row = got.loc[i]
        assert row["n_covered"] == len(found)
        if found:
            best = min(found)
            assert (row["license"], row["n_matched"], row["first_word"], row["last_word"]) == best[2:]
            assert row["coverage"] == pytest.approx(-best[0])
        else:
            assert row["license"] is None and row["coverage"] == 0


def test_nearest_recall_and_scores(spark, duck):
    rows = duck.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float64)
    norm = np.sqrt((x * x).sum(1))
    got = result(spark, "op5_nearest")
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        cosine = x @ x[q] / (norm * norm[q])
        cosine[q] = -np.inf
        best = np.lexsort((ids, -cosine))[:5]
        own = got[got["query_id"] == ids[q]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 6))
        assert np.allclose(own["score"], cosine[np.searchsorted(ids, own["vec_id"])], atol=1e-12)
        order = own[["score", "vec_id"]].to_numpy()
        assert all((a[0], -a[1]) > (b[0], -b[1]) for a, b in zip(order, order[1:], strict=False))
        hits += len(set(ids[best]) & set(own["vec_id"]))
        total += 5
    assert hits / total >= 0.9


def test_bpe_same_as_library(spark, documents, library):
    got = result(spark, "op6_bpe").set_index("doc_id")
    assert len(got) == len(documents)
    for i, text in documents.items():
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert tuple(got.loc[i]) == want


def removed(texts: dict[int, str]) -> dict[int, tuple[int, int, int, bytes]]:
    """(bytes, removed bytes, removed runs, what is left) of each text."""
    seen, out = set(), {}
    for i in sorted(texts):
        raw = texts[i].encode()
        windows = [raw[j : j + 50] for j in range(len(raw) - 49)]
        cover = np.zeros(len(raw) + 1, int)
        for j, w in enumerate(windows):
            if w in seen:
                cover[j] += 1
                cover[j + 50] -= 1
        seen.update(windows)
        gone = np.append(np.cumsum(cover[:-1]) > 0, False)
        runs = int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(raw) else 0
        out[i] = (len(raw), int(gone.sum()), runs, bytes(b for b, g in zip(raw, gone, strict=False) if not g))
    return out


def test_repeats_against_all_windows(spark, documents):
    got = result(spark, "op7_suffix_dedup").set_index("doc_id")
    for i, (n, gone, runs, left) in removed(documents).items():
        assert tuple(got.loc[i][["n_bytes", "n_removed", "n_spans", "kept_sha256"]]) == (n, gone, runs, hashlib.sha256(left).hexdigest())


def sets_of(texts: dict[int, str]) -> dict[int, frozenset]:
    out = {}
    for i, text in texts.items():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text.translate(AZ)) if x]
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def joined(sets: dict[int, frozenset]) -> dict[int, int]:
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    index = defaultdict(list)
    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in index[s])
        for j, k in common.items():
            if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                up[b] = a
        for s in sets[i]:
            index[s].append(i)
    return {i: find(i) for i in sets}


def test_similar_against_all_pairs(spark, documents):
    got = result(spark, "op8_similar").set_index("doc_id")
    sets = sets_of(documents)
    want = joined(sets)
    assert got["n_shingles"].to_dict() == {i: len(s) for i, s in sets.items()}
    assert got["component_id"].to_dict() == want


def test_token_files_round_trip(spark, documents, library):
    got = result(spark, "op9_token_ids").set_index("doc_id")
    start = 0
    for i, text in documents.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        assert tuple(got.loc[i]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_pipeline_stages(spark, duck, documents, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    rows = lambda df: {r["doc_id"]: r for r in df.toPandas().to_dict("records")}

    one = stage["quality"](spark, docs, SF)
    assert one.columns == columns
    scored = result(spark, "op3_quality").set_index("doc_id")["predicted"]
    kept = rows(one)
    assert set(kept) == set(scored[scored == 1].index)

    def again(found):
        return spark.createDataFrame(pd.DataFrame(list(found.values()))[columns], docs.schema)

    two = stage["near_duplicates"](spark, again(kept), SF)
    want = joined(sets_of({i: r["text"] for i, r in kept.items()}))
    assert two.columns == columns and set(rows(two)) == {i for i, c in want.items() if i == c}

    kept = rows(two)
    three = stage["repeated_passages"](spark, again(kept), SF)
    left = removed({i: r["text"] for i, r in kept.items()})
    found = rows(three)
    assert three.columns == columns and set(found) == set(kept)
    for i, r in found.items():
        assert r["text"] == left[i][3].decode("utf-8", "ignore") and r["n_chars"] == len(r["text"])

    four = stage["decontamination"](spark, again(found), SF)
    items = [r[0] for r in duck.execute("SELECT text FROM benchmark").fetchall()]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(AZ))
    windows = {tuple(w[k : k + 13]) for w in map(words, items) for k in range(max(1, len(w) - 12))}
    clean = set()
    for i, r in found.items():
        w = words(r["text"])
        hit = set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
        if not hit or 20 * len(hit) < len(w):
            clean.add(i)
    assert four.columns == columns and set(rows(four)) == clean

    five = rows(stage["tokens"](spark, four, SF))
    assert set(five) == clean
    for i in list(clean)[:40]:
        assert five[i]["n_tokens"] == len(library.encode(found[i]["text"], add_special_tokens=False).ids)


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
