"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, no rows, clashing names."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import sparktab.llm as llm
from sparktab.llm import (
    ann,
    bpe,
    common,
    decontaminate,
    idfiles,
    licenses,
    quality,
    shards,
    similar,
    suffixes,
    warc,
    words,
)
from sparktab.session import scratch_path

llm.load_all()
DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def docs_of(spark, rows, schema=DOCS, parts=3):
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows] if schema == DOCS else rows
    return spark.createDataFrame(full, schema).repartition(parts)


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice("abcdefgh") + str(rng.randrange(10**6)) for _ in range(n))


# WARC


def test_warc_round_trip_with_odd_rows(spark):
    big = "x" * 300_000
    rows = [(5, "http://a/ b\r\né", big), (3, "http://b", big), (9, None, None), (9, None, None), (None, "u", big),
            (4, "u", ""), (7, "u", "short"), (8, "u", "short"), (3, "http://b", big), (-2, "u", "y" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("PAYLOAD", F.lit(1))
    path = scratch_path(spark, "warc")
    warc.write_warc(warc.archive_records(pages, "page_id", "url", "html"), path, splitbytes=1000, filebytes=200_000)
    back = warc.read_warc(spark, path)
    got = sorted(
        (r["record_type"], r["id"], r["to"], r["payload_bytes"], r["payload_digest"], None if r["payload"] is None else bytes(r["payload"]))
        for r in back.withColumn("id", F.coalesce(warc.key_of(F.col("record_id")), F.lit(-99)))
        .withColumn("to", F.coalesce(warc.key_of(F.col("refers_to")), F.lit(-99))).collect()
    )
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        again = html == big and i != 3
        want.append(("revisit" if again else "response", -99 if i is None else i, 3 if again else -99, len(body), hashlib.sha256(body).hexdigest(), None if again else body))
    assert got == sorted(want)
    only = warc.read_warc(spark, path).where("record_type = 'revisit' AND target_uri IS NOT NULL")
    assert "record_type" not in only.drop("record_type").columns and only.count() == 2
    heads = warc.read_warc(spark, path, "record_id string, payload_bytes long").where(F.col("record_id").startswith("urn:uuid:"))
    assert heads.agg(F.sum("payload_bytes")).first()[0] == sum(r[3] for r in want)


def test_warc_reader_tests_headers_and_skips_payloads():
    rows = [{"record_id": f"urn:{i}", "record_type": "response" if i % 3 else "revisit", "target_uri": "http://x", "refers_to": "urn:0",
             "payload_digest": "ab", "payload_bytes": 2 * i, "payload": ("é" * i).encode()} for i in range(0, 9000, 300)]
    import gzip
    import io

    own = b"".join(warc.member(warc.record_bytes(r), 1) for r in rows)
    for data in (own, b"".join(gzip.compress(warc.record_bytes(r)) for r in rows), b"".join(map(warc.record_bytes, rows))):
        for tests in ([], [("in", "record_type", ("response",))], [("null", "refers_to", None)]):
            for payloads in (True, False):
                found = list(warc.records(warc.Window(io.BytesIO(data), 5000), 0, len(data), tests, payloads))
                want = [r for r in rows if not tests or r["record_type"] == "response"]
                assert [h["warc-record-id"] for h, _, _ in found] == [r["record_id"] for r in want]
                assert [n for _, n, _ in found] == [r["payload_bytes"] for r in want]
                if payloads:
                    assert [p for _, _, p in found] == [None if r["record_type"] == "revisit" else r["payload"] for r in want]


def test_warc_headers_of_any_length():
    import gzip
    import io

    def long_http(row, n):
        """The record with ``n`` more bytes in its HTTP header."""
        data = warc.record_bytes(row)
        size = int(data.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        data = data.replace(b"Content-Length: %d" % size, b"Content-Length: %d" % (size + n), 1)
        return data.replace(b"HTTP/1.1 200 OK\r\n", b"HTTP/1.1 200 OK\r\nX-A: " + b"x" * (n - 7) + b"\r\n", 1)

    noise = random.Random(5)
    for n in (*range(3500, 4200, 13), 6000, 20_000, 300_000):
        for url in ("u" * n, "".join(noise.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))):
            row = {"record_id": "urn:1", "record_type": "response", "target_uri": url, "refers_to": None,
                   "payload_digest": "ab", "payload_bytes": 12, "payload": b"some payload"}
            for plain in (warc.record_bytes(row), long_http(row | {"target_uri": "u"}, n)):
                for data in (warc.member(plain, 1), gzip.compress(plain), plain):
                    for payloads in (True, False):
                        found = list(warc.records(warc.Window(io.BytesIO(data), 5000), 0, len(data), [], payloads))
                        assert [(h["warc-record-id"], m, p) for h, m, p in found] == [("urn:1", 12, b"some payload" if payloads else None)]
                        assert found[0][0]["warc-target-uri"] == (url if plain[:400].count(b"X-A") == 0 else "u")
    for data in (warc.member(b"WARC/1.1\r\nWARC-Type: response\r\n", 1), b"WARC/1.1\r\nWARC-Type: response\r\n"):
        with pytest.raises(ValueError, match="header"):
            list(warc.records(warc.Window(io.BytesIO(data)), 0, len(data), [], True))


def test_warc_of_long_urls(spark):
    rows = [(i, "http://a/" + "x" * n, f"page {i}") for i, n in enumerate((3500, 3900, 4000, 4096, 6000, 20_000))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    path = scratch_path(spark, "warc")
    warc.write_warc(warc.archive_records(pages, "page_id", "url", "html"), path)
    back = {warc_row["target_uri"]: bytes(warc_row["payload"]).decode() for warc_row in warc.read_warc(spark, path).collect()}
    assert back == {u: h for _, u, h in rows}
    heads = warc.read_warc(spark, path, "target_uri string, payload_bytes long").collect()
    assert {r["target_uri"]: r["payload_bytes"] for r in heads} == {u: len(h) for _, u, h in rows}


def test_warc_pushes_predicates(spark):
    path = scratch_path(spark, "warc")
    pages = spark.createDataFrame([(1, "u", "a")], "page_id long, url string, html string")
    warc.write_warc(warc.archive_records(pages, "page_id", "url", "html"), path)
    plan = warc.read_warc(spark, path).where("record_type = 'response'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "Filter [" not in plan.replace("RuntimeFilters", "")


def test_warc_of_no_rows(spark):
    path = scratch_path(spark, "warc")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(warc.archive_records(pages, "page_id", "url", "html"), path)
    assert warc.read_warc(spark, path).count() == 0


# Shards


def test_shards_are_contiguous_and_even(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["", "a", "b" * 50])) for i in range(500)] + [(7, "a")] * 300 + [(None, None), (None, "z"), (3, "w" * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Shard", F.lit("?")).withColumn("range", F.lit(1))
    out = shards.shard_by_bytes(df, "doc_id", shards.text_size(F.col("text")), F.crc32(F.coalesce("text", F.lit("")).cast("binary")), 7)
    got = out.toPandas()
    assert len(got) == len(rows) and got["size"].sum() == sum(len(t or "") + 8 for _, t in rows)
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    got = got.sort_values(["shard", "slot"])
    assert got["id"].fillna(-1).is_monotonic_increasing
    assert (got.groupby("shard")["size"].sum() - got["size"].sum() / 7).abs().max() <= 9008


def test_shards_of_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert shards.shard_by_bytes(df, "doc_id", shards.text_size(F.col("text")), F.lit(0), 3).count() == 0


def test_shards_run_no_python(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = shards.shard_by_bytes(df, "doc_id", shards.text_size(F.col("text")), F.lit(0), 3)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Quality


def test_class_prior_and_risk_on_two_clouds():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0, 1, (6000, 3)), rng.normal([4, 0, 0], 1, (6000, 3))
    web = np.concatenate([good[:2100], bad[:900]])
    scorer, prior = quality.fit(good[3000:].astype(np.float32), web.astype(np.float32))
    assert abs(prior - 0.7) < 0.08
    assert (scorer.score(good[:3000]) >= 0.5).mean() > 0.93 and (scorer.score(bad[3000:]) < 0.5).mean() > 0.8


def test_quality_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "   \n "), (4, "é" * 50_000), (5, prose(80, 1)), (5, prose(80, 1)), (None, "a b"), (6, "!!!")]
    docs = docs_of(spark, rows).withColumn("Score", F.lit("old"))
    labels = spark.createDataFrame([(5, 1), (5, 1), (99, 0), (None, 1)], "doc_id long, quality int")
    out = quality.score_quality(docs, labels)
    got = out.toPandas()
    assert len(got) == len(rows) and got["score"].between(0, 1).all()
    assert [c for c in out.columns if c.lower() == "score"] == ["score"]
    assert quality.score_quality(docs.limit(0), labels.limit(0)).count() == 0


def test_measures_cut_texts_apart():
    texts = [b"AB ab ab!", b"", b"ab", b"x" * 200 + b" y"]
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    whole = quality.measures(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for i, t in enumerate(texts):
        alone = quality.measures(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert np.allclose(whole[i], alone[0], atol=1e-5)


# Licenses


def test_patience_aligns_gaps():
    a = "x the cat sat on the mat y".split()
    b = "the cat lay on the mat".split()
    pairs = licenses.patience(a, b)
    assert [a[i] for i, _ in pairs] == ["the", "cat", "on", "the", "mat"]
    assert pairs == sorted(pairs) and all(a[i] == b[j] for i, j in pairs)
    assert licenses.longest_rise([3, 1, 2, 9, 4, 5]) == [1, 2, 4, 5]
    assert licenses.patience([], [1]) == [] and licenses.patience([1, 1], [1, 1, 1]) == [(0, 0), (1, 1)]


def test_license_of_odd_texts(spark):
    mit = licenses.TEMPLATES["MIT"]
    rows = [(1, None), (2, ""), (3, f"{prose(3000, 2)} {mit.upper()} {prose(3000, 3)}"), (4, "Released under\nthe  MIT license"),
            (4, "Released under\nthe  MIT license"), (None, mit.replace("copy", "steal"))]
    got = licenses.scan_licenses(docs_of(spark, rows).withColumn("LICENSE", F.lit(0)), "text").toPandas().sort_values("doc_id")
    by = {(-1 if i != i else int(i)): x for i, x in zip(got["doc_id"], got["license"], strict=True)}
    assert by == {1: None, 2: None, 3: "MIT", 4: "MIT-line", -1: "MIT"} and len(got) == len(rows)
    assert licenses.scan_licenses(docs_of(spark, rows).limit(0), "text").count() == 0


def common_words(a, b):
    """Length of a longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def test_license_that_a_text_holds_more_than_once(spark):
    line, mit, notice = (licenses.TEMPLATES[n] for n in ("MIT-line", "MIT", "Apache-2.0-notice"))
    changed = mit.replace("sublicense", "sell on").replace("persons", "folk")
    scattered = " ".join(sorted(set(notice.lower().split())) * 3)
    texts = [f"foo bar {line} {prose(20, 1)} {line} the end", f"{mit} {mit}", f"{notice}\n{prose(400, 2)}\n{notice}\n{prose(9, 3)} {notice}",
             f"{prose(50, 4)} {changed} {changed} {prose(50, 5)} {changed}", f"{scattered} {prose(30, 6)} {notice} {scattered}",
             # Each copy is longer than the template by half.
             " ".join(f"{w} {i if i % 2 else ''}" for i, w in enumerate(mit.split())) + " and " + " ".join(f"{w} {i if i % 2 else ''}" for i, w in enumerate(mit.split())),
             f"{prose(50, 7)} {' '.join(mit.split()[:50])} {' '.join(mit.split()[:50])}"]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs_of(spark, list(enumerate(texts))), "text").collect()}
    words = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    names = ["MIT-line", "MIT", "Apache-2.0-notice", "MIT", "Apache-2.0-notice", "MIT", None]
    for i, (text, name) in enumerate(zip(texts, names, strict=True)):
        assert got[i]["license"] == name
        if name:
            template = words(licenses.TEMPLATES[name])
            most = common_words(words(changed) if i == 3 else template, template)
            # Alignment by anchors leaves some repeated words over where foreign words lie between them.
            assert 0.95 * most <= got[i]["n_matched"] <= most if i == 5 else got[i]["n_matched"] == most
            assert got[i]["coverage"] == pytest.approx(got[i]["n_matched"] / len(template))
            assert common_words(words(text)[got[i]["first_word"] : got[i]["last_word"] + 1], template) >= got[i]["n_matched"]
    assert (got[0]["first_word"], got[0]["last_word"]) == (2, 6) and got[1]["first_word"] == 0
    # 28 of 35 words are 0.8 of them, though 0.8 * 35 is a little more than 28.
    own = {"own": " ".join(f"w{i}" for i in range(35))}
    some = docs_of(spark, [(1, " ".join(f"w{i}" for i in range(28)))])
    assert licenses.scan_licenses(some, "text", own).first()["license"] == "own"


# Nearest neighbours


def exact(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = {}
    for q, v in good:
        if q % 10 == 0:
            near = [(-(v @ w) / np.sqrt((v @ v) * (w @ w)), j) for j, w in good if j != q]
            out[q] = sorted(near)[:k]
    return out


def test_nearest_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=8)]) for i in range(400)]
    rows += [(i, [1.0] * 8) for i in range(400, 700)]
    rows += [(1000, None), (1010, []), (1020, [0.0] * 8), (1030, [1.0] * 7 + [None]), (1040, [float("nan")] * 8), (1050, [float("inf")] + [1.0] * 7), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, v array<float>").withColumn("LIST", F.lit(1))
    got = ann.nearest(df, "vec_id", "v", F.col("vec_id") % 10 == 0, k=5, lists=6, probes=6).toPandas()
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    want = exact(rows, 5)
    assert set(got["query_id"]) == set(want)
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        assert np.allclose(part["score"], [-s for s, _ in want[q]], atol=1e-9)
        if 400 <= q < 700:
            assert part["vec_id"].tolist() == [j for j in range(400, 407) if j != q][:5]


def test_nearest_with_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, v array<double>")
    got = ann.nearest(df, "vec_id", "v", F.col("vec_id") == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, 0.0)]
    assert ann.nearest(df.limit(0), "vec_id", "v", F.col("vec_id") == 0).count() == 0


# Tokens


ALPHABET = "abcdefgh  's't're've'll'd'm''  .,!?\n\t\x0b\x1c\x85\xa0éÀßñİΣσ你好😀٣½Ⅷ̸́>日本'"


def odd_texts(n=300):
    rng = random.Random(5)
    texts = [None, "", "a", "don't we'll I'd 's !'s ''s 'should", " <|endoftext|>x<|startoftext|≯ ", "aaaaaaa", "a" * 3000, prose(4000, 9), "HELLO 12345"]
    return texts + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_bpe_same_as_library_on_odd_texts(spark, library):
    texts = odd_texts()
    df = docs_of(spark, list(enumerate(texts))).withColumn("IDS", F.lit(0))
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in bpe.encode_texts(df, "text", bpe.vocabulary()).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i] == (ids, library.decode(ids, skip_special_tokens=False))
    assert bpe.encode_texts(df.limit(0), "text", bpe.vocabulary()).count() == 0


def ids_of(codes, found):
    rows = codes.codes(found)
    return codes.ids[bpe.ragged_rows(codes.offsets, rows)]


def test_word_table_starts_again_when_full_or_wrong():
    model = bpe.Model(bpe.vocabulary())
    splitter = words.Splitter(model.specials, words.character_kinds())
    small, large = words.WordCodes(model.encode, most=3), words.WordCodes(model.encode)
    for text in (prose(40, 1), prose(40, 2), prose(40, 1)):
        found = splitter.split([text, "", text])
        assert np.array_equal(ids_of(small, found), ids_of(large, found))
    found = splitter.split([prose(30, 7)])
    want = ids_of(large, found)
    large.checks = large.checks + np.uint64(1)
    assert np.array_equal(ids_of(large, found), want) and large.seed > 0


def test_variable_length_codes():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 9, 200)
    numbers = (rng.integers(0, 1 << 32, counts.sum(), dtype=np.uint64) >> rng.integers(0, 32, counts.sum(), dtype=np.uint64)).astype(np.uint32)
    control, data, sizes = idfiles.code_numbers(numbers, counts)
    assert sizes.sum() == len(data) and len(control) == ((counts + 3) // 4).sum()
    assert np.array_equal(idfiles.decode_numbers(control, data, counts), numbers)


def test_token_files_of_odd_texts(spark, library):
    rows = [(7 * i % 101, t) for i, t in enumerate(odd_texts(60))] + [(None, "null id"), (5, "again"), (5, "again")]
    path = scratch_path(spark, "idfiles")
    idfiles.write_ids(docs_of(spark, rows), "doc_id", "text", path)
    got = idfiles.read_ids(spark, path).collect()
    want = sorted(((-1 if i is None else i), [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows)
    assert sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["ids"]) for r in got) == want
    got.sort(key=lambda r: r["start"])
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert ids == sorted(ids) and [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    raw = idfiles.read_ids(spark, path, "n_tokens long, ids_le binary").collect()
    assert sum(zlib.crc32(r["ids_le"]) for r in raw) == sum(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got)
    empty = scratch_path(spark, "idfiles")
    idfiles.write_ids(docs_of(spark, rows).limit(0), "doc_id", "text", empty)
    assert idfiles.read_ids(spark, empty).count() == 0


# Repeats


def test_suffix_ranks_against_sorting():
    rng = np.random.default_rng(1)
    for trial in range(300):
        n = int(rng.integers(1, 50))
        s = rng.integers(1, rng.integers(2, 5), n)
        s = np.tile(s[: max(1, n // 4)], 5) if trial % 3 == 0 else s
        tails = [s[i:].tolist() for i in range(len(s))]
        assert suffixes.suffix_ranks(s).tolist() == [sorted(tails).index(t) + 1 for t in tails]


def test_suffix_ranks_sort_by_counting(monkeypatch):
    """Sorts see 16-bit digits only, of each sampled suffix once a level; keys too wide for 64 bits are joined in steps."""
    rng = np.random.default_rng(2)
    text = np.tile(rng.integers(1, 257, 700), 3)
    wide = rng.integers(1, 1 << 31, 300)
    wide[100:150] = wide[200:250]
    sorted_by = []
    plain = np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, *args, **kw: sorted_by.append((a.dtype, len(a))) or plain(a, *args, **kw))
    got = [suffixes.suffix_ranks(s).tolist() for s in (text, wide)]
    monkeypatch.undo()
    assert {kind for kind, _ in sorted_by} == {np.dtype(np.uint16)}
    for s, ranks in zip((text, wide), got, strict=True):
        tails = [s[i:].tolist() for i in range(len(s))]
        place = {i: n + 1 for n, i in enumerate(sorted(range(len(s)), key=lambda i: tails[i]))}
        assert ranks == [place[i] for i in range(len(s))]


@pytest.mark.parametrize("small", [False, True])
def test_repeats_on_odd_texts(spark, monkeypatch, small):
    from tests.llm.test_queries import removed

    if small:  # many hand-overs and many arrays
        monkeypatch.setattr(suffixes, "GATHER", 50)
        monkeypatch.setattr(suffixes, "STRETCHES", 500)
        monkeypatch.setattr(suffixes, "ARRAY_BYTES", 300)
    rng = random.Random(4)
    hot = prose(30, 8)
    texts = {i: " ".join([prose(rng.randrange(12), i), hot[rng.randrange(60) :], "é" * rng.randrange(60), prose(5, i % 3)]) for i in range(60)}
    texts |= {100: "", 101: "x" * 49, 102: "x" * 50, 103: "x" * 400, 104: hot, 105: hot, 106: "x" * 49, 107: "ab" * 300, 108: "b" + "ab" * 40}
    rows = [*texts.items(), (200, None)]
    df = docs_of(spark, rows).withColumn("KEPT", F.lit("?"))
    got = {r["doc_id"]: r for r in suffixes.remove_repeats(df, "doc_id", "text").collect()}
    for i, (n, gone, runs, left) in removed(texts | {200: ""}).items():
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept"])) == (n, gone, runs, left)


def test_repeats_around_a_hot_passage_meet_in_many_parts(spark, monkeypatch):
    from sparktab.llm.common import unpack
    from tests.llm.test_queries import removed

    hot = prose(10, 8)
    texts = {i: f"{prose(3, 2 * i)}{hot}{prose(3, 2 * i + 1)}" for i in range(300)}
    texts |= {1000 + i: t[5:-5] for i, t in texts.items() if i % 7 == 0}
    monkeypatch.setattr(suffixes, "HOT", 100)
    seen = {}

    def largest(stretches, least):
        sizes = {}
        for r in stretches.collect():
            own, _, _, places, *_ = unpack(r["blob"], np.uint32, np.uint16, np.uint8, np.uint32, np.int64, np.int64, np.uint32)
            sizes[r["bucket"]] = sizes.get(r["bucket"], 0) + int(own.sum())
        seen["share"] = max(sizes.values()) / sum(sizes.values())
        return spans(stretches, least)

    spans = suffixes.repeated_spans
    monkeypatch.setattr(suffixes, "repeated_spans", largest)
    monkeypatch.setattr(suffixes, "width", lambda _: 64)
    got = {r["doc_id"]: r for r in suffixes.remove_repeats(docs_of(spark, list(texts.items())), "doc_id", "text").collect()}
    for i, (n, gone, runs, left) in removed(texts).items():
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept"])) == (n, gone, runs, left)
    assert seen["share"] < 0.1


def test_repeats_of_equal_and_null_ids(spark):
    long = prose(40, 1)
    rows = [(1, long), (1, long), (2, long), (None, long), (None, long + "!")]
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_removed"]) for r in suffixes.remove_repeats(docs_of(spark, rows), "doc_id", "text").collect())
    n = len(long)
    assert got == [(-1, n), (-1, n), (1, 0), (1, 0), (2, n)]
    assert suffixes.remove_repeats(docs_of(spark, rows).limit(0), "doc_id", "text").count() == 0


# Similarity


def test_divide_skip_against_counting():
    rng = random.Random(6)
    for _ in range(200):
        lists = [sorted(rng.sample(range(30), rng.randrange(1, 25))) for _ in range(rng.randrange(1, 12))]
        least = rng.randrange(1, len(lists) + 2)
        count = {m: sum(m in x for x in lists) for m in range(30)}
        member, times = similar.divide_skip([np.array(x) for x in lists], least)
        assert dict(zip(member.tolist(), times.tolist(), strict=True)) == {m: c for m, c in count.items() if c >= least}


@pytest.mark.parametrize("small", [False, True])
def test_similar_on_families(spark, monkeypatch, small):
    from tests.llm.test_queries import joined, sets_of

    if small:
        monkeypatch.setattr(similar, "GATHER", 100)
        monkeypatch.setattr(similar, "PART", 7)
    rng = random.Random(7)
    texts = {}
    for family in range(6):
        base = prose(60 + 20 * family, family).split()
        for copy in range(25):
            own = list(base)
            for _ in range(rng.randrange(6)):
                own[rng.randrange(len(own))] = f"w{rng.randrange(50)}"
            texts[len(texts) * 3 % 1009] = " ".join(own) + ("\n" if copy % 2 else "")
    texts |= {2000: "", 2001: " \t", 2002: "One Two", 2003: "one  two", 2004: "one", 2005: "a b c d e", 2006: "A B C D E", 2007: "a b c d e f"}
    chain = prose(200, 99).split()
    for i in range(12):  # each links to the next, the ends don't
        texts[3000 + i] = " ".join(chain[6 * i : 6 * i + 110])
    rows = [*texts.items(), (4000, None)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar.similar_groups(docs_of(spark, rows), "doc_id", "text").collect()}
    sets = sets_of(texts | {4000: ""})
    want = joined(sets)
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}


def test_similar_with_equal_and_null_ids(spark):
    a, b = prose(50, 1), prose(50, 2)
    rows = [(5, a), (5, b), (7, a + " x"), (3, b + " y"), (None, a), (7, a + " x")]
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["component_id"]) for r in similar.similar_groups(docs_of(spark, rows), "doc_id", "text").collect())
    assert got == [(-1, 5), (3, 3), (5, 3), (5, 5), (7, 5), (7, 5)]
    assert similar.similar_groups(docs_of(spark, rows).limit(0), "doc_id", "text").count() == 0


def test_similar_through_null_ids(spark):
    words = prose(132, 5).split()
    left, middle, right = (" ".join(words[k : k + 110]) for k in (0, 10, 20))
    alone = prose(60, 9)
    for bridge in (3, None):
        rows = [(1, left), (2, right), (bridge, middle), (bridge, middle), (None, alone), (None, alone + " x")]
        got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in similar.similar_groups(docs_of(spark, rows), "doc_id", "text").collect())
        if bridge:
            assert got == [(0, 0), (0, 0), (1, 1), (2, 1), (3, 1), (3, 1)]
        else:
            assert got == [(0, 0), (0, 0), (0, 1), (0, 1), (1, 1), (2, 1)]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 300)] + [(500, 500)] + [(7, 6)]
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 300)}


# Benchmark


def test_wu_manber_against_find():
    rng = random.Random(8)
    for trial in range(60):
        letters = "ab " if trial % 2 else "abcdefghij "
        data = "".join(rng.choice(letters) for _ in range(3000)).encode()
        patterns = list({"".join(rng.choice(letters) for _ in range(rng.randrange(*((3, 6) if trial % 2 else (9, 17))))).encode() for _ in range(20)})
        patterns += [p for p in {data[a : a + len(patterns[0])] for a in range(0, 2000, 400)} if p not in patterns]
        start, number = decontaminate.WuManber(patterns).search(data, decontaminate.Block8(data), stretch=100)
        got = sorted(zip(start.tolist(), number.tolist(), strict=True))
        want = sorted((i, k) for k, p in enumerate(patterns) for i in range(len(data)) if data.startswith(p, i))
        assert got == want


@pytest.mark.parametrize("group_bytes", [1 << 20, 40])
def test_benchmark_on_odd_texts(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(decontaminate, "GROUP_BYTES", group_bytes)
    item = " ".join(f"word{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (2, "Just, two"), (None, "é"), (3, ""), (4, None), (5, "..."), (1, item), (10, item)], "item_id long, text string")
    rows = [(1, None), (2, ""), (3, "..."), (4, item.upper()), (5, "x " * 1000 + " ".join(f"word{i}" for i in range(13))),
            (6, " ".join(f"word{i}" for i in range(12))), (7, "it's JUST two"), (8, "é-É"), (8, "é-É"), (9, "adjust two")]
    out = decontaminate.benchmark_hits(docs_of(spark, rows).withColumn("N_HIT", F.lit("?")), "text", bench, "item_id", "text")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in out.collect()}
    assert got == {
        1: (0, 0, [], False), 2: (0, 0, [], False), 3: (0, 0, [], False), 4: (20, 20, ["1", "10"], True),
        5: (1013, 13, ["1", "10"], False), 6: (12, 0, [], False), 7: (4, 2, ["2"], True), 8: (2, 1, [""], True), 9: (2, 0, [], False),
    }
    spans = {r["doc_id"]: r["hit_words"] for r in out.collect()}
    assert spans[4] == [[0, 19]] and spans[5] == [[1000, 1012]] and spans[7] == [[2, 3]]
    assert out.limit(0).count() == 0
