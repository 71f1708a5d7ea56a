"""Alignment of tokenizers, spelling variants and URL filters on odd tables and against brute force."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sparktab.llm import alignment, bpe, spellings, urls, words
from sparktab.llm.bpe import printable_bytes
from tests.conftest import SF

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Alignment


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    sign = {c: i for i, c in enumerate(printable_bytes())}
    vocab = json.load(open(public_tokenizers.path("byte_bpe_50k.json")))["model"]["vocab"]
    raw_a = {i: bytes(sign[c] for c in t) for t, i in vocab.items() if all(c in sign for c in t)}
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def raw_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    return lambda t: [(i, raw_a[i]) for i in a.encode(t, add_special_tokens=False).ids], lambda t: [(i, raw_b(i)) for i in b.encode(t)]


def spans(tokens):
    at, out = 0, []
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute_alignment(texts, sides):
    """Rows as the contract words them, token by token and without any chunks."""
    docs = []
    for t in texts:
        a, b = (sides[0](" " + t), sides[1](t)) if t else ([], [])
        whole = all(b"".join(raw for _, raw in x) == (" " + t).encode() for x in (a, b)) if t else False
        a, b = (spans(a), spans(b)) if whole else ([], [])
        ends = sorted({y for *_, y in a} & {y for *_, y in b})
        groups, before = [], 0
        for e in ends:
            groups.append([[i for i, x, y in side if before <= x and y <= e] for side in (a, b)])
            before = e
        links = [(i, j) for i, x, y in a for j, u, v in b if x < v and u < y]
        docs.append((a, b, groups, links))
    count = Counter(p for *_, links in docs for p in set(links))
    best = {}
    for (i, _), n in count.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for a, b, groups, links in docs:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(said.encode()).hexdigest() if a else ""
        top = sum(count[p] == best[p[0]] for p in links)
        out.append((len(a), len(b), len(groups), len(links), top, sum(count[p] for p in links), digest))
    return out


ODD = [
    None, "", " ", "  ", "a", "foo  bar", " lead", "trail \n", "tab\tand\nline\n\n end", "a▁b", "▁", "x\u0000y", "\ufeffbom",
    "<|endoftext|> <s> </s> <0x41> <unk>", "naïve café “quotes” — ½ ﬁ", "日本語 テキスト", "😀 👩‍👩‍👧 x", "it's we've I'll", "1234567 3.14",
    "\u3000wide\u00a0space \u2028line", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "aaa aaa", "the the the", "the the the", "    four", "a    b     c",
    "x \u00a0 y", "\r\n \r\n", "Ünïcödé " * 40, "e\u0301 a\u0308", "\u200b zero", "🏳️‍🌈" * 5 + " end",
]


def alignment_rows(df):
    return [tuple(r) for r in df.orderBy("doc_id").collect()]


def test_alignment_of_odd_texts(spark, sides):
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(ODD)], "doc_id int, text string, n_links string").repartition(3)
    got = alignment_rows(alignment.align_texts(df, "doc_id", "text"))
    assert got == [(i, *row) for i, row in enumerate(brute_alignment(ODD, sides))]


def test_alignment_query(spark, duck, sides):
    rows = duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    rows = [(i, t) for i, t in rows]
    got = alignment_rows(alignment.op11_alignment(spark, SF))
    long = [len(t or "") > 6000 for _, t in rows]
    if any(long):
        # The brute force below is quadratic in a text; long ones are checked by their library counts.
        for (i, t), skip, row in zip(rows, long, got, strict=True):
            if skip:
                assert (row[0], row[1], row[2]) == (i, len(sides[0](" " + t)), len(sides[1](t)))
    short = [(i, t) for (i, t), skip in zip(rows, long, strict=True) if not skip]
    df = spark.createDataFrame(short, "doc_id long, text string")
    got = alignment_rows(alignment.align_texts(df, "doc_id", "text"))
    assert got == [(i, *row) for (i, _), row in zip(short, brute_alignment([t for _, t in short], sides), strict=True)]


def test_alignment_cache_and_lots(spark, sides, monkeypatch):
    texts = [t for t in ODD if t]
    df = spark.createDataFrame(list(enumerate(texts * 2)), "doc_id int, text string").coalesce(1)
    want = [(i, *row) for i, row in enumerate(brute_alignment(texts * 2, sides))]
    monkeypatch.setattr(alignment, "MOST", 3)
    assert alignment_rows(alignment.align_texts(df, "doc_id", "text")) == want


def test_alignment_without_rows_and_ids(spark, sides):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_texts(empty, "doc_id", "text").count() == 0
    twice = spark.createDataFrame([(None, "the cat"), (None, "the cat"), (1, "the cat")], "doc_id long, text string")
    got = alignment.align_texts(twice, "doc_id", "text").collect()
    want = brute_alignment(["the cat"] * 3, sides)[0]
    assert sorted(str(r[0]) for r in got) == ["1", "None", "None"] and {tuple(r)[1:] for r in got} == {want}


# Spelling variants


def brute_words(rows):
    counts = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(v, w):
    if len(v) == len(w):
        return sum(a != b for a, b in zip(v, w, strict=True)) == 1
    if abs(len(v) - len(w)) != 1:
        return False
    v, w = sorted((v, w), key=len)
    return any(w[:i] + w[i + 1 :] == v for i in range(len(w)))


def brute_groups(counts):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if v != w and one_edit(v, w)]
        top = min(near, key=lambda v: (-counts[v], v), default=None)
        out[w] = (n, len(near), top if top and counts[top] >= 2 * n else None)
    roots = {}
    for w in out:
        at = w
        while out[at][2]:
            at = out[at][2]
        roots[w] = at
    return {w: (n, k, f, counts[f] if f else None, roots[w]) for w, (n, k, f) in out.items()}


def spelling_rows(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


def test_words_of_odd_texts(spark):
    rows = [(i, t) for i, t in enumerate([None, "", "HELLO hello Hello", "Àéîõü " * 3, "×÷×÷× " * 4, "don't stop" * 3, "x1y2 " * 9, "ÄÖÜäö " * 3])]
    rows += [(None, "words words words"), (5, "again again again"), (5, "again")] + [(i, "misspelling accommodate separate") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r["word"]: r["n"] for r in spellings.word_counts(df, "doc_id", "text").collect()}
    assert got == brute_words(rows)


def test_spellings_of_runs_ties_and_chains(spark):
    counts = {
        "aaaaa": 5, "aaaaaa": 11, "aaaaaaa": 30, "abcde": 4, "abcdf": 8, "abcdg": 8, "abcdef": 8, "bcdef": 3, "abbbbbc": 3, "abbbbc": 9,
        "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzz": 3, "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz": 7, "q" * 70: 3, "q" * 35 + "r" + "q" * 34: 9, "lonely": 3, "ÀÀÀÀÀ": 3, "ÀÀÀÀ\U0001f600": 6,
    }
    df = spark.createDataFrame(list(counts.items()), "word string, n int")
    assert spelling_rows(spellings.group_spellings(df)) == brute_groups(counts)


@pytest.mark.parametrize("hot, block", [(4096, 128), (3, 2), (7, 5)])
def test_spellings_of_crowded_words(spark, monkeypatch, hot, block):
    monkeypatch.setattr(spellings, "HOT", hot)
    monkeypatch.setattr(spellings, "BLOCK", block)
    letters = "abé"
    words = ["".join((x, y, z, v, u)) for x in letters for y in letters for z in "ab" for v in letters for u in letters]
    words += [w + "a" for w in words[::3]] + [w[:2] + "b" + w[2:] for w in words[::7]]
    counts = {w: 3 + zlib.crc32(w.encode()) % 40 for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert spelling_rows(spellings.group_spellings(df)) == brute_groups(counts)


def test_spellings_without_words(spark):
    df = spark.createDataFrame([(1, "ab c"), (2, None)], "doc_id int, text string")
    assert spellings.group_spellings(spellings.word_counts(df, "doc_id", "text")).count() == 0
    with pytest.raises(ValueError):
        spellings.group_spellings(df, factor=1)


# URL filters


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :]).group()


def brute_rule(host, path):
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://EXAMPLE.NET/en/1", "http://a.example.net/EN/1", "https://x.org/fr/2?q=/de/#y", "http://x.org?fr/",
    "http://x.net", "http://x.net/", "http://evilnet/", "http://net/", "ftp://sub.example.com/de/", "http://example.com/de", "http://u@example.net/en/",
    "a://b://c.net/x", "http://ÀB.net/é", "http://x.org//fr/", "http://x.org/" + "deep/" * 60, "http://x.org/*/**/", "http://x.org/" + "l" * 100_000,
    "http://host/a\nb/c?d", "http://x.example.net:80/en/", "http://İ.net/",
]


def test_urls_rules_and_parts(spark):
    rows = [(i, u, "own", 1) for i, u in enumerate(URLS)] + [(None, "http://x.net/", "own", 1), (0, "http://x.net/", "own", 1), (0, "http://x.net/", "own", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string, segs int")
    got = urls.judge_urls(df, "page_id", "url", urls.RULES).collect()
    want = Counter()
    for i, u, *_ in rows:
        host, path = brute_parts(u)
        rule = brute_rule(host, path)
        want[i, host, path, rule.text if rule else None] += 1
        for r in got:
            if (r["id"], r["host"], r["path"]) == (i, host, path) and rule:
                assert r["verdict"] == rule.verdict
    assert Counter((r["id"], r["host"], r["path"], r["rule"]) for r in got) == want
    assert all(r["verdict"] == "allow" for r in got if r["rule"] is None)


def test_urls_templates_carry_labels(spark):
    rules = [urls.Rule("block", "h", "/bad/1"), urls.Rule("allow", "h", "/good/1")]
    paths = [f"/bad/1{i}" for i in range(60)] + [f"/bad/2{i}" for i in range(60)]
    paths += [f"/good/1{i}" for i in range(60)] + [f"/good/2{i}" for i in range(60)] + [f"/new/{i}" for i in range(60)]
    df = spark.createDataFrame([(i, "http://h" + p) for i, p in enumerate(paths)], "id long, url string")
    got = {r["path"]: r for r in urls.judge_urls(df, "id", "url", rules).collect()}
    assert {r["verdict"] for p, r in got.items() if p.startswith("/bad/")} == {"block"}
    assert {r["verdict"] for p, r in got.items() if not p.startswith("/bad/")} == {"allow"}
    assert {r["template"] for r in got.values()} == {"/bad/*", "/good/*", "/new/*"}


def test_urls_merge_branches_that_are_alike(spark):
    rules = [urls.Rule("block", "h", f"/{x}/1") for x in ("ab", "cd")]
    paths = [f"/{x}/{k}{i}" for x in ("ab", "cd", "ef") for k in (1, 2) for i in range(10)]
    df = spark.createDataFrame([(i, "http://h" + p) for i, p in enumerate(paths)], "id long, url string")
    got = {r["path"]: r for r in urls.judge_urls(df, "id", "url", rules).collect()}
    # Two branches are half labelled and judged as one; the third has no labels and stays apart.
    assert got["/ab/20"]["n_labelled"] == got["/cd/20"]["n_labelled"] == 20
    assert got["/ef/20"]["n_labelled"] == 0 and got["/ef/20"]["verdict"] == "allow" and got["/ab/20"]["verdict"] == "block"


def test_urls_without_rows_or_rules(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge_urls(empty, "page_id", "url", urls.RULES).count() == 0
    one = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    assert [tuple(r) for r in urls.judge_urls(one, "page_id", "url", []).collect()] == [(1, "x.net", "/", None, "allow", "/*", 0, 0)]


def test_urls_run_no_python(spark):
    plan = urls.judge_urls(spark.read.parquet(f"{SF}/pages.parquet"), "page_id", "url", urls.RULES)
    said = plan._jdf.queryExecution().toString()
    assert "Python" not in said and "Arrow" not in said and "Cartesian" not in said and "NestedLoop" not in said


# Words of the BPE operators


@pytest.mark.parametrize("form", ["{0}", "{0}{0}", "a'{0}b", "e{0}\u0323\u0301", "x{0}\u0345"])
def test_words_of_every_code_point(form):
    source = bpe.vocabulary()
    library, model = Tokenizer.from_str(source), bpe.Model(source)
    splitter, codes = words.Splitter(model.specials, words.character_kinds()), words.WordCodes(model.encode)
    every = [form.format(chr(i)) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for start in range(0, len(every), 100_000):
        texts = [" ".join(every[k : k + 100]) for k in range(start, min(start + 100_000, len(every)), 100)]
        found = splitter.split(texts)
        rows = codes.codes(found)
        flat = codes.ids[bpe.ragged_rows(codes.offsets, rows)]
        at = np.append(0, np.cumsum(np.diff(codes.offsets)[rows]))[found.bounds].tolist()
        want = library.encode_batch_fast(texts, add_special_tokens=False)
        for i, e in enumerate(want):
            assert e.ids == flat[at[i] : at[i + 1]].tolist(), ascii(texts[i])
