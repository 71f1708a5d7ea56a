"""Benchmark passages in documents, found by Wu-Manber multi-pattern search.

Texts are normalized to words with one space around each; the patterns are the benchmark's word
windows in the same form. For patterns of similar length a shift table tells, for the block of bytes
that ends at a position, how far the search may move on at once; a shift of zero names a bucket of
patterns by the block's hash, their first bytes are compared, then the whole pattern. The search
runs over many stretches of a buffer in step, so every step is a few numpy operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktab.llm.common import fresh, query, ragged, slices, table
from sparktab.session import spread

WINDOW = 13
SHARE = 20
#: Benchmark text searched for at once; a larger benchmark is searched for in several groups.
GROUP_BYTES = 2 << 20
TABLE_BITS = 22
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Lower-cases A-Z, keeps digits, letters and bytes beyond ASCII, makes all others a space.
CLEAN = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(CLEAN).split()


def windows(items: list[tuple[str, bytes]], size: int) -> dict[bytes, set[str]]:
    """Window (a space around each word) -> ids of the items that hold it."""
    found: dict[bytes, set[str]] = {}
    for item, text in items:
        words = words_of(text)
        k = min(size, len(words))
        for i in range(len(words) - k + 1 if k else 0):
            found.setdefault(b" " + b" ".join(words[i : i + k]) + b" ", set()).add(item)
    return found


class Block8:
    """Any eight bytes of a buffer as numbers; position p is the eight bytes before p."""

    def __init__(self, data: bytes) -> None:
        pad = -len(data) % 8 + 8
        self.lanes = np.frombuffer(bytes(8) + data + bytes(pad), "<u8")

    def before(self, p: np.ndarray) -> np.ndarray:
        q, r = p >> 3, ((p & 7) << 3).astype(np.uint64)
        return (self.lanes[q] >> r) | ((self.lanes[q + 1] << (np.uint64(63) - r)) << np.uint64(1))


class WuManber:
    """Search for patterns whose lengths lie within a factor of two."""

    def __init__(self, patterns: list[bytes]) -> None:
        self.patterns = patterns
        self.m = min(map(len, patterns))
        self.block = max(1, min(8, self.m // 2))
        self.drop = np.uint64(8 * (8 - self.block))
        data = b"".join(p[: self.m] for p in patterns)
        every = Block8(data)
        most = min(self.m - self.block + 1, 255)
        self.shift = np.full(1 << TABLE_BITS, most, np.uint8)
        starts = np.arange(len(patterns)) * self.m
        for j in range(self.block, self.m + 1):
            np.minimum.at(self.shift, self.hash(every.before(starts + j) >> self.drop), min(self.m - j, most))
        last = every.before(starts + self.m) >> self.drop
        self.order = np.argsort(last, kind="stable")
        self.last = last[self.order]
        self.head = every.before(starts + min(8, self.m))[self.order]

    def hash(self, block: np.ndarray) -> np.ndarray:
        return ((block * MULTIPLIER) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, data: bytes, view: Block8, stretch: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """(start, number of the pattern) of all occurrences."""
        n = len(data)
        if n < self.m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(self.m, n + 1, stretch)
        stop = np.minimum(at + stretch, n + 1)
        ends, blocks = [], []
        while len(at):
            block = view.before(at) >> self.drop
            shift = self.shift[self.hash(block)]
            hit = shift == 0
            if hit.any():
                ends.append(at[hit])
                blocks.append(block[hit])
            at = at + np.maximum(shift, 1)
            keep = at < stop
            if not keep.all():
                at, stop = at[keep], stop[keep]
        if not ends:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        end, block = np.concatenate(ends), np.concatenate(blocks)
        low, high = np.searchsorted(self.last, block), np.searchsorted(self.last, block, side="right")
        candidate = ragged(low, high - low)
        start = np.repeat(end - self.m, high - low)
        same = view.before(start + min(8, self.m)) == self.head[candidate] if self.m >= 8 else np.ones(len(start), bool)
        start, number = start[same], self.order[candidate[same]]
        sure = np.fromiter(
            (data.startswith(self.patterns[k], s) for s, k in zip(start.tolist(), number.tolist(), strict=True)),
            bool, len(start),
        )
        return start[sure], number[sure]


class Finder:
    """Search for all windows of some items, in groups of similar length."""

    def __init__(self, items: list[tuple[str, bytes]], size: int) -> None:
        by_window = windows(items, size)
        by_length: dict[int, list[bytes]] = {}
        for w in by_window:
            by_length.setdefault(len(w).bit_length(), []).append(w)
        self.parts = [WuManber(group) for _, group in sorted(by_length.items())]
        self.items = [[sorted(by_window[w]) for w in part.patterns] for part in self.parts]
        self.sizes = [np.array([w.count(b" ") - 1 for w in part.patterns], np.int64) for part in self.parts]

    def search(self, data: bytes, view: Block8) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
        """(starts, words of each, item ids of each), once for each group of lengths."""
        for part, items, sizes in zip(self.parts, self.items, self.sizes, strict=True):
            start, number = part.search(data, view)
            yield start, sizes[number], [items[k] for k in number.tolist()]


def benchmark_hits(
    df: DataFrame, text: str, bench: DataFrame, item_id: str, item_text: str, size: int = WINDOW, share: int = SHARE,
    keep: list[str] | None = None,
) -> DataFrame:
    """Every row of ``df`` (columns ``keep``; all, if None) with what it shares with the benchmark.

    Added: n_words, n_hit (words inside any occurrence of a window), items (ids of items with
    occurring windows, sorted as strings), hit_words (array of [first word, last word] runs), and
    contaminated (n_hit > 0 and share * n_hit >= n_words). A window is ``size`` consecutive words of
    an item; a shorter item is one window; an item without words has none. A null or empty text has
    no words and isn't contaminated. A null item id reads "". Repeated rows and texts are each
    judged alike. Columns of these names in ``df``, in any spelling, are replaced.

    The benchmark goes to the tasks in groups of ``GROUP_BYTES`` of text (or one longer item), so
    no task holds more at once, however many items there are.
    """
    spark = df.sparkSession
    added = ["n_words", "n_hit", "items", "hit_words", "contaminated"]
    types = ["long", "long", "array<string>", "array<array<int>>", "boolean"]
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in added]
    copy = fresh(df, "text_to_search")
    plain = df.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(copy))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema[:-1]), *map(" ".join, zip(added, types, strict=True))])
    items = bench.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text")
    ).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // GROUP_BYTES))
    groups = []
    for g in range(n):
        rows = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == g)
        groups.append(spark.sparkContext.broadcast([(r["item"], r["text"].encode()) for r in rows.distinct().collect()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = Finder(groups[0].value, size) if len(groups) == 1 else None
        for batch in batches:
            for part in slices(batch, copy, (2 << 20) if only else (16 << 20)):
                docs = [b" ".join(words_of(x.as_buffer().to_pybytes())) for x in part.column(copy)]
                data = b"".join([b" " + d + b" " for d in docs])
                view = Block8(data)
                begin = np.append(0, np.cumsum([len(d) + 2 for d in docs]))
                spaces = np.append(0, np.cumsum(np.frombuffer(data, np.uint8) == 32, dtype=np.int32))
                n_words = np.where(np.diff(begin) > 2, np.diff(spaces[begin]) - 1, 0)
                first = np.append(0, np.cumsum(n_words))
                edge = np.zeros(int(first[-1]) + 1, np.int32)
                owned: list[set] = [set() for _ in docs]
                for group in groups:
                    finder = only or Finder(group.value, size)
                    for start, sizes, names in finder.search(data, view):
                        doc = np.searchsorted(begin, start, side="right") - 1
                        word = first[doc] + spaces[start] - spaces[begin[doc]]
                        np.add.at(edge, word, 1)
                        np.add.at(edge, word + sizes, -1)
                        for d, own in zip(doc.tolist(), names, strict=True):
                            owned[d].update(own)
                hit = np.append(np.cumsum(edge[:-1]) > 0, False)
                n_hit = np.diff(np.append(0, np.cumsum(hit))[first])
                runs = []
                for d in range(len(docs)):
                    own = hit[first[d] : first[d + 1]]
                    turns = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]))).reshape(-1, 2) if n_hit[d] else []
                    runs.append([[int(a), int(b) - 1] for a, b in turns])
                out = [
                    pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                    pa.array([sorted(o) for o in owned], pa.list_(pa.string())),
                    pa.array(runs, pa.list_(pa.list_(pa.int32()))),
                    pa.array((n_hit > 0) & (share * n_hit >= n_words)),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *out], names=[*kept, *added])

    return plain.mapInArrow(run, schema)


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(
    "op10_decontaminate",
    f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    bk AS (SELECT item_id, w, least(len(w), 13) AS k FROM b WHERE len(w) > 0),
    bi AS (SELECT item_id, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM bk),
    bg AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM bi),
    dk AS (SELECT doc_id, w, k FROM d, (SELECT DISTINCT k FROM bg) WHERE len(w) >= k),
    di AS (SELECT doc_id, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM dk),
    dg AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM di),
    h AS (SELECT doc_id, i, k, item_id FROM dg JOIN bg USING (k, g)),
    p AS (SELECT doc_id, count(DISTINCT q) AS n_hit
          FROM (SELECT doc_id, unnest(range(i, i + k)) AS q FROM h) GROUP BY doc_id),
    t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
      CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)""",
)
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = benchmark_hits(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text", keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )
