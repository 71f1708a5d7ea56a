"""Spelling variants: words one edit apart, each with its more frequent form.

Words that differ by one code point agree in all but one of their pieces, so they meet by length,
piece and the code points around it. Inside such a meeting place a group holds words that differ
in a piece of three or four code points at most, whatever the size of the corpus. The words lie in
padded matrices of code points; two blocks are compared column by column, which gives the lengths
of the common prefix and of the common suffix of every pair. Two different words are one edit
apart if these reach the longer length less one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktab.llm.common import query, ragged, run_starts, table, text_bytes
from sparktab.session import materialize, spread

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = r"[A-Za-zÀ-ÿ]+"
#: Code points of a piece, and how many pieces a long word has (its pieces are longer then).
PIECE, PIECES = 3, 8
BLOCK = 128
#: A group of more words is dealt out; each lot compares its own words with the whole group.
HOT = 4096


def corpus_words(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(word) for each occurrence: letter runs with A-Z lower-cased. A null text has none; a null id is an empty one.

    A run loses the code point h % length if 97 divides h, the CRC-32 of ``<id>:<run>``.
    """
    runs = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(RUN), F.lit(0))
    word = F.explode(runs).alias("w")
    rows = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("d"), word)
    rows = rows.select("w", F.crc32(F.concat_ws(":", "d", "w").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("w")).cast("int")
    cut = F.concat(F.substr("w", F.lit(1), at), F.substr("w", at + 2))
    return rows.select(F.when(F.col("h") % 97 == 0, cut).otherwise(F.col("w")).alias("word"))


def word_counts(df: DataFrame, id_col: str, text: str, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n) of the words with at least ``least_length`` code points and ``least_count`` occurrences."""
    found = corpus_words(df, id_col, text).where(F.length("word") >= least_length)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def meeting_places(words: DataFrame, least_length: int) -> DataFrame:
    """(place, k, longer, word, n): where a word may meet words of its length, and longer ones by one.

    A place is a length, one of the pieces of that length, and what surrounds the piece. A word
    comes to the places of its own length, and with a piece longer by one to those of the length below.
    """
    own = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("longer"))
    own = own.withColumn("size", F.length("word") - F.col("longer")).where(F.col("size") >= least_length)
    pieces = F.least(F.ceil(F.col("size") / PIECE), F.lit(PIECES)).cast("int")
    cut = own.select("*", pieces.alias("q"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("k"))
    start, end = F.expr("int(k * size div q)"), F.expr("int((k + 1) * size div q)")
    around = F.concat(F.substr("word", F.lit(1), start), F.substr("word", end + F.col("longer") + 1))
    around = F.when(F.length(around) <= 32, around).otherwise(F.sha2(around, 256))
    return cut.select(F.concat_ws(",", "size", "k", around).alias("place"), "k", (F.col("longer") == 1).alias("longer"), "word", "n")


def dealt(places: DataFrame) -> DataFrame:
    """Rows of all places, with the key of a group and whether the word asks there (``own``)."""
    hot = materialize(places.groupBy("place").agg(F.count("*").alias("size")).where(F.col("size") > HOT), "hot_places")
    lots = F.coalesce(F.ceil(F.col("size") / HOT).cast("int"), F.lit(1))
    rows = places.join(hot, "place", "left").withColumn("lots", lots)
    rows = rows.withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    own = F.pmod(F.xxhash64("word"), F.col("lots")) == F.col("lot")
    return rows.select(F.concat_ws(",", "lot", "place").alias("key"), "k", own.alias("own"), "longer", "word", "n")


class Tiles:
    """Words sorted by their groups, compared in blocks."""

    def __init__(self, rows: pa.RecordBatch, group: np.ndarray) -> None:
        self.group = group
        self.own, self.longer = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("own", "longer"))
        self.piece = rows.column("k").to_numpy()
        points, offsets = text_bytes(rows.column("points"))
        self.points, self.offsets = points.view(">u4").astype(np.uint32), offsets // 4
        self.size = np.diff(self.offsets)

    def matrices(self, i: slice) -> tuple[np.ndarray, np.ndarray]:
        """Code points of the words of a block, from their first and from their last on; pads are 0."""
        size, first = self.size[i], self.offsets[:-1][i]
        row = np.repeat(np.arange(len(size)), size)
        place = ragged(np.zeros(len(size), np.int64), size)
        both = np.zeros((2, len(size), int(size.max())), np.uint32)
        both[0, row, place] = self.points[first[row] + place]
        both[1, row, place] = self.points[first[row] + size[row] - 1 - place]
        return both[0], both[1]

    @staticmethod
    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In how many columns, from the first on, each row of ``a`` agrees with each row of ``b``."""
        same = np.ones((len(a), len(b)), bool)
        total = np.zeros((len(a), len(b)), np.int32)
        for c in range(min(a.shape[1], b.shape[1])):
            x = a[:, c, None]
            same &= (x == b[None, :, c]) & (x != 0)
            if not same.any():
                break
            total += same
        return total

    def pairs(self, i: slice, j: slice) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows of two blocks, first row before second, that are one edit apart and count here."""
        one = self.matrices(i)
        two = one if i == j else self.matrices(j)
        prefix, suffix = self.common(one[0], two[0]), self.common(one[1], two[1])
        most = np.maximum(self.size[i][:, None], self.size[j])
        near = prefix + suffix >= most - 1
        near &= (self.group[i][:, None] == self.group[j]) & ~(self.longer[i][:, None] & self.longer[j])
        a, b = np.nonzero(near)
        suffix = suffix[a, b]
        a, b = a + i.start, b + j.start
        held = a < b
        a, b, suffix = a[held], b[held], suffix[held]
        # Where a letter was put into a run of it, several pieces may hide it: the first that does counts.
        size, k = np.minimum(self.size[a], self.size[b]), self.piece[a]
        spot = size - np.minimum(suffix, size)
        parts = np.minimum(-(-size // PIECE), PIECES)
        counts = (spot <= (k + 1) * size // parts) & ((spot > k * size // parts) | (k == 0))
        return a[counts], b[counts]

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.group)
        ends = np.searchsorted(self.group, self.group, side="right")
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for start in range(0, n, BLOCK):
            block = slice(start, min(start + BLOCK, n))
            last = int(ends[block.stop - 1])
            found += [self.pairs(block, slice(j, min(j + BLOCK, last))) for j in range(start, last, BLOCK)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def near_words(words: DataFrame, least_length: int = 5) -> DataFrame:
    """(word, near, near_n): all words of ``words`` (word, n) that are one edit from each other, both ways.

    Words shorter than ``least_length`` take no part. A task holds the rows of one place at a time,
    or of one lot of a place.
    """
    rows = dealt(meeting_places(words, least_length)).withColumn("points", F.encode("word", "UTF-32"))

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = rows.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
        alone = run_starts(keys) & np.append(run_starts(keys)[1:], True)
        if alone.all():
            return
        batch = rows.filter(pa.array(~alone)).combine_chunks().to_batches()[0]
        tiles = Tiles(batch, keys[~alone])
        a, b = tiles.near()
        ask, answer = np.concatenate([a, b]), np.concatenate([b, a])
        held = tiles.own[ask]
        ask, answer = pa.array(ask[held]), pa.array(answer[held])
        word, n = batch.column("word"), batch.column("n")
        yield pa.RecordBatch.from_arrays([word.take(ask), word.take(answer), n.take(answer)], names=["word", "near", "near_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # The last group of a batch may go on in the next one, so its rows wait.
            key = batch.column("key")
            last = pc.index(key, key[-1]).as_py()
            if last or (kept and kept[-1].column("key")[-1] != key[-1]):
                yield from compare(pa.Table.from_batches([*kept, batch.slice(0, last)]))
                kept = []
            kept.append(batch.slice(last))
        if kept:
            yield from compare(pa.Table.from_batches(kept))

    ordered = rows.drop("size").repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, "word string, near string, near_n long")


def with_roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form (word, form): the last word reached over forms.

    A form is at least twice as frequent as its word, so a path has fewer than 64 steps; each round
    doubles the steps taken, and rounds end when no path goes on.
    """
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = now.join(onward, "root", "left")
        if moved.where("further is not null").isEmpty():
            return now
        now = materialize(moved.select("word", F.coalesce("further", "root").alias("root")), "roots")


def group_spellings(words: DataFrame, least_length: int = 5, factor: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every row of ``words`` (word, n; words differ).

    ``n_near`` counts the words one inserted, deleted or replaced code point away. ``form`` is the most
    frequent of them (ties: smallest by code points) if it has at least ``factor`` (2 or more) times the word's
    count; ``root`` is where a path of forms ends, or the word itself. No words give no rows.
    """
    if factor < 2:
        raise ValueError("factor must be at least 2, or paths of forms may not end")
    words = materialize(words.select("word", F.col("n").cast("long").alias("n")), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    near = near_words(words, least_length).groupBy("word").agg(F.count("*").alias("n_near"), best)
    enough = -F.col("best.less") >= factor * F.col("n")
    full = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    full = materialize(full, "forms")
    roots = with_roots(full.where("form is not null").select("word", "form"))
    return full.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


@query(
    "op12_spellings",
    """
    WITH RECURSIVE k AS (SELECT i, i AS c, 0 AS bit FROM range(256) AS r(i) UNION ALL
      SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, bit + 1 FROM k WHERE bit < 8),
    t AS (SELECT list(c ORDER BY i) AS crcs FROM k WHERE bit = 8),
    o AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d,
        unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
    a AS (SELECT d, w, count(*) AS n FROM o GROUP BY ALL),
    b AS (SELECT w, n, [CAST(4294967295 AS BIGINT)] || list_transform(regexp_extract_all(hex(encode(d || ':' || w)), '..'),
        lambda h: CAST(16 * (strpos('0123456789ABCDEF', h[1]) - 1) + strpos('0123456789ABCDEF', h[2]) - 1 AS BIGINT)) AS bytes FROM a),
    h AS (SELECT w, n, CAST(xor(list_reduce(bytes, lambda c, x: xor(c // 256, crcs[CAST(xor(c % 256, x) AS BIGINT) + 1])), 4294967295) AS BIGINT) AS h FROM b, t),
    s AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
    v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
    x AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
    e AS (SELECT p.word, q.word AS near, q.n AS near_n FROM x AS p JOIN x AS q ON p.i = q.i AND p.less = q.less AND p.word <> q.word
        UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.less = v.word
        UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.less = v.word),
    g AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM e GROUP BY word),
    m AS (SELECT e.word, min(e.near) AS form, any_value(g.top) AS form_n, any_value(g.n_near) AS n_near FROM e JOIN g ON e.word = g.word AND e.near_n = g.top GROUP BY e.word),
    f AS (SELECT v.word, v.n, coalesce(m.n_near, 0) AS n_near, CASE WHEN m.form_n >= 2 * v.n THEN m.form END AS form,
        CASE WHEN m.form_n >= 2 * v.n THEN m.form_n END AS form_n FROM v LEFT JOIN m USING (word)),
    z AS (SELECT word, word AS root, form AS onward FROM f UNION ALL SELECT z.word, f.word, f.form FROM z JOIN f ON z.onward = f.word)
    SELECT f.word, f.n, f.n_near, f.form, f.form_n, z.root FROM f JOIN z ON f.word = z.word AND z.onward IS NULL""",
)
def op12_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return group_spellings(word_counts(docs, "doc_id", "text"))
