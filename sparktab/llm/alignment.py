"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often.

Both tokenizers split a text before a space that follows something else, so a text is a row of
chunks, and a different chunk is encoded and aligned once in a task. Byte offsets where tokens of both
end cut a chunk into groups. Nearly all groups are one token of each with the same bytes: an array maps
the A ids to their B ids, and such links are counted in vectors of vocabulary length. Only the links
of the other groups go into the exchange of pairs.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext
from tokenizers import Tokenizer

from sparktab.llm.bpe import printable_bytes
from sparktab.llm.common import query, ragged, run_starts, slices, table
from sparktab.session import scratch_path, spread

BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: A chunk begins with a space that follows something else; one is put before the text for the first.
CUT = re.compile(r"(?<=\S) ")
TWO = re.compile(r"\s ")
MOST = 300_000


def cut_chunks(text: str) -> list[str]:
    """The chunks of a text, each without its first space."""
    if not text:
        return []
    return CUT.split(text) if text[0].isspace() or TWO.search(text) else text.split(" ")


class ByteLevel:
    """Side A: a byte-level BPE file of the tokenizers library. Strings of special tokens are plain text."""

    def __init__(self, source: str) -> None:
        self.library = Tokenizer.from_str(source)
        self.library.encode_special_tokens = True
        sign = {c: i for i, c in enumerate(printable_bytes())}
        vocab = json.loads(source)["model"]["vocab"]
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(sign[c] for c in token) if all(c in sign for c in token) else token.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of a space and each text."""
        return [e.ids for e in self.library.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """Side B: a sentencepiece file, which puts a space before a text by itself."""

    def __init__(self, source: bytes) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_proto=source)
        size = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(size)]
        self.space = names.index("▁")
        if any("▁" in n.lstrip("▁") for n in names):
            raise ValueError("a piece goes over the start of a word, so texts can't be cut into chunks")
        byte = [self.library.is_byte(i) for i in range(size)]
        self.bytes = [bytes([int(n[3:5], 16)]) if b else n.replace("▁", " ").encode() for n, b in zip(names, byte, strict=True)]
        self.plain = [not (b or self.library.is_control(i) or self.library.is_unknown(i)) for i, b in enumerate(byte)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of a space and each text. The library itself gives an empty text no space."""
        return [ids or [self.space] for ids in self.library.encode(texts, num_threads=1)]


def same_bytes(a: ByteLevel, b: Pieces) -> np.ndarray:
    """For each A id the B id of the same bytes, or -1. A piece is preferred to a byte token."""
    found = {raw: i for i, raw in enumerate(b.bytes) if not b.plain[i] and len(raw) == 1}
    found |= {raw: i for i, raw in enumerate(b.bytes) if b.plain[i]}
    return np.array([found.get(raw, -1) for raw in a.bytes], np.int64)


class Aligner:
    """Aligned chunks, kept over calls in flat arrays; row c holds what is known of chunk c."""

    def __init__(self, a: ByteLevel, b: Pieces, lot: int = 1000) -> None:
        self.sides, self.same, self.lot = (a, b), same_bytes(a, b), lot
        self.sizes = [np.array([len(x) for x in side.bytes], np.int64) for side in self.sides]
        n_a, n_b = (len(size) for size in self.sizes)
        signs = [f"{i}{sign}" for n, ends in ((n_a, ",|"), (n_b, (",", ";", ""))) for sign in ends for i in range(n)]
        self.signs = pa.array(signs, pa.string())
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.texts = pa.array([], pa.string())
        # Tokens of A, of B, groups, links, and whether the tokens' bytes are the chunk's.
        self.counts = np.zeros((0, 5), np.int64)
        self.links = [np.zeros(0, np.int64)] * 2
        self.at = [np.zeros(1, np.int64)] * 2

    def of(self, chunks: list[str]) -> np.ndarray:
        """Rows of the chunks."""
        new = [c for c in dict.fromkeys(chunks) if c not in self.rows]
        # Chunks that end in white space would change where another follows, so they stand alone.
        alone = [not c or c[-1].isspace() for c in new]
        joined = [c for c, x in zip(new, alone, strict=True) if not x]
        lots = [joined[k : k + self.lot] for k in range(0, len(joined), self.lot)]
        self.add(lots + [[c] for c, x in zip(new, alone, strict=True) if x])
        return np.array(list(map(self.rows.__getitem__, chunks)), np.int64)

    def encoded(self, lots: list[list[str]]) -> tuple[list[np.ndarray], np.ndarray]:
        """Flat ids of both sides, and which chunks' bytes both of them keep; the others have no ids."""
        texts = [" ".join(lot) for lot in lots]
        ids, kept = [], np.ones(len(lots), bool)
        for side in self.sides:
            ids.append(side.encode(texts))
            kept &= [b"".join(map(side.bytes.__getitem__, x)) == b" " + t.encode() for x, t in zip(ids[-1], texts, strict=True)]
        flags = [np.ones(len(lot), bool) for lot in lots]
        for i in np.flatnonzero(~kept):
            if len(lots[i]) > 1:
                parts, flags[i] = self.encoded([[c] for c in lots[i]])
                ids[0][i], ids[1][i] = (p.tolist() for p in parts)
            else:
                ids[0][i], ids[1][i], flags[i] = [], [], np.zeros(1, bool)
        return [np.concatenate([np.array(x, np.int64) for x in side]) for side in ids], np.concatenate(flags)

    def add(self, lots: list[list[str]]) -> None:
        if not lots:
            return
        new = [c for lot in lots for c in lot]
        flat, whole = self.encoded(lots)
        length = (np.array(pc.binary_length(pa.array(new, pa.string())), np.int64) + 1) * whole
        ends = np.cumsum(length)
        stops = [np.cumsum(size[x]) for size, x in zip(self.sizes, flat, strict=True)]
        starts = [stop - size[x] for stop, size, x in zip(stops, self.sizes, flat, strict=True)]
        # Both sides cover the same bytes, so offsets run on over all chunks.
        cut = np.intersect1d(*stops, assume_unique=True)
        heads = np.searchsorted(ends, cut)
        if not np.array_equal(cut[run_ends(heads)], ends[length > 0]):
            raise ValueError("a token goes over the start of a word")
        group = [np.searchsorted(cut, x) for x in stops]
        owner = [heads[g] for g in group]
        sizes = [np.bincount(g, minlength=len(cut)) for g in group]
        # The B tokens that an A token overlaps are neighbours.
        first = np.searchsorted(stops[1], starts[0], side="right")
        n = np.searchsorted(starts[1], stops[0], side="left") - first
        x, y, of = np.repeat(flat[0], n), flat[1][ragged(first, n)], np.repeat(owner[0], n)
        per = lambda chunk: np.bincount(chunk, minlength=len(new))
        counts = np.stack([per(owner[0]), per(owner[1]), per(heads), per(of), whole], 1)
        fast = self.same[x] == y
        for i, (held, value) in enumerate(((fast, x), (~fast, x << 32 | y))):
            self.links[i] = np.concatenate([self.links[i], value[held]])
            self.at[i] = np.concatenate([self.at[i], self.at[i][-1] + np.cumsum(per(of[held]))])
        self.texts = pa.concat_arrays([self.texts, self.spelled(flat, group, sizes, heads, counts[:, 0] + counts[:, 1])])
        base = len(self.counts)
        self.counts = np.concatenate([self.counts, counts.astype(np.int64)])
        self.rows |= {c: base + i for i, c in enumerate(new)}

    def spelled(self, flat, group, sizes, heads, tokens: np.ndarray) -> pa.Array:
        """The groups of each chunk as text: ids of A, a bar, ids of B, groups divided by semicolons."""
        kinds = [len(s) for s in self.sizes]
        before = [np.cumsum(s) - s for s in sizes]
        # Each id has a text for each sign behind it: comma and bar for A; comma, semicolon, none for B.
        last_a = run_ends(group[0])
        a = flat[0] + kinds[0] * last_a
        end = np.where(run_ends(heads), 2, 1)[group[1]] * run_ends(group[1])
        b = flat[1] + 2 * kinds[0] + kinds[1] * end
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + before[1][group[0]]] = a
        order[np.arange(len(b)) + (before[0] + sizes[0])[group[1]]] = b
        at = pa.array(np.append(0, np.cumsum(tokens)).astype(np.int32))
        return pc.binary_join(pa.ListArray.from_arrays(at, self.signs.take(pa.array(order))), "")


def run_ends(values: np.ndarray) -> np.ndarray:
    """True where a sorted array's value differs from the one after."""
    return np.append(run_starts(values)[1:], True)[: len(values)]


def per_document(value: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different values of each document, how often each occurs there, and how many different ones each has."""
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    at = np.flatnonzero(run_starts(value) | run_starts(doc))
    return value[at], np.diff(np.append(at, len(value))), np.bincount(doc[at], minlength=n)


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values, kind))


def aligned(df: DataFrame, id_col: str, text: str, a_source: str, b_source: bytes) -> DataFrame:
    """One row for each row of ``df``: its own key, id, counts, digest, and the links with how often each occurs.

    ``same`` holds A ids that are linked with the B id of their bytes, ``pair`` all other links as
    A id * 2^32 + B id.
    """
    plain = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Tasks fill the cores already; the library's own threads would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        aligner = Aligner(ByteLevel(a_source), Pieces(b_source))
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text"):
                if len(aligner.rows) > MOST:
                    aligner.clear()
                cut = [cut_chunks(t) for t in part.column("text").to_pylist()]
                chunks = aligner.of([c for x in cut for c in x])
                n = len(cut)
                doc = np.repeat(np.arange(n), [len(x) for x in cut])
                lost = np.zeros(n, bool)
                lost[doc[aligner.counts[chunks, 4] == 0]] = True
                held = ~lost[doc]
                chunks, doc = chunks[held], doc[held]
                totals = [np.bincount(doc, aligner.counts[chunks, i], n).astype(np.int64) for i in range(4)]
                bounds = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
                said = pc.binary_join(pa.ListArray.from_arrays(bounds, aligner.texts.take(pa.array(chunks))), ";")
                digests = [hashlib.sha256(x.as_buffer()).hexdigest() if x.as_buffer().size else "" for x in said]
                out = []
                for links, at, kind in zip(aligner.links, aligner.at, (pa.int32(), pa.int64()), strict=True):
                    sizes = np.diff(at)[chunks]
                    value, times, many = per_document(links[ragged(at[chunks], sizes)], np.repeat(doc, sizes), n)
                    out += [lists(value, many, kind), lists(times, many, pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key + np.arange(n)), part.column("doc_id"), *map(pa.array, totals), pa.array(digests, pa.string()), *out],
                    names=["key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "same", "same_n", "pair", "pair_n"],
                )
                key += n

    return plain.mapInArrow(
        run,
        "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "same array<int>, same_n array<int>, pair array<bigint>, pair_n array<int>",
    )


def same_counts(rows: DataFrame, size: int) -> np.ndarray:
    """In how many documents each A id is linked with the B id of its bytes; each task adds up a vector of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            counts += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], names=["id", "n"])

    counts = np.zeros(size, np.int64)
    # At most as many rows as A has ids.
    for r in rows.select("same").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    return counts


def align_texts(df: DataFrame, id_col: str, text: str, a_path: str = BYTE_LEVEL, b_path: str = PIECES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of ``df``.

    A is a byte-level BPE file of the tokenizers library, B a sentencepiece file; both encode a space
    and the text. A link joins an A and a B token that share bytes; its count says how many rows
    of ``df`` hold the same pair of ids linked. ``n_best`` is how many of a row's links have the highest
    count of their A id (ties included), ``count_sum`` adds up all links' counts.

    Null and empty texts, and texts whose bytes one of the tokenizers doesn't keep, have no tokens: zeros
    and an empty digest. Each row counts as a document, whether its id is null or repeated. Texts are
    encoded whole; only the two named columns are read; an empty table gives no rows.

    The aligned rows are written once. Vectors that cross the driver have A's vocabulary's length;
    pairs of ids are counted and looked up by joins, which adaptive execution splits where a pair is hot.
    """
    spark = df.sparkSession
    with open(a_path, encoding="utf-8") as f:
        a_source = f.read()
    with open(b_path, "rb") as f:
        b_source = f.read()
    size = len(ByteLevel(a_source).bytes)
    path = scratch_path(spark, "aligned")
    aligned(df, id_col, text, a_source, b_source).write.option("compression", "zstd").parquet(path)
    rows = spark.read.parquet(path)
    count = same_counts(rows, size)
    links = rows.select("key", F.explode(F.arrays_zip("pair", "pair_n")).alias("p")).select("key", "p.pair", "p.pair_n")
    counted = links.groupBy("pair").agg(F.count("*").alias("count"))
    path = scratch_path(spark, "pairs")
    counted.write.parquet(path)
    counted = spark.read.parquet(path)
    best = count.copy()
    for r in counted.groupBy((F.shiftright("pair", 32)).alias("a")).agg(F.max("count").alias("count")).collect():
        best[r["a"]] = max(best[r["a"]], r["count"])

    def with_best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top = best[batch.column("pair").to_numpy() >> 32] == batch.column("count").to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(top)], names=["pair", "count", "top"])

    def with_same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, times = batch.column("same"), batch.column("same_n").flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), ids.value_lengths().to_numpy())
            ids = ids.flatten().to_numpy()
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            np.add.at(sums[0], row, times * (count[ids] == best[ids]))
            np.add.at(sums[1], row, times * count[ids])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *map(pa.array, sums)], names=[*batch.schema.names[:-2], "best", "sum"])

    plain = "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    known = counted.mapInArrow(with_best, "pair long, count long, top boolean")
    other = links.hint("merge").join(known, "pair").groupBy("key").agg(
        F.sum(F.when(F.col("top"), F.col("pair_n")).otherwise(0)).alias("other_best"),
        F.sum(F.col("pair_n") * F.col("count")).alias("other_sum"),
    )
    own = rows.select(*[c.split()[0] for c in plain.split(", ")], "same", "same_n").mapInArrow(with_same, plain + ", best long, sum long")
    zero = F.lit(0)
    return own.join(other.hint("merge"), "key", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("best") + F.coalesce("other_best", zero)).alias("n_best"),
        (F.col("sum") + F.coalesce("other_sum", zero)).alias("count_sum"),
        "groups_sha256",
    )


@query("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align_texts(spread(docs), "doc_id", "text")
