"""Token ids in binary files: frequency-ranked, byte-aligned variable length, separate control bytes.

Each id is written as its rank by corpus frequency, in 1 to 4 bytes. Two bits in a control byte tell
the length, so one control byte describes four ids and readers decode whole arrays by table lookup.
Each document is coded on its own (its last control byte may be part filled). A file is a row of
blocks: a header, the documents' ids and sizes, all control bytes, all data bytes. Files follow
ascending document ids; the folder's manifest lists them in that order with the number of ids before
each block, so every document's place in the whole stream is known without reading the others.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.taskcontext import TaskContext
from tokenizers import Tokenizer

from sparktab.llm.bpe import VOCABULARY, ragged_rows, vocabulary
from sparktab.llm.common import Store, query, slices, table, text_bytes, width
from sparktab.llm.words import Splitter, WordCodes, character_kinds
from sparktab.session import scratch_path, spread

MANIFEST = "_id_files.json"
RANKS = "_ranks.bin"
END = 1
#: Document ids that a task names for cutting the corpus into ranges.
PLACES = 256
TOKEN_COLUMNS = ["doc_id", "ids", "counts", "places"]
SCHEMA = "doc_id long, start long, n_tokens long, ids array<int>"
#: Lengths of the four numbers that a control byte describes, and which of their 16 bytes are kept.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
KEPT = np.arange(4)[None, None, :] < LENGTHS[:, :, None]


def code_numbers(numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(control bytes, data bytes, data bytes of each document) of several documents' numbers."""
    length = np.zeros(len(numbers), np.uint8)
    for limit in (1 << 8, 1 << 16, 1 << 24):
        length += numbers >= limit
    fours = (counts + 3) // 4
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    slot = np.arange(len(numbers)) - first[owner] + 4 * (np.cumsum(fours) - fours)[owner]
    codes = np.zeros(4 * int(fours.sum()), np.uint8)
    codes[slot] = length
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    data = numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) <= length[:, None]]
    sizes = np.bincount(owner, weights=length + 1.0, minlength=len(counts)).astype(np.int64)
    return control, data, sizes


def decode_numbers(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of several documents, from their control and data bytes."""
    fours = (counts + 3) // 4
    kept = KEPT[control].reshape(-1, 4)
    # Slots behind a document's last number hold nothing.
    ends = 4 * np.cumsum(fours)
    held = np.ones(4 * len(control), bool)
    spare = 4 * fours - counts
    for k in (1, 2, 3):
        held[ends[spare >= k] - k] = False
    kept = kept[held]
    out = np.zeros((len(kept), 4), np.uint8)
    out[kept] = data
    return out.reshape(-1).view("<u4")


def light_tokenizer(source: str) -> Tokenizer:
    """The file's model behind a splitter that expects normalized words with one space between them."""
    config = json.loads(source)
    config["normalizer"], config["added_tokens"] = None, []
    by_byte = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    space = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
    config["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [space, by_byte]}
    return Tokenizer.from_str(json.dumps(config))


def token_ids(df: DataFrame, id_col: str, text: str, source: str, size: int) -> DataFrame:
    """(doc_id, ids, counts, places): ids as little-endian unsigned 16-bit (or, from 65,537 ids on, 32-bit) numbers.

    The tokenizers library encodes each different word of a task once; words are found as it finds
    them. A null text counts as empty. Each task ends with a row of its own, the only one with
    ``counts``: how often it met each of the ``size`` ids, and the number of its documents behind
    them. ``places`` are up to ``PLACES`` even quantiles of its document ids.
    """
    plain = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kinds = character_kinds()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Tasks fill the cores already; the library's own threads would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        config = json.loads(source)
        special = {t["content"]: t["id"] for t in config["added_tokens"]}
        numbers = list(special.values())
        suffix = config["model"]["end_of_word_suffix"]
        library = light_tokenizer(source)
        last = np.zeros(max([*config["model"]["vocab"].values(), *numbers]) + 1, bool)
        last[[i for t, i in config["model"]["vocab"].items() if t.endswith(suffix)]] = True
        kind = "<u2" if len(last) <= 1 << 16 else "<u4"

        def encode(words: list[str | int]) -> tuple[np.ndarray, np.ndarray]:
            own = [i for i, w in enumerate(words) if not isinstance(w, int)]
            lots = [" ".join(words[i] for i in own[k : k + 1000]) for k in range(0, len(own), 1000)]
            flat = [e.ids for e in library.encode_batch_fast(lots, add_special_tokens=False)]
            ids = np.concatenate([np.array(x, np.int64) for x in flat]) if flat else np.zeros(0, np.int64)
            ends = np.flatnonzero(last[ids]) + 1
            if len(ends) != len(own):
                raise ValueError("the vocabulary doesn't mark the ends of words")
            lengths = np.ones(len(words), np.int64)
            lengths[own] = np.diff(ends, prepend=0)
            out = np.empty(int(lengths.sum()), np.int64)
            at = np.cumsum(lengths) - lengths
            taken = np.ones(len(out), bool)
            for i, w in enumerate(words) if len(own) < len(words) else []:
                if isinstance(w, int):
                    out[at[i]], taken[at[i]] = numbers[w], False
            out[taken] = ids
            return out, lengths

        splitter, codes = Splitter(list(special), kinds), WordCodes(encode)
        counts, keys = np.zeros(size + 1, np.int64), [np.zeros(0, np.int64)]
        for batch in batches:
            for part in slices(batch, "text"):
                words = splitter.split(part.column("text").to_pylist())
                rows = codes.codes(words)
                flat = codes.ids[ragged_rows(codes.offsets, rows)].astype(kind)
                at = np.append(0, np.cumsum(np.diff(codes.offsets)[rows]))[words.bounds]
                width_ = flat.itemsize
                ids = pa.Array.from_buffers(
                    pa.binary(), len(at) - 1,
                    [None, pa.py_buffer((at * width_).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())],
                )
                counts[:size] += np.bincount(flat, minlength=size)
                counts[size] += part.num_rows
                keys.append(part.column("doc_id").drop_null().to_numpy())
                none = pa.nulls(part.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, none, none], names=TOKEN_COLUMNS)
        key = np.sort(np.concatenate(keys))
        places = key[(np.arange(min(PLACES, len(key))) * len(key)) // max(1, min(PLACES, len(key)))]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()]), pa.array([places.tobytes()])],
            names=TOKEN_COLUMNS,
        )

    return plain.mapInArrow(run, "doc_id long, ids binary, counts binary, places binary")


def summed(summaries: DataFrame, size: int) -> np.ndarray:
    """The tasks' ``counts`` added up: one number for each id and the number of documents; never more for more rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            data, _ = text_bytes(batch.column(0))
            total += data.view(np.int64).reshape(-1, size + 1).sum(0)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["id", "n"])

    total = np.zeros(size + 1, np.int64)
    for r in summaries.select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        total[r["id"]] = r["n"]
    return total


def cut_points(summaries: DataFrame, steps: int) -> np.ndarray:
    """At most ``steps`` - 1 document ids that cut the corpus into about even ranges; they steer balance only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, _ = text_bytes(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(data.view(np.int64))], names=["place"])

    share = F.array(*[F.lit(i / steps) for i in range(1, steps)] or [F.lit(0.5)])
    found = summaries.select("places").mapInArrow(run, "place long").agg(F.percentile_approx("place", share, F.lit(10_000)).alias("c"))
    return np.unique(np.array(found.first()["c"] or [], np.int64))


@dataclass
class Written(WriterCommitMessage):
    """The file of one task: its place, name, and for each block (byte offset, ids, documents)."""

    place: int
    name: str | None
    blocks: list


class IdWriter(DataSourceArrowWriter):
    """Blocks in the order of the rows; each attempt writes a file of its own name."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.block_bytes = int(options.get("blockbytes", 1 << 20))

    def write(self, iterator):
        name, out, blocks, at = f"part-{uuid.uuid4().hex}.ids", None, [], 0
        for batch in iterator:
            for part in slices(batch, "data", self.block_bytes):
                key = part.column(0)
                null = key.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
                counts = part.column(1).to_numpy().astype("<u4")
                control, _ = text_bytes(part.column(2))
                data, _ = text_bytes(part.column(3))
                body = [
                    key.fill_null(0).to_numpy().astype("<i8").tobytes(), null.tobytes(), counts.tobytes(),
                    control.tobytes(), data.tobytes(),
                ]
                body = zstandard.compress(b"".join(body), 1)
                if out is None:
                    out = Store(self.path).create(name)
                out.write(np.array([len(counts), len(body)], "<i8").tobytes() + body)
                blocks.append([at, int(counts.sum()), len(counts)])
                at += 16 + len(body)
        if out is not None:
            out.close()
        return Written(TaskContext.get().partitionId(), name if out is not None else None, blocks)

    def commit(self, messages) -> None:
        files, before = [], 0
        for m in sorted((m for m in messages if m is not None and m.name), key=lambda m: m.place):
            blocks = []
            for at, ids, docs in m.blocks:
                blocks.append([at, before, docs])
                before += ids
            files.append([m.name, blocks])
        with Store(self.path).create(MANIFEST) as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and m.name:
                Store(self.path).delete(m.name)


@dataclass
class Blocks(InputPartition):
    name: str
    blocks: list


class IdReader(DataSourceReader):
    def __init__(self, schema, options: dict) -> None:
        self.path = options["path"]
        self.names = [f.name for f in schema.fields]
        self.at_once = int(options.get("splitblocks", 16))

    def partitions(self):
        with Store(self.path).open(MANIFEST) as f:
            files = json.loads(f.read())
        n = self.at_once
        pieces = [Blocks(name, b[i : i + n]) for name, b in files for i in range(0, len(b), n)]
        return pieces or [Blocks("", [])]

    def read(self, partition):
        kinds = {"ids": pa.list_(pa.int32()), "ids_le": pa.binary()}
        schema = pa.schema([(n, kinds.get(n, pa.int64())) for n in self.names])
        if not partition.blocks:
            return
        folder = Store(self.path)
        with folder.open(RANKS) as f:
            id_of = np.frombuffer(f.read(), "<u4")
        with folder.open(partition.name) as f:
            for at, before, _ in partition.blocks:
                f.seek(at)
                n, size = np.frombuffer(f.read(16), "<i8")
                body = zstandard.decompress(f.read(int(size)))
                keys = np.frombuffer(body, "<i8", n)
                null = np.frombuffer(body, np.uint8, n, 8 * n)
                counts = np.frombuffer(body, "<u4", n, 9 * n).astype(np.int64)
                fours = int(((counts + 3) // 4).sum())
                control = np.frombuffer(body, np.uint8, fours, 13 * n)
                ids = id_of[decode_numbers(control, np.frombuffer(body, np.uint8, -1, 13 * n + fours), counts)]
                ends = np.append(0, np.cumsum(counts))
                values = {
                    "doc_id": lambda: pa.array(keys, mask=null.astype(bool)),
                    "start": lambda: pa.array(before + ends[:-1]),
                    "n_tokens": lambda: pa.array(counts),
                    "ids": lambda: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32))),
                    "ids_le": lambda: pa.Array.from_buffers(
                        pa.binary(), int(n),
                        [None, pa.py_buffer((4 * ends).astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())],
                    ),
                }
                yield pa.RecordBatch.from_arrays([values[c]() for c in self.names], schema=schema)


class IdSource(DataSource):
    """Reads give doc_id, start, n_tokens, and ids as an array (``ids``) or as bytes (``ids_le``)."""

    @classmethod
    def name(cls) -> str:
        return "tokenids"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return IdReader(schema, dict(self.options))

    def writer(self, schema, overwrite):
        return IdWriter(dict(self.options))


def write_ids(df: DataFrame, id_col: str, text: str, path: str, vocabulary_path: str = VOCABULARY, end: int = END) -> None:
    """Encode the texts of ``df`` and write their ids, each document's with ``end`` behind, to ``path``.

    Documents follow ascending ids, null ids first; documents of one id follow their number of ids
    and then their coded bytes. A null text is empty and leaves only ``end``. Only the two named
    columns are read. An empty table gives a folder without documents.
    """
    spark = df.sparkSession
    source = vocabulary(vocabulary_path)
    config = json.loads(source)
    size = max([*config["model"]["vocab"].values(), *[t["id"] for t in config["added_tokens"]], end]) + 1
    kind = "<u2" if size <= 1 << 16 else "<u4"
    raw = scratch_path(spark, "ids")
    token_ids(df, id_col, text, source, size).write.option("compression", "zstd").parquet(raw)
    found = spark.read.schema("doc_id long, ids binary, counts binary, places binary").parquet(raw)
    summaries = found.where("counts is not null")
    counts = summed(summaries, size)
    counts[end] += counts[size]
    order = np.lexsort((np.arange(size), -counts[:size])).astype("<u4")
    with Store(path).create(RANKS) as out:
        out.write(order.tobytes())
    rank = np.empty(size, np.uint32)
    rank[order] = np.arange(size, dtype=np.uint32)
    cuts = cut_points(summaries, width(spark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ids"):
                data, at = text_bytes(part.column("ids"))
                numbers, at = rank[data.view(kind)], at // np.dtype(kind).itemsize
                counts = np.diff(at) + 1
                full = np.full(int(counts.sum()), rank[end], np.uint32)
                body = np.ones(len(full), bool)
                body[np.cumsum(counts) - 1] = False
                full[body] = numbers
                control, coded, sizes = code_numbers(full, counts)
                fours = np.append(0, np.cumsum((counts + 3) // 4)).astype(np.int32)
                ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
                blobs = [
                    pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(o.tobytes()), pa.py_buffer(b.tobytes())])
                    for o, b in ((fours, control), (ends, coded))
                ]
                key = part.column("doc_id")
                # Null ids come first, with the smallest.
                place = np.searchsorted(cuts, key.fill_null(-(1 << 63)).to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [key, pa.array(counts), *blobs, pa.array(place.astype(np.int32))], names=["doc_id", "n", "control", "data", "place"]
                )

    ids = found.where("counts is null").select("doc_id", "ids")
    coded = ids.mapInArrow(run, "doc_id long, n long, control binary, data binary, place int")
    spark.dataSource.register(IdSource)
    (
        coded.repartitionById(len(cuts) + 1, F.col("place"))
        .drop("place")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n", "control", "data")
        .write.format("tokenids").mode("append").save(path)
    )


def read_ids(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    spark.dataSource.register(IdSource)
    return spark.read.format("tokenids").schema(schema).load(path)


@query("op9_token_ids")
def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "idfiles")
    write_ids(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", path)
    back = read_ids(spark, path, "doc_id long, start long, n_tokens long, ids_le binary")
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids_le").alias("ids_crc32"))
