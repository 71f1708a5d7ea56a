"""What several operators of this package share: registry, Arrow batches of texts, packed blobs."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktab.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(tune(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Number of buckets for an exchange that operators deal out by themselves."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, in any spelling."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes in ``column``; one row at least."""
    _, offsets = text_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without a copy, and the rows' offsets (null: empty)."""
    kind = column.type
    if pa.types.is_null(kind) or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    wide = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = at.astype(np.int64)
    return raw[at[0] : at[-1]], at - at[0]


class Store:
    """Files of a shared folder. Plain paths and ``file:`` use the mounted disk, all others Arrow's file systems."""

    def __init__(self, path: str) -> None:
        local = "://" not in path and not path.startswith("file:")
        if local or path.startswith("file:"):
            self.fs, self.folder = None, path if local else "/" + path.removeprefix("file:").lstrip("/")
        else:
            from pyarrow import fs

            self.fs, self.folder = fs.FileSystem.from_uri(path)
        self.folder = self.folder.rstrip("/")

    def create(self, name: str):
        if self.fs is None:
            os.makedirs(self.folder, exist_ok=True)
            return open(f"{self.folder}/{name}", "wb")
        self.fs.create_dir(self.folder, recursive=True)
        return self.fs.open_output_stream(f"{self.folder}/{name}")

    def open(self, name: str):
        full = f"{self.folder}/{name}"
        return open(full, "rb") if self.fs is None else self.fs.open_input_file(full)

    def has(self, name: str) -> bool:
        full = f"{self.folder}/{name}"
        return os.path.exists(full) if self.fs is None else self.fs.get_file_info(full).is_file

    def delete(self, name: str) -> None:
        full = f"{self.folder}/{name}"
        os.remove(full) if self.fs is None else self.fs.delete_file(full)

    def files(self) -> list[tuple[str, int]]:
        """(name under the folder, bytes) of all files."""
        if self.fs is None:
            found = [os.path.join(d, f) for d, _, names in os.walk(self.folder) for f in names]
            return sorted((os.path.relpath(f, self.folder), os.path.getsize(f)) for f in found)
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(self.folder, recursive=True))
        return sorted((f.path[len(self.folder) + 1 :], f.size) for f in found if f.is_file)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of known types as one compressed value."""
    head = np.array([len(arrays), *[a.nbytes for a in arrays]], np.int64)
    return zstandard.compress(b"".join([head.tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]]), 1)


def unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8)
    out, at = [], 8 * (n + 1)
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(raw, kind, int(size) // np.dtype(kind).itemsize, at))
        at += int(size)
    return out


def unpack_all(blobs: Iterable[bytes], *kinds: type) -> list[np.ndarray]:
    """Each array of all blobs, one after another."""
    parts = [unpack(b, *kinds) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(kinds)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input moves every bit of the output (fixed values)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_codes(seed: int = 7) -> np.ndarray:
    """A 64-bit code for each byte."""
    return mixed((np.arange(1, 257, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0x9E3779B97F4A7C15))


def runs(gap: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs without a gap, cut at the texts' ends: (starts, stops, numbers of the texts)."""
    held = ~gap
    start = held.copy()
    start[1:] &= gap[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(gap)]
    start[edges] = held[edges]
    stop = held.copy()
    stop[:-1] &= gap[1:] | start[1:]
    starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return starts, stops, np.searchsorted(offsets, starts, side="right") - 1


def run_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run's bytes: a polynomial over codes of the bytes, then a finalizer."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power = np.full(int((stops - starts).max()), 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    begin = np.zeros(len(data), np.int64)
    begin[starts] = starts
    place = np.minimum(np.arange(len(data)) - np.maximum.accumulate(begin), len(power) - 1)
    code = byte_codes()[data] * power[place]
    total = np.append(np.uint64(0), np.cumsum(code, dtype=np.uint64))
    return mixed(total[stops] - total[starts] + (stops - starts).astype(np.uint64))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all ranges [start, start + length), one range after another."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def run_starts(values: np.ndarray) -> np.ndarray:
    """True where a sorted array's value differs from the one before."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return new


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Smallest id reachable over undirected edges, for each id in an edge with another: (id, component).

    Alternates two steps until the edges are stars around their smallest ids. In the first, each id
    links its larger neighbours to the smallest id around it; in the second, each id links its smaller
    neighbours and itself to the smallest of them. Minima are pre-aggregated before each shuffle, joins
    with one row for each id leave adaptive execution free to split what a hub gathers, and each
    round's edges are written to the shared folder, so lost executors don't lose rounds.
    """
    from sparktab.session import materialize

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))).first())

    a, b = F.col(left), F.col(right)
    pairs = edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    pairs = materialize(pairs, "edges")
    now = state(pairs)
    while True:
        around = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        far = around.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = far.groupBy("a").agg(F.min("b").alias("m"))
        near = far.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = materialize(near.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        before, now = now, state(pairs)
        if now == before:
            tops = pairs.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            return pairs.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(tops)
