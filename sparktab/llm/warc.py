"""WARC archives as a Spark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Archives are gzip members, one for each record, whose gzip header carries the compressed length (the
"sl" extra field). A reader inflates a member as far as its headers go, parses the WARC header, tests the
pushed predicates and, when the record or its payload isn't wanted, jumps to the next member.
Writers name split points in a manifest, so one large file gives many partitions. Archives without a
manifest or without the extra field are read too, one partition for each file.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringStartsWith,
    WriterCommitMessage,
)

from sparktab.llm.common import Store, query, table
from sparktab.session import scratch_path

SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, "
    "payload_digest string, payload_bytes long, payload binary"
)
HEADERS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
}
MANIFEST = "_warc_files.json"
SMALLEST_REVISIT = 100
# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP_EXTRA = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff"


def record_bytes(row: dict) -> bytes:
    """One WARC record: header, HTTP header, and for a response the payload."""
    payload = row["payload"] or b""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {row['payload_bytes']}\r\n\r\n"
    ).encode()
    full = row["record_type"] != "revisit"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <{row['record_id']}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + len(payload) * full}",
        f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
    ]
    if row["target_uri"] is not None:
        # A header value is one line; what would break it is percent-encoded.
        lines.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if ord(c) < 33 else c for c in row["target_uri"]))
    if not full:
        lines += [f"WARC-Refers-To: <{row['refers_to']}>", f"WARC-Profile: {PROFILE}"]
    head = ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass")
    return b"".join([head, http, payload if full else b"", b"\r\n\r\n"])


def member(data: bytes, level: int) -> bytes:
    """A gzip member that names its own length."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    length = len(GZIP_EXTRA) + 2 + 12 + len(body) + 8
    extra = struct.pack("<H2sHII", 12, b"sl", 8, length & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return b"".join([GZIP_EXTRA, extra, body, struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)])


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: [name, split points]."""

    files: list


class WarcWriter(DataSourceArrowWriter):
    """Each attempt writes files of its own name; only those in the manifest count."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        self.file_bytes = int(options.get("filebytes", 256 << 20))
        self.split_bytes = int(options.get("splitbytes", 16 << 20))
        self.level = int(options.get("level", 1))

    def write(self, iterator):
        folder = Store(self.path)
        files, out, at = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or at >= self.file_bytes:
                    if out is not None:
                        files[-1][1].append(at)
                        out.close()
                    name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    files.append([name, [0]])
                    out = folder.create(name)
                data = member(record_bytes(row), self.level)
                out.write(data)
                at += len(data)
                if at - files[-1][1][-1] >= self.split_bytes:
                    files[-1][1].append(at)
        if out is not None:
            if files[-1][1][-1] < at:
                files[-1][1].append(at)
            out.close()
        return Written(files)

    def commit(self, messages) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        with Store(self.path).create(MANIFEST) as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages) -> None:
        for m in messages:
            for name, _ in m.files if m is not None else []:
                Store(self.path).delete(name)


@dataclass
class Piece(InputPartition):
    name: str
    start: int
    stop: int


class Window:
    """Read-ahead over a file."""

    def __init__(self, file, ahead: int = 1 << 20) -> None:
        self.file, self.ahead, self.at, self.held = file, ahead, 0, b""

    def get(self, start: int, n: int) -> bytes:
        if start < self.at or start + n > self.at + len(self.held):
            self.file.seek(start)
            self.at, self.held = start, self.file.read(max(n, self.ahead))
        return self.held[start - self.at : start - self.at + n]


class Member:
    """A gzip member, inflated no further than asked."""

    def __init__(self, window: Window, start: int, stop: int, first: int) -> None:
        self.window, self.at, self.stop, self.step = window, start, stop, first
        self.inflate, self.rest, self.block = zlib.decompressobj(31), b"", b""

    def more(self) -> bool:
        """Inflate about as much again; false at the member's end."""
        if not self.rest and self.at < self.stop and not self.inflate.eof:
            self.rest = self.window.get(self.at, min(self.step, self.stop - self.at))
            self.at += len(self.rest)
        if not self.rest:
            return False
        self.block += self.inflate.decompress(self.rest, self.step)
        self.rest = self.inflate.unconsumed_tail
        self.step = max(self.step, len(self.block))
        return True

    def blank_line(self, start: int, stop: int | None = None) -> int:
        """The place behind the first blank line from ``start`` on; -1 if there is none, or none before ``stop``."""
        seen = start
        while (at := self.block.find(b"\r\n\r\n", max(start, seen - 3))) < 0:
            seen = len(self.block)
            if (stop is not None and seen >= stop) or not self.more():
                return -1
        return at + 4


def parse_header(text: bytes) -> dict:
    found = {}
    for line in text.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        value = value.strip().decode("utf-8", "replace")
        key = key.strip().lower().decode("latin-1")
        if key in ("warc-record-id", "warc-refers-to"):
            value = value.strip("<>")
        found[key] = value
    if "warc-payload-digest" in found:
        found["warc-payload-digest"] = found["warc-payload-digest"].rpartition(":")[2]
    return found


def is_http(header: dict) -> bool:
    return header.get("content-type", "").startswith("application/http")


def http_parts(block: bytes, header: dict) -> tuple[int, int]:
    """(start of the payload in a block, full length of the payload), from the block's first bytes."""
    total = int(header.get("content-length", 0))
    if not is_http(header):
        return 0, total
    stop = block.find(b"\r\n\r\n")
    if stop < 0:
        return 0, total
    for line in block[:stop].split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == b"content-length" and value.strip().isdigit():
            return stop + 4, int(value)
    return stop + 4, total - stop - 4


def wanted(header: dict, tests: list) -> bool:
    for kind, column, value in tests:
        have = header.get(HEADERS[column])
        if kind == "in":
            ok = have is not None and have in value
        elif kind == "starts":
            ok = have is not None and have.startswith(value)
        else:
            ok = (have is None) == (kind == "null")
        if not ok:
            return False
    return True


def records(window: Window, start: int, stop: int, tests: list, payloads: bool, first: int = 4096):
    """(header, payload length, payload or None) of the wanted records."""
    while start < stop:
        lead = window.get(start, min(first, stop - start))
        if lead[:2] == b"\x1f\x8b":
            skip = 0
            if lead[: len(GZIP_EXTRA)] == GZIP_EXTRA and lead[12:14] == b"sl":
                skip = struct.unpack_from("<I", lead, 16)[0]
            opened = Member(window, start, stop, first)
            header_end = opened.blank_line(0)
            if header_end < 0:
                raise ValueError(f"the archive's member at byte {start} has no whole WARC header")
            header = parse_header(opened.block[: header_end - 4])
            size = int(header.get("content-length", 0))
            take = wanted(header, tests)
            if skip and not (take and payloads):
                if take and is_http(header):
                    opened.blank_line(header_end, header_end + size)
                body = opened.block[header_end : header_end + size]
                length = skip
            else:
                if skip:
                    inflate = zlib.decompressobj(31)
                    block = inflate.decompress(window.get(start, skip))
                    length = skip
                else:
                    # The member's end is known only after inflating all of it.
                    inflate, parts, length = zlib.decompressobj(31), [], 0
                    while not inflate.eof and start + length < stop:
                        chunk = window.get(start + length, min(1 << 20, stop - start - length))
                        parts.append(inflate.decompress(chunk))
                        length += len(chunk) - len(inflate.unused_data)
                    block = b"".join(parts)
                body = block[header_end : header_end + size]
        else:
            while b"\r\n\r\n" not in lead and len(lead) < stop - start:
                lead = window.get(start, min(2 * len(lead), stop - start))
            header_end = lead.find(b"\r\n\r\n") + 4
            if header_end < 4:
                if lead.strip():
                    raise ValueError(f"the archive's record at byte {start} has no whole WARC header")
                return
            header = parse_header(lead[: header_end - 4])
            size = int(header.get("content-length", 0))
            take = wanted(header, tests)
            length = header_end + size + 4
            seen = size if take and payloads else min(size, first)
            body = window.get(start + header_end, seen)
            while take and is_http(header) and seen < size and b"\r\n\r\n" not in body:
                seen = min(2 * seen, size)
                body = window.get(start + header_end, seen)
        if take:
            at, full = http_parts(body, header)
            keep = payloads and header.get("warc-type") != "revisit"
            yield header, full, body[at:] if keep else None
        start += length


class WarcReader(DataSourceReader):
    def __init__(self, schema, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        self.names = [f.name for f in schema.fields]
        self.tests: list = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in HEADERS:
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append(("in", name, (f.value,)))
            elif isinstance(f, In):
                self.tests.append(("in", name, tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append(("starts", name, f.value))
            elif isinstance(f, IsNull):
                self.tests.append(("null", name, None))
            elif isinstance(f, IsNotNull):
                self.tests.append(("set", name, None))
            else:
                yield f

    def partitions(self):
        folder = Store(self.path)
        if folder.has(MANIFEST):
            with folder.open(MANIFEST) as f:
                files = json.loads(f.read())
            pieces = [Piece(name, a, b) for name, cuts in files for a, b in zip(cuts, cuts[1:], strict=False)]
        else:
            pieces = [Piece(name, 0, size) for name, size in folder.files() if name.endswith((".warc", ".warc.gz"))]
        return pieces or [Piece("", 0, 0)]

    def read(self, partition):
        types = {"payload_bytes": pa.int64(), "payload": pa.binary()}
        schema = pa.schema([(n, types.get(n, pa.string())) for n in self.names])
        if partition.stop <= partition.start:
            return
        rows, size = [], 0
        with Store(self.path).open(partition.name) as file:
            for header, full, payload in records(
                Window(file), partition.start, partition.stop, self.tests, "payload" in self.names
            ):
                values = {"payload_bytes": full, "payload": payload}
                rows.append({n: values[n] if n in values else header.get(HEADERS[n]) for n in self.names})
                size += 500 + len(payload or b"")
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcSource(DataSource):
    """Options of writes: filebytes, splitbytes, level. A read schema without ``payload`` skips payloads."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    """Make the source known and let Spark push predicates into it."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def urn(key: Column) -> Column:
    """A UUID URN (version 8: own content) that holds a 64-bit key."""
    digits = F.coalesce(F.lpad(F.hex(key.cast("long")), 30, "0"), F.lit("f" * 30))
    cut = [F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 3), (16, 3), (19, 12))]
    return F.lower(
        F.concat(F.lit("urn:uuid:"), cut[0], F.lit("-"), cut[1], F.lit("-8"), cut[2], F.lit("-8"), cut[3], F.lit("-"), cut[4])
    )


def key_of(name: Column) -> Column:
    """The key in such a URN; null if it held none."""
    s = F.regexp_replace(F.substring(name, 10, 36), "-", "")
    digits = F.concat(F.substring(s, 1, 12), F.substring(s, 14, 3), F.substring(s, 18, 15))
    return F.when(~digits.startswith("f"), F.conv(F.substring(digits, 15, 16), 16, -10).cast("long"))


def archive_records(pages: DataFrame, id_col: str, url: str, html: str) -> DataFrame:
    """Rows of the source's schema. Of equal payloads of at least 100 bytes, the record with the
    smallest id is the response and the others revisit it.

    A null payload is empty; a null id revisits when its group has an id, and is a response
    otherwise; repeated rows of a group's smallest id all stay responses. Only the three named
    columns are read.
    """
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url).cast("string").alias("target_uri"), body.alias("payload"),
        F.sha2(body, 256).alias("payload_digest"), F.octet_length(body).cast("long").alias("payload_bytes"),
    )
    firsts = (
        rows.where(F.col("payload_bytes") >= SMALLEST_REVISIT).groupBy("payload_digest")
        .agg(F.min("id").alias("first"), F.count("*").alias("n")).where((F.col("n") > 1) & F.col("first").isNotNull())
        .drop("n")
    )
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return rows.join(firsts, "payload_digest", "left").select(
        urn(F.col("id")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(again, urn(F.col("first"))).alias("refers_to"),
        "payload_digest", "payload_bytes",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write_warc(records_: DataFrame, path: str, **options) -> None:
    register(records_.sparkSession)
    records_.write.format("warc").options(**options).mode("append").save(path)


def read_warc(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    return register(spark).read.format("warc").schema(schema).load(path)


@query(
    "op1_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS n, sha256(body) AS digest FROM p),
    g AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d),
    v AS (SELECT *, n >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM g)
    SELECT page_id, n AS payload_bytes, digest AS payload_digest,
      CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN again THEN first END AS refers_to
    FROM v""",
)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(archive_records(table(spark, sf_dir, "pages"), "page_id", "url", "html"), path)
    back = read_warc(spark, path)
    full = F.col("record_type") == "response"
    digest = F.when(full, F.sha2("payload", 256)).otherwise(F.col("payload_digest"))
    return back.select(
        key_of(F.col("record_id")).alias("page_id"),
        F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(digest == F.col("payload_digest"), digest)
        .otherwise(F.raise_error(F.lit("an archived payload doesn't have its digest"))).alias("payload_digest"),
        "record_type",
        key_of(F.col("refers_to")).alias("refers_to"),
    )
