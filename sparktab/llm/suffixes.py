"""Repeated passages across documents, by suffix arrays built with a difference cover.

A byte string of ``least`` bytes that starts in a document with a smaller id is removed wherever it
occurs. Equal strings must meet in one task, and only text that can hold one should travel:

1. Each window of ``least`` bytes names its anchor, the k-gram in it with the smallest hash; equal windows
   name equal anchors. Anchors that only one text holds are dropped (exact copies count as one text).
2. Around each other anchor the stretch of its windows is dealt out by the anchor. Equal stretches of
   one task travel once.
3. Each part builds the suffix array of its different stretches by the difference cover modulo 3: sort the
   sampled suffixes' triples, recurse on their names until all differ, place the remaining suffixes by
   one symbol and the rank behind it, and merge. Adjacent suffixes whose first
   ``least`` bytes agree form a group; its smallest document id decides.

Parts are cut by the anchors' hashes, and the stretches of one frequent passage are mostly equal and travel
once for each task. Where a frequent anchor has many different stretches (around the edges of such a passage),
its windows are dealt out one by one instead, each by its own hash: only equal windows must meet.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktab.llm.common import (
    byte_codes,
    mixed,
    pack,
    query,
    ragged,
    run_starts,
    slices,
    table,
    text_bytes,
    unpack_all,
    width,
)
from sparktab.llm.similar import GATHER, blobs, bucket_of
from sparktab.session import spread

LEAST = 50
#: Bytes of different stretches that one suffix array is built over.
ARRAY_BYTES = 1 << 20
#: Bytes of stretches that a task gathers before it hands them on.
STRETCHES = 12 << 20
#: An anchor with more (text, mark of the stretch) than HOT, of at least MARKS different marks (of 256), is dealt by windows.
HOT = 4096
MARKS = 128
HOT_BIT = np.uint64(1 << 63)
HASH = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
NO_ID = np.iinfo(np.int64).max


def anchors(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, hash of the anchor, a byte from the hash of their stretch) of each run of windows with one anchor."""
    k = 2 * least // 5
    w = least - k + 1
    n = len(data)
    inside = np.zeros(n, bool)
    size = np.diff(offsets)
    inside[ragged(offsets[:-1], np.maximum(size - least + 1, 0))] = True
    if not inside.any():
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.uint8))
    inverse = pow(HASH, -1, 1 << 64)
    power = np.full(n, HASH, np.uint64)
    back = np.full(n, inverse, np.uint64)
    power[0] = back[0] = 1
    power, back = np.cumprod(power, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
    total = np.append(np.uint64(0), np.cumsum(byte_codes()[data] * power, dtype=np.uint64))
    key = mixed((total[k:] - total[:-k]) * back[: n - k + 1])
    # The upper half decides, then the position: a minimum names its place.
    value = (key & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(key), dtype=np.uint64)
    span = 1
    while 2 * span <= w:
        value = np.minimum(value[:-span], value[span:])
        span *= 2
    if span < w:
        value = np.minimum(value[: len(value) - (w - span)], value[w - span :])
    window = np.flatnonzero(inside)
    anchor = (value[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = run_starts(anchor)
    low = window[first]
    high = window[np.append(np.flatnonzero(first)[1:] - 1, len(window) - 1)]
    anchor = anchor[first]
    mark = mixed((total[high + least] - total[low]) * back[low]) >> np.uint64(56)
    return low, high, key[anchor], mark.astype(np.uint8)


def order_of(key: np.ndarray, bits: int) -> np.ndarray:
    """The stable order of unsigned keys below ``2**bits``, sixteen bits at a time, which numpy sorts by counting."""
    order = np.argsort((key & np.uint64(0xFFFF)).astype(np.uint16), kind="stable")
    for low in range(16, bits, 16):
        digit = ((key >> np.uint64(low)) & np.uint64(0xFFFF)).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]
    return order


def names_of(key: np.ndarray, bits: int = 64) -> tuple[np.ndarray, int]:
    """Dense names, from 1, in the order of the keys (below ``2**bits``); how many."""
    order = order_of(key, bits)
    new = run_starts(key[order])
    names = np.empty(len(key), np.int64)
    names[order] = np.cumsum(new)
    return names, int(new.sum())


def joint_key(*parts: tuple[np.ndarray, int]) -> tuple[np.ndarray, int]:
    """One key, and its bits, that sorts as the parts (numbers, bits) do one after the other."""
    key, bits = parts[0][0].astype(np.uint64), parts[0][1]
    for part, more in parts[1:]:
        if bits + more > 64:
            key, many = names_of(key, bits)
            key, bits = key.astype(np.uint64), many.bit_length()
        key, bits = (key << np.uint64(more)) | part.astype(np.uint64), bits + more
    return key, bits


def suffix_ranks(s: np.ndarray) -> np.ndarray:
    """Ranks, from 1, of all suffixes of ``s`` (numbers from 1 to below 2**32), by the difference cover modulo 3."""
    n = len(s)
    if n < 4:
        tails = [s[i:].tolist() for i in range(n)]
        order = sorted(tails)
        return np.array([order.index(x) + 1 for x in tails], np.int64)
    t = np.concatenate([s, np.zeros(5, s.dtype)])
    one, two, rest = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate([one, two])
    symbol, place_bits = int(s.max()).bit_length(), len(sample).bit_length()
    names, many = names_of(*joint_key((t[sample], symbol), (t[sample + 1], symbol), (t[sample + 2], symbol)))
    if many < len(sample):
        # The names of the suffixes at 1, 4, 7, ... and then of those at 2, 5, 8, ... are the next string.
        names = suffix_ranks(names)
    rank = np.zeros(n + 5, np.int64)
    rank[sample] = names
    # All names differ now, so the sampled suffixes are in order by their names, without another sort.
    in_order = np.empty(len(sample), np.int64)
    in_order[names - 1] = sample
    from_one = in_order % 3 == 1
    by_one, by_two = in_order[from_one], in_order[~from_one]
    # Remaining suffixes: one symbol, then the rank behind it, which has its order. Against suffixes at 1, 4, ...
    # the same comparison serves; against those at 2, 5, ... two symbols and the rank behind them.
    by_rest = by_one - 1
    by_rest = by_rest[order_of(t[by_rest].astype(np.uint64), symbol)]
    by_one = by_one[by_one < n]
    ends = len(by_rest)
    near, _ = joint_key((np.concatenate([t[by_rest], t[by_one]]), symbol), (np.concatenate([rank[by_rest + 1], rank[by_one + 1]]), place_bits))
    both = np.concatenate([by_rest, by_two])
    far, _ = joint_key((t[both], symbol), (t[both + 1], symbol), (rank[both + 2], place_bits))
    before = np.searchsorted(near[ends:], near[:ends]) + np.searchsorted(far[ends:], far[:ends])
    place = np.empty(n, np.int64)
    at = np.arange(ends) + before
    place[by_rest] = at
    taken = np.zeros(n, bool)
    taken[at] = True
    place[in_order[in_order < n]] = np.flatnonzero(~taken)
    return place + 1


def window_groups(data: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """A number for each window of ``least`` bytes at ``starts``, equal for equal windows."""
    if not len(starts):
        return np.zeros(0, np.int64)
    rank = suffix_ranks(data.astype(np.int64) + 1)
    # The windows in the order of their ranks, which all differ.
    number = np.full(len(data), -1, np.int64)
    number[rank[starts] - 1] = np.arange(len(starts))
    order = number[number >= 0]
    at = starts[order]
    # Adjacent prefixes, eight bytes at a time; the last eight may overlap those before.
    pad = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(pad, 8)
    new = np.zeros(len(at), bool)
    new[0] = True
    steps = [*range(0, least - 7, 8), least - 8] if least >= 8 else []
    for step in steps:
        word = np.ascontiguousarray(eight[at + step]).view("<u8").ravel()
        new[1:] |= word[1:] != word[:-1]
    for step in range(least) if least < 8 else []:
        new[1:] |= pad[at[1:] + step] != pad[at[:-1] + step]
    out = np.empty(len(at), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def dealt_anchors(docs: DataFrame, least: int, n_buckets: int) -> DataFrame:
    """(bucket, blob): postings (upper half of the anchor's hash, mark of the stretch, text's signature), by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                low, _, key, mark = anchors(data, offsets, least)
                sig = part.column("sig").to_numpy()
                held.append((key, mark, sig[np.searchsorted(offsets, low, side="right") - 1]))
            if sum(len(h[0]) for h in held) >= GATHER:
                yield from flush(held)
                held = []
        if held:
            yield from flush(held)

    def flush(held):
        key, mark, sig = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((mark, key, sig))
        key, mark, sig = key[order], mark[order], sig[order]
        new = run_starts(key) | run_starts(sig) | run_starts(mark)
        key, mark, sig = key[new], mark[new], sig[new]
        return blobs(["bucket", "blob"], bucket_of(key, n_buckets), (key >> np.uint64(32)).astype(np.uint32), mark, sig)

    return docs.select("sig", "text").mapInArrow(run, "bucket int, blob binary")


def shared_anchors(dealt: DataFrame) -> DataFrame:
    """(sig, blob): the anchors of a text that other texts have, some in each row; with HOT_BIT if dealt by windows."""

    def run(group: pa.Table) -> pa.Table:
        own = group["bucket"][0].as_py()
        key, mark, sig = unpack_all((b.as_py() for b in group["blob"]), np.uint32, np.uint8, np.int64)
        order = np.lexsort((mark, sig, key))
        key, mark, sig = key[order], mark[order], sig[order]
        text = run_starts(key) | run_starts(sig)
        new = text | run_starts(mark)
        key, mark, sig, text = key[new], mark[new], sig[new], text[new]
        first = np.flatnonzero(run_starts(key))
        many = np.diff(np.append(first, len(key)))
        hot = many > HOT
        for i in np.flatnonzero(hot).tolist():
            hot[i] = len(np.unique(mark[first[i] : first[i] + many[i]])) >= MARKS
        several = (np.repeat(np.add.reduceat(text.astype(np.int64), first), many) > 1) & text
        named = (np.uint64(own) << np.uint64(32)) | key[several].astype(np.uint64)
        named |= np.where(np.repeat(hot, many)[several], HOT_BIT, np.uint64(0))
        sig = sig[several]
        order = np.argsort(sig, kind="stable")
        sig, named = sig[order], named[order]
        first = np.flatnonzero(run_starts(sig))
        ends = np.append(first, len(sig)).astype(np.int32) * 8
        lists = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(named.tobytes())])
        return pa.table([pa.array(sig[first]), lists], names=["sig", "blob"])

    return dealt.groupBy("bucket").applyInArrow(run, "sig long, blob binary")


def dealt_stretches(texts: DataFrame, least: int, n_buckets: int) -> DataFrame:
    """(bucket, blob): stretches around shared anchors, or their single windows, of rows (sig, doc_id, text, blobs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, bytes], int] = {}
        places: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                low, high, key, _ = anchors(data, offsets, least)
                doc = np.searchsorted(offsets, low, side="right") - 1
                bucket = bucket_of(key, n_buckets)
                named = (bucket.astype(np.uint64) << np.uint64(32)) | (key >> np.uint64(32))
                kept, hot = np.zeros(len(low), bool), np.zeros(len(low), bool)
                lists = part.column("blobs").to_pylist()
                bounds = np.searchsorted(doc, np.arange(len(lists) + 1))
                for i, own in enumerate(lists):
                    a, b = bounds[i], bounds[i + 1]
                    if a < b and own:
                        names = np.frombuffer(b"".join(own), np.uint64)
                        kept[a:b] = np.isin(named[a:b], names & ~HOT_BIT)
                        hot[a:b] = np.isin(named[a:b] | HOT_BIT, names)
                raw = data.tobytes()
                rows, single = np.flatnonzero(kept & ~hot), np.flatnonzero(hot)
                windows = high[single] - low[single] + 1
                alone = ragged(low[single], windows)
                own_key = mixed(np.array([zlib.crc32(raw[a : a + least]) for a in alone.tolist()], np.uint64))
                begin, end = np.append(low[rows], alone), np.append(high[rows], alone) + least
                code = np.append(key[rows], own_key)
                rows = np.append(rows, np.repeat(single, windows))
                number = np.empty(len(rows), np.int64)
                dealt, upper = bucket_of(code, n_buckets), (code >> np.uint64(48)).astype(np.int64)
                for j, (a, b, c, u) in enumerate(zip(begin.tolist(), end.tolist(), dealt.tolist(), upper.tolist(), strict=True)):
                    own_ = ((c << 16) | u, raw[a:b])
                    at = found.get(own_)
                    if at is None:
                        at = found[own_] = len(found)
                        held += b - a
                    number[j] = at
                sig, ids = part.column("sig").to_numpy(), part.column("doc_id").to_numpy()
                places.append(np.stack([number, sig[doc[rows]], ids[doc[rows]], begin - offsets[doc[rows]]], 1))
                if held >= STRETCHES or sum(map(len, places)) > GATHER:
                    yield from flush(found, places)
                    found, places, held = {}, [], 0
        if found:
            yield from flush(found, places)

    def flush(found, places):
        every = np.concatenate(places)
        head = np.fromiter((h for h, _ in found), np.int64, len(found))
        texts_ = [t for _, t in found]
        order = np.argsort(head >> 16, kind="stable")
        bucket = head[order] >> 16
        place_of = np.empty(len(order), np.int64)
        place_of[order] = np.arange(len(order))
        every[:, 0] = place_of[every[:, 0]]
        every = every[np.argsort(every[:, 0], kind="stable")]
        first = np.flatnonzero(run_starts(bucket))
        ends = np.append(first[1:], len(bucket))
        for a, b in zip(first, ends, strict=True):
            own = [texts_[i] for i in order[a:b]]
            rows = every[np.searchsorted(every[:, 0], a) : np.searchsorted(every[:, 0], b)]
            packed = pack(
                np.array([len(x) for x in own], np.uint32), (head[order[a:b]] & 0xFFFF).astype(np.uint16),
                np.frombuffer(b"".join(own), np.uint8), (rows[:, 0] - a).astype(np.uint32),
                rows[:, 1], rows[:, 2], rows[:, 3].astype(np.uint32),
            )
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a])], pa.int32()), pa.array([packed], pa.binary())], names=["bucket", "blob"])

    return texts.mapInArrow(run, "bucket int, blob binary")


def repeated_spans(stretches: DataFrame, least: int) -> DataFrame:
    """(sig, start, stop): bytes of a text covered by windows that start in a document with a smaller id."""
    from sparktab.llm.common import unpack

    def run(group: pa.Table) -> pa.Table:
        found: dict[bytes, int] = {}
        heads: list[int] = []
        number, sig, doc, place = [], [], [], []
        for blob in group["blob"]:
            sizes, head, data, row, own_sig, own_doc, own_place = unpack(
                blob.as_py(), np.uint32, np.uint16, np.uint8, np.uint32, np.int64, np.int64, np.uint32
            )
            raw, ends = data.tobytes(), np.append(0, np.cumsum(sizes, dtype=np.int64)).tolist()
            names = np.empty(len(sizes), np.int64)
            for i, h in enumerate(head.tolist()):
                text = raw[ends[i] : ends[i + 1]]
                names[i] = found.setdefault(text, len(found))
                if names[i] == len(heads):
                    heads.append(h)
            number.append(names[row])
            sig.append(own_sig)
            doc.append(own_doc)
            place.append(own_place.astype(np.int64))
        number, sig, doc, place = (np.concatenate(x) for x in (number, sig, doc, place))
        texts = list(found)
        sizes = np.array([len(x) for x in texts], np.int64)
        least_doc = np.full(len(texts), NO_ID, np.int64)
        np.minimum.at(least_doc, number, doc)
        # Arrays of bounded size; stretches of one anchor, and equal windows, have one head and stay together.
        order = np.argsort(np.array(heads), kind="stable")
        heads = np.array(heads)[order]
        filled = np.cumsum(sizes[order]) // ARRAY_BYTES
        begins = np.flatnonzero(run_starts(heads))
        cut = begins[np.append(True, filled[begins[1:]] != filled[begins[:-1]])]
        by_number = np.argsort(number, kind="stable")
        at = np.searchsorted(number[by_number], np.arange(len(texts) + 1))
        out = []
        for part in np.split(order, cut[1:]):
            data = np.frombuffer(b"".join([texts[i] for i in part]), np.uint8)
            ends = np.cumsum(sizes[part])
            n_windows = sizes[part] - least + 1
            starts = ragged(ends - sizes[part], n_windows)
            group_ = window_groups(data, starts, least)
            smallest = np.full(int(group_.max()) + 1, NO_ID, np.int64)
            np.minimum.at(smallest, group_, np.repeat(least_doc[part], n_windows))
            smallest = smallest[group_]
            first = np.cumsum(n_windows) - n_windows
            # Each place of each stretch, in pieces.
            places = at[part + 1] - at[part]
            rows = by_number[ragged(at[part], places)]
            of = np.repeat(np.arange(len(part)), places)
            for k in range(0, len(rows), 1 << 15):
                r, o = rows[k : k + (1 << 15)], of[k : k + (1 << 15)]
                window = ragged(first[o], n_windows[o])
                owner = np.repeat(np.arange(len(r)), n_windows[o])
                hit = smallest[window] < doc[r][owner]
                begin = hit & ~np.append(False, hit[:-1] & (owner[1:] == owner[:-1]))
                end = hit & ~np.append(hit[1:] & (owner[1:] == owner[:-1]), False)
                b, e = np.flatnonzero(begin), np.flatnonzero(end)
                start = place[r][owner[b]] + window[b] - first[o][owner[b]]
                out.append(np.stack([sig[r][owner[b]], start, start + (e - b) + least], 1))
        spans = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
        return pa.table({"sig": spans[:, 0], "start": spans[:, 1].astype(np.int32), "stop": spans[:, 2].astype(np.int32)})

    return stretches.groupBy("bucket").applyInArrow(run, "sig long, start int, stop int")


def cut_texts(texts: DataFrame, form: str) -> DataFrame:
    """(sig, first, n_removed, n_spans, kept) of rows (sig, first, text, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, kept = [], [], []
            for text, own in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                parts, at, n, last = [], 0, 0, -1
                for a, b in sorted((s["start"], s["stop"]) for s in own or []):
                    if a > last:
                        n += 1
                        parts.append(raw[at:a])
                    last = max(last, b)
                    at = last
                left = b"".join([*parts, raw[at:]])
                removed.append(len(raw) - len(left))
                spans.append(n)
                if form == "sha256":
                    left = hashlib.sha256(left).hexdigest().encode()
                elif form == "text":
                    left = left.decode("utf-8", "ignore").encode()
                kept.append(left)
            yield pa.RecordBatch.from_arrays(
                [batch.column("sig"), batch.column("first"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                names=["sig", "first", "n_removed", "n_spans", "kept"],
            )

    return texts.mapInArrow(run, "sig long, first long, n_removed long, n_spans long, kept binary")


def remove_repeats(
    docs: DataFrame, id_col: str, text: str, least: int = LEAST, form: str = "bytes", keep: list[str] | None = None
) -> DataFrame:
    """Every row (columns ``keep``; all, if None) with n_bytes, n_removed, n_spans and kept.

    Texts are taken as UTF-8 bytes (null: empty); each byte covered by a string of ``least`` bytes that
    also starts in a row with a smaller id is removed. Strings don't cross texts, overlaps count, and
    all is judged on the texts as given. ``kept`` holds the remaining bytes, or by ``form`` their "sha256" as
    hex, or "text", without what is left of characters cut in two; n_spans counts the maximal removed runs. Rows of one id don't remove from each
    other; null ids are larger than all others. Exact copies are told by their MD5. Columns of the added
    names, in any spelling, are replaced.
    """
    n_buckets = width(docs.sparkSession)
    added = ["n_bytes", "n_removed", "n_spans", "kept"]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    md5 = F.md5(body.cast("binary"))
    # Never null, and known to be so: both joins below then read one and the same exchange of the texts.
    sig = F.coalesce(F.conv(F.substring(md5, 1, 16), 16, -10).cast("long"), F.lit(0).cast("long"))
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(int(NO_ID)))
    plain = docs.select(sig.alias("sig"), key.alias("doc_id"), body.alias("text"))
    shared = shared_anchors(dealt_anchors(plain, least, n_buckets)).groupBy("sig").agg(F.collect_list("blob").alias("blobs"))
    # One row for each different text; copies meet in the map tasks already.
    texts = plain.groupBy("sig").agg(F.min("doc_id").alias("first"), F.min("text").alias("text"))
    held = texts.join(shared, "sig").select("sig", F.col("first").alias("doc_id"), "text", "blobs")
    spans = repeated_spans(dealt_stretches(held, least, n_buckets), least)
    spans = spans.groupBy("sig").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    cut = cut_texts(texts.join(spans, "sig", "left").select("sig", "first", "text", "spans"), form)
    own = docs.select(
        *[F.col(f"`{c}`") for c in kept if c.lower() != text.lower() or form == "sha256"], sig.alias("_sig"), key.alias("_id"),
        F.octet_length(body).cast("long").alias("_size"),
    )
    cut = cut.select(F.col("sig").alias("_sig"), F.col("first").alias("_first"), F.col("n_removed").alias("_removed"), F.col("n_spans").alias("_spans"), F.col("kept").alias("_kept"))
    whole = (F.col("_id") > F.col("_first")) & (F.col("_size") >= least)
    empty = F.lit(hashlib.sha256(b"").hexdigest()).cast("binary") if form == "sha256" else F.lit("").cast("binary")
    out = F.when(whole, empty).otherwise(F.col("_kept"))
    return own.join(cut, "_sig").select(
        *[F.col(f"`{c}`") for c in kept if c.lower() != text.lower() or form == "sha256"], F.col("_size").alias("n_bytes"),
        F.when(whole, F.col("_size")).otherwise(F.col("_removed")).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.col("_spans")).alias("n_spans"),
        (out if form == "bytes" else out.cast("string")).alias("kept"),
    )


@query(
    "op7_suffix_dedup",
    """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    piece AS (SELECT doc_id, b, substr(h, 2 * b + 1, 1122) AS t FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49, 512)) AS b FROM d)),
    w AS (SELECT doc_id, b + j AS i, substr(t, 2 * j + 1, 100) AS g
      FROM (SELECT doc_id, b, t, unnest(range(least(512, length(t) // 2 - 49))) AS j FROM piece)),
    m AS (SELECT g, min(doc_id) AS least FROM w GROUP BY g HAVING min(doc_id) < max(doc_id)),
    hit AS (SELECT doc_id, i FROM w JOIN m USING (g) WHERE least < doc_id),
    brk AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS new FROM hit),
    num AS (SELECT doc_id, i, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM brk),
    span AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM num GROUP BY doc_id, run),
    cut AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM span),
    part AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, max(b) AS last,
        string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS head FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
      CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
      sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
    FROM d LEFT JOIN part USING (doc_id)""",
)
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = remove_repeats(docs, "doc_id", "text", form="sha256", keep=["doc_id"])
    return out.withColumnRenamed("kept", "kept_sha256")
