"""Near-duplicate documents: an exact Jaccard join on word shingles by T-occurrence search.

Two documents link when their shingle sets reach a Jaccard similarity. For a set of n shingles that
means T = ceil(similarity * n) common shingles at least, so candidates are the documents that occur in
T of its inverted lists. DivideSkip finds them: the short lists are merged on a heap, and only what
reaches T minus the number of long lists is looked up in the long ones by binary search.

To run the search in many tasks, documents that may link must meet in one:

1. Equal sets become one class.
2. Of each set the n - T + t smallest shingles (by hash) are dealt out by shingle; linked sets share t of
   these at least. Shingles that no other set has are dropped there, and so are sets left with too few.
3. Of the remaining shingles, the rarest that must hold a common one become a set's short lists; sets in
   one list are joined to its smallest. The connected parts of these stars go to one task each.

Parts with more sets than a task should hold are searched block by block, see ``search_blocks``.
No pairs are listed: a search stops at sets that are connected already.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktab.llm.common import (
    components,
    mixed,
    pack,
    query,
    run_hashes,
    run_starts,
    runs,
    slices,
    table,
    text_bytes,
    unpack_all,
    width,
)
from sparktab.session import materialize, spread

WORDS = 5
PERCENT = 80
#: Postings a task gathers before it hands them on, and sets of one part that a task searches.
GATHER = 1 << 20
PART = 20_000
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
GAP = np.zeros(256, bool)
GAP[[32, *range(9, 14)]] = True


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the different shingles of each text, ascending; text i has bounds[i] to bounds[i + 1]."""
    n = len(offsets) - 1
    starts, stops, owner = runs(GAP[data], offsets)
    word = run_hashes(LOWER[data], starts, stops)
    count = np.bincount(owner, minlength=n)
    first = np.cumsum(count) - count
    step = np.uint64(0x9E3779B97F4A7C15)
    hashed, last = word.copy(), len(word) - size + 1
    short = [(i, first[i], count[i]) for i in np.flatnonzero((count > 0) & (count < size))]
    if last > 0:
        hashed = hashed[:last]
        for j in range(1, size):
            hashed = mixed(hashed * step + word[j : j + last])
        whole = owner[:last] == owner[size - 1 :]
        hashed, owner = hashed[whole], owner[:last][whole]
    else:
        hashed, owner = hashed[:0], owner[:0]
    if short:
        # A text of fewer words is one shingle.
        more = []
        for _, at, k in short:
            h = word[at : at + 1]
            for j in range(1, k):
                h = mixed(h * step + word[at + j : at + j + 1])
            more.append(mixed(h + np.uint64(k)))
        hashed = np.concatenate([hashed, *more])
        owner = np.concatenate([owner, [i for i, _, _ in short]])
    order = np.lexsort((hashed, owner))
    hashed, owner = hashed[order], owner[order]
    new = run_starts(hashed) | run_starts(owner)
    hashed, owner = hashed[new], owner[new]
    return hashed, np.append(0, np.cumsum(np.bincount(owner, minlength=n)))


def signatures(hashed: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit signature of each set."""
    total = np.append(np.uint64(0), np.cumsum(mixed(hashed), dtype=np.uint64))
    return mixed(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def least_common(n, percent: int):
    """Common shingles that a set of n needs with any partner."""
    return (percent * n + 99) // 100


def spare(n):
    """t: how many shingles linked sets must share among those dealt out."""
    return np.maximum(1, n // 5)


def needed(n, percent: int):
    """t of the smallest partner that a set of n may have."""
    return spare(least_common(n, percent))


def text_column(df: DataFrame, text: str):
    return F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")


def set_sizes(docs: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """(doc_id, n, sig) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashed, bounds = shingles(*text_bytes(part.column("text")), size)
                columns = [part.column(0), pa.array(np.diff(bounds)), pa.array(signatures(hashed, bounds))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "sig"])

    return docs.select(F.col(id_col).alias("doc_id"), text_column(docs, text)).mapInArrow(run, "doc_id long, n long, sig long")


def nameless_texts(docs: DataFrame, text: str, chosen: DataFrame, size: int) -> DataFrame:
    """(sig, part, text) of the ``chosen`` sets (sig, part) that only rows of null id hold; one text each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sig = signatures(*shingles(*text_bytes(part.column("text")), size))
                yield pa.RecordBatch.from_arrays([pa.array(sig), part.column("text")], names=["sig", "text"])

    rows = docs.where("doc_id is null").select(text_column(docs, text)).mapInArrow(run, "sig long, text string")
    return rows.groupBy("sig").agg(F.min("text").alias("text")).join(chosen, "sig").select("sig", "part", "text")


def blobs(names: list[str], bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row (bucket, packed arrays) for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(run_starts(bucket))
    ends = np.append(first[1:], len(bucket))
    for k in range(0, len(first), 64):
        keys, packed = [], []
        for a, b in zip(first[k : k + 64], ends[k : k + 64], strict=True):
            keys.append(int(bucket[a]))
            packed.append(pack(*[x[order[a:b]] for x in arrays]))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(packed, pa.binary())], names=names)


def bucket_of(key: np.ndarray, n: int) -> np.ndarray:
    """A bucket for each 64-bit key, from its lower half."""
    return (((key & np.uint64(0xFFFFFFFF)) * np.uint64(n)) >> np.uint64(32)).astype(np.int32)


def dealt_shingles(docs: DataFrame, text: str, size: int, percent: int, n_buckets: int) -> DataFrame:
    """(bucket, blob): postings (upper half of the shingle's hash, signature), by shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part in slices(batch, "text"):
                hashed, bounds = shingles(*text_bytes(part.column("text")), size)
                n = np.diff(bounds)
                sig = signatures(hashed, bounds)
                take = np.where(n > 0, n - least_common(n, percent) + spare(n), 0)
                place = np.arange(len(hashed)) - np.repeat(bounds[:-1], n)
                kept = place < np.repeat(take, n)
                held.append((hashed[kept], np.repeat(sig, n)[kept]))
            if sum(len(h) for h, _ in held) >= GATHER:
                yield from flush(held)
                held = []
        if held:
            yield from flush(held)

    def flush(held):
        key, sig = (np.concatenate(x) for x in zip(*held, strict=True))
        # Copies in one task say nothing new. Postings of one signature side by side take less room.
        order = np.lexsort((key, sig))
        key, sig = key[order], sig[order]
        new = run_starts(key) | run_starts(sig)
        key, sig = key[new], sig[new]
        return blobs(["bucket", "blob"], bucket_of(key, n_buckets), (key >> np.uint64(32)).astype(np.uint32), sig)

    return docs.select(text_column(docs, text)).mapInArrow(run, "bucket int, blob binary")


def shared_shingles(dealt: DataFrame, n_buckets: int) -> DataFrame:
    """(bucket, blob): postings (signature, shingle, sets that have it) of shingles of several sets, by signature."""

    def run(group: pa.Table) -> pa.Table:
        own = group["bucket"][0].as_py()
        key, sig = unpack_all((b.as_py() for b in group["blob"]), np.uint32, np.int64)
        order = np.lexsort((sig, key))
        key, sig = key[order], sig[order]
        new = run_starts(key) | run_starts(sig)
        key, sig = key[new], sig[new]
        first = np.flatnonzero(run_starts(key))
        sets = np.diff(np.append(first, len(key)))
        count = np.repeat(sets, sets)
        several = count > 1
        named = (np.uint64(own) << np.uint64(32)) | key[several].astype(np.uint64)
        sig = sig[several]
        rows = list(blobs(["bucket", "blob"], bucket_of(mixed(sig.view(np.uint64)), n_buckets), sig, named, count[several].astype(np.uint32)))
        return pa.Table.from_batches(rows, pa.schema([("bucket", pa.int32()), ("blob", pa.binary())]))

    return dealt.groupBy("bucket").applyInArrow(run, "bucket int, blob binary")


def short_lists(shared: DataFrame, sizes: DataFrame, percent: int, n_buckets: int) -> DataFrame:
    """(bucket, blob): entries (shingle, signature) of the lists in which linked sets must meet, by shingle."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = batch.column("sig").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket_of(mixed(sig.view(np.uint64)), n_buckets)), batch.column("sig"), batch.column("n")],
                names=["bucket", "sig", "n"],
            )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        sig, key, count = unpack_all((b.as_py() for b in left["blob"]), np.int64, np.uint64, np.uint32)
        known, n = right["sig"].to_numpy(), right["n"].to_numpy()
        order = np.argsort(known)
        known, n = known[order], n[order]
        order = np.lexsort((key, count, sig))
        sig, key = sig[order], key[order]
        first = np.flatnonzero(run_starts(sig))
        have = np.diff(np.append(first, len(sig)))
        must = needed(n[np.searchsorted(known, sig[first])], percent)
        take = np.where(have >= must, have - must + 1, 0)
        kept = np.arange(len(sig)) - np.repeat(first, have) < np.repeat(take, have)
        sig, key = sig[kept], key[kept]
        return pa.Table.from_batches(list(blobs(["bucket", "blob"], bucket_of(mixed(key), n_buckets), key, sig)), out)

    dealt = sizes.select("sig", "n").distinct().mapInArrow(deal, "bucket int, sig long, n long")
    return shared.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInArrow(run, "bucket int, blob binary")


def stars(lists: DataFrame) -> DataFrame:
    """(a, b): each set of a list with the list's smallest signature."""

    def run(group: pa.Table) -> pa.Table:
        key, sig = unpack_all((b.as_py() for b in group["blob"]), np.uint64, np.int64)
        order = np.lexsort((sig, key))
        key, sig = key[order], sig[order]
        first = np.flatnonzero(run_starts(key))
        least = np.repeat(sig[first], np.diff(np.append(first, len(key))))
        edge = np.unique(np.stack([sig, least], 1)[sig != least], axis=0)
        return pa.table({"a": edge[:, 0], "b": edge[:, 1]})

    return lists.groupBy("bucket").applyInArrow(run, "a long, b long")


class Labels:
    """Union-find."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def long_lists(sizes: np.ndarray, least: int) -> int:
    """How many of the longest lists to leave out of the merge: the cheapest of some choices.

    Merging costs the short lists' lengths. What reaches ``least`` minus the number of long lists, at most
    the short lists' total over that number, is looked up in each long list.
    """
    total = np.append(0, np.cumsum(sizes))
    choices = np.unique(np.linspace(0, least - 1, 8).astype(int))
    merged = total[len(sizes) - choices]
    looked = choices * (200 + merged / (least - choices))
    return int(choices[np.argmin(merged + looked)])


def merge(short: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(members, number of lists that hold each) of ascending lists: on a heap, or many at once in numpy."""
    if sum(map(len, short)) <= 200:
        members, times = [], []
        for m in heapq.merge(*[x.tolist() for x in short]):
            if members and members[-1] == m:
                times[-1] += 1
            else:
                members.append(m)
                times.append(1)
        return np.array(members, np.int64), np.array(times, np.int64)
    every = np.sort(np.concatenate(short), kind="stable")  # a merge of ascending runs
    first = np.flatnonzero(run_starts(every))
    return every[first], np.diff(np.append(first, len(every)))


def divide_skip(lists: list[np.ndarray], least: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(members of ``least`` lists or more, number of lists that hold each); of those marked in ``wanted``, if given."""
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    lists = sorted((x for x in lists if len(x)), key=len)
    if len(lists) < least:
        return nothing
    n_long = long_lists(np.array([len(x) for x in lists]), least)
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    if wanted is not None:
        short = [x[wanted[x]] for x in short]
    member, times = merge(short)
    for left, held in zip(range(n_long, 0, -1), long, strict=True):
        alive = times + left >= least
        if not alive.all():
            member, times = member[alive], times[alive]
        if not len(member):
            return nothing
        at = np.minimum(np.searchsorted(held, member), len(held) - 1)
        times = times + (held[at] == member)
    found = times >= least
    return member[found], times[found]


def linked(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


class Index:
    """Inverted lists of some sets."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.n = np.array([len(s) for s in sets], np.int64)
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.n)
        order = np.lexsort((owner, flat))
        flat, self.owner = flat[order], owner[order]
        self.first = np.flatnonzero(run_starts(flat))
        self.keys, self.ends = flat[self.first], np.append(self.first[1:], len(flat))

    def search(self, own: np.ndarray, wanted: np.ndarray, percent: int) -> list[int]:
        """The marked sets that link with ``own``."""
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        at = at[self.keys[at] == own]
        lists = [self.owner[a:b] for a, b in zip(self.first[at].tolist(), self.ends[at].tolist(), strict=True)]
        member, common = divide_skip(lists, int(least_common(len(own), percent)), wanted)
        return member[linked(common, len(own), self.n[member], percent)].tolist()


def search_part(sets: list[np.ndarray], percent: int, labels: Labels) -> None:
    """Join the labels of all linked sets of a part.

    First each set is searched for among the leaders before it, the sets that found no leader
    themselves; in groups of copies nearly all sets end here. Then sets outside the most frequent label
    are searched for among all, so every pair of different labels is met from one side at least.
    """
    index, leader = Index(sets), np.zeros(len(sets), bool)
    for i, own in enumerate(sets):
        partners = index.search(own, leader, percent)
        for j in partners:
            labels.join(i, j)
        leader[i] = not partners
    roots = np.array([labels.find(i) for i in range(len(sets))])
    asked = roots != np.bincount(roots).argmax()
    # Of two such sets the later one asks for both.
    for i in np.flatnonzero(asked).tolist():
        wanted = ~asked
        wanted[:i] = True
        wanted[i] = False
        for j in index.search(sets[i], wanted, percent):
            labels.join(i, j)


def own_sets(group: pa.Table, size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(signatures, sets) of rows (sig, text), ascending. Rows of one id may hold several texts, and equal
    rows come twice: one row that has the named signature is kept."""
    sig = group["sig"].to_numpy()
    hashed, bounds = shingles(*text_bytes(group["text"].combine_chunks()), size)
    rows = np.flatnonzero(signatures(hashed, bounds) == sig)
    rows = rows[np.argsort(sig[rows], kind="stable")]
    rows = rows[run_starts(sig[rows])]
    return sig[rows], [hashed[bounds[i] : bounds[i + 1]] for i in rows]


def search_parts(texts: DataFrame, size: int, percent: int, n_buckets: int) -> DataFrame:
    """(sig, root): each set's smallest linked signature in its part, of ``texts`` (sig, part, text)."""

    def run(group: pa.Table) -> pa.Table:
        sigs, roots = [], []
        group = group.sort_by("part")
        part = group["part"].to_numpy()
        edges = np.append(np.flatnonzero(run_starts(part)), len(part))
        for a, b in zip(edges, edges[1:], strict=False):
            sig, sets = own_sets(group.slice(a, b - a), size)
            if len(sig):
                labels = Labels(len(sig))
                search_part(sets, percent, labels)
                sigs.append(sig)
                roots.append(sig[[labels.find(i) for i in range(len(sig))]])
        none = np.zeros(0, np.int64)
        return pa.table({"sig": np.concatenate([none, *sigs]), "root": np.concatenate([none, *roots])})

    dealt = texts.withColumn("bucket", F.pmod(F.xxhash64("part"), F.lit(n_buckets)).cast("int"))
    return dealt.groupBy("bucket").applyInArrow(run, "sig long, root long")


def search_blocks(texts: DataFrame, size: int, percent: int, n_buckets: int) -> DataFrame:
    """(sig, root) as ``search_parts`` gives it, for parts of more than ``PART`` sets.

    A part is cut into blocks, each searched on its own. The blocks' roots are searched as one part, where
    they are few enough, which connects the copies of one original over all blocks. Sets outside the
    part's most frequent label are then searched for in every block, in lots of ``PART``; so all pairs of
    different labels are met and no task holds more than a block and a lot.
    """
    texts = materialize(texts.withColumn("block", F.pmod(F.xxhash64("sig"), F.ceil(F.col("sets") / PART))), "blocks")
    cells = texts.select("sig", F.xxhash64("part", "block").alias("part"), "text")
    inner = materialize(search_parts(cells, size, percent, n_buckets), "inner")
    tops = texts.join(inner.where("sig = root").select("sig"), "sig")
    few = tops.groupBy("part").count().where(F.col("count") <= PART).select("part")
    outer = search_parts(tops.join(few, "part").select("sig", "part", "text"), size, percent, n_buckets)
    known = materialize(inner.unionByName(outer), "known")
    names = components(known, "sig", "root")
    label = F.coalesce("component", "sig")
    named = texts.join(names, texts["sig"] == names["id"], "left").select(texts["*"], label.alias("label"))
    named = materialize(named, "named")
    most = named.groupBy("part", "label").count().groupBy("part").agg(F.max_by("label", "count").alias("most"))
    asked = materialize(named.join(most, "part").where("label <> most").select("sig", "part", "label", "text"), "asked")
    lots = asked.groupBy("part").agg(F.ceil(F.count("*") / PART).alias("lots"))
    blocks = named.select("part", F.ceil(F.col("sets") / PART).alias("blocks")).distinct()
    left = named.join(lots, "part").select("sig", "part", "label", "text", "block", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"))
    right = asked.join(lots, "part").join(blocks, "part").select(
        "sig", "part", "label", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("sig", F.lit("lot")), "lots").alias("lot"),
    )

    def run(block: pa.Table, lot: pa.Table) -> pa.Table:
        pairs = []
        if block.num_rows and lot.num_rows:
            sig, sets = own_sets(block, size)
            label_of = dict(zip(block["sig"].to_pylist(), block["label"].to_pylist(), strict=True))
            labels = np.array([label_of[s] for s in sig.tolist()], np.int64)
            index = Index(sets)
            mine = dict(zip(lot["sig"].to_pylist(), lot["label"].to_pylist(), strict=True))
            for s, own in zip(*own_sets(lot, size), strict=True):
                found = index.search(own, labels != mine[int(s)], percent)
                pairs += [(int(s), int(x)) for x in np.unique(labels[found])]
        flat = np.array(pairs, np.int64).reshape(-1, 2)
        return pa.table({"sig": flat[:, 0], "root": flat[:, 1]})

    keys = ["part", "block", "lot"]
    across = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "sig long, root long")
    names = components(known.unionByName(across), "sig", "root")
    return texts.select("sig").distinct().join(names, F.col("sig") == F.col("id"), "left").select("sig", F.coalesce("component", "sig").alias("root"))


def similar_groups(docs: DataFrame, id_col: str, text: str, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    A set holds the different ``size``-word shingles of the lower-cased (A-Z) whole text; a text of fewer
    words is one shingle; a text without words, or null, has none and links with nothing. Rows link when
    100 * intersection >= percent * union. component_id is the smallest id reachable by links, the row's
    own included; rows of null id link like others, but name no component, which is null where all its
    rows have null ids. Repeated rows are in one component. Only the two named columns are read. Sets and shingles are told
    apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    n_buckets = width(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sizes = materialize(set_sizes(docs, "doc_id", "text", size), "sets")
    full = sizes.where("n > 0")
    shared = shared_shingles(dealt_shingles(docs, "text", size, percent, n_buckets), n_buckets)
    edges = materialize(stars(short_lists(shared, full, percent, n_buckets)), "stars")
    parts = materialize(components(edges), "parts")
    firsts = full.groupBy("sig").agg(F.min("doc_id").alias("first"))
    chosen = firsts.join(parts, F.col("sig") == F.col("id")).select(
        F.col("first").alias("doc_id"), "sig", F.col("component").alias("part")
    )
    texts = docs.join(chosen, "doc_id").select("sig", "part", F.coalesce("text", F.lit("")).alias("text"))
    nameless = chosen.where("doc_id is null").select("sig", "part")
    if not nameless.isEmpty():
        texts = texts.unionByName(nameless_texts(docs, "text", nameless, size))
    large = parts.groupBy(F.col("component").alias("part")).agg(F.count("*").alias("sets")).where(F.col("sets") > PART)
    if large.isEmpty():
        roots = search_parts(texts, size, percent, n_buckets)
    else:
        # Small and large parts give the same links; large ones are cut so that a task can hold a block.
        texts = materialize(texts.join(large, "part", "left"), "texts")
        roots = search_parts(texts.where("sets is null").drop("sets"), size, percent, n_buckets).unionByName(
            search_blocks(texts.where("sets is not null"), size, percent, n_buckets)
        )
    roots = materialize(roots, "roots")
    named = roots.join(firsts, "sig").groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = roots.join(named, "root").select("sig", "component_id")
    of_class = firsts.join(of_class, "sig", "left").select("sig", F.coalesce("component_id", "first").alias("component_id"))
    return (
        full.join(of_class, "sig").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        .unionByName(sizes.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    )


@query(
    "op8_similar",
    r"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM i),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s AS a JOIN s AS b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
    link AS (SELECT a, b FROM c JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
    reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
    SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
    FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)""",
)
def op8_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")
