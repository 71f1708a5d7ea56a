"""Approximate nearest neighbours: inverted lists, scanned by dimension with early abandoning.

Vectors are brought to length 1 and rotated at random, so that any block of rotated dimensions tells
as much as any other. Every vector belongs to the list of its nearest centre; a query scans the lists
of the centres nearest to it. Inside a list rotated vectors are read in column blocks: after each block
a hypothesis test asks whether the partial distance, scaled to all dimensions, could still end below
the best distances found so far, and drops the candidates that fail. Those that remain are compared in
double precision on the original vectors.

Equal vectors count once: each keeps its k + 1 smallest ids, which is all that any result can name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparktab.llm.common import query, table
from sparktab.session import materialize

#: Vectors that the centres are fitted on, and rows of a list that one task scans at most.
SAMPLE = 20_000
BLOCK = 20_000
COLUMNS = 16
#: Width of the test: larger keeps more candidates. At 2.1 standard errors few true neighbours fail.
EPSILON = 2.1
#: Share of the sample's true neighbours that the scanned lists must hold.
TARGET = 0.97


def rotation(d: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def centres(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k-means on the unit sphere; an empty centre moves to the row farthest from its own."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = x @ c.T
        own = near.argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=k) == 0)
        if len(empty):
            total[empty] = x[np.argsort(near.max(1))[: len(empty)]]
        norm = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(norm > 0, total / np.maximum(norm, 1e-12), c)
    return c.astype(np.float32)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """An array column of equal lengths as float64 rows."""
    flat = pa.chunked_array(column) if isinstance(column, pa.Array) else column
    flat = flat.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1)


def scan(q: np.ndarray, rotated: np.ndarray, need: int) -> np.ndarray:
    """Rows of ``rotated`` that may be among the ``need`` nearest to q (both unit, rotated)."""
    n, d = rotated.shape
    # A first few rows give a distance to beat.
    lead = min(n, max(need, 64))
    full = ((rotated[:lead] - q) ** 2).sum(1)
    kept, best = [np.arange(lead)], [full]
    bar = np.partition(full, need - 1)[need - 1] if lead >= need else np.inf
    for start in range(lead, n, 4096):
        rows = np.arange(start, min(start + 4096, n))
        part = np.zeros(len(rows), np.float32)
        for at in range(0, d, COLUMNS):
            stop = min(at + COLUMNS, d)
            part += ((rotated[rows, at:stop] - q[at:stop]) ** 2).sum(1)
            if stop < d:
                test = part * (d / stop) <= (1 + EPSILON / np.sqrt(stop)) ** 2 * bar
                rows, part = rows[test], part[test]
        near = part <= bar * 1.00001 + 1e-9
        kept.append(rows[near])
        best.append(part[near])
        every = np.concatenate(best)
        if len(every) >= need:
            bar = np.partition(every, need - 1)[need - 1]
    rows, dist = np.concatenate(kept), np.concatenate(best)
    return rows[dist <= bar * 1.00001 + 1e-9]


def enough_probes(sample: np.ndarray, middle: np.ndarray, k: int, target: float = TARGET) -> int:
    """Lists to scan so that the share ``target`` of the sample's true neighbours lies in them."""
    step = max(1, len(sample) // 500)
    asked = sample[::step]
    near = asked @ sample.T
    near[np.arange(len(asked)), np.arange(0, len(sample), step)] = -np.inf
    found = np.argpartition(-near, min(k, len(sample) - 1), axis=1)[:, :k]
    rank = np.argsort(np.argsort(-(asked @ middle.T), axis=1, kind="stable"), axis=1)
    own = (sample @ middle.T).argmax(1)
    ranks = np.sort(np.take_along_axis(rank, own[found], 1), axis=None)
    return int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))))]) + 1


def nearest(
    df: DataFrame, id_col: str, vector: str, is_query, k: int = 5, lists: int | None = None, probes: int | None = None
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of greatest cosine found for each query row.

    Queries are the rows where ``is_query`` holds; a query's own id is no candidate. Ranks start at 1,
    ties go to the smaller id; scores are cosines in double precision on the original vectors.
    Vectors that are null, empty, zero, or hold null or non-finite components take no part, as query or
    candidate; so do null ids. Rows of one id count once for each different vector. A query with fewer
    candidates than k gets them all. Other columns aren't read. All vectors that take part must have
    one length.

    Centres are fitted on about ``SAMPLE`` vectors, and so is the number of lists to scan, unless
    ``probes`` names it; every vector is indexed. Lists longer than ``BLOCK``
    are split into parts, each scanned by a task of its own.
    """
    x = F.col(vector)
    plain = df.select(F.col(id_col).cast("long").alias("id"), x.cast("array<double>").alias("v"), (is_query).alias("q"))
    valid = plain.where(
        F.col("id").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
        & F.exists("v", lambda c: c != 0)
    )
    # The smallest ids of each different vector: ranks are limited before the shuffle, too.
    order = Window.partitionBy("v").orderBy("id")
    few = valid.select("id", "v").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    base = materialize(few.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")), "vectors")
    asked = materialize(valid.where("q").select(F.col("id").alias("query_id"), "v").distinct(), "queries")
    probe = asked.groupBy("v").agg(F.min("query_id").alias("key"))
    n = base.count()
    if n == 0:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = min(1.0, SAMPLE / n)
    drawn = base.where(F.pmod(F.xxhash64("ids"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("v").toArrow()
    sample = unit(matrix(drawn["v"])) if len(drawn) else unit(matrix(base.limit(1).select("v").toArrow()["v"]))
    turn = rotation(sample.shape[1])
    sample = (sample @ turn).astype(np.float32)
    n_lists = max(1, min(lists or round(np.sqrt(n)), len(sample)))
    middle = centres(sample, n_lists)
    n_probes = min(n_lists, probes or enough_probes(sample, middle, k))

    def assign(batches):
        for batch in batches:
            own = (unit(matrix(batch.column("v"))) @ turn).astype(np.float32) @ middle.T
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own.argmax(1).astype(np.int32))], names=["v", "ids", "list"]
            )

    indexed = materialize(base.mapInArrow(assign, "v array<double>, ids array<long>, list int"), "lists")
    # One number for each list.
    parts = {r["list"]: -(-r["count"] // BLOCK) for r in indexed.groupBy("list").count().collect()}
    many = np.array([parts.get(i, 0) for i in range(n_lists)], np.int64)

    def route(batches):
        for batch in batches:
            near = (unit(matrix(batch.column("v"))) @ turn).astype(np.float32) @ middle.T
            chosen = np.argsort(-near, axis=1, kind="stable")[:, :n_probes].ravel()
            row = np.repeat(np.arange(len(near)), n_probes)
            row, chosen = np.repeat(row, many[chosen]), np.repeat(chosen, many[chosen])
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (chosen[1:] != chosen[:-1])
            begin = np.flatnonzero(new)
            part = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))
            yield pa.RecordBatch.from_arrays(
                [*(c.take(pa.array(row)) for c in batch.columns), pa.array(chosen.astype(np.int32)), pa.array(part.astype(np.int32))],
                names=["v", "key", "list", "part"],
            )

    sides = F.array([F.lit(int(m)) for m in np.maximum(many, 1)])
    dealt = indexed.withColumn("part", F.pmod(F.xxhash64("ids"), sides[F.col("list")]).cast("int"))
    routed = probe.mapInArrow(route, "v array<double>, key long, list int, part int")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.schema([("key", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        rows, asked_ = matrix(left["v"]), matrix(right["v"])
        rotated, turned = (unit(rows) @ turn).astype(np.float32), (unit(asked_) @ turn).astype(np.float32)
        ids = left["ids"].combine_chunks()
        first = np.array(ids.flatten())[np.array(ids.offsets)[:-1] - ids.offsets[0].as_py()]
        keys, found, scores = [], [], []
        norm = np.sqrt((rows * rows).sum(1))
        for key, q, original in zip(right["key"].to_pylist(), turned, asked_, strict=True):
            near = scan(q, rotated, min(k + 1, len(rows)))
            cosine = (rows[near] * original).sum(1) / (norm[near] * np.sqrt((original * original).sum()))
            best = np.lexsort((first[near], -cosine))[: k + 1]
            keys.append(np.full(len(best), key))
            found.append(near[best])
            scores.append(cosine[best])
        return pa.table(
            [pa.array(np.concatenate(keys)), ids.take(pa.array(np.concatenate(found))), pa.array(np.concatenate(scores))],
            schema=out,
        )

    hits = dealt.groupBy("list", "part").cogroup(routed.groupBy("list", "part")).applyInArrow(
        search, "key long, ids array<long>, score double"
    )
    best = Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("ids")[0])
    top = materialize(hits.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1), "hits")
    listed = top.select("key", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("key").orderBy(F.col("score").desc(), "vec_id")
    listed = listed.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    lists_ = listed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))
    each = asked.join(probe, "v").select("query_id", "key").join(lists_, "key")
    own = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k)
    return each.select("query_id", F.posexplode(own).alias("p", "f")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score")
    )


@query("op5_nearest")
def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0)
