"""Balanced shards by byte size, with DataFrame functions only.

Rows are put in the order of their id and cut where the running byte total passes equal targets.
The running total is global but no task sees more than one range of ids: each range is summed on its
own, the few range totals become offsets, and a window adds up inside the ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparktab.llm.common import query, table, width
from sparktab.session import materialize

SHARDS = 24


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(8)


def range_of(key: Column, tie: Column, cuts: list[int]) -> Column:
    """Number of the range that holds a row. A key that several cuts share is split by its tie value."""
    if not cuts:
        return F.lit(0)
    values = F.array(*[F.lit(c).cast("long") for c in cuts])
    below = F.size(F.filter(values, lambda c: c < key))
    same = F.size(F.filter(values, lambda c: c == key))
    part = F.when(same > 1, F.floor(tie * same / F.lit(2.0**32)).cast("int")).otherwise(F.lit(0))
    return F.coalesce(below + part, F.lit(-1))


def shard_by_bytes(df: DataFrame, id_col: str, size: Column, tie: Column, n: int) -> DataFrame:
    """(id, size, tie, shard, slot): ``n`` contiguous shards of nearly equal bytes in id order.

    A row goes to the shard in whose target range the middle of its bytes falls, so a shard differs
    from the target by the size of one row at most. ``slot`` counts from 0 inside a shard without
    gaps. Null ids come first; rows with one id follow their tie value (unsigned 32 bits), then
    their size; equal rows are interchangeable. No rows in, no rows out. Rows longer than a target
    leave the shards they cover empty.

    Only id, size and tie are carried, so any other columns and their names don't matter.
    """
    spark = df.sparkSession
    rows = materialize(
        df.select(F.col(id_col).cast("long").alias("id"), size.cast("long").alias("size"), tie.alias("tie")), "sizes"
    )
    steps = 4 * width(spark)
    cuts = rows.agg(
        F.percentile_approx("id", F.array(*[F.lit(i / steps) for i in range(1, steps)]), F.lit(50 * steps)).alias("c")
    ).first()["c"]
    rows = rows.withColumn("range", range_of(F.col("id"), F.col("tie"), list(cuts or [])))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    offsets = totals.select(
        "range",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    inside = Window.partitionBy("range").orderBy(F.col("id").asc_nulls_first(), "tie", "size")
    placed = rows.select(
        "*",
        (F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start"),
        (F.row_number().over(inside) - 1).alias("row"),
    ).join(offsets, "range")
    middle = 2 * (F.col("bytes_before") + F.col("start")) + F.col("size")
    placed = materialize(
        placed.select(
            "id", "size", "tie", (F.col("rows_before") + F.col("row")).alias("row"),
            F.least(F.lit(n - 1).cast("long"), F.call_function("div", middle * n, 2 * F.col("total"))).cast("int").alias("shard"),
        ),
        "placed",
    )
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(first, "shard").select("id", "size", "tie", "shard", (F.col("row") - F.col("first")).alias("slot"))


@query(
    "op2_sharding",
    """
    WITH RECURSIVE k AS (SELECT i, i AS c, 0 AS bit FROM range(256) AS r(i) UNION ALL
      SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, bit + 1 FROM k WHERE bit < 8),
    t AS (SELECT list(c ORDER BY i) AS crcs FROM k WHERE bit = 8),
    d AS (SELECT doc_id, coalesce(text, '') AS body, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size FROM documents),
    b AS (SELECT doc_id, size, [CAST(4294967295 AS BIGINT)] || list_transform(regexp_extract_all(hex(encode(body)), '..'),
        lambda h: CAST(16 * (strpos('0123456789ABCDEF', h[1]) - 1) + strpos('0123456789ABCDEF', h[2]) - 1 AS BIGINT)) AS bytes FROM d),
    r AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda c, x: xor(c // 256, crcs[CAST(xor(c % 256, x) AS BIGINT) + 1])), 4294967295) AS crc FROM b, t),
    s AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, crc, size ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS total FROM r),
    p AS (SELECT *, CAST(least(23, ((2 * start + size) * 24) // (2 * total)) AS INTEGER) AS shard FROM s)
    SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
      row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, crc, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
    FROM p""",
)
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    out = shard_by_bytes(docs, "doc_id", text_size(F.col("text")), crc, SHARDS)
    return out.select(
        F.col("id").alias("doc_id"), "size", F.col("tie").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
