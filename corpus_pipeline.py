"""A corpus pipeline: quality, near duplicates, repeated passages, contamination, tokens.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns the rows it
keeps with the columns of ``documents``; the last stage returns the tokens' digests. Between stages rows
are written as Parquet and read again.

The first stage fits a classifier, so SQL can't give the rows of ``run``; each stage is tested against a
brute-force version instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktab import tune
from sparktab.llm.bpe import encode_texts, vocabulary
from sparktab.llm.common import fresh, table
from sparktab.llm.decontaminate import benchmark_hits
from sparktab.llm.quality import score_quality
from sparktab.llm.similar import similar_groups
from sparktab.llm.suffixes import remove_repeats
from sparktab.session import scratch_path, spread

ORACLE_SQL = None


def hidden(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns under names that no operator adds."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"own{i}") for i, c in enumerate(docs.columns)])


def shown(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again."""
    return found.select(*[F.col(c if c in ("doc_id", "text") else f"own{i}").alias(c) for i, c in enumerate(docs.columns)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject.

    Null ids and repeated rows are judged like others; a null or empty text by its measures, all 0.
    """
    scored = score_quality(spread(hidden(docs)), table(tune(spark), sf_dir, "labels"))
    return shown(scored.where("predicted = 1"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one of smallest id.

    A document of null id stays, and so do all rows of a kept id and texts without words.
    """
    groups = similar_groups(spread(docs.select("doc_id", "text")), "doc_id", "text")
    mark = fresh(docs, "kept_id")
    kept = groups.where("doc_id = component_id").select(F.col("doc_id").alias(mark)).distinct()
    rows = docs.join(kept, docs["doc_id"] == kept[mark]).drop(mark)
    return rows.unionByName(docs.where("doc_id is null")).select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that start in a document of smaller id.

    Bytes of a character that was cut in two are dropped, and n_chars follows the text. Null ids are
    larger than all others, rows of one id keep what they share, and a null text becomes empty.
    """
    found = remove_repeats(spread(hidden(docs)), "doc_id", "text", form="text").withColumnRenamed("kept", "text")
    whole = shown(found, docs)
    if "n_chars" in docs.columns:
        whole = whole.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return whole


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule doesn't name; null and empty texts have no hits and stay."""
    found = benchmark_hits(spread(hidden(docs)), "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return shown(found.where(~F.col("contaminated")), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; a null text counts as empty."""
    return encode_texts(spread(docs), "text", vocabulary(), digests=True, keep=["doc_id"])


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(tune(spark), sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = scratch_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
