"""Sums over pairs of columns in one scan: each task multiplies matrices, small tables of pairs are added up."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_AT_ONCE = 4096


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    """Rows by columns as doubles; nulls as NaN."""
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])


def _pair_table(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row for each pair of columns, first before second."""
    n = len(next(iter(sums.values())))
    i, j = np.triu_indices(n, 1)
    cells = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *[pa.array(s[i, j]) for s in sums.values()]]
    return pa.RecordBatch.from_arrays(cells, names=["i", "j", *sums])


def _added_up(parts: DataFrame, names: Sequence[str]) -> DataFrame:
    """(i, j, sums): a row from each task and pair goes in, one a pair comes out."""
    return parts.groupBy("i", "j").agg(*[F.sum(n).alias(n) for n in names])


def named_pairs(sums: DataFrame, cols: Sequence[str], a: str, b: str) -> DataFrame:
    """Numbers of columns turned to their names."""
    names = F.array(*[F.lit(c) for c in cols])
    return sums.withColumn(a, F.get(names, F.col("i"))).withColumn(b, F.get(names, F.col("j"))).drop("i", "j")


def moment_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(i, j, n, x, y, xx, yy, xy): sums over the rows where both columns of a pair are present.

    Each column is shifted by a value of its own, so that sums of squares keep their digits and a
    constant column gives exact zeros. Each task holds matrices of columns x columns.
    """
    clean = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    head = clean.limit(1000).agg(*[F.min(F.nanvl(c, F.lit(None).cast("double"))).alias(c) for c in clean.columns]).first()
    shift = np.array([head[c] if head[c] is not None and np.isfinite(head[c]) else 0.0 for c in clean.columns])
    names = ["n", "x", "y", "xx", "yy", "xy"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = len(shift)
        sums = {k: np.zeros((p, p)) for k in names}
        for batch in batches:
            held = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns])
            values = _numbers(batch) - shift
            for start in range(0, len(values), ROWS_AT_ONCE):
                mask = held[start : start + ROWS_AT_ONCE].astype(np.float64)
                x = np.where(mask > 0, values[start : start + ROWS_AT_ONCE], 0.0)
                square = x * x
                sums["n"] += mask.T @ mask
                sums["x"] += x.T @ mask
                sums["xx"] += square.T @ mask
                sums["xy"] += x.T @ x
        sums["y"], sums["yy"] = sums["x"].T, sums["xx"].T
        yield _pair_table(sums)

    schema = "i int, j int, " + ", ".join(f"{n} double" for n in names)
    return _added_up(clean.mapInArrow(run, schema), names)


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, corr): Pearson correlation of each pair over rows where both are present.

    Null where a column of the pair is constant over those rows, or no rows are left. A NaN makes
    the correlations of its column NaN.
    """
    sums = named_pairs(moment_pairs(df, cols), cols, "a", "b")
    spread_x = F.col("xx") - F.col("x") * F.col("x") / F.col("n")
    spread_y = F.col("yy") - F.col("y") * F.col("y") / F.col("n")
    both = F.col("xy") - F.col("x") * F.col("y") / F.col("n")
    # A quotient, so that neither product under the root leaves the range of doubles.
    value = both / (F.sqrt(spread_x) * F.sqrt(spread_y))
    return sums.select("a", "b", F.when((F.col("n") > 0) & (spread_x > 0) & (spread_y > 0), value).alias("corr"))


def agreement_pairs(wide: DataFrame, models: Sequence[str], y: str) -> DataFrame:
    """(i, j, n, same, both, either): rows, equal predictions, errors of both models and of either one.

    Classes may be of any type. A null prediction agrees with nothing; with a null prediction or a
    null label a row holds no error of that model, and an error of the other counts for ``either``.
    """
    cells = [F.col(m).cast("string").alias(f"c{i}") for i, m in enumerate(models)]
    rows = wide.select(*cells, F.col(y).cast("string").alias("y"))
    names = ["n", "same", "both", "either"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = len(models)
        total, same, both, wrong = 0, np.zeros((p, p)), np.zeros((p, p)), np.zeros(p)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                joined = pa.chunked_array(part.columns).dictionary_encode().combine_chunks()
                codes = joined.indices.fill_null(-1).to_numpy().reshape(p + 1, -1)
                held = codes >= 0
                # One matrix product for each class: a cell counts the rows where both models say it.
                for c in range(len(joined.dictionary)):
                    said = (codes[:-1] == c).astype(np.float64)
                    same += said @ said.T
                miss = (held[:-1] & held[-1] & (codes[:-1] != codes[-1])).astype(np.float64)
                both += miss @ miss.T
                wrong += miss.sum(1)
                total += part.num_rows
        either = wrong[:, None] + wrong[None, :] - both
        yield _pair_table({"n": np.full((p, p), float(total)), "same": same, "both": both, "either": either})

    schema = "i int, j int, " + ", ".join(f"{n} double" for n in names)
    return _added_up(rows.mapInArrow(run, schema), names)
