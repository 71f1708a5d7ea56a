"""Text quality by positive-unlabelled learning.

Trusted positives and unlabelled web text are all that is learned from. A first classifier tells the
two apart; the smallest ratio of unlabelled to positive rows above any of its thresholds estimates the
share of positives (class prior) in the unlabelled text. The second classifier minimizes the
non-negative unbiased risk: prior * loss on positives as positive, plus what is left of the unlabelled
loss as negative after taking the positives' part out of it, never counted below zero.

A classifier adds one weight for the bin of each text measure. It is fitted on a bounded sample; all
texts are scored whole, in tasks that each hold the few weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktab.llm.common import fresh, mixed, query, run_hashes, run_starts, runs, slices, table, text_bytes
from sparktab.session import spread

#: Expected sizes of the fitting sample.
POSITIVES = 20_000
UNLABELLED = 40_000
BINS = 12
STEPS = 300

SIGNS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "mark": b"!?", "stop": b".,;:", "bar": b"|",
         "brace": b"{}<>[]()=/\\_", "symbol": b"#$%&*@^~+`", "quote": b"'\"-", "line": b"\n"}
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each run [offsets[i], offsets[i + 1])."""
    return np.diff(np.append(0, np.cumsum(values, dtype=np.float64))[offsets])


def repeats(owner: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(different keys, occurrences of the most frequent key) of each of n owners."""
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    first = np.flatnonzero(run_starts(key) | run_starts(owner))
    count = np.diff(np.append(first, len(owner)))
    most = np.zeros(n)
    np.maximum.at(most, owner[first], count)
    return np.bincount(owner[first], minlength=n).astype(float), most


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Measures of each text, from its bytes alone; an empty text's are all 0."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    if not len(data):
        return np.zeros((n, len(SIGNS) + 13), np.float32)
    some = np.maximum(size, 1)
    shares = [sums(np.isin(data, np.frombuffer(s, np.uint8)), offsets) / some for s in SIGNS.values()]
    starts, stops, owner = runs(data <= 32, offsets)
    key = run_hashes(LOWER[data], starts, stops)
    words = np.bincount(owner, minlength=n).astype(float)
    many = np.maximum(words, 1)
    length = (stops - starts).astype(float)
    kinds, most = repeats(owner, key, n)
    again = np.zeros(len(key))
    again[1:] = (key[1:] == key[:-1]) & (owner[1:] == owner[:-1])
    pair = np.zeros(len(key), np.uint64)
    pair[1:] = mixed(key[:-1] * np.uint64(3) + key[1:])
    pair_kinds, pair_most = repeats(owner, pair, n)
    tail = data[stops - 1]
    ends_sign = ~((tail >= 48) & (tail <= 57) | (tail >= 65) & (tail <= 90) | (tail >= 97) & (tail <= 122) | (tail >= 128))
    capital = (data[starts] >= 65) & (data[starts] <= 90)
    l_starts, l_stops, l_owner = runs(data == 10, offsets)
    l_key = run_hashes(data, l_starts, l_stops)
    lines = np.maximum(np.bincount(l_owner, minlength=n), 1)
    line_kinds, _ = repeats(l_owner, l_key, n)
    by_word = lambda x: np.bincount(owner, weights=x, minlength=n) / many
    rest = [
        np.log1p(size), np.log1p(words), by_word(length), np.sqrt(by_word(length**2)), kinds / many, most / many,
        by_word(again), pair_kinds / many, pair_most / many, by_word(ends_sign), by_word(capital),
        np.log1p(size / lines), line_kinds / lines,
    ]
    out = np.stack([*shares, *rest], 1).astype(np.float32)
    out[size == 0] = 0
    return out


@dataclass
class Scorer:
    """Bin edges of each measure, and a weight for each bin."""

    edges: list[np.ndarray]
    weights: list[np.ndarray]
    bias: float

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum(w[b] for w, b in zip(self.weights, self.bins(x), strict=True))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -500, 500)))


def bin_edges(x: np.ndarray) -> list[np.ndarray]:
    levels = np.linspace(0, 1, BINS + 1)[1:-1]
    return [np.unique(np.concatenate([np.quantile(x[:, j], levels), [np.quantile(x[:, j], 0.98)]])) for j in range(x.shape[1])]


def minimize(edges, positive, unlabelled, slope, steps: int = STEPS, rate: float = 0.1, decay: float = 1e-4) -> Scorer:
    """Adam over the weights. ``slope(logits of both)`` gives the risk's derivatives for each row."""
    scorer = Scorer(edges, [np.zeros(len(e) + 1) for e in edges], 0.0)
    cells = [np.concatenate(pair) for pair in zip(scorer.bins(positive), scorer.bins(unlabelled), strict=True)]
    start = np.append(0, np.cumsum([len(w) for w in scorer.weights]))
    flat = np.stack([c + s for c, s in zip(cells, start[:-1], strict=True)])
    w = np.zeros(start[-1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        logits = w[-1] + w[flat].sum(0)
        d = slope(logits[: len(positive)], logits[len(positive) :])
        g = np.append(np.bincount(flat.ravel(), np.tile(d, len(flat)), minlength=start[-1]), d.sum()) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    scorer.weights = [w[a:b] for a, b in zip(start[:-1], start[1:], strict=True)]
    scorer.bias = float(w[-1])
    return scorer


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, edges: list[np.ndarray]) -> float:
    """Share of positives in the unlabelled rows: the smallest ratio of the two tails over all
    thresholds of a classifier that tells them apart, with a margin for thin tails."""
    p, u = positive[::2], unlabelled[::2]
    split = minimize(
        edges, p, u,
        lambda a, b: np.concatenate([(sigmoid(a) - 1) / (2 * len(a)), sigmoid(b) / (2 * len(b))]),
        steps=STEPS // 2, decay=1e-3,
    )
    a, b = np.sort(split.logits(positive[1::2])), np.sort(split.logits(unlabelled[1::2]))
    cuts = np.quantile(b, np.linspace(0, 0.99, 200))
    tail_p = 1 - np.searchsorted(a, cuts) / max(len(a), 1)
    tail_u = 1 - np.searchsorted(b, cuts) / max(len(b), 1)
    margin = np.sqrt(np.log(40) / 2 / max(len(a), 1)) + np.sqrt(np.log(40) / 2 / max(len(b), 1))
    ok = tail_p > 0
    bound = (tail_u[ok] + margin) / tail_p[ok]
    best = int(np.argmin(bound))
    return float(np.clip(tail_u[ok][best] / tail_p[ok][best], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[Scorer, float]:
    """(scorer, class prior). Without positives or unlabelled rows every score is 0.5."""
    if len(positive) < 4 or len(unlabelled) < 4:
        return Scorer([], [], 0.0), 0.5
    edges = bin_edges(unlabelled)
    prior = class_prior(positive, unlabelled, edges)

    def slope(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        # Logistic loss: derivative as positive is s - 1, as negative s; their values for the sign test.
        as_negative = np.logaddexp(0, b).mean() - prior * np.logaddexp(0, a).mean()
        if as_negative >= 0:
            return np.concatenate([prior * (sigmoid(a) - 1) - prior * sigmoid(a), sigmoid(b)]) / np.concatenate(
                [np.full(len(a), len(a)), np.full(len(b), len(b))]
            )
        # The negative part fell below zero: climb back on it alone.
        return np.concatenate([prior * sigmoid(a) / len(a), -sigmoid(b) / len(b)])

    return minimize(edges, positive, unlabelled, slope), prior


def measured(df: DataFrame, text: str, keep: list[str], scorer: Scorer | None = None, out: str = "measures") -> DataFrame:
    """Columns ``keep`` and each text's measures, or with a scorer its score."""
    copy = fresh(df, "text_to_score")
    plain = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(copy))
    kind = "array<float>" if scorer is None else "double"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema[:-1]), f"`{out}` {kind}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, copy, 1 << 20):
                x = measures(*text_bytes(part.column(copy)))
                if scorer is None:
                    flat = pa.array(x.ravel())
                    value = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)
                else:
                    value = pa.array(scorer.score(x) + np.zeros(len(x)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], value], names=[*keep, out])

    return plain.mapInArrow(run, schema)


def remainder(id_col: str):
    """crc32 of the id as text, modulo 3 (null id: as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3


def fit_quality(docs: DataFrame, labels: DataFrame) -> Scorer:
    """A scorer for ``docs`` (doc_id, text), learned from the labels of two thirds of the documents.

    Positives are documents all of whose labels are 1; unlabelled text is a sample of all documents of
    those two thirds. Both are drawn by a hash of the id, so the sample's expected size is bounded by
    ``POSITIVES`` and ``UNLABELLED`` however many rows there are.
    """
    def drawn(df: DataFrame, most: int, salt: str) -> DataFrame:
        share = min(1.0, most / max(df.count(), 1))
        return df.where(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) < int(share * (1 << 30)))

    good = labels.where(remainder("doc_id") != 1).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    good = drawn(good.select("doc_id"), POSITIVES, "p").withColumn("trusted", F.lit(True))
    all_docs = docs.select("doc_id", "text").where(remainder("doc_id") != 1)
    share = min(1.0, UNLABELLED / max(docs.count(), 1))
    web = F.pmod(F.xxhash64("doc_id", F.lit("u")), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = (
        all_docs.withColumn("web", F.coalesce(web, F.lit(False)))
        .join(F.broadcast(good), "doc_id", "left").where("web or trusted")
    )
    rows = measured(sample, "text", ["web", "trusted"]).toPandas()
    x = np.stack(rows["measures"].to_list()) if len(rows) else np.zeros((0, 1), np.float32)
    scorer, _ = fit(x[rows["trusted"].eq(True).to_numpy()], x[rows["web"].to_numpy(bool)])
    return scorer


def score_quality(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` (columns ``keep``; all, if None) with held_out, score and predicted.

    held_out: the row's label can't have been learned from. Null and empty texts get the score that
    fits their measures, all 0. Columns of the added names, in any spelling, are replaced. Only doc_id
    and quality are read of the labels; scores depend on the text alone.
    """
    added = ["held_out", "score", "predicted"]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    scorer = fit_quality(docs, labels)
    scored = measured(docs, "text", kept, scorer, "score")
    return scored.select(
        *[F.col(f"`{c}`") for c in kept], (remainder("doc_id") == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return score_quality(docs, table(spark, sf_dir, "labels"), keep=["doc_id"])
