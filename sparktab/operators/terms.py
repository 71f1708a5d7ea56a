"""Terms of texts: TF-IDF weights, a counted vocabulary, and principal components over it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktab.operators.folds import top_rows
from sparktab.session import materialize, spread

#: Cells (row, term) that a task multiplies at once.
CELLS_AT_ONCE = 1 << 17
#: Blocks of directions that are kept before they are merged into one.
BLOCKS = 4
#: Directions iterated beside those asked for.
SPARE = 8
#: Bytes of a vocabulary's terms up to which tasks hold it; beyond, terms meet it by an exchange.
VOCABULARY_BYTES = 64 << 20


def words_of(col: str) -> Column:
    """Lower-cased runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(F.col(col)), F.lit("([\\p{L}\\p{N}_]{2,})"), 1)


def term_counts(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, term, tf); a document without terms has one row, whose term is null."""
    each = spread(df.select(key, col)).select(key, F.explode_outer(words_of(col)).alias("term"))
    return each.groupBy(key, "term").agg(F.count("term").alias("tf"))


def inverse_frequency(n: int) -> Column:
    """``ln((1+N)/(1+df)) + 1``."""
    return F.log((F.lit(1.0) + F.lit(n)) / (F.lit(1.0) + F.col("df"))) + 1.0


def term_weights(df: DataFrame, key: str, col: str, min_df: int = 1) -> DataFrame:
    """TF-IDF per (document, term): ``tf * (ln((1+N)/(1+df)) + 1)``.

    Terms are counted where their rows lie; only those of keys that repeat are gathered by an exchange.
    Document frequency is an aggregation of the written counts, which combines map-side. It is joined back
    by term: by broadcast up to a measured ``VOCABULARY_BYTES``, so that no count moves, else by an exchange.
    """
    n, single, several = counts_by_key(df, key, col)
    tf = _cells(single).select("__key", F.col("terms").alias("term"), F.col("tfs").cast("long").alias("tf"))
    if several is not None:
        tf = tf.unionByName(several.where("term IS NOT NULL"))
    dfreq = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    dfreq = materialize(dfreq, "frequencies")
    if _fits_tasks(dfreq):
        dfreq = F.broadcast(dfreq)
    weight = (F.col("tf") * inverse_frequency(n)).alias("weight")
    return tf.join(dfreq, "term").select(F.col("__key").alias(key), "term", "tf", "df", weight)


def counts_by_key(df: DataFrame, key: str, col: str) -> tuple[int, DataFrame, DataFrame | None]:
    """Number of rows, counts (__key, terms, tfs) of keys with one row, and (__key, term, tf) of other keys, if any.

    The input is read once and the counts are written.
    """
    named = df.select(F.col(key).alias("__key"), F.col(col).alias("__text"))
    rows = materialize(row_counts(named, "__key", "__text"), "rows")
    keys = rows.groupBy("__key").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    keys = materialize(keys.select(F.col("__key").alias("__again")), "repeated")
    n = rows.count()
    if keys.isEmpty():
        return n, rows, None
    same = F.col("__key").eqNullSafe(F.col("__again"))
    several = materialize(_summed(rows.join(keys, same, "left_semi")), "counts")
    return n, rows.join(keys, same, "left_anti"), several


def _fits_tasks(words: DataFrame) -> bool:
    """Whether tasks hold the terms of a written table, with the numbers beside them."""
    size = words.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    return size <= VOCABULARY_BYTES


def vocabulary(counts: DataFrame, n_docs: int, max_terms: int, min_df: int = 1) -> DataFrame:
    """(term, id, n, df, idf): the ``max_terms`` terms that occur most often, from ``term_counts``.

    Ids follow the number of occurrences, then the term. Ties at the cut go by the md5 of the term.
    The cut is found from counts, so that only terms near it are ranked.
    """
    terms = counts.where("term IS NOT NULL").groupBy("term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("df"))
    return _most_frequent(terms, n_docs, max_terms, min_df)


def _most_frequent(terms: DataFrame, n_docs: int, max_terms: int, min_df: int) -> DataFrame:
    terms = materialize(terms.where(F.col("df") >= min_df), "terms")
    size, most = terms.agg(F.count(F.lit(1)), F.max("n")).first()
    if size > max_terms:
        # Logarithms, since a few terms hold most occurrences.
        scored = terms.withColumn("__score", F.ln(F.col("n").cast("double")))
        terms = top_rows(scored, [], "__score", "term", max_terms, 0.0, float(np.log(most))).drop("__score")
    # One task numbers max_terms rows at most.
    order = Window.orderBy(F.col("n").desc(), "term")
    numbered = terms.withColumn("id", (F.row_number().over(order) - 1).cast("int"))
    return numbered.select("term", "id", "n", "df", inverse_frequency(n_docs).alias("idf"))


def term_vectors(counts: DataFrame, key: str, words: DataFrame) -> DataFrame:
    """(key, ids, weights): one row a document, terms by id; a document without known terms has empty lists."""
    return _gathered(counts, key, words, F.col("tf") * F.col("__idf"))


def _gathered(counts: DataFrame, key: str, words: DataFrame, weight: Column) -> DataFrame:
    """Vectors by two exchanges: terms meet the vocabulary, then documents gather their cells."""
    known = counts.join(words.select("term", F.col("id").alias("__id"), F.col("idf").alias("__idf")), "term", "left")
    cell = F.when(F.col("__id").isNotNull(), F.struct(F.col("__id").alias("id"), weight.alias("w")))
    cells = known.groupBy(key).agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    return cells.select(key, F.col("cells.id").alias("ids"), F.col("cells.w").alias("weights"))


def _owners(lists: pa.ListArray) -> np.ndarray:
    """The row of each element of ``lists``; null lists have none."""
    sizes = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(sizes)), sizes)


def _lists(owner: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """``n`` lists from values in the order of their rows."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), values)


def _pieces(batch: pa.RecordBatch, col: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose lists in ``col`` hold ``CELLS_AT_ONCE`` values at most, or are one row."""
    ends = np.cumsum(pc.fill_null(batch.column(col).value_lengths(), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + CELLS_AT_ONCE, "right")))
        yield batch.slice(first, last - first)
        first = last


def _counter(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in _pieces(whole, 1)):
            words, n = batch.column(1), batch.num_rows
            coded = words.flatten().dictionary_encode()
            size = max(1, len(coded.dictionary))
            cells, times = np.unique(_owners(words) * size + coded.indices.to_numpy(), return_counts=True)
            owner, code = cells // size, cells % size
            terms = coded.dictionary.take(pa.array(code))
            counts = pa.array(times.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _lists(owner, n, terms), _lists(owner, n, counts)], names=[key, "terms", "tfs"]
            )

    return run


def row_counts(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, terms, tfs): the terms of every row with their counts, counted where the row lies."""

    kind = df.schema[key].dataType.simpleString()
    words = spread(df.select(key, col)).select(key, words_of(col).alias("__words"))
    return words.mapInArrow(_counter(key), f"`{key}` {kind}, terms array<string>, tfs array<int>")


def _cells(counted: DataFrame) -> DataFrame:
    return counted.select("__key", F.explode(F.arrays_zip("terms", "tfs")).alias("c")).select("__key", "c.terms", "c.tfs")


def _summed(counted: DataFrame) -> DataFrame:
    """(key, term, tf) of rows with counts; a key without terms has one row, whose term is null."""
    each = counted.select("__key", F.explode_outer(F.arrays_zip("terms", "tfs")).alias("c"))
    return each.groupBy("__key", F.col("c.terms").alias("term")).agg(F.coalesce(F.sum("c.tfs"), F.lit(0)).alias("tf"))


def _in_place(counted: DataFrame, words: DataFrame) -> DataFrame:
    """Vectors of rows that are whole documents: tasks look their terms up, and nothing moves.

    The vocabulary is broadcast; its caller has measured it.
    """
    table = words.select("term", "id").toPandas().sort_values("id")
    held = counted.sparkSession.sparkContext.broadcast(table["term"].tolist())
    kind = counted.schema["__key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(held.value, pa.string())
        for batch in (piece for whole in batches for piece in _pieces(whole, 1)):
            terms, n = batch.column("terms"), batch.num_rows
            ids = pc.fill_null(pc.index_in(terms.flatten(), known), -1).to_numpy()
            owner, tfs = _owners(terms), batch.column("tfs").flatten().to_numpy()
            met = np.flatnonzero(ids >= 0)
            met = met[np.argsort(owner[met] * max(1, len(known)) + ids[met], kind="stable")]
            owner, ids, tfs = owner[met], pa.array(ids[met].astype(np.int32)), pa.array(tfs[met].astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("__key"), _lists(owner, n, ids), _lists(owner, n, tfs)], names=["__key", "ids", "weights"]
            )

    return counted.mapInArrow(run, f"__key {kind}, ids array<int>, weights array<bigint>")


def _products(batch: pa.RecordBatch, matrix: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows times ``matrix``, some rows at a time: (first row, products, row of each cell, ids, weights)."""
    ids_of, weights_of = batch.column("ids"), batch.column("weights")
    sizes = ids_of.value_lengths().to_numpy(zero_copy_only=False)
    first = 0
    while first < len(sizes):
        last = first + max(1, int(np.searchsorted(np.cumsum(sizes[first:]), CELLS_AT_ONCE, "right")))
        ids = ids_of.slice(first, last - first).flatten().to_numpy()
        weights = weights_of.slice(first, last - first).flatten().to_numpy().astype(float)
        owner = np.repeat(np.arange(min(last, len(sizes)) - first), sizes[first:last])
        out = np.zeros((min(last, len(sizes)) - first, matrix.shape[1]))
        if len(ids):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            out[owner[starts]] = np.add.reduceat(matrix[ids] * weights[:, None], starts)
        yield first, out, owner, ids, weights
        first = last


def gram_times(vectors: DataFrame, directions: np.ndarray) -> np.ndarray:
    """``A' A Q`` for the rows A of ``vectors`` and the directions Q (terms x width), in one scan.

    Each task holds Q and its own sums, terms x width doubles each, and sends on the sums of the
    terms that it met. The driver receives terms x width numbers.
    """
    spark = vectors.sparkSession
    held = spark.sparkContext.broadcast(directions)
    width = directions.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = held.value
        sums = np.zeros(matrix.shape)
        met = np.zeros(len(matrix), bool)
        for batch in batches:
            for _, out, owner, ids, weights in _products(batch, matrix):
                if len(ids):
                    order = np.argsort(ids, kind="stable")
                    here = ids[order]
                    starts = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
                    sums[here[starts]] += np.add.reduceat(out[owner[order]] * weights[order, None], starts)
                    met[here[starts]] = True
        terms = np.flatnonzero(met)
        for start in range(0, len(terms), 10_000):
            some = terms[start : start + 10_000]
            cells = [pa.array(some.astype(np.int32)), *[pa.array(np.ascontiguousarray(sums[some, j])) for j in range(width)]]
            yield pa.RecordBatch.from_arrays(cells, names=["i", *[f"s{j}" for j in range(width)]])

    schema = "i int, " + ", ".join(f"s{j} double" for j in range(width))
    # One task a core, since each one sends a row for every term it met.
    rows = vectors.select("ids", "weights").coalesce(spark.sparkContext.defaultParallelism)
    parts = rows.mapInArrow(run, schema)
    found = parts.groupBy("i").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(width)]).toPandas()
    held.destroy()
    out = np.zeros(directions.shape)
    out[found["i"].to_numpy()] = found.drop(columns="i").to_numpy()
    return out


def principal_directions(
    vectors: DataFrame, n_terms: int, k: int, mean: np.ndarray | None = None, n_rows: int = 0,
    tolerance: float = 1e-9, max_scans: int = 60, seed: int = 42, scale: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of ``A' A`` and their directions (terms x k).

    With ``scale`` (a number for each term) A has the columns of ``vectors`` times those numbers. With
    ``mean`` (that of A's columns) rows are centred, by a correction of rank one. A random
    block of directions is multiplied by the matrix, one scan each; the wanted pairs come from the
    span of the last few blocks, and scans go on until no wanted pair is off by more than
    ``tolerance`` of the largest value. Raises if ``max_scans`` don't suffice.
    """
    k = min(k, n_terms)
    if k == 0:
        return np.zeros(0), np.zeros((n_terms, 0))
    width = min(n_terms, k + SPARE)
    scales = np.ones((n_terms, 1)) if scale is None else scale[:, None]

    def times(q: np.ndarray) -> np.ndarray:
        out = gram_times(vectors, q * scales) * scales
        return out if mean is None else out - n_rows * np.outer(mean, mean @ q)

    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(n_terms, width)))[0]
    basis, image = np.zeros((n_terms, 0)), np.zeros((n_terms, 0))
    for _ in range(max_scans):
        basis, image = np.hstack([basis, block]), np.hstack([image, times(block)])
        small = basis.T @ image
        values, mix = np.linalg.eigh((small + small.T) / 2)
        top = np.argsort(values)[::-1][:width]
        values, ritz, moved = values[top], basis @ mix[:, top], image @ mix[:, top]
        miss = moved - ritz * values
        if np.linalg.norm(miss[:, :k], axis=0).max() <= tolerance * max(values[0], 1e-300):
            break
        if basis.shape[1] >= BLOCKS * width:
            basis, image = ritz, moved
        # Twice, since the first subtraction loses digits where little is left.
        for _ in range(2):
            miss = miss - basis @ (basis.T @ miss)
        left, sizes, _ = np.linalg.svd(miss, full_matrices=False)
        block = left[:, sizes > 1e-13 * max(values[0], 1e-300)][:, : n_terms - basis.shape[1]]
        if block.shape[1] == 0:
            break
    else:
        raise RuntimeError(f"components not settled after {max_scans} scans; raise tolerance or max_scans")
    ritz = ritz[:, :k]
    # The sign that makes the largest loading positive.
    return values[:k], ritz * np.where(ritz[np.abs(ritz).argmax(0), np.arange(k)] < 0, -1.0, 1.0)


@dataclass
class TermComponents:
    """TF-IDF vectors over a counted vocabulary, reduced to their principal components.

    ``fit`` takes the ``max_terms`` most frequent terms of all documents (no hashing: each has a
    column of its own) and finds directions of largest variance; ``centre=False`` gives those of the
    truncated singular value decomposition. Driver and tasks hold matrices of max_terms x
    (components + 8) doubles, 4 to 8 of them on the driver; that is what ``max_terms`` bounds.

    The input is read once, by tasks that count the terms of each row; the counts are written. Rows of
    one key are one document: only keys that repeat go through an exchange, with their terms counted
    before it. All other rows stay where they are. Null and empty texts, and texts without known terms, get zeros.
    Where there are fewer terms than components, the rest are zeros too.
    """

    key: str
    col: str
    components: int = 8
    max_terms: int = 1 << 16
    min_df: int = 1
    centre: bool = True
    words: DataFrame | None = None
    values: np.ndarray | None = None
    loadings: np.ndarray | None = None
    idf: np.ndarray | None = None

    def fit(self, df: DataFrame) -> TermComponents:
        self._learn(*self._counted(df))
        return self

    def _counted(self, df: DataFrame) -> tuple[int, DataFrame, DataFrame | None]:
        return counts_by_key(df, self.key, self.col)

    def _learn(self, n_rows: int, single: DataFrame, several: DataFrame | None) -> DataFrame:
        found = _cells(single).groupBy(F.col("terms").alias("term")).agg(F.sum("tfs").alias("n"), F.count(F.lit(1)).alias("df"))
        if several is not None:
            more = several.where("term IS NOT NULL").groupBy("term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("df"))
            found = found.unionByName(more).groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
        self.words = materialize(_most_frequent(found, n_rows, self.max_terms, self.min_df), "vocabulary")
        vectors = materialize(self._vectors(single, several), "vectors")
        # Weights of a term over all documents: n * idf.
        table = self.words.select("id", "n", "idf").toPandas().sort_values("id")
        n_docs = vectors.count()
        self.idf = table["idf"].to_numpy(float)
        mean = table["n"].to_numpy(float) * self.idf / max(n_docs, 1)
        self.values, self.loadings = principal_directions(
            vectors, len(table), self.components, mean if self.centre else None, n_docs, scale=self.idf
        )
        return vectors

    def _vectors(self, single: DataFrame, several: DataFrame | None) -> DataFrame:
        """(__key, ids, weights): one row a document, with counts for weights."""
        size = self.words.agg(F.sum(F.octet_length("term"))).first()[0] or 0
        if size > VOCABULARY_BYTES:
            moved = _summed(single)
            several = moved if several is None else several.unionByName(moved)
            return _gathered(several, "__key", self.words, F.col("tf"))
        placed = _in_place(single, self.words)
        return placed if several is None else placed.unionByName(_gathered(several, "__key", self.words, F.col("tf")))

    def transform(self, df: DataFrame) -> DataFrame:
        """(key, <col>_pc0, ...): one row a document; products of its vector (not centred) with the directions."""
        return self._project(self._vectors(*self._counted(df)[1:]))

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self._project(self._learn(*self._counted(df)))

    def _project(self, vectors: DataFrame) -> DataFrame:
        matrix = np.zeros((len(self.loadings), self.components))
        matrix[:, : self.loadings.shape[1]] = self.loadings * self.idf[:, None]
        held = vectors.sparkSession.sparkContext.broadcast(matrix)
        names = [f"{self.col}_pc{j}" for j in range(self.components)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, out, *_ in _products(batch, held.value):
                    keys = batch.column(0).slice(first, len(out))
                    yield pa.RecordBatch.from_arrays([keys, *[pa.array(np.ascontiguousarray(c)) for c in out.T]], names=["__key", *names])

        kind = vectors.schema["__key"].dataType.simpleString()
        made = vectors.mapInArrow(run, f"__key {kind}, " + ", ".join(f"`{n}` double" for n in names))
        return made.withColumnRenamed("__key", self.key)


def tfidf_components(df: DataFrame, key: str, col: str, components: int = 8, max_terms: int = 1 << 16) -> DataFrame:
    """TF-IDF vectors of documents reduced to principal components (``TermComponents``)."""
    return TermComponents(key, col, components, max_terms).fit_transform(df)
