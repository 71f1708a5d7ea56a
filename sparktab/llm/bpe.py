"""Byte-pair encoding and decoding in batched numpy rounds.

The symbols of all different words of a batch lie in one flat array. Each round looks up every pair
of neighbours by binary search over the sorted pair keys, takes the lowest rank in each word, merges
it wherever it occurs there, and closes the gaps; words without a known pair leave. A word of n
symbols takes fewer than n rounds, and a round costs what is still active.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktab.llm.common import fresh, query, run_starts, slices, table
from sparktab.llm.words import Splitter, WordCodes, character_kinds
from sparktab.session import spread

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
NO_RANK = np.iinfo(np.int64).max


def printable_bytes() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for i, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + i)
    return [out[b] for b in range(256)]


class Model:
    """Merge rules of a vocabulary file as sorted arrays."""

    def __init__(self, source: str) -> None:
        config = json.loads(source)
        vocab = config["model"]["vocab"]
        end = config["model"]["end_of_word_suffix"] or ""
        self.special_ids = [t["id"] for t in config["added_tokens"]]
        self.specials = [t["content"] for t in config["added_tokens"]]
        self.size = max([*vocab.values(), *self.special_ids]) + 1
        tokens = [""] * self.size
        for token, i in [*vocab.items(), *zip(self.specials, self.special_ids, strict=True)]:
            tokens[i] = token
        self.tokens = tokens
        signs = printable_bytes()
        self.inner = np.array([vocab[c] for c in signs], np.int64)
        self.last = np.array([vocab[c + end] for c in signs], np.int64)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in config["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]

    def encode(self, words: list[str | int]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words, and the number of each. A number stands for a special token."""
        raw = [b"\0" if isinstance(w, int) else w.encode() for w in words]
        lengths = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbol = self.inner[data]
        ends = np.cumsum(lengths) - 1
        symbol[ends] = self.last[data[ends]]
        word = np.repeat(np.arange(len(words)), lengths)
        for i, w in enumerate(words):
            if isinstance(w, int):
                symbol[ends[i]] = self.special_ids[w]
        return self.merge(symbol, word, len(words))

    def merge(self, symbol: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            first = np.flatnonzero(run_starts(word))
            key = np.full(len(symbol), -1, np.int64)
            key[:-1] = np.where(word[1:] == word[:-1], symbol[:-1] * self.size + symbol[1:], -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.ranks[at], NO_RANK)
            sizes = np.diff(np.append(first, len(symbol)))
            best = np.repeat(np.minimum.reduceat(rank, first), sizes)
            active = best < NO_RANK
            if not active.all():
                done.append((symbol[~active], word[~active]))
                symbol, word, at, rank, best = (x[active] for x in (symbol, word, at, rank, best))
                if not len(symbol):
                    break
            take = rank == best
            # Of overlapping occurrences (a a a) every second one is taken, from the left.
            begins = np.flatnonzero(take & ~np.append(False, take[:-1]))
            place = np.arange(len(take))
            since = np.zeros(len(take), np.int64)
            since[begins] = begins
            take &= (place - np.maximum.accumulate(since)) % 2 == 0
            symbol = np.where(take, self.merged[at], symbol)
            keep = ~np.append(False, take[:-1])
            symbol, word = symbol[keep], word[keep]
        ids = np.concatenate([d[0] for d in done]) if done else np.zeros(0, np.int64)
        owner = np.concatenate([d[1] for d in done]) if done else np.zeros(0, np.int64)
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=n)


def encode_texts(
    df: DataFrame, text: str, source: str, digests: bool = False, keep: list[str] | None = None
) -> DataFrame:
    """Every row (columns ``keep``; all, if None) with its ids (``ids``, array of int) and what they decode to (``decoded``).

    With ``digests`` the ids and the decoded text are given as their number and SHA-256 instead
    (``n_tokens``, ``ids_sha256``, ``decoded_sha256``), as decimal ids joined by one space and as
    UTF-8. A null text counts as empty: no ids, decoded "". Columns of ``df`` of these names, in any
    spelling, are replaced; all others are kept. Texts are encoded whole.
    """
    added = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in added]
    kinds = character_kinds()
    copy = fresh(df, "text_to_encode")
    types = ["long", "string", "string"] if digests else ["array<int>", "string"]
    plain = df.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(copy))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema[:-1]), *map(" ".join, zip(added, types, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(source)
        splitter, codes, known = Splitter(model.specials, kinds), WordCodes(model.encode), 0
        cleared = codes.cleared
        shown = pa.array(model.tokens, pa.string())
        numbers = pa.array([str(i) for i in range(model.size)], pa.string())
        id_text = word_text = pa.array([], pa.string())
        for batch in batches:
            for part in slices(batch, copy):
                words = splitter.split(part.column(copy).to_pylist())
                rows = codes.codes(words)
                if codes.cleared > cleared:
                    cleared, known, id_text, word_text = codes.cleared, 0, id_text[:0], word_text[:0]
                if len(codes.offsets) - 1 > known:
                    ids = pa.array(codes.ids[codes.offsets[known] :])
                    at = pa.array((codes.offsets[known:] - codes.offsets[known]).astype(np.int32))
                    more = [pc.binary_join(pa.ListArray.from_arrays(at, names.take(ids)), " ") for names in (numbers, shown)]
                    id_text = pa.concat_arrays([id_text, more[0]])
                    word_text = pa.concat_arrays([word_text, more[1]])
                    known = len(codes.offsets) - 1
                bounds = pa.array(words.bounds.astype(np.int32))
                decoded = pc.binary_join(pa.ListArray.from_arrays(bounds, word_text.take(pa.array(rows))), " ")
                sizes = np.diff(codes.offsets)[rows]
                total = np.append(0, np.cumsum(sizes))[words.bounds]
                if digests:
                    joined = pc.binary_join(pa.ListArray.from_arrays(bounds, id_text.take(pa.array(rows))), " ")
                    out = [
                        pa.array(np.diff(total)),
                        pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in joined], pa.string()),
                        pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in decoded], pa.string()),
                    ]
                else:
                    flat = codes.ids[ragged_rows(codes.offsets, rows)]
                    out = [pa.ListArray.from_arrays(pa.array(total.astype(np.int32)), pa.array(flat, pa.int32())), decoded]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *out], names=[*kept, *added])

    return plain.mapInArrow(run, schema)


def ragged_rows(offsets: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Positions of the ids of the given rows, one row after another."""
    sizes = np.diff(offsets)[rows]
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(offsets[rows] - (ends - sizes), sizes)


def vocabulary(path: str = VOCABULARY) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


@query("op6_bpe")
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_texts(spread(docs), "text", vocabulary(), digests=True, keep=["doc_id"])
