"""Small column helpers used across the package."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(c: Column) -> Column:
    """True for finite numbers, else false or null."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def finite(c: Column) -> Column:
    """Null unless ``c`` is a finite number."""
    return F.when(is_finite(c), c)


def clip(c: Column, lo: float | None, hi: float | None) -> Column:
    if lo is not None:
        c = F.greatest(c, F.lit(float(lo)))
    if hi is not None:
        c = F.least(c, F.lit(float(hi)))
    return c


def total(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def weighted(cols: Sequence[Column], weights: Sequence[float], const: float = 0.0) -> Column:
    """``sum(w*c) + const`` with zero weights left out of the expression."""
    terms = [c if w == 1 else c * F.lit(float(w)) for c, w in zip(cols, weights) if w]
    if const or not terms:
        terms.append(F.lit(float(const)))
    return total(terms)


_MAX_TREE = 64


def number_array(values: Sequence[float]) -> Column:
    """Constant array of doubles, folded once at planning whatever its length."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def edges_below(c: Column, edges: Sequence[float], closed: str = "left") -> Column:
    """Number of sorted ``edges`` that lie below ``c``.

    ``closed='left'`` counts ``edge <= c`` (intervals ``[a, b)``), ``'right'`` counts
    ``edge < c`` (intervals ``(a, b]``). Up to 64 edges this is a balanced tree of
    comparisons in generated code; beyond that, which would outgrow one generated method,
    a binary search over a constant array. Both take log2(len) steps per row.
    """
    if closed not in ("left", "right"):
        raise ValueError("closed must be 'left' or 'right'")

    def node(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        edge = F.lit(float(edges[mid]))
        return F.when(c < edge if closed == "left" else c <= edge, node(lo, mid)).otherwise(
            node(mid + 1, hi)
        )

    if len(edges) <= _MAX_TREE:
        return F.when(c.isNotNull(), node(0, len(edges)))
    table = number_array(edges)
    strides = [1 << i for i in reversed(range(len(edges).bit_length()))]

    def step(found: Column, stride: Column) -> Column:
        edge = F.get(table, found + stride - 1)
        below = edge <= c if closed == "left" else edge < c
        return F.when(below, found + stride).otherwise(found)

    search = F.aggregate(F.array(*[F.lit(s) for s in strides]), F.lit(0), step)
    return F.when(c.isNotNull(), search)


def hash_text(key: Column | str, seed: int) -> Column:
    """Seeded, engine-independent hash text used wherever rows need a random order."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
