"""Integer and text codes computed from one row: fixed bins, rounding codes, crosses."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktab.functions.exprs import edges_below, finite

INT32_MIN = -2147483648

# Constants of the hashed crosses (fixed values).
HASH_SHIFT_A = 1_000_003
HASH_SHIFT_B = 9_176
HASH_SHIFT_C = 17_191
HASH_MODULUS = 2_147_483_647

# Edges and labels that rebuild the two sky categories from colours (fixed values).
SPECTRAL_EDGES = (-1.0, -0.5, 0.0)
SPECTRAL_LABELS = ("M", "G/K", "A/F", "O/B")
POPULATION_EDGES = (2.2,)
POPULATION_LABELS = ("Blue_Cloud", "Red_Sequence")


def fixed_bin(
    c: Column, edges: Sequence[float], labels: Sequence[str] | None = None,
    closed: str = "right", missing: str | int | None = None,
) -> Column:
    """Cut at fixed edges: labelled, or integer codes 0..len(edges).

    ``missing`` is given to rows that are null or not finite.
    """
    value = finite(c)
    code = edges_below(value, edges, "right" if closed == "right" else "left")
    if labels is None:
        return F.coalesce(code, F.lit(-1 if missing is None else missing))
    named = F.array(*[F.lit(x) for x in labels])[code]
    return F.coalesce(named, F.lit("nan" if missing is None else missing))


def rebuild_sky_categories(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "spectral_type": fixed_bin(F.col("r") - F.col("g"), SPECTRAL_EDGES, SPECTRAL_LABELS),
            "galaxy_population": fixed_bin(
                F.col("u") - F.col("r"), POPULATION_EDGES, POPULATION_LABELS
            ),
        }
    )


def _known(c: Column, sentinel: float) -> Column:
    return F.coalesce(finite(c), F.lit(sentinel))


def floor_code(c: Column, sentinel: float = -999999.0) -> Column:
    return F.floor(_known(c, sentinel)).cast("long")


def round_code(c: Column, decimals: int, sentinel: float = -999999.0) -> Column:
    """Scaled and rounded half to even."""
    return F.rint(_known(c, sentinel) * F.lit(float(10**decimals))).cast("long")


def mod_code(c: Column, modulus: int) -> Column:
    """Integer part of the absolute value, modulo ``modulus``; missing counts as 0."""
    return F.pmod(F.floor(_known(F.abs(c), 0.0)).cast("long"), F.lit(modulus)).cast("int")


def frac_code(c: Column, scale: int, sentinel: int = INT32_MIN) -> Column:
    """First digits of the fraction of the absolute value."""
    a = finite(F.abs(c))
    return F.coalesce(F.floor((a - F.floor(a)) * scale).cast("int"), F.lit(sentinel))


def scaled_floor_key(c: Column, scale: float) -> Column:
    """``floor(c*scale)`` as a text category; missing becomes the smallest 32-bit integer."""
    code = F.floor(finite(c) * F.lit(float(scale))).cast("long")
    return F.coalesce(code, F.lit(INT32_MIN).cast("long")).cast("string")


def token(c: Column, missing: str = "__NA__") -> Column:
    return F.coalesce(c.cast("string"), F.lit(missing))


def cross(cols: Sequence[Column], sep: str = "|", missing: str = "__NA__") -> Column:
    return F.concat_ws(sep, *[token(c, missing) for c in cols])


def hash_cross2(a: Column, b: Column) -> Column:
    a, b = a.cast("long"), b.cast("long")
    return F.pmod(
        (a + F.lit(HASH_SHIFT_A)) * F.lit(HASH_SHIFT_A) + (b + F.lit(HASH_SHIFT_B)),
        F.lit(HASH_MODULUS).cast("long"),
    )


def hash_cross3(a: Column, b: Column, c: Column) -> Column:
    """Nested two-way hash; reduced before the second product, which leaves the residue
    unchanged and keeps the product inside 64 bits for any 32-bit codes."""
    modulus = F.lit(HASH_MODULUS).cast("long")
    return F.pmod(
        hash_cross2(a, b) * F.lit(HASH_SHIFT_A) + (c.cast("long") + F.lit(HASH_SHIFT_C)), modulus
    )


def all_crosses(
    df: DataFrame, bases: Sequence[str], manual: Sequence[tuple[str, str]] = (), width: int | None = None
) -> DataFrame:
    """Hashed crosses: the manual pairs, all pairs of the bases that exist (of the first ``width``,
    if given), and the trios at positions 0-2, 3-5 and 6-8. Absent bases are skipped."""
    have = set(df.columns)
    bases = [b for b in bases if b in have][:width]
    new: dict[str, Column] = {}
    for a, b in manual:
        if a in have and b in have:
            new[f"COMBO_{a}__{b}"] = hash_cross2(F.col(a), F.col(b))
    for a, b in combinations(bases, 2):
        new[f"PAIR_{a}__{b}"] = hash_cross2(F.col(a), F.col(b))
    for i in (0, 3, 6):
        trio = bases[i : i + 3]
        if len(trio) == 3:
            new["TRIO_" + "__".join(trio)] = hash_cross3(*[F.col(t) for t in trio])
    return df.withColumns(new)


def ordinal_map(c: Column, codes: dict[str, int], unknown: int = -1) -> Column:
    out = F.lit(unknown)
    for value, code in codes.items():
        out = F.when(c == F.lit(value), F.lit(code)).otherwise(out)
    return out


def one_hot(df: DataFrame, col: str, levels: Sequence, prefix: str | None = None) -> DataFrame:
    prefix = prefix or col
    return df.withColumns(
        {
            f"{prefix}_{v}": F.coalesce((F.col(col) == F.lit(v)).cast("int"), F.lit(0))
            for v in levels
        }
    )
