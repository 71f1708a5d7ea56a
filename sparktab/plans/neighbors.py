"""Exact k-nearest-neighbour votes at any size.

Reference rows fall into a tree of cells around sampled pivots: into the group of the nearest of a
few chief pivots, there into the cell of the group's nearest pivot. For each query the triangle
inequality gives an upper bound of its k-th distance and lower bounds for groups and cells, and the
query visits only cells that can hold a neighbour. Driver and tasks hold the pivots and k radii of
each, whose number is about the square root of the rows, and no table of pairs of pivots. Cells are cut into blocks of bounded size,
so one crowded cell becomes many tasks, and neighbouring blocks are dealt to bins. A query moves once for each bin
that it visits, with the numbers of the blocks; each (query, bin) keeps k rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparktab.session import materialize


def _pivots(ref: DataFrame, features: str, n: int, wanted: int) -> np.ndarray:
    # Drawn evenly over the whole frame, whatever the order of its files.
    fraction = min(1.0, wanted / max(n, 1))
    probe = ref.sample(fraction=fraction, seed=3) if fraction < 1 else ref
    rows = [r[0] for r in probe.select(features).collect()]
    if not rows:
        rows = [ref.select(features).first()[0]]
    return np.unique(np.array(rows, dtype="float64"), axis=0)


def _distance_function():
    """Made inside a function, so that it travels to the workers with the code that uses it."""

    def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Euclidean; differences are formed directly, so equal rows give exactly 0."""
        out = np.empty((len(x), len(y)))
        step = max(1, 1_000_000 // max(1, len(y) * x.shape[1]))
        for s in range(0, len(x), step):
            diff = x[s : s + step, None, :] - y[None, :, :]
            out[s : s + step] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
        return out

    return distances


#: Numbers that a task holds at once while it compares queries with pivots.
NUMBERS_AT_ONCE = 4_000_000
#: Rows of a bin of whole blocks, and queries that meet it in one task.
BIN_ROWS = 8192


@dataclass
class PivotTree:
    """Pivots in groups around chief pivots; cell numbers follow the groups."""

    chiefs: np.ndarray
    pivots: np.ndarray
    starts: np.ndarray  # first pivot of each group, and the end

    @classmethod
    def of(cls, points: np.ndarray, seed: int = 5) -> PivotTree:
        """Groups of different points; a chief for the square root of their number."""
        distances = _distance_function()
        some = np.random.default_rng(seed).choice(len(points), math.isqrt(len(points)), replace=False)
        chiefs = points[np.sort(some)]
        step = max(1, NUMBERS_AT_ONCE // len(chiefs))
        nearest_ = [distances(points[i : i + step], chiefs).argmin(1) for i in range(0, len(points), step)]
        group = np.concatenate(nearest_)
        # Every chief is a point, so no group is empty.
        return cls(chiefs, points[np.argsort(group, kind="stable")], np.searchsorted(np.sort(group), np.arange(len(chiefs) + 1)))


def _placer(tree: PivotTree, features: str):
    distances = _distance_function()

    def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf[features].to_numpy()).astype("float64")
            step = max(1, NUMBERS_AT_ONCE // len(tree.chiefs))
            group, reach = np.empty(len(x), dtype="int32"), np.empty(len(x))
            for i in range(0, len(x), step):
                d = distances(x[i : i + step], tree.chiefs)
                group[i : i + step], reach[i : i + step] = d.argmin(1), d.min(1)
            cell, radius = np.empty(len(x), dtype="int32"), np.empty(len(x))
            for g in np.unique(group):
                rows, first = np.flatnonzero(group == g), tree.starts[g]
                here = tree.pivots[first : tree.starts[g + 1]]
                step = max(1, NUMBERS_AT_ONCE // len(here))
                for i in range(0, len(rows), step):
                    d = distances(x[rows[i : i + step]], here)
                    cell[rows[i : i + step]], radius[rows[i : i + step]] = first + d.argmin(1), d.min(1)
            yield pdf.assign(cell=cell, radius=radius, grp=group, reach=reach)

    return to_cells


def _smallest(rows: DataFrame, by: str, value: str, k: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, value, largest): the k smallest values of each of ``n`` parts, and the largest (-1 without rows)."""
    order = Window.partitionBy(by).orderBy(value)
    few = rows.select(by, value).withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k)
    few = few.select(by, value).orderBy(by, value).toPandas()
    far = np.full(n, -1.0)
    most = rows.groupBy(by).agg(F.max(value).alias("far")).toPandas()
    far[most[by].to_numpy()] = most["far"].to_numpy()
    return few[by].to_numpy(), few[value].to_numpy(), far


def _bounds():
    def kth(values: np.ndarray, k: int) -> np.ndarray:
        """An upper bound of the k-th distance, from distances that rows are known not to exceed."""
        if values.shape[1] < k:
            return np.full(len(values), np.inf)
        return np.partition(values, k - 1, axis=1)[:, k - 1] * (1 + 1e-9) + 1e-12

    def plane(d: np.ndarray, home: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """Least distance to rows that are nearer to another pivot than to the home pivot."""
        own = d[np.arange(len(d)), home][:, None] ** 2
        least = d**2 - own - 1e-12 * (d**2 + own)
        return np.divide(least, 2 * gap, out=np.full_like(d, -np.inf), where=gap > 0)

    return kth, plane


def _visitor(tree: PivotTree, features: str, k: int, n_rows: int, of_groups, of_cells, first_block: np.ndarray, bin_of: np.ndarray):
    """``first_block``: the first block of each cell, and the end; ``bin_of``: the bin of each block."""
    distances = _distance_function()
    kth, plane = _bounds()
    chief_of, chief_reach, group_far = of_groups
    cell_of, cell_reach, cell_far = of_cells
    chief_gaps = distances(tree.chiefs, tree.chiefs)
    # Where the radii of each group's cells start.
    spans = np.searchsorted(cell_of, tree.starts)
    widest = max(int(np.diff(spans).max()), len(chief_of), len(tree.chiefs), int(np.diff(tree.starts).max()), 1)
    wanted_k = min(k, n_rows)

    def inside(x: np.ndarray, g: int) -> np.ndarray:
        return distances(x, tree.pivots[tree.starts[g] : tree.starts[g + 1]])

    def visited(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = distances(x, tree.chiefs)
        bound = kth(d[:, chief_of] + chief_reach, wanted_k)
        home = d.argmin(1)
        for g in np.unique(home):
            rows = np.flatnonzero(home == g)
            near = slice(spans[g], spans[g + 1])
            upper = inside(x[rows], g)[:, cell_of[near] - tree.starts[g]] + cell_reach[near]
            bound[rows] = np.minimum(bound[rows], kth(upper, wanted_k))
        least = np.maximum(d - group_far, plane(d, home, chief_gaps[home]))
        open_ = (least <= bound[:, None]) & (group_far >= 0)
        found = []
        for g in np.flatnonzero(open_.any(0)):
            rows, first, last = np.flatnonzero(open_[:, g]), tree.starts[g], tree.starts[g + 1]
            d_in = inside(x[rows], g)
            nearest_ = d_in.argmin(1)
            gap = inside(tree.pivots[first + nearest_], g)
            far = cell_far[first:last]
            hit = (np.maximum(d_in - far, plane(d_in, nearest_, gap)) <= bound[rows, None]) & (far >= 0)
            r, c = np.nonzero(hit)
            found.append((rows[r], first + c))
        return tuple(np.concatenate(f) for f in zip(*found))

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, NUMBERS_AT_ONCE // max(widest, 4 * len(tree.pivots)))
        dim = tree.pivots.shape[1]
        n_bins = int(bin_of[-1]) + 1
        for pdf in batches:
            for i in range(0, len(pdf), step):
                some = pdf.iloc[i : i + step]
                rows, cells_ = visited(np.stack(some[features].to_numpy()).astype("float64"))
                by_row = np.argsort(rows, kind="stable")
                rows, cells_ = rows[by_row], cells_[by_row]
                ends = np.searchsorted(rows, np.arange(len(some) + 1))
                times = first_block[cells_ + 1] - first_block[cells_]
                # Some queries at a time: their blocks, and copies of them for each bin, are bounded.
                each = np.diff(np.r_[0, np.cumsum(times)][ends])
                upto = np.r_[0, np.cumsum(each + np.minimum(each, n_bins) * dim)]
                start = 0
                while start < len(some):
                    stop = max(start + 1, int(np.searchsorted(upto, upto[start] + NUMBERS_AT_ONCE, "right")) - 1)
                    here = slice(ends[start], ends[stop])
                    count, first = times[here], first_block[cells_[here]]
                    last = np.cumsum(count)
                    block = np.arange(last[-1]) - np.repeat(last - count - first, count)
                    owner = np.repeat(rows[here], count)
                    order = np.lexsort((block, owner))
                    owner, block = owner[order], block[order]
                    cell = owner * n_bins + bin_of[block]
                    cuts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
                    out = some.iloc[owner[cuts]].reset_index(drop=True)
                    yield out.assign(bin=bin_of[block[cuts]], blocks=np.split(block.astype("int32"), cuts[1:]))
                    start = stop

    return visits


def nearest(
    ref: DataFrame, query: DataFrame, key: str, features: str, k: int, y: str = "y",
    block_rows: int = 20_000,
) -> DataFrame:
    """``(key, ref_key, y, distance)``: the k nearest reference rows, ties by reference key.

    The number of pivots grows with the square root of the rows, that of chief pivots with its
    root. Cells are cut into blocks of ``block_rows`` rows, at most; a query is compared only with blocks
    of cells that it visits. A task holds the pivots or one bin of blocks, a slice of queries and some of their distances.
    """
    distances = _distance_function()
    n = ref.count()
    tree = PivotTree.of(_pivots(ref, features, n, max(1, min(2 * math.isqrt(n), n // 50))))
    m = len(tree.pivots)
    shape = f"`{key}` long, `{y}` int, `{features}` array<double>, cell int, radius double, grp int, reach double"
    cast = F.col(features).cast("array<double>").alias(features)
    cells = materialize(
        ref.select(F.col(key).cast("long"), F.col(y).cast("int"), cast).mapInPandas(_placer(tree, features), shape),
        "knn-cells",
    )
    # One row per pivot.
    summary = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")).toPandas()
    sizes = np.zeros(m, dtype="int64")
    sizes[summary["cell"].to_numpy()] = summary["rows"].to_numpy()
    times = -(-sizes // block_rows)
    first_block = np.r_[0, np.cumsum(times)]
    # Bins of even size on both sides, small enough for some tasks a core.
    tasks = 4 * ref.sparkSession.sparkContext.defaultParallelism
    side = max(1, min(BIN_ROWS, math.isqrt(n * query.count() // tasks)))
    owner = np.repeat(np.arange(m), times)
    part = np.arange(first_block[-1]) - first_block[owner]
    bin_of = (np.cumsum(sizes)[owner] - sizes[owner] + part * sizes[owner] // times[owner]) // side
    bin_of = np.unique(bin_of, return_inverse=True)[1].astype("int32")
    of_groups = _smallest(cells, "grp", "reach", k, len(tree.chiefs))
    of_cells = _smallest(cells, "cell", "radius", k, m)
    visits = _visitor(tree, features, k, n, of_groups, of_cells, first_block, bin_of)

    asked = query.select(F.col(key).cast("long"), cast).mapInPandas(
        visits, f"`{key}` long, `{features}` array<double>, bin int, blocks array<int>"
    )
    asked = materialize(asked, "knn-asked")
    loads = materialize(
        asked.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / side).cast("int").alias("slices")), "knn-loads"
    )
    asked = asked.join(loads, "bin").select(
        key, features, "bin", "blocks",
        F.pmod(F.xxhash64(key), F.col("slices")).cast("int").alias("slice"),
    )

    def in_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell = pdf["cell"].to_numpy()
            block = first_block[cell] + pdf["part"].to_numpy() % times[cell]
            yield pdf.drop(columns=["cell", "part"]).assign(bin=bin_of[block], block=block.astype("int32"))

    placed = cells.select(key, y, features, "cell", F.abs(F.xxhash64(key) % (1 << 31)).alias("part")).mapInPandas(
        in_blocks, f"`{key}` long, `{y}` int, `{features}` array<double>, bin int, block int"
    )
    stored = placed.join(loads, "bin").withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    ).drop("slices")

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({key: [], "ref_key": [], y: [], "distance": []})
        right = right.sort_values(key, ignore_index=True)
        ids, labels, owns = right[key].to_numpy(), right[y].to_numpy(), right["block"].to_numpy()
        points, asked_ = np.stack(right[features].to_numpy()), np.stack(left[features].to_numpy())
        numbers, at = np.unique(owns, return_inverse=True)
        wanted, width, parts = left["blocks"].to_numpy(), min(k, len(ids)), []
        rows = max(1, NUMBERS_AT_ONCE // len(ids))
        squares = np.einsum("ij,ij->i", points, points)
        pairs = max(1, 1_000_000 // points.shape[1])
        for start in range(0, len(asked_), rows):
            some, lists = asked_[start : start + rows], wanted[start : start + rows]
            who, block = np.repeat(np.arange(len(some)), [len(b) for b in lists]), np.concatenate(lists)
            # A block may have no rows, since the hash of the key deals them out.
            place = np.minimum(np.searchsorted(numbers, block), len(numbers) - 1)
            visited = np.zeros((len(some), len(numbers)), dtype=bool)
            visited[who[numbers[place] == block], place[numbers[place] == block]] = True
            seen = visited[:, at]
            # Products find the rows that can be near, up to what rounding adds; differences decide.
            own = np.einsum("ij,ij->i", some, some)[:, None]
            d = own + squares - 2 * (some @ points.T)
            slack = (points.shape[1] + 8) * 4e-15 * (own + squares.max())
            if not np.isfinite(d).all():
                d, slack = distances(some, points), 0.0
            d[~seen] = np.inf
            bound = np.partition(d, width - 1, axis=1)[:, width - 1 : width] + slack
            q, r = np.nonzero((d <= bound) & seen)
            far = np.empty(len(q))
            for i in range(0, len(q), pairs):
                diff = some[q[i : i + pairs]] - points[r[i : i + pairs]]
                far[i : i + pairs] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
            # Ties by reference key.
            near = np.lexsort((r, far, q))
            q, r, far = q[near], r[near], far[near]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            q, r, far = q[place < width], r[place < width], far[place < width]
            parts.append((left[key].to_numpy()[start + q], ids[r], labels[r], far))
        columns = [np.concatenate(c) for c in zip(*parts)]
        return pd.DataFrame(dict(zip([key, "ref_key", y, "distance"], columns)))

    group = ["bin", "slice"]
    found = asked.groupBy(*group).cogroup(stored.groupBy(*group)).applyInPandas(
        match, f"`{key}` long, ref_key long, `{y}` int, distance double"
    )
    best = Window.partitionBy(key).orderBy("distance", "ref_key")
    return found.withColumn("__k", F.row_number().over(best)).where(F.col("__k") <= k).drop("__k")


def knn_votes(neighbours: DataFrame, key: str, n_classes: int, y: str = "y") -> DataFrame:
    """Votes weighted by 1/distance; when a neighbour is at distance 0 only such rows vote."""
    zero = F.min("distance").over(Window.partitionBy(key)) == 0
    weight = F.when(zero, (F.col("distance") == 0).cast("double")).otherwise(
        F.try_divide(F.lit(1.0), F.col("distance"))
    )
    sums = [F.sum(F.when(F.col(y) == c, F.col("__w")).otherwise(0.0)) for c in range(n_classes)]
    votes = neighbours.withColumn("__w", weight).groupBy(key).agg(
        F.sum("__w").alias("__all"), *[s.alias(f"__s{c}") for c, s in enumerate(sums)]
    )
    p = F.array(*[F.col(f"__s{c}") / F.col("__all") for c in range(n_classes)])
    return votes.select(key, p.alias("p"))


def knn_classify(
    ref: DataFrame, query: DataFrame, key: str, features: str, n_classes: int, k: int = 15,
    y: str = "y", **options,
) -> DataFrame:
    return knn_votes(nearest(ref, query, key, features, k, y, **options), key, n_classes, y)
