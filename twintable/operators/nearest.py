"""Exact nearest-neighbour distances between mixed-type tables.

The distance is Euclidean over numbers divided by their deviation and one-hot
categories: two different known categories add 2 to the square, a category the
real table never saw adds 1.

How the work is cut up, so that no task sees a whole table or a whole group:

1. Equal rows fold into one row with a count; categories become numbers.
2. A bounded sample of real rows is halved again and again along the column
   that spreads most, which gives a tree of cells. Every real row goes down the
   tree to its cell; cells, and all nodes above them, keep the least and
   greatest value of each column.
3. A query row is first compared with the cell it would lie in, which gives an
   upper bound. Then it goes down the tree again, past nodes whose box is
   farther away, to the cells that could still hold something nearer.
4. Cells and visitors are cut into blocks of bounded size before they meet, so
   a cell that holds a third of the table is many tasks, not one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from twintable.functions.noise import uniform
from twintable.operators.counts import value_counts
from twintable.operators.selection import exact_quantiles
from twintable.operators.validate import _with_known_flags
from twintable.session import materialize
from twintable.spec import feature_types

#: Rows of the sample that is halved, and how many of them make a cell.
MAX_PIVOTS = 1 << 17
CELL_PIVOTS = 4
#: Different rows that a cell should hold, as long as the sample allows.
CELL_ROWS = 512
#: A category is no use to halve by if fewer rows than this share a value.
PEERS = 4
BLOCK_ROWS = 8192
TILE_CELLS = 250_000
#: Pairs of a row and a node that are looked at together.
PAIRS = 200_000


@dataclass(frozen=True)
class Space:
    """What the real table says about distance; one entry per column."""

    medians: dict[str, float]
    deviations: dict[str, float]
    modes: dict[str, str]

    @property
    def numbers(self) -> list[str]:
        return [f"x{i}" for i in range(len(self.medians))]

    @property
    def categories(self) -> list[str]:
        return [f"c{i}" for i in range(len(self.modes))]

    @property
    def weights(self) -> list[str]:
        return [f"w{i}" for i in range(len(self.modes))]


def fit_space(real: DataFrame, target: str | None) -> Space:
    """Medians, deviations after filling, and most frequent categories."""
    numeric, categorical = feature_types(real, target)
    medians, deviations, modes = {}, {}, {}
    if numeric:
        found = {r["column"]: r["p50"] for r in exact_quantiles(real, numeric, (0.5,)).collect()}
        medians = {c: float(found.get(c, 0.0)) for c in numeric}
        spread = real.agg(
            *[F.stddev_pop(F.coalesce(F.col(c).cast("double"), F.lit(medians[c]))).alias(c) for c in numeric]
        ).first()
        deviations = {c: float(spread[c] or 1.0) for c in numeric}
    if categorical:
        best = F.min(F.struct((-F.col("n")).alias("k"), "value")).getField("value")
        rows = (
            value_counts(real, categorical)
            .where(F.col("value").isNotNull())
            .groupBy("column")
            .agg(best.alias("mode"))
            .collect()
        )
        found = {r["column"]: r["mode"] for r in rows}
        modes = {c: found.get(c, "") for c in categorical}
    return Space(medians, deviations, modes)


def encode(df: DataFrame, space: Space, known_in: DataFrame | None = None) -> DataFrame:
    """Distinct points ``x*, c*, w*`` with their count ``n``.

    ``known_in`` is the real table when ``df`` is another one: categories it
    lacks weigh 1 instead of 2.
    """
    categories = list(space.modes)
    filled = df.select(
        *[F.coalesce(F.col(c).cast("double"), F.lit(m)).alias(c) for c, m in space.medians.items()],
        *[F.coalesce(F.col(c).cast("string"), F.lit(m)).alias(c) for c, m in space.modes.items()],
    )
    points = filled.groupBy(*filled.columns).agg(F.count(F.lit(1)).alias("n"))
    if known_in is not None:
        points = _with_known_flags(known_in, points, categories)

    def weight(c: str) -> Column:
        if known_in is None:
            return F.lit(2)
        return F.when(F.coalesce(F.col(f"_known_{c}"), F.lit(False)), 2).otherwise(1)

    return points.select(
        *[(F.col(c) + F.lit(0.0)).alias(x) for c, x in zip(space.medians, space.numbers)],
        *[F.col(c).alias(a) for c, a in zip(categories, space.categories)],
        *[weight(c).alias(w) for c, w in zip(categories, space.weights)],
        "n",
    )


@dataclass(frozen=True)
class _Tree:
    """Nodes as arrays; the right child follows the left one, a cell has ``column`` -1."""

    column: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    rows: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def home(self, values: np.ndarray, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row, and the last node on the way with ``least`` rows."""
        node = np.zeros(len(values), dtype=np.int64)
        safe = node.copy()
        going = np.arange(len(values))
        while len(going):
            here = node[going]
            if self.rows is not None:
                enough = self.rows[here] >= least
                safe[going[enough]] = here[enough]
            inner = self.column[here] >= 0
            going, here = going[inner], here[inner]
            node[going] = self.child[here] + (values[going, self.column[here]] > self.cut[here])
        return node, safe

    def reached(self, q: np.ndarray, weights: np.ndarray, bound: np.ndarray, deviations: list[float]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a row and a cell whose box is within the row's bound, at most ``PAIRS`` at a time."""
        stack = [(np.arange(len(q)), np.zeros(len(q), dtype=np.int64))]
        while stack:
            row, node = stack.pop()
            if len(row) > PAIRS:
                half = len(row) // 2
                stack += [(row[:half], node[:half]), (row[half:], node[half:])]
                continue
            near = _nearest_corner(q[row], weights[row], self.low[node], self.high[node], deviations) <= bound[row]
            row, node = row[near], node[near]
            inner = self.column[node] >= 0
            if not inner.all():
                yield row[~inner], node[~inner]
            if inner.any():
                row, left = row[inner], self.child[node[inner]]
                stack.append((np.concatenate([row, row]), np.concatenate([left, left + 1])))

    def with_boxes(self, cells: pa.Table, names: list[str]) -> _Tree:
        """The same tree with counts and boxes of all nodes, from those of its cells."""
        n, k = len(self.column), len(names)
        rows, low, high = np.zeros(n, dtype=np.int64), np.full((n, k), np.inf), np.full((n, k), -np.inf)
        at = cells.column("cell").to_numpy()
        rows[at] = cells.column("rows").to_numpy()
        for j, name in enumerate(names):
            low[at, j] = cells.column(f"low_{name}").to_numpy()
            high[at, j] = cells.column(f"high_{name}").to_numpy()
        for node in range(n - 1, -1, -1):  # children come after their parent
            if self.column[node] >= 0:
                both = slice(self.child[node], self.child[node] + 2)
                rows[node], low[node], high[node] = rows[both].sum(), low[both].min(axis=0), high[both].max(axis=0)
        return replace(self, rows=rows, low=low, high=high)


def _halved(sample: np.ndarray, deviations: list[float], each: float) -> _Tree:
    """Cells of about ``CELL_PIVOTS`` rows of the sample; a row of it stands for ``each`` rows.

    Halved is the column that adds most to the squared distance of two rows. A category
    whose values hardly two rows share adds the same to nearly all, so it rules nothing out.
    """
    column, cut, child = [-1], [0.0], [0]
    stack = [(0, sample)]
    while stack:
        node, part = stack.pop()
        m = len(part)
        if m < 2 * CELL_PIVOTS:
            continue
        ordered = np.sort(part, axis=0)
        spread = np.zeros(part.shape[1])
        for j in range(part.shape[1]):
            if not ordered[0, j] < ordered[-1, j]:
                continue
            if j < len(deviations):
                spread[j] = np.nan_to_num(part[:, j].var() / deviations[j] ** 2)
            else:
                runs = np.diff(np.flatnonzero(np.concatenate([[True], ordered[1:, j] != ordered[:-1, j], [True]])))
                same = (runs * (runs - 1)).sum() / (m * (m - 1))
                spread[j] = 1 - same if same * m * each >= PEERS else 0.0
        best = int(spread.argmax()) if len(spread) else 0
        if not len(spread) or not spread[best] > 0:
            continue
        values = ordered[:, best]
        middle = values[(m - 1) // 2]
        if middle == values[-1]:
            middle = values[np.searchsorted(values, middle) - 1]
        right = part[:, best] > middle
        column[node], cut[node], child[node] = best, float(middle), len(column)
        for side in (part[~right], part[right]):
            stack.append((len(column), side))
            column.append(-1)
            cut.append(0.0)
            child.append(0)
    return _Tree(np.array(column), np.array(cut), np.array(child))


def _matrix(table: pa.Table | pa.RecordBatch, names: list[str]) -> np.ndarray:
    out = np.empty((table.num_rows, len(names)))
    for j, name in enumerate(names):
        out[:, j] = table.column(name).to_numpy()
    return out


def _square_distances(q: np.ndarray, weights: np.ndarray, r: np.ndarray, deviations: list[float]) -> np.ndarray:
    """Squares between rows of ``q``, whose categories weigh ``weights``, and of ``r``."""
    total = np.zeros((len(q), len(r)))
    numbers = len(deviations)
    for j, deviation in enumerate(deviations):
        gap = (q[:, j, None] - r[None, :, j]) / deviation
        gap *= gap
        total += gap
    for j in range(weights.shape[1]):
        own, other = q[:, numbers + j], r[:, numbers + j]
        if (other == other[0]).all():
            total += (weights[:, j] * (own != other[0]))[:, None]
        else:
            total += weights[:, j, None] * (own[:, None] != other[None, :])
    return total


def _nearest_corner(q: np.ndarray, weights: np.ndarray, low: np.ndarray, high: np.ndarray, deviations: list[float]) -> np.ndarray:
    """Least square that a row of a box can have, for pairs of a row and a box."""
    n = len(deviations)
    gap = np.maximum(np.maximum(low[:, :n] - q[:, :n], q[:, :n] - high[:, :n]), 0) / np.array(deviations)
    apart = (q[:, n:] < low[:, n:]) | (q[:, n:] > high[:, n:])
    return (gap * gap).sum(axis=1) + (weights * apart).sum(axis=1)


def _farthest_corner(q: np.ndarray, weights: np.ndarray, low: np.ndarray, high: np.ndarray, deviations: list[float]) -> np.ndarray:
    """Greatest square that a row of a box can have, for pairs of a row and a box."""
    n = len(deviations)
    gap = np.maximum(np.abs(q[:, :n] - low[:, :n]), np.abs(high[:, :n] - q[:, :n])) / np.array(deviations)
    apart = (q[:, n:] != low[:, n:]) | (q[:, n:] != high[:, n:])
    return (gap * gap).sum(axis=1) + (weights * apart).sum(axis=1)


def _tiles(rows: int, width: int) -> Iterator[slice]:
    step = max(1, TILE_CELLS // max(1, width))
    for start in range(0, rows, step):
        yield slice(start, start + step)


def _pivots(points: DataFrame, space: Space, distinct: int) -> np.ndarray:
    """About ``CELL_PIVOTS`` rows for each cell the table should have, about ``MAX_PIVOTS`` at most.

    Which rows are picked only changes the speed, not the distances.
    """
    names = space.numbers + space.categories
    wanted = min(MAX_PIVOTS, CELL_PIVOTS * -(-distinct // CELL_ROWS))
    draw = uniform(1, *[F.col(c) for c in names])
    return _matrix(points.where(draw < wanted / distinct).select(*names).toArrow(), names)


def _numbered(points: DataFrame, queries: DataFrame, space: Space) -> tuple[DataFrame, DataFrame]:
    """Both tables with a number for each different category of a column."""
    for c in space.categories:
        values = points.select(c).union(queries.select(c)).distinct()
        values = materialize(values.withColumn("_code", F.monotonically_increasing_id().cast("double")))
        points, queries = (d.join(values, c).drop(c).withColumnRenamed("_code", c) for d in (points, queries))
    return points, queries


def _blocks(count: Column) -> Column:
    return F.ceil(count / F.lit(BLOCK_ROWS)).cast("int")


def _meet(visits: DataFrame, cells: DataFrame, space: Space, skip_self: bool) -> DataFrame:
    """``(qid, d2)``: the smallest square per visit of a query row to a cell."""
    coords, weights = space.numbers + space.categories, space.weights
    deviations = list(space.deviations.values())
    # one row per cell, of which the sample bounds the number
    sizes = (
        visits.groupBy("cell")
        .agg(_blocks(F.count(F.lit(1))).alias("q_blocks"))
        .join(cells.groupBy("cell").agg(_blocks(F.count(F.lit(1))).alias("r_blocks")), "cell")
    )
    sizes = F.broadcast(materialize(sizes))
    row_hash = F.xxhash64(*coords)

    def span(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = (
        visits.join(sizes, "cell")
        .withColumn("q_block", F.pmod(F.xxhash64("qid"), F.col("q_blocks")).cast("int"))
        .withColumn("r_block", span("r_blocks"))
        .select("qid", *coords, *weights, "cell", "q_block", "r_block")
    )
    right = (
        cells.join(sizes, "cell")
        .withColumn("r_block", F.pmod(row_hash, F.col("r_blocks")).cast("int"))
        .withColumn("q_block", span("q_blocks"))
        .select(*coords, "cell", "q_block", "r_block")
    )

    def nearest(queries: pa.Table, rows: pa.Table) -> pa.Table:
        best = np.empty(queries.num_rows if rows.num_rows else 0)
        q, w, r = _matrix(queries, coords), _matrix(queries, weights), _matrix(rows, coords)
        for tile in _tiles(len(best), len(r)):
            square = _square_distances(q[tile], w[tile], r, deviations)
            if skip_self:
                square[square == 0] = np.inf
            best[tile] = square.min(axis=1)
        return pa.table({"qid": queries.column("qid").slice(0, len(best)), "d2": best})

    keys = ["cell", "q_block", "r_block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(nearest, "qid bigint, d2 double")


def nearest_distances(points: DataFrame, queries: DataFrame, space: Space, skip_self: bool = False) -> DataFrame:
    """``(n, distance)`` per distinct query point to its nearest point.

    Both inputs come from ``encode``. With ``skip_self`` the queries are the
    points themselves and a point is not its own neighbour.
    """
    coords, weights = space.numbers + space.categories, space.weights
    points, queries = _numbered(points, queries, space)
    points = materialize(points.select(*coords))
    distinct = points.count()
    if distinct == 0:
        return queries.select("n", F.lit(None).cast("double").alias("distance"))
    deviations = list(space.deviations.values())
    pivots = _pivots(points, space, distinct)
    halved = _halved(pivots, deviations, distinct / max(1, len(pivots)))
    point_ddl = ", ".join(f"{c} double" for c in coords)
    query_ddl = ", ".join([point_ddl, *[f"{w} int" for w in weights], "qid bigint"]).lstrip(", ")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, _ = halved.home(_matrix(batch, coords))
            yield batch.append_column("cell", pa.array(cell.astype(np.int32)))

    cells = materialize(points.mapInArrow(assign, ", ".join([point_ddl, "cell int"]).lstrip(", ")))
    ends = [end(c).alias(f"{side}_{c}") for c in coords for side, end in (("low", F.min), ("high", F.max))]
    tree = halved.with_boxes(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), *ends).toArrow(), coords)

    numbered = materialize(queries.select(*coords, *weights, "n").withColumn("qid", F.monotonically_increasing_id()))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = 2 if skip_self else 1
        for batch in batches:
            q = _matrix(batch, coords)
            cell, safe = tree.home(q, least)
            bound = _farthest_corner(q, _matrix(batch, weights), tree.low[safe], tree.high[safe], deviations)
            bound[tree.rows[safe] < least] = np.inf
            yield batch.append_column("cell", pa.array(cell.astype(np.int32))).append_column("bound", pa.array(bound))

    first = materialize(numbered.drop("n").mapInArrow(home, f"{query_ddl}, cell int, bound double"))
    at_home = materialize(_meet(first, cells, space, skip_self).groupBy("qid").agg(F.min("d2").alias("d2")))
    bounds = first.join(at_home, "qid").select(*coords, *weights, "qid", "cell", F.least("bound", "d2").alias("bound"))

    def roam(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, w = _matrix(batch, coords), _matrix(batch, weights)
            own = batch.column("cell").to_numpy()
            # a hair of slack for rounding
            bound = batch.column("bound").to_numpy() * (1 + 1e-9) + 1e-12
            for row, node in tree.reached(q, w, bound, deviations):
                away = node != own[row]
                visitors = batch.select([*coords, *weights, "qid"]).take(pa.array(row[away]))
                yield visitors.append_column("cell", pa.array(node[away].astype(np.int32)))

    visits = materialize(bounds.mapInArrow(roam, f"{query_ddl}, cell int"))
    away = _meet(visits, cells, space, skip_self)
    best = at_home.unionByName(away).groupBy("qid").agg(F.min("d2").alias("d2"))
    return numbered.join(best, "qid").select("n", F.sqrt("d2").alias("distance"))


def synthetic_to_real(real: DataFrame, syn: DataFrame, target: str | None, space: Space | None = None) -> DataFrame:
    """Weighted distances from synthetic rows to the nearest real row."""
    space = space or fit_space(real, target)
    return nearest_distances(encode(real, space), encode(syn, space, real), space)


def real_to_real(real: DataFrame, target: str | None, space: Space | None = None) -> DataFrame:
    """Weighted distances from real rows to the nearest other real row."""
    space = space or fit_space(real, target)
    points = materialize(encode(real, space))
    alone = nearest_distances(points, points.where(F.col("n") == 1), space, skip_self=True)
    twins = points.where(F.col("n") > 1).select("n", F.lit(0.0).alias("distance"))
    return alone.unionByName(twins)
