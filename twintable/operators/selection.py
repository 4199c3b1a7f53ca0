"""Exact order statistics by refinement: no sort and no shuffle of values.

Each pass counts, for every range that still holds a wanted rank, how many values fall into
each of its cells, with the cell's least and largest value. The cell with the rank is the next
range, until it is one value or holds few enough to list. What is shuffled are counts of cells,
a bounded number for each wanted rank, whatever the table's size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from twintable.operators.counts import quantile_name
from twintable.spec import column

#: Cells of a range, and values that a range may hold to be listed.
CELLS, LISTED = 1024, 4096


@dataclass
class _Range:
    """Values of a column from ``low`` to ``high``, ``below`` of the column before them."""

    name: str
    low: float
    high: float
    below: int
    n: int
    ranks: list[int]


def _number(name: str) -> Column:
    """A column as a double without negative zero and without NaN."""
    x = column(name).cast("double")
    return F.when(~F.isnan(x), x + F.lit(0.0))


def count_upto(df: DataFrame, wanted: dict[str, tuple[Column, Column, int]]) -> DataFrame:
    """Add a column for each name: how many numbers of a sorted array are at most a given one.

    ``wanted`` has the array, the number, and how many numbers an array has at most. Each step
    halves what is left in a projection of its own, so that expressions stay short whatever the
    array's length; a long ``CASE`` is not compiled.
    """
    out = df.withColumns({name: F.lit(0) for name in wanted})
    for level in reversed(range(max((most.bit_length() for _, _, most in wanted.values()), default=0))):
        step = 1 << level
        moved = {}
        for name, (numbers, x, most) in wanted.items():
            if most >= step:
                at = F.col(f"`{name}`")
                moved[name] = at + F.when(F.get(numbers, at + (step - 1)) <= x, F.lit(step)).otherwise(F.lit(0))
        out = out.withColumns(moved)
    return out


def numbers_of(values: Sequence[float]) -> Column:
    """Doubles as a constant array."""
    return F.array(*[F.lit(float(v)) for v in values]) if values else F.array().cast("array<double>")


def _cell(x: Column, low: Column, width: Column, even: bool) -> Column:
    """Cells 1 to ``CELLS`` over the finite part of a range, by distance or by its logarithm; infinite values around.

    Half of each value is taken, so that the width of any range is finite; ``low`` and ``width`` are
    halves too. Both scales rise with x and put the ends of a range into different cells.
    """
    share = F.when(width > 0, (x / 2 - low) / width).otherwise(F.lit(0.0))
    if not even:  # octaves above the lower end
        share = F.log2(share * float(2**60) + 1) / math.log2(2**60 + 1)
    place = F.least(F.floor(share * CELLS), F.lit(CELLS - 1)) + 1
    infinite = float("inf")
    return F.when(x == -infinite, F.lit(0)).when(x == infinite, F.lit(CELLS + 1)).otherwise(place).cast("bigint")


def _counted(df: DataFrame, ranges: list[_Range], place, weight: str | None) -> DataFrame:
    """Values in any of ``ranges`` by range and ``place`` of them."""
    by_name: dict[str, list[tuple[int, _Range]]] = {}
    for i, r in sorted(enumerate(ranges), key=lambda r: r[1].low):  # ranges of a column don't overlap
        by_name.setdefault(r.name, []).append((i, r))
    tables: dict[str, list[Column]] = {k: [] for k in ("ids", "lows", "highs", "starts", "widths")}
    for own in by_name.values():
        ends = [(max(r.low, -1.7976931348623157e308) / 2, min(r.high, 1.7976931348623157e308) / 2) for _, r in own]
        tables["ids"].append(F.array(*[F.lit(i) for i, _ in own]))
        tables["lows"].append(numbers_of([r.low for _, r in own]))
        tables["highs"].append(numbers_of([r.high for _, r in own]))
        tables["starts"].append(numbers_of([low for low, _ in ends]))
        tables["widths"].append(numbers_of([high - low for low, high in ends]))
    own = {k: F.get(F.array(*v), F.col("at")) for k, v in tables.items()}
    more = [F.col(weight).alias("w")] if weight else []
    long = df.select(F.posexplode(F.array(*[_number(c) for c in by_name])).alias("at", "x"), *more).where("x is not null")
    found = count_upto(long, {"upto": (own["lows"], F.col("x"), max(len(r) for r in by_name.values()))})
    held = found.select("x", *(["w"] if weight else []), *[F.get(v, F.col("upto") - 1).alias(k) for k, v in own.items()]).where(F.col("x") <= F.col("highs"))
    n = F.col("w") if weight else F.lit(1)
    placed = place(F.col("x"), F.col("starts"), F.col("widths")).alias("place")
    return held.groupBy(F.col("ids").alias("range"), placed).agg(F.sum(n).cast("bigint").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))


def select_ranks(df: DataFrame, whole: dict[str, _Range], weight: str | None = None) -> dict[tuple[str, int], float]:
    """The value of each rank (from 0) that the ranges of whole columns ask for."""
    out: dict[tuple[str, int], float] = {}
    open_ = list(whole.values())
    even = True

    def narrowed(ranges: list[_Range], counted: DataFrame) -> list[_Range]:
        cells: dict[int, list] = {}
        for c in counted.collect():
            cells.setdefault(c["range"], []).append(c)
        found = []
        for i, r in enumerate(ranges):
            below = r.below
            for c in sorted(cells[i], key=lambda c: c["low"]):
                ranks = [k for k in r.ranks if below <= k < below + c["n"]]
                if ranks:
                    found.append(_Range(r.name, c["low"], c["high"], below, c["n"], ranks))
                below += c["n"]
        return found

    while open_:
        for r in open_:
            if r.low == r.high:
                out |= {(r.name, k): r.low for k in r.ranks}
        open_ = [r for r in open_ if r.low != r.high]
        # Ends that halving makes one leave two values to list, however often they occur.
        large = [r for r in open_ if r.n > LISTED and r.high / 2 > r.low / 2]
        if not large:
            break
        small = [r for r in open_ if r not in large]
        open_ = small + narrowed(large, _counted(df, large, lambda x, low, width, even=even: _cell(x, low, width, even), weight))
        even = not even
    if open_:  # each value is a cell of its own now
        for r in narrowed(open_, _counted(df, open_, lambda x, low, width: x, weight)):
            out |= {(r.name, k): r.low for k in r.ranks}
    return out


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], weight: str | None = None) -> DataFrame:
    """``column, n`` and a column for each of ``probs``: interpolated quantiles of columns that hold numbers.

    A row counts ``weight`` times, a whole number of 1 or more. Nulls and NaN aren't counted. The
    driver sees counts of at most 1,024 cells, or 4,096 values, for each wanted rank.
    """
    columns = list(columns)
    facts = []
    for i, c in enumerate(columns):
        x = _number(c)
        size = F.sum(F.when(x.isNotNull(), F.col(weight))) if weight else F.count(x)
        facts += [size.alias(f"n{i}"), F.min(x).alias(f"low{i}"), F.max(x).alias(f"high{i}")]
    names = [quantile_name(p) for p in probs]
    schema = "column string, n bigint, " + ", ".join(f"{n} double" for n in names)
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    seen = df.agg(*facts).first()
    whole = {}
    for i, c in enumerate(columns):
        n = int(seen[f"n{i}"] or 0)
        if n:
            ranks = sorted({f(p * (n - 1)) for p in probs for f in (math.floor, math.ceil)})
            whole[c] = _Range(c, seen[f"low{i}"], seen[f"high{i}"], 0, n, ranks)
    found = select_ranks(df, whole, weight)
    rows = []
    for c, r in whole.items():
        row: list = [c, r.n]
        for p in probs:
            at = p * (r.n - 1)
            low, high = found[c, math.floor(at)], found[c, math.ceil(at)]
            row.append(low if low == high else low + (high - low) * (at - math.floor(at)))
        rows.append(tuple(row))
    return df.sparkSession.createDataFrame(rows, schema)
