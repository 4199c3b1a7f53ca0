"""Samplers that draw a row's columns one after the other, each given a few earlier ones.

Every column becomes a text code: a bin of its quantiles, a frequent value itself, or the
bucket that the digest of a rare value falls into. Networks and conditional tables are made
of codes, whose number is bounded; a rare value is drawn afterwards among the real ones of
its bucket and parents, so columns with any number of values keep their dependence.
"""

from __future__ import annotations

import itertools
import math
import secrets
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from twintable.functions.noise import laplace, uniform, uniform_index
from twintable.operators.counts import numeric_counts, running_totals, value_counts
from twintable.operators.sampler import Sampler, draws, seed_of
from twintable.operators.selection import count_upto, exact_quantiles, numbers_of
from twintable.session import materialize
from twintable.spec import column, feature_types

#: Values of a column that have a code of their own, and buckets of the others.
FREQUENT, BUCKETS = 256, 64
#: Conditional tables up to this many rows go to every executor.
BROADCAST_ROWS = 200_000
SALTS = 32
#: More partitions than there are: where a plan's compiled code ends and nothing moves.
MANY = 1 << 20
#: Rows whose column sets are counted together.
COUNTED_ROWS = 1 << 16
#: Cells whose counts a task keeps in arrays, and counts of other cells that it keeps.
DENSE_CELLS, SPARSE_CELLS = 1 << 22, 1 << 20
#: Code of a null.
NULL = "\u0000"


@dataclass(frozen=True)
class Node:
    name: str
    parents: tuple[str, ...]


@dataclass(frozen=True)
class Coding:
    """How a column becomes a code: by ``edges`` of bins, else by its frequent values and buckets."""

    edges: tuple[float, ...] = ()
    values: tuple[str, ...] = ()
    buckets: int = 0
    nullable: bool = True

    def codes(self) -> list[str]:
        null = [NULL] if self.nullable else []
        if self.edges:
            return [*null, *map(str, range(max(1, len(self.edges) - 1)))]
        return [*null, *[f"={v}" for v in self.values], *[f"#{b}" for b in range(self.buckets)]]

    def code(self, text: Column, number: Column, place: Column) -> Column:
        """A value's code; of numbers ``place`` says how many inner edges they reach."""
        if self.edges:
            return F.when(number.isNull() | F.isnan(number), F.lit(NULL)).otherwise(place.cast("string"))
        rare = F.concat(F.lit("#"), bucket(text, self.buckets).cast("string")) if self.buckets else F.lit(NULL)
        own = F.when(text.isin(list(self.values)), F.concat(F.lit("="), text)) if self.values else F.when(F.lit(False), text)
        return F.when(text.isNull(), F.lit(NULL)).otherwise(F.coalesce(own, rare))


def bucket(text: Column, buckets: int) -> Column:
    """Which of ``buckets`` the digest of a text falls into."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % buckets


def as_text(df: DataFrame, name: str) -> Column:
    """A column's values as the texts that ``value_counts`` has, nested ones as JSON."""
    kind, c = df.schema[name].dataType, column(name)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    if isinstance(kind, T.BinaryType):
        return F.base64(c)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return (c.cast("double") + F.lit(0.0)).cast("string")
    return c.cast("string")


def from_text(text: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.from_json(text, kind)
    if isinstance(kind, T.BinaryType):
        return F.unbase64(text)
    return text.cast(kind)


def set_entropies(coded: DataFrame, codes: dict[str, list[str]], sets: Iterable[tuple[str, ...]]) -> dict[tuple[str, ...], float]:
    """Entropy (bits) of each of the given sets of columns, in one pass over ``coded``.

    ``codes`` lists each column's codes. A task counts the cells of all sets over a run of rows
    at once and adds up the runs, so a set costs a row no row of its own and a task sends a cell
    once; of sets with too many cells for that it sends counts whenever it holds
    ``SPARSE_CELLS`` of them. One number for each set reaches the driver.
    """
    sets = list(sets)
    if not sets:
        return {}
    used = sorted({c for s in sets for c in s})

    sizes = [math.prod(len(codes[c]) for c in s) for s in sets]
    dense, total = set(), 0
    for i in sorted(range(len(sets)), key=sizes.__getitem__):
        total += sizes[i]
        if total > DENSE_CELLS:
            break
        dense.add(i)

    def counted(rows: pa.Table):
        """``(set, cells, counts)`` of a run of rows."""
        index = {c: pc.index_in(rows.column(c), pa.array(codes[c])).to_numpy().astype(np.int64) for c in used}
        for i, s in enumerate(sets):
            cell = index[s[0]]
            for c in s[1:]:
                cell = cell * len(codes[c]) + index[c]
            if sizes[i] <= 4 * len(cell):
                n = np.bincount(cell, minlength=sizes[i])
                at = np.flatnonzero(n)
                yield i, at, n[at]
            else:
                yield (i, *np.unique(cell, return_counts=True))

    def sent(i: int, at: np.ndarray, n: np.ndarray):
        for start in range(0, len(at), COUNTED_ROWS):
            part = slice(start, start + COUNTED_ROWS)
            columns = [np.full(len(at[part]), i, np.int32), at[part].astype(np.int64), n[part].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["set", "cell", "n"])

    def runs(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= COUNTED_ROWS:
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows = [], 0
        if rows:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches):
        whole = {i: np.zeros(sizes[i], np.int64) for i in dense}
        sparse: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        held = 0
        for rows in runs(batches):
            for i, at, n in counted(rows):
                if i in dense:
                    whole[i][at] += n
                else:
                    sparse.setdefault(i, []).append((at, n))
                    held += len(at)
                if held > SPARSE_CELLS:
                    yield from added(sparse)
                    sparse, held = {}, 0
        yield from added(sparse)
        for i, n in whole.items():
            at = np.flatnonzero(n)
            yield from sent(i, at, n[at])

    def added(sparse):
        for i, parts in sparse.items():
            at, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.zeros(len(at), np.int64)
            np.add.at(n, place, np.concatenate([p[1] for p in parts]))
            yield from sent(i, at, n)

    cells = coded.select(*[column(c) for c in used]).mapInArrow(run, "set int, cell bigint, n bigint").groupBy("set", "cell").agg(F.sum("n").alias("n"))
    # H = log N - sum(n log n) / N
    sums = cells.groupBy("set").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log2("n")).alias("s")).collect()
    found = {r["set"]: math.log2(r["all"]) - r["s"] / r["all"] for r in sums}
    return {s: found.get(i, 0.0) for i, s in enumerate(sets)}


def search_network(
    nodes: Sequence[str], degree: int, entropies: Callable[[list[tuple[str, ...]]], dict[tuple[str, ...], float]], pick: Callable[[list[float]], int], first: str
) -> list[Node]:
    """Parents for each node, found one at a time.

    Pairs come first: from ``first`` on, the node joins whose information about a node that has
    joined is largest, which orders the nodes and gives each one parent. A further parent is the
    node before it that adds most to what its parents say, so a pass counts at most two sets
    for each pair of nodes, never all triples. ``pick`` chooses among scores in bits.
    """
    place = {c: i for i, c in enumerate(nodes)}

    def key(*names: str) -> tuple[str, ...]:
        return tuple(sorted(names, key=place.__getitem__))

    h = entropies([(c,) for c in nodes] + ([key(a, b) for a, b in itertools.combinations(nodes, 2)] if degree else []))
    order, parents = [first], {first: ()}
    left = [c for c in nodes if c != first]
    while left:
        if not degree:
            order, parents, left = [*order, *left], parents | {c: () for c in left}, []
            break
        options = [(c, p) for c in left for p in order]
        child, parent = options[pick([h[(c,)] + h[(p,)] - h[key(c, p)] for c, p in options])]
        order.append(child)
        left.remove(child)
        parents[child] = (parent,)
    for size in range(2, degree + 1):
        choices = {c: [p for p in order[:i] if p not in parents[c]] for i, c in enumerate(order) if i >= size}
        wanted = {key(*parents[c], p, *more) for c, ps in choices.items() for p in ps for more in ((), (c,))}
        h |= entropies(sorted(wanted - set(h)))
        for c, ps in choices.items():
            scores = [h[(c,)] + h[key(*parents[c], p)] - h[key(*parents[c], p, c)] for p in ps]
            parents[c] = (*parents[c], ps[pick(scores)])
    return [Node(c, parents[c]) for c in order]


def pair_information(df: DataFrame, bins: int = 20, max_values: int = FREQUENT, buckets: int = BUCKETS) -> DataFrame:
    """``a, b, bits``: what each two columns' codes say about each other, the first in column order as ``a``."""
    coder = BayesNetwork(bins=bins, max_values=max_values, buckets=buckets)
    coder.schema = df.schema
    coded = materialize(coder.code(df))
    pairs = list(itertools.combinations(df.columns, 2))
    h = set_entropies(coded, {c: coder.codings[c].codes() for c in df.columns}, [*[(c,) for c in df.columns], *pairs])
    rows = [(a, b, h[(a,)] + h[(b,)] - h[(a, b)]) for a, b in pairs]
    return df.sparkSession.createDataFrame(rows, "a string, b string, bits double")


class BayesNetwork(Sampler):
    """Columns drawn one after the other, each given up to ``degree`` earlier ones.

    Numbers with more than ``bins`` values are binned at quantiles and drawn evenly within a
    bin. Of other columns the ``max_values`` most frequent values (ties by value) have a code
    each; the others share ``buckets`` codes and are drawn, given bucket and parents, as often as
    the real table has them there. As a parent such a value counts by its bucket. ``structure``
    gives nodes and parents instead of the search.
    """

    def __init__(
        self,
        degree: int = 2,
        bins: int = 20,
        max_values: int = FREQUENT,
        seed: int = 42,
        buckets: int = BUCKETS,
        structure: Sequence[tuple[str, Sequence[str]]] | None = None,
    ):
        self.degree, self.bins, self.max_values, self.seed, self.buckets = degree, bins, max_values, seed, buckets
        self.structure = structure
        self.epsilon: float | None = None

    def _fit(self, real: DataFrame) -> None:
        coded = materialize(self.code(real))
        self.network = self._network(coded) if self.nodes else []
        self.width = max((len(n.parents) for n in self.network), default=0)
        self.tables = self._conditionals(coded) if self.network else {}
        self.within = self._within(coded) if self.wide else None

    def code(self, real: DataFrame) -> DataFrame:
        """Codes of all columns, and as ``_text_<column>`` the values of those that have rare ones."""
        self.nodes = list(real.columns)
        self.codings = self._codings(real)
        self.wide = [c for c in self.nodes if self.codings[c].buckets]
        binned = {c: self.codings[c].edges[1:-1] for c in self.nodes if self.codings[c].edges}
        places = {f"_place_{c}": (numbers_of(edges), column(f"_number_{c}"), len(edges)) for c, edges in binned.items()}
        placed = count_upto(real.withColumns({f"_number_{c}": column(c).cast("double") for c in binned}), places) if binned else real
        cells = []
        for c in self.nodes:
            text = as_text(real, c)
            number, place = (column(f"_number_{c}"), column(f"_place_{c}")) if c in binned else (F.lit(None), F.lit(None))
            cells.append(self.codings[c].code(text, number, place).alias(c))
            if c in self.wide:
                cells.append(text.alias(f"_text_{c}"))
        return placed.select(*cells)

    def _codings(self, real: DataFrame) -> dict[str, Coding]:
        numeric, rest = feature_types(real, None)
        out: dict[str, Coding] = {}
        few: list[str] = []
        if numeric:
            # An estimate far above the bins leaves no doubt; the others are counted.
            near = real.agg(*[F.approx_count_distinct(column(c).cast("double")).alias(f"n{i}") for i, c in enumerate(numeric)]).first()
            doubtful = [c for i, c in enumerate(numeric) if near[f"n{i}"] <= 2 * self.bins + 2]
            sizes = {}
            if doubtful:
                sizes = {r["column"]: r["k"] for r in numeric_counts(real, doubtful).groupBy("column").agg(F.count(F.lit(1)).alias("k")).collect()}
            few = [c for c in doubtful if sizes.get(c, 0) <= self.bins]
            marks = [i / self.bins for i in range(self.bins + 1)]
            for r in exact_quantiles(real, [c for c in numeric if c not in few], marks).collect():
                out[r["column"]] = Coding(edges=tuple(sorted(set(r[2:]))))
        return out | self._valued(real, [*rest, *few])

    def _valued(self, real: DataFrame, columns: list[str]) -> dict[str, Coding]:
        if not columns:
            return {}
        texts = real.select(*[as_text(real, c).alias(c) for c in columns])
        counts = materialize(value_counts(texts).where(F.col("value").isNotNull()))
        sizes = {r["column"]: r["k"] for r in counts.groupBy("column").agg(F.count(F.lit(1)).alias("k")).collect()}
        frequent: dict[str, list[str]] = {c: [] for c in columns}
        by_count = Window.partitionBy("column").orderBy(F.desc("n"), "value")
        top = counts.withColumn("turn", F.row_number().over(by_count)).where(F.col("turn") <= self.max_values)
        for r in top.collect():  # max_values a column at most
            frequent[r["column"]].append(r["value"])
        return {c: Coding(values=tuple(sorted(frequent[c])), buckets=self.buckets if sizes.get(c, 0) > self.max_values else 0) for c in columns}

    def _network(self, coded: DataFrame) -> list[Node]:
        if self.structure is not None:
            return [Node(c, tuple(parents)) for c, parents in self.structure]
        codes = {c: self.codings[c].codes() for c in self.nodes}
        degree = min(self.degree, len(self.nodes) - 1)
        return search_network(self.nodes, degree, lambda sets: set_entropies(coded, codes, sets), lambda s: int(np.argmax(s)), self.nodes[0])

    def _cells(self, nodes: Iterable[tuple[int, Node]], *more: Callable[[Node], Column]) -> Column:
        """``_node, _p0.., _value`` of each node, as rows of an array."""
        cells = []
        for i, node in nodes:
            parents = [(column(node.parents[j]) if j < len(node.parents) else F.lit("")).alias(f"_p{j}") for j in range(self.width)]
            cells.append(F.struct(F.lit(i).alias("_node"), *parents, column(node.name).alias("_value"), *[m(node) for m in more]))
        return F.inline(F.array(*cells))

    def _cell_counts(self, coded: DataFrame) -> DataFrame:
        """``(_node, _p0.., _value, _n)`` of every node, rows fanning out over nodes in one pass."""
        fanned = coded.select(self._cells(enumerate(self.network)))
        return fanned.groupBy(*fanned.columns).agg(F.count(F.lit(1)).cast("double").alias("_n"))

    def _conditionals(self, coded: DataFrame) -> dict[str, tuple[DataFrame, int, int]]:
        """Per node and parent codes: child codes with cumulative shares and counts.

        With each node come the number of its rows and the most codes one of them has.

        A window or list holds the codes of one child, a bounded number.
        """
        keys = ["_node", *[f"_p{j}" for j in range(self.width)]]
        whole = Window.partitionBy(*keys)
        upto = whole.orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        shares = self._cell_counts(coded).select(
            *keys, "_value", (F.sum("_n").over(upto) / F.sum("_n").over(whole)).alias("_upto"), F.col("_n").cast("bigint").alias("_n")
        )
        steps = F.array_sort(F.collect_list(F.struct("_upto", "_value", "_n"))).alias("_steps")
        packed = materialize(shares.groupBy(*keys).agg(steps).withColumn("_uptos", F.col("_steps._upto")))
        sizes = {r["_node"]: (r["k"], r["most"]) for r in packed.groupBy("_node").agg(F.count(F.lit(1)).alias("k"), F.max(F.size("_steps")).alias("most")).collect()}
        return {
            node.name: (
                packed.where(F.col("_node") == i).select(*[f"_p{j}" for j in range(len(node.parents))], F.struct("_steps", "_uptos").alias("_table")),
                *sizes.get(i, (0, 0)),
            )
            for i, node in enumerate(self.network)
        }

    def rare_values(self, coded: DataFrame) -> DataFrame:
        """``_cell, value, n``: how often each rare value occurs with its bucket and parents."""
        wide = [(i, n) for i, n in enumerate(self.network) if n.name in self.wide]
        fanned = coded.select(self._cells(wide, lambda n: column(f"_text_{n.name}").alias("value"))).where(F.col("_value").startswith("#"))
        cell = F.struct("_node", "_value", *[f"_p{j}" for j in range(self.width)]).alias("_cell")
        return fanned.groupBy(cell, "value").agg(F.count(F.lit(1)).alias("n"))

    def _within(self, coded: DataFrame) -> DataFrame:
        """``_cell, _at, _text``: the occurrences of rare values, numbered in their bucket and parents."""
        totals = running_totals(self.rare_values(coded), ["n"], key="_cell")
        places = F.explode(F.sequence(F.col("upto_n") - F.col("n"), F.col("upto_n") - 1)).alias("_at")
        return materialize(totals.select("_cell", places, F.col("value").alias("_text")))

    def _draw(self, rows: DataFrame, i: int, node: Node, seed: int) -> DataFrame:
        table, size, most = self.tables[node.name]
        keys = [f"_p{j}" for j in range(len(node.parents))]
        u = uniform(seed_of(seed, node.name), F.col("_id"))
        table = table.withColumnsRenamed({k: f"_code_{p}" for k, p in zip(keys, node.parents, strict=True)})
        on = [f"_code_{p}" for p in node.parents]
        if not on:
            # a single row without parents becomes a value of the plan
            joined = rows.withColumn("_table", table.select("_table").scalar())
        elif size <= BROADCAST_ROWS:
            joined = rows.join(F.broadcast(table), on, "left")
        else:
            # a parent value may hold a third of the rows
            salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            joined = rows.withColumn("_salt", F.pmod("_id", F.lit(SALTS)).cast("int")).join(salted, [*on, "_salt"], "left").drop("_salt")
        # the first code whose share goes beyond u, the last one where rounding leaves none
        placed = count_upto(joined.withColumn("_u", u), {"_place": (F.col("_table._uptos"), F.col("_u"), most)})
        drawn = placed.withColumn("_step", F.get("_table._steps", F.least("_place", F.size("_table._steps") - 1)))
        more = [F.col("_step._value").alias(f"_code_{node.name}")]
        if node.name in self.wide:
            parents = [(F.col(f"_code_{node.parents[j]}") if j < len(node.parents) else F.lit("")).alias(f"_p{j}") for j in range(self.width)]
            cell = F.struct(F.lit(i).alias("_node"), F.col("_step._value").alias("_value"), *parents)
            # Rows whose code is a value find nothing; their numbers spread them over tasks.
            at = F.when(F.col("_step._value").startswith("#"), uniform_index(F.col("_step._n"), seed_of(seed + 2, node.name), F.col("_id"))).otherwise(-1 - F.col("_id"))
            more += [cell.alias("_cell"), at.alias("_at")]
        # Without a stop after each node, all of them become one method, too long for the JVM to compile.
        drawn = drawn.select(*rows.columns, *more).coalesce(MANY)
        if node.name not in self.wide:
            return drawn
        found = self.within.where(F.col("_cell._node") == i)
        return drawn.join(found.hint("merge"), ["_cell", "_at"], "left").withColumnRenamed("_text", f"_text_{node.name}").drop("_cell", "_at")

    def _decode(self, name: str, seed: int) -> Column:
        edges, kind = self.codings[name].edges, self.schema[name].dataType
        code = F.nullif(F.col(f"_code_{name}"), F.lit(NULL))
        if not edges:
            own = F.when(code.startswith("="), F.substr(code, F.lit(2)))
            text = F.coalesce(own, F.col(f"_text_{name}")) if name in self.wide else own
            return from_text(text, kind).alias(name)
        marks = F.array(*[F.lit(float(e)) for e in edges])
        at = code.cast("int")
        lo = F.get(marks, at)
        hi = F.coalesce(F.get(marks, at + 1), lo)
        if isinstance(kind, T.IntegralType):
            # Whole numbers of a bin alike: it ends below the next edge, the last one with it.
            hi = F.when(at >= len(edges) - 2, hi + 1).otherwise(F.greatest(hi, lo + 1))
        return (lo + uniform(seed_of(seed + 1, name), F.col("_id")) * (hi - lo)).alias(name)

    def _generate(self, count: int, seed: int) -> DataFrame:
        rows = draws(SparkSession.active(), count)
        for i, node in enumerate(self.network):
            rows = self._draw(rows, i, node, seed)
        return rows.select("_id", *[self._decode(n.name, seed) for n in self.network])


@dataclass
class Ledger:
    """What of a budget of epsilon and delta has been spent on what."""

    epsilon: float
    delta: float
    entries: list[tuple[str, str, float, float]] = field(default_factory=list)

    def spend(self, what: str, mechanism: str, epsilon: float, delta: float = 0.0) -> float:
        if self.spent() + epsilon > self.epsilon * (1 + 1e-9) or self.spent_delta() + delta > self.delta * (1 + 1e-9):
            raise ValueError(f"{what}: the budget is spent")
        self.entries.append((what, mechanism, epsilon, delta))
        return epsilon

    def spent(self) -> float:
        return sum(e[2] for e in self.entries)

    def spent_delta(self) -> float:
        return sum(e[3] for e in self.entries)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.entries, "what string, mechanism string, epsilon double, delta double")


#: The range tree over numbers: children of a node and levels below the root.
TREE_FAN, TREE_LEVELS = 32, 6
_REACH = 1025.0  # log2 of the largest double, and a little more


def number_key(x: Column) -> Column:
    """A number's cell in the last level of the range tree: finer near zero, of equal ratios far from it."""
    place = F.signum(x) * F.log2(F.abs(x) + 1)
    return F.floor((place + _REACH) / (2 * _REACH) * float(TREE_FAN**TREE_LEVELS)).cast("bigint")


def key_number(key: float) -> float:
    """The number at which a cell of the range tree begins."""
    place = key / TREE_FAN**TREE_LEVELS * 2 * _REACH - _REACH
    size = 2 ** min(abs(place), 1023.99) - 1
    return math.copysign(size, place)


def private_edges(df: DataFrame, columns: Sequence[str], bins: int, epsilon: float, rng: np.random.Generator) -> dict[str, tuple[float, ...]]:
    """Bin edges at noisy quantiles, ``epsilon`` for each column, over a public range of all doubles.

    All marks of a column go down one tree together: on each level the nodes they have reached
    split into 32, and the noisy counts of these tell each mark where to go; a row is in one of
    them, so a level costs its share of epsilon once, however many marks there are. Cells
    without rows get noise too. Counts come from one table of cells; on a level a driver
    sees 32 numbers for each node reached.
    """
    cells = df.select(*[number_key(column(c).cast("double")).alias(c) for c in columns])
    counts = materialize(numeric_counts_of_keys(cells, columns))
    scale = 2 * TREE_LEVELS / epsilon
    hidden = scale * math.log(TREE_FAN * (bins + 1) * TREE_LEVELS)
    marks = {c: [(0, None)] * (bins + 1) for c in columns}  # node, and where in its counts
    for level in range(TREE_LEVELS):
        below = TREE_FAN ** (TREE_LEVELS - level - 1)
        reached = {c: sorted({node for node, _ in marks[c]}) for c in columns}
        node, child = F.floor(F.col("value") / (below * TREE_FAN)).cast("bigint"), F.floor(F.col("value") / below).cast("bigint")
        wanted = F.lit(False)
        for c in columns:
            wanted = wanted | ((F.col("column") == c) & node.isin(reached[c]))
        seen = {(r["column"], r["child"]): r["n"] for r in counts.where(wanted).groupBy("column", child.alias("child")).agg(F.sum("n").alias("n")).collect()}
        for c in columns:
            noisy = {
                at: np.array([seen.get((c, at * TREE_FAN + i), 0) for i in range(TREE_FAN)]) + rng.laplace(0, scale, TREE_FAN) for at in reached[c]
            }
            moved = []
            for i, (at, share) in enumerate(marks[c]):
                # Counts that noise alone could reach are none; where all are, the node is even inside.
                held = np.where(noisy[at] > hidden, noisy[at], 0.0)
                upto = (held if held.any() else np.ones(TREE_FAN)).cumsum()
                rank = upto[-1] * (i / bins if share is None else share)
                step = min(int(np.searchsorted(upto, rank, side="right")), int(np.searchsorted(upto, upto[-1])))
                start = upto[step - 1] if step else 0.0
                moved.append((at * TREE_FAN + step, (rank - start) / (upto[step] - start)))
            marks[c] = moved
    out = {}
    for c in columns:
        edges = sorted({key_number(node) for node, _ in marks[c]})
        # The last mark's cell ends beyond its rows.
        last = key_number(max(node for node, _ in marks[c]) + 1)
        out[c] = tuple([*edges, last])
    return out


def numeric_counts_of_keys(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, n)`` over whole numbers."""
    long = cells.unpivot([], list(columns), "column", "value").where(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


class PrivateBayesNetwork(BayesNetwork):
    """The network under differential privacy (Zhang et al., PrivBayes, TODS 2017).

    The schema and the number of rows are public; two tables are neighbours if one row differs.
    Everything else that is read is paid for, and ``ledger`` says how: the choice of parents
    (exponential mechanism) and the cell counts (Laplace) get half of ``epsilon`` each. What
    values there are is a question of ``public``. If it is true, the values, nulls and bin edges
    of the table are taken as public knowledge, which the ledger lists at no cost, and a column of
    more than ``max_values`` values needs a domain. If it is false, nothing is: values come from
    a histogram whose noisy counts must pass a threshold (which takes ``delta``), bin edges of
    numbers from noisy counts of a range tree, each with 10 % of ``epsilon`` before the rest
    is halved; at most ``max_values`` values a column are kept, those with the largest noisy counts.

    ``domains`` (values by column) and ``bounds`` (least and largest number by column) are public
    in both cases. Values outside a column's values become null, numbers beyond the bounds or the
    edges fall into the first or last bin; nulls stay nulls. No column is drawn from real rows.
    Noise has a secret seed unless a test gives one.
    """

    def __init__(
        self,
        epsilon: float = 1.0,
        degree: int = 2,
        bins: int = 10,
        max_values: int = 32,
        seed: int | None = None,
        domains: dict[str, Sequence[str]] | None = None,
        bounds: dict[str, tuple[float, float]] | None = None,
        delta: float = 1e-6,
        public: bool = True,
    ):
        super().__init__(degree, bins, max_values, secrets.randbits(60) if seed is None else seed)
        self.epsilon, self.delta, self.public = epsilon, delta, public
        self.domains = {c: tuple(sorted(map(str, v))) for c, v in (domains or {}).items()}
        self.bounds = dict(bounds or {})

    def fit(self, real: DataFrame) -> Sampler:
        self.schema = real.schema
        self.rng = np.random.default_rng(self.seed)
        self.ledger = Ledger(self.epsilon, self.delta)
        self.rows = real.count()
        self._fit(real)
        return self

    def _codings(self, real: DataFrame) -> dict[str, Coding]:
        numeric, rest = feature_types(real, None)
        out = {c: Coding(values=v) for c, v in self.domains.items() if c in real.columns}
        for c, (lo, hi) in self.bounds.items():
            out.setdefault(c, Coding(edges=tuple(lo + (hi - lo) * i / self.bins for i in range(self.bins + 1))))
        unknown, loose = [c for c in rest if c not in out], [c for c in numeric if c not in out]
        if self.public:
            return out | self._public_codings(real.select(*[column(c) for c in [*unknown, *loose]]))
        if unknown:
            each, delta = self.epsilon * 0.1 / len(unknown), self.delta / len(unknown)
            for c in unknown:
                self.ledger.spend(f"values of {c}", "thresholded histogram", each, delta)
            out |= self._noisy_values(real, unknown, each, delta)
        if loose:
            each = self.epsilon * 0.1 / len(loose)
            for c in loose:
                self.ledger.spend(f"edges of {c}", "laplace", each)
            out |= {c: Coding(edges=e) for c, e in private_edges(real, loose, self.bins, each, self.rng).items()}
        return out

    def _public_codings(self, real: DataFrame) -> dict[str, Coding]:
        if not real.columns:
            return {}
        found = super()._codings(real)
        wide = [c for c in real.columns if found[c].buckets]
        if wide:
            raise ValueError(f"{', '.join(wide)}: more than {self.max_values} values; give public domains or drop these columns")
        holes = real.select(*[F.max(as_text(real, c).isNull() | (as_text(real, c) == "NaN")).alias(c) for c in real.columns]).first()
        for c in real.columns:
            self.ledger.spend(f"values of {c}", "taken as public", 0.0)
        return {c: replace(found[c], nullable=bool(holes[c])) for c in real.columns}

    def _noisy_values(self, real: DataFrame, columns: list[str], epsilon: float, delta: float) -> dict[str, Coding]:
        texts = real.select(*[as_text(real, c).alias(c) for c in columns])
        counts = value_counts(texts).where(F.col("value").isNotNull())
        noisy = F.col("n") + laplace(2 / epsilon, self.seed, F.col("column"), F.col("value"))
        # A value that one row has passes with a probability of half of delta; neighbours may have one each.
        passed = counts.withColumn("n", noisy).where(F.col("n") > 1 + 2 * math.log(1 / delta) / epsilon)
        by_count = Window.partitionBy("column").orderBy(F.desc("n"), "value")
        values: dict[str, list[str]] = {c: [] for c in columns}
        for r in passed.withColumn("turn", F.row_number().over(by_count)).where(F.col("turn") <= self.max_values).collect():
            values[r["column"]].append(r["value"])
        return {c: Coding(values=tuple(sorted(v))) for c, v in values.items()}

    def _network(self, coded: DataFrame) -> list[Node]:
        rest = self.epsilon - self.ledger.spent()
        degree = min(self.degree, len(self.nodes) - 1)
        picks = sum(max(0, len(self.nodes) - k) for k in range(1, degree + 1))
        if picks:
            each = self.ledger.spend("parents", "exponential", rest / 2) / picks
        n = max(2, self.rows)
        sensitivity = 2 / n * math.log2((n + 1) / 2) + (n - 1) / n * math.log2((n + 1) / (n - 1))

        def pick(scores: list[float]) -> int:
            power = each * np.array(scores) / (2 * sensitivity)
            chance = np.exp(power - power.max())
            return int(self.rng.choice(len(scores), p=chance / chance.sum()))

        codes = {c: self.codings[c].codes() for c in self.nodes}
        first = self.nodes[int(self.rng.integers(len(self.nodes)))]
        return search_network(self.nodes, degree, lambda sets: set_entropies(coded, codes, sets), pick, first)

    def _cell_counts(self, coded: DataFrame) -> DataFrame:
        """Noisy counts over every possible cell, empty ones included."""
        spark = coded.sparkSession
        parts = []
        for i, node in enumerate(self.network):
            columns = [*node.parents, node.name]
            places = [f"_p{j}" for j in range(len(node.parents))] + ["_value"]
            step, picks = 1, {f"_p{j}": F.lit("") for j in range(self.width)}
            for c, place in zip(columns, places, strict=True):
                codes = sorted(self.codings[c].codes())
                at = F.pmod(F.floor(F.col("id") / step), F.lit(len(codes))).cast("int")
                picks[place] = F.get(F.array(*[F.lit(v) for v in codes]), at)
                step *= len(codes)
            parts.append(spark.range(step).select(F.lit(i).alias("_node"), *[v.alias(k) for k, v in picks.items()]))
        cells = parts[0]
        for part in parts[1:]:
            cells = cells.unionByName(part)
        budget = self.ledger.spend("cell counts", "laplace", self.epsilon - self.ledger.spent())
        noise = laplace(2 * len(self.nodes) / budget, self.seed + 1, *[F.col(c) for c in cells.columns])
        noisy = F.greatest(F.coalesce("_n", F.lit(0.0)) + noise, F.lit(0.0))
        # all cells at zero would leave nothing to draw from
        joined = cells.join(super()._cell_counts(coded), cells.columns, "left")
        return joined.select(*cells.columns, (noisy + F.lit(1e-9)).alias("_n"))
