"""Product codes of vectors, fitted by dual-tree Lloyd rounds in whole numbers.

Vectors are cut into parts; each part position has a codebook. For a block of rows and a
position, one tree halves the parts and another the codebook's entries, each node with its
box. Pairs of nodes go down both trees together: an entry's node leaves a parts' node when
it is farther from all of its box than another is from any of it, or when the plane between
two entries leaves the whole box on one side. A parts' node left with one entry is assigned
as a whole, by sums kept for it; leaves that stay uncertain compare their parts one by one.
All arithmetic is on whole numbers, so results don't depend on blocks or tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from twintable.llm.common import keep

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Bytes of the rows whose trees lie together, and parts in a leaf.
BLOCK_BYTES, LEAF = 4 << 20, 16
#: Whole components stay below this, so that sums of squares fit 64 bits.
LARGEST = 1 << 27


def _whole(scale: int):
    """``v``: floor(scale * x) of usable vectors as 32-bit numbers, ``size`` their count."""

    def run(batches):
        for batch in batches:
            at = batch.schema.names.index("v")
            kept, values, sizes = [], [], []
            for i, v in enumerate(batch.column(at).to_pylist()):
                if not v or any(c is None for c in v):
                    continue
                x = np.asarray(v, dtype=np.float64)
                if not np.isfinite(x).all():
                    continue
                whole = np.floor(scale * x)
                if np.abs(whole).max() >= LARGEST:
                    raise ValueError(f"a component times {scale} reaches {LARGEST}")
                kept.append(i), values.append(whole.astype("<i4").tobytes()), sizes.append(len(x))
            if kept:
                rest = batch.select([n for n in batch.schema.names if n != "v"]).take(pa.array(kept))
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(values, pa.binary()), pa.array(sizes, pa.int32())], names=[*rest.schema.names, "v", "size"])

    return run


def _bounds(n: int, level: int) -> np.ndarray:
    """Where the ``2 ** level`` nodes of a level begin, and the end."""
    return (np.arange((1 << level) + 1) * n) >> level


def _boxes(x: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    starts = _bounds(len(x), level)[:-1]
    return np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)


def tree_order(x: np.ndarray, depth: int) -> np.ndarray:
    """Rows of ``x`` in the order of a tree that halves each node along its widest side."""
    order = np.arange(len(x))
    for level in range(depth):
        starts = _bounds(len(x), level)
        low, high = _boxes(x[order], level)
        node = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        widest = (high - low).argmax(axis=1)[node]
        order = order[np.lexsort((x[order, widest], node))]
    return order


def _depth(n: int) -> int:
    """Levels below the root of the tree over ``n`` parts; no node is empty."""
    return max(0, (n // LEAF).bit_length() - 1)


class Entries:
    """The tree over one codebook's entries."""

    def __init__(self, entries: np.ndarray):
        self.depth = max(0, (len(entries) - 1).bit_length())
        self.order = tree_order(entries, self.depth)
        self.entries, self.squares = entries, (entries * entries).sum(axis=1)
        own = entries[self.order]
        self.boxes = [_boxes(own, level) for level in range(self.depth + 1)]
        self.starts = [_bounds(len(entries), level) for level in range(self.depth + 1)]
        self.index = self.order[self.starts[-1][:-1]]  # of the last level's nodes


def _firsts(group: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))


def _without_far(tree: Entries, level: int, low, high, p, e):
    """Pairs of parts' and entries' nodes without those ruled out by another node's distance."""
    elow, ehigh = tree.boxes[level]
    gap = np.maximum(np.maximum(elow[e] - high[p], low[p] - ehigh[e]), 0)
    span = np.maximum(high[p] - elow[e], ehigh[e] - low[p])
    runs = _firsts(p)
    most = np.minimum.reduceat((span * span).sum(axis=1), runs)
    stay = (gap * gap).sum(axis=1) <= np.repeat(most, np.diff(np.append(runs, len(p))))
    return p[stay], e[stay]


def _without_beaten(tree: Entries, low, high, p, e):
    """Pairs with nodes of the last level without entries that another one beats on the whole box."""
    own = tree.index[e]
    c = tree.entries[own]
    off = 2 * c - (low[p] + high[p])
    by = np.lexsort((own, (off * off).sum(axis=1), p))
    p, e, own, c = p[by], e[by], own[by], c[by]
    runs = _firsts(p)
    counts = np.diff(np.append(runs, len(p)))
    best = np.repeat(own[runs], counts)
    away = c - tree.entries[best]
    # The most that the best entry's squared distance exceeds the other's, over the box.
    most = tree.squares[best] - tree.squares[own] + 2 * (away * np.where(away > 0, high[p], low[p])).sum(axis=1)
    stay = (best == own) | (most > 0) | ((most == 0) & (best > own))
    return p[stay], e[stay]


def assign(x: np.ndarray, tree: Entries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of each row of ``x`` (in tree order), and sums and counts by entry.

    Ties go to the lower index. A node assigned as a whole adds its sum, a difference of two
    running sums, without looking at its rows.
    """
    n, k = len(x), len(tree.entries)
    running = np.concatenate([np.zeros((1, x.shape[1]), np.int64), x.cumsum(axis=0)])
    nearest = np.full(n, -1, np.int64)
    sums, counts = np.zeros((k, x.shape[1]), np.int64), np.zeros(k, np.int64)
    p = e = np.zeros(1, np.int64)
    depth, level = _depth(n), 0  # of the parts' tree and of the entries'
    for step in range(max(depth, tree.depth) + 1):
        at = min(step, depth)
        low, high = _boxes(x, at)
        if step and step <= depth:  # each parts' node hands its pairs to both halves
            p, e = np.concatenate([2 * p, 2 * p + 1]), np.concatenate([e, e])
            by = np.argsort(p, kind="stable")
            p, e = p[by], e[by]
        if step and level < tree.depth:
            level += 1
            p, e = np.repeat(p, 2), np.stack([2 * e, 2 * e + 1], axis=1).ravel()
            full = np.diff(tree.starts[level])[e] > 0
            p, e = p[full], e[full]
        if level < tree.depth:
            p, e = _without_far(tree, level, low, high, p, e)
            continue
        if not len(p):
            break
        p, e = _without_beaten(tree, low, high, p, e)
        runs = _firsts(p)
        alone = runs[np.diff(np.append(runs, len(p))) == 1]
        starts = _bounds(n, at)
        begin, end, to = starts[p[alone]], starts[p[alone] + 1], tree.index[e[alone]]
        np.add.at(sums, to, running[end] - running[begin])
        np.add.at(counts, to, end - begin)
        edges = np.zeros(n + 1, np.int64)
        edges[begin] += to + 1
        np.subtract.at(edges, end, to + 1)
        marks = edges.cumsum()[:n]
        nearest = np.where(marks > 0, marks - 1, nearest)
        stay = np.ones(len(p), bool)
        stay[alone] = False
        p, e = p[stay], e[stay]
    if len(p):
        _leaves(x, tree.entries, _bounds(n, depth), p, tree.index[e], nearest, sums, counts)
    return nearest, sums, counts


def _leaves(x, entries, starts, p, e, nearest, sums, counts) -> None:
    """Each part of the uncertain leaves against the entries that its leaf is left with."""
    runs = _firsts(p)
    many = np.diff(np.append(runs, len(p)))
    size = np.diff(starts)[p[runs]]
    rows = np.concatenate([np.arange(starts[q], starts[q + 1]) for q in p[runs]])
    each, first = np.repeat(many, size), np.repeat(runs, size)  # entries of a row's leaf, and where they begin
    begin = np.concatenate([[0], each.cumsum()])
    pair = np.arange(begin[-1]) - np.repeat(begin[:-1] - first, each)
    candidate = e[pair]
    off = x[np.repeat(rows, each)] - entries[candidate]
    far = (off * off).sum(axis=1)
    least = np.minimum.reduceat(far, begin[:-1])
    candidate = np.where(far == np.repeat(least, each), candidate, len(entries))
    found = np.minimum.reduceat(candidate, begin[:-1])
    nearest[rows] = found
    np.add.at(sums, found, x[rows])
    np.add.at(counts, found, 1)


def _trees(parts: int):
    """Blocks of rows with the order of each part's tree."""

    def block(rows: pa.Table) -> pa.RecordBatch:
        n = rows.num_rows
        x = _vectors(rows.column("v").to_pylist(), n, parts)
        orders = np.stack([tree_order(x[:, i].astype(np.int64), _depth(n)) for i in range(parts)])
        ends = pa.array([0, n], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, rows.column(c).combine_chunks()) for c in ("key", "label")]
        return pa.RecordBatch.from_arrays(
            [pa.array([n], pa.int32()), *lists, pa.array([x.tobytes()], pa.binary()), pa.array([orders.astype("<i4").tobytes()], pa.binary())],
            names=["n", "keys", "labels", "vectors", "orders"],
        )

    def run(batches):
        held, space = [], BLOCK_BYTES
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                each = len(batch.column("v")[0].as_py())
                own = batch.slice(start, max(1, space // each))
                held.append(own)
                start, space = start + own.num_rows, space - own.num_rows * each
                if space < each:
                    yield block(pa.Table.from_batches(held))
                    held, space = [], BLOCK_BYTES
        if held:
            yield block(pa.Table.from_batches(held))

    return run


def _vectors(raw: list[bytes], n: int, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype="<i4").reshape(n, parts, -1)


def _each_block(batches, parts: int) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            n = batch.column("n")[i].as_py()
            orders = np.frombuffer(batch.column("orders")[i].as_py(), dtype="<i4").reshape(parts, n)
            yield batch.slice(i, 1), _vectors([batch.column("vectors")[i].as_py()], n, parts), orders


def _round(codebooks: np.ndarray):
    """Sums and counts of the parts by position and entry, added up over a task."""
    parts, k, width = codebooks.shape

    def run(batches):
        sums, counts = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        trees = [Entries(c) for c in codebooks]
        for _, x, orders in _each_block(batches, parts):
            for i in range(parts):
                _, s, c = assign(x[orders[i], i].astype(np.int64), trees[i])
                sums[i] += s
                counts[i] += c
        part, entry = np.nonzero(counts)
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry])]
        yield pa.RecordBatch.from_arrays([*columns, *[pa.array(sums[part, entry, j]) for j in range(width)]], names=["part", "entry", "n", *[f"s{j}" for j in range(width)]])

    return run


def _coded(codebooks: np.ndarray):
    parts, k, _ = codebooks.shape
    hexes = np.array([f"{i:02x}" for i in range(k)])

    def run(batches):
        trees = [Entries(c) for c in codebooks]
        for block, x, orders in _each_block(batches, parts):
            code, error = np.zeros((len(x), parts), np.int64), np.zeros(len(x), np.int64)
            for i in range(parts):
                code[orders[i], i] = assign(x[orders[i], i].astype(np.int64), trees[i])[0]
                off = x[:, i] - codebooks[i][code[:, i]]
                error += (off * off).sum(axis=1)
            text = ["".join(row) for row in hexes[code].tolist()]
            own = [block.column(c).flatten() for c in ("keys", "labels")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(text, pa.string()), pa.array(error)], names=["key", "label", "code", "error"])

    return run


def lloyd(blocks: DataFrame, codebooks: np.ndarray, rounds: int) -> np.ndarray:
    """``codebooks`` after rounds of assigning all parts and flooring the entries' means.

    The driver holds the codebooks only: a sum and a count for each entry come back.
    """
    parts, _, width = codebooks.shape
    names = [f"s{j}" for j in range(width)]
    for _ in range(rounds):
        found = blocks.mapInArrow(_round(codebooks), "part int, entry int, n long, " + ", ".join(f"{s} long" for s in names))
        codebooks = codebooks.copy()
        for r in found.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).collect():
            codebooks[r["part"], r["entry"]] = [r[s] // r["n"] for s in names]
    return codebooks


def vector_codes(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> DataFrame:
    """Columns key, code, error, label_error, codebooks_sha256: one row per usable row of ``df``.

    Components become floor(``scale`` * x); vectors are cut into ``parts`` equal consecutive
    parts. The codebook of a position begins as that part of the ``entries`` smallest keys'
    vectors (null first; rows that share a key by their components' bytes), fewer if there
    are fewer. After ``rounds`` of ``lloyd`` parts are assigned again: ``code`` has the
    entries' indices as two hex digits each, ``error`` the squared distances added up,
    ``label_error`` that sum over rows of an equal label, nulls together.

    Vectors that are null, empty, hold null or non-finite components, or are not as long as
    that of the smallest usable key are dropped; a length that ``parts`` doesn't divide, or
    components of 2^27 after scaling, raise. Rows that repeat are rows of their own; other
    columns are ignored; an empty table gives an empty result.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries: 1 to 256")
    kinds = dict(df.dtypes)
    read = df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("v"))
    rows = keep(read.mapInArrow(_whole(scale), f"key {kinds[key]}, label {kinds[label]}, v binary, size int"))
    first = rows.orderBy("key", "v").select("size").take(1)
    if not first:
        empty = rows.select(F.col("key").alias(key), F.lit("").alias("code"), *[F.lit(0).cast("bigint").alias(c) for c in ("error", "label_error")])
        return empty.withColumn("codebooks_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    size = first[0]["size"]
    if size % parts:
        raise ValueError(f"{parts} parts don't divide {size} components")
    rows = rows.where(F.col("size") == size)
    least = [bytes(r["v"]) for r in rows.orderBy("key", "v").select("v").take(entries)]
    blocks = keep(rows.drop("size").mapInArrow(_trees(parts), f"n int, keys array<{kinds[key]}>, labels array<{kinds[label]}>, vectors binary, orders binary"))
    first_books = np.ascontiguousarray(_vectors(least, len(least), parts).swapaxes(0, 1)).astype(np.int64)
    codebooks = lloyd(blocks, first_books, rounds)
    sha = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    coded = keep(blocks.mapInArrow(_coded(codebooks), f"key {kinds[key]}, label {kinds[label]}, code string, error long"))
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, coded["label"].eqNullSafe(by_label["of"])).select(
        F.col("key").alias(key), "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256")
    )
