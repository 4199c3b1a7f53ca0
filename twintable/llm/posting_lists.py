"""Nearest neighbours by inner product, from balanced posting lists.

A bounded sample is halved again and again into lists of equal size; every vector goes into
the list of its nearest centroid, and near a boundary into others too. A query walks a graph
of the centroids to the nearest one and on to all that are at most ``ratio`` times as far, and
meets the vectors of these lists in tiles of bounded size. The largest inner product becomes
the smallest distance by one more coordinate, which fills vectors up to the longest one's norm.
"""

from __future__ import annotations

import hashlib
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from twintable.llm.common import keep, whole_groups

#: Different vectors for each list, and sampled ones for each list at least.
LIST_ROWS, SAMPLED_ROWS = 512, 16
#: Bytes (as doubles) of the sample that centroids, ``ratio`` and boundaries are fitted on;
#: a quarter of it goes to the tasks that choose lists.
SAMPLE_BYTES = 16 << 20
#: A vector within this ratio of its nearest centroid's distance lies in that list too, in the nearest few.
BOUNDARY, REPLICAS = 1.05, 2
#: Share of the sample's nearest neighbours whose list must be among those searched.
COVERED = 0.97
#: Links of a centroid, and queries that walk the graph together.
LINKS, TOGETHER = 16, 256
#: Lists that a query meets in one place; the halving makes neighbours of them.
GROUP = 8
#: Vectors and queries of a tile.
BLOCK = 4096


def _usable(batches):
    """``digest`` and ``raw`` (doubles, without negative zeros) of vectors that are whole, finite and not zero."""
    for batch in batches:
        at = batch.schema.names.index("v")
        column = batch.column(at)
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # nulls are NaN here
        kept, raw, digest = [], [], []
        for i, (end, size) in enumerate(zip(sizes.cumsum(), sizes, strict=True)):
            x = flat[end - size : end]
            if size and np.isfinite(x).all() and x.any():
                kept.append(i)
                raw.append(x.tobytes())
                digest.append(hashlib.blake2b(raw[-1], digest_size=16).digest())
        rest = batch.select([n for n in batch.schema.names if n != "v"]).take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(digest, pa.binary()), pa.array(raw, pa.binary())], names=[*rest.schema.names, "digest", "raw"])


def _matrix(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype=np.float64).reshape(len(raw), -1)


class Lists(NamedTuple):
    """Fitted centroids with one coordinate more than the vectors, and what chooses among them."""

    centroids: np.ndarray
    links: np.ndarray
    seeds: np.ndarray
    unit: float  # the largest component; vectors are divided by it
    longest: float  # the largest norm after that
    ratio: float
    sample: np.ndarray  # vectors of the sample, for bounds on scores
    sample_lists: np.ndarray

    def stored(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the coordinate that gives them all the longest one's norm."""
        x = x / self.unit
        more = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1), 0))
        return np.concatenate([x, more[:, None]], axis=1)

    def asked(self, x: np.ndarray) -> np.ndarray:
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x * (self.longest / np.linalg.norm(x, axis=1, keepdims=True))
        return np.concatenate([x, np.zeros((len(x), 1))], axis=1)

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and their lists: the nearest, and further ones within ``BOUNDARY``."""
        far = _apart(self.stored(x), self.centroids)
        few = min(REPLICAS, far.shape[1])
        near = np.argsort(far, axis=1, kind="stable")[:, :few]
        far = np.take_along_axis(far, near, axis=1)
        row, turn = np.nonzero(far <= BOUNDARY * far[:, :1])
        return row, near[row, turn]

    def chosen(self, x: np.ndarray) -> np.ndarray:
        """Which lists each query searches: a walk over the graph of centroids.

        The walk begins at a few seeds. Each round looks at the links of all centroids seen that
        are within ``ratio`` of the nearest seen so far, until none is left: first it nears the
        nearest one, then spreads around it.
        """
        q = self.asked(x)
        far = np.full((len(q), len(self.centroids)), np.inf)
        far[:, self.seeds] = _apart(q, self.centroids[self.seeds])
        walked = np.zeros(far.shape, bool)
        while True:
            row, at = np.nonzero((far <= self.ratio * far.min(axis=1, keepdims=True)) & ~walked)
            if not len(row):
                return walked & (far <= self.ratio * far.min(axis=1, keepdims=True))
            walked[row, at] = True
            new = np.zeros(far.shape, bool)
            new[np.repeat(row, self.links.shape[1]), self.links[at].ravel()] = True
            row, at = np.nonzero(new & np.isinf(far))
            off = q[row] - self.centroids[at]
            far[row, at] = np.sqrt((off * off).sum(axis=1))


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    squared = (x * x).sum(axis=1)[:, None] - 2 * x @ y.T + (y * y).sum(axis=1)
    return np.sqrt(np.maximum(squared, 0))


def _halved(x: np.ndarray, at: np.ndarray, parts: int) -> list[np.ndarray]:
    """``at`` cut into ``parts`` of equal size, at a plane between two means each time."""
    if parts == 1:
        return [at]
    y = x[at]
    a = y[_apart(y, y[:1])[:, 0].argmax()]
    b = y[_apart(y, a[None])[:, 0].argmax()]
    left = parts // 2
    cut = len(at) * left // parts
    for _ in range(6):
        order = np.argsort(y @ (b - a), kind="stable")
        a, b = y[order[:cut]].mean(axis=0), y[order[cut:]].mean(axis=0)
    return _halved(x, at[order[:cut]], left) + _halved(x, at[order[cut:]], parts - left)


def fit(sample: np.ndarray, lists: int, unit: float, longest: float, neighbours: int) -> Lists:
    """Centroids, their graph and ``ratio`` from a sample (in an order that says nothing of the vectors)."""
    own = Lists(np.zeros((1, sample.shape[1] + 1)), np.zeros((1, 1), int), np.zeros(1, int), unit, longest, 1.0, sample[:0], np.zeros(0, int))
    x = own.stored(sample)
    centroids = np.array([x[p].mean(axis=0) for p in _halved(x, np.arange(len(x)), lists)])
    links = np.argsort(_apart(centroids, centroids), axis=1, kind="stable")[:, : LINKS + 1]
    # Neighbours in the order of the halving too, so that every centroid can be reached.
    beside = (np.arange(lists)[:, None] + np.array([1, lists - 1])) % lists
    own = own._replace(centroids=centroids, links=np.concatenate([links, beside], axis=1), seeds=np.arange(0, lists, ceil(lists**0.5)))
    row, at = zip(*[own.places(sample[s : s + 1024]) for s in range(0, len(sample), 1024)], strict=True)
    row, at = np.concatenate([r + 1024 * i for i, r in enumerate(row)]), np.concatenate(at)
    # How much farther than the nearest centroid a list of each neighbour is, for some queries.
    needed = []
    held = np.full((len(sample), REPLICAS), -1)
    held[row, np.concatenate([np.arange(c) for c in np.bincount(row)])] = at
    for s in range(0, min(len(sample), 512), 64):
        scores = sample[s : s + 64] @ sample.T
        scores[np.arange(len(scores)), s + np.arange(len(scores))] = -np.inf
        best = np.argsort(-scores, axis=1, kind="stable")[:, : min(neighbours, len(sample) - 1)]
        far = _apart(own.asked(sample[s : s + 64]), centroids)
        of = held[best]
        least = np.where(of >= 0, np.take_along_axis(far[:, None, :], np.maximum(of, 0), axis=2), np.inf).min(axis=2)
        needed.append((least / np.maximum(far.min(axis=1, keepdims=True), 1e-300)).ravel())
    needed = np.concatenate(needed)
    ratio = float(np.quantile(needed, COVERED)) if len(needed) else 1.0
    few = max(1, len(sample) // 4)
    first = np.full(len(sample), -1)
    first[row[::-1]] = at[::-1]
    return own._replace(ratio=max(ratio, 1.0) + 1e-9, sample=sample[:few], sample_lists=first[:few])


def _by_group(batch: pa.RecordBatch, held: np.ndarray) -> pa.RecordBatch:
    """A row for each group of lists that a row of ``batch`` has, ``mask`` with a bit for each list of the group."""
    n, lists = held.shape
    bits = np.zeros((n, -(-lists // GROUP) * GROUP), np.int64)
    bits[:, :lists] = held
    masks = (bits.reshape(n, -1, GROUP) << np.arange(GROUP)).sum(axis=2)
    row, at = np.nonzero(masks)
    out = batch.take(pa.array(row))
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(masks[row, at].astype(np.int32)), *out.columns], names=["group", "mask", *out.schema.names])


def _placed(lists: Lists):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            row, at = lists.places(_matrix(batch.column("raw").to_pylist()))
            held = np.zeros((batch.num_rows, len(lists.centroids)), bool)
            held[row, at] = True
            yield _by_group(batch, held)

    return run


def _filled(lists: Lists, x: np.ndarray, chosen: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """``chosen`` with the nearest further lists where those hold fewer than ``k`` different vectors."""
    enough = k * REPLICAS  # a vector lies in so many lists at most
    few = np.flatnonzero(chosen @ sizes < enough)
    if len(few):
        near = np.argsort(_apart(lists.asked(x[few]), lists.centroids), axis=1, kind="stable")
        before = sizes[near].cumsum(axis=1) - sizes[near]
        more = np.zeros((len(few), len(sizes)), bool)
        np.put_along_axis(more, near, before < enough, axis=1)
        chosen[few] |= more
    return chosen


def _routed(lists: Lists, sizes: np.ndarray, k: int):
    """A row for each group of lists that a query searches, with a score that its ``k`` best reach there."""

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, TOGETHER):
                own = batch.slice(s, TOGETHER)
                x = _matrix(own.column("raw").to_pylist())
                chosen = _filled(lists, x, lists.chosen(x), sizes, k)
                floor = np.full(len(x), -np.inf)
                if len(lists.sample) >= k:
                    scores = np.where(chosen[:, lists.sample_lists], x @ lists.sample.T, -np.inf)
                    floor = np.partition(scores, -k, axis=1)[:, -k]
                names = [*own.schema.names, "floor"]
                yield _by_group(pa.RecordBatch.from_arrays([*own.columns, pa.array(floor)], names=names), chosen)

    return run


def scores_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products row by row, added up from the first component to the last."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total = total + x[:, j] * y[:, j]
    return total


def _tiles(k: int):
    """Of each tile, the ``k`` best of each query that reach its floor."""

    def run(whole: pa.Table, starts: np.ndarray):
        raw, side = whole.column("raw").combine_chunks(), whole.column("side").to_numpy()
        floor, mask = whole.column("floor").to_numpy(), whole.column("mask").to_numpy()
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            q, v = s + np.flatnonzero(side[s:e]), s + np.flatnonzero(~side[s:e])
            if not len(q) or not len(v):
                continue
            x, y = (_matrix(raw.take(pa.array(i)).to_pylist()) for i in (q, v))
            length = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1).max()
            for t in range(0, len(q), TOGETHER):
                product = x[t : t + TOGETHER] @ y.T
                product[(mask[q[t : t + TOGETHER]][:, None] & mask[v]) == 0] = -np.inf  # no list of both
                least = floor[q[t : t + TOGETHER]]
                if len(v) > k:
                    least = np.maximum(least, np.partition(product, -k, axis=1)[:, -k])
                # Products differ in their last digits from scores, which are added up in order.
                i, j = np.nonzero((product >= (least - 1e-9 * length[t : t + TOGETHER])[:, None]) & np.isfinite(product))
                score = scores_of(x[t + i], y[j])
                yield pa.table(
                    {
                        "query": whole.column("digest").take(pa.array(q[t + i])),
                        "found": whole.column("digest").take(pa.array(v[j])),
                        "score": pa.array(score),
                        "ids": whole.column("ids").take(pa.array(v[j])),
                    }
                )

    return run


class Index(NamedTuple):
    """Lists, their postings ``group, mask, digest, raw, ids`` and numbers, and the bytes of a vector."""

    lists: Lists | None
    postings: DataFrame | None
    sizes: np.ndarray | None
    width: int


def _rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    read = df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(vector).alias("v"))
    return read.mapInArrow(_usable, "key bigint, digest binary, raw binary")


def build(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20) -> Index:
    """Posting lists over all rows of ``df`` for searches of up to ``k`` neighbours.

    Equal vectors are one posting with their ``k`` + 1 smallest keys, which suffice for any
    search, so a vector that a third of the rows share is one row. Centroids are fitted on at
    most ``SAMPLE_BYTES`` of vectors, the first by a hash of their content.
    """
    rows = _rows(df, key, vector)
    sizes = rows.groupBy(F.octet_length("raw").alias("size")).agg(F.count("*").alias("n"), F.approx_count_distinct("digest", 0.02).alias("sets"))
    most = sizes.orderBy(F.desc("n"), "size").take(1)
    if not most:
        return Index(None, None, None, 0)
    size, sets = most[0]["size"], most[0]["sets"]
    rows = rows.where(F.octet_length("raw") == size)
    norms = rows.mapInArrow(_lengths, "unit double, norm double").select(F.max("unit").alias("unit"), F.max(F.struct("unit", "norm")).alias("top"), F.max(F.col("unit") * F.col("norm")).alias("norm")).first()
    unit = norms["unit"]
    longest = norms["norm"] / unit if np.isfinite(norms["norm"]) else norms["top"]["norm"]
    room = max(1, SAMPLE_BYTES // size)
    share = min(1.0, 2 * room / sets)  # by content, so that copies don't fill the sample
    spot = F.xxhash64("digest")
    sampled = rows.where(F.pmod(spot, F.lit(1 << 30)) < int(share * (1 << 30)) + 1).dropDuplicates(["digest"]).orderBy(spot, "digest").limit(room)
    sample = _matrix([bytes(r[0]) for r in sampled.select("raw").collect()])
    lists = fit(sample, max(1, min(sets // LIST_ROWS, len(sample) // SAMPLED_ROWS)), unit, longest, k)
    few = Window.partitionBy("digest").orderBy("key")
    distinct = rows.groupBy("digest", "key").agg(F.first("raw").alias("raw")).withColumn("turn", F.row_number().over(few)).where(F.col("turn") <= k + 1)
    folded = distinct.groupBy("digest").agg(F.first("raw").alias("raw"), F.sort_array(F.collect_list("key")).alias("ids"))
    postings = keep(folded.mapInArrow(_placed(lists), "group int, mask int, digest binary, raw binary, ids array<bigint>"))
    held = np.zeros(-(-len(lists.centroids) // GROUP) * GROUP, np.int64)
    in_list = [F.sum(F.shiftright("mask", b).bitwiseAND(1)).alias(f"n{b}") for b in range(GROUP)]
    for r in postings.groupBy("group").agg(*in_list).collect():  # a row per group, bounded by the sample
        held[r["group"] * GROUP : (r["group"] + 1) * GROUP] = [r[f"n{b}"] for b in range(GROUP)]
    return Index(lists, postings, held[: len(lists.centroids)], size)


def _lengths(batches):
    """Largest component, and largest norm in units of it, of a batch."""
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("raw").to_pylist())
            unit = np.abs(x).max()
            yield pa.RecordBatch.from_arrays([pa.array([unit]), pa.array([np.linalg.norm(x / unit, axis=1).max()])], names=["unit", "norm"])


def search(index: Index, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20) -> DataFrame:
    """Columns query_id, rank, vec_id, score: the ``k`` nearest found of each row of ``queries``.

    Equal queries are searched for once. ``score`` is the inner product, added up in doubles
    in the order of the components; ties go to the smaller key. Rows with the query's own key
    are left out.
    """
    if index.lists is None:
        return queries.limit(0).select(F.col(key).cast("bigint").alias("query_id"), F.lit(1).alias("rank"), F.col(key).cast("bigint").alias("vec_id"), F.lit(0.0).alias("score"))
    asked = keep(_rows(queries, key, vector).where(F.octet_length("raw") == index.width))
    once = asked.groupBy("digest").agg(F.first("raw").alias("raw"))
    routed = keep(once.mapInArrow(_routed(index.lists, index.sizes, k + 1), "group int, mask int, digest binary, raw binary, floor double"))
    blocks = index.postings.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("v_blocks")).join(
        routed.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("q_blocks")), "group"
    )

    def dealt(df: DataFrame, mine: str, other: str) -> DataFrame:
        own = F.pmod(F.xxhash64("digest"), F.col(mine)).cast("int").alias(mine[0])
        df = df.join(F.broadcast(blocks), "group")  # a row per group, bounded by the sample
        return df.select("*", own, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other[0]))

    columns = ["group", "v", "q", "digest", "raw", "mask"]
    stored = dealt(index.postings, "v_blocks", "q_blocks").select(*columns, "ids", F.lit(0.0).alias("floor"), F.lit(False).alias("side"))
    wanted = dealt(routed, "q_blocks", "v_blocks").select(*columns, F.lit(None).cast("array<bigint>").alias("ids"), "floor", F.lit(True).alias("side"))
    found = whole_groups(stored.unionByName(wanted), ["group", "v", "q"], _tiles(k + 1), "query binary, found binary, score double, ids array<bigint>")
    # A vector of lists in two groups comes twice; beyond its own vector a query needs no more than k others.
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0], "found")
    best = found.repartition("query").dropDuplicates(["query", "found"]).withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= k + 1)
    ahead = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("under"), i.alias("id")))
    near = best.groupBy("query").agg(F.slice(F.sort_array(F.flatten(F.collect_list(ahead))), 1, k + 1).alias("near"))
    joined = asked.select("key", "digest").distinct().join(near, F.col("digest") == F.col("query"))
    others = F.slice(F.filter("near", lambda n: n["id"] != F.col("key")), 1, k)
    return joined.select(F.col("key").alias("query_id"), F.posexplode(others).alias("at", "n")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.id").alias("vec_id"), (-F.col("n.under")).alias("score")
    )


def nearest(df: DataFrame, asked: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20) -> DataFrame:
    """``search`` of the rows of ``df`` where ``asked`` holds among all rows of ``df``.

    Vectors that are null, empty, zero, hold null or non-finite components, or are not as long
    as most take no part, nor do rows with a null key. Rows that repeat key and vector are one;
    rows that share a key are not each other's neighbours. Other columns are ignored; a table
    without usable rows gives an empty result.
    """
    return search(build(df, key, vector, k), df.where(asked), key, vector, k)
