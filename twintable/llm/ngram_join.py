"""Near duplicates: texts whose five-word shingle sets have a Jaccard similarity of 0.8 or more.

1. Texts with equal shingle sets are one set; each set gets a sketch of MinHash values.
2. Sets that agree in a band of values meet in tiles of bounded size. Their sketches are
   compared a few values at a time; a pair is dropped once the posterior probability that it
   reaches the threshold is below a tolerance (Bayesian pruning). Of the pairs left in a tile
   only a spanning forest is written, never the pairs.
3. Components of those forests are groups in which all links lie. Texts of a group meet
   again in tiles, are pruned in the same way, and what is left is verified exactly.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from twintable.llm.common import fixed, forest, keep, mix, slices, whole_groups
from twintable.llm.components import components

WORDS = 5
#: Similarity as a fraction, so that the exact check is one of whole numbers.
THRESHOLD = (4, 5)
BANDS, BAND = 20, 4
VALUES = BANDS * BAND
#: Values compared before each look at the posterior, which prunes below ``TOLERANCE``.
STEP, TOLERANCE = 16, 1e-6
#: Sets in a block; a tile compares two blocks.
BLOCK, TEXT_BLOCK = 512, 256

_rng = np.random.Generator(np.random.PCG64(20))
_A = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD = np.array([chr(c).isalnum() or c >= 128 for c in range(256)])


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def shingles(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted hashes of the different runs of five words of each text.

    Words are runs of ASCII letters, digits and other characters beyond ASCII, in lower
    case. A text of fewer than five words is one shingle, one without words has none.
    """
    raws = [(t or "").lower().encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    data = np.frombuffer(b"".join(raws), dtype=np.uint8)
    word = _WORD[data]
    edge = np.flatnonzero(np.diff(word.astype(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return [np.zeros(0, np.uint64) for _ in texts]
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)))])
        words = mix((total[end] - total[start]) * _powers(_BACK, len(data))[start] + (end - start).astype(np.uint64))
        ends = np.cumsum([len(r) for r in raws])
        of = np.searchsorted(ends, start, side="right")
        runs = np.zeros(max(len(words) - WORDS + 1, 0), dtype=np.uint64)
        for i in range(WORDS):
            runs = mix(runs + words[i : i + len(runs)])
        inside = of[: len(runs)] == of[WORDS - 1 :] if len(runs) else np.zeros(0, bool)
        runs, run_of = runs[inside], of[: len(inside)][inside]
        first, last = np.searchsorted(run_of, np.arange(len(texts))), np.searchsorted(run_of, np.arange(len(texts)), side="right")
        w0, w1 = np.searchsorted(of, np.arange(len(texts))), np.searchsorted(of, np.arange(len(texts)), side="right")
        out = []
        for i in range(len(texts)):
            if last[i] > first[i]:
                out.append(np.unique(runs[first[i] : last[i]]))
            elif w1[i] > w0[i]:
                x = np.zeros(1, dtype=np.uint64)
                for w in words[w0[i] : w1[i]]:
                    x = mix(x + w)
                out.append(mix(x + np.uint64(w1[i] - w0[i])))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def sketch(found: np.ndarray) -> np.ndarray:
    """The low 16 bits of each MinHash value."""
    out = np.full(VALUES, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(found), 2048):
            x = found[i : i + 2048, None] * _A + _B
            np.minimum(out, x.min(axis=0), out=out)
    return (mix(out) & np.uint64(0xFFFF)).astype(np.uint16)


def _least(values: int) -> int:
    """The fewest matches among ``values`` at which the threshold is still likely enough.

    With a flat prior the posterior of the similarity after m matches in n is Beta(m + 1,
    n - m + 1); its mass above t is the chance of at most m successes in n + 1 draws.
    """
    t, total = THRESHOLD[0] / THRESHOLD[1], 0.0
    for m in range(values + 1):
        total += comb(values + 1, m) * t**m * (1 - t) ** (values + 1 - m)
        if total >= TOLERANCE:
            return m
    return values


LEAST = {n: _least(n) for n in range(STEP, VALUES + 1, STEP)}


def pruned(own: np.ndarray, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sketches that survive: of ``own`` with itself, each once, or with ``other``."""
    rows, columns = [], []
    right = own if other is None else other
    if not len(own) or not len(right):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, len(own), 128):
        left = own[at : at + 128]
        same = (left[:, None, :STEP] == right[None, :, :STEP]).sum(axis=2, dtype=np.uint8)
        i, j = np.nonzero(same >= LEAST[STEP])
        if other is None:
            up = j > i + at
            i, j = i[up], j[up]
        n = same[i, j].astype(np.int32)
        for k in range(STEP, VALUES, STEP):
            n += (left[i, k : k + STEP] == right[j, k : k + STEP]).sum(axis=1)
            ok = n >= LEAST[k + STEP]
            i, j, n = i[ok], j[ok], n[ok]
        rows.append(i + at)
        columns.append(j)
    return np.concatenate(rows), np.concatenate(columns)


def _sketches(batches):
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            digest, values, size = [], [], []
            for s in shingles(part.column(part.schema.names.index("text")).to_pylist()):
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                values.append(sketch(s).tobytes() if len(s) else None)
                size.append(len(s))
            kept = [i for i, n in enumerate(part.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(i) for i in kept], pa.array(digest, pa.binary()), pa.array(values, pa.binary()), pa.array(size, pa.int32())],
                names=[*[part.schema.names[i] for i in kept], "digest", "sketch", "size"],
            )


def _tiles(df: DataFrame, count: str, spread: str, block: int) -> DataFrame:
    """Rows of a group of ``count`` members dealt to tiles of at most two blocks: tile, side."""
    k = F.ceil(F.col(count) / F.lit(block)).cast("int")
    b = F.pmod(F.xxhash64(spread), F.col("blocks")).cast("int")
    dealt = df.withColumn("blocks", k).withColumn("block", b)
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "*",
        F.least("block", "other").alias("tile_a"),
        F.greatest("block", "other").alias("tile_b"),
        (F.col("block") > F.col("other")).alias("side"),
    )


def _halves(side: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray | None]:
    return (np.arange(len(side)), None) if same else (np.flatnonzero(~side), np.flatnonzero(side))


def _candidate_edges(whole: pa.Table, starts: np.ndarray):
    """A spanning forest of the pairs that survive in each tile: a, b."""
    digest, sketches = fixed(whole.column("digest")), fixed(whole.column("sketch")).view(np.uint16)
    side = whole.column("side").to_numpy()
    same = whole.column("tile_a").to_numpy() == whole.column("tile_b").to_numpy()
    a, b = [], []
    for s, e in zip(starts[:-1], starts[1:], strict=True):
        if e - s < 2:
            continue
        left, right = _halves(side[s:e], same[s])
        i, j = pruned(sketches[s:e][left], None if right is None else sketches[s:e][right])
        if not len(i):
            continue
        root = forest(e - s, left[i], left[j] if right is None else right[j])
        moved = np.flatnonzero(root != np.arange(e - s))
        a.append(s + moved)
        b.append(s + root[moved])
    if a:
        a, b = np.concatenate(a), np.concatenate(b)
        yield pa.table({"a": [digest[x].tobytes() for x in a], "b": [digest[x].tobytes() for x in b]}, schema=pa.schema([("a", pa.binary()), ("b", pa.binary())]))


def _links(found: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs reach the threshold, by the sizes of their sets' intersections."""
    sizes = np.array([len(f) for f in found])
    if len(i) <= 2 * len(found):
        both = np.array([len(np.intersect1d(found[x], found[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], dtype=np.int64)
    else:
        names, place = np.unique(np.concatenate(found), return_inverse=True)
        of = np.repeat(np.arange(len(found)), sizes)
        grid = np.zeros((len(found), len(found)), dtype=np.float32)
        order = np.argsort(place, kind="stable")
        place, of = place[order], of[order]
        for start in range(0, len(names), 4096):
            lo, hi = np.searchsorted(place, [start, start + 4096])
            part = np.zeros((len(found), min(4096, len(names) - start)), dtype=np.float32)
            part[of[lo:hi], place[lo:hi] - start] = 1
            grid += part @ part.T
        both = np.rint(grid[i, j]).astype(np.int64)
    return both * THRESHOLD[1] >= (sizes[i] + sizes[j] - both) * THRESHOLD[0]


def _verified(whole: pa.Table, starts: np.ndarray):
    """Of each set of a tile: copies linked to it, and the smallest set that links connect it to here."""
    digest, sketches = whole.column("digest").to_pylist(), fixed(whole.column("sketch")).view(np.uint16)
    texts, side, copies = whole.column("text"), whole.column("side").to_numpy(), whole.column("copies").to_numpy()
    same = whole.column("tile_a").to_numpy() == whole.column("tile_b").to_numpy()
    for s, e in zip(starts[:-1], starts[1:], strict=True):
        rows = {}
        found = []
        for x in range(s, e):  # a repeated row stands for the same set
            if digest[x] not in rows:
                rows[digest[x]] = x
        at = np.array(sorted(rows.values(), key=lambda x: digest[x]))
        if len(at) < 2:
            continue
        left, right = _halves(side[at], same[s])
        i, j = pruned(sketches[at[left]], None if right is None else sketches[at[right]])
        i, j = left[i], left[j] if right is None else right[j]
        if not len(i):
            continue
        used = np.unique(np.concatenate([i, j]))
        found = shingles([texts[int(x)].as_py() for x in at[used]])
        i, j = np.searchsorted(used, i), np.searchsorted(used, j)
        ok = _links(found, i, j)
        i, j = i[ok], j[ok]
        n = copies[at[used]]
        links = np.bincount(i, weights=n[j], minlength=len(used)) + np.bincount(j, weights=n[i], minlength=len(used))
        root = forest(len(used), i, j)
        hit = np.flatnonzero(links)
        if len(hit):
            yield pa.table(
                {
                    "digest": pa.array([digest[at[used[x]]] for x in hit], pa.binary()),
                    "links": pa.array(links[hit].astype(np.int64)),
                    "root": pa.array([digest[at[used[root[x]]]] for x in hit], pa.binary()),
                }
            )


def _classes(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows as (key, sum, digest), and of each shingle set: root, links, copies, least key."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    read = rows.withColumn("sum", F.xxhash64("text"))
    kind = dict(df.dtypes)[key]
    rows = keep(read.mapInArrow(_sketches, f"key {kind}, sum long, digest binary, sketch binary, size int"))
    sets = keep(
        rows.where("digest is not null").groupBy("digest").agg(
            F.count("*").alias("copies"), F.min(F.struct("key", "sum")).alias("least"), F.first("sketch").alias("sketch")
        )
    )
    bands = sets.select("digest", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.substring("sketch", b * (2 * BAND) + 1, F.lit(2 * BAND)).alias("part")))).alias("x"))
    bands = bands.select("digest", F.xxhash64("x.band", "x.part").alias("bucket"))
    # Written down, so that the join is one of two scans, whose hot buckets Spark can split.
    shared = keep(bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    met = bands.join(shared, "bucket").join(sets.select("digest", "sketch"), "digest")
    tiles = _tiles(met, "n", "digest", BLOCK).select("bucket", "tile_a", "tile_b", "side", "digest", "sketch")
    groups = components(keep(whole_groups(tiles, ["bucket", "tile_a", "tile_b"], _candidate_edges, "a binary, b binary").distinct()))
    sized = groups.join(groups.groupBy("root").agg(F.count("*").alias("n")), "root")
    wanted = sized.join(sets, sized["vertex"] == sets["digest"]).select("root", "n", "digest", "sketch", "copies", "least.key", "least.sum")
    w = wanted.alias("w")
    texts = read.alias("d").join(w, F.col("d.key").eqNullSafe(F.col("w.key")) & F.col("d.sum").eqNullSafe(F.col("w.sum")))
    tiles = _tiles(texts.select("w.root", "w.n", "w.digest", "w.sketch", "w.copies", "d.text"), "n", "digest", TEXT_BLOCK)
    tiles = tiles.select("root", "tile_a", "tile_b", "side", "digest", "sketch", "copies", "text")
    linked = keep(whole_groups(tiles, ["root", "tile_a", "tile_b"], _verified, "digest binary, links long, root binary", 1024))
    roots = components(linked.select(F.col("digest").alias("a"), F.col("root").alias("b")))
    links = linked.groupBy("digest").agg(F.sum("links").alias("links"))
    known = sets.select("digest", "copies", "least").join(links, "digest", "left").join(roots, F.col("digest") == F.col("vertex"), "left")
    known = keep(known.select("digest", "copies", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "digest").alias("root")))
    least = known.groupBy("root").agg(F.min("least").alias("class"))
    return rows.select("key", "sum", "digest"), known.join(least, "root").select("digest", "copies", "links", "class")


def ngram_jaccard(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of ``df``: key, class_id, n_links.

    Rows are linked if their shingle sets have a similarity of 0.8 or more; ``n_links``
    counts other rows, those with an equal set included, and ``class_id`` is the smallest
    key that links lead to (a null key counts as smallest). Texts without words, null ones
    among them, link with nothing and are their own class. Repeated rows count as rows;
    other columns are ignored; an empty table gives an empty result. Pairs at the threshold
    are missed with a probability below 1 in 30,000 (no band in common), others less.
    """
    rows, known = _classes(df, key, text)
    out = rows.join(known, "digest", "left")
    return out.select(
        F.col("key").alias(key),
        F.when(F.col("copies").isNull(), F.col("key")).otherwise(F.col("class.key")).alias("class_id"),
        F.when(F.col("copies").isNull(), F.lit(0)).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"),
    )


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The row with the smallest key of each class, with all columns of ``df``; rows without words all stay.

    Of rows that repeat key and text one stays.
    """
    rows, known = _classes(df, key, text)
    k, x = "__key", "__sum"
    times = rows.groupBy(F.col("key").alias(k), F.col("sum").alias(x)).agg(F.count("*").alias("times"), F.first("digest").alias("digest"))
    best = known.select(F.col("class.key").alias(k), F.col("class.sum").alias(x)).distinct()
    first = times.join(best, times[k].eqNullSafe(best[k]) & times[x].eqNullSafe(best[x]), "left_semi")
    stay = keep(times.where("digest is null").unionByName(first).select(k, x, "times"))

    def among(some: DataFrame, how: str) -> DataFrame:
        d, s = df.alias("d"), some.alias("s")
        return d.join(s, F.col(f"d.`{key}`").eqNullSafe(F.col(f"s.{k}")) & F.xxhash64(F.col(f"d.`{text}`")).eqNullSafe(F.col(f"s.{x}")), how)

    again = stay.where("times > 1")
    if again.isEmpty():
        return among(stay, "left_semi")
    one = among(again, "inner").dropDuplicates([k, x]).select(*[F.col(f"d.`{c}`") for c in df.columns])
    return among(stay.where("times = 1"), "left_semi").union(one)
