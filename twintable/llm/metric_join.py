"""Near-duplicate vectors by an exact metric range join.

Unit vectors of cosine c lie sqrt(2 - 2c) apart. Pivots cut the vectors of a label into
cells; a vector also visits each cell whose border is near enough that a partner may lie
beyond it. Each cell then finds its pairs alone, by tiles of bounded size.
"""

from __future__ import annotations

import hashlib
from math import sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from twintable.llm.common import fixed, forest, keep, whole_groups
from twintable.llm.components import components

#: Vectors of a label for each of its pivots, and the most pivots of a label.
PER_PIVOT, MOST_PIVOTS = 4096, 64
#: Pivots of all labels that one broadcast holds; labels beyond have one cell each, cut into tiles.
ALL_PIVOTS = 4096
BLOCK = 2048
#: Room for rounding in distances.
SLACK = 1e-6


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        scale = np.abs(x).max(axis=1, keepdims=True)
        x = x / np.where(scale > 0, scale, 1)
        return x / np.linalg.norm(x, axis=1, keepdims=True)


def _encode(batches):
    """Bytes of usable vectors as doubles, null for others."""
    for batch in batches:
        at = batch.schema.names.index("v")
        values = []
        for v in batch.column(at).to_pylist():
            ok = v and all(c is not None for c in v)
            x = np.array(v, dtype=np.float64) if ok else None
            values.append(x.tobytes() if ok and np.isfinite(x).all() and x.any() else None)
        digest = [None if v is None else hashlib.blake2b(v, digest_size=16).digest() for v in values]
        names = [*[n for n in batch.schema.names if n != "v"], "raw", "digest"]
        yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i != at], pa.array(values, pa.binary()), pa.array(digest, pa.binary())], names=names)


def _cells(pivots: dict[int, list[bytes]], radius: float):
    """Own cell of each vector (visit false) and lower-numbered cells that it visits."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            label, raw = batch.column(names.index("label")).to_pylist(), batch.column(names.index("raw"))
            rows, cell, visit = [], [], []
            groups: dict[tuple, list[int]] = {}
            sizes = pc.binary_length(raw).to_pylist()
            for i, key in enumerate(zip(label, sizes, strict=True)):
                groups.setdefault(key, []).append(i)
            for (of, size), at in groups.items():
                own = [p for p in pivots.get(of, []) if len(p) == size]
                at = np.array(at)
                if not own:
                    rows.append(at), cell.append(np.zeros(len(at), int)), visit.append(np.zeros(len(at), bool))
                    continue
                x = unit(np.frombuffer(b"".join(raw.take(pa.array(at)).to_pylist()), dtype=np.float64).reshape(len(at), -1))
                p = unit(np.frombuffer(b"".join(own), dtype=np.float64).reshape(len(own), -1))
                squared = np.maximum(2 - 2 * x @ p.T, 0)
                home = squared.argmin(axis=1)
                apart = np.sqrt(np.maximum(2 - 2 * p @ p.T, 0))[home]
                least = squared[np.arange(len(at)), home][:, None]
                # How far x is from the plane between its pivot and another; where pivots
                # coincide, the triangle inequality alone.
                plane = (squared - least) / np.maximum(2 * apart, 1e-9)
                ring = (np.sqrt(squared) - np.sqrt(least)) / 2
                near = np.where(apart > 1e-6, plane, ring) <= radius + SLACK
                near &= np.arange(len(own))[None, :] < home[:, None]
                i, j = np.nonzero(near)
                rows += [at, at[i]]
                cell += [home, j]
                visit += [np.zeros(len(at), bool), np.ones(len(i), bool)]
            if rows:
                out = batch.take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(cell).astype(np.int32)), pa.array(np.concatenate(visit))], names=[*names, "cell", "visit"])

    return run


def _pairs(least: float):
    def run(whole: pa.Table, starts: np.ndarray):
        digest, raw = fixed(whole.column("digest")), whole.column("raw").combine_chunks()
        copies, visit, side = (whole.column(c).to_numpy() for c in ("copies", "visit", "side"))
        same = whole.column("tile_a").to_numpy() == whole.column("tile_b").to_numpy()
        sizes = pc.binary_length(raw).to_numpy()
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            for size in np.unique(sizes[s:e]):
                at = s + np.flatnonzero(sizes[s:e] == size)
                if len(at) < 2:
                    continue
                x = unit(np.frombuffer(b"".join(raw.take(pa.array(at)).to_pylist()), dtype=np.float64).reshape(len(at), -1))
                halves = (np.arange(len(at)), np.arange(len(at))) if same[s] else (np.flatnonzero(~side[at]), np.flatnonzero(side[at]))
                rows, columns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for k in range(0, len(halves[0]), 256):
                    i, j = np.nonzero(x[halves[0][k : k + 256]] @ x[halves[1]].T >= least)
                    i, j = halves[0][i + k], halves[1][j]
                    ok = ~(visit[at[i]] & visit[at[j]])  # two visitors meet elsewhere
                    if same[s]:
                        ok &= i < j
                    rows.append(i[ok])
                    columns.append(j[ok])
                i, j = np.concatenate(rows), np.concatenate(columns)
                if not len(i):
                    continue
                n = copies[at]
                links = np.bincount(i, weights=n[j], minlength=len(at)) + np.bincount(j, weights=n[i], minlength=len(at))
                root, hit = forest(len(at), i, j), np.flatnonzero(links)
                yield pa.table(
                    {
                        "digest": pa.array([digest[at[h]].tobytes() for h in hit], pa.binary()),
                        "links": pa.array(links[hit].astype(np.int64)),
                        "root": pa.array([digest[at[root[h]]].tobytes() for h in hit], pa.binary()),
                    }
                )

    return run


def metric_join(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98) -> DataFrame:
    """A row per row of ``df``: key, n_links, component_id, kept.

    Rows are linked if their labels are equal and the cosine of their vectors, in doubles, is
    ``cosine`` or more; vectors of other lengths aren't compared. ``component_id`` is the
    smallest key that links lead to, ``kept`` marks the row that has it. Rows with a null
    label, and vectors that are null, empty, zero or hold null or non-finite components,
    link with nothing. Equal vectors of a label are compared once and counted as often as
    they occur. A null key is smaller than others; rows that repeat a key are rows of their
    own; other columns are ignored; an empty table gives an empty result.
    """
    spark = df.sparkSession
    kind = dict(df.dtypes)
    read = df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("v"))
    rows = keep(read.mapInArrow(_encode, f"key {kind[key]}, label {kind[label]}, raw binary, digest binary").withColumn(
        "digest", F.when(F.col("label").isNotNull(), F.unhex(F.md5(F.concat("digest", F.col("label").cast("string").cast("binary")))))
    ))
    sets = keep(rows.where("digest is not null").groupBy("digest").agg(
        F.count("*").alias("copies"), F.min("key").alias("least"), F.first("label").alias("label"), F.first("raw").alias("raw")
    ))
    sizes = sets.groupBy("label").agg(F.count("*").alias("n"))
    wanted = sizes.select("label", F.least(F.ceil(F.col("n") / PER_PIVOT), F.lit(MOST_PIVOTS)).cast("int").alias("pivots"), "n").where("pivots > 1")
    wanted = wanted.orderBy(F.desc("n"), "label").limit(ALL_PIVOTS // MOST_PIVOTS).collect()
    pivots: dict = {}
    for r in wanted:  # the first by a hash, a few from each of a bounded number of labels
        own = sets.where(F.col("label") == F.lit(r["label"])).orderBy(F.xxhash64("digest"), "digest").limit(r["pivots"]).select("raw")
        pivots[r["label"]] = [bytes(x[0]) for x in own.collect()]
    placed = sets.mapInArrow(_cells(pivots, sqrt(2 - 2 * cosine)), sets.withColumns({"cell": F.lit(0), "visit": F.lit(False)}).schema)
    placed = keep(placed)
    counts = keep(placed.groupBy("label", "cell").agg(F.count("*").alias("n")))
    dealt = placed.join(counts, ["label", "cell"]).withColumns(
        {"blocks": F.ceil(F.col("n") / BLOCK).cast("int"), "other": F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / BLOCK).cast("int") - 1))}
    )
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("digest"), "blocks").cast("int")).select(
        "label", "cell", F.least("block", "other").alias("tile_a"), F.greatest("block", "other").alias("tile_b"),
        (F.col("block") > F.col("other")).alias("side"), "digest", "raw", "copies", "visit",
    )
    linked = keep(whole_groups(dealt, ["label", "cell", "tile_a", "tile_b"], _pairs(cosine), "digest binary, links long, root binary"))
    roots = components(linked.select(F.col("digest").alias("a"), F.col("root").alias("b")))
    known = sets.join(linked.groupBy("digest").agg(F.sum("links").alias("links")), "digest", "left").join(roots, F.col("digest") == F.col("vertex"), "left")
    known = keep(known.select("digest", "copies", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "digest").alias("root")))
    first = known.groupBy("root").agg(F.min("least").alias("component"))
    known = known.join(first, "root").select("digest", "copies", "links", "component")
    out = rows.select("key", "digest").join(known, "digest", "left")
    alone = F.col("copies").isNull()
    return out.select(
        F.col("key").alias(key),
        F.when(alone, F.lit(0)).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"),
        F.when(alone, F.col("key")).otherwise(F.col("component")).alias("component_id"),
        (alone | F.col("key").eqNullSafe(F.col("component"))).alias("kept"),
    )
