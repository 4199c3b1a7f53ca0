"""Shards by a weighted hash tree of regions, racks and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from twintable.llm.common import keep, utf8

#: A tree as regions of racks of shard weights.
Tree = list[list[list[float]]]


def tree(shards: int, racks: int = 3, per_rack: int = 4) -> Tree:
    """Shards of weight 1 filled rack by rack, region by region."""
    out: Tree = []
    for i in range(shards):
        if i % (racks * per_rack) == 0:
            out.append([])
        if i % per_rack == 0:
            out[-1].append([])
        out[-1][-1].append(1.0)
    return out


def _draw(key: Column, shard: int, weight: float) -> Column:
    """An exponential variable of rate ``weight`` from 53 bits of a hash."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 53))) / F.lit(weight)


def tree_shard(key: Column, nodes: Tree) -> Column:
    """The shard that a key descends to; shares follow the weights.

    A subtree draws the least of its shards' exponential draws, which is exponential with
    the subtree's weight; the key takes the region, then the rack, then the shard with the
    least draw. As a shard's draw depends on nothing but key, shard and weight, draws of
    subtrees without a changed weight stay, and a shard that is added or made heavier takes
    keys from others and moves none between them. Shards of weight 0 get nothing. A null
    key is a key like others. Shards count from 0, in the order of the tree.
    """
    if not any(w > 0 for region in nodes for rack in region for w in rack):
        raise ValueError("no shard has a weight")

    def least(found: list) -> Column:
        return F.array_min(F.array(*found))

    regions, shard = [], 0
    for region in nodes:
        racks = []
        for rack in region:
            leaves = []
            for weight in rack:
                if weight > 0:
                    leaves.append(F.struct(_draw(key, shard, weight).alias("draw"), F.lit(shard).alias("shard")))
                shard += 1
            if leaves:
                racks.append(least(leaves))
        if racks:
            regions.append(least(racks))
    return least(regions)["shard"]


def hash_tree_shards(df: DataFrame, key: str, text: str, shards: int, cell_rows: int = 100_000) -> DataFrame:
    """Columns ``key``, size, text_crc32, law, shard, slot, grown_shard: one row per row of ``df``.

    ``slot`` numbers a shard's rows from 0 without a gap. Rows of a shard fall into cells by
    a hash of key and text, about ``cell_rows`` in each; cells are numbered inside (one
    shuffle) and start after the rows of the cells before them, so no shard is one task.
    The cells' order is that of their number, the rows' that of key, checksum and size.
    Rows of one key and text lie in one cell; so that many repeats can't fill it, rows that
    repeat are spread by the position at which Spark reads them, and the rows are written
    down once so that positions stay. Null texts have no bytes, null keys are one key,
    other columns are ignored, an empty table gives an empty result.
    """
    own, grown = tree(shards), tree(shards + 1)
    rows = df.select(F.col(key).alias("key"), utf8(F.col(text)).alias("bytes")).select(
        "key",
        (F.octet_length("bytes") + 8).cast("long").alias("size"),
        F.crc32("bytes").alias("text_crc32"),
        tree_shard(F.col("key"), own).alias("shard"),
        tree_shard(F.col("key"), grown).alias("grown_shard"),
    )
    spot = F.xxhash64("key", "text_crc32", F.pmod(F.monotonically_increasing_id(), F.lit(64)))
    rows = keep(rows.withColumn("spot", spot))
    cells = max(1, -(-rows.count() // (shards * cell_rows)))
    rows = rows.withColumn("cell", F.pmod("spot", F.lit(cells)))
    return _slots(rows, key)


def _slots(rows: DataFrame, key: str) -> DataFrame:
    counts = rows.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "cell").orderBy("key", "text_crc32", "size")
    return (
        rows.withColumn("place", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "cell"])
        .select(
            F.col("key").alias(key),
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("start") + F.col("place")).cast("long").alias("slot"),
            "grown_shard",
        )
    )
