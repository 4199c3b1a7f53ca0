"""Merkle manifest of a table: leaves of rows, subroots of groups, a root, and proofs.

A row's rank in its group, written in base 8, is its way through the tree. Blocks of 8^4
leaves lie together after one shuffle; inside them a grouping without the last digit nests
the children of a node as structs, then one without the last two, until a block is one row
that holds its whole tree. The block's nodes are the leaves of the next tier. Back from the
root, transforms hand each child its parent's way and its siblings, and an explode emits
them: proofs need no join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from twintable.llm.common import keep

#: Children of a node, and levels that a block holds.
FAN_BITS, LEVELS = 3, 4
FAN = 1 << FAN_BITS
BLOCK_BITS = FAN_BITS * LEVELS
_WAY = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of texts put together."""
    return F.sha2(F.concat(*parts), 256)


def leaf(*fields: Column) -> Column:
    """Digest of a row: for each field ``-`` if null, else its UTF-8 bytes' number, ``:`` and itself."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def ranked(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``rank`` from 0 in their group by ``order`` and ``n``, the group's size.

    Rows are sorted over ranges and written with their position, so a group of any size lies
    in many tasks; a range adds what its group has in the ranges before it. ``group`` has no
    nulls; rows equal in ``order`` have any order among them.
    """
    bits = 33  # of the position that monotonically_increasing_id gives inside a partition
    placed = keep(
        rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("at", F.monotonically_increasing_id())
    ).withColumn("range", F.shiftright("at", bits))
    spans = placed.groupBy(group, "range").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = keep(
        spans.select(group, "range", "first", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"), F.sum("held").over(whole).alias("n"))
    )
    return placed.join(starts, [group, "range"]).select(*rows.columns, (F.col("at") - F.col("first") + F.col("start")).alias("rank"), "n")


def _levels() -> Column:
    """Levels that a tree over ``n`` nodes has in one block."""
    return sum(((F.col("n") > (1 << FAN_BITS * k)).cast("int") for k in range(1, LEVELS)), (F.col("n") > 1).cast("int"))


def _blocks(nodes: DataFrame) -> DataFrame:
    """``grp, block, n, hash, kids`` from nodes ``grp, rank, n, hash, item``: a row per block."""
    digits = {f"d{k}": F.shiftright("rank", FAN_BITS * k).bitwiseAND(FAN - 1).cast("int") for k in range(LEVELS)}
    work = nodes.withColumns({"block": F.shiftright("rank", BLOCK_BITS), **digits}).repartition("grp", "block")
    inner = "item"
    for k in range(LEVELS):
        keys = ["grp", "block", "n", *[f"d{j}" for j in range(k + 1, LEVELS)]]
        child = F.struct(F.col(f"d{k}").alias("at"), "hash", inner)
        work = work.groupBy(*keys).agg(F.sort_array(F.collect_list(child)).alias("kids"))
        below = F.array_join(F.transform("kids", lambda x: x["hash"]), "")
        work = work.withColumn("hash", F.when(_levels() > k, digest(below)).otherwise(F.col("kids")[0]["hash"]))
        inner = "kids"
    return work.select("grp", "block", "n", "hash", "kids")


def _siblings(parent: Column, i: Column) -> Column:
    kids = parent["kids"]

    def joined(part: Column) -> Column:
        return F.array_join(F.transform(part, lambda x: x["hash"]), "")

    return F.struct(joined(F.slice(kids, 1, i)).alias("before"), joined(F.slice(kids, i + 2, FAN)).alias("after"))


def _children(level: int) -> Callable[[Column], Column]:
    """From a node with its way to its children with theirs."""
    carried = ("hash", "item") if level == 0 else ("kids",)

    def children(parent: Column) -> Column:
        def child(x: Column, i: Column) -> Column:
            way = F.when(_levels() > level, F.concat(F.array(_siblings(parent, i)), parent["way"])).otherwise(parent["way"])
            return F.struct(*[x[c].alias(c) for c in carried], way.alias("way"))

        return F.transform(parent["kids"], child)

    return children


def _emit(blocks: DataFrame, ways: DataFrame) -> DataFrame:
    """``grp, subroot, hash, item, way`` of each leaf of ``blocks``; ``way`` leads from it to the root.

    ``ways`` has ``grp, block, subroot, way`` of the blocks; a grouping puts both together.
    """
    shape = blocks.select("kids").schema.simpleString()[len("struct<kids:") : -1]
    both = blocks.select("grp", "block", "n", "kids", F.lit(None).cast("string").alias("subroot"), F.lit(None).cast(_WAY).alias("way")).unionByName(
        ways.select("grp", "block", F.lit(None).cast("bigint").alias("n"), F.lit(None).cast(shape).alias("kids"), "subroot", "way")
    )
    work = both.groupBy("grp", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "kids", "subroot", "way")])
    nodes = F.array(F.struct("kids", "way"))
    for k in reversed(range(LEVELS)):
        work = work.select("grp", "n", "subroot", F.flatten(F.transform(nodes, _children(k))).alias("nodes"))
        nodes = F.col("nodes")
    return work.select("grp", "subroot", F.explode("nodes").alias("node")).select("grp", "subroot", "node.*")


class Tree(NamedTuple):
    """Tiers of blocks, and ``grp, hash, tier``: the top of each group and the tier that has it."""

    tiers: list[DataFrame]
    tops: DataFrame


def _build(nodes: DataFrame) -> Tree:
    tiers, tops = [], None
    while True:
        blocks = keep(_blocks(nodes))
        done = blocks.where(F.col("n") <= 1 << BLOCK_BITS).select("grp", "hash", F.lit(len(tiers)).alias("tier"))
        tiers.append(blocks)
        tops = done if tops is None else tops.unionByName(done)
        more = blocks.where(F.col("n") > 1 << BLOCK_BITS)
        if more.isEmpty():
            return Tree(tiers, tops)
        count = F.shiftright(F.col("n") + ((1 << BLOCK_BITS) - 1), BLOCK_BITS)
        nodes = more.select("grp", F.col("block").alias("rank"), count.alias("n"), "hash", F.struct("block").alias("item"))


def _ways(tree: Tree, tops: DataFrame) -> DataFrame:
    """``_emit`` of a tree's first tier, given ``grp, tier, subroot, way`` of the tops."""
    above = None
    for tier in reversed(range(len(tree.tiers))):
        ways = tops.where(F.col("tier") == tier).select("grp", F.lit(0).cast("bigint").alias("block"), "subroot", "way")
        if above is not None:
            ways = ways.unionByName(above.select("grp", F.col("item.block").alias("block"), "subroot", "way"))
        above = _emit(tree.tiers[tier], ways)
        if tier:
            above = keep(above)
    return above


def manifest(
    df: DataFrame, key: str = "doc_id", group: str = "lang", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), changed: dict[str, Column] | None = None
) -> DataFrame:
    """A row per row of ``df``: key, leaf, subroot, root, way, folded_root, verified.

    ``leaf`` digests ``fields``. In a group, leaves ascend by ``key`` (null first; rows that
    share a key by their leaf), and runs of 8 become their digest until one node is left, the
    ``subroot``; a run at the end may be shorter, a group of one leaf is its own subroot. The
    subroots, ordered by group (null first, then bytewise), likewise give ``root``. ``way``
    lists, from the leaf to the root, the digests ``before`` and ``after`` the row's node in its
    run. ``changed`` replaces fields by what a reader found; ``folded_root`` is the root that
    follows from them and the way, ``verified`` whether it is the root. Equal rows are leaves
    of their own; other columns are ignored; an empty table gives an empty result.
    """
    changed = changed or {}
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    found = leaf(*[changed.get(f, F.col(f)) for f in fields]) if changed else leaf(*[F.col(f) for f in fields])
    # Rows equal in everything get an order too, so that many of them spread over ranges.
    leaves = keep(
        df.select(name.alias("grp"), F.col(key).alias("key"), leaf(*[F.col(f) for f in fields]).alias("hash"), found.alias("found")).withColumn(
            "spot", F.monotonically_increasing_id()
        )
    )
    nodes = ranked(leaves, "grp", ["key", "hash", "spot"]).select("grp", "rank", "n", "hash", F.struct("key", "found").alias("item"))
    tree = _build(nodes)
    tops = keep(tree.tops.withColumn("all", F.lit("")))
    groups = ranked(tops, "all", ["grp"]).select(F.col("all").alias("grp"), "rank", "n", "hash", F.struct(F.col("grp").alias("name"), "tier").alias("item"))
    crown = _build(groups)
    top = crown.tops.collect()  # one row, none for an empty table
    root = F.lit(top[0]["hash"] if top else None).cast("string")
    start = crown.tops.select("grp", "tier", F.lit(None).cast("string").alias("subroot"), F.array().cast(_WAY).alias("way"))
    ways = keep(_ways(crown, start).select(F.col("item.name").alias("grp"), "item.tier", F.col("hash").alias("subroot"), "way"))
    rows = _ways(tree, ways)
    fold = F.aggregate("way", F.col("item.found"), lambda h, step: digest(step["before"], h, step["after"]))
    rows = rows.select(F.col("item.key").alias(key), F.col("hash").alias("leaf"), "subroot", root.alias("root"), "way", fold.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def proof_digest(way: Column) -> Column:
    """Digest of all siblings of a way, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(way, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def lowered(key: Column, text: Column) -> Column:
    """``text`` with A-Z in lower case where 3 divides the CRC-32 of the decimal key."""
    hit = F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return F.when(hit, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(text)
