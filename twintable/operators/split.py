"""Deterministic stratified train/test split."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from twintable.operators.counts import running_totals
from twintable.session import materialize

_ANY = "(all)"
#: Rows of a class that may share the beginning of the digest in which its quota ends.
EDGE_ROWS = 4096


def test_quotas(df: DataFrame, target: str | None, share: float = 0.2) -> DataFrame:
    """``(stratum, rows, quota)``: test rows per class.

    The test set has ceil(share * rows) rows. Each class gets the whole part of
    its share and the largest remainders get one more. Where a class has a
    single row, or there are more classes than test rows, all rows form one
    stratum.
    """
    label = F.col(target).cast("string") if target else F.lit(_ANY)
    sizes = df.groupBy(F.coalesce(label, F.lit("<MISSING>")).alias("stratum")).agg(F.count(F.lit(1)).alias("rows"))
    facts = sizes.agg(F.sum("rows"), F.min("rows"), F.count(F.lit(1))).first()
    total, smallest, classes = facts[0] or 0, facts[1] or 0, facts[2]
    test_rows = math.ceil(share * total)
    if smallest < 2 or classes > min(test_rows, total - test_rows):
        return df.sparkSession.createDataFrame(
            [(_ANY, total, test_rows)], "stratum string, rows bigint, quota bigint"
        )
    exact = F.col("rows") * F.lit(test_rows) / F.lit(total)
    whole = sizes.select("stratum", "rows", F.floor(exact).alias("floor"), (exact - F.floor(exact)).alias("rest"))
    left_over = F.lit(test_rows) - whole.select(F.sum("floor")).scalar()
    ordered = whole.withColumns({"_all": F.lit(0), "_one": F.lit(1), "_down": -F.col("rest")})
    ranked = running_totals(ordered, ["_one"], key="_all", order=("_down", "stratum"))
    more = (F.col("upto__one") <= left_over).cast("int")
    return ranked.select("stratum", "rows", (F.col("floor") + more).cast("bigint").alias("quota"))


def _stratum(quotas: DataFrame, target: str | None):
    single = target is None or quotas.where(F.col("stratum") == _ANY).count() > 0
    return F.lit(_ANY) if single else F.coalesce(F.col(target).cast("string"), F.lit("<MISSING>"))


def quota_edges(hashed: DataFrame, quotas: DataFrame) -> DataFrame:
    """``_stratum, _edge, _take``: how the digest begins in which a class's quota ends, and how many rows of it.

    ``hashed`` has ``_stratum, _digest, _n``. Each pass counts a class's rows by the next three hex
    digits below the prefix that holds the edge, 4,096 numbers a class and task, and goes on with
    the prefix that the quota ends in, until few rows share it or all of them the next 15 digits:
    no table is sorted, and passes grow with the logarithm of the largest class. A class of quota 0
    has no edge.
    """
    edges = quotas.where("quota > 0").select(F.col("stratum").alias("_stratum"), F.lit("").alias("_prefix"), F.col("quota").alias("_take"))
    length = 0
    while True:
        inside = hashed.join(edges, "_stratum").where(F.substring("_digest", 1, length) == F.col("_prefix"))
        length += 3
        # as a number, which hash aggregates can hold
        rest = F.conv(F.substring("_digest", length + 1, 15), 16, 10).cast("bigint")
        counts = inside.groupBy("_stratum", "_take", F.substring("_digest", 1, length).alias("_prefix")).agg(
            F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_many"), F.min(rest).alias("_low"), F.max(rest).alias("_high")
        )
        # at most 4096 rows a class
        upto = F.sum("_rows").over(Window.partitionBy("_stratum").orderBy("_prefix"))
        hit = counts.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_take")) & (F.col("_upto") - F.col("_rows") < F.col("_take")))
        edges = materialize(hit.select("_stratum", "_prefix", (F.col("_take") - F.col("_upto") + F.col("_rows")).alias("_take"), "_many", "_low", "_high"))
        if edges.where((F.col("_many") > EDGE_ROWS) & (F.col("_low") != F.col("_high"))).isEmpty():
            begin = F.lpad(F.lower(F.hex("_low")), 15, "0")
            return edges.select("_stratum", F.when(F.col("_low") == F.col("_high"), F.concat("_prefix", begin)).otherwise(F.col("_prefix")).alias("_edge"), "_take")
        edges = edges.select("_stratum", "_prefix", "_take")


def _taken(marked: DataFrame) -> DataFrame:
    """``_test``: how many of a row's ``_n`` copies go to the test set.

    Digests below the edge go there and those above it don't; a window numbers only the few rows
    of the prefix in which a quota ends.
    """
    below = F.coalesce(F.col("_digest") < F.col("_edge"), F.lit(False))
    at_edge = F.coalesce(F.startswith("_digest", "_edge"), F.lit(False))
    decided = marked.where(~at_edge).withColumn("_test", F.when(below, F.col("_n")).otherwise(F.lit(0).cast("bigint")))
    earlier = Window.partitionBy("_stratum").orderBy("_digest").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("_take") - F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    return decided.unionByName(marked.where(at_edge).withColumn("_test", F.least(F.greatest(rest, F.lit(0)), F.col("_n"))))


def tag_split(
    df: DataFrame, target: str | None, key: Sequence[str], share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add boolean ``is_test``; ``key`` must identify a row.

    Rows are ordered within a class by SHA-256 of key and seed and the first ``quota`` go to the
    test set; where that is follows from counts of digests (``quota_edges``).
    """
    quotas = materialize(test_quotas(df, target, share))
    digest = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(str(seed))), 256)
    hashed = df.withColumns({"_stratum": _stratum(quotas, target), "_digest": digest, "_n": F.lit(1).cast("bigint")})
    edges = quota_edges(hashed.select("_stratum", "_digest", "_n"), quotas)
    return _taken(hashed.join(edges, "_stratum", "left")).select(*df.columns, (F.col("_test") > 0).alias("is_test"))


def _repeat(df: DataFrame, times: str, block: int = 4096) -> DataFrame:
    """Each row ``times`` times, a row with many copies spread over tasks."""
    blocks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(times) - 1) / block))
    spread = df.where(F.col(times) > 0).withColumn("_block", F.explode(blocks)).hint("rebalance")
    rest = F.least(F.lit(block).cast("bigint"), F.col(times) - F.col("_block") * block)
    return spread.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), rest))).drop("_block", "_copy")


def split_rows(
    df: DataFrame, target: str | None, share: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Train and test tables of a table without a key.

    Equal rows cannot be told apart, so distinct rows carry a count; the digest
    in which a class's quota ends says how many copies of each go to the test set.
    """
    quotas = materialize(test_quotas(df, target, share))
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in df.columns]
    digest = F.sha2(F.concat_ws("\u0001", *cells, F.lit(str(seed))), 256)
    distinct = materialize(
        df.groupBy(*df.columns)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumns({"_stratum": _stratum(quotas, target), "_digest": digest})
    )
    edges = quota_edges(distinct.select("_stratum", "_digest", "_n"), quotas)
    tagged = _taken(distinct.join(edges, "_stratum", "left")).withColumn("_train", F.col("_n") - F.col("_test"))
    return (
        _repeat(tagged, "_train").select(*df.columns),
        _repeat(tagged, "_test").select(*df.columns),
    )


def run_context(
    df: DataFrame, train: DataFrame, test: DataFrame, target: str, group: str | None, seed: int
) -> DataFrame:
    """One row that says what a run worked on."""

    def rows(t: DataFrame):
        return t.select(F.count(F.lit(1))).scalar().cast("bigint")

    return df.sparkSession.range(1).select(
        F.lit(seed).cast("bigint").alias("seed"),
        rows(df).alias("rows_all"),
        rows(train).alias("rows_train"),
        rows(test).alias("rows_test"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        F.lit(target).alias("target_col"),
        F.lit(group).cast("string").alias("group_col"),
    )
