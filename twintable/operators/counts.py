"""Value counts, running totals and exact quantiles.

Most reports here need only how often each value occurs. One unpivot and one
``groupBy`` give that for every column at once; partial aggregation folds
repeated values before the shuffle, so a value that fills a third of the table
costs one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from twintable.session import materialize


def _long_text(df: DataFrame, columns: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    as_text = df.select(*carry, *[F.col(c).cast("string").alias(c) for c in columns])
    return as_text.unpivot(list(carry), list(columns), "column", "value")


def _long_numbers(df: DataFrame, columns: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    # + 0.0 folds negative zero into zero
    as_double = df.select(*carry, *[(F.col(c).cast("double") + F.lit(0.0)).alias(c) for c in columns])
    long = as_double.unpivot(list(carry), list(columns), "column", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, value, n)`` with values as text; null is a value of its own.

    Numbers are grouped as numbers and only their distinct values turn to text.
    """
    columns = list(columns or df.columns)
    kinds = {f.name: f.dataType for f in df.schema}
    whole = [c for c in columns if isinstance(kinds[c], T.IntegralType)]
    real = [c for c in columns if isinstance(kinds[c], (T.DoubleType, T.FloatType))]
    if not whole and not real:
        return _long_text(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    cells = []
    for c in columns:
        text = F.lit(None) if c in whole or c in real else F.col(c)
        cells += [
            F.lit(c),
            text.cast("string"),
            (F.col(c) if c in whole else F.lit(None)).cast("bigint"),
            # + 0.0 folds negative zero into zero
            (F.col(c).cast("double") + F.lit(0.0)) if c in real else F.lit(None).cast("double"),
        ]
    keys = ["column", "_text", "_whole", "_real"]
    long = df.select(F.stack(F.lit(len(columns)), *cells).alias(*keys))
    value = F.coalesce("_text", F.col("_whole").cast("string"), F.col("_real").cast("string")).alias("value")
    return long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select("column", value, "n")


def numeric_counts(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """``(column, value, n)`` over the non-null numbers of ``columns``."""
    carry = [weight] if weight else []
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return _long_numbers(df, columns, carry).groupBy("column", "value").agg(n.alias("n"))


def tag_pair(real: DataFrame, syn: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both tables on top of each other with 0/1 columns ``_real`` and ``_syn``."""
    left = real.select(*columns, F.lit(1).alias("_real"), F.lit(0).alias("_syn"))
    right = syn.select(*columns, F.lit(0).alias("_real"), F.lit(1).alias("_syn"))
    return left.unionByName(right)


def _pair_sums() -> list[Column]:
    return [F.sum("_real").alias("real_n"), F.sum("_syn").alias("syn_n")]


def paired_row_counts(real: DataFrame, syn: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per distinct combination with its count on either side.

    Grouping treats nulls as equal, so this one aggregate stands in for a
    null-safe join in both directions.
    """
    columns = list(columns or real.columns)
    return tag_pair(real, syn, columns).groupBy(*columns).agg(*_pair_sums())


def paired_value_counts(
    real: DataFrame, syn: DataFrame, columns: Sequence[str], null_text: str = "nan"
) -> DataFrame:
    """``(column, value, real_n, syn_n)``; null counts as the text ``null_text``."""
    long = _long_text(tag_pair(real.select(*columns), syn.select(*columns), columns), columns, ["_real", "_syn"])
    value = F.coalesce("value", F.lit(null_text)).alias("value")
    return long.groupBy("column", value).agg(*_pair_sums())


def paired_numeric_counts(real: DataFrame, syn: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, real_n, syn_n)`` over non-null numbers."""
    long = _long_numbers(tag_pair(real.select(*columns), syn.select(*columns), columns), columns, ["_real", "_syn"])
    return long.groupBy("column", "value").agg(*_pair_sums())


def running_totals(
    counts: DataFrame, measures: Sequence[str], key: str = "column", order: Sequence[str] = ("value",)
) -> DataFrame:
    """Add ``upto_<m>`` (inclusive running sum in ``order``) and ``all_<m>`` per key.

    A window over the whole key would sort it in one task. Here the rows are
    range-partitioned, the partition number is written down with them, totals
    per partition give each its starting value, and the window only runs inside
    a partition.
    """
    sliced = materialize(
        counts.repartitionByRange(key, *order).withColumn("_slice", F.spark_partition_id())
    )
    per_slice = sliced.groupBy(key, "_slice").agg(*[F.sum(m).alias(f"_sum_{m}") for m in measures])
    whole = Window.partitionBy(key)
    before = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_slice.select(
        key,
        "_slice",
        *[F.coalesce(F.sum(f"_sum_{m}").over(before), F.lit(0)).alias(f"_start_{m}") for m in measures],
        *[F.sum(f"_sum_{m}").over(whole).alias(f"all_{m}") for m in measures],
    )
    inside = (
        Window.partitionBy(key, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = sliced.join(starts, [key, "_slice"])
    return joined.select(
        *counts.columns,
        *[(F.sum(m).over(inside) + F.col(f"_start_{m}")).alias(f"upto_{m}") for m in measures],
        *[f"all_{m}" for m in measures],
    )


def quantile_name(p: float) -> str:
    return f"p{p * 100:g}".replace(".", "_")


def quantiles_of_totals(totals: DataFrame, probs: Sequence[float]) -> DataFrame:
    """Quantiles from ``running_totals(..., ["n"])``: ``(column, n, p1, p50, ...)``.

    Linear interpolation between the two nearest ranks.
    """
    first = F.col("upto_n") - F.col("n")

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank < F.col("upto_n")), F.col("value")))

    picks, results = [F.max("all_n").cast("bigint").alias("n")], []
    for i, p in enumerate(probs):
        rank = F.lit(float(p)) * (F.col("all_n") - 1)
        picks += [at(F.floor(rank)).alias(f"_lo{i}"), at(F.ceil(rank)).alias(f"_hi{i}")]
        share = F.lit(float(p)) * (F.col("n") - 1)
        share = share - F.floor(share)
        results.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * share).alias(quantile_name(p)))
    return totals.groupBy("column").agg(*picks).select("column", "n", *results)


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], weight: str | None = None) -> DataFrame:
    """Exact quantiles of every column, without holding a column in one task."""
    return quantiles_of_totals(running_totals(numeric_counts(df, columns, weight), ["n"]), probs)
