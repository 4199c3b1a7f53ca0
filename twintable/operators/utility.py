"""Distribution distances between a real and a synthetic table."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from twintable.operators.counts import paired_numeric_counts, paired_value_counts, running_totals

#: Up to this many rows on either side ``method="auto"`` is exact.
EXACT_KS_ROWS = 10_000


def ks_pvalue(d: float, n: int, m: int, method: str = "auto") -> float:
    """Two-sided p-value of a two-sample KS statistic by ``method``.

    ``exact``: the chance that a random monotone lattice path from (0, 0) to (n, m)
    strays at least ``d`` from the diagonal, followed one anti-diagonal at a time. Only
    the strip around the diagonal is followed, 2 d n m / (n + m) points of each
    anti-diagonal, so its cost grows with d n m; chances below 1e-300 are given as 0.
    ``asymptotic``: the limiting Kolmogorov series. ``auto``: exact up to ``EXACT_KS_ROWS`` rows a side, as common
    statistics packages have it; callers that compare tables of different sizes
    name one law.
    """
    if method not in ("auto", "exact", "asymptotic"):
        raise ValueError(f"unknown method {method!r}")
    if method == "asymptotic" or method == "auto" and max(n, m) > EXACT_KS_ROWS:
        x = d * math.sqrt(n * m / (n + m))
        if x < 0.2:
            return 1.0
        terms = (2 * (-1) ** (k - 1) * math.exp(-2 * (k * x) ** 2) for k in range(1, 101))
        return min(1.0, max(0.0, sum(terms)))
    gap = round(d * n * m)
    if gap == 0:
        return 1.0
    # Each side alone strays half as far with a chance of 2 exp(-n d^2 / 2) at most.
    if min(n, m) * d * d / 2 > 700:
        return 0.0
    # Chances at the points (i, step - i) with |i m - (step - i) n| < gap; beyond the strip they are 1.
    low, chance = 0, np.zeros(1)
    for step in range(1, n + m + 1):
        first = max(0, step - m, -((gap - 1 - step * n) // (n + m)))
        last = min(n, step, (step * n + gap - 1) // (n + m))
        if first > last:
            return 1.0
        i = np.arange(first, last + 1)
        # chances one step before, at i - 1 and at i
        before = np.ones(len(i) + 1)
        start, end = max(first - 1, low), min(last, low + len(chance) - 1)
        if start <= end:
            before[start - first + 1 : end - first + 2] = chance[start - low : end - low + 1]
        chance = (i * before[:-1] + (step - i) * before[1:]) / step
        low = first
    return float(chance[n - low])


def ks_statistic(real: DataFrame, syn: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, real_n, syn_n, ks_stat)``: largest gap of the two step functions."""
    totals = running_totals(paired_numeric_counts(real, syn, columns), ["real_n", "syn_n"])
    gap = F.abs(F.col("upto_real_n") / F.col("all_real_n") - F.col("upto_syn_n") / F.col("all_syn_n"))
    both = (F.col("all_real_n") > 0) & (F.col("all_syn_n") > 0)
    return totals.groupBy("column").agg(
        F.max("all_real_n").cast("bigint").alias("real_n"),
        F.max("all_syn_n").cast("bigint").alias("syn_n"),
        F.max(F.when(both, gap)).alias("ks_stat"),
    )


def _moments(df: DataFrame, columns: Sequence[str], side: str) -> DataFrame:
    def stats(c: str) -> Column:
        x = F.nullif(F.col(c).cast("double"), F.lit(float("nan")))
        return F.struct(
            F.lit(c).alias("column"), F.avg(x).alias(f"{side}_mean"), F.stddev_samp(x).alias(f"{side}_std")
        )

    return df.agg(F.array(*[stats(c) for c in columns]).alias("s")).select(F.inline("s"))


def moments(real: DataFrame, syn: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of every column on both sides."""
    return _moments(real, columns, "real").join(_moments(syn, columns, "syn"), "column")


def numeric_distance(
    real: DataFrame, syn: DataFrame, columns: Sequence[str], method: str = "auto"
) -> DataFrame:
    """Moments, KS statistic and p-value per numeric column."""

    @F.pandas_udf(T.DoubleType())
    def pvalue(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        # one row per column
        return pd.Series(
            [None if pd.isna(x) else ks_pvalue(x, int(a), int(b), method) for x, a, b in zip(d, n, m)],
            dtype=float,
        )

    ks = ks_statistic(real, syn, columns)
    return (
        moments(real, syn, columns)
        .join(ks, "column", "left")
        .withColumn("ks_pvalue", pvalue("ks_stat", "real_n", "syn_n"))
        .select("column", "real_mean", "syn_mean", "real_std", "syn_std", "ks_stat", "ks_pvalue")
    )


def category_shares(
    real: DataFrame, syn: DataFrame, columns: Sequence[str], null_text: str = "nan"
) -> DataFrame:
    """``(column, value, real_share, syn_share)`` over the union of values."""
    counts = paired_value_counts(real, syn, columns, null_text)

    def rows(t: DataFrame) -> Column:
        return F.nullif(t.select(F.count(F.lit(1))).scalar(), F.lit(0).cast("bigint"))

    return counts.select(
        "column",
        "value",
        F.coalesce(F.col("real_n") / rows(real), F.lit(0.0)).alias("real_share"),
        F.coalesce(F.col("syn_n") / rows(syn), F.lit(0.0)).alias("syn_share"),
    )


def total_variation(shares: DataFrame) -> DataFrame:
    """``(column, tvd)``: half the summed share differences."""
    gap = F.abs(F.col("real_share") - F.col("syn_share"))
    return shares.groupBy("column").agg((F.lit(0.5) * F.sum(gap)).alias("tvd"))


def top_categories(shares: DataFrame, k: int = 5) -> DataFrame:
    """``(column, side, position, value, share)``: the most frequent values of either side."""
    parts = []
    for side in ("real", "syn"):
        share = F.col(f"{side}_share")
        rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc(share), "value"))
        parts.append(
            shares.select("column", F.lit(side).alias("side"), rank.alias("position"), "value", share.alias("share"))
            .where(F.col("position") <= k)
        )
    return parts[0].unionByName(parts[1])


def cross_products(df: DataFrame, columns: Sequence[str], means: Sequence[float]) -> DataFrame:
    """``i, j, n, sx, sy, sxx, syy, sxy`` for every two columns (i <= j): sums over rows that have both.

    A task multiplies blocks of rows as matrices, with ``means`` taken off, and adds its blocks
    up; a row for each pair and task is all that is shuffled, however many rows there are.
    """
    k = len(columns)
    upper = np.triu_indices(k)

    def run(batches):
        total = np.zeros((6, k, k))
        for batch in batches:
            x = np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns], dtype=np.float64).T.reshape(-1, k) - means
            has = ~np.isnan(x)
            x, one = np.where(has, x, 0.0), has.astype(np.float64)
            square = x * x
            total += [one.T @ one, x.T @ one, one.T @ x, square.T @ one, one.T @ square, x.T @ x]
        cells = [pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), *[pa.array(t[upper]) for t in total]]
        yield pa.RecordBatch.from_arrays(cells, names=["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])

    sums = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    numbers = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    products = numbers.mapInArrow(run, "i int, j int, " + ", ".join(f"{s} double" for s in sums))
    return products.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in sums])


def _correlations(df: DataFrame, columns: Sequence[str], side: str) -> DataFrame:
    seen = df.agg(*[F.avg(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None))).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    products = cross_products(df, columns, [m if m is not None else 0.0 for m in seen])
    n = F.nullif("n", F.lit(0.0))

    def spread(first: str, second: str) -> Column:
        # What rounding leaves of a constant side is no spread; such a side leaves the value undefined.
        value = F.col(second) / n - (F.col(first) / n) * (F.col(first) / n)
        return F.when(value > F.col(second) / n * 1e-12, value)

    both = F.sqrt(spread("sx", "sxx")) * F.sqrt(spread("sy", "syy"))
    r = F.when(F.col("i") == F.col("j"), both / both).otherwise((F.col("sxy") / n - F.col("sx") / n * (F.col("sy") / n)) / both)
    clean = F.when(r.isNull() | F.isnan(r), F.lit(0.0)).otherwise(F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))
    names = F.array(*[F.lit(c) for c in columns])
    return products.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), clean.alias(f"{side}_corr"))


def correlation_pairs(real: DataFrame, syn: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(a, b, real_corr, syn_corr)`` for every unordered pair, undefined ones as 0."""
    return _correlations(real, columns, "real").join(_correlations(syn, columns, "syn"), ["a", "b"])


def correlation_mae(real: DataFrame, syn: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean absolute difference over the full matrix, diagonal included."""
    if len(columns) < 2:
        return real.sparkSession.createDataFrame([(None,)], "numeric_correlation_mae double")
    gap = F.abs(F.col("real_corr") - F.col("syn_corr"))
    times = F.when(F.col("a") == F.col("b"), 1).otherwise(2)
    return correlation_pairs(real, syn, columns).agg(
        (F.sum(gap * times) / F.lit(len(columns) ** 2)).alias("numeric_correlation_mae")
    )


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 20, weight: str | None = None) -> DataFrame:
    """``(column, bin, bin_low, bin_high, n, density)`` over each column's own range.

    The last bin is closed; a constant column gets a range of width one around
    its value. Bins without rows are left out.
    """
    columns = list(columns)
    limits = df.agg(
        F.map_from_arrays(
            F.array(*[F.lit(c) for c in columns]),
            F.array(
                *[
                    F.struct(F.min(F.col(c).cast("double")).alias("lo"), F.max(F.col(c).cast("double")).alias("hi"))
                    for c in columns
                ]
            ),
        ).alias("limits")
    ).scalar()
    numbers = df.select(
        (F.col(weight) if weight else F.lit(1)).alias("_w"), *[F.col(c).cast("double").alias(c) for c in columns]
    )
    long = numbers.unpivot(["_w"], columns, "column", "value").where(F.col("value").isNotNull())
    own = F.element_at(limits, F.col("column"))
    flat = own.getField("lo") == own.getField("hi")
    long = long.select(
        "column",
        "value",
        "_w",
        F.when(flat, own.getField("lo") - 0.5).otherwise(own.getField("lo")).alias("lo"),
        F.when(flat, own.getField("hi") + 0.5).otherwise(own.getField("hi")).alias("hi"),
    )
    place = F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    width = (F.col("hi") - F.col("lo")) / bins
    counted = (
        long.withColumn("bin", F.least(place, F.lit(bins - 1)).cast("bigint"))
        .groupBy("column", "bin", "lo", "hi")
        .agg(F.sum("_w").cast("bigint").alias("n"))
    )
    # one row per column and bin from here on
    rows = F.sum("n").over(Window.partitionBy("column"))
    return counted.select(
        "column",
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("bin_low"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_high"),
        "n",
        (F.col("n") / (rows * width)).alias("density"),
    )


def histogram_overlay(real: DataFrame, syn: DataFrame, columns: Sequence[str], bins: int = 20) -> DataFrame:
    """Histograms of both sides in one table."""
    return (
        histogram(real, columns, bins)
        .withColumn("side", F.lit("real"))
        .unionByName(histogram(syn, columns, bins).withColumn("side", F.lit("syn")))
    )
