"""Column profile, numeric summary, outliers and range flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from twintable.functions.text import BINARY_WORDS
from twintable.operators.counts import quantile_name, value_counts
from twintable.operators.selection import exact_quantiles
from twintable.session import materialize
from twintable.spec import is_numeric, numeric_columns

# Name fragments that mark identifiers, percentages and amounts.
ID_WORDS = ("id", "uuid", "serial", "gtin", "lot", "batch", "sku")
PERCENT_WORDS = ("pct", "percent", "percentage")
AMOUNT_WORDS = ("mass", "weight", "co2", "amount", "qty", "quantity")

SUMMARY_PROBS = (0.01, 0.05, 0.5, 0.95, 0.99)
QUARTILES = (0.25, 0.75)


def _named(words: Sequence[str], column: str) -> bool:
    return any(w in column.lower() for w in words)


def _fact(facts: dict[str, object]) -> Column:
    """A literal map from column name to a fact known from the schema."""
    pairs = [F.lit(x) for item in facts.items() for x in item]
    return F.element_at(F.create_map(*pairs), F.col("column"))


def role_case(numeric: Column, textual: Column, non_null: Column, distinct: Column, folded: Column, binary: Column):
    """Role of a column from its counts."""
    return (
        F.when(non_null == 0, "unknown")
        .when(numeric, F.when(distinct <= 2, "binary").otherwise("numeric"))
        .when(~textual, "unknown_type")
        .when(binary, "binary")
        .when(folded <= F.greatest(F.lit(20), F.floor(F.lit(0.2) * non_null)), "categorical")
        .otherwise("text_or_id")
    )


def column_profile(
    df: DataFrame, target: str | None = None, group: str | None = None, counts: DataFrame | None = None
) -> DataFrame:
    """One row per column: counts, missing share, distinct values, role, flags.

    ``counts`` may be a materialised ``value_counts`` of the same table.
    """
    counts = value_counts(df) if counts is None else counts
    # an empty table still gets one row per column
    names = df.sparkSession.createDataFrame(
        [(c, None, 0) for c in df.columns], "column string, value string, n bigint"
    )
    word = F.lower(F.trim("value"))
    stats = (
        counts.unionByName(names)
        .groupBy("column")
        .agg(
            F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("non_null_count"),
            F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing_count"),
            F.count("value").alias("nunique_non_null"),
            F.count_distinct(word).alias("_folded"),
            F.bool_and(word.isin(*BINARY_WORDS)).alias("_binary"),
        )
    )
    kinds = {f.name: f.dataType for f in df.schema}
    numeric = _fact({c: is_numeric(t) for c, t in kinds.items()})
    textual = _fact({c: isinstance(t, T.StringType) for c, t in kinds.items()})
    rows = F.col("non_null_count") + F.col("missing_count")
    ratio = F.col("nunique_non_null") / F.greatest(F.lit(1), F.col("non_null_count"))
    return stats.select(
        "column",
        _fact({c: t.simpleString() for c, t in kinds.items()}).alias("dtype"),
        "non_null_count",
        "missing_count",
        F.when(rows > 0, F.col("missing_count") / rows * 100).alias("missing_pct"),
        "nunique_non_null",
        role_case(
            numeric, textual, F.col("non_null_count"), F.col("nunique_non_null"), F.col("_folded"), F.col("_binary")
        ).alias("inferred_role"),
        ratio.alias("nunique_ratio"),
        (
            _fact({c: _named(ID_WORDS, c) for c in kinds})
            | (~numeric & (F.col("non_null_count") > 0) & (ratio >= 0.9))
        ).alias("is_id_like"),
        (F.col("column").eqNullSafe(F.lit(target))).alias("is_target"),
        (F.col("column").eqNullSafe(F.lit(group))).alias("is_group"),
    )


def id_like_columns(df: DataFrame, exempt: Sequence[str] = (), profile: DataFrame | None = None) -> list[str]:
    """Names of identifier-like columns; one row per column reaches the driver."""
    profile = column_profile(df) if profile is None else profile
    found = {r["column"] for r in profile.where("is_id_like").select("column").collect()}
    return [c for c in df.columns if c in found and c not in exempt]


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """``(label, count, pct)``, null shown as ``<MISSING>``, most frequent first."""
    label = F.coalesce(F.col(target).cast("string"), F.lit("<MISSING>")).alias("label")
    rows = df.select(F.count(F.lit(1))).scalar()
    return (
        df.groupBy(label)
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("pct", F.col("count") / rows * 100)
        .orderBy(F.desc("count"), "label")
    )


def sample_values(
    df: DataFrame, k: int = 15, counts: DataFrame | None = None, profile: DataFrame | None = None
) -> DataFrame:
    """The ``k`` smallest distinct values of every non-numeric or binary column."""
    counts = materialize(value_counts(df)) if counts is None else counts
    profile = column_profile(df, counts=counts) if profile is None else profile
    shown = profile.where(F.col("inferred_role").isin("categorical", "binary", "text_or_id")).select("column")
    rank = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    # at most one row per column on the joined side
    return (
        counts.where(F.col("value").isNotNull())
        .join(F.broadcast(shown), "column", "left_semi")
        .select("column", "value", rank.alias("position"))
        .where(F.col("position") <= k)
    )


def _describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation and range of every column from one scan."""

    def stats(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.struct(
            F.lit(c).alias("column"),
            F.count(x).alias("count"),
            F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
        )

    return df.agg(F.array(*[stats(c) for c in columns]).alias("s")).select(F.inline("s"))


def summary_quantiles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All quantiles that ``numeric_summary`` and ``iqr_outliers`` need, in one go."""
    return exact_quantiles(df, columns, sorted({*SUMMARY_PROBS, *QUARTILES}))


def numeric_summary(
    df: DataFrame, columns: Sequence[str] | None = None, found: DataFrame | None = None
) -> DataFrame:
    """Count, mean, sample deviation, range and quantiles of numeric columns.

    ``found`` may hold the quantiles (``summary_quantiles``).
    """
    columns = list(columns or numeric_columns(df))
    found = exact_quantiles(df, columns, SUMMARY_PROBS) if found is None else found
    names = [quantile_name(p) for p in SUMMARY_PROBS]
    # one row per column
    return (
        _describe(df, columns)
        .join(F.broadcast(found.select("column", *names)), "column", "left")
        .select("column", "count", "mean", "std", "min", *names, "max")
    )


def iqr_outliers(
    df: DataFrame, columns: Sequence[str] | None = None, found: DataFrame | None = None
) -> DataFrame:
    """Bounds 1.5 quartile ranges out, and how many values lie beyond them."""
    columns = list(columns or numeric_columns(df))
    found = exact_quantiles(df, columns, QUARTILES) if found is None else found
    bounds = {}
    for r in found.collect():  # one row per column
        spread = r["p75"] - r["p25"]
        if r["n"] >= 10 and spread != 0:
            bounds[r["column"]] = (r["p25"] - 1.5 * spread, r["p75"] + 1.5 * spread)
    if not bounds:
        return df.sparkSession.createDataFrame([], "column string, iqr_low double, iqr_high double, outlier_count bigint")

    def beyond(c: str) -> Column:
        low, high = bounds[c]
        x = F.col(c).cast("double")
        out = ~F.isnan(x) & ((x < low) | (x > high))
        return F.struct(F.lit(c).alias("column"), F.lit(low).alias("iqr_low"), F.lit(high).alias("iqr_high"), F.count_if(out).alias("outlier_count"))

    return df.agg(F.array(*[beyond(c) for c in bounds]).alias("s")).select(F.inline("s"))


def range_flags(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Percentages outside 0..100 and negative amounts, told by column name."""
    columns = [c for c in columns or numeric_columns(df) if _named(PERCENT_WORDS + AMOUNT_WORDS, c)]
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, flag string")

    def flag(c: str) -> Column:
        x = F.col(c)
        text = F.lit(None).cast("string")
        if _named(PERCENT_WORDS, c):
            text = F.when((F.min(x) < 0) | (F.max(x) > 100), "values_outside_0_100_for_percentage_like_column")
        if _named(AMOUNT_WORDS, c):
            text = F.when(F.min(x) < 0, "negative_values_in_quantity_like_column").otherwise(text)
        return F.struct(F.lit(c).alias("column"), text.alias("flag"))

    found = df.agg(F.array(*[flag(c) for c in columns]).alias("s")).select(F.inline("s"))
    return found.where(F.col("flag").isNotNull())


def schema_catalogue(profile: DataFrame, flags: DataFrame) -> DataFrame:
    """Profile rows for documentation, with the range flag where there is one."""
    return profile.join(flags, "column", "left").select(
        "column",
        "dtype",
        "inferred_role",
        "missing_pct",
        "nunique_non_null",
        "is_target",
        "is_group",
        "flag",
    )
