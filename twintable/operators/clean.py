"""Cell clean-up, coercion, pseudonyms, duplicates and row filters."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from twintable.functions.text import (
    bool_word_to_int,
    is_bool_word,
    parse_double,
    pseudonym,
    squish,
    without_placeholder,
)
from twintable.spec import column, string_columns

# Fixed values of the proxy label rule.
EASY_MATERIALS = ("aluminum", "aluminium", "steel", "copper", "glass", "paper", "cardboard")
HARD_MATERIALS = ("composite", "mixed_composite", "unknown")


def _with(df: DataFrame, columns: Iterable[str], change) -> DataFrame:
    return df.withColumns({c: change(column(c)) for c in columns})


def normalize_strings(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _with(df, string_columns(df) if columns is None else columns, squish)


def null_placeholders(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _with(df, string_columns(df) if columns is None else columns, without_placeholder)


def _chosen(df: DataFrame, tests: dict[str, Column]) -> list[str]:
    """Names of the columns whose test aggregate is true, all in one pass."""
    if not tests:
        return []
    verdict = df.agg(*[F.coalesce(t, F.lit(False)).alias(c) for c, t in tests.items()]).first()
    return [c for c in tests if verdict[c]]


def boolean_columns(df: DataFrame) -> list[str]:
    """String columns whose every non-null value is a boolean word."""
    return _chosen(df, {c: F.bool_and(is_bool_word(column(c))) for c in string_columns(df)})


def coerce_booleans(df: DataFrame) -> DataFrame:
    return _with(df, boolean_columns(df), bool_word_to_int)


def _plain_number(c: Column) -> Column:
    return parse_double(F.replace(c, F.lit(","), F.lit("")))


def numeric_like_columns(df: DataFrame, min_rate: float = 0.95) -> list[str]:
    """String columns where more than ``min_rate`` of the non-nulls are numbers."""

    def test(name: str) -> Column:
        c = column(name)
        return F.count(_plain_number(c)) > F.lit(min_rate) * F.count(c)

    return _chosen(df, {c: test(c) & (F.count(c) > 0) for c in string_columns(df)})


def coerce_numeric(df: DataFrame, min_rate: float = 0.95) -> DataFrame:
    """Turn number-like strings into doubles; the few that fail become null."""
    return _with(df, numeric_like_columns(df, min_rate), _plain_number)


def to_numeric(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Parse the named columns, whatever fails becoming null."""
    text = set(string_columns(df))
    named = [c for c in columns if c in text]
    return _with(df, named, parse_double)


def force_string(df: DataFrame, columns: Iterable[str] = (), suffix: str | None = None) -> DataFrame:
    """Keep codes as text: the named columns and those ending in ``suffix``."""
    named = set(columns)
    codes = [c for c in df.columns if c in named or (suffix and c.endswith(suffix))]
    return _with(df, codes, lambda c: c.cast("string"))


def hash_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return _with(df, columns, pseudonym)


def drop_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.drop(*columns)


def filled_columns(df: DataFrame) -> list[str]:
    """Columns with at least one value."""
    return _chosen(df, {c: F.count(column(c)) > 0 for c in df.columns})


def drop_empty(df: DataFrame) -> DataFrame:
    """Drop columns without any value, then rows without any value."""
    kept = df.select(*[column(c) for c in filled_columns(df)])
    return kept.dropna(how="all") if kept.columns else kept


def with_provenance(df: DataFrame, **facts: str) -> DataFrame:
    return df.withColumns({f"source_{name}": F.lit(value) for name, value in facts.items()})


def deduplicate(df: DataFrame, subset: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Distinct rows, or the first row per ``subset`` in the given ``order``.

    The subset form is an aggregate over structs, so copies fold on the map
    side and a subset value that holds a third of the rows is no hot group.
    """
    if not subset:
        return df.dropDuplicates()
    rest = [c for c in df.columns if c not in subset]
    rank = [c for c in order if c not in subset]
    if not rest:
        return df.dropDuplicates()
    packed = F.struct(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(rank)], *rest)
    first = df.groupBy(*subset).agg(F.min(packed).alias("_row"))
    return first.select(*[c if c in subset else F.col("_row").getField(c).alias(c) for c in df.columns])


def align(syn: DataFrame, real: DataFrame) -> DataFrame:
    """The columns of ``real`` in its order and types."""
    return syn.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in real.schema])


def union_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Stack tables of differing columns, filling gaps with null."""
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table, allowMissingColumns=True)
    return whole


def proxy_label(
    df: DataFrame,
    out_col: str = "recyclability_bin",
    recycled: str = "recycled_content_pct",
    material: str = "material_main",
    rohs: str = "compliance_rohs",
    hazardous: str = "contains_hazardous_substance",
) -> DataFrame:
    """A High / Medium / Low label from recycled share, material and compliance."""

    def number(name: str) -> Column:
        if name not in df.columns:
            return F.lit(None).cast("double")
        return parse_double(F.col(name).cast("string"))

    share, compliant = number(recycled), number(rohs)
    hazard = F.coalesce(number(hazardous), F.lit(0.0))
    stuff = F.lower(F.col(material).cast("string")) if material in df.columns else F.lit("<unk>")
    low = (share < 10) | (hazard == 1) | stuff.isin(*HARD_MATERIALS)
    high = (share >= 50) & stuff.isin(*EASY_MATERIALS) & (compliant.isNull() | (compliant == 1)) & (hazard == 0)
    return df.withColumn(out_col, F.when(low, "Low").when(high, "High").otherwise("Medium"))


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(F.col(target).isNotNull())


def drop_rare_classes(df: DataFrame, target: str, min_count: int = 5) -> DataFrame:
    """Keep rows whose class has at least ``min_count`` rows.

    The rare side is joined: a class with fewer than ``min_count`` rows cannot
    be hot, and an anti join lets the optimizer split or broadcast as sizes allow.
    """
    rare = df.groupBy(target).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < min_count)
    return df.where(F.col(target).isNotNull()).join(rare.select(target), target, "left_anti")


def require_classes(df: DataFrame, target: str, at_least: int = 2) -> DataFrame:
    """Fail unless the target takes ``at_least`` different values."""
    found = df.select(target).where(F.col(target).isNotNull()).distinct().limit(at_least).count()
    if found < at_least:
        raise ValueError(f"need at least {at_least} target classes, found {found}")
    return df


def columns_with_nulls(df: DataFrame) -> list[str]:
    return _chosen(df, {c: F.bool_or(column(c).isNull()) for c in df.columns})


def require_complete(df: DataFrame) -> DataFrame:
    """Fail if any cell is missing."""
    holes = columns_with_nulls(df)
    if holes:
        raise ValueError(f"missing values in: {', '.join(holes)}; fill or drop them first")
    return df


# Name fragments that suggest a column repeats the target.
LEAKAGE_WORDS = ("label", "target", "class")


def leakage_columns(columns: Iterable[str], group: str | None = None) -> list[str]:
    return [c for c in columns if c != group and any(w in c.lower() for w in LEAKAGE_WORDS)]
