"""Clean a flat table and report on what it holds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from twintable.operators.clean import (
    coerce_booleans,
    coerce_numeric,
    deduplicate,
    drop_columns,
    hash_columns,
    normalize_strings,
)
from twintable.operators.counts import value_counts
from twintable.operators.naming import resolve_columns, standard_name, standardize_columns
from twintable.operators.profile import (
    class_distribution,
    column_profile,
    id_like_columns,
    iqr_outliers,
    numeric_summary,
    range_flags,
    sample_values,
    schema_catalogue,
    summary_quantiles,
)
from twintable.session import materialize
from twintable.spec import Roles, numeric_columns


@dataclass(frozen=True)
class CleanReport:
    table: DataFrame
    generator_input: DataFrame
    profile: DataFrame
    classes: DataFrame | None
    samples: DataFrame
    numbers: DataFrame | None
    outliers: DataFrame | None
    flags: DataFrame
    catalogue: DataFrame
    summary: DataFrame


def clean_table(raw: DataFrame, roles: Roles, order: tuple[str, ...] = ()) -> tuple[DataFrame, int, int]:
    """The cleaned table with row counts before and after removing duplicates."""
    named = coerce_booleans(normalize_strings(standardize_columns(raw)))
    hidden = hash_columns(named, resolve_columns(named, roles.hash))
    kept = drop_columns(hidden, resolve_columns(named, roles.drop))
    subset = [c for c in resolve_columns(named, roles.dedupe) if c in kept.columns]
    unique = materialize(deduplicate(kept, subset, order))
    return materialize(coerce_numeric(unique)), raw.count(), unique.count()


def profile_and_clean(raw: DataFrame, roles: Roles, order: tuple[str, ...] = ()) -> CleanReport:
    """Clean, then profile; the value counts are computed once for all reports."""
    table, before, after = clean_table(raw, roles, order)
    target = standard_name(roles.target) if roles.target else None
    group = standard_name(roles.group) if roles.group else None
    target = target if target in table.columns else None
    group = group if group in table.columns else None

    counts = materialize(value_counts(table))
    profile = materialize(column_profile(table, target, group, counts))
    numeric = numeric_columns(table)
    found = summary_quantiles(table, numeric) if numeric else None
    flags = range_flags(table)
    unwanted = id_like_columns(table, [c for c in (target, group) if c], profile)

    def names(values) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    summary = raw.sparkSession.range(1).select(
        F.lit(before).cast("bigint").alias("original_rows"),
        F.lit(len(raw.columns)).cast("bigint").alias("original_cols"),
        F.lit(after).cast("bigint").alias("cleaned_rows"),
        F.lit(len(table.columns)).cast("bigint").alias("cleaned_cols"),
        F.lit(before - after).cast("bigint").alias("duplicates_removed"),
        names(raw.columns).alias("columns_renamed_from"),
        names(table.columns).alias("columns_final"),
        F.lit(target).cast("string").alias("target_col"),
        F.lit(group).cast("string").alias("group_col"),
        names(roles.drop).alias("drop_cols_applied"),
        names(roles.hash).alias("hash_cols_applied"),
        flags.select(F.map_from_entries(F.collect_list(F.struct("column", "flag")))).scalar().alias("range_flags"),
        names(unwanted).alias("recommended_drop"),
    )
    return CleanReport(
        table=table,
        generator_input=drop_columns(table, unwanted),
        profile=profile,
        classes=class_distribution(table, target) if target else None,
        samples=sample_values(table, counts=counts, profile=profile),
        numbers=numeric_summary(table, numeric, found) if numeric else None,
        outliers=iqr_outliers(table, numeric, found) if numeric else None,
        flags=flags,
        catalogue=schema_catalogue(profile, flags),
        summary=summary,
    )
