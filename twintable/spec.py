"""Roles of columns and row rules, passed between operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The columns of a product table that the default rules know.
POSITIVE_COLUMNS = ("mass_g",)
PERCENT_COLUMNS = ("recycled_content_pct",)
FLAG_COLUMNS = ("compliance_rohs", "contains_hazardous_substance")
RARE_COMBINATION_COLUMNS = ("supplier_region", "component_type", "material_main")


@dataclass(frozen=True)
class Rules:
    """Domain rules; each applies only where its column exists."""

    positive: tuple[str, ...] = POSITIVE_COLUMNS
    percent: tuple[str, ...] = PERCENT_COLUMNS
    flags: tuple[str, ...] = FLAG_COLUMNS


@dataclass(frozen=True)
class Roles:
    """Which column is predicted, which one groups rows, and what to do with others."""

    target: str | None = None
    group: str | None = None
    drop: tuple[str, ...] = ()
    hash: tuple[str, ...] = ()
    dedupe: tuple[str, ...] = ()
    rare_keys: tuple[str, ...] = RARE_COMBINATION_COLUMNS
    rules: Rules = field(default_factory=Rules)


def column(name: str) -> Column:
    """A column by its literal name, dots and all."""
    quoted = name.replace("`", "``")
    return F.col(f"`{quoted}`")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def feature_types(df: DataFrame, target: str | None) -> tuple[list[str], list[str]]:
    """Numeric and categorical feature names, the target left out."""
    numeric = [c for c in numeric_columns(df) if c != target]
    rest = [c for c in df.columns if c != target and c not in numeric]
    return numeric, rest


def resolve_role(df: DataFrame, name: str | None, required: bool = False) -> str | None:
    """The column a user means by ``name``: in normalised form, else as given."""
    if name:
        for candidate in (name.strip().lower().replace(" ", "_"), name):
            if candidate in df.columns:
                return candidate
    if required:
        raise ValueError(f"column not found: {name}")
    return None
