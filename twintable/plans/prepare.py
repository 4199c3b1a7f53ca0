"""Mixed raw inputs to flat tables ready for a generator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from twintable.functions.text import NULL_TOKENS
from twintable.operators.clean import coerce_booleans, normalize_strings, to_numeric, union_tables
from twintable.operators.documents import documents_to_table
from twintable.operators.naming import slug_columns
from twintable.operators.sheets import clean_sheets
from twintable.sources.tables import (
    conversion_summary,
    list_files,
    read_documents,
    read_grid,
    read_table,
)

# Columns of a flat product table that are parsed as numbers.
NUMERIC_CANDIDATES = ("mass_g", "recycled_content_pct", "contains_hazardous_substance")


def prepare_flat(df: DataFrame, numeric: Sequence[str] = NUMERIC_CANDIDATES) -> DataFrame:
    """Names, text, booleans and numbers of one flat table."""
    return to_numeric(coerce_booleans(normalize_strings(slug_columns(df))), numeric)


def prepare_documents(texts: DataFrame) -> DataFrame:
    """Documents as one table; types are decided over all of them together."""
    return coerce_booleans(documents_to_table(texts))


def prepare_inputs(
    spark: SparkSession,
    flat: str | None = None,
    grids: str | None = None,
    documents: str | None = None,
    sheet_name: str = "BOM_ENG",
    null_tokens: Sequence[str] = NULL_TOKENS,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables by kind from three globs, and the conversion summary."""
    tables: dict[str, DataFrame] = {}
    summary = []
    if flat:
        tables["flat"] = prepare_flat(read_table(spark, flat, null_tokens=null_tokens))
        name = flat.rsplit("/", 1)[-1]
        summary.append(conversion_summary(tables["flat"], "csv", "converted", "flat", name=name))
    if grids:
        files = [r["path"] for r in list_files(spark, {"grid": grids}).collect()]
        sheets = {p.rsplit("/", 1)[-1]: read_grid(spark, p).drop("file") for p in files}
        tables["grids"] = clean_sheets(sheets, sheet_name)
        summary.append(conversion_summary(tables["grids"], "sheet", "converted", "grids", filled_only=True))
        name = grids.rsplit("/", 1)[-1]
        summary.append(conversion_summary(tables["grids"], "sheet_combined", "combined", "grids", name=name))
    if documents:
        tables["documents"] = prepare_documents(read_documents(spark, documents))
        summary.append(
            conversion_summary(tables["documents"], "document", "converted", "documents", filled_only=True)
        )
        name = documents.rsplit("/", 1)[-1]
        summary.append(
            conversion_summary(tables["documents"], "document_combined", "combined", "documents", name=name)
        )
    return tables, union_tables(summary) if summary else None
