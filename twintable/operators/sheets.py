"""Spreadsheet grids (text cells by row number) to tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from twintable.functions.text import slug_text, squish
from twintable.operators.clean import (
    drop_empty,
    force_string,
    normalize_strings,
    to_numeric,
    union_tables,
    with_provenance,
)
from twintable.operators.naming import slug_columns

# Where the header row is looked for and how it is recognised.
HEADER_ROWS = 30
HEADER_CELLS = 25
HEADER_MARKS = ("position number", "component number")

# Columns kept as text, and columns parsed as numbers.
CODE_COLUMNS = (
    "resolution",
    "position_number",
    "assembly_indicator",
    "component_number",
    "base_amount",
    "compensation_unit",
    "vi_material",
)
NUMBER_COLUMNS = ("componentmng_kme", "vi_recommendation")


def header_row(grid: DataFrame, marks: Sequence[str] = HEADER_MARKS) -> tuple[int, dict[str, str]]:
    """Row number of the header and its cells by grid column; one row is fetched."""
    cells = [c for c in grid.columns if c != "row_no"]
    joined = F.lower(F.concat_ws(" | ", *[squish(F.col(c)) for c in cells[:HEADER_CELLS]]))
    near_top = grid.where(F.col("row_no") <= HEADER_ROWS)
    for mark in marks:
        near_top = near_top.where(F.contains(joined, F.lit(mark)))
    found = near_top.select("row_no", *[squish(F.col(c)).alias(c) for c in cells]).orderBy("row_no").first()
    if found is None:
        raise ValueError(f"no header row with {' and '.join(marks)} in the first {HEADER_ROWS} rows")
    return found["row_no"], {c: found[c] for c in cells if found[c]}


def promote_header(grid: DataFrame, marks: Sequence[str] = HEADER_MARKS) -> DataFrame:
    """Rows below the header that have a value, named by the header cells.

    A header text that occurs twice keeps its last column.
    """
    at, names = header_row(grid, marks)
    column_of = {name: c for c, name in names.items()}
    filled = F.coalesce(*[squish(F.col(c)) for c in names]).isNotNull()
    body = grid.where((F.col("row_no") > at) & filled)
    return body.select(*[F.col(c).alias(name) for name, c in column_of.items()])


def clean_sheet(grid: DataFrame, file_name: str, sheet_name: str, name_suffix: str = "_BOM") -> DataFrame:
    """A sheet as a table: names, codes as text, numbers, empty parts, provenance."""
    table = slug_columns(promote_header(grid))
    table = force_string(table, CODE_COLUMNS, suffix="_number")
    table = to_numeric(normalize_strings(table), NUMBER_COLUMNS)
    table = drop_empty(table)
    stem = file_name.rsplit(".", 1)[0]
    return with_provenance(
        table, product_scope=slug_text(stem.replace(name_suffix, "")), sheet=sheet_name, file=file_name
    )


def clean_sheets(grids: dict[str, DataFrame], sheet_name: str) -> DataFrame:
    """All sheets of one kind, stacked."""
    return union_tables([clean_sheet(g, name, sheet_name) for name, g in sorted(grids.items())])
