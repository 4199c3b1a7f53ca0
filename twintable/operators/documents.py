"""Sectioned key/value text to one row per document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from twintable.functions.text import PLACEHOLDER, single_spaced, slug, squish
from twintable.session import materialize

# How the lines of a document are told apart.
END_MARK = "END OF DOCUMENT"
RULE_LINE = r"^[-=]+$"
SECTION_LINE = r"^(\d+)\)\s+(.+)$"
NOTE_SECTION = "IMPORTANT NOTE"
TITLE_START = "DIGITAL PRODUCT PASSPORT"
BULLET = "•"
KEY_LINE = r"^([^:]+):\s*(.+)$"
FIRST_SECTION = "document_header"
JOINT = " || "

# Where a section starts in a tidied text.
SECTION_START = r"(?<![^\n])(?=\d+\) \S|IMPORTANT NOTE)(?![^\n]*END OF DOCUMENT)"

# Lines of one document that are carried in one window.
CHUNK_LINES = 10_000


def classify_lines(lines: DataFrame) -> DataFrame:
    """Tidy lines with their ``kind``, ``key`` and ``value``.

    Kinds: blank, skip, section, note_section, title, bullet, pair, note.
    """
    line = F.col("line")
    kind = (
        F.when(line.isNull() | (line == ""), "blank")
        .when(line.contains(END_MARK) | line.rlike(RULE_LINE), "skip")
        .when(line.rlike(SECTION_LINE), "section")
        .when(line.startswith(NOTE_SECTION), "note_section")
        .when(line.startswith(TITLE_START), "title")
        .when(line.startswith(BULLET), "bullet")
        .when(line.rlike(KEY_LINE), "pair")
        .otherwise("note")
    )
    key = F.when(F.col("kind") == "section", F.regexp_extract(line, SECTION_LINE, 2)).when(
        F.col("kind") == "pair", F.regexp_extract(line, KEY_LINE, 1)
    )
    # a tidy line has no white space left around its parts
    written = F.regexp_extract(line, KEY_LINE, 2)
    value = (
        F.when(F.col("kind") == "pair", F.when(~written.rlike(PLACEHOLDER), written))
        .when(F.col("kind") == "bullet", F.trim(F.regexp_replace(line, f"^{BULLET}+", "")))
        .when(F.col("kind").isin("title", "note"), line)
    )
    return lines.withColumn("kind", kind).withColumns({"key": key, "value": value})


def tidy_text(text: Column) -> Column:
    """A text whose lines are trimmed, single spaced and end in a line feed."""
    lined = F.trim(single_spaced(text))
    # spaces are single here, so a line break has at most one on either side
    for found, put in (("\r\n", "\n"), ("\r", "\n"), (" \n", "\n"), ("\n ", "\n")):
        lined = F.replace(lined, F.lit(found), F.lit(put))
    return lined


def explode_lines(df: DataFrame, file: str, text: str) -> DataFrame:
    """``(file, line_no, line)``, lines tidied, from one text per row."""
    return df.select(F.col(file).alias("file"), F.posexplode(F.split(tidy_text(F.col(text)), "\n")).alias("line_no", "line"))


def sectioned_lines(df: DataFrame, file: str, text: str) -> DataFrame:
    """``(file, line_no, section, line)`` from one text per row, without a shuffle.

    The text is cut in front of its section lines first, so every block knows
    its section from its own first line.
    """
    blocks = df.select(
        F.col(file).alias("file"), F.posexplode(F.split(tidy_text(F.col(text)), SECTION_START)).alias("_block", "_text")
    )
    head = F.substring_index("_text", "\n", 1)
    title = (
        F.when(head.contains(END_MARK), FIRST_SECTION)
        .when(head.rlike(SECTION_LINE), F.regexp_extract(head, SECTION_LINE, 2))
        .when(head.startswith(NOTE_SECTION), "important_note")
        .otherwise(FIRST_SECTION)
    )
    return (
        blocks.withColumn("section", slug(title))
        .select("file", "_block", "section", F.posexplode(F.split("_text", "\n")).alias("_at", "line"))
        .select("file", (F.col("_block").cast("bigint") * 2**31 + F.col("_at")).alias("line_no"), "section", "line")
    )


def carry_section(classified: DataFrame) -> DataFrame:
    """Add the ``section`` (raw title) to lines that are already apart.

    A document may hold a third of all lines, so it is carried in chunks: the
    last title of each chunk is passed on over one row per chunk, and windows
    over lines stay within a chunk.
    """
    mark = F.when(F.col("kind") == "section", F.col("key")).when(F.col("kind") == "note_section", F.lit("important_note"))
    marked = classified.withColumns({"_mark": mark, "_chunk": F.floor(F.col("line_no") / CHUNK_LINES)})
    last_mark = F.max(F.when(F.col("_mark").isNotNull(), F.struct("line_no", "_mark"))).getField("_mark")
    chunks = marked.groupBy("file", "_chunk").agg(last_mark.alias("_last"))
    earlier = Window.partitionBy("file").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    inherited = chunks.select("file", "_chunk", F.last("_last", ignorenulls=True).over(earlier).alias("_inherited"))
    within = Window.partitionBy("file", "_chunk").orderBy("line_no")
    section = F.coalesce(F.last("_mark", ignorenulls=True).over(within), "_inherited", F.lit(FIRST_SECTION))
    return (
        marked.join(inherited, ["file", "_chunk"])
        .withColumn("section", section)
        .drop("_mark", "_chunk", "_inherited")
    )


def line_cells(sectioned: DataFrame) -> DataFrame:
    """``(file, line_no, name, value, overwrite)``: what each line writes where.

    Pairs and titles overwrite, bullets and notes append. ``section`` holds
    slugs already.
    """
    kept = sectioned.where(F.col("kind").isin("title", "bullet", "pair", "note"))
    tail = F.when(F.col("kind") == "bullet", "bullet_items").when(F.col("kind") == "note", "notes").otherwise(slug("key"))
    name = F.when(F.col("kind") == "title", "document_title").otherwise(F.concat_ws("_", "section", tail))
    return kept.select(
        "file", "line_no", name.alias("name"), "value", F.col("kind").isin("title", "pair").alias("overwrite")
    )


def merge_cells(cells: DataFrame) -> DataFrame:
    """``(file, name, value)``: the last overwrite and what was appended after it.

    One aggregate: overwrites fold to the last one, and the lists hold what one
    output cell is made of.
    """
    piece = F.struct("line_no", "value")
    grouped = cells.groupBy("file", "name").agg(
        F.max(F.when(F.col("overwrite"), piece)).alias("_last"),
        F.collect_list(F.when(~F.col("overwrite") & F.col("value").isNotNull(), piece)).alias("_added"),
    )
    start = F.coalesce(F.col("_last").getField("line_no"), F.lit(-1))
    added = F.sort_array(F.filter("_added", lambda p: p.getField("line_no") > start))
    base = F.array_compact(F.array(F.col("_last").getField("value")))
    texts = F.concat(base, F.transform(added, lambda p: p.getField("value")))
    return grouped.select("file", "name", squish(F.array_join(texts, JOINT)).alias("value"))


def document_cells(texts: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """``(file, name, value)`` of all documents in long form, with one shuffle."""
    return merge_cells(line_cells(classify_lines(sectioned_lines(texts, file, text))))


def documents_to_maps(texts: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """``(file, cells)``: every document with its cells that have a value, by name, however many names there are."""
    cells = document_cells(texts, file, text).where(F.col("value").isNotNull())
    maps = cells.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("cells"))
    files = texts.select(F.col(file).alias("file"))
    return files.join(maps, "file", "left").select("file", F.coalesce("cells", F.create_map().cast("map<string,string>")).alias("cells"))


def documents_to_table(
    texts: DataFrame,
    file: str = "file",
    text: str = "text",
    names: Sequence[str] | None = None,
    max_columns: int | None = None,
    source_type: str = "text",
) -> DataFrame:
    """One row per document, one column per cell name that has a value anywhere.

    Without ``names`` they are looked up, as many as there are columns in the result; more than
    ``max_columns`` is an error if that is given. Where names don't make columns,
    ``documents_to_maps`` has them all.
    """
    cells = document_cells(texts, file, text)
    if names is None:
        cells = materialize(cells)
        found = cells.where(F.col("value").isNotNull()).select("name").distinct()
        found = (found if max_columns is None else found.limit(max_columns + 1)).collect()
        if max_columns is not None and len(found) > max_columns:
            raise ValueError(f"more than {max_columns} cell names")
        names = sorted(r["name"] for r in found)
    files = texts.select(F.col(file).alias("file"))
    source = [F.col("file").alias("source_file"), F.lit(source_type).alias("source_type")]
    if not names:
        return files.select(*source)
    table = cells.groupBy("file").pivot("name", list(names)).agg(F.first("value"))
    return files.join(table, "file", "left").select(*source, *names)
