"""Reading flat tables, sectioned text and files by pattern; writing results."""

from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Sequence
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from twintable.functions.text import NULL_TOKENS, NUMBER, WHOLE_NUMBER, missing_to_null, parse_double
from twintable.session import materialize
from twintable.spec import column, string_columns


def infer_types(df: DataFrame) -> DataFrame:
    """Whole numbers and numbers for string columns whose every value is one.

    Whole numbers become bigint, beyond it decimals of 38 digits, beyond those they stay
    text: no digit is lost.

    All columns are judged in one aggregate; nothing but its one row reaches
    the driver.
    """
    columns = string_columns(df)
    if not columns:
        return df
    tests = []
    for c in columns:
        value = column(c)
        whole = F.when(value.rlike(WHOLE_NUMBER), F.trim(value))
        tests += [
            (F.bool_and(value.rlike(WHOLE_NUMBER))).alias(f"w_{c}"),
            (F.bool_and(value.isNull() | whole.try_cast("bigint").isNotNull())).alias(f"b_{c}"),
            (F.bool_and(value.isNull() | whole.try_cast("decimal(38,0)").isNotNull())).alias(f"d_{c}"),
            (F.bool_and(value.rlike(NUMBER))).alias(f"n_{c}"),
        ]
    verdict = df.agg(*tests).first()
    typed = {}
    for c in columns:
        if verdict[f"w_{c}"] and verdict[f"b_{c}"]:
            typed[c] = F.trim(column(c)).try_cast("bigint")
        elif verdict[f"w_{c}"] and verdict[f"d_{c}"]:
            typed[c] = F.trim(column(c)).try_cast("decimal(38,0)")
        elif verdict[f"w_{c}"]:
            continue  # whole numbers of more digits stay text, a double would change them
        elif verdict[f"n_{c}"]:
            typed[c] = parse_double(column(c))
    return df.withColumns(typed)


def null_tokens_to_null(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    return df.withColumns({c: missing_to_null(column(c), tokens) for c in string_columns(df)})


def read_table(
    spark: SparkSession,
    path: str | list[str],
    fmt: str = "csv",
    null_tokens: Sequence[str] = NULL_TOKENS,
    infer: bool = True,
    multi_line: bool = False,
) -> DataFrame:
    """A flat table. CSV cells equal to a null token become null, then types follow.

    Files with different headers are put together by column name; a column that a file
    lacks is null there. Formats with types of their own are read as they are.
    ``multi_line`` allows line breaks inside quoted cells, at the price of files that
    cannot be split.
    """
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    raw = None
    for files in same_header(spark, path):
        part = spark.read.csv(files, header=True, inferSchema=False, multiLine=multi_line, escape='"')
        raw = part if raw is None else raw.unionByName(part, allowMissingColumns=True)
    table = null_tokens_to_null(raw, null_tokens)
    return infer_types(table) if infer else table


def same_header(spark: SparkSession, path: str | list[str]) -> list[str | list[str]]:
    """The files of ``path`` in groups of one header line each; one group is the path itself.

    Files are listed without their content, and a task opens each once for its first line.
    One row a header, with its files, reaches the driver, as the reader takes names from there.
    """
    files = spark.read.format("binaryFile").load(path).select("path")
    firsts = materialize(files.repartition(F.col("path")).mapInArrow(_first_lines, "path string, header binary"))
    kinds = firsts.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("files")).orderBy(F.element_at("files", 1)).collect()
    return [path] if len(kinds) < 2 else [[_literal(f) for f in r["files"]] for r in kinds]


def _literal(path: str) -> str:
    """A path whose characters stand for themselves where patterns are allowed."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _open(path: str):
    """A file named as Spark names it, without escapes, as a stream."""
    scheme, _, rest = path.partition(":")
    if scheme == "file" or path.startswith("/"):
        return LocalFileSystem().open_input_stream("/" + (rest if scheme == "file" else path).lstrip("/"))
    folder, name = FileSystem.from_uri(quote(path, safe=":/@"))
    return folder.open_input_stream(name)


def _first_lines(batches):
    for batch in batches:
        heads = []
        for path in batch.column("path").to_pylist():
            head = b""
            with _open(path) as stream:
                while b"\n" not in head and (more := stream.read(1 << 16)):
                    head += more
            heads.append(head.split(b"\n", 1)[0].rstrip(b"\r"))
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(heads, pa.binary())], names=["path", "header"])


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted cell is still open after ``line``, given whether one is before it.

    A quote opens a cell only where the cell begins, two quotes inside are one, and what
    follows a closing quote belongs to the cell up to the next comma.
    """
    at = 0
    while True:
        if not inside and line.startswith('"', at):
            inside, at = True, at + 1
        if inside:
            close = line.find('"', at)
            while close >= 0 and line.startswith('"', close + 1):
                close = line.find('"', close + 2)
            if close < 0:
                return True
            inside, at = False, close + 1
        comma = line.find(",", at)
        if comma < 0:
            return False
        at = comma + 1


_LINES = pa.schema([(n, pa.string() if n in ("file", "value") else pa.bool_() if n.startswith("open") else pa.int64()) for n in "file split line value record0 record1 open0 open1".split()])


def _numbered_lines(batches):
    """Lines with their place in their split, and their row there if the split begins outside a cell (0) or inside (1).

    ``record`` counts the rows that end before a line, ``open`` tells whether a cell is open after it.
    """
    place, line, record, open_ = None, 0, [0, 0], [False, True]
    for batch in batches:
        out: dict[str, list] = {n: [] for n in _LINES.names}
        for file, split, value in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (file, split) != place:
                place, line, record, open_ = (file, split), 0, [0, 0], [False, True]
            before = list(record)
            if '"' in value:
                open_ = [ends_inside(value, o) for o in open_]
            for i in (0, 1):
                record[i] += not open_[i]
            for n, v in zip(_LINES.names, (file, split, line, value, *before, *open_), strict=True):
                out[n].append(v)
            line += 1
        yield pa.RecordBatch.from_pydict(out, schema=_LINES)


def _parsed(batches):
    csv.field_size_limit(sys.maxsize)
    for batch in batches:
        cells = []
        for text in batch.column("text").to_pylist():
            row = next(csv.reader(io.StringIO(text, newline="")), [])
            cells.append([c if c else None for c in row])
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("row_no"), pa.array(cells, pa.list_(pa.string()))], names=["file", "row_no", "cells"])


def read_grid(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A headerless sheet exported as CSV: ``file, row_no`` and text cells ``c1..cN``."""
    cells = read_cells(spark, path)
    width = cells.agg(F.max(F.size("cells"))).first()[0] or 1
    return cells.select("file", "row_no", *[F.get("cells", F.lit(i)).alias(f"c{i + 1}") for i in range(max(1, width))])


def read_cells(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Sheets exported as CSV: ``file, row_no, cells``, each row with the cells it has.

    Rows end with a line feed, after a carriage return or without; a quoted cell may hold line
    breaks. Blank lines are rows without cells, so ``row_no`` is the place in the file. A large
    file is many tasks' work: each reads its split's lines for both cases, that it begins inside
    a quoted cell and that it doesn't; the splits of a file, one after the other, tell which
    holds; then the lines of a row meet.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
    ddl = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'boolean' if f.type == pa.bool_() else 'bigint'}" for f in _LINES)
    lines = materialize(lines.mapInArrow(_numbered_lines, ddl))
    last = F.max_by(F.struct(*[F.struct((F.col(f"record{i}") + (~F.col(f"open{i}")).cast("bigint")).alias("rows"), F.col(f"open{i}").alias("open")).alias(f"s{i}") for i in (0, 1)]), "line")
    splits = lines.groupBy("file", "split").agg(last.alias("s"))
    # one row a file, one entry for each split of it
    in_order = splits.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("split", "s"))).alias("all"))
    start = F.struct(F.array().cast("array<struct<split:bigint,row:bigint,inside:boolean>>").alias("found"), F.lit(0).cast("bigint").alias("row"), F.lit(False).alias("inside"))

    def step(held, x):
        own = F.when(held["inside"], x["s"]["s1"]).otherwise(x["s"]["s0"])
        entry = F.struct(x["split"].alias("split"), held["row"].alias("row"), held["inside"].alias("inside"))
        return F.struct(F.concat(held["found"], F.array(entry)).alias("found"), (held["row"] + own["rows"]).alias("row"), own["open"].alias("inside"))

    starts = in_order.select("file", F.inline(F.aggregate("all", start, step, lambda held: held["found"])))
    placed = lines.join(starts, ["file", "split"]).select(
        "file", (F.col("row") + F.when(F.col("inside"), F.col("record1")).otherwise(F.col("record0")) + 1).alias("row_no"), F.struct("split", "line", "value").alias("piece")
    )
    pieces = F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["value"])
    rows = placed.groupBy("file", "row_no").agg(F.array_join(pieces, "\n").alias("text"))
    cells = rows.mapInArrow(_parsed, "file string, row_no bigint, cells array<string>")
    return materialize(cells.withColumn("file", _plain_name(F.element_at(F.split("file", "/"), -1))))


def _plain_name(name: Column) -> Column:
    """A file's name without the escapes that paths have."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text documents, one per file, as ``(file, text)``."""
    return spark.read.text(path, wholetext=True).select(_plain_name(F.col("_metadata.file_name")).alias("file"), F.col("value").alias("text"))


def list_files(spark: SparkSession, patterns: dict[str, str]) -> DataFrame:
    """``(source_type, source_file, path, bytes)`` of the files behind each glob, sorted."""
    found = None
    for source_type, pattern in patterns.items():
        # only file facts are selected, so no content is read
        part = (
            spark.read.format("binaryFile")
            .load(pattern)
            .select(
                F.lit(source_type).alias("source_type"),
                F.element_at(F.split("path", "/"), -1).alias("source_file"),
                "path",
                F.col("length").alias("bytes"),
            )
        )
        found = part if found is None else found.unionByName(part)
    return found.orderBy("source_type", "source_file")


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    options = {"header": True, "escape": '"'} if fmt == "csv" else {}
    df.write.mode(mode).format(fmt).options(**options).save(path)


def write_metrics(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Metric rows as JSON lines, null fields kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def snapshot(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Freeze a table before it is used, and read the frozen copy."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.parquet(path)


def conversion_summary(
    df: DataFrame, source_type: str, status: str, output: str, file_col: str | None = "source_file",
    name: str | None = None, filled_only: bool = False,
) -> DataFrame:
    """Rows and columns per source file (or of the whole table under ``name``).

    With ``filled_only`` a file counts only the columns it has values in.
    """
    columns = F.lit(len(df.columns))
    if filled_only:
        columns = sum((F.coalesce(F.max(F.col(c).isNotNull().cast("int")), F.lit(0)) for c in df.columns), F.lit(0))
    measures = [F.count(F.lit(1)).alias("rows"), columns.cast("bigint").alias("columns")]
    source = F.col(file_col) if name is None else F.lit(name)
    if name is None:
        rows = df.groupBy(source.alias("_file")).agg(*measures)
    else:
        rows = df.agg(*measures).withColumn("_file", source)
    return rows.select(
        F.col("_file").alias("source_file"),
        F.lit(source_type).alias("source_type"),
        F.lit(status).alias("status"),
        "rows",
        "columns",
        F.lit(output).alias("output_file"),
    )
