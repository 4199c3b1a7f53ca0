"""Files as they come: ragged sheets, headers in another order, long numbers; samplers that keep values whole."""

import csv
import io
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from twintable.operators.sampling import SAMPLERS, Bootstrap, Marginals, UniformDomain
from twintable.operators.sheets import promote_header
from twintable.sources.tables import infer_types, read_cells, read_documents, read_grid, read_table


def test_ragged_sheets_keep_cells_and_places(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Parts list\n\nx,"two\nlines","say ""hi"""\n,,last\n')
    (tmp_path / "b.csv").write_text("1,2\n")
    rows = {(r.file, r.row_no): r.cells for r in read_cells(spark, str(tmp_path)).collect()}
    assert rows == {
        ("a.csv", 1): ["Parts list"],
        ("a.csv", 2): [],
        ("a.csv", 3): ["x", "two\nlines", 'say "hi"'],
        ("a.csv", 4): [None, None, "last"],
        ("b.csv", 1): ["1", "2"],
    }
    grid = read_grid(spark, str(tmp_path))
    assert grid.columns == ["file", "row_no", "c1", "c2", "c3"] and grid.where("c3 = 'last'").first().row_no == 4


def test_sheets_in_many_splits_equal_the_whole_file(spark, tmp_path):
    rng = random.Random(4)
    cell = lambda: rng.choice(["", "x", '"', 'say "hi", \n\n"', "a,b", "line\r\nbreak", 'half " inch', "  ", "é" * 40, '",\n"', "\n" * 5])
    for name, end in (("a b.csv", "\n"), ("c.csv", "\r\n")):
        out = io.StringIO(newline="")
        for i in range(900):
            csv.writer(out, lineterminator=end, quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL])).writerow([cell() for _ in range(rng.randint(0, 5))] if i % 7 else [f"row {i}"])
            if i % 50 == 0:
                out.write(f'7" pipe,"closed" and more,{i}{end}{end}')
        (tmp_path / name).write_bytes(out.getvalue().encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = sorted((r.file, r.row_no, r.cells) for r in read_cells(spark, str(tmp_path)).collect())
        assert spark.read.text(str(tmp_path), lineSep="\n").rdd.getNumPartitions() > 8
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = []
    for name in ("a b.csv", "c.csv"):
        rows = csv.reader(io.StringIO((tmp_path / name).read_bytes().decode(), newline=""))
        want += [(name, i, [c if c else None for c in row]) for i, row in enumerate(rows, 1)]
    assert got == want


def test_long_cells_and_empty_files(spark, tmp_path):
    long = "x" * 200_000 + "\n" + '""' * 70_000
    (tmp_path / "long.csv").write_text(f'a,"{long}",b\nc\n')
    (tmp_path / "none.csv").write_text("")
    rows = {r.row_no: r.cells for r in read_cells(spark, str(tmp_path)).collect()}
    assert rows == {1: ["a", long.replace('""', '"'), "b"], 2: ["c"]}


def test_names_that_need_escapes(spark, tmp_path):
    folder = tmp_path / "a b"
    folder.mkdir()
    (folder / "x 1.csv").write_text("a,b\r\n1,x\r\n")
    (folder / "y+ %2[z] 2.csv").write_text("b,c\ny,2\n")
    got = {(r.a, r.b, r.c) for r in read_table(spark, str(folder)).collect()}
    assert got == {(1, "x", None), (None, "y", 2)}
    assert {r.file for r in read_cells(spark, str(folder)).collect()} == {"x 1.csv", "y+ %2[z] 2.csv"}
    assert {r.file for r in read_documents(spark, str(folder)).collect()} == {"x 1.csv", "y+ %2[z] 2.csv"}


def test_header_below_a_short_title_is_found(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Parts list\n\nPosition number,Component number,Name\n1,007,bolt\n")
    table = promote_header(read_grid(spark, str(tmp_path / "s.csv")).drop("file"))
    assert table.count() == 1 and len([c for c in table.columns if c != "row_no"]) == 3


def test_columns_meet_by_name(spark, tmp_path):
    (tmp_path / "1.csv").write_text("a,b\n1,x\n")
    (tmp_path / "2.csv").write_text("b,a,c\ny,2,z\n")
    got = {(r.a, r.b, r.c) for r in read_table(spark, [str(tmp_path / "1.csv"), str(tmp_path / "2.csv")]).collect()}
    assert got == {(1, "x", None), (2, "y", "z")}


def test_long_whole_numbers_keep_their_digits(spark):
    df = spark.createDataFrame([("1234567890123456789", "12345678901234567890123", "9" * 40), ("7", " 8 ", "1")], "a string, b string, c string")
    typed = infer_types(df)
    assert dict(typed.dtypes) == {"a": "bigint", "b": "decimal(38,0)", "c": "string"}
    assert {int(r.a) for r in typed.collect()} == {1234567890123456789, 7} and {int(r.b) for r in typed.collect()} == {12345678901234567890123, 8}


def test_samplers_keep_large_keys_and_nested_values(spark):
    big = 1 << 60
    df = spark.range(40).select((F.lit(big) + F.col("id")).alias("k"), F.array(F.col("id") % 3).alias("a"), (F.col("id") % 3).cast("int").alias("v"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 5).cast("int")).alias("d"))
    keys = {r.k for r in df.collect()}
    for kind in (Bootstrap, Marginals):
        assert {r.k for r in kind().fit(df).generate(200).collect()} <= keys
    made = UniformDomain().fit(df).generate(9000)
    assert made.schema == df.schema or [f.dataType for f in made.schema] == [f.dataType for f in df.schema]
    counts = Counter(r.v for r in made.collect())
    assert set(counts) == {0, 1, 2} and all(2700 < n < 3300 for n in counts.values())
    assert {r.k for r in made.select("k").collect()} <= keys


def test_private_network_shows_public_values_only(spark):
    df = spark.range(400).select(F.concat(F.lit("name"), F.col("id")).alias("n"), (F.col("id") % 7).cast("string").alias("s"), (F.col("id") * 1.5).alias("x"))
    sampler = SAMPLERS["private_bayes_network"]
    with pytest.raises(ValueError, match="public domains"):
        sampler(epsilon=0.01).fit(df)
    public = [f"public{i}" for i in range(40)]
    made = sampler(epsilon=0.5, degree=1, domains={"n": public}, bounds={"x": (0.0, 100.0)}).fit(df).generate(500).collect()
    assert {r.n for r in made} <= {None, *public} and all(r.x is None or 0 <= r.x <= 100 for r in made)
    first, second = (sampler(epsilon=0.5, degree=1).fit(df.select("s")).generate(300).groupBy("s").count().collect() for _ in range(2))
    assert sorted(map(tuple, first)) != sorted(map(tuple, second))  # the noise has no known seed
