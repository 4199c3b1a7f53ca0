import random
import re

import pytest
from pyspark.sql import functions as F

from twintable.functions.text import BLANK, WHITE, squish
from twintable.operators.documents import carry_section, classify_lines, documents_to_maps, documents_to_table, explode_lines, tidy_text
from twintable.operators import documents
from twintable.operators.sheets import clean_sheet, clean_sheets, promote_header
from twintable.plans.prepare import prepare_documents, prepare_inputs

TEXT = """DIGITAL PRODUCT PASSPORT (TXT)  — Box
=====
Loose remark
7)  not numbered: but a pair
IMPORTANT NOTE
-----
first line
Key: in note
1) SIZE & WEIGHT
Mass: 3 kg
Mass:   4 kg
Empty: (Enter it)
• one
••  two
words
notes: replaced
more words
Recycled: yes
2) END OF DOCUMENT
END OF DOCUMENT (really)
"""


CELLS = {
    "document_title": "DIGITAL PRODUCT PASSPORT (TXT) — Box",
    "document_header_notes": "Loose remark",
    "important_note_notes": "first line",
    "important_note_key": "in note",
    "size_weight_mass": "4 kg",
    "size_weight_bullet_items": "one || two",
    "size_weight_notes": "replaced || more words",
    "size_weight_recycled": "yes",
}


def test_document_table(spark):
    other = TEXT.replace("4 kg", "5 kg").replace("\n", "\r\n") + "trailing: 1\r\n"
    df = spark.createDataFrame([("a.txt", TEXT), ("b.txt", other), ("empty.txt", "\n")], "file string, text string")
    rows = {r["source_file"]: r.asDict() for r in documents_to_table(df).collect()}
    for name, cells in (("a.txt", CELLS), ("b.txt", CELLS | {"size_weight_mass": "5 kg", "size_weight_trailing": "1"})):
        assert {k: v for k, v in rows[name].items() if v is not None and not k.startswith("source_")} == cells
    assert all(v is None for k, v in rows["empty.txt"].items() if not k.startswith("source_"))


def test_types_are_decided_over_all_documents(spark):
    df = spark.createDataFrame([("a", "Ok: yes\nN: 1"), ("b", "Ok: No\nN: 2")], "file string, text string")
    table = prepare_documents(df)
    assert dict(table.dtypes)["document_header_ok"] == "bigint"
    assert dict(table.dtypes)["document_header_n"] == "string"


def test_too_many_names(spark):
    df = spark.createDataFrame([("a", "k1: 1\nk2: 2\nk3: 3")], "file string, text string")
    with pytest.raises(ValueError, match="more than 2"):
        documents_to_table(df, max_columns=2)


def test_carry_section_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(documents, "CHUNK_LINES", 3)
    text = "\n".join(["x"] * 4 + ["1) First"] + ["y"] * 8 + ["2) Second", "z"])
    df = spark.createDataFrame([("f", text)], "file string, text string")
    rows = carry_section(classify_lines(explode_lines(df, "file", "text"))).orderBy("line_no").collect()
    assert [r["section"] for r in rows] == ["document_header"] * 4 + ["First"] * 9 + ["Second"] * 2


GRID = [
    (1, "Title", None, None, None),
    (2, "Position number", "", "Component Number", "Vi  recommendation"),
    (3, "001", "ignored", "0042", "7"),
    (4, None, "ignored", None, " "),
    (5, "002", None, "A-1", "high"),
]


def test_sheets(spark):
    grid = spark.createDataFrame(GRID, "row_no int, c1 string, c2 string, c3 string, c4 string")
    assert promote_header(grid).count() == 2
    table = clean_sheet(grid, "Heat pump_BOM.csv", "Parts").orderBy("position_number")
    assert [tuple(r)[:3] for r in table.collect()] == [("001", "0042", 7.0), ("002", "A-1", None)]
    both = clean_sheets({"b_BOM.csv": grid, "a_BOM.csv": grid.drop("c4")}, "Parts")
    assert both.count() == 4 and both.where("source_product_scope = 'a'").where("vi_recommendation is null").count() == 2
    with pytest.raises(ValueError, match="header"):
        promote_header(grid.where("row_no > 2"))


def test_prepare_inputs(spark, tmp_path):
    (tmp_path / "goods.csv").write_text("Mass (g),Is OK?,region\n1.5, Yes,NA\nbad,no,EU\n")
    (tmp_path / "d1.txt").write_text(TEXT)
    (tmp_path / "d2.txt").write_text("Only: this\n")
    sheet = "\n".join(",".join(c or "" for c in row[1:]) for row in GRID)
    (tmp_path / "x_BOM.csv").write_text(sheet + "\n")
    tables, summary = prepare_inputs(
        spark, f"{tmp_path}/goods.csv", f"{tmp_path}/*_BOM.csv", f"{tmp_path}/d*.txt", "Parts"
    )
    flat = tables["flat"].orderBy("is_ok").collect()
    assert [(r["is_ok"], r["region"]) for r in flat] == [(0, "EU"), (1, "NA")]
    assert tables["grids"].count() == 2 and tables["documents"].count() == 2
    rows = {(r["source_file"], r["status"]): (r["rows"], r["columns"]) for r in summary.collect()}
    assert rows[("goods.csv", "converted")] == (2, 3)
    assert rows[("d2.txt", "converted")] == (1, 3)
    assert rows[("d*.txt", "combined")][0] == 2


def test_maps_have_all_names_and_all_documents(spark):
    wide = "\n".join(f"k{i}: {i}" for i in range(12_000))
    df = spark.createDataFrame([("wide", wide), ("none", ""), ("null", None), ("few", "a: 1\nb: not specified")], "file string, text string")
    cells = {r["file"]: r["cells"] for r in documents_to_maps(df).collect()}
    assert cells["wide"] == {f"document_header_k{i}": str(i) for i in range(12_000)}
    assert cells["none"] == cells["null"] == {} and cells["few"]["document_header_a"] == "1"


def test_white_space_as_the_patterns_say(spark):
    parts = [" ", "  ", "\t", "\n", "\r", "\r\n", "a", "1) b", " ", "　", "é", "\x0b", "\x1c", "\x85", " ", ":"]
    draw = random.Random(1)
    texts = ["".join(draw.choice(parts[: 8 if i % 2 else 16]) for _ in range(draw.randint(0, 20))) for i in range(4000)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    for r in df.select("t", squish(F.col("t")).alias("s"), tidy_text(F.col("t")).alias("y")).collect():
        if r["t"] is None:
            assert r["s"] is None and r["y"] is None
            continue
        assert r["s"] == (re.sub(f"[{WHITE}]+", " ", r["t"]).strip(" ") or None)
        assert r["y"] == re.sub(" ?(?:\r\n|\r|\n) ?", "\n", re.sub(f"[{BLANK}]+", " ", r["t"]).strip(" "))


def test_line_breaks_need_no_pattern(spark):
    plan = spark.range(1).select(tidy_text(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert "?:" not in plan and "octet_length" in plan
