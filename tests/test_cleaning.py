import pytest
from pyspark.sql import functions as F

from twintable.functions.text import slug, slug_text
from twintable.operators import clean
from twintable.operators.naming import number_repeats, resolve_columns, standard_name
from twintable.sources.tables import infer_types, list_files, read_table, snapshot, write_metrics, write_table
from twintable.spec import resolve_role


def test_names():
    assert standard_name("  Mass  (g) ") == "mass_g"
    assert standard_name("***") == "col"
    assert standard_name("Größe %") == "größe"
    assert number_repeats(["a", "a", "a_2", "a"]) == ["a", "a_2", "a_2_2", "a_3"]
    assert slug_text("END‑OF‑LIFE (H×W)") == "endoflife_hw"
    assert slug_text("Grösse_—_2") == "grosse_2"
    assert slug_text("—") == "col"


def test_slug_keeps_nulls(spark):
    df = spark.createDataFrame([("A b",), (None,), ("A b",)], "x string")
    assert sorted(str(r[0]) for r in df.select(slug("x")).collect()) == ["None", "a_b", "a_b"]


def test_csv_missing_tokens_and_types(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('Part.No,region,w,n,mixed\n007,NA,1.5,1,1d\nnull,NaN, 2 ,2,2\n009,"a, ""b""",,3,x\n')
    df = read_table(spark, str(path))
    assert dict(df.dtypes) == {"Part.No": "bigint", "region": "string", "w": "double", "n": "bigint", "mixed": "string"}
    rows = sorted(df.collect(), key=lambda r: r["n"])
    assert [r["region"] for r in rows] == ["NA", None, 'a, "b"']
    assert [r["Part.No"] for r in rows] == [7, None, 9]
    assert read_table(spark, str(path), infer=False).dtypes[0] == ("Part.No", "string")


def test_empty_and_all_null(spark):
    df = spark.createDataFrame([(None, "1"), (None, None)], "a string, b string")
    assert dict(infer_types(df).dtypes) == {"a": "string", "b": "bigint"}
    kept = clean.drop_empty(df)
    assert kept.columns == ["b"] and kept.count() == 1
    assert clean.coerce_booleans(df).dtypes == [("a", "string"), ("b", "bigint")]
    nothing = df.where("false")
    assert clean.numeric_like_columns(nothing) == []


def test_numeric_rate_is_strict(spark):
    exactly = spark.createDataFrame([(str(i),) for i in range(19)] + [("x",)], "v string")
    assert clean.coerce_numeric(exactly).dtypes == [("v", "string")]
    above = spark.createDataFrame([("1,000",)] * 20 + [("x",)], "v string")
    done = clean.coerce_numeric(above)
    assert done.dtypes == [("v", "double")]
    assert done.where("v = 1000").count() == 20 and done.where("v is null").count() == 1


def test_squish_handles_unicode_space(spark):
    df = spark.createDataFrame([(" a  b\t\n",), ("  ",)], "x string")
    assert [r[0] for r in clean.normalize_strings(df).collect()] == ["a b", None]


def test_deduplicate_keeps_first(spark):
    df = spark.createDataFrame([(1, 9, "c"), (1, 2, "b"), (2, 5, None), (1, 2, "a")], "k int, o int, v string")
    rows = {tuple(r) for r in clean.deduplicate(df, ["k"], ["o", "v"]).collect()}
    assert rows == {(1, 2, "a"), (2, 5, None)}
    assert clean.deduplicate(df.unionByName(df)).count() == 4


def test_guards(spark):
    df = spark.createDataFrame([("a", 1), ("a", None)], "k string, v int")
    with pytest.raises(ValueError, match="v"):
        clean.require_complete(df)
    with pytest.raises(ValueError, match="classes"):
        clean.require_classes(df, "k")
    with pytest.raises(ValueError, match="not found"):
        resolve_role(df, "nope", required=True)
    assert resolve_role(df, " K ") == "k" and resolve_role(df, None) is None
    assert resolve_columns(df, ["K", "x", "V"]) == ["k", "v"]
    assert clean.leakage_columns(["my_label", "target_x", "grp_class", "ok"], group="grp_class") == ["my_label", "target_x"]


def test_proxy_label_without_optional_columns(spark):
    df = spark.createDataFrame([(60.0,), (5.0,), (None,)], "recycled_content_pct double")
    assert [r[0] for r in clean.proxy_label(df).select("recyclability_bin").collect()] == ["Medium", "Low", "Medium"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a,\"b", None), ("NA", 2)], "s string, n int")
    write_table(df, str(tmp_path / "out_csv"))
    back = read_table(spark, str(tmp_path / "out_csv"))
    assert sorted(str(r["s"]) for r in back.collect()) == ["NA", 'a,"b']
    write_metrics(df, str(tmp_path / "out_json"))
    assert spark.read.json(str(tmp_path / "out_json")).count() == 2
    assert snapshot(df, str(tmp_path / "frozen")).count() == 2
    (tmp_path / "b.txt").write_text("x")
    (tmp_path / "a.txt").write_text("yy")
    found = list_files(spark, {"text": f"{tmp_path}/*.txt"}).collect()
    assert [(r["source_file"], r["bytes"]) for r in found] == [("a.txt", 2), ("b.txt", 1)]


def test_drop_rare_classes_with_hot_class(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 1000, "hot").otherwise(F.concat(F.lit("c"), F.floor(F.col("id") / 4))).alias("k"))
    kept = clean.drop_rare_classes(df, "k", 5)
    assert kept.count() == 1000
