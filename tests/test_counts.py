import bisect
import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from twintable.operators import selection
from twintable.operators.counts import numeric_counts, quantile_name, quantiles, running_totals, value_counts
from twintable.operators.profile import column_profile, iqr_outliers, numeric_summary, range_flags


def test_quantiles_with_a_hot_value(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([np.full(4000, 7.25), rng.normal(size=8000) * 50])
    df = spark.createDataFrame([(float(v), None if i % 3 else float(-v)) for i, v in enumerate(values)], "a double, b double")
    probs = [0.0, 0.01, 0.33, 0.5, 0.975, 1.0]
    found = {r["column"]: r for r in quantiles(df.repartition(7), ["a", "b"], probs).collect()}
    for name, data in (("a", values), ("b", -values[::3])):
        assert found[name]["n"] == len(data)
        for p in probs:
            assert found[name][quantile_name(p)] == pytest.approx(np.quantile(data, p), abs=1e-9)


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (9.0, 2)], "x double, w bigint")
    row = quantiles(df, ["x"], [0.5, 0.9], weight="w").first()
    expanded = [1.0, 1.0, 1.0, 2.0, 9.0, 9.0]
    assert (row["p50"], row["p90"]) == pytest.approx((np.quantile(expanded, 0.5), np.quantile(expanded, 0.9)))


@pytest.mark.parametrize("cells,listed", [(1024, 4096), (4, 3)])
def test_selection_equals_sorting(spark, monkeypatch, cells, listed):
    monkeypatch.setattr(selection, "CELLS", cells)
    monkeypatch.setattr(selection, "LISTED", listed)
    rng = np.random.default_rng(8)
    inf = float("inf")
    data = {
        "skewed": list(10.0 ** rng.uniform(-300, 300, 900)) + [-1.5] * 100,
        "hot": [7.25] * 700 + list(rng.normal(size=300)),
        "wide": [1.7e308, -1.7e308] * 20 + [0.0, -0.0] * 20 + [None] * 920,
        "tiny": [5e-324 * (i % 3) for i in range(1000)],
        "endless": [inf, -inf] * 3 + list(range(94)) + [float("nan")] * 900,
        "none": [None] * 1000,
    }
    rows = [tuple(None if v is None else float(v) for v in r) for r in zip(*data.values(), strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in data)).repartition(5)
    probs = [0.0, 0.01, 0.2, 0.5, 0.77, 1.0]
    got = {r["column"]: r for r in selection.exact_quantiles(df, list(data), probs).collect()}
    assert set(got) == set(data) - {"none"}
    for c in got:
        values = np.sort([v for v in data[c] if v is not None and v == v])
        assert got[c]["n"] == len(values)
        for p in probs:
            at = p * (len(values) - 1)
            low, high = values[int(np.floor(at))], values[int(np.ceil(at))]
            want = low if low == high else low + (high - low) * (at - np.floor(at))
            assert got[c][quantile_name(p)] == want, (c, p)


def test_selection_with_weights_and_without_rows(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (9.0, 2), (None, 50)], "x double, w bigint")
    row = selection.exact_quantiles(df, ["x"], [0.5, 0.9], weight="w").first()
    expanded = [1.0, 1.0, 1.0, 2.0, 9.0, 9.0]
    assert row["n"] == 6 and (row["p50"], row["p90"]) == pytest.approx((np.quantile(expanded, 0.5), np.quantile(expanded, 0.9)))
    assert selection.exact_quantiles(df.limit(0), ["x"], [0.5]).count() == 0


@settings(max_examples=4, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=30), st.integers(1, 6))
def test_running_totals_do_not_depend_on_partitions(spark, values, parts):
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(parts)
    got = {r["value"]: (r["n"], r["upto_n"], r["all_n"]) for r in running_totals(numeric_counts(df, ["v"]), ["n"]).collect()}
    want = {float(v): (values.count(v), sum(x <= v for x in values), len(values)) for v in set(values)}
    assert got == want


def test_value_counts_types(spark):
    df = spark.createDataFrame([(0.0, 1, "x"), (-0.0, 1, None), (None, 2, None)], "d double, i int, s string")
    got = {(r["column"], r["value"]): r["n"] for r in value_counts(df).collect()}
    assert got == {
        ("d", "0.0"): 2, ("d", None): 1, ("i", "1"): 2, ("i", "2"): 1, ("s", "x"): 1, ("s", None): 2,
    }


def test_profile_of_empty_table(spark):
    df = spark.createDataFrame([], "a double, my_id string")
    rows = {r["column"]: r for r in column_profile(df).collect()}
    assert rows["a"]["inferred_role"] == "unknown" and rows["a"]["non_null_count"] == 0
    assert rows["my_id"]["is_id_like"] and not rows["a"]["is_id_like"]


def test_roles(spark):
    df = spark.range(200).select(
        F.when(F.col("id") % 2 == 0, " Yes").otherwise("n").alias("answer"),
        F.concat(F.lit("v"), F.col("id") % 40).alias("forty"),
        F.concat(F.lit("v"), F.col("id") % 41).alias("forty_one"),
        (F.col("id") % 2 * 4 + 3).alias("two_numbers"),
        F.col("id").cast("string").alias("unique_text"),
    )
    rows = {r["column"]: r for r in column_profile(df, target="answer").collect()}
    assert {c: r["inferred_role"] for c, r in rows.items()} == {
        "answer": "binary", "forty": "categorical", "forty_one": "text_or_id", "two_numbers": "binary",
        "unique_text": "text_or_id",
    }
    assert rows["unique_text"]["is_id_like"] and rows["answer"]["is_target"]


def test_summary_and_outliers(spark):
    data = [float(i) for i in range(20)] + [500.0]
    df = spark.createDataFrame([(v, 1.0, v - 600) for v in data], "v double, flat double, net_weight double")
    row = numeric_summary(df).where("column = 'v'").first()
    assert row["std"] == pytest.approx(np.std(data, ddof=1)) and row["p95"] == pytest.approx(np.quantile(data, 0.95))
    found = {r["column"]: r["outlier_count"] for r in iqr_outliers(df).collect()}
    assert found == {"v": 1, "net_weight": 1}
    assert [tuple(r) for r in range_flags(df).collect()] == [("net_weight", "negative_values_in_quantity_like_column")]
    assert iqr_outliers(df.limit(9)).count() == 0


def test_upto_by_halving(spark):
    marks = [-math.inf, -2.5, 0.0, 0.5, 7.0, 1e300]
    values = [*marks, -3.0, 0.25, 8.0, math.inf, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for n in range(len(marks) + 1):
        got = selection.count_upto(df, {"k": (selection.numbers_of(marks[:n]), F.col("x"), n)}).collect()
        assert {r["x"]: r["k"] for r in got} == {v: 0 if v is None else bisect.bisect_right(marks[:n], v) for v in values}


def test_quantiles_of_many_ranges(spark):
    rows = [(i * i % 9973 / 7, float(i), -math.inf if i % 50 == 0 else i * 1e-300) for i in range(30000)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(3)
    probs = [i / 20 for i in range(21)]
    for r in selection.exact_quantiles(df, ["a", "b", "c"], probs).collect():
        own = sorted(row["abc".index(r["column"])] for row in rows)
        for p, got in zip(probs, r[2:], strict=True):
            at = p * (len(own) - 1)
            low, high = own[math.floor(at)], own[math.ceil(at)]
            assert got == (low if low == high else pytest.approx(low + (high - low) * (at - math.floor(at))))
