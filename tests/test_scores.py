import hashlib
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from twintable.operators.class_metrics import accuracy_and_f1, confusion_counts, confusion_matrix, group_metrics
from twintable.operators.compare import winner
from twintable.operators.fairness import fairness_summary, group_label_l1
from twintable.operators import split
from twintable.operators.split import _repeat, split_rows, tag_split
from twintable.operators.utility import (
    category_shares,
    correlation_mae,
    correlation_pairs,
    histogram,
    ks_pvalue,
    ks_statistic,
    numeric_distance,
    total_variation,
)
from twintable.operators.validate import rare_combinations, row_overlap, rule_matrix, validation_summary


def ks_by_listing(gap, n, m):
    """Share of all orderings whose largest gap is at least ``gap`` (times n*m)."""
    hits = total = 0
    for ups in itertools.combinations(range(n + m), n):
        i = j = worst = 0
        for step in range(n + m):
            i, j = (i + 1, j) if step in ups else (i, j + 1)
            worst = max(worst, abs(i * m - j * n))
        hits += worst >= gap
        total += 1
    return hits / total


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.data())
def test_ks_pvalue_exact(n, m, data):
    gap = data.draw(st.integers(1, n * m))
    assert ks_pvalue(gap / (n * m), n, m) == pytest.approx(ks_by_listing(gap, n, m))


def test_ks_pvalue_limits():
    assert ks_pvalue(0.0, 10, 10) == 1.0
    assert 0 < ks_pvalue(1.0, 60, 60) < 1e-30
    assert ks_pvalue(0.05, 2000, 2000) == pytest.approx(ks_pvalue(0.05, 2000, 2000, method="asymptotic"), rel=0.1)


def test_ks_pvalue_of_large_tables_and_far_gaps():
    near = ks_pvalue(0.004, 60_000, 90_000, method="exact")
    assert near == pytest.approx(ks_pvalue(0.004, 60_000, 90_000, method="asymptotic"), rel=0.03) and near < 1
    assert ks_pvalue(0.5, 10**9, 10**9, method="exact") == 0.0
    assert ks_pvalue(1.0, 3, 100, method="exact") == pytest.approx(2 / math.comb(103, 3))


def test_self_comparison(spark, goods):
    numbers = ["mass_g", "recycled_content_pct", "compliance_rohs"]
    assert {r["ks_stat"] for r in ks_statistic(goods, goods, numbers).collect()} == {0.0}
    assert {r["ks_pvalue"] for r in numeric_distance(goods, goods, numbers).collect()} == {1.0}
    shares = category_shares(goods, goods, ["supplier_region", "grade"])
    assert {r["tvd"] for r in total_variation(shares).collect()} == {0.0}
    assert correlation_mae(goods, goods, numbers).first()[0] == 0.0
    summary = validation_summary(goods, goods).first()
    assert summary["exact_overlap_with_real_train_rate"] == 1.0 and summary["any_rule_violation_rate"] == 0.0


def test_tvd_is_symmetric_and_bounded(spark, goods):
    a, b = goods.where("mass_g < 40"), goods.where("mass_g >= 70")
    one = {r["column"]: r["tvd"] for r in total_variation(category_shares(a, b, ["grade", "material_main"])).collect()}
    two = {r["column"]: r["tvd"] for r in total_variation(category_shares(b, a, ["grade", "material_main"])).collect()}
    assert one == pytest.approx(two) and all(0 <= v <= 1 for v in one.values())


def test_constant_column_correlation(spark):
    real = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 2.0)], "a double, b double")
    syn = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "a double, b double")
    r = np.corrcoef([1, 2, 3], [1, 3, 2])[0, 1]
    assert correlation_mae(real, syn, ["a", "b"]).first()[0] == pytest.approx((2 * abs(r) + 1) / 4)
    assert correlation_mae(real, syn, ["a"]).first()[0] is None


def test_histogram_matches_numpy(spark):
    data = [0.0, 0.1, 0.5, 0.9, 1.0, 1.0]
    rows = histogram(spark.createDataFrame([(v, 4.0) for v in data], "v double, c double"), ["v", "c"], 5).collect()
    density, _ = np.histogram(data, bins=5, density=True)
    got = np.zeros(5)
    for r in rows:
        if r["column"] == "v":
            got[r["bin"]] = r["density"]
    assert got == pytest.approx(density)
    flat = [r for r in rows if r["column"] == "c"]
    assert len(flat) == 1 and (flat[0]["bin_low"], flat[0]["bin_high"]) == pytest.approx((3.9, 4.1))


def test_rules_with_nulls_and_unknown_values(spark):
    real = spark.createDataFrame([(1.0, "a", "k"), (3.0, "b", "k")], "mass_g double, c string, e string")
    syn = spark.createDataFrame([(2.0, "a", None), (4.0, "z", None), (None, None, None)], "mass_g double, c string, e string")
    rows = [tuple(r) for r in rule_matrix(real, syn).orderBy(F.desc("row_valid"), "mass_g_positive").collect()]
    assert rule_matrix(real, syn).columns == [
        "mass_g__in_real_range", "mass_g_positive", "c__valid_category", "e__valid_category", "row_valid", "row_has_violation",
    ]
    assert rows == [(True, True, True, True, True, False), (False, False, False, True, False, True), (False, True, False, True, False, True)]


def test_overlap_counts_copies_and_nulls(spark):
    real = spark.createDataFrame([(1, None), (2, "b")], "a int, b string")
    syn = spark.createDataFrame([(1, None), (1, None), (3, "b"), (2, None)], "a int, b string")
    row = row_overlap(real, syn).first()
    assert (row["rows"], row["duplicate_row_rate"], row["exact_overlap_rate"]) == (4, 0.25, 0.5)
    assert tuple(row_overlap(real, syn.where("false")).first()) == (0, 0.0, 0.0)
    assert rare_combinations(real, syn, ["nope"]).first()[0] is None
    assert rare_combinations(real, syn, ["a"]).first()[0] == 0.75


def test_fairness_edges(spark):
    real = spark.createDataFrame([("x", "1"), ("y", "1")], "g string, t string")
    syn = spark.createDataFrame([("x", "1"), ("z", "2"), ("z", "1")], "g string, t string")
    got = {r["group"]: r["label_l1"] for r in group_label_l1(real, syn, "g", "t").collect()}
    assert got == {"x": 0.0, "y": 1.0, "z": 0.5}
    skipped = fairness_summary(real, syn.drop("g"), real, "g", "t").first()
    assert skipped["skipped"] and "g" in skipped["reason"]


def test_class_metrics(spark):
    pairs = [("a", "a", "g")] * 3 + [("a", "b", "g")] + [("b", "b", "h")] * 2 + [("c", "a", None)]
    counts = confusion_counts(spark.createDataFrame(pairs, "label string, prediction string, grp string"))
    row = accuracy_and_f1(counts).first()
    assert row["accuracy"] == pytest.approx(5 / 7)
    assert row["macro_f1"] == pytest.approx((6 / 8 + 4 / 5 + 0) / 3)
    matrix = [tuple(r) for r in confusion_matrix(counts, ["c", "a", "b"]).collect()]
    assert matrix == [("a", 3, 1, 0), ("b", 0, 2, 0), ("c", 1, 0, 0)]
    grouped = confusion_counts(spark.createDataFrame(pairs, "label string, prediction string, grp string"), group="grp")
    scores = {r["group"]: r for r in group_metrics(grouped).collect()}
    assert scores["g"]["macro_f1"] == pytest.approx(6 / 7 / 3) and scores["<MISSING>"]["accuracy"] == 0.0
    assert [r["group"] for r in group_metrics(grouped, min_n=3, all_labels=False).collect()] == ["g"]


def test_winner_puts_nulls_last(spark):
    rows = [("a", 0.0, 0.5, 0.0, None, 1.0), ("b", 0.0, 0.5, 0.0, 0.4, 2.0), ("c", 0.1, 0.9, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(
        rows,
        "model string, any_rule_violation_rate double, tstr_macro_f1 double, exact_overlap_with_real_train_rate double,"
        " group_macro_f1_gap_max_minus_min double, fit_seconds double",
    )
    assert winner(df).first()["model"] == "b"


def test_split_with_hot_repeated_row(spark):
    hot = spark.range(9000).select(F.lit("same").alias("v"), F.lit("x").alias("t"))
    rest = spark.range(1000).select(F.col("id").cast("string").alias("v"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("t"))
    df = hot.unionByName(rest)
    train, test = split_rows(df, "t")
    assert (train.count(), test.count()) == (8000, 2000)
    assert {r["t"]: r["count"] for r in test.groupBy("t").count().collect()} == {"x": 1900, "y": 100}
    together = train.unionByName(test)
    assert together.exceptAll(df).count() == 0 and df.exceptAll(together).count() == 0
    again, _ = split_rows(df.repartition(3), "t")
    assert again.exceptAll(train).count() == 0


def test_split_falls_back_to_one_stratum(spark):
    df = spark.range(20).select("id", F.when(F.col("id") == 3, "lone").otherwise("many").alias("t"))
    tagged = tag_split(df, "t", ["id"])
    assert tagged.count() == 20 and tagged.where("is_test").count() == 4


@pytest.mark.parametrize("few", [4096, 1])
def test_split_takes_the_first_digests_of_each_class(spark, monkeypatch, few):
    monkeypatch.setattr(split, "EDGE_ROWS", few)
    rows = [(i, "abc"[min(i % 7, 2)]) for i in range(9000)] + [(10000 + i, None) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, t string").repartition(7)
    tagged = tag_split(df, "t", ["id"], share=0.3, seed=9).collect()
    by_class = {}
    for r in tagged:
        by_class.setdefault(r["t"], []).append((hashlib.sha256(f"{r['id']}|9".encode()).hexdigest(), r["is_test"]))
    sizes = {t: sum(b for _, b in v) for t, v in by_class.items()}
    assert sum(sizes.values()) == 2709 and all(abs(n - 0.3 * len(by_class[t])) < 1 for t, n in sizes.items())
    for t, v in by_class.items():
        assert [b for _, b in sorted(v)] == [True] * sizes[t] + [False] * (len(v) - sizes[t])


def test_correlations_of_every_two_columns(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 40)) * 10.0 ** rng.integers(-3, 6, 40) + 10.0 ** rng.integers(0, 7, 40)
    x[:, 1] = 3 * x[:, 0] - 1
    x[:, 2] = 0.1  # constant, and constant where others are there
    x[400:, 3], x[:400, 4] = np.nan, np.nan
    x[400:, 5] = 7.7
    x[::3, 6] = np.nan
    df = spark.createDataFrame([tuple(None if v != v and i % 2 else float(v) for i, v in enumerate(r)) for r in x], ", ".join(f"c{i} double" for i in range(40)))
    got = {(r["a"], r["b"]): r["real_corr"] for r in correlation_pairs(df.repartition(3), df, df.columns).collect()}
    want = pd.DataFrame(x).corr().fillna(0.0).to_numpy()
    assert len(got) == 40 * 41 // 2
    for i in range(40):
        for j in range(i, 40):
            if {i, j} != {4, 5}:
                assert got[f"c{i}", f"c{j}"] == pytest.approx(want[i, j], abs=1e-6), (i, j)
    assert got["c4", "c5"] == 0.0 and got["c3", "c4"] == 0.0 and got["c2", "c2"] == 0.0


def test_repeat_spreads_blocks(spark):
    df = spark.createDataFrame([("a", 10000), ("b", 0), ("c", 1)], "k string, n bigint")
    assert {r["k"]: r["count"] for r in _repeat(df, "n", 512).groupBy("k").count().collect()} == {"a": 10000, "c": 1}
