import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from twintable.operators import sampling
from twintable.operators.models import class_weights, fit_classifier
from twintable.operators.sampling import SAMPLERS, generate_table, make_sampler, number_rows
from twintable.plans.baseline import run_baseline
from twintable.plans.evaluate import evaluate_generators
from twintable.plans.profile_clean import profile_and_clean
from twintable.spec import Roles


def test_number_rows(spark):
    got = sorted(r["_row"] for r in number_rows(spark.range(1000).repartition(7)).collect())
    assert got == list(range(1000))


@pytest.mark.parametrize("name", sorted(SAMPLERS))
def test_samplers(name, spark, goods):
    sampler = SAMPLERS[name]().fit(goods)
    made = sampler.generate(0, seed=1)
    rows = sorted(map(tuple, made.collect()))
    assert made.schema.simpleString() == goods.schema.simpleString()
    assert len(rows) == 240 and sampler.generate(700).count() == 700
    assert sorted(map(tuple, sampler.generate(0, seed=1).repartition(3).collect())) == rows
    assert sorted(map(tuple, sampler.generate(0, seed=2).collect())) != rows
    seen = {r[0] for r in goods.select("supplier_region").distinct().collect()}
    assert {r[4] for r in rows} <= seen
    masses = [r[2] for r in rows]
    assert 3.0 <= min(masses) and max(masses) <= 99.0


def test_marginals_and_network_follow_the_data(spark, goods):
    share = goods.where("contains_hazardous_substance = 1").count() / 240
    network = SAMPLERS["bayes_network"]().fit(goods).generate(6000)
    alone = SAMPLERS["marginals"]().fit(goods).generate(6000)
    for made in (network, alone):
        assert made.where("contains_hazardous_substance = 1").count() / 6000 == pytest.approx(share, abs=0.04)

    def low(df):
        hazard = df.where("contains_hazardous_substance = 1")
        return hazard.where("grade = 'Low'").count() / hazard.count()

    assert low(goods) == 1.0 and low(network) > 0.9 > low(alone)


def test_network_with_nulls_loose_columns_and_large_tables(spark, monkeypatch):
    monkeypatch.setattr(sampling, "BROADCAST_ROWS", 1)
    df = spark.range(400).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 5)).alias("k"),
        F.when(F.col("id") % 4 != 0, F.col("id") * 1.5).alias("x"),
        F.concat(F.lit("unique"), "id").alias("free_text"),
    )
    made = SAMPLERS["bayes_network"](max_values=50).fit(df).generate(900)
    assert made.count() == 900
    assert made.where("x is null").count() / 900 == pytest.approx(0.25, abs=0.06)
    assert made.where("k = 'hot'").count() / 900 == pytest.approx(1 / 3, abs=0.07)
    assert made.select("free_text").distinct().count() > 200
    uniform = SAMPLERS["uniform_domain"]().fit(df).generate(500)
    assert uniform.count() == 500 and uniform.where("k is null").count() == 0


def test_private_network_noise_shrinks_with_epsilon(spark, goods):
    def gap(epsilon):
        made = SAMPLERS["private_bayes_network"](epsilon=epsilon, degree=1).fit(goods).generate(4000)
        real = {r["grade"]: r["count"] / 240 for r in goods.groupBy("grade").count().collect()}
        got = {r["grade"]: r["count"] / 4000 for r in made.groupBy("grade").count().collect()}
        return sum(abs(real[k] - got.get(k, 0)) for k in real)

    assert gap(1e6) < 0.15


def test_unknown_options_are_reported(spark, goods):
    _, used, ignored = make_sampler("private_bayes_network", {"epsilon": 2.0, "n_iter": 9})
    assert used == {"epsilon": 2.0} and ignored == {"n_iter": 9}
    made, facts = generate_table(goods, "bootstrap", count=10, drop=["grade"], options={"n_iter": 9})
    row = facts.first()
    assert made.count() == 10 and (row["rows_in"], row["columns_out"]) == (240, 7) and "n_iter" in row["ignored_options"]


def test_classifiers(spark, goods, tmp_path):
    weights = {r["label"]: r["weight"] for r in class_weights(goods, "grade").collect()}
    sizes = {r["grade"]: r["count"] for r in goods.groupBy("grade").count().collect()}
    assert weights == pytest.approx({k: 240 / (3 * n) for k, n in sizes.items()})
    holed = goods.withColumn("mass_g", F.when(F.col("mass_g") > 5, F.col("mass_g")))
    fitted = fit_classifier(holed, "grade", "forest", trees=20)
    new = goods.withColumn("material_main", F.lit("never seen"))
    scored = fitted.predict(new, "grade")
    assert scored.where("prediction is null").count() == 0
    names = [r["feature"] for r in fitted.importances(spark).collect()]
    assert names[0] in ("recycled_content_pct", "contains_hazardous_substance")
    assert "supplier_region_NA" in fitted.features
    fitted.save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model")).transform(new)
    assert again.where("_predicted is null").count() == 0


def test_baseline(spark, goods):
    labelled = goods.withColumns({"row_id": F.monotonically_increasing_id(), "old_label": F.col("grade")})
    result = run_baseline(labelled, "Grade", "supplier_region", trees=30)
    scores = {r["model"]: r for r in result.scores.collect()}
    assert result.dropped_id_like == ["row_id"] and scores["rf"]["n_features"] == 7
    assert scores[result.best]["macro_f1"] == max(r["macro_f1"] for r in scores.values()) > 0.8
    assert result.gaps.first()["macro_f1_gap_max_minus_min"] >= 0
    assert result.confusion["rf"].count() == 3


def test_profile_and_clean(spark):
    raw = spark.createDataFrame(
        [(f"P{i % 30}", " a  b" if i % 2 else "c", "1,000" if i % 3 else "2", "yes" if i % 2 else "NO") for i in range(60)],
        "`Product ID` string, Kind string, `Base amount` string, Flag string",
    )
    report = profile_and_clean(raw, Roles(target="Flag", hash=("Product ID",), drop=("missing",)))
    row = report.summary.first()
    assert (row["original_rows"], row["cleaned_rows"], row["duplicates_removed"]) == (60, 30, 30)
    assert row["recommended_drop"] == ["product_id"] and row["target_col"] == "flag"
    assert dict(report.table.dtypes) == {"product_id": "string", "kind": "string", "base_amount": "double", "flag": "bigint"}
    assert {r["value"] for r in report.samples.where("column = 'kind'").collect()} == {"a b", "c"}
    assert report.generator_input.columns == ["kind", "base_amount", "flag"]
    assert {len(r["product_id"]) for r in report.table.collect()} == {16}
    assert report.catalogue.count() == 4 and report.classes.count() == 2 and report.numbers.count() == 2


def test_evaluation_survives_a_failing_generator(spark, goods, monkeypatch):
    class Broken(sampling.Sampler):
        def _fit(self, real):
            raise RuntimeError("no luck")

    monkeypatch.setitem(SAMPLERS, "broken", Broken)
    roles = Roles(target="grade", group="supplier_region")
    result = evaluate_generators(goods, roles, {"broken": {}, "bootstrap": {"n_iter": 3}})
    assert result.winner == "bootstrap"
    row = result.comparison.first()
    assert row["exact_overlap_with_real_train_rate"] == 1.0 and row["suspiciously_close_rate"] == 1.0
    log = {(r["model"], r["entry"]): r["value"] for r in result.log.collect()}
    assert "no luck" in log[("broken", "error")] and "n_iter" in log[("bootstrap", "ignored_options")]
    assert result.synthetic["bootstrap_5x"].count() == 5 * 192
    tables = result.details["bootstrap"]
    assert {r["column"] for r in tables["numeric_distance"].collect()} == {r["column"] for r in tables["moments"].collect()}
    assert all(t.count() > 0 for t in tables.values()) and "group_metrics" in tables
    context = result.context.first()
    assert (context["rows_train"], context["rows_test"]) == (192, 48)
    with pytest.raises(RuntimeError, match="not enough"):
        evaluate_generators(goods, roles, {"bootstrap": {}})
    with pytest.raises(RuntimeError, match="all generators failed"):
        _all_fail(goods, roles, monkeypatch)


def _all_fail(goods, roles, monkeypatch):
    monkeypatch.setitem(SAMPLERS, "broken_too", SAMPLERS["broken"])
    return evaluate_generators(goods, roles, {"broken": {}, "broken_too": {}})


@pytest.mark.parametrize("name", ["bootstrap", "marginals"])
def test_rows_are_not_sent_whole_to_tasks(spark, name):
    real = spark.range(300).select(F.col("id").alias("a"), (F.col("id") % 7).cast("string").alias("b"))
    made, _ = generate_table(real, name)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and made.count() == 300
