"""How far a synthetic table shifts groups and the labels within them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from twintable.operators.class_metrics import confusion_counts, group_metrics, metric_gaps
from twintable.operators.counts import tag_pair
from twintable.operators.utility import category_shares, total_variation


def group_proportion_tvd(real: DataFrame, syn: DataFrame, group: str) -> DataFrame:
    """One row: total variation between the group shares."""
    shares = category_shares(real, syn, [group])
    return total_variation(shares).select(F.col("tvd").alias("group_proportion_tvd"))


def group_label_l1(real: DataFrame, syn: DataFrame, group: str, target: str) -> DataFrame:
    """``(group, label_l1)``: summed label share differences inside every group.

    Only labels of the real table count. A group missing on one side has all
    zero shares there.
    """
    both = tag_pair(
        real.select(F.col(group).cast("string").alias("group"), F.col(target).cast("string").alias("label")),
        syn.select(F.col(group).cast("string").alias("group"), F.col(target).cast("string").alias("label")),
        ["group", "label"],
    ).select(
        F.coalesce("group", F.lit("nan")).alias("group"),
        F.coalesce("label", F.lit("nan")).alias("label"),
        "_real",
        "_syn",
    )
    cells = both.groupBy("group", "label").agg(F.sum("_real").alias("real_n"), F.sum("_syn").alias("syn_n"))
    sizes = cells.groupBy("group").agg(F.sum("real_n").alias("real_all"), F.sum("syn_n").alias("syn_all"))
    labels = cells.where(F.col("real_n") > 0).select("label").distinct()
    share = {
        s: F.coalesce(F.when(F.col(f"{s}_all") > 0, F.col(f"{s}_n") / F.col(f"{s}_all")), F.lit(0.0))
        for s in ("real", "syn")
    }
    # a group without any real label still counts, with distance 0
    known = cells.join(labels.withColumn("_in_real", F.lit(True)), "label", "left")
    gap = F.when(F.col("_in_real"), F.abs(share["real"] - share["syn"])).otherwise(0.0)
    return known.join(sizes, "group").groupBy("group").agg(F.sum(gap).alias("label_l1"))


def mean_group_label_l1(real: DataFrame, syn: DataFrame, group: str, target: str) -> DataFrame:
    """One row: the plain mean over all groups of either side."""
    return group_label_l1(real, syn, group, target).agg(
        F.avg("label_l1").alias("mean_group_label_distribution_l1")
    )


def fairness_summary(
    real: DataFrame, syn: DataFrame, predictions: DataFrame, group: str, target: str, min_n: int = 1
) -> DataFrame:
    """One row of group distances and the macro-F1 gap of ``predictions``.

    ``predictions`` is the scored real test set with ``label``, ``prediction``
    and the group column. Without the group column on both sides the row only
    says that it was skipped.
    """
    spark = real.sparkSession
    if group not in real.columns or group not in syn.columns:
        return spark.createDataFrame(
            [(True, f"group column not found: {group}", None, None, None, None)],
            "skipped boolean, reason string, group_col string, group_proportion_tvd double,"
            " mean_group_label_distribution_l1 double, group_macro_f1_gap_max_minus_min double",
        )
    scored = group_metrics(confusion_counts(predictions, group=group), min_n=min_n)
    return spark.range(1).select(
        F.lit(False).alias("skipped"),
        F.lit(None).cast("string").alias("reason"),
        F.lit(group).alias("group_col"),
        group_proportion_tvd(real, syn, group).scalar().alias("group_proportion_tvd"),
        mean_group_label_l1(real, syn, group, target).scalar().alias("mean_group_label_distribution_l1"),
        metric_gaps(scored)
        .select("macro_f1_gap_max_minus_min")
        .scalar()
        .alias("group_macro_f1_gap_max_minus_min"),
    )
