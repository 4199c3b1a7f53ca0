"""Classification scores from counts of (group, true label, predicted label)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _safe(a: Column, b: Column) -> Column:
    return F.coalesce(F.when(b != 0, a / b), F.lit(0.0))


def confusion_counts(
    df: DataFrame, true: str = "label", pred: str = "prediction", group: str | None = None
) -> DataFrame:
    """``([group,] true_label, pred_label, n)``."""
    keys = [F.col(true).cast("string").alias("true_label"), F.col(pred).cast("string").alias("pred_label")]
    if group:
        keys.insert(0, F.coalesce(F.col(group).cast("string"), F.lit("<MISSING>")).alias("group"))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(counts: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row per true label, one ``pred_<label>`` column per label, in label order."""
    labels = sorted(labels)
    blank = counts.sparkSession.createDataFrame([(x, None, 0) for x in labels], "true_label string, pred_label string, n bigint")
    cells = [
        F.sum(F.when(F.col("pred_label") == x, F.col("n")).otherwise(0)).cast("bigint").alias(f"pred_{x}")
        for x in labels
    ]
    known = counts.where(F.col("true_label").isin(*labels))
    return known.unionByName(blank).groupBy("true_label").agg(*cells).orderBy("true_label")


def per_class(counts: DataFrame, group: bool = False) -> DataFrame:
    """Precision, recall, F1 and support per label seen as true or predicted."""
    keys = ["group"] if group else []
    n, zero = F.col("n"), F.lit(0)
    hit = F.when(F.col("true_label") == F.col("pred_label"), n).otherwise(zero)
    as_true = counts.select(*keys, F.col("true_label").alias("label"), n.alias("t"), zero.alias("p"), hit.alias("h"))
    as_pred = counts.select(*keys, F.col("pred_label").alias("label"), zero.alias("t"), n.alias("p"), zero.alias("h"))
    sums = (
        as_true.unionByName(as_pred)
        .groupBy(*keys, "label")
        .agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("h").alias("hits"))
    )
    hits, support, predicted = F.col("hits"), F.col("support"), F.col("predicted")
    return sums.select(
        *keys,
        "label",
        _safe(hits, predicted).alias("precision"),
        _safe(hits, support).alias("recall"),
        _safe(2 * hits, support + predicted).alias("f1_score"),
        support.cast("bigint").alias("support"),
    )


def classification_report(counts: DataFrame) -> DataFrame:
    """Per-class rows followed by ``macro avg``, ``weighted avg`` and ``accuracy``."""
    rows = per_class(counts)
    scores = ("precision", "recall", "f1_score")
    total = F.sum("support")
    macro = rows.agg(F.lit("macro avg").alias("label"), *[F.avg(s).alias(s) for s in scores], total.alias("support"))
    weighted = rows.agg(
        F.lit("weighted avg").alias("label"),
        *[_safe(F.sum(F.col(s) * F.col("support")), total).alias(s) for s in scores],
        total.alias("support"),
    )
    right = F.sum(F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0))
    accuracy = counts.agg(
        F.lit("accuracy").alias("label"),
        *[_safe(right, F.sum("n")).alias(s) for s in scores],
        F.sum("n").alias("support"),
    )
    return rows.unionByName(macro).unionByName(weighted).unionByName(accuracy)


def accuracy_and_f1(counts: DataFrame) -> DataFrame:
    """One row ``(n, accuracy, macro_f1)`` over labels seen as true or predicted."""
    right = F.sum(F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0))
    f1 = per_class(counts).select(F.avg("f1_score")).scalar()
    return counts.agg(F.sum("n").alias("n"), _safe(right, F.sum("n")).alias("accuracy")).withColumn("macro_f1", f1)


def group_metrics(counts: DataFrame, min_n: int = 1, all_labels: bool = True) -> DataFrame:
    """``(group, n, accuracy, macro_f1)`` for groups of at least ``min_n`` rows.

    With ``all_labels`` the F1 average runs over every true label of the whole
    set, a label a group lacks scoring 0; otherwise over the labels seen in the
    group as true or predicted.
    """
    scores = per_class(counts, group=True)
    if all_labels:
        truth = counts.select(F.col("true_label").alias("label")).distinct()
        how_many = truth.select(F.count(F.lit(1))).scalar()
        f1 = scores.join(truth, "label", "left_semi").groupBy("group").agg(F.sum("f1_score").alias("f1"))
        f1 = f1.select("group", (F.col("f1") / how_many).alias("macro_f1"))
    else:
        f1 = scores.groupBy("group").agg(F.avg("f1_score").alias("macro_f1"))
    right = F.sum(F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0))
    base = counts.groupBy("group").agg(
        F.sum("n").cast("bigint").alias("n"), _safe(right, F.sum("n")).alias("accuracy")
    )
    return base.where(F.col("n") >= min_n).join(f1, "group").select("group", "n", "accuracy", "macro_f1")


def metric_gaps(metrics: DataFrame) -> DataFrame:
    """Largest minus smallest score over the groups: one row."""
    return metrics.agg(
        F.count(F.lit(1)).alias("groups_evaluated"),
        (F.max("macro_f1") - F.min("macro_f1")).alias("macro_f1_gap_max_minus_min"),
        (F.max("accuracy") - F.min("accuracy")).alias("accuracy_gap_max_minus_min"),
    )


def best_model(scores: DataFrame) -> DataFrame:
    """Highest ``macro_f1``; the earlier ``position`` wins a tie."""
    return scores.orderBy(F.desc_nulls_last("macro_f1"), "position").limit(1)


def metrics_lookup(scores: DataFrame) -> DataFrame:
    """Accuracy, macro-F1, rows and features of the best model."""
    return best_model(scores).select(
        F.col("model").alias("best_model"), "accuracy", "macro_f1", "n_rows_used", "n_features"
    )
