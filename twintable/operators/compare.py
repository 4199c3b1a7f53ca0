"""Ranking of generators by their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Sort keys of the decision, in order of weight.
RANKING = (
    ("any_rule_violation_rate", True),
    ("tstr_macro_f1", False),
    ("exact_overlap_with_real_train_rate", True),
    ("group_macro_f1_gap_max_minus_min", True),
    ("fit_seconds", True),
)


def _order() -> list[Column]:
    keys = [F.asc_nulls_last(c) if ascending else F.desc_nulls_last(c) for c, ascending in RANKING]
    return [*keys, F.asc("model")]


def comparison_table(scores: DataFrame) -> DataFrame:
    """Scores with the loss against training on real data, best first."""
    gap = F.col("tstr_macro_f1") - F.col("trtr_macro_f1")
    return scores.withColumn("tstr_minus_trtr_macro_f1", gap).orderBy(*_order())


def winner(scores: DataFrame) -> DataFrame:
    return scores.orderBy(*_order()).limit(1).select("model")


def ranked_rows(scores: DataFrame) -> DataFrame:
    """Decision rows to four decimals; ``scores`` has one row per generator."""
    shown = {
        "violation": "any_rule_violation_rate",
        "tstr_f1": "tstr_macro_f1",
        "overlap": "exact_overlap_with_real_train_rate",
        "fairness_gap": "group_macro_f1_gap_max_minus_min",
    }
    return scores.select(
        F.row_number().over(Window.orderBy(*_order())).alias("position"),
        "model",
        *[F.round(c, 4).alias(name) for name, c in shown.items()],
    )
