"""Score one or several synthetic tables against a real one."""

from __future__ import annotations

import json
import traceback
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from twintable.operators.class_metrics import accuracy_and_f1, classification_report, confusion_counts, group_metrics
from twintable.operators.clean import align, require_complete, union_tables
from twintable.operators.compare import comparison_table, ranked_rows, winner
from twintable.operators.fairness import fairness_summary
from twintable.operators.models import fit_classifier
from twintable.operators.privacy import Distances, distance_histograms, privacy_summary, real_distances, with_synthetic
from twintable.operators.sampling import SAMPLERS, timed_generation
from twintable.operators.split import run_context, split_rows
from twintable.operators.utility import (
    category_shares,
    correlation_mae,
    histogram_overlay,
    moments,
    numeric_distance,
    top_categories,
    total_variation,
)
from twintable.operators.validate import invalid_category_rates, rule_matrix, validation_summary
from twintable.session import materialize
from twintable.spec import Roles, feature_types

DEFAULT_MODELS = {
    "marginals": {},
    "bayes_network": {},
    "private_bayes_network": {"epsilon": 1.0},
}


@dataclass(frozen=True)
class Evaluation:
    comparison: DataFrame
    ranking: DataFrame
    winner: str
    log: DataFrame
    context: DataFrame
    synthetic: dict[str, DataFrame]
    details: dict[str, dict[str, DataFrame]]
    real_scores: DataFrame
    real_report: DataFrame


def train_and_score(train: DataFrame, test: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Logistic regression from ``train`` on ``test``: score row and predictions."""
    predictions = materialize(fit_classifier(train, target).predict(test, target))
    return accuracy_and_f1(confusion_counts(predictions)), predictions


def score_synthetic(
    name: str,
    real: DataFrame,
    test: DataFrame,
    syn: DataFrame,
    roles: Roles,
    trtr_f1: float,
    distances: Distances | None = None,
    ks_method: str = "asymptotic",
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """All scores of one synthetic table as one row, and the tables behind them by name.

    ``distances`` of the real table may be given where several tables are scored. Reports of
    one row are written down once; the tables of columns, bins and groups are computed
    when they are read.
    """
    syn = materialize(align(syn, real))
    numeric, categorical = feature_types(real, roles.target)
    scores, predictions = train_and_score(syn, test, roles.target)
    scores = materialize(scores)
    matrix = rule_matrix(real, syn, roles.rules)
    checks = materialize(validation_summary(real, syn, roles.rules, matrix))
    distances = with_synthetic(distances or real_distances(real, roles.target), real, syn, roles.target)
    privacy = materialize(privacy_summary(real, syn, roles.target, roles.rare_keys, distances))
    shares = category_shares(real, syn, categorical)
    details = {
        "moments": moments(real, syn, numeric),
        "numeric_distance": numeric_distance(real, syn, numeric, method=ks_method),
        "histograms": histogram_overlay(real, syn, numeric),
        "total_variation": total_variation(shares),
        "top_categories": top_categories(shares),
        "validation": checks,
        "invalid_category_rates": invalid_category_rates(matrix),
        "tstr": scores,
        "tstr_report": classification_report(confusion_counts(predictions)),
        "privacy": privacy,
        "distance_histograms": distance_histograms(distances.syn_real, distances.real_real),
    }

    def one(table: DataFrame, column: str) -> Column:
        return table.select(column).scalar()

    row = {
        "any_rule_violation_rate": one(checks, "any_rule_violation_rate"),
        "duplicate_row_rate": one(checks, "duplicate_row_rate"),
        "exact_overlap_with_real_train_rate": one(checks, "exact_overlap_with_real_train_rate"),
        "tstr_accuracy": one(scores, "accuracy"),
        "tstr_macro_f1": one(scores, "macro_f1"),
        "trtr_macro_f1": F.lit(trtr_f1),
        "numeric_correlation_mae": one(correlation_mae(real, syn, numeric), "numeric_correlation_mae"),
        "suspiciously_close_rate": one(privacy, "suspiciously_close_rate"),
        "rare_combo_leakage_rate": one(privacy, "rare_combo_leakage_rate"),
    }
    for c in ("group_macro_f1_gap_max_minus_min", "group_proportion_tvd"):
        row[c] = F.lit(None).cast("double")
    if roles.group:
        fair = materialize(fairness_summary(real, syn, predictions, roles.group, roles.target))
        details["fairness"] = fair
        if roles.group in real.columns:
            details["group_metrics"] = group_metrics(confusion_counts(predictions, group=roles.group))
        for c in ("group_macro_f1_gap_max_minus_min", "group_proportion_tvd"):
            row[c] = one(fair, c)
    row = real.sparkSession.range(1).select(F.lit(name).alias("model"), *[v.alias(c) for c, v in row.items()])
    return materialize(row), details


def evaluate_generators(
    real: DataFrame,
    roles: Roles,
    models: dict[str, dict] | None = None,
    seed: int = 42,
    test_share: float = 0.2,
    ks_method: str = "asymptotic",
) -> Evaluation:
    """Split, generate with every model, score and rank.

    ``real_scores`` and ``real_report`` are those of the classifier trained on real rows. The p-values
    of the KS statistics follow ``ks_method``, whatever the size of the tables. A model that fails is
    logged and left out. At least two models must be
    known, and one must succeed.
    """
    models = DEFAULT_MODELS if models is None else models
    known = [m for m in models if m in SAMPLERS]
    if len(known) < 2:
        raise RuntimeError(f"not enough known generators: {known}")
    real = materialize(require_complete(real))
    train, test = (materialize(p) for p in split_rows(real, roles.target, test_share, seed))
    trtr, on_real = train_and_score(train, test, roles.target)
    trtr_f1 = trtr.first()["macro_f1"]

    rows, log, tables, details = [], [("(real)", "trtr_macro_f1", repr(trtr_f1))], {}, {}
    distances = real_distances(train, roles.target)
    for name in known:
        try:
            run = timed_generation(train, name, models[name], seed)
            scores, details[name] = score_synthetic(name, train, test, run.once, roles, trtr_f1, distances, ks_method)
            rows.append(
                scores.withColumns(
                    {
                        "fit_seconds": F.lit(run.fit_seconds),
                        "generate_1x_seconds": F.lit(run.generate_1x_seconds),
                        "generate_5x_seconds": F.lit(run.generate_5x_seconds),
                    }
                )
            )
            tables[f"{name}_1x"], tables[f"{name}_5x"] = run.once, run.five_times
            log += [
                (name, "options", json.dumps(run.used)),
                (name, "ignored_options", json.dumps(run.ignored)),
                (name, "fit_seconds", repr(run.fit_seconds)),
                (name, "generate_1x_seconds", repr(run.generate_1x_seconds)),
                (name, "generate_5x_seconds", repr(run.generate_5x_seconds)),
            ]
        except Exception as error:  # noqa: BLE001 - one model must not stop the others
            log.append((name, "error", f"{error}\n{traceback.format_exc()}"))
    if not rows:
        raise RuntimeError(f"all generators failed: {[x for x in log if x[1] == 'error']}")
    scores = materialize(union_tables(rows))
    best = winner(scores).first()["model"]
    log.append((best, "winner", "true"))
    return Evaluation(
        comparison=comparison_table(scores),
        ranking=ranked_rows(scores),
        winner=best,
        log=real.sparkSession.createDataFrame(log, "model string, entry string, value string"),
        context=run_context(real, train, test, roles.target, roles.group, seed),
        synthetic=tables,
        details=details,
        real_scores=trtr,
        real_report=classification_report(confusion_counts(on_real)),
    )
