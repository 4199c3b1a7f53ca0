"""Train and compare the baseline classifiers on one table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from twintable.operators.class_metrics import (
    accuracy_and_f1,
    best_model,
    classification_report,
    confusion_counts,
    confusion_matrix,
    group_metrics,
    metric_gaps,
)
from twintable.operators.clean import drop_missing_target, drop_rare_classes, leakage_columns, require_classes
from twintable.operators.models import Classifier, fit_classifier
from twintable.operators.profile import id_like_columns
from twintable.operators.split import split_rows
from twintable.session import materialize
from twintable.spec import resolve_role


@dataclass(frozen=True)
class Baseline:
    scores: DataFrame
    best: str
    reports: dict[str, DataFrame]
    confusion: dict[str, DataFrame]
    groups: DataFrame | None
    gaps: DataFrame | None
    importances: DataFrame
    dropped_id_like: list[str]
    classifiers: dict[str, Classifier]


def baseline_features(work: DataFrame, target: str, group: str | None) -> tuple[list[str], list[str]]:
    """Columns to learn from, and those left out as identifiers."""
    leaks = leakage_columns([c for c in work.columns if c != target], group)
    candidates = [c for c in work.columns if c != target and c not in leaks]
    ids = id_like_columns(work.select(*candidates), [group] if group else [])
    return [c for c in candidates if c not in ids], ids


def run_baseline(
    df: DataFrame,
    target: str,
    group: str | None = None,
    test_share: float = 0.2,
    seed: int = 42,
    min_class_count: int = 5,
    trees: int = 300,
    model_path: str | None = None,
    split: tuple[DataFrame, DataFrame] | None = None,
) -> Baseline:
    """Filter, split, fit both classifiers, score them and pick the better one.

    ``split`` takes ready train and test tables instead of the seeded split.
    """
    target = resolve_role(df, target, required=True)
    group = resolve_role(df, group)
    work = materialize(drop_rare_classes(drop_missing_target(df, target), target, min_class_count))
    require_classes(work, target)
    features, ids = baseline_features(work, target, group)
    used = work.select(*features, target)
    parts = split or split_rows(used, target, test_share, seed)
    train, test = (materialize(p.select(*used.columns)) for p in parts)

    labels = [r[0] for r in work.select(F.col(target).cast("string")).distinct().collect()]
    fitted, reports, confusion, scored, rows = {}, {}, {}, {}, []
    for position, (name, kind, options) in enumerate(
        (("logreg", "logreg", {}), ("rf", "forest", {"seed": seed, "trees": trees}))
    ):
        fitted[name] = fit_classifier(train, target, kind, **options)
        scored[name] = materialize(fitted[name].predict(test, target))
        counts = materialize(confusion_counts(scored[name]))
        reports[name] = classification_report(counts)
        confusion[name] = confusion_matrix(counts, labels)
        rows.append(
            accuracy_and_f1(counts).select(
                F.lit(name).alias("model"), F.lit(position).alias("position"), "accuracy", "macro_f1"
            )
        )
    scores = materialize(
        rows[0]
        .unionByName(rows[1])
        .withColumns(
            {
                "n_rows_used": F.lit(work.count()).cast("bigint"),
                "n_features": F.lit(len(features)).cast("bigint"),
                "n_classes": F.lit(len(labels)).cast("bigint"),
            }
        )
    )
    best = best_model(scores).first()["model"]
    groups = gaps = None
    if group and group in features:
        groups = group_metrics(confusion_counts(scored[best], group=group), min_n=5, all_labels=False)
        gaps = metric_gaps(groups)
    if model_path:
        fitted[best].save(model_path)
    return Baseline(
        scores, best, reports, confusion, groups, gaps, fitted["rf"].importances(df.sparkSession), ids, fitted
    )
