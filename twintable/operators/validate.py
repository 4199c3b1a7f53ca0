"""Row rules and row overlap of a synthetic table against a real one."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from twintable.operators.clean import align
from twintable.operators.counts import paired_row_counts, tag_pair, value_counts
from twintable.session import materialize
from twintable.spec import Rules, numeric_columns

# A domain at most this large (values, characters) is sent to every executor.
SMALL_DOMAIN = (100_000, 4_000_000)


def _holds(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def range_rules(real: DataFrame, syn: DataFrame) -> dict[str, Column]:
    """``{c}__in_real_range`` for every numeric column of ``syn``."""
    columns = [c for c in numeric_columns(syn) if c in real.columns]
    if not columns:
        return {}
    limits = real.agg(
        F.struct(
            *[F.min(F.col(c).cast("double")).alias(f"lo_{c}") for c in columns],
            *[F.max(F.col(c).cast("double")).alias(f"hi_{c}") for c in columns],
        ).alias("limits")
    ).scalar()
    return {
        f"{c}__in_real_range": _holds(
            F.col(c).cast("double").between(limits.getField(f"lo_{c}"), limits.getField(f"hi_{c}"))
        )
        for c in columns
    }


def domain_rules(syn: DataFrame, rules: Rules) -> dict[str, Column]:
    def number(c: str) -> Column:
        return F.col(c).try_cast("double")

    tests = {f"{c}_positive": number(c) > 0 for c in rules.positive if c in syn.columns}
    tests |= {f"{c}_0_100": number(c).between(0, 100) for c in rules.percent if c in syn.columns}
    tests |= {f"{c}_binary": number(c).isin(0.0, 1.0) for c in rules.flags if c in syn.columns}
    return {name: _holds(test) for name, test in tests.items()}


def _with_known_flags(real: DataFrame, syn: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``_known_<c>``: whether the value occurs in the real column."""
    if not columns:
        return syn
    domains = materialize(value_counts(real, columns).where(F.col("value").isNotNull()).select("column", "value"))
    sizes = {
        r["column"]: (r["values"], r["chars"])
        for r in domains.groupBy("column")
        .agg(F.count(F.lit(1)).alias("values"), F.sum(F.length("value")).alias("chars"))
        .collect()
    }
    for c in columns:
        domain = domains.where(F.col("column") == c).select(
            F.col("value").alias(f"_value_{c}"), F.lit(True).alias(f"_known_{c}")
        )
        values, chars = sizes.get(c, (0, 0))
        if values <= SMALL_DOMAIN[0] and chars <= SMALL_DOMAIN[1]:
            domain = F.broadcast(domain)
        syn = syn.join(domain, F.col(c).cast("string") == F.col(f"_value_{c}"), "left").drop(f"_value_{c}")
    return syn


def rule_matrix(
    real: DataFrame, syn: DataFrame, rules: Rules | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """One boolean column per rule and row, plus ``row_valid`` and its opposite.

    ``keep`` names columns to carry along and exempt from the rules.
    """
    rules = rules or Rules()
    subject = syn.drop(*keep)
    numeric = numeric_columns(subject)
    categorical = [c for c in subject.columns if c not in numeric]
    filled = (
        subject.agg(F.struct(*[F.count(F.col(c)).alias(c) for c in categorical]).alias("filled")).scalar()
        if categorical
        else None
    )
    checks = range_rules(real, subject) | domain_rules(subject, rules)
    for c in categorical:
        # a column without any value has nothing invalid in it
        checks[f"{c}__valid_category"] = _holds(F.col(f"_known_{c}")) | (filled.getField(c) == 0)
    flagged = _with_known_flags(real, syn, categorical).select(
        *keep, *[test.alias(name) for name, test in checks.items()]
    )
    valid = reduce(lambda a, b: a & b, [F.col(name) for name in checks], F.lit(True))
    return flagged.withColumns({"row_valid": valid, "row_has_violation": ~valid})


def invalid_category_rates(matrix: DataFrame) -> DataFrame:
    """``(column, invalid_rate)`` for every categorical column of a rule matrix."""
    suffix = "__valid_category"
    names = [c for c in matrix.columns if c.endswith(suffix)]
    rates = [
        F.struct(
            F.lit(c.removesuffix(suffix)).alias("column"),
            F.coalesce(F.avg((~F.col(c)).cast("int")), F.lit(0.0)).alias("invalid_rate"),
        )
        for c in names
    ]
    if not rates:
        return matrix.sparkSession.createDataFrame([], "column string, invalid_rate double")
    return matrix.agg(F.array(*rates).alias("r")).select(F.inline("r"))


def row_overlap(real: DataFrame, syn: DataFrame) -> DataFrame:
    """Rows, repeats and exact matches of the synthetic table: one row.

    Both tables fold to distinct rows in one shuffle; nothing is joined.
    """
    pairs = paired_row_counts(real, align(syn, real))
    n = F.nullif(F.sum("syn_n"), F.lit(0).cast("bigint"))
    repeats = F.sum(F.when(F.col("syn_n") > 0, F.col("syn_n") - 1).otherwise(0))
    hits = F.sum(F.when(F.col("real_n") > 0, F.col("syn_n")).otherwise(0))
    return pairs.agg(
        F.coalesce(n, F.lit(0)).cast("bigint").alias("rows"),
        F.coalesce(repeats / n, F.lit(0.0)).alias("duplicate_row_rate"),
        F.coalesce(hits / n, F.lit(0.0)).alias("exact_overlap_rate"),
    )


def rare_combinations(real: DataFrame, syn: DataFrame, keys: Sequence[str], at_most: int = 2) -> DataFrame:
    """Share of synthetic rows whose key combination occurs 1..``at_most`` times in real."""
    keys = [k for k in keys if k in syn.columns]
    if not keys:
        return syn.sparkSession.createDataFrame(
            [(None,)], "rare_combo_leakage_rate double"
        )
    pairs = tag_pair(real.select(*keys), syn.select(*keys), keys).groupBy(*keys).agg(
        F.sum("_real").alias("real_n"), F.sum("_syn").alias("syn_n")
    )
    hits = F.sum(F.when(F.col("real_n").between(1, at_most), F.col("syn_n")).otherwise(0))
    return pairs.agg(
        F.coalesce(hits / F.greatest(F.lit(1), F.sum("syn_n")), F.lit(0.0)).alias("rare_combo_leakage_rate")
    )


def validation_summary(
    real: DataFrame, syn: DataFrame, rules: Rules | None = None, matrix: DataFrame | None = None
) -> DataFrame:
    """One row: size, missing, repeated and overlapping rows, rule violations."""
    matrix = rule_matrix(real, syn, rules) if matrix is None else matrix
    incomplete = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in syn.columns])
    missing = syn.select(F.avg(incomplete.cast("int"))).scalar()
    broken = matrix.select(F.avg(F.col("row_has_violation").cast("int"))).scalar()
    return row_overlap(real, syn).select(
        "rows",
        F.coalesce(missing, F.lit(0.0)).alias("missing_row_rate"),
        "duplicate_row_rate",
        F.col("exact_overlap_rate").alias("exact_overlap_with_real_train_rate"),
        F.coalesce(broken, F.lit(0.0)).alias("any_rule_violation_rate"),
    )
