"""Privacy report: neighbour distances, rare combinations, exact copies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from twintable.operators.counts import quantiles
from twintable.operators.nearest import fit_space, real_to_real, synthetic_to_real
from twintable.operators.utility import histogram
from twintable.operators.validate import rare_combinations, row_overlap
from twintable.session import materialize


def distance_summary(distances: DataFrame, side: str) -> DataFrame:
    """``(side, min, p01, median, mean)`` of weighted distances."""
    marks = quantiles(distances, ["distance"], (0.01, 0.5), weight="n").select(
        F.lit(side).alias("side"), F.col("p1").alias("p01"), F.col("p50").alias("median")
    )
    base = distances.agg(
        F.lit(side).alias("side"),
        F.min("distance").alias("min"),
        (F.sum(F.col("distance") * F.col("n")) / F.sum("n")).alias("mean"),
    )
    return base.join(marks, "side").select("side", "min", "p01", "median", "mean")


def suspiciously_close_rate(syn_real: DataFrame, real_real: DataFrame) -> DataFrame:
    """Share of synthetic rows within the first percentile of real distances."""
    limit = quantiles(real_real, ["distance"], (0.01,), weight="n").select("p1").scalar()
    near = F.sum(F.when(F.col("distance") <= limit, F.col("n")).otherwise(0))
    return syn_real.agg((near / F.sum("n")).alias("suspiciously_close_rate"))


def distance_histograms(syn_real: DataFrame, real_real: DataFrame, bins: int = 30) -> DataFrame:
    parts = [
        histogram(d, ["distance"], bins, weight="n").withColumn("side", F.lit(side)).drop("column")
        for d, side in ((syn_real, "syn_to_real"), (real_real, "real_to_real"))
    ]
    return parts[0].unionByName(parts[1])


@dataclass(frozen=True)
class Distances:
    """Neighbour distances of a real table, and of one synthetic table to it."""

    space: object
    real_real: DataFrame
    syn_real: DataFrame | None = None


def real_distances(real: DataFrame, target: str) -> Distances:
    """The part that all synthetic tables share."""
    space = fit_space(real, target)
    return Distances(space, materialize(real_to_real(real, target, space)))


def with_synthetic(known: Distances, real: DataFrame, syn: DataFrame, target: str) -> Distances:
    return replace(known, syn_real=materialize(synthetic_to_real(real, syn, target, known.space)))


def privacy_summary(
    real: DataFrame, syn: DataFrame, target: str, rare_keys: Sequence[str] = (), distances: Distances | None = None
) -> DataFrame:
    """One row with both distance summaries and the three leakage rates."""
    known = distances or real_distances(real, target)
    known = known if known.syn_real is not None else with_synthetic(known, real, syn, target)
    syn_real, real_real = known.syn_real, known.real_real
    keys = list(dict.fromkeys([*rare_keys, target]))
    row = syn.sparkSession.range(1).select(
        row_overlap(real, syn).select("exact_overlap_rate").scalar().alias("exact_overlap_with_real_train_rate"),
        rare_combinations(real, syn, keys).scalar().alias("rare_combo_leakage_rate"),
        suspiciously_close_rate(syn_real, real_real).scalar().alias("suspiciously_close_rate"),
    )
    for side, distances in (("syn_to_real", syn_real), ("real_to_real", real_real)):
        marks = distance_summary(distances, side)
        row = row.withColumns({f"{side}_{m}": marks.select(m).scalar() for m in ("min", "p01", "median", "mean")})
    return row
