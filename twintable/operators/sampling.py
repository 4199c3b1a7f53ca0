"""Seeded row samplers.

Each sampler fits small tables to a real table and then makes any number of
rows. A synthetic row is decided by its number and the seed alone, so the
result does not depend on the partitioning and a lost task remakes the same
rows.
"""

from __future__ import annotations

import inspect
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from twintable.functions.noise import uniform, uniform_index, wide_uniform_index
from twintable.operators.counts import running_totals, value_counts
from twintable.operators.network import BROADCAST_ROWS, BayesNetwork, PrivateBayesNetwork
from twintable.operators.sampler import Sampler, draws, number_rows, seed_of
from twintable.session import materialize
from twintable.spec import column, numeric_columns


class Bootstrap(Sampler):
    """Real rows drawn with replacement."""

    def _fit(self, real: DataFrame) -> None:
        self.numbered = materialize(number_rows(real))

    def _generate(self, count: int, seed: int) -> DataFrame:
        picked = draws(self.numbered.sparkSession, count).withColumn(
            "_row", uniform_index(F.lit(self.rows), seed, F.col("_id"))
        )
        # as Parquet the rows look small enough to be sent to every task
        return picked.join(self.numbered.hint("merge"), "_row")


class UniformDomain(Sampler):
    """Numbers uniform over their range, other values uniform over those seen."""

    def _fit(self, real: DataFrame) -> None:
        self.numeric = numeric_columns(real)
        whole = {f.name for f in real.schema if isinstance(f.dataType, T.IntegralType)}
        strings = {f.name for f in real.schema if isinstance(f.dataType, T.StringType)}
        self.whole = [c for c in self.numeric if c in whole]
        rest = [c for c in real.columns if c in strings and c not in self.numeric]
        typed = [c for c in real.columns if c not in strings and c not in self.numeric]

        def bound(g, c):
            return g(F.col(c) if c in whole else F.col(c).cast("double"))

        limits = [bound(g, c).alias(f"{n}_{c}") for c in self.numeric for n, g in (("lo", F.min), ("hi", F.max))]
        found = real.agg(F.count(F.lit(1)), *limits).first()
        self.limits = {c: (found[f"lo_{c}"], found[f"hi_{c}"]) for c in self.numeric}
        self.domains = {}
        if rest:
            seen = value_counts(real, rest).where(F.col("value").isNotNull()).select("column", "value", F.lit(1).alias("n"))
            ranked = materialize(running_totals(seen, ["n"]))
            sizes = {r["column"]: r["k"] for r in ranked.groupBy("column").agg(F.count(F.lit(1)).alias("k")).collect()}
            for c in rest:
                domain = ranked.where(F.col("column") == c).select(
                    (F.col("upto_n") - 1).cast("bigint").alias(f"_at_{c}"), F.col("value").alias(c)
                )
                self.domains[c] = (sizes.get(c, 0), domain)
        for c in typed:  # dates, flags and nested values keep their type
            seen = materialize(number_rows(real.select(c).where(F.col(c).isNotNull()).distinct().sort(c)))
            self.domains[c] = (seen.count(), seen.select(F.col("_row").alias(f"_at_{c}"), c))

    def _generate(self, count: int, seed: int) -> DataFrame:
        rows = draws(SparkSession.active(), count)
        for c, (lo, hi) in self.limits.items():
            if lo is None:
                value = F.lit(None).cast("double")
            elif c in self.whole:  # every whole number of the range alike
                value = wide_uniform_index(lo, hi, seed_of(seed, c), F.col("_id"))
            else:
                value = F.lit(lo) + uniform(seed_of(seed, c), F.col("_id")) * (hi - lo)
            rows = rows.withColumn(c, value)
        for c, (size, domain) in self.domains.items():
            if size == 0:
                rows = rows.withColumn(c, F.lit(None).cast(self.schema[c].dataType))
                continue
            # few values would make hot join keys, so they are sent out instead
            domain = F.broadcast(domain) if size <= BROADCAST_ROWS else domain
            rows = rows.withColumn(f"_at_{c}", uniform_index(F.lit(size), seed_of(seed, c), F.col("_id")))
            rows = rows.join(domain, f"_at_{c}").drop(f"_at_{c}")
        return rows


class Marginals(Sampler):
    """Every column drawn on its own from its empirical distribution.

    A column value is that of an independently drawn real row, which is exact
    for any number of distinct values and joins on evenly spread row numbers.
    """

    def _fit(self, real: DataFrame) -> None:
        self.numbered = materialize(number_rows(real))

    def _generate(self, count: int, seed: int) -> DataFrame:
        rows = draws(self.numbered.sparkSession, count)
        for f in self.schema:
            draw = uniform_index(F.lit(self.rows), seed_of(seed, f.name), F.col("_id"))
            # a column of the rows looks small enough as Parquet to be sent to every task, all of them at once
            rows = rows.withColumn("_row", draw).join(self.numbered.select("_row", column(f.name)).hint("merge"), "_row").drop("_row")
        return rows


SAMPLERS = {
    "bootstrap": Bootstrap,
    "uniform_domain": UniformDomain,
    "marginals": Marginals,
    "bayes_network": BayesNetwork,
    "private_bayes_network": PrivateBayesNetwork,
}


def make_sampler(name: str, options: dict | None = None) -> tuple[Sampler, dict, dict]:
    """A sampler, the options it took and those it does not know."""
    kind = SAMPLERS[name]
    accepted = set(inspect.signature(kind).parameters)
    used = {k: v for k, v in (options or {}).items() if k in accepted}
    ignored = {k: v for k, v in (options or {}).items() if k not in accepted}
    return kind(**used), used, ignored


def generate_table(
    real: DataFrame,
    name: str,
    count: int = 0,
    drop: Sequence[str] = (),
    options: dict | None = None,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Synthetic rows, and one row of facts about how they were made."""
    kept = real.drop(*drop)
    sampler, used, ignored = make_sampler(name, options)
    made = sampler.fit(kept).generate(count, seed)
    facts = real.sparkSession.createDataFrame(
        [(name, sampler.rows, len(kept.columns), count or sampler.rows, len(made.columns), str(used), str(ignored))],
        "model string, rows_in bigint, columns_in bigint, rows_out bigint, columns_out bigint,"
        " options string, ignored_options string",
    )
    return made, facts


@dataclass(frozen=True)
class TimedRun:
    once: DataFrame
    five_times: DataFrame
    fit_seconds: float
    generate_1x_seconds: float
    generate_5x_seconds: float
    used: dict
    ignored: dict


def timed_generation(real: DataFrame, name: str, options: dict | None = None, seed: int = 42) -> TimedRun:
    """Fit, then write as many and five times as many rows, timing each."""
    sampler, used, ignored = make_sampler(name, options)
    marks = [time.perf_counter()]
    sampler.fit(real)
    marks.append(time.perf_counter())
    once = materialize(sampler.generate(sampler.rows, seed))
    marks.append(time.perf_counter())
    five = materialize(sampler.generate(5 * sampler.rows, seed + 1))
    marks.append(time.perf_counter())
    fit, one, many = (b - a for a, b in zip(marks, marks[1:]))
    return TimedRun(once, five, fit, one, many, used, ignored)
