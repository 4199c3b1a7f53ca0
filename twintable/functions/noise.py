"""Seeded randomness that does not depend on the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _bits(seed: int, *keys: Column) -> Column:
    """60 bits of a digest that other engines have too, so that draws can be told in SQL."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def uniform(seed: int, *keys: Column) -> Column:
    """A value in [0, 1) fixed by ``seed`` and the keys."""
    return F.shiftright(_bits(seed, *keys), 7).cast("double") / F.lit(float(2**53))


def uniform_index(n: Column, seed: int, *keys: Column) -> Column:
    """A whole number in [0, n) fixed by ``seed`` and the keys."""
    return (_bits(seed, *keys) % n).cast("bigint")


def wide_uniform_index(low: int, high: int, seed: int, *keys: Column) -> Column:
    """A whole number from ``low`` to ``high``, both included, however far apart they are."""
    size = high - low + 1
    if size <= 1 << 60:
        return F.lit(low).cast("bigint") + uniform_index(F.lit(size), seed, *keys)
    # 120 bits, as one word of 60 doesn't reach them all
    first, second = (_bits(s, *keys).cast("decimal(38,0)") for s in (seed, seed + 1))
    word = first * F.lit(1 << 60).cast("decimal(19,0)") + second
    return (F.lit(str(low)).cast("decimal(20,0)") + word % F.lit(str(size)).cast("decimal(20,0)")).cast("bigint")


def laplace(scale: float, seed: int, *keys: Column) -> Column:
    """A Laplace deviate with the given scale."""
    centred = uniform(seed, *keys) - F.lit(0.5)
    tail = F.greatest(F.lit(1.0) - F.lit(2.0) * F.abs(centred), F.lit(1e-300))
    return F.lit(-float(scale)) * F.signum(centred) * F.log(tail)
