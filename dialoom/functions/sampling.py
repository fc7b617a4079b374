"""Deterministic draws: md5 of a seed and keys, the same in every engine and for every partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Key = Column | str


def rank_key(seed: str, *keys: Key) -> Column:
    """Text whose order is a random permutation of the keys."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))


def draw(seed: str, *keys: Key) -> Column:
    """A whole number, uniform over 0 .. 2**32 - 1."""
    return F.conv(F.substring(rank_key(seed, *keys), 1, 8), 16, 10).cast("long")


def below(bound: Column, seed: str, *keys: Key) -> Column:
    """A whole number, uniform over 0 .. bound - 1; null if bound is not positive."""
    return F.when(bound > 0, draw(seed, *keys) % F.greatest(bound, F.lit(1))).cast("long")


def unit(seed: str, *keys: Key) -> Column:
    """Uniform over [0, 1)."""
    return draw(seed, *keys) / F.lit(4294967296.0)


def weighted(names: list[str], weights: list[float], at: Column) -> Column:
    """The name whose share of the weights holds `at`, a number in [0, 1)."""
    total, upto, out = sum(weights), 0.0, None
    for name, w in list(zip(names, weights, strict=True))[:-1]:
        upto += w
        cond = at < F.lit(round(upto / total, 9))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])
