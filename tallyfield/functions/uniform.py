"""Replayable random numbers: uniforms read from the md5 of a key.

``rand(seed)`` depends on how rows fall into partitions, so a retried task may draw other numbers.
A hash of the row's key gives the same number on every run, cluster size and engine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def uniform(salt: str, *keys: Column | str) -> Column:
    """Uniform in [0, 1) from the first 32 bits of ``md5(salt|key|...)``."""
    return F.conv(F.substring(digest(salt, *keys), 1, 8), 16, 10).cast("double") / F.lit(TWO_32)


def digest(salt: str, *keys: Column | str) -> Column:
    """``md5(salt|key|...)``, the text that a uniform is read from."""
    return F.md5(F.concat_ws("|", F.lit(salt), *[_col(k).cast("string") for k in keys]))


def standard_normal(salt: str, *keys: Column | str) -> Column:
    """Box-Muller draw from two hash uniforms (the first kept away from 0)."""
    u1 = uniform(salt + "#1", *keys) + F.lit(0.5 / TWO_32)
    u2 = uniform(salt + "#2", *keys)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)


def poisson_one(u: Column) -> Column:
    """Poisson(1) count by inverting the CDF at a uniform of :func:`uniform`."""
    weight = F.lit(0)
    for cut in poisson_one_cuts():
        weight = weight + F.when(u >= F.lit(cut), 1).otherwise(0)
    return weight


def poisson_one_of(text: Column) -> Column:
    """:func:`poisson_one` at the uniform of a :func:`digest`, from comparisons of text: no number is read from it."""
    weight = F.lit(0)
    for cut in _digest_cuts():
        weight = weight + F.when(text >= F.lit(cut), 1).otherwise(0)
    return weight


def poisson_one_below(text: Column) -> Column:
    """:func:`poisson_one_of` for lambdas, which are not compiled: the first cut above ends the search, most often the first or second."""
    weight = F.when(text < F.lit(_digest_cuts()[0]), 0)
    for k, cut in enumerate(_digest_cuts()[1:], 1):
        weight = weight.when(text < F.lit(cut), k)
    return weight.otherwise(len(_digest_cuts()))


def drawn_at_all(text: Column) -> Column:
    """Whether :func:`poisson_one_of` is above 0."""
    return text >= F.lit(_digest_cuts()[0])


def _digest_cuts() -> list[str]:
    # a uniform reaches a cut where its 32 bits, a whole number, reach the cut in units of 2**-32 (exact: a power of two)
    return [f"{math.ceil(cut * TWO_32):08x}" for cut in poisson_one_cuts()]


def poisson_one_cuts() -> list[float]:
    """CDF of Poisson(1) at 0, 1, ... as far as a 32-bit uniform can exceed it."""
    cdf, cuts, term = 0.0, [], math.exp(-1.0)
    while True:
        cdf += term
        if cdf > 1 - 1 / TWO_32:
            return cuts
        cuts.append(round(cdf, 15))
        term /= len(cuts)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
