"""Special functions as Column expressions, so they stay inside whole-stage codegen.

Spark has no lgamma, digamma or erfc. The first two use the asymptotic series after shifting the
argument up by eight; the error is below 1e-11 for arguments from 0.05 to several hundred.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

SHIFT = 8


def lgamma(x: Column) -> Column:
    """Natural log of the gamma function for x > 0."""
    y = x + float(SHIFT)
    product = x
    for k in range(1, SHIFT):
        product = product * (x + float(k))
    inv = 1.0 / y
    inv2 = inv * inv
    series = inv * (1.0 / 12 - inv2 * (1.0 / 360 - inv2 * (1.0 / 1260 - inv2 * (1.0 / 1680))))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def digamma(x: Column) -> Column:
    """Derivative of :func:`lgamma` for x > 0."""
    y = x + float(SHIFT)
    below = 1.0 / x
    for k in range(1, SHIFT):
        below = below + 1.0 / (x + float(k))
    inv2 = 1.0 / (y * y)
    series = inv2 * (1.0 / 12 - inv2 * (1.0 / 120 - inv2 * (1.0 / 252 - inv2 * (1.0 / 240))))
    return F.log(y) - 0.5 / y - series - below


def trigamma(x: Column) -> Column:
    """Derivative of :func:`digamma` for x > 0."""
    y = x + float(SHIFT)
    below = 1.0 / (x * x)
    for k in range(1, SHIFT):
        below = below + 1.0 / ((x + float(k)) * (x + float(k)))
    inv = 1.0 / y
    inv2 = inv * inv
    return below + inv * (1.0 + 0.5 * inv + inv2 * (1.0 / 6 - inv2 * (1.0 / 30 - inv2 * (1.0 / 42 - inv2 * (1.0 / 30)))))


def log_beta(a: Column, b: Column) -> Column:
    return lgamma(a) + lgamma(b) - lgamma(a + b)


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0; meant for a handful of summary rows.

    Series with positive terms below 5, continued fraction above.
    """
    def step(acc: Column, n: Column) -> Column:
        term = acc["term"] * 2.0 * x * x / (2.0 * n + 1.0)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    zero = F.struct(x.alias("term"), x.alias("total"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(120)), zero, step, lambda acc: acc["total"])
    near = 1.0 - 2.0 / math.sqrt(math.pi) * F.exp(-x * x) * series
    fraction = x
    for k in range(60, 0, -1):
        fraction = x + (k / 2.0) / fraction
    far = F.exp(-x * x) / (math.sqrt(math.pi) * fraction)
    return F.when(x < 3.0, near).otherwise(far)


def normal_two_sided(z: Column) -> Column:
    """Two-sided p-value of a standard normal statistic."""
    return erfc(F.abs(z) / math.sqrt(2.0))


NEAR_ONE = 0.75  # beyond it the series about 0 converges slowly
MOST_TERMS = 100_000


def gauss_series(a: np.ndarray, b: np.ndarray, c: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Sum of (a)_n (b)_n / (c)_n z^n / n!; an error if it has not settled after MOST_TERMS terms."""
    term, total = np.ones_like(z), np.ones_like(z)
    for n in range(MOST_TERMS):
        term = term * (a + n) * (b + n) / ((c + n) * (n + 1.0)) * z
        total = total + term
        if n > 8 and np.all(np.abs(term) <= 1e-17 * np.abs(total)):
            return total
    raise ArithmeticError("the hypergeometric series did not settle")


def gauss_towards_one(a: np.ndarray, b: np.ndarray, c: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The same function for 1/2 <= z < 1 by Taylor expansions that halve the distance to 1.

    The expansion about z0 follows from the differential equation
    z (1 - z) w'' + (c - (a + b + 1) z) w' - a b w = 0: two coefficients give the next.
    """
    at = np.full_like(z, 0.5)
    w, slope = gauss_series(a, b, c, at), a * b / c * gauss_series(a + 1, b + 1, c + 1, at)
    while np.any(at < z):
        h = np.minimum((1 - at) / 2, z - at)
        p, q, first = at * (1 - at), 1 - 2 * at, c - (a + b + 1) * at
        older, newer = w, slope  # coefficients n and n + 1
        w, slope, power = older + newer * h, newer.copy(), h.copy()
        for n in range(200):
            older, newer = newer, ((n * (n - 1) + (a + b + 1) * n + a * b) * older
                                   - (n + 1) * (q * n + first) * newer) / (p * (n + 1) * (n + 2))
            slope = slope + (n + 2) * newer * power
            power = power * h
            change = newer * power
            w = w + change
            if n > 8 and np.all(np.abs(change) <= 1e-18 * np.abs(w)):
                break
        else:
            raise ArithmeticError("the expansion of the hypergeometric function did not settle")
        at = at + h
    return w


def gauss(a: np.ndarray, b: np.ndarray, c: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Gauss hypergeometric function for 0 <= z < 1.

    The Euler transform moves the large parameters into a power of 1 - z, so that frequent buyers cost few terms.
    """
    p, q = c - a, c - b
    out = np.full_like(z, np.nan)
    near = z > NEAR_ONE
    known = np.isfinite(a + b + c + z) & (z >= 0) & (z < 1)
    for part, of in ((known & ~near, gauss_series), (known & near, gauss_towards_one)):
        if part.any():
            out[part] = of(p[part], q[part], c[part], z[part])
    return (1.0 - z) ** (c - a - b) * out


@F.pandas_udf(DoubleType())
def hyp2f1(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]
           ) -> Iterator[pd.Series]:
    """:func:`gauss` of four columns; missing where one of them is, or z is outside [0, 1)."""
    for columns in parts:
        yield pd.Series(gauss(*(s.to_numpy(dtype=float) for s in columns)))
