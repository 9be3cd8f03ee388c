"""Least squares from sufficient statistics: one aggregate, a k x k solve, one more for the errors."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _design(xs: Sequence[str], intercept: bool) -> list[tuple[str, Column]]:
    cols = [(x, F.col(x).cast("double")) for x in xs]
    return ([("intercept", F.lit(1.0))] if intercept else []) + cols


def moment_columns(design: Sequence[tuple[str, Column]], weight: Column | None = None
                   ) -> list[Column]:
    """Sums of all products of the design columns (upper triangle), named m_i_j."""
    w = weight if weight is not None else F.lit(1.0)
    return [F.sum(w * design[i][1] * design[j][1]).alias(f"m_{i}_{j}")
            for i in range(len(design)) for j in range(i, len(design))]


def moment_matrix(row, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = row[f"m_{i}_{j}"]
    return out


def ols(df: DataFrame, y: str, xs: Sequence[str], intercept: bool = True,
        robust: str | None = None) -> DataFrame:
    """Coefficients with standard errors; ``robust="HC1"`` for the sandwich form.

    The number of regressors is small, so what reaches the driver is a k x k matrix.
    """
    design = _design(xs, intercept)
    k = len(design)
    full = [*design, (y, F.col(y).cast("double"))]
    row = df.agg(F.count(F.lit(1)).alias("n"), *moment_columns(full)).first()
    n = row["n"]
    m = moment_matrix(row, k + 1)
    inverse = np.linalg.inv(m[:k, :k])
    beta = inverse @ m[:k, k]
    if robust == "HC1":
        fitted = sum((F.lit(float(b)) * c for b, (_, c) in zip(beta, design, strict=True)),
                     F.lit(0.0))
        e = F.col(y) - fitted
        meat = moment_matrix(df.agg(*moment_columns(design, e * e)).first(), k)
        cov = inverse @ meat @ inverse * n / (n - k)
    else:
        sse = m[k, k] - beta @ m[:k, k]
        cov = inverse * sse / (n - k)
    se = np.sqrt(np.diag(cov))
    z = NormalDist().inv_cdf(0.975)
    rows = [(name, float(b), float(s), float(b - z * s), float(b + z * s))
            for (name, _), b, s in zip(design, beta, se, strict=True)]
    return df.sparkSession.createDataFrame(
        rows, "term string, estimate double, se double, ci_low double, ci_high double")
