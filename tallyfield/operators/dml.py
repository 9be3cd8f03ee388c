"""Double machine learning: cross-fitting, residual-on-residual effects, weighted averages."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.uniform import uniform
from tallyfield.operators.experiments import diff_in_means
from tallyfield.operators.linear import moment_columns, moment_matrix, ols
from tallyfield.operators.ordering import exact_quantiles, ranked
from tallyfield.operators.uplift import aipw_column
from tallyfield.session import cut_lineage

Z95 = NormalDist().inv_cdf(0.975)


def baseline_estimates(df: DataFrame, y: str, t: str, covariates: Sequence[str]) -> DataFrame:
    """Naive difference in means, and the treatment coefficient of a regression with HC1 errors."""
    naive = diff_in_means(df, y, t).select(F.lit("naive").alias("method"), "estimate", "se",
                                           F.col("lo").alias("ci_low"), F.col("hi").alias("ci_high"))
    fit = ols(df, y, [t, *covariates], robust="HC1").filter(F.col("term") == t)
    return naive.unionByName(fit.drop("term").withColumn("method", F.lit("regression")))


def folds(df: DataFrame, key: str, k: int = 5, stratum: str = "t", seed: int = 0) -> DataFrame:
    """Fold 0..k-1 of equal size within each treatment arm, by the order of a seeded hash."""
    keys = df.select(key, stratum).withColumn("_u", uniform(f"fold{seed}", key))
    numbered = ranked(keys, ["_u", key], [stratum], "_rank").select(
        key, ((F.col("_rank") - 1) % k).cast("int").alias("fold"))
    return df.join(numbered, key)


def cross_fit(df: DataFrame, target: str, features: Sequence[str], out: str,
              model: str = "linear", fold: str = "fold", k: int = 5) -> DataFrame:
    """Out-of-fold predictions; a classifier predicts the probability of class 1.

    The linear model needs one pass: cross products per fold, each fold solved from the sum of the
    others. "logistic" takes one aggregate per Newton step for all folds together; "gbt" fits one
    pyspark.ml model per fold on the other folds.
    """
    if model == "linear":
        return _cross_fit_linear(df, target, features, out, fold)
    if model == "logistic":
        return _cross_fit_logistic(df, target, features, out, fold, k)
    if model != "gbt":
        raise ValueError(f"model is 'linear', 'logistic' or 'gbt', not {model!r}")
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    data = cut_lineage(VectorAssembler(inputCols=list(features), outputCol="_x").transform(
        df.withColumn("_y", F.col(target).cast("double"))))
    parts = None
    for i in range(k):
        train, test = data.filter(F.col(fold) != i), data.filter(F.col(fold) == i)
        scored = GBTRegressor(featuresCol="_x", labelCol="_y", predictionCol=out, maxIter=10,
                              maxDepth=3, seed=7).fit(train).transform(test)
        parts = scored if parts is None else parts.unionByName(scored)
    return parts.drop("_x", "_y")


def _cross_fit_logistic(df: DataFrame, target: str, features: Sequence[str], out: str, fold: str, k: int,
                        steps: int = 60, tolerance: float = 1e-12) -> DataFrame:
    """One Newton step for the models of all folds is one aggregate: a row adds its weighted cross products to
    every model but its own fold's, map-side. Steps end when no log likelihood gains ``tolerance`` of itself;
    a step that loses likelihood is halved. Predictions are a Column of the coefficients."""
    rows = cut_lineage(df.select(fold, F.col(target).cast("double").alias("_y"),
                                 *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)]))
    x = [F.lit(1.0), *[F.col(f"_x{i}") for i in range(len(features))]]
    held = rows.withColumn("_model", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).filter(F.col("_model") != F.col(fold))
    beta, last, best = np.zeros((k, len(x))), np.full(k, -np.inf), None
    for _ in range(steps):
        eta = sum((F.element_at(F.array(*[F.lit(float(b)) for b in beta[:, j]]), F.col("_model") + 1) * c
                   for j, c in enumerate(x)), F.lit(0.0))
        scored = held.withColumn("_eta", eta)
        p = 1 / (1 + F.exp(-F.col("_eta")))
        w = F.greatest(p * (1 - p), F.lit(1e-300))
        design = [(f"x{j}", c) for j, c in enumerate(x)]
        gain = [F.sum((F.col("_y") - p) * c).alias(f"g_{j}") for j, c in enumerate(x)]
        loglik = F.sum(F.col("_y") * F.col("_eta") - F.greatest(F.col("_eta"), F.lit(0.0))
                       - F.log1p(F.exp(-F.abs(F.col("_eta")))))
        got = {r["_model"]: r for r in scored.groupBy("_model").agg(
            loglik.alias("ll"), *gain, *moment_columns(design, w)).collect()}  # one row per fold
        now = np.array([got[i]["ll"] if i in got else 0.0 for i in range(k)])
        if best is not None:
            worse = now < last - 1e-9 * np.abs(last)
            beta[worse] = (beta[worse] + best[worse]) / 2
            if worse.any():
                continue
        if best is not None and np.all(now - last <= tolerance * np.abs(now)):
            break
        best, last = beta.copy(), now
        for i, r in got.items():
            step = np.linalg.lstsq(moment_matrix(r, len(x)), np.array([r[f"g_{j}"] for j in range(len(x))]), rcond=1e-14)[0]
            beta[i] += step
    own = lambda j: F.element_at(F.array(*[F.lit(float(b)) for b in beta[:, j]]), F.col(fold) + 1)
    score = sum((own(j + 1) * F.col(f).cast("double") for j, f in enumerate(features)), own(0))
    return df.withColumn(out, 1 / (1 + F.exp(-score)))


def _cross_fit_linear(df: DataFrame, target: str, features: Sequence[str], out: str,
                      fold: str) -> DataFrame:
    design = [("one", F.lit(1.0)), *[(f, F.col(f).cast("double")) for f in features],
              ("y", F.col(target).cast("double"))]
    n = len(design) - 1
    rows = df.groupBy(fold).agg(*moment_columns(design)).collect()  # one row per fold
    mats = {r[fold]: moment_matrix(r, n + 1) for r in rows}
    everything = sum(mats.values())
    predicted = F.lit(None).cast("double")
    for f, m in mats.items():
        rest = everything - m
        beta = np.linalg.lstsq(rest[:n, :n], rest[:n, n], rcond=None)[0]
        fitted = F.lit(float(beta[0]))
        for b, (_, c) in zip(beta[1:], design[1:n], strict=True):
            fitted = fitted + F.lit(float(b)) * c
        predicted = F.when(F.col(fold) == f, fitted).otherwise(predicted)
    return df.withColumn(out, predicted)


def _interval(df: DataFrame) -> DataFrame:
    return df.withColumns({"ci_low": F.col("theta") - Z95 * F.col("se"),
                           "ci_high": F.col("theta") + Z95 * F.col("se")})


def _residuals(y: str, t: str, y_hat: str, t_hat: str) -> tuple[Column, Column]:
    return F.col(y) - F.col(y_hat), F.col(t) - F.col(t_hat)


def _theta(df: DataFrame, u: Column, v: Column, keep: Column) -> DataFrame:
    """Theta and its HC0 error. The error's sums expand in theta, so one pass is enough."""
    def total(c: Column) -> Column:
        return F.sum(F.when(keep, c).otherwise(0.0))

    v2 = v * v
    one = df.agg(total(v * u).alias("vu"), total(v2).alias("vv"), total(v2 * u * u).alias("a"),
                 total(v2 * v * u).alias("b"), total(v2 * v2).alias("c"),
                 F.avg(keep.cast("double")).alias("share_kept"))
    th = F.col("vu") / F.col("vv")
    meat = F.col("a") - 2 * th * F.col("b") + th * th * F.col("c")
    return one.select(th.alias("theta"), (F.sqrt(meat) / F.col("vv")).alias("se"), "share_kept")


def dml_estimate(df: DataFrame, y: str = "y", t: str = "t", y_hat: str = "y_hat",
                 t_hat: str = "t_hat") -> DataFrame:
    """Residual on residual without intercept, HC0 error, 95% interval."""
    u, v = _residuals(y, t, y_hat, t_hat)
    return _interval(_theta(df, u, v, F.lit(True))).drop("share_kept")


def trimmed_estimate(df: DataFrame, low: float, high: float, y: str = "y", t: str = "t",
                     y_hat: str = "y_hat", t_hat: str = "t_hat") -> DataFrame:
    """The estimate on rows with low <= t_hat <= high, the share kept and the weight dropped."""
    u, v = _residuals(y, t, y_hat, t_hat)
    e = F.col(t_hat)
    keep = e.between(low, high)
    w = e * (1 - e)
    dropped = df.agg((F.sum(F.when(~keep, w).otherwise(0.0)) / F.sum(w)).alias("w"))
    return _interval(_theta(df, u, v, keep)).withColumn("weight_share_dropped", dropped.scalar())


def true_averages(df: DataFrame, e: str = "e", tau: str = "tau") -> DataFrame:
    """ATE, ATT, ATC and the overlap-weighted average of known effects."""
    p, x = F.col(e), F.col(tau)
    return df.agg(F.avg(x).alias("ate"), (F.sum(p * x) / F.sum(p)).alias("att"),
                  (F.sum((1 - p) * x) / F.sum(1 - p)).alias("atc"),
                  (F.sum(p * (1 - p) * x) / F.sum(p * (1 - p))).alias("overlap"))


def confound(df: DataFrame, favored: Column, key: str, t: str = "treatment",
             keep_favored: float = 0.9, keep_other: float = 0.2, salt: str = "keep") -> DataFrame:
    """Spoil an experiment: keep all controls, and treated rows with unequal probability."""
    p = F.when(favored, keep_favored).otherwise(keep_other)
    return df.filter((F.col(t) == 0) | (uniform(salt, key) < p))


def kept_shares(df: DataFrame, kept: Column, favored: Column, t: str = "treatment") -> DataFrame:
    """Share kept among controls, favored treated and other treated (``kept`` marks rows)."""
    treated = F.col(t) == 1
    cells = [F.struct(F.lit(name).alias("group"), F.count_if(g).alias("rows"),
                      F.try_divide(F.count_if(g & kept), F.count_if(g)).alias("share_kept"))
             for name, g in (("control", ~treated), ("favored", treated & favored),
                             ("other", treated & ~favored))]
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def leave_one_out(df: DataFrame, features: Sequence[str], drop: Sequence[str], y: str = "y",
                  t: str = "t", model_y: str = "linear", model_t: str = "linear") -> DataFrame:
    """Theta with all covariates and without each one of ``drop``, and its shift."""
    def estimate(cols: Sequence[str], name: str) -> DataFrame:
        fitted = cross_fit(cross_fit(df, y, cols, "_yh", model_y), t, cols, "_th", model_t)
        return dml_estimate(fitted, y, t, "_yh", "_th").withColumn("left_out", F.lit(name))

    base = estimate(features, "none")
    out = base
    for name in drop:
        out = out.unionByName(estimate([f for f in features if f != name], name))
    return out.withColumn("_base", base.select("theta").scalar()).withColumn(
        "shift", F.col("theta") - F.col("_base")).drop("_base")


def binned_means(df: DataFrame, by: str, edges: Sequence[float],
                 values: Sequence[str]) -> DataFrame:
    """Means by bin of a covariate; bins are closed on the right, the first also on the left."""
    c = F.col(by)
    bin_no = F.when(c == edges[0], 0)
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        bin_no = bin_no.when((c > lo) & (c <= hi), i)
    rows = df.withColumn("bin", bin_no).filter("bin is not null")
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(by).alias(f"mean_{by}"),
                                   *[F.avg(v).alias(f"mean_{v}") for v in values])


def effect_by_quartile(df: DataFrame, baseline: str, values: Sequence[str]) -> DataFrame:
    """Means by quartile of a baseline (edges at the exact quartiles, closed on the right)."""
    q = exact_quantiles(df, baseline, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    edges = q.select(F.struct("q1", "q2", "q3").alias("q")).scalar()
    rows = df.withColumn("_q", edges)
    b = F.col(baseline)
    quartile = (F.when(b <= F.col("_q.q1"), 1).when(b <= F.col("_q.q2"), 2)
                .when(b <= F.col("_q.q3"), 3).otherwise(4))
    return rows.groupBy(quartile.alias("quartile")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values])


def dr_ate(df: DataFrame, y: str = "y", t: str = "t", mu1: str = "mu1", mu0: str = "mu0",
           e: str = "t_hat", floor: float = 0.01) -> DataFrame:
    """Doubly robust average effect with the propensity kept away from 0 and 1."""
    p = F.least(F.lit(1 - floor), F.greatest(F.lit(floor), F.col(e)))
    g = aipw_column(y, t, mu1, mu0, p)
    n = F.count(F.lit(1))
    return _interval(df.agg(F.avg(g).alias("theta"),
                            (F.stddev_samp(g) / F.sqrt(n)).alias("se")))


def overlap_histogram(df: DataFrame, t: str = "t", t_hat: str = "t_hat",
                      bins: int = 40) -> DataFrame:
    """Predicted propensity by arm in equal bins; the last bin is closed."""
    b = F.least(F.floor(F.col(t_hat) * bins), F.lit(bins - 1))
    return df.groupBy(b.alias("bin"), t).agg(F.count(F.lit(1)).alias("n"))


def overlap_shares(df: DataFrame, low: float = 0.05, high: float = 0.95,
                   t_hat: str = "t_hat") -> DataFrame:
    """Share of rows below ``low`` and above ``high``."""
    e = F.col(t_hat)
    return df.agg(F.avg((e < low).cast("double")).alias("below"),
                  F.avg((e > high).cast("double")).alias("above"))
