"""Controlled experiments. Nearly everything is one pass of conditional aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.special import erfc
from tallyfield.functions.uniform import uniform
from tallyfield.operators.ordering import cumulate, ranked
from tallyfield.operators.resample import resampled_sums

Z95 = NormalDist().inv_cdf(0.975)


def arm_counts(df: DataFrame, levels: Sequence[int], arm: str = "treatment") -> DataFrame:
    """Units per arm, zero for arms that do not occur."""
    cells = [F.struct(F.lit(a).alias(arm), F.count_if(F.col(arm) == a).alias("units"))
             for a in levels]
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def srm_test(counts: DataFrame, shares: dict[int, float], arm: str = "treatment",
             units: str = "units") -> DataFrame:
    """Chi-square test of the observed split against the planned shares."""
    whole = sum(shares.values())
    share = F.create_map(*[F.lit(x) for a, s in shares.items() for x in (a, s / whole)])
    total = F.sum(units)
    rows = counts.groupBy().agg(
        total.alias("n"), F.collect_list(F.struct(F.col(units).alias("o"),
                                                  share[F.col(arm)].alias("s"))).alias("a"))
    stat = F.aggregate("a", F.lit(0.0), lambda acc, x: acc + F.pow(
        x["o"] - x["s"] * F.col("n"), F.lit(2)) / (x["s"] * F.col("n")))
    out = rows.select("n", stat.alias("statistic"))
    return out.withColumn("p_value", chi_square_tail(F.col("statistic"), len(shares) - 1))


def chi_square_tail(x: Column, df: int) -> Column:
    """Upper tail of the chi-square distribution with ``df`` degrees of freedom."""
    half = x / 2.0
    if df % 2 == 0:
        tail, term = F.lit(0.0), F.lit(1.0)
        for i in range(df // 2):
            if i:
                term = term * half / float(i)
            tail = tail + term
        return F.exp(-half) * tail
    tail = erfc(F.sqrt(half))
    for i in range((df - 1) // 2):
        power = i + 0.5
        tail = tail + F.exp(-half) * F.pow(half, F.lit(power)) / math.gamma(power + 1)
    return tail


def _z(alpha: float, power: float) -> float:
    nd = NormalDist()
    return nd.inv_cdf(1 - alpha / 2) + nd.inv_cdf(power)


def sample_size(df: DataFrame, effects: dict[str, float], alpha: float = 0.05,
                power: float = 0.8) -> DataFrame:
    """Units per arm to detect each metric's effect, and the smallest effect n per arm detects.

    One row per metric; the table's units are taken as split in two equal arms for the latter.
    """
    z = _z(alpha, power)
    cells = []
    for metric, effect in effects.items():
        sd = F.stddev_samp(metric)
        per_arm = F.count(metric) / 2.0
        cells.append(F.struct(
            F.lit(metric).alias("metric"), sd.alias("sd"),
            F.ceil(2 * F.pow(z * sd / effect, F.lit(2))).alias("n_per_arm"),
            (z * sd * F.sqrt(2 / per_arm)).alias("mde")))
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def _arm_moments(y: str, t: str) -> list[Column]:
    treated = F.when(F.col(t) == 1, F.col(y).cast("double"))
    control = F.when(F.col(t) == 0, F.col(y).cast("double"))
    return [F.avg(treated).alias("m1"), F.var_samp(treated).alias("v1"),
            F.count(treated).alias("n1"), F.avg(control).alias("m0"),
            F.var_samp(control).alias("v0"), F.count(control).alias("n0")]


def diff_in_means(df: DataFrame, y: str, t: str = "treatment", by: Sequence[str] = (),
                  z: float = Z95, extra: Sequence[Column] = ()) -> DataFrame:
    """Treated minus control mean with the unpooled standard error and a normal interval.

    ``extra`` aggregates are computed in the same pass.
    """
    rows = df.groupBy(*by).agg(*_arm_moments(y, t), *extra)
    kept = [c for c in rows.columns if c not in (*by, "m1", "v1", "n1", "m0", "v0", "n0")]
    est = F.col("m1") - F.col("m0")
    se = F.sqrt(F.try_divide("v1", "n1") + F.try_divide("v0", "n0"))
    return rows.select(*by, est.alias("estimate"), se.alias("se"), (est - z * se).alias("lo"),
                       (est + z * se).alias("hi"), "n1", "n0", *kept)


def cuped(df: DataFrame, y: str = "spend", x: str = "history", t: str = "treatment") -> DataFrame:
    """Raw and covariate-adjusted effect. Theta is pooled over both arms.

    The adjusted outcome is linear in theta, so all its moments follow from one pass.
    """
    parts = [F.covar_samp(y, x).alias("cov"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy")]
    for arm in (1, 0):
        yy = F.when(F.col(t) == arm, F.col(y))
        xx = F.when(F.col(t) == arm, F.col(x))
        parts += [F.avg(yy).alias(f"my{arm}"), F.avg(xx).alias(f"mx{arm}"),
                  F.var_samp(yy).alias(f"vy{arm}"), F.var_samp(xx).alias(f"vx{arm}"),
                  F.covar_samp(yy, xx).alias(f"c{arm}"), F.count(yy).alias(f"n{arm}")]
    one = df.agg(*parts).withColumn("theta", F.col("cov") / F.col("vx"))
    th = F.col("theta")
    raw = F.col("my1") - F.col("my0")
    adjusted = raw - th * (F.col("mx1") - F.col("mx0"))

    def variance(arm: int) -> Column:
        return F.col(f"vy{arm}") + th * th * F.col(f"vx{arm}") - 2 * th * F.col(f"c{arm}")

    raw_se = F.sqrt(F.col("vy1") / F.col("n1") + F.col("vy0") / F.col("n0"))
    adj_se = F.sqrt(variance(1) / F.col("n1") + variance(0) / F.col("n0"))
    adj_all = F.col("vy") + th * th * F.col("vx") - 2 * th * F.col("cov")
    return one.select(
        "theta", (1 - adj_all / F.col("vy")).alias("variance_reduction"),
        raw.alias("raw_effect"), raw_se.alias("raw_se"), adjusted.alias("adjusted_effect"),
        adj_se.alias("adjusted_se"), (adjusted - Z95 * adj_se).alias("adjusted_lo"),
        (adjusted + Z95 * adj_se).alias("adjusted_hi"))


def ratio_delta(df: DataFrame, num: str, den: str) -> DataFrame:
    """Ratio of sums and its delta-method standard error over units."""
    n = F.count(F.lit(1))
    one = df.agg(n.alias("n"), (F.sum(num) / F.sum(den)).alias("ratio"),
                 (F.var_samp(num) / n).alias("vn"), (F.var_samp(den) / n).alias("vd"),
                 (F.covar_samp(num, den) / n).alias("c"), F.avg(den).alias("md"))
    r = F.col("ratio")
    var = (F.col("vn") - 2 * r * F.col("c") + r * r * F.col("vd")) / (F.col("md") * F.col("md"))
    return one.select("n", "ratio", F.sqrt(var).alias("se"))


def ratio_bootstrap(df: DataFrame, num: str, den: str, key: str, resamples: int = 200,
                    salt: str = "ratio") -> DataFrame:
    """Standard error of the ratio by resampling units (Poisson weights, see resample)."""
    sums = resampled_sums(df, {"n": F.col(num), "d": F.col(den)}, [key], resamples, salt)
    per = sums.select("b", F.try_divide("n", "d").alias("ratio"))
    return per.agg(F.count(F.lit(1)).alias("resamples"), F.avg("ratio").alias("mean_ratio"),
                   F.stddev_samp("ratio").alias("se"))


def session_to_unit(sessions: DataFrame, unit: str = "customer_id",
                    value: str = "revenue") -> DataFrame:
    """Per-unit numerator and denominator from one row per session."""
    return sessions.groupBy(unit).agg(F.sum(value).alias("revenue"),
                                      F.count(F.lit(1)).alias("sessions"))


def naive_session_error(sessions: DataFrame, value: str = "revenue") -> DataFrame:
    """Mean per session and the standard error that treats sessions as independent."""
    n = F.count(F.lit(1))
    return sessions.agg(n.alias("sessions"), F.avg(value).alias("mean"),
                        (F.stddev_samp(value) / F.sqrt(n)).alias("naive_se"))


def attributed_vs_incremental(df: DataFrame, y: str = "conversion",
                              t: str = "treatment") -> DataFrame:
    """Conversions among the treated, and the part the treatment caused, with its interval."""
    yes = F.col(y).cast("double")
    one = df.agg(F.sum(F.when(F.col(t) == 1, yes)).alias("attributed"),
                 F.avg(F.when(F.col(t) == 1, yes)).alias("p1"),
                 F.avg(F.when(F.col(t) == 0, yes)).alias("p0"),
                 F.count_if(F.col(t) == 1).alias("n1"), F.count_if(F.col(t) == 0).alias("n0"))
    p1, p0, n1, n0 = (F.col(c) for c in ("p1", "p0", "n1", "n0"))
    se = F.sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0)
    return one.select("attributed", ((p1 - p0) * n1).alias("incremental"),
                      ((p1 - p0 - Z95 * se) * n1).alias("lo"),
                      ((p1 - p0 + Z95 * se) * n1).alias("hi"), "p1", "p0", "n1", "n0")


def sequential_looks(df: DataFrame, looks: int, y: str = "spend", t: str = "treatment",
                     order: Sequence[str] = ("customer_id",), threshold: float = Z95) -> DataFrame:
    """z statistic after equally spaced numbers of units per arm, and the first rejecting look.

    Units enter in ``order`` within their arm. Running moments are built with range buckets; only the
    rows at the look sizes go on.
    """
    rows = df.select(*order, t, F.col(y).cast("double").alias("_y")).withColumns(
        {"_one": F.lit(1), "_y2": F.col("_y") * F.col("_y")})
    sizes = df.groupBy(t).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("n"))
    run = cumulate(rows, list(order), {"n": "_one", "s": "_y", "s2": "_y2"}, [t])
    marks = F.transform(F.sequence(F.lit(1), F.lit(looks)), lambda i: F.struct(
        F.bround(F.col("_size") * i / looks).cast("bigint").alias("n"), i.alias("look")))
    at = (run.withColumn("_size", sizes.scalar())
          .withColumn("_mark", F.explode(marks)).filter("_mark.n = n"))

    def arm(a: int, c: str) -> Column:
        return F.max(F.when(F.col(t) == a, F.col(c)))

    per = at.groupBy(F.col("_mark.look").alias("look"), F.col("n")).agg(
        *[arm(a, c).alias(f"{c}{a}") for a in (1, 0) for c in ("s", "s2")])

    def variance(a: int) -> Column:
        return (F.col(f"s2{a}") - F.col(f"s{a}") * F.col(f"s{a}") / F.col("n")) / (F.col("n") - 1)

    z = (F.col("s1") - F.col("s0")) / F.col("n") / F.sqrt((variance(1) + variance(0)) / F.col("n"))
    looked = per.select("look", "n", z.alias("z"))
    first = looked.filter(F.abs("z") > threshold).agg(F.min("look").alias("f"))
    return (looked.withColumn("_first", first.scalar())
            .withColumn("first_rejection", F.coalesce(F.col("look") == F.col("_first"),
                                                      F.lit(False))).drop("_first"))


def lose_share(df: DataFrame, share: float, key: str, t: str = "treatment",
               salt: str = "lost") -> DataFrame:
    """Drop round(share * n) random treated rows: a broken log for testing the split alarm."""
    treated = df.filter(F.col(t) == 1).select(key).withColumn("_u", uniform(salt, key))
    order = ranked(treated, ["_u", key], name="_rank")
    size = order.agg(F.bround(F.max("_rank") * share).cast("bigint").alias("k")).scalar()
    lost = order.withColumn("_k", size).filter("_rank <= _k").select(key)
    return df.join(lost, key, "left_anti")


def covariate_correlation(df: DataFrame, y: str = "spend", x: str = "history") -> DataFrame:
    """Correlation with the pre-period covariate and the variance share it can remove."""
    return df.agg(F.corr(y, x).alias("rho")).withColumn("removable", F.col("rho") * F.col("rho"))


def holdout_readout(df: DataFrame, y: str = "converted", holdout: str = "holdout") -> DataFrame:
    """Served against withheld conversion and the incremental conversions among the served."""
    served = df.withColumn("_t", 1 - F.col(holdout))
    return attributed_vs_incremental(served, y, "_t").drop("attributed")
