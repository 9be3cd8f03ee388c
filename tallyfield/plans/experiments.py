"""Experiment queries on customers with a hash-coin treatment."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from tallyfield.functions.uniform import uniform
from tallyfield.operators import experiments as X
from tallyfield.plans import roles as R
from tallyfield.plans.draws import poisson_sql
from tallyfield.plans.registry import query

Z = NormalDist().inv_cdf(0.975)
ZP = Z + NormalDist().inv_cdf(0.8)


@query("E1", "arm_counts", "treatment:i units:i", "experiment", """
    SELECT unnest([0, 1, 2]) AS treatment, unnest([count(*) FILTER (WHERE treatment = 0),
           count(*) FILTER (WHERE treatment = 1), 0]) AS units FROM experiment""")
def _(spark, sf):
    return X.arm_counts(R.experiment(spark, sf), [0, 1, 2])


@query("E2", "srm_test", "n:i statistic:8", "experiment", """
    SELECT n, pow(a - n / 2.0, 2) / (n / 2.0) + pow(n - a - n / 2.0, 2) / (n / 2.0) AS statistic
    FROM (SELECT count(*) AS n, count(*) FILTER (WHERE treatment = 1) AS a FROM experiment) AS c""")
def _(spark, sf):
    return X.srm_test(X.arm_counts(R.experiment(spark, sf), [0, 1]), {0: 0.5, 1: 0.5})


@query("E3", "sample_size", "metric:s sd:6 n_per_arm:i mde:6", "experiment", f"""
    SELECT metric, sd, ceil(2 * pow(CAST({ZP} AS DOUBLE) * sd / effect, 2)) AS n_per_arm,
           CAST({ZP} AS DOUBLE) * sd * sqrt(2 / (n / 2.0)) AS mde
    FROM (SELECT unnest(['spend', 'conversion', 'history']) AS metric,
                 unnest([stddev_samp(spend), stddev_samp(conversion), stddev_samp(history)]) AS sd,
                 CAST(unnest([1.0, 0.02, 0.5]) AS DOUBLE) AS effect, count(*) AS n
          FROM experiment) AS m""")
def _(spark, sf):
    return X.sample_size(R.experiment(spark, sf),
                         {"spend": 1.0, "conversion": 0.02, "history": 0.5})


MEANS = f"""avg(y) FILTER (WHERE t = 1) - avg(y) FILTER (WHERE t = 0) AS estimate,
    sqrt(var_samp(y) FILTER (WHERE t = 1) / count(*) FILTER (WHERE t = 1)
         + var_samp(y) FILTER (WHERE t = 0) / count(*) FILTER (WHERE t = 0)) AS se"""


def diff_sql(src: str, by: str = "") -> str:
    """Difference in means over rows (y, t) of ``src``, optionally by columns."""
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""
    SELECT *, estimate - CAST({Z} AS DOUBLE) * se AS lo, estimate + CAST({Z} AS DOUBLE) * se AS hi
    FROM (SELECT {keys}{MEANS} FROM {src}{group}) AS d"""


@query("E4", "diff_in_means", "segment:s estimate:6 se:6 lo:6 hi:6", "experiment",
       diff_sql("(SELECT segment, spend AS y, treatment AS t FROM experiment) AS e", "segment"))
def _(spark, sf):
    return X.diff_in_means(R.experiment(spark, sf), "spend", by=["segment"])


@query("E5", "cuped", "theta:6 variance_reduction:6 raw_effect:6 raw_se:6 adjusted_effect:6"
       " adjusted_se:6", "experiment", """
    SELECT any_value(theta) AS theta, 1 - var_samp(z) / var_samp(spend) AS variance_reduction,
           avg(spend) FILTER (WHERE treatment = 1) - avg(spend) FILTER (WHERE treatment = 0)
             AS raw_effect,
           sqrt(var_samp(spend) FILTER (WHERE treatment = 1) / count(*) FILTER (WHERE treatment = 1)
             + var_samp(spend) FILTER (WHERE treatment = 0) / count(*) FILTER (WHERE treatment = 0))
             AS raw_se,
           avg(z) FILTER (WHERE treatment = 1) - avg(z) FILTER (WHERE treatment = 0)
             AS adjusted_effect,
           sqrt(var_samp(z) FILTER (WHERE treatment = 1) / count(*) FILTER (WHERE treatment = 1)
             + var_samp(z) FILTER (WHERE treatment = 0) / count(*) FILTER (WHERE treatment = 0))
             AS adjusted_se
    FROM (SELECT e.*, theta, spend - theta * (history - mx) AS z FROM experiment AS e,
            (SELECT covar_samp(spend, history) / var_samp(history) AS theta, avg(history) AS mx
             FROM experiment) AS th) AS a""")
def _(spark, sf):
    return X.cuped(R.experiment(spark, sf))


R.role_sql("unit_ratio", "", """
    SELECT user_id AS customer_id, sum(value) AS revenue, count(*) AS sessions FROM events
    GROUP BY 1""")


def sessions(spark, sf):
    return R.table(spark, sf, "events").select(F.col("user_id").alias("customer_id"),
                                               F.col("value").alias("revenue"))


@query("E6", "ratio_delta", "n:i ratio:6 se:6", "unit_ratio", """
    SELECT n, ratio, sqrt((vn - 2 * ratio * c + ratio * ratio * vd) / (md * md)) AS se
    FROM (SELECT count(*) AS n, sum(revenue) / sum(sessions) AS ratio,
                 var_samp(revenue) / count(*) AS vn, var_samp(sessions) / count(*) AS vd,
                 covar_samp(revenue, sessions) / count(*) AS c, avg(sessions) AS md
          FROM unit_ratio) AS m""")
def _(spark, sf):
    return X.ratio_delta(X.session_to_unit(sessions(spark, sf)), "revenue", "sessions")


@query("E7", "ratio_bootstrap", "resamples:i mean_ratio:6 se:6", "unit_ratio", f"""
    SELECT count(*) AS resamples, avg(ratio) AS mean_ratio, stddev_samp(ratio) AS se
    FROM (SELECT b, sum(w * revenue) / sum(w * sessions) AS ratio
          FROM (SELECT *, {poisson_sql(R.sql_uniform('ratio', 'customer_id', 'b'))} AS w
                FROM (SELECT *, unnest(range(1, 201)) AS b FROM unit_ratio) AS x) AS y
          GROUP BY b) AS r""")
def _(spark, sf):
    return X.ratio_bootstrap(X.session_to_unit(sessions(spark, sf)), "revenue", "sessions",
                             "customer_id", 200)


@query("E8", "session_to_unit", "customer_id:i revenue:4 sessions:i", "unit_ratio",
       "SELECT * FROM unit_ratio")
def _(spark, sf):
    return X.session_to_unit(sessions(spark, sf))


@query("E8", "naive_session_error", "sessions:i mean:6 naive_se:6", "", """
    SELECT count(*) AS sessions, avg(value) AS mean, stddev_samp(value) / sqrt(count(*)) AS naive_se
    FROM events""")
def _(spark, sf):
    return X.naive_session_error(sessions(spark, sf))


def incremental_sql(src: str) -> str:
    return f"""
    SELECT attributed, (p1 - p0) * n1 AS incremental,
           (p1 - p0 - CAST({Z} AS DOUBLE) * se) * n1 AS lo,
           (p1 - p0 + CAST({Z} AS DOUBLE) * se) * n1 AS hi, p1, p0, n1, n0
    FROM (SELECT *, sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0) AS se
          FROM (SELECT sum(y) FILTER (WHERE t = 1) AS attributed, avg(y) FILTER (WHERE t = 1) AS p1,
                       avg(y) FILTER (WHERE t = 0) AS p0, count(*) FILTER (WHERE t = 1) AS n1,
                       count(*) FILTER (WHERE t = 0) AS n0 FROM {src}) AS m) AS s"""


@query("E9", "attributed_vs_incremental", "attributed:i incremental:6 lo:6 hi:6", "experiment",
       incremental_sql("(SELECT conversion AS y, treatment AS t FROM experiment) AS e"))
def _(spark, sf):
    return X.attributed_vs_incremental(R.experiment(spark, sf))


@query("E10", "sequential_looks", "look:i n:i z:6 first_rejection:b", "experiment", f"""
    SELECT look, n, z, coalesce(look = min(CASE WHEN abs(z) > CAST({Z} AS DOUBLE) THEN look END)
             OVER (), false) AS first_rejection
    FROM (SELECT look, any_value(k) AS n,
                 (avg(spend) FILTER (WHERE treatment = 1) - avg(spend) FILTER (WHERE treatment = 0))
                 / sqrt((var_samp(spend) FILTER (WHERE treatment = 1)
                         + var_samp(spend) FILTER (WHERE treatment = 0)) / any_value(k)) AS z
          FROM (SELECT look, CAST(round_even(size * look / 10, 0) AS BIGINT) AS k, r.*
                FROM (SELECT unnest(range(1, 11)) AS look) AS l,
                     (SELECT min(c) AS size FROM (SELECT count(*) AS c FROM experiment
                                                  GROUP BY treatment) AS q) AS s,
                     (SELECT *, row_number() OVER (PARTITION BY treatment ORDER BY customer_id) AS rn
                      FROM experiment) AS r) AS x
          WHERE rn <= k GROUP BY look) AS z""")
def _(spark, sf):
    return X.sequential_looks(R.experiment(spark, sf), 10)


@query("E11", "lose_share", "customer_id:i treatment:i", "experiment", f"""
    SELECT customer_id, treatment FROM experiment WHERE customer_id NOT IN (
      SELECT customer_id FROM (
        SELECT customer_id, row_number() OVER (ORDER BY {R.sql_uniform('lost', 'customer_id')},
                                               customer_id) AS rn,
               round_even(CAST(count(*) OVER () AS DOUBLE) * 0.1, 0) AS k
        FROM experiment WHERE treatment = 1) AS r WHERE rn <= k)""")
def _(spark, sf):
    return X.lose_share(R.experiment(spark, sf), 0.1, "customer_id")


@query("E12", "covariate_correlation", "rho:6 removable:6", "experiment", """
    SELECT rho, rho * rho AS removable FROM (SELECT corr(spend, history) AS rho FROM experiment)""")
def _(spark, sf):
    return X.covariate_correlation(R.experiment(spark, sf))


@query("E13", "holdout_readout", "incremental:6 lo:6 hi:6 p1:6 p0:6 n1:i n0:i", "journeys",
       incremental_sql("(SELECT converted AS y, CASE WHEN u < 0.2 THEN 0 ELSE 1 END AS t FROM"
                       " (SELECT converted, " + R.sql_uniform("holdout", "user_id", "day")
                       + " AS u FROM journeys WHERE list_contains(path, 'click')) AS j) AS h"))
def _(spark, sf):
    from tallyfield.operators.attribution import journeys

    made = journeys(R.touches(spark, sf), R.conversions(spark, sf), ["user_id", "day"])
    reached = made.filter(F.array_contains("path", "click")).withColumn(
        "holdout", (uniform("holdout", "user_id", "day") < 0.2).cast("int"))
    return X.holdout_readout(reached)
