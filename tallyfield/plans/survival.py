"""Survival queries: customers as subscribers who leave 180 days after their last order."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from tallyfield.operators import survival as V
from tallyfield.plans import roles as R
from tallyfield.plans.draws import poisson_sql
from tallyfield.plans.registry import query

COVARIATES = ["plan_standard", "plan_premium", "onboarded", "intro_offer"]
Z = f"CAST({NormalDist().inv_cdf(0.975)} AS DOUBLE)"


def subs(spark, sf):
    return V.plan_indicators(V.tenure_and_churn(R.subscribers(spark, sf), R.LOG_END))


@query("V1", "tenure_and_churn", "customer_id:i start_date:d tenure_months:6 churned:i", "subs",
       "SELECT * FROM subs")
def _(spark, sf):
    return subs(spark, sf)


@query("V2", "plan_indicators", "customer_id:i plan_standard:i plan_premium:i", "subs", """
    SELECT customer_id, CAST(plan = 'standard' AS INT) AS plan_standard,
           CAST(plan = 'premium' AS INT) AS plan_premium FROM subs""")
def _(spark, sf):
    return subs(spark, sf)


@query("V2", "share_onboarded", "plan:s share_onboarded:6 subscribers:i", "subs", """
    SELECT plan, avg(onboarded) AS share_onboarded, count(*) AS subscribers FROM subs GROUP BY 1""")
def _(spark, sf):
    return V.share_onboarded(subs(spark, sf))


def life_sql(src: str, by: str = "", w: str = "1") -> str:
    """Life table (by, t, d, n, survival, before, greenwood) of rows (t, e)."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""
    SELECT *, CASE WHEN last_one THEN 0 ELSE exp(logs) END AS survival,
           CASE WHEN last_one AND d < n THEN 0 ELSE exp(logs - own) END AS before
    FROM (SELECT *, sum(own) OVER ({part}ORDER BY t) AS logs,
                 sum(CASE WHEN d < n THEN d / (n * (n - d)) ELSE 0 END) OVER ({part}ORDER BY t)
                   AS greenwood, bool_or(d >= n) OVER ({part}ORDER BY t) AS last_one
          FROM (SELECT *, CASE WHEN d < n THEN ln(1 - d / n) ELSE 0 END AS own
                FROM (SELECT {keys}t, CAST(d AS DOUBLE) AS d,
                             CAST(sum(leaving) OVER ({part}ORDER BY t DESC) AS DOUBLE) AS n
                      FROM (SELECT {keys}t, sum(CASE WHEN e = 1 THEN {w} ELSE 0 END) AS d,
                                   sum({w}) AS leaving FROM {src} GROUP BY {keys}t) AS g) AS r
                WHERE d > 0) AS o) AS c"""


ROWS = "(SELECT *, tenure_months AS t, churned AS e FROM subs) AS s"


@query("V3", "kaplan_meier", "plan:s t:6 survival:8", "subs",
       f"SELECT plan, t, survival FROM ({life_sql(ROWS, 'plan')}) AS l")
def _(spark, sf):
    return V.kaplan_meier(subs(spark, sf), by=["plan"])


@query("V4", "km_interval", "time:1 survival:8 lower:7 upper:7", "subs", f"""
    SELECT time, s AS survival, pow(s, exp(-{Z} * sqrt(v) / ln(s))) AS lower,
           pow(s, exp({Z} * sqrt(v) / ln(s))) AS upper
    FROM (SELECT time, max_by(survival, t) AS s, max_by(greenwood, t) AS v
          FROM ({life_sql(ROWS)}) AS l, (SELECT CAST(unnest([6, 12, 24, 48, 72]) AS DOUBLE) AS time)
          WHERE t <= time GROUP BY 1) AS k""")
def _(spark, sf):
    return V.km_interval(V.life_table(subs(spark, sf)), [6, 12, 24, 48, 72])


R.role_sql("yearly", "subs", """
    SELECT cohort, period, count(*) FILTER (WHERE y >= period) / count(*) AS survival
    FROM (SELECT plan AS cohort, tenure_months / 12 AS y, unnest(range(0, 5)) AS period FROM subs)
      AS p GROUP BY 1, 2""")


@query("V5", "expected_periods", "cohort:s expected_periods:6", "yearly", """
    SELECT cohort, sum(survival) AS expected_periods FROM yearly WHERE period < 4 GROUP BY 1""")
def _(spark, sf):
    years = F.col("tenure_months") / 12
    rows = subs(spark, sf).select(F.col("plan").alias("cohort"), years.alias("y"), F.explode(
        F.sequence(F.lit(0), F.lit(4))).alias("period"))
    curve = rows.groupBy("cohort", "period").agg(
        F.avg((F.col("y") >= F.col("period")).cast("double")).alias("survival"))
    return V.expected_periods(curve, 4, by=["cohort"])


def rmst_sql(src: str, by: str, horizon: float = 36.0, w: str = "1") -> str:
    using = f"USING ({by})"
    return f"""
    SELECT {by}, {horizon} - coalesce(lost, 0) AS rmst
    FROM (SELECT DISTINCT {by} FROM {src}) AS k LEFT JOIN (
      SELECT {by}, sum(CASE WHEN t <= {horizon} THEN (before - survival) * ({horizon} - t) ELSE 0 END)
               AS lost FROM ({life_sql(src, by, w)}) AS l GROUP BY {by}) AS a {using}"""


@query("V6", "rmst", "plan:s onboarded:i rmst:6", "subs", rmst_sql(ROWS, "plan, onboarded"))
def _(spark, sf):
    return V.rmst(subs(spark, sf), 36.0, by=["plan", "onboarded"])


def gain_sql(src: str, by: str = "", w: str = "1") -> str:
    keys = f"{by}, " if by else ""
    return f"""
    SELECT {keys}plan, rmst_onboarded, rmst_not, rmst_onboarded - rmst_not AS difference, weight,
           weight * (rmst_onboarded - rmst_not) AS weighted
    FROM (SELECT {keys}plan, max(rmst) FILTER (WHERE onboarded = 1) AS rmst_onboarded,
                 max(rmst) FILTER (WHERE onboarded = 0) AS rmst_not
          FROM ({rmst_sql(src, keys + 'plan, onboarded', w=w)}) AS r GROUP BY {keys}plan) AS p
    JOIN (SELECT plan, count(*) / sum(count(*)) OVER () AS weight FROM subs WHERE onboarded = 0
          GROUP BY plan) AS t USING (plan)"""


@query("V7", "rmst_by_plan", "plan:s rmst_onboarded:6 rmst_not:6 difference:6 weight:6 weighted:6",
       "subs", gain_sql(ROWS))
def _(spark, sf):
    s = subs(spark, sf)
    return V.rmst_by_plan(s, 36.0, V.target_weights(s))


@query("V7", "rmst_gain", "gain:6", "subs",
       f"SELECT sum(weighted) AS gain FROM ({gain_sql(ROWS)}) AS g")
def _(spark, sf):
    s = subs(spark, sf)
    return V.rmst_gain(s, 36.0, V.target_weights(s))


BOOT = f"""(SELECT * FROM (SELECT *, {poisson_sql(R.sql_uniform('rmst', 'customer_id', 'b'))} AS w
            FROM (SELECT *, tenure_months AS t, churned AS e, unnest(range(1, 201)) AS b FROM subs)
            AS x) AS y WHERE w > 0) AS z"""
R.role_sql("gains", "subs", f"""
    SELECT b, sum(weighted) AS gain FROM ({gain_sql(BOOT, 'b', 'w')}) AS g GROUP BY b""")


def gains(spark, sf):
    s = subs(spark, sf)
    return V.rmst_bootstrap(s, 36.0, V.target_weights(s), resamples=200)


@query("V8", "rmst_bootstrap", "b:i gain:6", "gains", "SELECT * FROM gains")
def _(spark, sf):
    return gains(spark, sf)


@query("V9", "landmark_split", "customer_id:i part:s tenure_months:6 churned:i", "subs", """
    SELECT customer_id, 'before' AS part, least(tenure_months, 24) AS tenure_months,
           CASE WHEN tenure_months > 24 THEN 0 ELSE churned END AS churned FROM subs
    UNION ALL SELECT customer_id, 'after', tenure_months - 24, churned FROM subs
    WHERE tenure_months > 24""")
def _(spark, sf):
    return V.landmark_split(subs(spark, sf), 24.0)


@query("V10", "monthly_churn", "intro_offer:i month:i active:i cancellations:i rate:7", "subs", """
    SELECT intro_offer, month, count(*) FILTER (WHERE t > month - 1) AS active,
           count(*) FILTER (WHERE t > month - 1 AND t <= month AND churned = 1) AS cancellations,
           count(*) FILTER (WHERE t > month - 1 AND t <= month AND churned = 1)
             / nullif(count(*) FILTER (WHERE t > month - 1), 0) AS rate
    FROM (SELECT *, tenure_months AS t, unnest(range(1, 61)) AS month FROM subs) AS m
    GROUP BY 1, 2""")
def _(spark, sf):
    return V.monthly_churn(subs(spark, sf), 60)


@query("V11", "dashboard_rates", "all_subscribers:6 known_status:6", "subs", """
    SELECT 1 - avg(CASE WHEN c THEN 1.0 ELSE 0 END) AS all_subscribers,
           count(*) FILTER (WHERE b) / count(*) FILTER (WHERE b OR c) AS known_status
    FROM (SELECT churned = 1 AND tenure_months <= 48 AS c, tenure_months > 48 AS b FROM subs) AS s""")
def _(spark, sf):
    return V.dashboard_rates(subs(spark, sf), 48.0)


@query("V12", "cox_fit", "covariate:s coef:5 se:5 hr:5 lower:5 upper:5")
def _(spark, sf):
    return V.cox_fit(subs(spark, sf), COVARIATES)


@query("V13", "ph_test", "covariate:s statistic:4 p_value:5")
def _(spark, sf):
    return V.ph_test(subs(spark, sf), COVARIATES)


@query("V14", "nudge_value", "q:2 value:6 lo:6 hi:6 p_pays:6 breakeven_lo:6 breakeven_hi:6", "gains",
       """
    SELECT q, q * 9 * mean AS value, q * 9 * lo AS lo, q * 9 * hi AS hi, p_pays, breakeven_lo,
           breakeven_hi
    FROM (SELECT q, avg(gain) AS mean, quantile_cont(gain, 0.025) AS lo,
                 quantile_cont(gain, 0.975) AS hi,
                 avg(CASE WHEN q * 9 * gain > 4.5 THEN 1.0 ELSE 0 END) AS p_pays,
                 quantile_cont(4.5 / (gain * 9), 0.025) AS breakeven_lo,
                 quantile_cont(4.5 / (gain * 9), 0.975) AS breakeven_hi
          FROM gains, (SELECT CAST(unnest([0.05, 0.1, 0.2]) AS DOUBLE) AS q) AS g GROUP BY q) AS s""")
def _(spark, sf):
    return V.nudge_value(gains(spark, sf), (0.05, 0.1, 0.2), 9.0, 4.5)
