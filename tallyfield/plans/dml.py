"""Double machine learning queries on the observational study rows."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from tallyfield.functions.uniform import uniform
from tallyfield.operators import dml as D
from tallyfield.plans import roles as R
from tallyfield.plans.experiments import diff_sql
from tallyfield.plans.registry import query
from tallyfield.session import cut_lineage

Z = f"CAST({NormalDist().inv_cdf(0.975)} AS DOUBLE)"


@query("D1", "baseline_estimates", "method:s estimate:6 se:6 ci_low:6 ci_high:6", "study", f"""
    SELECT 'naive' AS method, estimate, se, lo AS ci_low, hi AS ci_high
    FROM ({diff_sql('study')}) AS d
    UNION ALL
    SELECT 'regression', theta, se, theta - {Z} * se, theta + {Z} * se
    FROM (SELECT any_value(theta) AS theta,
                 sqrt(count(*) / (count(*) - 3.0) * sum(v * v * e * e)) / sum(v * v) AS se
          FROM (SELECT *, y - my - theta * (t - mt) - (cy - theta * ct) * (w - mw) AS e
                FROM (SELECT *, t - mt - ct * (w - mw) AS v, cy_raw AS cy,
                             (syt - syw * stw / sww) / (stt - stw * stw / sww) AS theta
                      FROM (SELECT s.y, s.t, s.balance AS w, m.*, stw / sww AS ct,
                                   syw / sww AS cy_raw
                            FROM study AS s, (SELECT avg(y) AS my, avg(t) AS mt, avg(balance) AS mw,
                                   covar_samp(y, t) AS syt, covar_samp(y, balance) AS syw,
                                   covar_samp(t, balance) AS stw, var_samp(t) AS stt,
                                   var_samp(balance) AS sww FROM study) AS m) AS a) AS b) AS c) AS f
    """)
def _(spark, sf):
    return D.baseline_estimates(R.study(spark, sf), "y", "t", ["balance"])


R.role_sql("folds5", "study", f"""
    SELECT *, (row_number() OVER (PARTITION BY t ORDER BY {R.sql_uniform('fold1', 'customer_id')},
                                  customer_id) - 1) % 5 AS fold FROM study""")


def folded(spark, sf):
    return D.folds(R.study(spark, sf), "customer_id", 5, "t", 1)


@query("D2", "folds", "customer_id:i t:i fold:i", "folds5", "SELECT * FROM folds5")
def _(spark, sf):
    return folded(spark, sf)


R.role_sql("crossed", "folds5", """
    SELECT a.*, iy + sy * balance AS y_cf, it + st * balance AS t_cf
    FROM folds5 AS a JOIN (
      SELECT f, regr_intercept(y, balance) AS iy, regr_slope(y, balance) AS sy,
             regr_intercept(t, balance) AS it, regr_slope(t, balance) AS st
      FROM folds5, (SELECT unnest(range(5)) AS f) AS k WHERE fold <> f GROUP BY f) AS b ON f = fold""")


def crossed(spark, sf):
    rows = cut_lineage(folded(spark, sf))
    return D.cross_fit(D.cross_fit(rows, "y", ["balance"], "y_cf"), "t", ["balance"], "t_cf")


@query("D3", "cross_fit", "customer_id:i fold:i y_cf:6 t_cf:6", "crossed", "SELECT * FROM crossed")
def _(spark, sf):
    return crossed(spark, sf)


# Newton steps of the three-parameter model for all folds at once; the 3 x 3 system by Cramer's rule
@query("D3", "cross_fit_logistic", "customer_id:i fold:i t_cf:4", "folds5", """
    WITH RECURSIVE cases AS (SELECT fold, t, balance / 1000 AS x, history AS z FROM folds5),
    newton AS (
      SELECT f, 0 AS step, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1, CAST(0 AS DOUBLE) AS b2
      FROM (SELECT unnest(range(5)) AS f) AS k
      UNION ALL
      SELECT f, step + 1,
             b0 + (g0 * (b * c - e * e) - d1 * (g1 * c - e * g2) + d2 * (g1 * e - b * g2)) / det,
             b1 + (a * (g1 * c - e * g2) - g0 * (d1 * c - e * d2) + d2 * (d1 * g2 - g1 * d2)) / det,
             b2 + (a * (b * g2 - g1 * e) - d1 * (d1 * g2 - g1 * d2) + g0 * (d1 * e - b * d2)) / det
      FROM (SELECT *, a * (b * c - e * e) - d1 * (d1 * c - e * d2) + d2 * (d1 * e - b * d2) AS det
            FROM (SELECT f, step, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2,
                         sum(t - p) AS g0, sum((t - p) * x) AS g1, sum((t - p) * z) AS g2,
                         sum(p * (1 - p)) AS a, sum(p * (1 - p) * x * x) AS b, sum(p * (1 - p) * z * z) AS c,
                         sum(p * (1 - p) * x) AS d1, sum(p * (1 - p) * z) AS d2, sum(p * (1 - p) * x * z) AS e
                  FROM (SELECT n.*, t, x, z, 1 / (1 + exp(-(b0 + b1 * x + b2 * z))) AS p
                        FROM newton AS n JOIN cases ON fold <> f WHERE step < 12) AS q
                  GROUP BY f, step) AS m) AS s)
    SELECT customer_id, fold, 1 / (1 + exp(-(b0 + b1 * balance / 1000 + b2 * history))) AS t_cf
    FROM folds5 JOIN newton ON f = fold AND step = 12""")
def _(spark, sf):
    return D.cross_fit(folded(spark, sf).withColumn("x", F.col("balance") / 1000), "t",
                       ["x", "history"], "t_cf", "logistic")


def dml_sql(src: str) -> str:
    return f"""
    SELECT theta, se, theta - {Z} * se AS ci_low, theta + {Z} * se AS ci_high
    FROM (SELECT any_value(theta) AS theta, sqrt(sum(v * v * pow(u - theta * v, 2))) / sum(v * v) AS se
          FROM (SELECT u, v, (SELECT sum((t - t_hat) * (y - y_hat)) / sum(pow(t - t_hat, 2))
                              FROM {src}) AS theta
                FROM (SELECT y - y_hat AS u, t - t_hat AS v FROM {src}) AS r) AS q) AS s"""


DML = "theta:6 se:6 ci_low:6 ci_high:6"


@query("D4", "dml_estimate", DML, "study", dml_sql("study"))
def _(spark, sf):
    return D.dml_estimate(R.study(spark, sf))


R.role_sql("overlap_rows", "study", """
    SELECT * FROM study WHERE t_hat BETWEEN CAST(0.1 AS DOUBLE) AND CAST(0.9 AS DOUBLE)""")


@query("D5", "trimmed_estimate", DML + " share_kept:6 weight_share_dropped:6",
       "study overlap_rows", f"""
    SELECT d.*, share_kept, weight_share_dropped FROM ({dml_sql('overlap_rows')}) AS d,
      (SELECT avg(CASE WHEN k THEN 1.0 ELSE 0 END) AS share_kept,
              sum(CASE WHEN k THEN 0 ELSE w END) / sum(w) AS weight_share_dropped
       FROM (SELECT t_hat BETWEEN CAST(0.1 AS DOUBLE) AND CAST(0.9 AS DOUBLE) AS k,
                    t_hat * (1 - t_hat) AS w FROM study) AS s) AS t""")
def _(spark, sf):
    return D.trimmed_estimate(R.study(spark, sf), 0.1, 0.9)


@query("D6", "true_averages", "ate:6 att:6 atc:6 overlap:6", "study", """
    SELECT avg(tau) AS ate, sum(e * tau) / sum(e) AS att, sum((1 - e) * tau) / sum(1 - e) AS atc,
           sum(e * (1 - e) * tau) / sum(e * (1 - e)) AS overlap FROM study""")
def _(spark, sf):
    return D.true_averages(R.study(spark, sf))


FAVORED = "(pre_orders >= 10 OR history >= 25)"


def favored():
    return (F.col("pre_orders") >= 10) | (F.col("history") >= 25)


KEPT = f"""(treatment = 0 OR {R.sql_uniform('keep', 'customer_id')}
            < CASE WHEN {FAVORED} THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END)"""


@query("D7", "confound", "customer_id:i treatment:i", "experiment",
       f"SELECT customer_id, treatment FROM experiment WHERE {KEPT}")
def _(spark, sf):
    return D.confound(R.experiment(spark, sf), favored(), "customer_id")


@query("D8", "kept_shares", "group:s rows:i share_kept:6", "experiment", f"""
    SELECT CASE WHEN treatment = 0 THEN 'control' WHEN {FAVORED} THEN 'favored' ELSE 'other' END
             AS "group", count(*) AS rows, avg(CASE WHEN {KEPT} THEN 1.0 ELSE 0 END) AS share_kept
    FROM experiment GROUP BY 1""")
def _(spark, sf):
    p = F.when(favored(), 0.9).otherwise(0.2)
    kept = (F.col("treatment") == 0) | (uniform("keep", "customer_id") < p)
    return D.kept_shares(R.experiment(spark, sf), kept, favored())


@query("D9", "leave_one_out", "left_out:s theta:5 se:5 shift:5")
def _(spark, sf):
    rows = cut_lineage(folded(spark, sf))
    return D.leave_one_out(rows, ["balance", "history", "pre_orders"], ["balance", "history"])


EDGES = [-1000, 0, 1000, 2000, 4000, 6000, 8000, 10000]


@query("D10", "binned_means", "bin:i n:i mean_balance:4 mean_t:6 mean_y:6", "study", f"""
    SELECT bin, count(*) AS n, avg(balance) AS mean_balance, avg(t) AS mean_t, avg(y) AS mean_y
    FROM (SELECT *, CASE {' '.join(f"WHEN balance > {lo} AND balance <= {hi} THEN {i}"
                                   for i, (lo, hi) in enumerate(zip(EDGES, EDGES[1:], strict=False)))}
                      END AS bin FROM study) AS b WHERE bin IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    return D.binned_means(R.study(spark, sf), "balance", EDGES, ["t", "y"])


@query("D11", "effect_by_quartile", "quartile:i n:i mean_tau:6 mean_y:6", "study", """
    SELECT CASE WHEN true_baseline <= q1 THEN 1 WHEN true_baseline <= q2 THEN 2
                WHEN true_baseline <= q3 THEN 3 ELSE 4 END AS quartile, count(*) AS n,
           avg(tau) AS mean_tau, avg(y) AS mean_y
    FROM study, (SELECT quantile_cont(true_baseline, 0.25) AS q1,
                        quantile_cont(true_baseline, 0.5) AS q2,
                        quantile_cont(true_baseline, 0.75) AS q3 FROM study) AS q GROUP BY 1""")
def _(spark, sf):
    return D.effect_by_quartile(R.study(spark, sf), "true_baseline", ["tau", "y"])


@query("D12", "dr_ate", DML, "study", f"""
    SELECT theta, se, theta - {Z} * se AS ci_low, theta + {Z} * se AS ci_high
    FROM (SELECT avg(g) AS theta, stddev_samp(g) / sqrt(count(*)) AS se
          FROM (SELECT m1 - m0 + t * (y - m1) / p - (1 - t) * (y - m0) / (1 - p) AS g
                FROM (SELECT *, y_hat - t_hat * 2 AS m0, y_hat + (1 - t_hat) * 2 AS m1,
                             least(0.99, greatest(0.01, t_hat)) AS p FROM study) AS a) AS b) AS c""")
def _(spark, sf):
    rows = R.study(spark, sf).withColumns({"mu0": F.col("y_hat") - F.col("t_hat") * 2,
                                           "mu1": F.col("y_hat") + (1 - F.col("t_hat")) * 2})
    return D.dr_ate(rows)


@query("D13", "overlap_histogram", "bin:i t:i n:i", "study", """
    SELECT least(floor(t_hat * 40), 39) AS bin, t, count(*) AS n FROM study GROUP BY 1, 2""")
def _(spark, sf):
    return D.overlap_histogram(R.study(spark, sf))


@query("D13", "overlap_shares", "below:6 above:6", "study", """
    SELECT avg(CASE WHEN t_hat < CAST(0.1 AS DOUBLE) THEN 1.0 ELSE 0 END) AS below,
           avg(CASE WHEN t_hat > CAST(0.9 AS DOUBLE) THEN 1.0 ELSE 0 END) AS above FROM study""")
def _(spark, sf):
    return D.overlap_shares(R.study(spark, sf), 0.1, 0.9)
