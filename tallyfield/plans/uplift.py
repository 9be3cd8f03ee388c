"""Uplift queries on the experiment rows."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from tallyfield.operators import uplift as U
from tallyfield.plans import roles as R
from tallyfield.plans.registry import query
from tallyfield.session import cut_lineage


def exp(spark, sf):
    return R.experiment(spark, sf)


@query("U1", "one_hot_features", "customer_id:i history:8 balance:2 segment_machinery:1"
       " segment_building:1 acquisition_channel_social:1", "experiment", """
    SELECT customer_id, history, balance, CASE WHEN segment = 'MACHINERY' THEN 1 ELSE 0 END
             AS segment_machinery, CASE WHEN segment = 'BUILDING' THEN 1 ELSE 0 END
             AS segment_building, CASE WHEN acquisition_channel = 'social' THEN 1 ELSE 0 END
             AS acquisition_channel_social FROM experiment""")
def _(spark, sf):
    rows = exp(spark, sf).select("customer_id", "history", "balance", "segment",
                                 "acquisition_channel")
    return U.one_hot_features(rows, ["history", "balance"], {
        "segment": ["MACHINERY", "BUILDING"], "acquisition_channel": ["social"]})


@query("U2", "random_split", "customer_id:i in_train:b", "experiment", f"""
    SELECT customer_id, row_number() OVER (ORDER BY {R.sql_uniform('split3', 'customer_id')},
             customer_id) <= count(*) OVER () // 2 AS in_train FROM experiment""")
def _(spark, sf):
    return U.random_split(exp(spark, sf), "customer_id", 3)


@query("U3", "uplift_learners", "customer_id:i s_learner:3 t_learner:3 x_learner:3")
def _(spark, sf):
    data = cut_lineage(U.random_split(exp(spark, sf), "customer_id", 3))
    return U.uplift_learners(data.filter("in_train"), data.filter("not in_train"),
                             ["history", "balance", "pre_orders"])


R.role_sql("cum", "experiment", """
    SELECT score, sum(n_t) OVER w AS n_t, sum(n_c) OVER w AS n_c, sum(y_t) OVER w AS y_t,
           sum(y_c) OVER w AS y_c, n_t AS d_n_t, n_c AS d_n_c
    FROM (SELECT coarse_score AS score, count(*) FILTER (WHERE treatment = 1) AS n_t,
                 count(*) FILTER (WHERE treatment = 0) AS n_c,
                 coalesce(sum(spend) FILTER (WHERE treatment = 1), 0) AS y_t,
                 coalesce(sum(spend) FILTER (WHERE treatment = 0), 0) AS y_c
          FROM experiment GROUP BY 1) AS g
    WINDOW w AS (ORDER BY score DESC)
    UNION ALL SELECT NULL, 0, 0, 0, 0, 0, 0""")
QINI = "y_t - y_c * CASE WHEN n_c = 0 THEN 0 ELSE n_t / n_c END"
UPLIFT = """((CASE WHEN n_t = 0 THEN 0 ELSE y_t / n_t END)
             - (CASE WHEN n_c = 0 THEN 0 ELSE y_c / n_c END)) * (n_t + n_c)"""


@query("U4", "cumulative_by_score", "score:1 n_t:i n_c:i y_t:4 y_c:4", "cum", "SELECT * FROM cum")
def _(spark, sf):
    return U.cumulative_by_score(exp(spark, sf), score="coarse_score").withColumnRenamed(
        "coarse_score", "score")


for _id, _name, _value, _fn in (("U5", "qini_curve", QINI, U.qini_curve),
                                ("U6", "uplift_curve", UPLIFT, U.uplift_curve)):
    query(_id, _name, "score:1 fraction:6 value:4", "cum", f"""
    SELECT score, (n_t + n_c) / (SELECT max(n_t + n_c) FROM cum) AS fraction, {_value} AS value
    FROM cum""")(lambda spark, sf, fn=_fn: fn(exp(spark, sf), score="coarse_score")
                 .withColumnRenamed("coarse_score", "score"))


def area_sql(src: str, value: str, by: str = "") -> str:
    """Trapezoid area and last value of a curve from (score, y, t) rows."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""
    SELECT {keys}sum((x - coalesce(px, 0)) * (v + coalesce(pv, 0)) / 2) AS area,
           max_by(v, x) AS last
    FROM (SELECT *, lag(x) OVER ({part}ORDER BY x) AS px, lag(v) OVER ({part}ORDER BY x) AS pv
          FROM (SELECT *, (n_t + n_c) / CAST(total AS DOUBLE) AS x, {value} AS v
                FROM (SELECT {keys}score, sum(n_t) OVER w AS n_t, sum(n_c) OVER w AS n_c,
                             sum(y_t) OVER w AS y_t, sum(y_c) OVER w AS y_c, total
                      FROM (SELECT *, sum(n_t + n_c) OVER ({part}) AS total FROM (
                        SELECT {keys}score, count(*) FILTER (WHERE t = 1) AS n_t,
                               count(*) FILTER (WHERE t = 0) AS n_c,
                               coalesce(sum(y) FILTER (WHERE t = 1), 0) AS y_t,
                               coalesce(sum(y) FILTER (WHERE t = 0), 0) AS y_c
                        FROM {src} GROUP BY {keys}score) AS g0) AS g
                      WINDOW w AS ({part}ORDER BY score DESC)) AS c) AS c1) AS c2
    {f'GROUP BY {by}' if by else ''}"""


ROWS = "(SELECT score, spend AS y, treatment AS t FROM experiment)"
PERFECT = """(SELECT CASE WHEN treatment = 1 THEN top + spend ELSE -top - spend END AS score,
              spend AS y, treatment AS t
              FROM experiment, (SELECT max(abs(spend)) + 1 AS top FROM experiment) AS m)"""


@query("U7", "qini_coefficient", "qini:4 perfect:4 normalized:6", "experiment", f"""
    SELECT q.area - q.last / 2 AS qini, p.area - p.last / 2 AS perfect,
           (q.area - q.last / 2) / (p.area - p.last / 2) AS normalized
    FROM ({area_sql(ROWS + ' AS r', QINI)}) AS q, ({area_sql(PERFECT + ' AS r', QINI)}) AS p""")
def _(spark, sf):
    return U.qini_coefficient(exp(spark, sf), normalize=True)


@query("U8", "auuc", "auuc:4 above_random:4", "experiment", f"""
    SELECT area AS auuc, area - last / 2 AS above_random
    FROM ({area_sql(ROWS + ' AS r', UPLIFT)}) AS q""")
def _(spark, sf):
    rows = exp(spark, sf)
    above = U.auuc(rows, subtract_random=True)
    return U.auuc(rows).withColumn("above_random", above.scalar())


@query("U9", "uplift_at_k", "targeted:i uplift:6", "experiment", """
    SELECT count(*) AS targeted, avg(spend) FILTER (WHERE treatment = 1)
             - avg(spend) FILTER (WHERE treatment = 0) AS uplift
    FROM (SELECT *, row_number() OVER (ORDER BY coarse_score DESC, customer_id) AS rn,
                 ceil(count(*) OVER () * CAST(0.3 AS DOUBLE)) AS m FROM experiment) AS r
    WHERE rn <= m""")
def _(spark, sf):
    return U.uplift_at_k(exp(spark, sf), 0.3, "customer_id", score="coarse_score")


def models(spark, sf):
    rows = exp(spark, sf).select("customer_id", "spend", "treatment", "true_cate",
                                 F.col("score").alias("model"),
                                 F.col("coarse_score").alias("coarse"),
                                 (-F.col("history")).alias("history"))
    return rows.unpivot(["customer_id", "spend", "treatment", "true_cate"],
                        ["model", "coarse", "history"], "model", "score")


R.role_sql("models", "experiment", " UNION ALL ".join(
    f"SELECT customer_id, spend, treatment, true_cate, '{m}' AS model, {c} AS score FROM experiment"
    for m, c in (("model", "score"), ("coarse", "coarse_score"), ("history", "-history"))))


@query("U10", "qini_table", "model:s qini:4", "models", f"""
    SELECT model, area - last / 2 AS qini
    FROM ({area_sql('(SELECT model, score, spend AS y, treatment AS t FROM models) AS r', QINI,
                    'model')}) AS q""")
def _(spark, sf):
    return U.qini_table(models(spark, sf))


@query("U10", "qini_noise_band", "band:4", "experiment", f"""
    SELECT quantile_cont(abs(area - last / 2), 0.99) AS band
    FROM ({area_sql(f'''(SELECT rep, floor({R.sql_uniform('noise', 'customer_id', 'rep')} * 1024) AS score,
            spend AS y, treatment AS t
            FROM experiment, (SELECT unnest(range(1, 201)) AS rep) AS p) AS r''', QINI, 'rep')}) AS q
    """)
def _(spark, sf):
    return U.qini_noise_band(exp(spark, sf), "customer_id")


@query("U11", "targeting_rule", "customer_id:i treat:i", "experiment", """
    SELECT customer_id, CASE WHEN score * 0.4 > 0.8 THEN 1 ELSE 0 END AS treat FROM experiment""")
def _(spark, sf):
    return exp(spark, sf).select("customer_id", U.targeting_rule("score", 0.4, 0.8).alias("treat"))


@query("U12", "policy_value", "value:6", "experiment", """
    SELECT avg(CASE WHEN score * 0.4 > 0.8 THEN 1.0 ELSE 0 END
               * CASE WHEN treatment = 1 THEN (0.4 * spend - 0.8) / 0.5 ELSE -0.4 * spend / 0.5 END)
             AS value FROM experiment""")
def _(spark, sf):
    return U.policy_value(exp(spark, sf), U.targeting_rule("score", 0.4, 0.8), 0.4, 0.8)


@query("U13", "policy_value_true", "value:6", "experiment", """
    SELECT avg(CASE WHEN score * 0.4 > 0.8 THEN 0.4 * true_cate - 0.8 ELSE 0 END) AS value
    FROM experiment""")
def _(spark, sf):
    return U.policy_value_true(exp(spark, sf), U.targeting_rule("score", 0.4, 0.8), 0.4, 0.8)


@query("U14", "targeting_profit", "share_targeted:6 expected_profit:6 true_profit:6", "experiment",
       """
    SELECT avg(s) AS share_targeted, avg(s * (0.4 * score - 0.8)) AS expected_profit,
           avg(s * (0.4 * true_cate - 0.8)) AS true_profit
    FROM (SELECT *, CASE WHEN score * 0.4 > 0.8 THEN 1.0 ELSE 0 END AS s FROM experiment) AS e""")
def _(spark, sf):
    return U.targeting_profit(exp(spark, sf), 0.4, 0.8)


Z94 = NormalDist().inv_cdf(0.97)


@query("U14", "targeting_profit_test", "share:6 estimate:6 lo:6 hi:6", "experiment", f"""
    SELECT share, estimate, estimate - CAST({Z94} AS DOUBLE) * se AS lo,
           estimate + CAST({Z94} AS DOUBLE) * se AS hi
    FROM (SELECT share, share * (0.4 * (m1 - m0) - 0.8) AS estimate,
                 share * 0.4 * sqrt(v1 / n1 + v0 / n0) AS se
          FROM (SELECT avg(CASE WHEN s THEN 1.0 ELSE 0 END) AS share,
                       avg(spend) FILTER (WHERE s AND treatment = 1) AS m1,
                       avg(spend) FILTER (WHERE s AND treatment = 0) AS m0,
                       var_samp(spend) FILTER (WHERE s AND treatment = 1) AS v1,
                       var_samp(spend) FILTER (WHERE s AND treatment = 0) AS v0,
                       count(*) FILTER (WHERE s AND treatment = 1) AS n1,
                       count(*) FILTER (WHERE s AND treatment = 0) AS n0
                FROM (SELECT *, score * 0.4 > 0.8 AS s FROM experiment) AS e) AS m) AS p""")
def _(spark, sf):
    return U.targeting_profit_test(exp(spark, sf), F.col("score") * 0.4 > 0.8, 0.4, 0.8)


@query("U15", "cate_accuracy", "model:s rmse:6 spearman:6", "models", """
    SELECT model, sqrt(avg((score - true_cate) * (score - true_cate))) AS rmse,
           corr(r1, r2) AS spearman
    FROM (SELECT *, rank() OVER (PARTITION BY model ORDER BY score)
                      + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0 AS r1,
                 rank() OVER (PARTITION BY model ORDER BY true_cate)
                      + (count(*) OVER (PARTITION BY model, true_cate) - 1) / 2.0 AS r2
          FROM models) AS m GROUP BY 1""")
def _(spark, sf):
    return U.cate_accuracy(models(spark, sf))


def gammas(spark, sf):
    rows = exp(spark, sf).withColumns({
        "mu0": F.col("history") * 0.5, "mu1": F.col("history") * 0.5 + F.col("score"),
        "priority": F.col("coarse_score")})
    return U.aipw_scores(rows)


R.role_sql("gammas", "experiment", """
    SELECT *, mu1 - mu0 + treatment * (spend - mu1) / 0.5 - (1 - treatment) * (spend - mu0) / 0.5
             AS gamma
    FROM (SELECT *, history * 0.5 AS mu0, history * 0.5 + score AS mu1, coarse_score AS priority
          FROM experiment) AS e""")


@query("U16", "aipw_scores", "customer_id:i gamma:6", "gammas", "SELECT * FROM gammas")
def _(spark, sf):
    return gammas(spark, sf)


def _rule_sql(name: str, term: str) -> str:
    return f"""
    SELECT '{name}' AS rule, m AS mean, m - 1.96 * s AS lo, m + 1.96 * s AS hi
    FROM (SELECT 1000 * avg({term}) AS m, 1000 * stddev_samp({term}) / sqrt(count(*)) AS s
          FROM gammas) AS t"""


RULE = "(CASE WHEN score * 0.4 > 0.8 THEN 1.0 ELSE 0.0 END * (0.4 * gamma - 0.8))"
ALL = "(0.4 * gamma - 0.8)"


@query("U17", "policy_comparison", "rule:s mean:4 lo:4 hi:4", "gammas",
       " UNION ALL ".join([_rule_sql("model", RULE), _rule_sql("everyone", ALL),
                           _rule_sql("model minus everyone", f"({RULE} - {ALL})")]))
def _(spark, sf):
    return U.policy_comparison(gammas(spark, sf), {
        "model": F.col("score") * 0.4 > 0.8, "everyone": F.lit(True)}, 0.4, 0.8, "everyone")


R.role_sql("toc_rows", "gammas", """
    SELECT *, sum(g) OVER (ORDER BY rn) / rn - ate AS toc
    FROM (SELECT avg(gamma) OVER (PARTITION BY priority) AS g, avg(gamma) OVER () AS ate,
                 count(*) OVER () AS n,
                 row_number() OVER (ORDER BY priority DESC, customer_id) AS rn FROM gammas) AS r""")


@query("U18", "toc_rate", "ate:6 rate:6", "toc_rows", """
    SELECT any_value(ate) AS ate, sum(rn / n * toc) / any_value(n) AS rate FROM toc_rows""")
def _(spark, sf):
    return U.toc_rate(gammas(spark, sf))


@query("U18", "toc_curve", "q:2 toc:6", "toc_rows", """
    SELECT p / 10.0 AS q, toc FROM toc_rows, (SELECT unnest(range(1, 11)) AS p) AS s
    WHERE rn = ceil(CAST(n AS DOUBLE) * p / 10)""")
def _(spark, sf):
    return U.toc_curve(gammas(spark, sf))
