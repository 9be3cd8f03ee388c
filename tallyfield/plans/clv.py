"""Lifetime-value queries.

Purchase models run on the dropout log (see roles); value arithmetic on draws made of embeddings.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions.uniform import uniform
from tallyfield.operators import clv as C
from tallyfield.operators import draws as I
from tallyfield.operators import purchases as P
from tallyfield.operators.fitting import parameter_table
from tallyfield.plans import roles as R
from tallyfield.plans.draws import hdi_sql, mean_hdi_sql, poisson_sql
from tallyfield.plans.registry import query

BG = {"r": 0.8, "alpha": 30.0, "a": 0.9, "b": 2.5}
GG = {"p": 6.0, "q": 4.0, "v": 15.0}
R.role_sql("bgparams", "", "SELECT " + ", ".join(
    f"CAST({v} AS DOUBLE) AS {k}" for k, v in BG.items()))


def dropout_rfm(spark, sf):
    return P.rfm(R.dropout_log(spark, sf), R.CAL_END)


R.role_sql("dbg", "drfm bgparams", """
    SELECT drfm.*, frequency AS x, recency AS tx, "T" AS t, bgparams.* FROM drfm, bgparams""")


@query("C1", "bgnbd_loglik", "customer_id:i loglik:6", "dbg", """
    SELECT customer_id, lgamma(r + x) - lgamma(r) + lgamma(a + b) + lgamma(b + x) - lgamma(b)
             - lgamma(a + b + x) + r * ln(alpha) - (r + x) * ln(alpha + tx)
             + ln(pow((alpha + tx) / (alpha + t), r + x)
                  + CASE WHEN x > 0 THEN a / (b + x - 1) ELSE 0 END) AS loglik
    FROM dbg""")
def _(spark, sf):
    return C.bgnbd_loglik(dropout_rfm(spark, sf), BG)


@query("C2", "bgnbd_fit", "parameter:s value:3")
def _(spark, sf):
    rfm = dropout_rfm(spark, sf)
    return parameter_table(rfm, C.bgnbd_fit(rfm))


ALIVE = """1.0 / (1 + CASE WHEN x > 0 THEN a / (b + x - 1)
             * pow((alpha + t) / (alpha + tx), r + x) ELSE 0 END)"""
R.role_sql("expected", "dbg", f"""
    SELECT customer_id, any_value(p_alive) * any_value((a + b + x - 1) / (a - 1)) * (1
             - any_value(pow((alpha + t) / (alpha + t + 52), r + x))
             * sum(exp(lgamma(r + x + k) - lgamma(r + x) + lgamma(b + x + k) - lgamma(b + x)
                       - lgamma(a + b + x - 1 + k) + lgamma(a + b + x - 1) - lgamma(k + 1)
                       + k * ln(52 / (alpha + t + 52))))) AS expected_purchases
    FROM (SELECT *, {ALIVE} AS p_alive, unnest(range(0, 400)) AS k FROM dbg) AS s GROUP BY 1""")


@query("C3", "bgnbd_expected_purchases", "customer_id:i expected_purchases:6", "expected",
       "SELECT * FROM expected")
def _(spark, sf):
    return C.bgnbd_expected_purchases(dropout_rfm(spark, sf), BG, 52.0)


@query("C4", "bgnbd_p_alive", "customer_id:i p_alive:6", "dbg",
       f"SELECT customer_id, {ALIVE} AS p_alive FROM dbg")
def _(spark, sf):
    return C.bgnbd_p_alive(dropout_rfm(spark, sf), BG)


@query("C5", "bgnbd_expected_new", "t:6 expected_purchases:6", "dbg", """
    SELECT t, (max(a) + max(b) - 1) / (max(a) - 1) * (1 - pow(max(alpha) / (max(alpha) + t), max(r))
             * sum(exp(lgamma(r + k) - lgamma(r) + lgamma(b + k) - lgamma(b)
                       - lgamma(a + b - 1 + k) + lgamma(a + b - 1) - lgamma(k + 1)
                       + k * ln(t / (alpha + t))))) AS expected_purchases
    FROM (SELECT t, r, alpha, a, b, unnest(range(0, 600)) AS k
          FROM (SELECT DISTINCT t, r, alpha, a, b FROM dbg WHERE t > 0) AS d) AS s GROUP BY t""")
def _(spark, sf):
    ages = dropout_rfm(spark, sf).filter("T > 0").select(F.col("T").alias("t")).distinct()
    return C.bgnbd_expected_new(ages, BG)


REPEAT = "frequency > 0 AND monetary_value > 0"


@query("C6", "gamma_gamma_loglik", "customer_id:i loglik:6", "drfm", f"""
    SELECT customer_id, lgamma(6.0 * x + 4.0) - lgamma(6.0 * x) - lgamma(4.0) + 4.0 * ln(15.0)
             + (6.0 * x - 1) * ln(z) + 6.0 * x * ln(x) - (6.0 * x + 4.0) * ln(x * z + 15.0) AS loglik
    FROM (SELECT customer_id, frequency AS x, monetary_value AS z FROM drfm WHERE {REPEAT}) AS r""")
def _(spark, sf):
    return C.gamma_gamma_loglik(dropout_rfm(spark, sf).filter(REPEAT), GG)


@query("C7", "gamma_gamma_fit", "parameter:s value:3")
def _(spark, sf):
    rfm = dropout_rfm(spark, sf).filter(REPEAT)
    return parameter_table(rfm, C.gamma_gamma_fit(rfm))


SPEND = """(1 - w) * (6.0 * 15.0 / 3.0) + w * monetary_value"""
R.role_sql("spend", "drfm", f"""
    SELECT *, {SPEND} AS expected_spend
    FROM (SELECT *, 6.0 * frequency / (6.0 * frequency + 3.0) AS w FROM drfm) AS r""")


@query("C8", "gamma_gamma_expected_spend", "customer_id:i expected_spend:6", "spend",
       "SELECT * FROM spend")
def _(spark, sf):
    return C.gamma_gamma_expected_spend(dropout_rfm(spark, sf), GG)


@query("C9", "pnbd_expected_new", "customer_id:i general:6 logarithmic:6", "rfm", """
    SELECT customer_id, 0.55 / 10.58 * 11.67 / (0.61 - 1) * (1 - pow(11.67 / (11.67 + "T"), 0.61 - 1))
             AS general, 0.55 / 10.58 * 11.67 * ln(1 + "T" / 11.67) AS logarithmic FROM rfm""")
def _(spark, sf):
    ages = P.rfm(R.transactions(spark, sf), R.CAL_END)
    one = C.pnbd_expected_new(ages, 0.55, 10.58, 0.61, 11.67, "T").withColumnRenamed(
        "expected_purchases", "general")
    return C.pnbd_expected_new(one, 0.55, 10.58, 1.0, 11.67, "T").withColumnRenamed(
        "expected_purchases", "logarithmic")


@query("C10", "closest_to_bar", "customer_id:i gain:4 list:s", "spend", """
    SELECT * FROM (SELECT customer_id, gain, 'largest' AS list FROM g WHERE gain > 100
                   ORDER BY gain DESC, customer_id LIMIT 10)
    UNION ALL SELECT * FROM (SELECT customer_id, gain, 'closest' FROM g WHERE gain > 100
                             ORDER BY gain, customer_id LIMIT 10)""".replace(
    "FROM g", "FROM (SELECT customer_id, frequency * expected_spend AS gain FROM spend) AS g"))
def _(spark, sf):
    scored = C.gamma_gamma_expected_spend(dropout_rfm(spark, sf), GG).withColumn(
        "gain", F.col("frequency") * F.col("expected_spend"))
    return C.closest_to_bar(scored, "gain", 100.0, 10)


@query("C11", "revenue_scores", "customer_id:i score:6", "expected spend", """
    SELECT customer_id, expected_purchases * expected_spend AS score
    FROM expected JOIN spend USING (customer_id)""")
def _(spark, sf):
    return C.revenue_scores(dropout_rfm(spark, sf), BG, GG, 52.0)


# ---- draws: vector = draw, label = channel, position = month ------------------------------------
R.role_sql("forecast", "", """
    SELECT draw, 'channel ' || (label % 3) AS channel, month, 20 + label AS spend,
           sum(step) OVER (PARTITION BY draw ORDER BY month) AS cumulative
    FROM (SELECT vec_id AS draw, label, unnest(range(1, len(embedding) + 1)) AS month,
                 abs(CAST(unnest(embedding) AS DOUBLE)) AS step FROM embeddings) AS e""")
R.role_sql("by_month", "forecast", """
    SELECT *, cumulative - coalesce(lag(cumulative) OVER (PARTITION BY draw ORDER BY month), 0)
             AS in_month FROM forecast""")


def forecast(spark, sf):
    """Cumulative forecast per draw and month; each draw belongs to one channel."""
    from pyspark.sql import Window as W

    rows = R.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("draw"), F.concat(F.lit("channel "), F.col("label") % 3)
        .alias("channel"), (F.col("label") + 20).cast("double").alias("spend"),
        F.posexplode("embedding").alias("p", "v"))
    run = W.partitionBy("draw").orderBy("p").rowsBetween(W.unboundedPreceding, 0)
    return rows.select("draw", "channel", "spend", (F.col("p") + 1).alias("month"),
                       F.sum(F.abs(F.col("v").cast("double"))).over(run).alias("cumulative"))


def by_month(spark, sf):
    return C.purchases_in_month(forecast(spark, sf), ["draw"])


@query("C12", "purchases_in_month", "draw:i month:i in_month:6", "by_month",
       "SELECT * FROM by_month")
def _(spark, sf):
    return by_month(spark, sf)


@query("C13", "discounted_clv", "draw:i channel:s clv:6", "by_month", """
    SELECT draw, channel, sum(in_month * spend / pow(1.008, month)) AS clv FROM by_month
    GROUP BY 1, 2""")
def _(spark, sf):
    return C.discounted_clv(by_month(spark, sf), ["draw", "channel"], 0.008)


R.role_sql("grid_totals", "by_month", """
    SELECT draw, horizon_months, monthly_rate,
           sum(in_month * spend / pow(CAST(1 AS DOUBLE) + monthly_rate, month)) AS value
    FROM by_month, (SELECT unnest([12, 24, 36]) AS horizon_months) AS h,
         (SELECT CAST(unnest([0.0, 0.008, 0.02]) AS DOUBLE) AS monthly_rate) AS d
    WHERE month <= horizon_months GROUP BY 1, 2, 3""")


@query("C14", "clv_grid", "horizon_months:i monthly_rate:4 mean:5 hdi_low:5 hdi_high:5",
       "grid_totals", mean_hdi_sql("grid_totals", "horizon_months, monthly_rate"))
def _(spark, sf):
    return C.clv_grid(by_month(spark, sf), (12, 24, 36), (0.0, 0.008, 0.02))


R.role_sql("values", "by_month", """
    SELECT draw, channel, 0.3 * max(spend) * (1 + sum(in_month / pow(1.01, month))) AS value
    FROM by_month GROUP BY 1, 2""")


def values(spark, sf):
    return C.new_customer_value(forecast(spark, sf), ["draw", "channel"], 0.01, 0.3)


@query("C15", "new_customer_value", "draw:i channel:s value:6", "values", "SELECT * FROM values")
def _(spark, sf):
    return values(spark, sf)


@query("C16", "cac_cap", "channel:s cac_cap:5", "values", """
    SELECT channel, quantile_cont(value, 0.2) AS cac_cap FROM values GROUP BY 1""")
def _(spark, sf):
    return C.cac_cap(values(spark, sf))


@query("C16", "p_value_above_cac", "channel:s p_above_cac:6", "values", """
    SELECT channel, avg(CASE WHEN value > CASE channel WHEN 'channel 0' THEN 40.0 WHEN 'channel 1'
             THEN 45.0 ELSE 50.0 END THEN 1.0 ELSE 0 END) AS p_above_cac FROM values GROUP BY 1""")
def _(spark, sf):
    return C.p_value_above_cac(values(spark, sf), {"channel 0": 40.0, "channel 1": 45.0,
                                                   "channel 2": 50.0})


R.role_sql("customer_draws", "draws", """
    SELECT draw, key AS customer_id, 'segment ' || (key // 16) AS segment, value FROM draws""")
R.role_sql("segment_draws", "customer_draws", """
    SELECT segment, draw, count(*) AS customers, sum(value) AS total, avg(value) AS average
    FROM customer_draws GROUP BY 1, 2""")


def customer_draws(spark, sf):
    return R.draws(spark, sf).withColumnRenamed("key", "customer_id").withColumn(
        "segment", F.concat(F.lit("segment "), F.floor(F.col("customer_id") / 16)))


@query("C17", "segment_value", "segment:s customers:i total_mean:6 per_customer_mean:6 total_low:6"
       " total_high:6 per_customer_low:6 per_customer_high:6", "segment_draws", f"""
    SELECT s.*, t.hdi_low AS total_low, t.hdi_high AS total_high, p.hdi_low AS per_customer_low,
           p.hdi_high AS per_customer_high
    FROM (SELECT segment, max(customers) AS customers, avg(total) AS total_mean,
                 avg(average) AS per_customer_mean FROM segment_draws GROUP BY 1) AS s
    JOIN ({hdi_sql('segment_draws', 'segment', 'total')}) AS t USING (segment)
    JOIN ({hdi_sql('segment_draws', 'segment', 'average')}) AS p USING (segment)""")
def _(spark, sf):
    return C.segment_value(customer_draws(spark, sf))


@query("C18", "prob_greater", "p_greater:6", "segment_draws", """
    SELECT avg(CASE WHEN a > b THEN 1.0 ELSE 0 END) AS p_greater
    FROM (SELECT draw, max(average) FILTER (WHERE segment = 'segment 0') AS a,
                 max(average) FILTER (WHERE segment = 'segment 1') AS b
          FROM segment_draws GROUP BY 1) AS d""")
def _(spark, sf):
    return C.prob_greater(customer_draws(spark, sf), "segment 0", "segment 1")


@query("C19", "campaign_table", "segment:s customers:i median_lift:6 below_5pct:i below_10pct:i"
       " below_20pct:i", "rfm customers", """
    SELECT segment, count(*) AS customers, quantile_cont(lift, 0.5) AS median_lift,
           count(*) FILTER (WHERE lift < 0.05) AS below_5pct,
           count(*) FILTER (WHERE lift < 0.1) AS below_10pct,
           count(*) FILTER (WHERE lift < 0.2) AS below_20pct
    FROM (SELECT segment, 2.0 / (6.0 * (frequency + 0.5)) AS lift
          FROM rfm JOIN customers USING (customer_id)) AS l GROUP BY 1""")
def _(spark, sf):
    r = P.rfm(R.transactions(spark, sf), R.CAL_END).join(
        R.customers(spark, sf).select("customer_id", "segment"), "customer_id")
    lifts = r.withColumn("margin", F.lit(6.0)).withColumn("n", F.col("frequency") + 0.5)
    return C.campaign_table(lifts.withColumn("lift", C.breakeven_lift(2.0, "margin", "n")))


@query("C20", "retarget_table", "response_rate:4 threshold:6 stopped:i share:6 cost_saved:2"
       " margin_given_up:4", "dbg", f"""
    SELECT u AS response_rate, 0.5 / (20 * u) AS threshold, count(*) FILTER (WHERE stop) AS stopped,
           avg(CASE WHEN stop THEN 1.0 ELSE 0 END) AS share,
           count(*) FILTER (WHERE stop) * 0.5 AS cost_saved,
           coalesce(sum(p_alive * 20 * u) FILTER (WHERE stop), 0) AS margin_given_up
    FROM (SELECT u, p_alive, p_alive < 0.5 / (20 * u) AS stop
          FROM (SELECT {ALIVE} AS p_alive FROM dbg) AS p,
               (SELECT CAST(unnest([0.02, 0.05, 0.1]) AS DOUBLE) AS u) AS g) AS s GROUP BY u""")
def _(spark, sf):
    return C.retarget_table(C.bgnbd_p_alive(dropout_rfm(spark, sf), BG), (0.02, 0.05, 0.1))


R.role_sql("naive", "rfmh", """
    SELECT *, frequency / greatest("T", 1) * 52 AS predicted, CASE WHEN frequency >= 7 THEN '7+' ELSE
             CAST(CAST(frequency AS INT) AS VARCHAR) END AS grp FROM rfmh""")


def naive(spark, sf):
    cal = P.calibration_holdout(R.transactions(spark, sf), R.CAL_END, R.HOLD_END)
    return cal.withColumn("expected_purchases",
                          F.col("frequency") / F.greatest("T", F.lit(1.0)) * 52)


@query("C21", "holdout_comparison", "group:s customers:i actual:6 predicted:6", "naive", """
    SELECT grp AS "group", count(*) AS customers, avg(holdout_purchases) AS actual,
           avg(predicted) AS predicted FROM naive GROUP BY 1""")
def _(spark, sf):
    return C.holdout_comparison(naive(spark, sf))


@query("C22", "holdout_scorecard", "method:s group:s customers:i mae:6 rmse:6 bias:4", "naive", """
    SELECT method, band AS "group", count(*) AS customers, avg(abs(e)) AS mae,
           sqrt(avg(e * e)) AS rmse, sum(e) AS bias
    FROM (SELECT 'rate' AS method, grp AS band, predicted - holdout_purchases AS e FROM naive
          UNION ALL SELECT 'constant', grp, 1.5 - holdout_purchases FROM naive) AS m GROUP BY 1, 2""")
def _(spark, sf):
    f = F.col("frequency").cast("int")
    wide = naive(spark, sf).select(
        F.when(f >= 7, "7+").otherwise(f.cast("string")).alias("group"),
        F.col("holdout_purchases").cast("double").alias("actual"),
        F.col("expected_purchases").alias("rate"), F.lit(1.5).alias("constant"))
    return C.holdout_scorecard(wide.unpivot(["group", "actual"], ["rate", "constant"], "method",
                                            "predicted"))


@query("C23", "mae_difference_bootstrap", "b:i value:6", "naive", f"""
    SELECT b, sum(w * (abs(predicted - holdout_purchases) - abs(1.5 - holdout_purchases))) / sum(w)
             AS value
    FROM (SELECT *, {poisson_sql(R.sql_uniform('mae', 'customer_id', 'b'))} AS w
          FROM (SELECT *, unnest(range(1, 201)) AS b FROM naive) AS x) AS y GROUP BY 1""")
def _(spark, sf):
    held = F.col("holdout_purchases")
    errors = naive(spark, sf).select("customer_id", (F.col("expected_purchases") - held).alias("ea"),
                                     (F.lit(1.5) - held).alias("eb"))
    return C.mae_difference_bootstrap(errors, "ea", "eb", resamples=200)


@query("C24", "gbt_forecast", "customer_id:i target:i predicted:4")
def _(spark, sf):
    design = P.train_holdout_design(R.transactions(spark, sf), R.CAL_END, 52)
    return C.gbt_forecast(design, ["frequency", "recency", "T", "mean_spend", "weeks_since_last",
                                   "purchases_4w", "purchases_13w"])


# ---- survivors: customers that have not left by their t-th purchase day -----------------------------
# A customer leaves at the first day with a price above its balance-dependent level (see roles).

def survivors(spark, sf):
    from pyspark.sql import Window as W

    cust = R.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    leaves = F.col("o_totalprice") / 500000 > F.col("c_acctbal") / 10000
    days = (R.table(spark, sf, "orders").join(cust, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("d"))
            .agg(F.max(leaves.cast("int")).alias("leaves"),
                 F.first("c_mktsegment").alias("cohort")))
    end = F.min(F.when(F.col("leaves") == 1, F.col("d"))).over(W.partitionBy("o_custkey"))
    per = days.withColumn("end", end).groupBy("o_custkey").agg(
        F.count_if(F.col("end").isNull() | (F.col("d") < F.col("end"))).alias("y"),
        F.first("cohort").alias("cohort"))
    reached = per.select("cohort", F.explode(F.sequence(
        F.lit(0), F.col("y").cast("int"))).alias("year"))
    return reached.groupBy("cohort", "year").agg(F.count(F.lit(1)).alias("alive"))


R.role_sql("survivors", "", f"""
    SELECT cohort, year, count(*) AS alive FROM (
      SELECT cohort, unnest(range(0, y + 1)) AS year
      FROM (SELECT o_custkey, any_value(cohort) AS cohort,
                   count(*) FILTER (WHERE last_day IS NULL OR d < last_day) AS y
            FROM (SELECT *, min(CASE WHEN leaves = 1 THEN d END) OVER (PARTITION BY o_custkey)
                              AS last_day
                  FROM (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d,
                               any_value(c_mktsegment) AS cohort,
                               max(CASE WHEN o_totalprice / 500000 > c_acctbal / 10000 THEN 1
                                   ELSE 0 END) AS leaves
                        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) AS x) AS w
            GROUP BY 1) AS p) AS r GROUP BY 1, 2""")
R.role_sql("leavers", "survivors", """
    SELECT cohort, year + 1 AS recency, max(year) OVER (PARTITION BY cohort) + 1 AS "T",
           alive - coalesce(lead(alive) OVER (PARTITION BY cohort ORDER BY year), 0) AS n
    FROM survivors""")


@query("C25", "counts_to_customers", "cohort:s recency:i T:i", "leavers", """
    SELECT cohort, recency, "T" FROM (SELECT *, unnest(range(n)) AS i FROM leavers) AS e""")
def _(spark, sf):
    return C.counts_to_customers(survivors(spark, sf))


@query("C26", "sbg_survival", "t:i customers:i survival:8 retention:8", "rfm", """
    SELECT t, customers, exp(lgamma(0.8 + 1.2) - lgamma(1.2) + lgamma(1.2 + t) - lgamma(2.0 + t))
             AS survival, CASE WHEN t > 0 THEN (1.2 + t - 1) / (2.0 + t - 1) END AS retention
    FROM (SELECT CAST(floor("T" / 13) AS BIGINT) AS t, count(*) AS customers FROM rfm GROUP BY 1) AS g
    """)
def _(spark, sf):
    ages = P.rfm(R.transactions(spark, sf), R.CAL_END).groupBy(
        F.floor(F.col("T") / 13).alias("t")).agg(F.count(F.lit(1)).alias("customers"))
    return C.sbg_survival(ages, 0.8, 1.2)


@query("C27", "sbg_fit", "parameter:s value:3")
def _(spark, sf):
    rows = C.counts_to_customers(survivors(spark, sf))
    return parameter_table(rows, C.sbg_fit(rows))


@query("C28", "clv_by_channel", "channel:s clv:2 customers:i", "spend customers", """
    SELECT CASE WHEN grouping(acquisition_channel) = 1 THEN 'all' ELSE acquisition_channel END
             AS channel, sum(frequency * expected_spend) AS clv, count(*) AS customers
    FROM spend JOIN customers USING (customer_id) GROUP BY ROLLUP (acquisition_channel)""")
def _(spark, sf):
    scored = C.gamma_gamma_expected_spend(dropout_rfm(spark, sf), GG).join(
        R.customers(spark, sf), "customer_id").withColumn(
        "clv", F.col("frequency") * F.col("expected_spend"))
    return C.clv_by_channel(scored.withColumnRenamed("acquisition_channel", "channel"))


@query("C29", "true_expected_revenue", "customer_id:i expected_revenue:6", "rfm", """
    SELECT customer_id, monetary_value / 1000 * frequency / greatest("T", 1) * CASE WHEN mu > 0 THEN
             (1 - exp(-mu * 52)) / mu ELSE 52.0 END AS expected_revenue
    FROM (SELECT *, CASE WHEN frequency > 0 THEN 1 / greatest(recency, 1) ELSE 0 END AS mu
          FROM rfm) AS r""")
def _(spark, sf):
    r = P.rfm(R.transactions(spark, sf), R.CAL_END).withColumns({
        "lam": F.col("frequency") / F.greatest("T", F.lit(1.0)),
        "mu": F.when(F.col("frequency") > 0, 1 / F.greatest("recency", F.lit(1.0))).otherwise(0.0),
        "alive": F.lit(1), "mean_spend": F.col("monetary_value") / 1000})
    return C.true_expected_revenue(r, 52.0)
