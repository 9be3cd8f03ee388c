"""Purchase-log queries on ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.operators import purchases as P
from tallyfield.plans import roles as R
from tallyfield.plans.registry import query

RULE_DAYS = (30, 60, 90, 180, 365)


@query("P1", "customer_table",
       "customer_id:i first_purchase:d last_purchase:d transactions:i total_spend:2", "tx", """
    SELECT customer_id, min(date) AS first_purchase, max(date) AS last_purchase,
           count(*) AS transactions, sum(amount) AS total_spend FROM tx GROUP BY 1""")
def _(spark, sf):
    return P.customer_table(R.transactions(spark, sf))


@query("P2", "repeat_purchases", "customer_id:i purchase_days:i repeat_days:i", "tx", """
    SELECT customer_id, count(DISTINCT date) AS purchase_days,
           count(DISTINCT date) - 1 AS repeat_days FROM tx GROUP BY 1""")
def _(spark, sf):
    return P.repeat_purchases(R.transactions(spark, sf))


@query("P3", "clean_invoices", "customer_id:i invoice:s invoice_date:d amount:2", "base_lines", """
    SELECT customer_id, invoice, CAST(min(invoice_date) AS DATE) AS invoice_date,
           sum(price * quantity) AS amount FROM base_lines
    WHERE customer_id >= 0 AND left(invoice, 1) <> 'C' AND least(quantity, price) > 0
    GROUP BY 1, 2""")
def _(spark, sf):
    return P.clean_invoices(R._lines(spark, sf))


@query("P4", "purchase_days", "customer_id:i purchase_date:d day_amount:2", "days",
       "SELECT * FROM days")
def _(spark, sf):
    return P.purchase_days(R.transactions(spark, sf))


GAPS_SQL = """
    SELECT customer_id, purchase_date, day_amount, rank() OVER c AS purchase_index,
           purchase_date - max(purchase_date) OVER (c ROWS BETWEEN UNBOUNDED PRECEDING
                                                    AND 1 PRECEDING) AS days_since_prev
    FROM days WINDOW c AS (PARTITION BY customer_id ORDER BY purchase_date)"""


@query("P5", "purchase_gaps",
       "customer_id:i purchase_date:d day_amount:2 purchase_index:i days_since_prev:0", "days",
       GAPS_SQL)
def _(spark, sf):
    return P.purchase_gaps(R.transactions(spark, sf))


@query("P6", "short_gap_share", "gaps:i share_short:6", "days", f"""
    SELECT count(*) AS gaps, avg(CASE WHEN days_since_prev < 7 THEN 1.0 ELSE 0 END) AS share_short
    FROM ({GAPS_SQL}) AS g WHERE days_since_prev IS NOT NULL""")
def _(spark, sf):
    return P.short_gap_share(P.purchase_gaps(R.transactions(spark, sf)))


@query("P6", "gap_histogram", "bin:i gaps:i", "days", f"""
    SELECT days_since_prev // 7 AS bin, count(*) AS gaps
    FROM ({GAPS_SQL}) AS g WHERE days_since_prev IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    return P.gap_histogram(P.purchase_gaps(R.transactions(spark, sf)))


RFM = "customer_id:i frequency:1 recency:6 T:6 monetary_value:6"


@query("P7", "rfm", RFM, "rfm", "SELECT * FROM rfm")
def _(spark, sf):
    return P.rfm(R.transactions(spark, sf), R.CAL_END)


ORDINALS = {
    "D": "date - DATE '1970-01-01'",
    "W": "(date - DATE '1970-01-01' + 3) // 7",
    "M": "year(date) * 12 + month(date)",
    "h": "(date - DATE '1970-01-01') * 24",
}


def _summary_sql(unit: str, scaler: float) -> str:
    return f"""
    SELECT customer_id, count(*) - 1 AS frequency, (max(o) - min(o)) / {scaler} AS recency,
           (max(e) - min(o)) / {scaler} AS "T",
           coalesce(avg(m) FILTER (WHERE o > f), 0) AS monetary_value
    FROM (SELECT *, min(o) OVER (PARTITION BY customer_id) AS f,
                 (SELECT max({ORDINALS[unit]}) FROM tx) AS e
          FROM (SELECT customer_id, {ORDINALS[unit]} AS o, sum(amount) AS m FROM tx
                GROUP BY 1, 2) AS p) AS q GROUP BY 1"""


def _summary(unit: str, scaler: float):
    def run(spark, sf):
        return P.rfm_summary(R.transactions(spark, sf), unit, scaler)
    return run


for _unit, _label, _scaler in (("D", "day", 7.0), ("W", "week", 1.0), ("M", "month", 1.0),
                               ("h", "hour", 24.0)):
    query("P8", f"rfm_by_{_label}", RFM, "tx", _summary_sql(_unit, _scaler))(
        _summary(_unit, _scaler))


@query("P9", "calibration_holdout", "customer_id:i frequency:1 recency:6 T:6 holdout_purchases:i",
       "rfmh", "SELECT * FROM rfmh")
def _(spark, sf):
    return P.calibration_holdout(R.transactions(spark, sf), R.CAL_END, R.HOLD_END)


@query("P10", "customer_rfm_with_attributes", RFM + " holdout_purchases:i acquisition_channel:s"
       " channel_social:i channel_referral:i test_weeks:1", "rfmh customers", """
    SELECT rfmh.*, acquisition_channel, 52.0 AS test_weeks,
           CASE WHEN acquisition_channel = 'social' THEN 1 ELSE 0 END AS channel_social,
           CASE WHEN acquisition_channel = 'referral' THEN 1 ELSE 0 END AS channel_referral
    FROM rfmh LEFT JOIN customers USING (customer_id)""")
def _(spark, sf):
    return P.customer_rfm_with_attributes(R.transactions(spark, sf), R.customers(spark, sf),
                                          R.CAL_END, R.HOLD_END)


@query("P11", "cohort_retention",
       "cohort_month:d months_since_first:i cohort_size:i active_share:6", "tx", """
    SELECT f.m0 AS cohort_month, 12 * (year(a.m) - year(f.m0)) + month(a.m) - month(f.m0)
             AS months_since_first, any_value(s.size) AS cohort_size,
           count(DISTINCT a.customer_id) / any_value(s.size) AS active_share
    FROM (SELECT customer_id, CAST(date_trunc('month', date) AS DATE) AS m FROM tx) AS a
    JOIN (SELECT customer_id, CAST(date_trunc('month', min(date)) AS DATE) AS m0 FROM tx GROUP BY 1)
      AS f USING (customer_id)
    JOIN (SELECT m0, count(*) AS size FROM (SELECT customer_id, CAST(date_trunc('month', min(date))
            AS DATE) AS m0 FROM tx GROUP BY 1) AS g GROUP BY 1) AS s ON s.m0 = f.m0
    GROUP BY f.m0, a.m""")
def _(spark, sf):
    return P.cohort_retention(R.transactions(spark, sf))


def _rfmh(spark, sf):
    tx = R.transactions(spark, sf)
    return P.customer_rfm_with_attributes(tx, R.customers(spark, sf), R.CAL_END, R.HOLD_END
                                          ).fillna(0, subset=["holdout_purchases"])


@query("P12", "recency_rule", "customer_id:i silent:b", "rfm", """
    SELECT customer_id, ("T" - recency) * 7 > 90 AS silent FROM rfm""")
def _(spark, sf):
    return P.rfm(R.transactions(spark, sf), R.CAL_END).select(
        "customer_id", P.recency_rule(90).alias("silent"))


@query("P13", "confusion", "tp:i fp:i fn:i tn:i", "rfmh", """
    SELECT count(*) FILTER (WHERE flag AND NOT alive) AS tp, count(*) FILTER (WHERE flag AND alive)
             AS fp, count(*) FILTER (WHERE NOT flag AND NOT alive) AS fn,
           count(*) FILTER (WHERE NOT flag AND alive) AS tn
    FROM (SELECT ("T" - recency) * 7 > 90 AS flag, holdout_purchases > 0 AS alive FROM rfmh) AS f
    """)
def _(spark, sf):
    cal = P.calibration_holdout(R.transactions(spark, sf), R.CAL_END, R.HOLD_END)
    return P.confusion(cal, P.recency_rule(90), F.col("holdout_purchases") > 0)


@query("P14", "inactivity_rule_economics", "days:i dropped:i dropped_alive:i lost_purchases:i"
       " margin_lost:2 cost_saved:2 net:2", "rfmh", f"""
    SELECT *, dropped * 1.5 * 4 - lost_purchases * 6.0 AS net, lost_purchases * 6.0 AS margin_lost,
           dropped * 1.5 * 4 AS cost_saved
    FROM (SELECT n AS days, count(*) FILTER (WHERE flag) AS dropped,
                 count(*) FILTER (WHERE flag AND holdout_purchases > 0) AS dropped_alive,
                 coalesce(sum(holdout_purchases) FILTER (WHERE flag), 0) AS lost_purchases
          FROM (SELECT n, holdout_purchases, ("T" - recency) * 7 > n AS flag
                FROM rfmh, (SELECT unnest({list(RULE_DAYS)}) AS n) AS g) AS f GROUP BY n) AS s""")
def _(spark, sf):
    cal = P.calibration_holdout(R.transactions(spark, sf), R.CAL_END, R.HOLD_END)
    return P.inactivity_rule_economics(cal, RULE_DAYS, quarters=4)


@query("P15", "purchases_between", "customer_id:i purchases:i", "holdout",
       "SELECT customer_id, holdout_purchases AS purchases FROM holdout")
def _(spark, sf):
    return P.purchases_between(R.transactions(spark, sf), R.CAL_END, R.HOLD_END)


def features_sql(cutoff: str) -> str:
    return f"""
    SELECT customer_id, count(*) - 1 AS frequency,
           (max(purchase_date) - min(purchase_date)) / 7.0 AS recency,
           (DATE '{cutoff}' - min(purchase_date)) / 7.0 AS "T", avg(day_amount) AS mean_spend,
           (DATE '{cutoff}' - max(purchase_date)) / 7.0 AS weeks_since_last,
           count(*) FILTER (WHERE DATE '{cutoff}' - purchase_date < 28) AS purchases_4w,
           count(*) FILTER (WHERE DATE '{cutoff}' - purchase_date < 91) AS purchases_13w
    FROM days WHERE purchase_date <= DATE '{cutoff}' GROUP BY 1"""


FEATURES = ("customer_id:i frequency:1 recency:6 T:6 mean_spend:6 weeks_since_last:6"
            " purchases_4w:i purchases_13w:i")


@query("P16", "make_features", FEATURES + " channel_social:i channel_referral:i",
       "days customers", f"""
    SELECT f.*, CASE WHEN acquisition_channel = 'social' THEN 1 ELSE 0 END AS channel_social,
           CASE WHEN acquisition_channel = 'referral' THEN 1 ELSE 0 END AS channel_referral
    FROM ({features_sql(R.CAL_END)}) AS f LEFT JOIN customers USING (customer_id)""")
def _(spark, sf):
    return P.make_features(R.transactions(spark, sf), R.CAL_END, R.customers(spark, sf))


def _design_sql() -> str:
    parts = []
    for split, start, end in (("train", "1999-08-02", R.CAL_END),
                              ("holdout", R.CAL_END, R.HOLD_END)):
        parts.append(f"""
    SELECT f.*, '{split}' AS split, coalesce(n, 0) AS target FROM ({features_sql(start)}) AS f
    LEFT JOIN (SELECT customer_id, count(*) AS n FROM days WHERE purchase_date > DATE '{start}'
               AND purchase_date <= DATE '{end}' GROUP BY 1) AS t USING (customer_id)""")
    return " UNION ALL ".join(parts)


@query("P17", "train_holdout_design", FEATURES + " split:s target:i", "days", _design_sql())
def _(spark, sf):
    return P.train_holdout_design(R.transactions(spark, sf), R.CAL_END, 52)


@query("P18", "frequency_group", "band:s customers:i", "rfm", """
    SELECT CASE WHEN frequency <= 0 THEN '0' WHEN frequency <= 1 THEN '1' WHEN frequency <= 3
             THEN '2-3' WHEN frequency <= 7 THEN '4-7' ELSE '8+' END AS band,
           count(*) AS customers FROM rfm GROUP BY 1""")
def _(spark, sf):
    table = P.rfm(R.transactions(spark, sf), R.CAL_END)
    return table.groupBy(P.frequency_group().alias("band")).agg(
        F.count(F.lit(1)).alias("customers"))


@query("P19", "customer_segments", "customer_id:i segment:s", "rfm customers", """
    SELECT customer_id, acquisition_channel || ' · ' || CASE WHEN frequency <= 0 THEN '0 repeat'
             WHEN frequency <= 3 THEN '1-3 repeat' ELSE '4+ repeat' END AS segment
    FROM rfm JOIN customers USING (customer_id)""")
def _(spark, sf):
    return _rfmh(spark, sf).select("customer_id", P.customer_segments().alias("segment"))


@query("P20", "rfm_quintiles",
       "recency_quintile:i frequency_quintile:i customers:i alive_share:6", "rfmh", """
    SELECT recency_quintile, frequency_quintile, count(*) AS customers,
           avg(CASE WHEN holdout_purchases > 0 THEN 1.0 ELSE 0 END) AS alive_share
    FROM (SELECT *, ntile(5) OVER (ORDER BY recency, customer_id) AS recency_quintile,
                 ntile(5) OVER (ORDER BY frequency, customer_id) AS frequency_quintile
          FROM rfmh) AS q GROUP BY 1, 2""")
def _(spark, sf):
    cal = P.calibration_holdout(R.transactions(spark, sf), R.CAL_END, R.HOLD_END)
    return P.rfm_quintiles(cal, F.col("holdout_purchases") > 0)


@query("P21", "spend_frequency_correlation", "repeat_buyers:i correlation:6", "rfm", """
    SELECT count(*) AS repeat_buyers, corr(frequency, monetary_value) AS correlation
    FROM rfm WHERE frequency > 0""")
def _(spark, sf):
    return P.spend_frequency_correlation(P.rfm(R.transactions(spark, sf), R.CAL_END))


@query("P22", "cumulative_repeat_purchases", "week:i repeat_purchases:i cumulative:i", "days", """
    SELECT week, repeat_purchases, sum(repeat_purchases) OVER (ORDER BY week) AS cumulative
    FROM (SELECT (purchase_date - DATE '1995-01-01') // 7 AS week, count(*) AS repeat_purchases
          FROM (SELECT *, min(purchase_date) OVER (PARTITION BY customer_id) AS f FROM days) AS d
          WHERE purchase_date > f GROUP BY 1) AS w""")
def _(spark, sf):
    return P.cumulative_repeat_purchases(R.transactions(spark, sf), "1995-01-01")
