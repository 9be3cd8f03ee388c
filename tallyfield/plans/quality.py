"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.operators import purchases as P
from tallyfield.operators import quality as Q
from tallyfield.plans import roles as R
from tallyfield.plans.extracts import scores
from tallyfield.plans.registry import query


@query("Q1", "expect_columns", "column:s present:b nulls:0", "lines", """
    SELECT unnest(['customer_id', 'invoice', 'price', 'discount']) AS "column",
           unnest([true, true, true, false]) AS present, unnest([a, b, c, NULL]) AS nulls
    FROM (SELECT count(*) - count(customer_id) AS a, count(*) - count(invoice) AS b,
                 count(*) - count(price) AS c FROM lines) AS n""")
def _(spark, sf):
    return Q.column_report(R.invoice_lines(spark, sf),
                           ["customer_id", "invoice", "price", "discount"])


COUNTS = ("not_finite", "frequency_not_whole", "frequency_negative", "recency_negative",
          "recency_over_age", "recency_without_repeat", "frequency_over_recency")


@query("Q2", "rfm_violations", "rows:i repeated_customers:i " + " ".join(f"{c}:i" for c in COUNTS),
       "rfm", """
    SELECT count(*) AS rows, 0 AS repeated_customers, 0 AS not_finite,
           count(*) FILTER (WHERE frequency >= 0 AND abs(frequency - round(frequency)) > 1e-8)
             AS frequency_not_whole,
           count(*) FILTER (WHERE frequency < 0) AS frequency_negative,
           count(*) FILTER (WHERE recency < 0) AS recency_negative,
           count(*) FILTER (WHERE recency > "T" + 1e-9) AS recency_over_age,
           count(*) FILTER (WHERE frequency = 0 AND recency > 1e-9) AS recency_without_repeat,
           count(*) FILTER (WHERE frequency > recency + 1e-9) AS frequency_over_recency
    FROM (SELECT recency AS frequency, frequency AS recency, "T" FROM rfm) AS swapped""")
def _(spark, sf):
    swapped = P.rfm(R.transactions(spark, sf), R.CAL_END).withColumnsRenamed(
        {"frequency": "x", "recency": "frequency"}).withColumnRenamed("x", "recency")
    return Q.rfm_violations(swapped)


@query("Q3", "probability_violations", "column:s not_finite:i outside:i", "scores", """
    SELECT unnest(['p_alive', 'clv_mean']) AS "column", unnest([0, 0]) AS not_finite,
           unnest([a, b]) AS outside
    FROM (SELECT count(*) FILTER (WHERE p_alive < 0 OR p_alive > 1) AS a,
                 count(*) FILTER (WHERE clv_mean < 0 OR clv_mean > 1) AS b FROM scores) AS s""")
def _(spark, sf):
    return Q.probability_violations(scores(spark, sf), ["p_alive", "clv_mean"])


@query("Q4", "monotone_violations", "rows:i violations:i", "days", """
    SELECT count(*) AS rows, count(*) FILTER (WHERE day_amount < p) AS violations
    FROM (SELECT *, lag(day_amount) OVER (ORDER BY purchase_date, customer_id) AS p FROM days) AS d
    """)
def _(spark, sf):
    return Q.monotone_violations(P.purchase_days(R.transactions(spark, sf)), "day_amount",
                                 ["purchase_date", "customer_id"])


@query("Q4", "monotone_violations_by_customer", "customer_id:i rows:i violations:i", "days", """
    SELECT customer_id, count(*) AS rows, count(*) FILTER (WHERE day_amount >= p) AS violations
    FROM (SELECT *, lag(day_amount) OVER (PARTITION BY customer_id ORDER BY purchase_date) AS p
          FROM days) AS d GROUP BY 1""")
def _(spark, sf):
    return Q.monotone_violations(P.purchase_days(R.transactions(spark, sf)), "day_amount",
                                 ["purchase_date"], ["customer_id"], increasing=False, strict=True)


@query("Q5", "frames_agree", "finding:s n:i", "rfm", f"""
    SELECT unnest(['rows left', 'rows right', 'repeated keys left', 'repeated keys right',
                   'only left', 'only right', 'differs frequency', 'differs recency', 'differs T',
                   'differs monetary_value']) AS finding,
           unnest([a, b, 0, 0, c, d, e, f, g, h]) AS n
    FROM (SELECT (SELECT count(*) FROM rfm) AS a, (SELECT count(*) FROM later) AS b,
             count(*) FILTER (WHERE l.customer_id IS NULL) AS c,
             count(*) FILTER (WHERE r.customer_id IS NULL) AS d,
             count(*) FILTER (WHERE abs(r.frequency - l.frequency) > 1e-6) AS e,
             count(*) FILTER (WHERE abs(r.recency - l.recency) > 1e-6) AS f,
             count(*) FILTER (WHERE abs(r."T" - l."T") > 1e-6) AS g,
             count(*) FILTER (WHERE abs(r.monetary_value - l.monetary_value) > 1e-6) AS h
          FROM rfm AS r FULL JOIN later AS l USING (customer_id)) AS s""".replace(
    "later", "(" + R.ROLE_SQL["rfm"][1].replace(R.CAL_END, R.HOLD_END) + ")").replace(
    "FULL JOIN (", "FULL JOIN ("))
def _(spark, sf):
    tx = R.transactions(spark, sf)
    return Q.frames_agree(P.rfm(tx, R.CAL_END), P.rfm(tx, R.HOLD_END), ["customer_id"])


@query("Q6", "close_violations", "rows:i violations:i largest_gap:4", "scores", """
    SELECT count(*) AS rows, count(*) FILTER (WHERE abs(clv_hdi_low - clv_mean)
             > 5 + 0.25 * abs(clv_mean)) AS violations, max(abs(clv_hdi_low - clv_mean))
             AS largest_gap FROM scores""")
def _(spark, sf):
    return Q.close_violations(scores(spark, sf), "clv_hdi_low", "clv_mean", 0.25, 5.0)


@query("Q7", "leakage_check", "trial:s finding:s n:i", "days", f"""
    SELECT trial, finding, CASE WHEN finding LIKE 'rows%' THEN
             (SELECT count(DISTINCT customer_id) FROM days WHERE purchase_date <= DATE '{R.CAL_END}')
             ELSE 0 END AS n
    FROM (SELECT unnest(['deleted', 'scrambled']) AS trial) AS t,
         (SELECT unnest(['rows left', 'rows right', 'repeated keys left', 'repeated keys right',
                         'only left', 'only right', 'differs frequency', 'differs recency',
                         'differs T', 'differs mean_spend', 'differs weeks_since_last',
                         'differs purchases_4w', 'differs purchases_13w']) AS finding) AS f""")
def _(spark, sf):
    return Q.leakage_check(lambda log: P.make_features(log, R.CAL_END), R.transactions(spark, sf),
                           R.CAL_END).withColumn("n", F.col("n"))
