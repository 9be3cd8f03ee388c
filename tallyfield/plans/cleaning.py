"""Cleaning queries on invoice lines made of ``lineitem`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.operators import cleaning as M
from tallyfield.operators import purchases as P
from tallyfield.plans import roles as R
from tallyfield.plans.registry import query
from tallyfield.session import cut_lineage

MATCH_KEYS = ("customer_id", "stock_code")


def _parts(spark, sf):
    """Lines that carry their flags, and matches. The lines are written out once, as several steps read them, without the columns
    that only tell copies apart."""
    flagged = M.flagged_lines(R.invoice_lines(spark, sf, "order_id"), dealt_by="order_id")
    lines = cut_lineage(flagged.drop("description", "country", "order_id"))
    return lines, None, M.match_cancellations(M.kept_lines(lines), MATCH_KEYS, written=True)


@query("M1", "flag_lines", "line_id:i no_customer:b non_product:b duplicate:b", "flags",
       "SELECT * FROM flags")
def _(spark, sf):
    return M.flag_lines(R.invoice_lines(spark, sf, "order_id"), dealt_by="order_id")


@query("M2", "match_cancellations", "cancel_id:i original_id:0", "matches", "SELECT * FROM matches")
def _(spark, sf):
    return _parts(spark, sf)[2]


R.role_sql("orders_at", "", """
    SELECT event_id AS order_id, user_id AS customer_id, ts AS ordered_at FROM events
    WHERE event_type = 'purchase'""")
R.role_sql("clicks_at", "", """
    SELECT event_id AS click_id, user_id AS customer_id, ts AS clicked_at, value AS campaign
    FROM events WHERE event_type = 'click'""")


@query("M3", "last_click", "order_id:i customer_id:i campaign:4 clicked_at:s",
       "orders_at clicks_at", """
    SELECT order_id, o.customer_id, max_by(campaign, (clicked_at, click_id)) AS campaign,
           strftime(max(clicked_at), '%Y-%m-%d %H:%M:%S') AS clicked_at
    FROM orders_at AS o LEFT JOIN clicks_at AS c
      ON c.customer_id = o.customer_id AND c.clicked_at <= o.ordered_at GROUP BY 1, 2""")
def _(spark, sf):
    events = R.table(spark, sf, "events")
    orders = events.filter("event_type = 'purchase'").select(
        F.col("event_id").alias("order_id"), F.col("user_id").alias("customer_id"),
        F.col("ts").alias("ordered_at"))
    clicks = events.filter("event_type = 'click'").select(
        F.col("event_id").alias("click_id"), F.col("user_id").alias("customer_id"),
        F.col("ts").alias("clicked_at"), F.col("value").alias("campaign"))
    return M.last_click(orders, clicks).withColumn(
        "clicked_at", F.date_format("clicked_at", "yyyy-MM-dd HH:mm:ss"))


R.role_sql("all_flags", "lines flags matches", """
    SELECT f.*, f.line_id IN (SELECT cancel_id FROM matches UNION ALL SELECT original_id FROM matches
             WHERE original_id IS NOT NULL) AS cancellation,
           quantity <= 0 OR price <= 0 AS nonpositive
    FROM flags AS f JOIN lines USING (line_id)""")


@query("M4", "reference_flags", "line_id:i no_customer:b non_product:b duplicate:b cancellation:b"
       " nonpositive:b", "all_flags", "SELECT * FROM all_flags")
def _(spark, sf):
    return M.reference_flags(*_parts(spark, sf))


R.role_sql("sales", "lines all_flags", """
    SELECT line_id, customer_id, invoice, invoice_date, quantity * price AS amount, non_product,
           duplicate, cancellation FROM lines JOIN all_flags USING (line_id)
    WHERE NOT no_customer AND NOT starts_with(invoice, 'C') AND NOT nonpositive""")
R.role_sql("clean_days", "sales", """
    SELECT customer_id, CAST(invoice_date AS DATE) AS date, sum(amount) AS amount FROM sales
    WHERE NOT non_product AND NOT duplicate AND NOT cancellation GROUP BY 1, 2""")


@query("M5", "purchases_by_day", "customer_id:i date:d amount:2", "clean_days",
       "SELECT * FROM clean_days")
def _(spark, sf):
    return M.purchases(*_parts(spark, sf))


@query("M5", "purchases_by_invoice_keep_cancelled", "customer_id:i date:d amount:2", "sales", """
    SELECT customer_id, min(invoice_date) AS date, sum(amount) AS amount FROM sales
    WHERE NOT non_product AND NOT duplicate GROUP BY customer_id, invoice""")
def _(spark, sf):
    return M.purchases(*_parts(spark, sf), keep_rules=("cancellation",), unit="invoice")


@query("M6", "rfm_by_invoice", "customer_id:i frequency:1 recency:6 T:6 monetary_value:7", "sales",
       f"""
    SELECT customer_id, count(*) - 1 AS frequency, (max(CAST(d AS DATE)) - min(CAST(d AS DATE))) / 7.0
             AS recency, (DATE '{R.CAL_END}' - min(CAST(d AS DATE))) / 7.0 AS "T",
           coalesce(avg(amount) FILTER (WHERE rn > 1), 0) AS monetary_value
    FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY d, invoice) AS rn
          FROM (SELECT customer_id, invoice, min(invoice_date) AS d, sum(amount) AS amount FROM sales
                WHERE NOT non_product AND NOT duplicate AND NOT cancellation
                GROUP BY customer_id, invoice) AS i
          WHERE CAST(d AS DATE) <= DATE '{R.CAL_END}') AS r GROUP BY 1""")
def _(spark, sf):
    return M.rfm_by_invoice(M.purchases(*_parts(spark, sf), unit="invoice"), R.CAL_END)


def _rfm_sql(days: str) -> str:
    return f"""
    SELECT customer_id, count(*) - 1 AS frequency,
           coalesce(avg(amount) FILTER (WHERE date > f), 0) AS monetary_value
    FROM (SELECT *, min(date) OVER (PARTITION BY customer_id) AS f FROM ({days}) AS d0
          WHERE date <= DATE '{R.CAL_END}') AS d GROUP BY 1"""


DIRTY_DAYS = """SELECT customer_id, CAST(invoice_date AS DATE) AS date, sum(amount) AS amount
    FROM sales WHERE NOT non_product AND NOT duplicate GROUP BY 1, 2"""


@query("M7", "clean_log_diff", "customer_id:i difference:s frequency_gap:1", "sales clean_days", f"""
    SELECT * FROM (
      SELECT customer_id, g.frequency - w.frequency AS frequency_gap,
             CASE WHEN g.frequency IS NULL THEN 'missing' WHEN w.frequency IS NULL THEN 'extra'
                  WHEN abs(g.frequency - w.frequency) > 1e-9 + 1e-9 * w.frequency THEN 'frequency'
                  WHEN abs(g.monetary_value - w.monetary_value)
                       > 1e-9 + 1e-9 * abs(w.monetary_value) THEN 'monetary_value' END AS difference
      FROM ({_rfm_sql(DIRTY_DAYS)}) AS g
      FULL JOIN ({_rfm_sql('SELECT * FROM clean_days')}) AS w USING (customer_id)) AS x
    WHERE difference IS NOT NULL""")
def _(spark, sf):
    parts = _parts(spark, sf)
    dirty = M.purchases(*parts, keep_rules=("cancellation",))
    return M.clean_log_diff(P.rfm(dirty, R.CAL_END), P.rfm(M.purchases(*parts), R.CAL_END))


@query("M8", "straddling_cancellations", "pairs:i straddling:i", "matches lines", f"""
    SELECT count(*) AS pairs, count(*) FILTER (WHERE CAST(o.invoice_date AS DATE) <= DATE
             '{R.CAL_END}' AND CAST(c.invoice_date AS DATE) > DATE '{R.CAL_END}') AS straddling
    FROM matches JOIN lines AS o ON o.line_id = original_id
    JOIN lines AS c ON c.line_id = cancel_id""")
def _(spark, sf):
    lines, _, matches = _parts(spark, sf)
    return M.straddling_cancellations(matches, lines, R.CAL_END)


@query("M9", "rule_shares", "rule:s lines:i share:6", "lines flags", """
    SELECT unnest(['no_customer', 'non_product', 'duplicate', 'newly flagged']) AS rule,
           unnest([a, b, c, d]) AS lines, unnest([a / n, b / n, c / n, d / k]) AS share
    FROM (SELECT count(*) AS n, count(*) FILTER (WHERE no_customer) AS a,
                 count(*) FILTER (WHERE non_product) AS b, count(*) FILTER (WHERE duplicate) AS c,
                 count(*) FILTER (WHERE old) AS k,
                 count(*) FILTER (WHERE old AND (non_product OR duplicate)) AS d
          FROM (SELECT flags.*, lines.customer_id IS NOT NULL AND NOT starts_with(invoice, 'C')
                         AND quantity > 0 AND price > 0 AS old
                FROM flags JOIN lines USING (line_id)) AS f) AS s""")
def _(spark, sf):
    lines, flags, _ = _parts(spark, sf)
    return M.rule_shares(flags, lines)


@query("M10", "standalone_fee_customers", "customer_id:i fee_days:i", "lines", """
    SELECT customer_id, count(*) AS fee_days FROM (
      SELECT customer_id, CAST(invoice_date AS DATE) AS day FROM lines
      WHERE customer_id IS NOT NULL GROUP BY 1, 2
      HAVING count(DISTINCT invoice) = 1 AND max(CASE WHEN stock_code = 'POST' THEN 1 ELSE 0 END) = 1
    ) AS d GROUP BY 1""")
def _(spark, sf):
    return M.standalone_fee_customers(R.invoice_lines(spark, sf))


VARIANT_RULES = {"reference": (), "keep_duplicate": ("duplicate",),
                 "keep_cancellation": ("cancellation",), "keep_non_product": ("non_product",)}


def variant_scores(spark, sf):
    """Spend per customer under each cleaning variant, long: one pass over the flagged lines."""
    lines, flags, matches = _parts(spark, sf)
    sold = lines.filter(~M.is_cancellation() & (F.col("quantity") > 0) & (F.col("price") > 0)
                        & F.col("customer_id").isNotNull())
    rows = M.with_reference_flags(sold, flags, matches)
    # decimals: a sum of floating-point numbers depends on the order of its rows, and customers of equal spend would be told apart by that
    money = (F.col("quantity") * F.col("price")).cast("decimal(28,10)")
    sums = []
    for name, kept in VARIANT_RULES.items():
        drop = F.lit(False)
        for rule in ("non_product", "duplicate", "cancellation"):
            if rule not in kept:
                drop = drop | F.col(rule)
        sums.append(F.sum(F.when(~drop, money)).cast("double").alias(name))
    wide = rows.groupBy("customer_id").agg(*sums)
    return cut_lineage(wide.unpivot("customer_id", list(VARIANT_RULES), "variant", "score")
                       .filter("score is not null"))


def _variant_sql() -> str:
    parts = []
    for name, rules in VARIANT_RULES.items():
        where = [f"NOT {r}" for r in ("non_product", "duplicate", "cancellation")
                 if r not in rules]
        parts.append(f"SELECT '{name}' AS variant, customer_id, sum(amount) AS score FROM sales"
                     f" WHERE {' AND '.join(where)} GROUP BY customer_id")
    return " UNION ALL ".join(parts)


R.role_sql("variants", "sales", _variant_sql())
R.role_sql("versus", "variants", """
    SELECT v.variant, v.customer_id, v.score, r.score AS ref FROM variants AS v
    JOIN variants AS r ON r.customer_id = v.customer_id AND r.variant = 'reference'""")


@query("M11", "variant_effects", "variant:s total_change_pct:6 customers_moved:i", "variants", """
    WITH ref AS (SELECT customer_id, score FROM variants WHERE variant = 'reference')
    SELECT k.variant, 100 * (k.total / (SELECT sum(score) FROM ref) - 1) AS total_change_pct,
           (SELECT count(*) FROM ref LEFT JOIN variants AS v
              ON v.customer_id = ref.customer_id AND v.variant = k.variant
            WHERE v.score IS NULL OR abs(v.score / ref.score - 1) > 0.1) AS customers_moved
    FROM (SELECT variant, sum(score) AS total FROM variants GROUP BY 1) AS k""")
def _(spark, sf):
    return M.variant_effects(variant_scores(spark, sf))


@query("M12", "largest_changes", "variant:s largest_pct_customer:i largest_change_pct:4"
       " largest_abs_customer:i largest_change_abs:2", "versus", """
    SELECT variant, max_by(customer_id, (abs(score / ref - 1), -customer_id))
             AS largest_pct_customer, 100 * max(abs(score / ref - 1)) AS largest_change_pct,
           max_by(customer_id, (abs(score - ref), -customer_id)) AS largest_abs_customer,
           max(abs(score - ref)) AS largest_change_abs
    FROM versus WHERE variant <> 'reference' GROUP BY 1""")
def _(spark, sf):
    return M.largest_changes(variant_scores(spark, sf))


@query("M13", "largest_purchase_days", "customer_id:i date:d amount:2 wholesale:b median_amount:4",
       "tx days customers", """
    SELECT customer_id, purchase_date AS date, day_amount AS amount, segment = 'MACHINERY'
             AS wholesale, (SELECT quantile_cont(day_amount, 0.5) FROM days) AS median_amount
    FROM days JOIN customers USING (customer_id)
    ORDER BY day_amount DESC, customer_id, date LIMIT 10""")
def _(spark, sf):
    days = P.purchase_days(R.transactions(spark, sf)).withColumnsRenamed(
        {"purchase_date": "date", "day_amount": "amount"})
    flagged = days.join(R.customers(spark, sf).select("customer_id", "segment"), "customer_id")
    return M.largest_purchase_days(flagged, 10, F.col("segment") == "MACHINERY")


@query("M14", "cap_amounts", "customer_id:i date:d amount:2 cap:4", "tx", f"""
    SELECT customer_id, date, least(amount, cap) AS amount, cap
    FROM tx, (SELECT quantile_cont(amount, 0.99) AS cap FROM tx WHERE date <= DATE '{R.CAL_END}') AS c
    """)
def _(spark, sf):
    return M.cap_amounts(R.transactions(spark, sf), 99.0, R.CAL_END)


@query("M15", "contact_list", "customer_id:i contact:b", "rfm", """
    SELECT customer_id, 0.03 * frequency * monetary_value > 50000.0 AS contact FROM rfm""")
def _(spark, sf):
    return P.rfm(R.transactions(spark, sf), R.CAL_END).select(
        "customer_id", M.contact_list("frequency", "monetary_value", 50000.0, 0.3, 0.1)
        .alias("contact"))


@query("M16", "contact_list_moves", "variant:s added:i dropped:i moved:i", "variants", """
    WITH listed AS (SELECT variant, customer_id FROM variants WHERE coalesce(score, 0) * 0.03 > 8000.0),
    base AS (SELECT customer_id FROM listed WHERE variant = 'reference')
    SELECT variant, added, dropped, added + dropped AS moved
    FROM (SELECT k.variant,
                 (SELECT count(*) FROM listed AS l WHERE l.variant = k.variant
                    AND l.customer_id NOT IN (SELECT customer_id FROM base)) AS added,
                 (SELECT count(*) FROM base WHERE customer_id NOT IN
                    (SELECT l.customer_id FROM listed AS l WHERE l.variant = k.variant)) AS dropped
          FROM (SELECT DISTINCT variant FROM variants WHERE variant <> 'reference') AS k) AS t""")
def _(spark, sf):
    return M.contact_list_moves(variant_scores(spark, sf), "reference", 0.1, 0.3, 8000.0)


@query("M17", "holdout_forecast_error", "forecast:4 actual:i error_pct:4", "rfm holdout", """
    SELECT forecast, actual, 100 * (forecast / actual - 1) AS error_pct
    FROM (SELECT sum(frequency / greatest("T", 1) * 52) AS forecast FROM rfm) AS f,
         (SELECT sum(holdout_purchases) AS actual FROM holdout) AS h""")
def _(spark, sf):
    tx = R.transactions(spark, sf)
    naive = P.rfm(tx, R.CAL_END).withColumn(
        "expected_purchases", F.col("frequency") / F.greatest("T", F.lit(1.0)) * 52)
    return M.holdout_forecast_error(naive, tx, R.CAL_END, R.HOLD_END)


@query("M18", "parameter_changes", "variant:s parameter:s shown:2", "variants", """
    SELECT v.variant, v.parameter, CASE WHEN v.variant = 'reference' THEN v.value
             ELSE 100 * (v.value / r.value - 1) END AS shown
    FROM (SELECT variant, unnest(['customers', 'mean', 'total']) AS parameter,
                 unnest([CAST(count(*) AS DOUBLE), avg(score), sum(score)]) AS value
          FROM variants GROUP BY 1) AS v
    JOIN (SELECT unnest(['customers', 'mean', 'total']) AS parameter,
                 unnest([CAST(count(*) AS DOUBLE), avg(score), sum(score)]) AS value
          FROM variants WHERE variant = 'reference') AS r USING (parameter)""")
def _(spark, sf):
    s = variant_scores(spark, sf).groupBy("variant").agg(
        F.count(F.lit(1)).cast("double").alias("customers"), F.avg("score").alias("mean"),
        F.sum("score").alias("total"))
    return M.parameter_changes(s.unpivot("variant", ["customers", "mean", "total"], "parameter",
                                         "value"))
