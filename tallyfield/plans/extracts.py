"""Sources, sinks and score tables on files that Spark writes from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.operators import purchases as P
from tallyfield.plans import roles as R
from tallyfield.plans.registry import query
from tallyfield.session import scratch_path
from tallyfield.sources import tables as S


@query("S1", "load_table", "customer_id:i date:d amount:2", "tx", "SELECT * FROM tx")
def _(spark, sf):
    path = scratch_path(spark, "retailer_transactions")
    R.transactions(spark, sf).withColumn("date", F.col("date").cast("date")).write.option(
        "header", True).csv(path)
    return S.load_table(spark, "retailer_transactions", path)


LINES = ("invoice:s stock_code:s description:s quantity:i stamp:s price:8 customer_id:0 country:s")


@query("S2", "read_lines", LINES, "base_lines", """
    SELECT *, strftime(invoice_date, '%Y-%m-%d %H:%M') AS stamp FROM base_lines""")
def _(spark, sf):
    path = scratch_path(spark, "lines")
    lines = R._lines(spark, sf).drop("line_id")
    (lines.withColumn("invoice_date", F.date_format("invoice_date", "yyyy-MM-dd HH:mm"))
     .write.option("header", True).option("nullValue", "").option("emptyValue", "").csv(path))
    return S.read_lines(spark, path).withColumn(
        "stamp", F.date_format("invoice_date", "yyyy-MM-dd HH:mm"))


@query("S3", "load_dated_log", "id:i date:d cds_bought:i spent:2", "", """
    SELECT o_custkey AS id, CAST(o_orderdate AS DATE) AS date, length(o_orderpriority)
           AS cds_bought, o_totalprice AS spent FROM orders""")
def _(spark, sf):
    path = scratch_path(spark, "dated_log")
    R.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("id"), F.date_format("o_orderdate", "yyyyMMdd").alias("date"),
        F.length("o_orderpriority").alias("cds_bought"), F.col("o_totalprice").alias("spent")
    ).write.option("header", True).csv(path)
    return S.load_dated_log(spark, path)


@query("S4", "union_overlapping_extracts", "line_id:i invoice:s price:8", "extract_one extract_two",
       """
    SELECT line_id, invoice, price FROM extract_one
    UNION ALL SELECT line_id, invoice, price FROM extract_two
    WHERE line_id NOT IN (SELECT line_id FROM extract_one)""")
def _(spark, sf):
    one, two = R.extracts(spark, sf)
    return S.union_overlapping_extracts(one, two, ["line_id"])


@query("S5", "sample_entities", "customer_id:i date:d amount:2", "tx", f"""
    SELECT * FROM tx WHERE customer_id IN (
      SELECT customer_id FROM (SELECT DISTINCT customer_id FROM tx) AS k
      ORDER BY {R.sql_uniform('entity7', 'customer_id')}, customer_id LIMIT 100)""")
def _(spark, sf):
    return S.sample_entities(R.transactions(spark, sf), "customer_id", 100, seed=7)


@query("S5", "sample_entity_fraction", "customer_id:i date:d amount:2", "tx", f"""
    SELECT * FROM tx WHERE {R.sql_uniform('entity7', 'customer_id')} < 0.25""")
def _(spark, sf):
    return S.sample_entities(R.transactions(spark, sf), "customer_id", 0.25, seed=7)


CODES = {"c": "click", "e": "error", "s": "signup", "v": "view"}


@query("S6", "load_journeys", "user_id:i path:s touches:i converted:i", "journeys", """
    SELECT user_id, array_to_string(path, '>') AS path, len(path) AS touches, converted
    FROM journeys""")
def _(spark, sf):
    from tallyfield.operators.attribution import journeys

    path = scratch_path(spark, "journeys")
    made = journeys(R.touches(spark, sf), R.conversions(spark, sf), ["user_id", "day"])
    made.select("user_id", S.encode_path("path", CODES).alias("path"), "converted").write.option(
        "header", True).csv(path)
    back = S.load_journeys(spark, path, CODES)
    return back.select("user_id", F.array_join("path", ">").alias("path"),
                       F.size("path").alias("touches"), "converted")


def scores(spark, sf):
    """A score table built from RFM: silence as (1 - p_alive), spend as value."""
    r = P.rfm(R.transactions(spark, sf), R.CAL_END).join(R.customers(spark, sf), "customer_id")
    value = F.col("monetary_value") * F.col("frequency") / 1000
    return r.select(
        F.col("customer_id").cast("string").alias("customer_id"),
        (1 - (F.col("T") - F.col("recency")) / F.greatest("T", F.lit(1.0))).alias("p_alive"),
        value.alias("clv_mean"), (value * 0.8 - F.col("balance") / 100).alias("clv_hdi_low"),
        (value * 1.3).alias("clv_hdi_high"), F.col("acquisition_channel").alias("segment"))


R.role_sql("scores", "rfm customers", """
    SELECT CAST(customer_id AS VARCHAR) AS customer_id,
           1 - ("T" - recency) / greatest("T", 1) AS p_alive, v AS clv_mean,
           v * 0.8 - balance / 100 AS clv_hdi_low, v * 1.3 AS clv_hdi_high,
           acquisition_channel AS segment, 'v1' AS model_version, DATE '2001-01-01' AS scored_at
    FROM (SELECT *, monetary_value * frequency / 1000 AS v FROM rfm) AS r
    JOIN customers USING (customer_id)""")


@query("S7", "write_scores", "customer_id:s p_alive:6 clv_mean:7 segment:s model_version:s"
       " scored_at:d", "scores", """
    SELECT customer_id, CASE WHEN segment = 'social' THEN 0.5 ELSE p_alive END AS p_alive, clv_mean,
           segment, 'v1' AS model_version, CASE WHEN segment = 'social' THEN DATE '2001-02-01'
             ELSE DATE '2001-01-01' END AS scored_at FROM scores
    UNION ALL SELECT customer_id, p_alive, clv_mean, segment, 'v2', DATE '2001-03-01' FROM scores
    """)
def _(spark, sf):
    path = scratch_path(spark, "scores")
    table = scores(spark, sf)
    S.write_scores(table, path, "v1", "2001-01-01")
    rescored = table.filter("segment = 'social'").withColumn("p_alive", F.lit(0.5))
    S.write_scores(rescored, path, "v1", "2001-02-01")
    S.write_scores(table, path, "v2", "2001-03-01")
    return S.read_scores(spark, path)


@query("S8", "audit_scores", "incomplete:i p_outside:i mean_outside:i wrong_tags:i", "scores", """
    SELECT sum(CASE WHEN customer_id || segment IS NULL OR p_alive + clv_mean IS NULL THEN 1 ELSE 0 END)
             AS incomplete, sum(CASE WHEN p_alive BETWEEN 0 AND 1 THEN 0 ELSE 1 END) AS p_outside,
           sum(CASE WHEN clv_mean BETWEEN clv_hdi_low AND clv_hdi_high THEN 0 ELSE 1 END)
             AS mean_outside, sum(CASE segment WHEN 'social' THEN 1 ELSE 0 END) AS wrong_tags
    FROM scores""")
def _(spark, sf):
    tagged = scores(spark, sf).withColumn("model_version", F.lit("v1")).withColumn(
        "scored_at", F.when(F.col("segment") == "social", "2000-12-31").otherwise("2001-01-01")
        .cast("date"))
    return S.audit_scores(tagged, "2001-01-01", "v1")


@query("S9", "score_summary", "segment:s customers:i mean_p_alive:6 clv_total:2", "scores", """
    SELECT segment, count(*) AS customers, avg(p_alive) AS mean_p_alive, sum(clv_mean) AS clv_total
    FROM scores GROUP BY 1""")
def _(spark, sf):
    return S.score_summary(scores(spark, sf))


@query("S10", "label_positions", "rows:i fingerprint:i", "base_lines", """
    SELECT count(*) AS rows, sum(CAST('0x' || substr(md5(CAST(line_id AS VARCHAR)), 1, 8) AS BIGINT))
             AS fingerprint
    FROM base_lines WHERE customer_id IS NULL""")
def _(spark, sf):
    return S.label_positions(R._lines(spark, sf), F.col("customer_id").isNull())
