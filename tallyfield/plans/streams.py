"""Streaming queries: files arrive in several batches; results equal the batch operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.operators import policy as N
from tallyfield.plans import roles as R
from tallyfield.plans.extracts import scores
from tallyfield.plans.policy import CONTEXT, PENALTY
from tallyfield.plans.registry import query
from tallyfield.session import scratch_path
from tallyfield.sources import tables as S
from tallyfield.streaming import jobs as J


def arriving(df, name: str, order: str, batches: int = 3):
    """The rows as a stream of files, a third of the files per batch.

    Spark chooses the number of files, so none grows with the log. A batch takes the files in the order in which they were written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.repartitionByRange(order).write.parquet(path)
    files = len(spark.read.schema(df.schema).parquet(path).inputFiles())
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(path)


@query("W1", "stream_arm_stats", "day:d context:i arm:i total:4 n:i", "log", f"""
    SELECT DATE '{R.FIRST_DAY}' + CAST(day AS INT) AS day, {CONTEXT} AS context, action AS arm,
           sum(margin - opted_out_today * CASE segment WHEN 'low' THEN 5.0 WHEN 'mid' THEN 10.0
               ELSE 20.0 END) AS total, count(*) AS n
    FROM log WHERE eligible = 1 GROUP BY 1, 2, 3""")
def _(spark, sf):
    rows = R.user_days(spark, sf).filter("eligible = 1").select(
        F.date_add(F.lit(R.FIRST_DAY).cast("date"), F.col("day")).cast("timestamp").alias("ts"),
        N.context_index().alias("context"), F.col("action").alias("arm"), "segment", "margin",
        "opted_out_today")
    # file order is not arrival order, so the delay covers the whole log: no row is late
    stats = J.stream_arm_stats(arriving(rows, "user_days", "ts"), PENALTY, delay="60 days")
    return J.latest(J.run_available(stats, "arm_stats"), ["day", "context", "arm"])


@query("W2", "stream_score_upsert", "customer_id:s p_alive:6 segment:s model_version:s scored_at:d",
       "scores", "SELECT * FROM scores")
def _(spark, sf):
    path = scratch_path(spark, "stream_scores")
    for _run in range(2):  # the second run replaces every row with itself
        job = J.stream_score_upsert(arriving(scores(spark, sf), "scores", "customer_id"), path, "v1",
                                    "2001-01-01", scratch_path(spark, "upsert-state"))
        job.awaitTermination()
    return S.read_scores(spark, path)


@query("W3", "stream_dedup_lines", "invoice:s stock_code:s quantity:i copies:i", "lines flags", """
    SELECT invoice, stock_code, quantity, count(*) AS copies FROM lines JOIN flags USING (line_id)
    WHERE NOT duplicate GROUP BY 1, 2, 3""")
def _(spark, sf):
    rows = R.invoice_lines(spark, sf).withColumn("arrived_at", F.col("invoice_date").cast(
        "timestamp"))
    kept = J.stream_dedup_lines(arriving(rows, "lines", "arrived_at"), delay="4000 days")
    return J.run_available(kept, "dedup", "append").groupBy("invoice", "stock_code", "quantity").agg(
        F.count(F.lit(1)).alias("copies"))


@query("W4", "stream_customer_rfm", "customer_id:i first_day:d last_day:d purchase_days:i purchases:i"
       " amount:2", "tx", """
    SELECT customer_id, min(date) AS first_day, max(date) AS last_day,
           count(DISTINCT date) AS purchase_days, count(*) AS purchases, sum(amount) AS amount
    FROM tx GROUP BY 1""")
def _(spark, sf):
    tx = R.transactions(spark, sf).withColumn("date", F.col("date").cast("timestamp"))
    days = J.stream_customer_days(arriving(tx, "tx", "date"), delay="4000 days")
    return J.rfm_from_days(J.latest(J.run_available(days, "customer_days"), ["customer_id", "day"]))
