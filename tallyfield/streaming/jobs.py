"""Streaming jobs. Each takes a streaming DataFrame and returns one, or starts an idempotent sink."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyfield.operators.cleaning import LINE_COLUMNS
from tallyfield.session import scratch_path
from tallyfield.sources.tables import write_scores


def stream_arm_stats(log: DataFrame, penalty: Mapping[str, float], ts: str = "ts",
                     delay: str = "1 day") -> DataFrame:
    """Daily reward sums and counts per (context, arm), as rows arrive.

    State holds the days inside the watermark only; rows later than ``delay`` are dropped.
    """
    table = F.create_map(*[F.lit(x) for k, v in penalty.items() for x in (k, float(v))])
    reward = F.col("margin") - table[F.col("segment")] * F.col("opted_out_today")
    day = F.window(ts, "1 day")
    return (log.withWatermark(ts, delay).groupBy(day.alias("w"), "context", "arm")
            .agg(F.sum(reward).alias("total"), F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").cast("date").alias("day"), "context", "arm", "total", "n"))


def stream_score_upsert(scores: DataFrame, path: str, model_version: str, scored_at,
                        checkpoint: str) -> StreamingQuery:
    """Write score batches by upsert. A replayed batch replaces the same rows, so nothing doubles."""
    def upsert(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            write_scores(batch, path, model_version, scored_at)

    return (scores.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def stream_dedup_lines(lines: DataFrame, ts: str = "arrived_at", delay: str = "1 day",
                       columns: Sequence[str] = LINE_COLUMNS) -> DataFrame:
    """Drop exact copies that arrive within ``delay`` of the first; NULLs count as equal."""
    return lines.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(columns))


def stream_customer_days(tx: DataFrame, customer: str = "customer_id", ts: str = "date",
                         amount: str = "amount", delay: str = "7 days") -> DataFrame:
    """Purchases and amount per customer and day, updated as transactions arrive.

    Days that fall behind the watermark leave the state, so it grows with recent activity and not
    with the number of customers ever seen. :func:`rfm_from_days` rolls the rows up.
    """
    day = F.window(ts, "1 day")
    return (tx.withWatermark(ts, delay).groupBy(customer, day.alias("w"))
            .agg(F.count(F.lit(1)).alias("purchases"), F.sum(amount).alias("amount"))
            .select(customer, F.col("w.start").cast("date").alias("day"), "purchases", "amount"))


def rfm_from_days(days: DataFrame, customer: str = "customer_id") -> DataFrame:
    """First and last day, purchase days and amount per customer from the streamed rows."""
    return days.groupBy(customer).agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.count(F.lit(1)).alias("purchase_days"), F.sum("purchases").alias("purchases"),
        F.sum("amount").alias("amount"))


def run_available(stream: DataFrame, name: str, mode: str = "update") -> DataFrame:
    """Process what is there, keeping every emitted row with the number of its batch.

    A batch writes its own folder, so a retried batch overwrites itself.
    """
    spark: SparkSession = stream.sparkSession
    out = scratch_path(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (stream.writeStream.outputMode(mode).foreachBatch(keep)
             .option("checkpointLocation", scratch_path(spark, f"{name}-state"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    fields = ", ".join(f"{c} {t}" for c, t in stream.dtypes)
    return spark.read.schema(f"{fields}, batch int").parquet(out)


def latest(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last emitted row of each key of an update-mode stream."""
    rest = [c for c in updates.columns if c not in keys and c != "batch"]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(
        *keys, "_r.*")
