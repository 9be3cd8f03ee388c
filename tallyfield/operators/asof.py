"""As-of left join: for each left row the latest right row at or before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_left_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str,
                   right_time: str, right_id: str, carry: Sequence[str],
                   bucket_seconds: int = 86400) -> DataFrame:
    """Left rows with the ``carry`` columns of the latest right row of the same ``keys``.

    Equal times match; at one time the largest ``right_id`` wins; unmatched rows keep NULL, as do
    rows with a NULL key. Keys are cut into time buckets so one hot key spreads over many tasks: a
    window finds the match inside a bucket, and the last right row of earlier buckets (one row per
    key and bucket) is carried forward.
    """
    keys, carry = list(keys), list(carry)
    # keys and the id are dealt once, not again inside the structs
    payload = F.struct(F.col(right_time).cast("timestamp").alias("_t"),
                       F.col(right_id).alias("_id"), *[F.col(c) for c in carry if c != right_id])
    left_cols = left.columns
    lefts = left.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                        F.col(left_time).cast("timestamp").alias("_at"), F.lit(1).alias("_side"),
                        F.struct(*([c for c in left_cols if c not in keys] or [F.lit(1)])).alias("_left"))
    rights = (right.dropna(subset=keys + [right_time])
              .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                      F.col(right_time).cast("timestamp").alias("_at"), F.lit(0).alias("_side"),
                      payload.alias("_right")))
    both = lefts.unionByName(rights, allowMissingColumns=True).withColumn(
        "_b", F.floor(F.unix_timestamp("_at") / bucket_seconds))
    ks = [f"_k{i}" for i in range(len(keys))]
    inside = (W.partitionBy(*ks, "_b").orderBy("_at", "_side")
              .rangeBetween(W.unboundedPreceding, W.currentRow))
    seen = both.withColumn("_here", F.max("_right").over(inside)).filter("_side = 1")
    ends = both.groupBy(*ks, "_b").agg(F.max("_right").alias("_end"))
    earlier = W.partitionBy(*ks).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carried = (ends.withColumn("_before", F.max("_end").over(earlier))
               .filter("_before is not null").select(*ks, "_b", "_before"))
    joined = seen.join(carried, [*ks, "_b"], "left")
    hit = F.coalesce("_here", "_before")
    own = [F.col(f"_k{keys.index(c)}").alias(c) if c in keys else F.col("_left")[c].alias(c) for c in left_cols]
    return joined.select(*own, *[hit["_id" if c == right_id else c].alias(c) for c in carry])
