"""Ordered computations without a one-task window.

A window with no (or a hot) partition key sends its rows to one task. Here rows are dealt to range partitions of
the ordering keys and written with the number of their partition; sums are then taken inside each partition and
shifted by the totals of the partitions before. Spark chooses the number and the bounds of the partitions from the
data; once written they are fixed, so a recomputed task finds its rows where they were.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfield.session import cut_lineage


def with_range_bucket(df: DataFrame, keys: Sequence[str], name: str = "_bucket") -> DataFrame:
    """A written copy of ``df`` with a bucket number that grows with the ordering ``keys``.

    Rows with equal keys share a bucket. A group that leads the keys and holds most rows spreads over many buckets.
    """
    return cut_lineage(df.repartitionByRange(*[F.col(k) for k in keys]).withColumn(name, F.spark_partition_id()))


def cumulate(df: DataFrame, order: Sequence[str], sums: dict[str, str],
             by: Sequence[str] = ()) -> DataFrame:
    """Running sums in ascending ``order`` inside each ``by`` group.

    ``sums`` maps a new column to the column it accumulates. ``by`` plus ``order`` must identify a
    row: aggregate ties away or add an id first. The input is written once, so pass only the columns that
    are needed.
    """
    by, order = list(by), list(order)
    rows = with_range_bucket(df, by + order)
    local = W.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    totals = rows.groupBy(*by, "_bucket").agg(
        *[F.sum(src).alias(f"_t_{out}") for out, src in sums.items()])
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    shifts = totals.select(
        *by, "_bucket", *[F.sum(f"_t_{out}").over(before).alias(f"_s_{out}") for out in sums])
    running = rows.select("*", *[F.sum(src).over(local).alias(out) for out, src in sums.items()])
    if by:  # a group may be named by null
        shifts = shifts.select("_bucket", *[F.col(b).alias(f"_by_{b}") for b in by], *[f"_s_{o}" for o in sums])
        same = running["_bucket"] == shifts["_bucket"]
        for b in by:
            same = same & running[b].eqNullSafe(shifts[f"_by_{b}"])
        shifted = running.join(shifts, same, "left").drop(shifts["_bucket"], *[f"_by_{b}" for b in by])
    else:
        shifted = running.join(shifts, "_bucket", "left")
    for out in sums:
        shifted = shifted.withColumn(out, F.col(out) + F.coalesce(F.col(f"_s_{out}"), F.lit(0)))
    return shifted.drop("_bucket", *[f"_s_{out}" for out in sums])


def ranked(df: DataFrame, order: Sequence[str], by: Sequence[str] = (),
           name: str = "rank") -> DataFrame:
    """Row number from 1 in ascending ``order`` inside ``by``; ``order`` must break all ties."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    return cumulate(one, order, {name: "_one"}, by).drop("_one")


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float],
                    by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per ``by`` group.

    ``probs`` maps an output column to its probability. Equal values are counted together before
    anything is ordered; the two order statistics are picked by their running counts.
    """
    by = list(by)
    counts = (df.filter(F.col(value).isNotNull()).groupBy(*by, value)
              .agg(F.count(F.lit(1)).alias("_n")))
    running = cumulate(counts, [value], {"_cum": "_n"}, by)
    sizes = counts.groupBy(*by).agg(F.sum("_n").alias("_size"))
    if by:
        at = running.join(sizes, by)
    else:
        at = running.withColumn("_size", sizes.select("_size").scalar())
    picks = []
    for out, p in probs.items():
        h = (F.col("_size") - 1) * F.lit(float(p))
        picks += [F.min(F.when(F.col("_cum") > F.floor(h), F.col(value))).alias(f"_lo_{out}"),
                  F.min(F.when(F.col("_cum") > F.ceil(h), F.col(value))).alias(f"_hi_{out}"),
                  F.max(h - F.floor(h)).alias(f"_f_{out}")]
    found = at.groupBy(*by).agg(*picks)
    return found.select(*by, *[
        F.when(F.col(f"_lo_{o}") == F.col(f"_hi_{o}"), F.col(f"_lo_{o}")).otherwise(
            F.col(f"_lo_{o}") + (F.col(f"_hi_{o}") - F.col(f"_lo_{o}")) * F.col(f"_f_{o}")).alias(o)
        for o in probs])


def with_ntile(df: DataFrame, n: int, order: Sequence[str], name: str) -> DataFrame:
    """NTILE(n) over a total order: the first ``size mod n`` tiles hold one row more."""
    rows = ranked(df, order, name="_rn")
    rows = rows.withColumn("_size", rows.agg(F.max("_rn").alias("c")).scalar())
    small = F.floor(F.col("_size") / n)
    extra = F.col("_size") % n
    edge = extra * (small + 1)
    tile = F.when(F.col("_rn") <= edge, F.floor((F.col("_rn") - 1) / (small + 1)) + 1).otherwise(
        extra + F.floor((F.col("_rn") - 1 - edge) / F.greatest(small, F.lit(1))) + 1)
    return rows.withColumn(name, tile.cast("int")).drop("_rn", "_size")


def average_rank(df: DataFrame, value: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank with ties at their mean, as Spearman's correlation uses.

    The rows are written first: they are read twice and joined on ``value``, and a sum of floating-point numbers may differ in its last
    digit when it is computed again.
    """
    by = list(by)
    df = cut_lineage(df)
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_ties"))
    running = cumulate(counts, [value], {"_cum": "_ties"}, by)
    table = running.select(*by, value, (F.col("_cum") - (F.col("_ties") - 1) / 2.0).alias(name))
    return df.join(table, [*by, value])
