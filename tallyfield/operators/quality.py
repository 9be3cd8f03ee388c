"""Data-quality checks that return counts of violations instead of raising."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.operators.ordering import with_range_bucket


def expect_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Raise if a required column is missing; else the table itself."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; the table has {df.columns}")
    return df


def column_report(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """One row per required column: is it there, and how many of its values are missing.

    Columns that are absent are reported, not read.
    """
    cells = []
    for c in required:
        there = c in df.columns
        nulls = F.count_if(F.col(c).isNull()) if there else F.lit(None).cast("bigint")
        cells.append(F.struct(F.lit(c).alias("column"), F.lit(there).alias("present"),
                              nulls.alias("nulls")))
    return df.agg(F.array(*cells).alias("r")).select(F.inline("r"))


def _bad(value: Column) -> Column:
    return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))


def rfm_violations(rfm: DataFrame, customer: str = "customer_id") -> DataFrame:
    """Counts for the eight invariants of an RFM table, in one aggregate over customers."""
    f, r, t = (F.col(c).cast("double") for c in ("frequency", "recency", "T"))
    eps = 1e-9
    per = rfm.groupBy(customer).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.coalesce(cond, F.lit(False))).alias(name) for name, cond in (
            ("not_finite", _bad(f) | _bad(r) | _bad(t)),
            ("frequency_not_whole", (f >= 0) & (F.abs(f - F.round(f)) > 1e-8)),
            ("frequency_negative", f < 0), ("recency_negative", r < 0),
            ("recency_over_age", r > t + eps), ("recency_without_repeat", (f == 0) & (r > eps)),
            ("frequency_over_recency", f > r + eps))])
    names = [c for c in per.columns if c not in (customer, "n")]
    return per.agg(F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("repeated_customers"),
                   *[F.sum(c).alias(c) for c in names])


def probability_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: values that are missing or infinite, and finite ones outside [0, 1]."""
    cells = []
    for c in columns:
        v = F.col(c).cast("double")
        cells.append(F.struct(
            F.lit(c).alias("column"), F.count_if(_bad(v)).alias("not_finite"),
            F.count_if(~_bad(v) & ((v < 0) | (v > 1))).alias("outside")))
    return df.agg(F.array(*cells).alias("r")).select(F.inline("r"))


def monotone_violations(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (),
                        increasing: bool = True, strict: bool = False) -> DataFrame:
    """Steps that break the order of ``value`` along ``order`` inside each ``by`` group.

    Steps inside a range bucket come from ``lag``; the one step between two buckets compares the
    last row of a bucket with the first of the next (one row per bucket).
    """
    by = list(by)
    rows = with_range_bucket(df, [*by, *order])
    w = W.partitionBy(*by, "_bucket").orderBy(*order)

    def broken(prev: Column, cur: Column) -> Column:
        if increasing:
            return cur <= prev if strict else cur < prev
        return cur >= prev if strict else cur > prev

    inside = rows.withColumn("_prev", F.lag(value).over(w)).groupBy(*by, "_bucket").agg(
        F.count_if(F.coalesce(broken(F.col("_prev"), F.col(value)), F.lit(False))).alias("_bad"),
        F.count(F.lit(1)).alias("_n"),
        F.min_by(value, F.struct(*order)).alias("_first"),
        F.max_by(value, F.struct(*order)).alias("_last"))
    edge = W.partitionBy(*by).orderBy("_bucket")
    joined = inside.withColumn("_prev", F.lag("_last").over(edge))
    jump = F.coalesce(broken(F.col("_prev"), F.col("_first")), F.lit(False)).cast("bigint")
    return joined.groupBy(*by).agg(F.sum("_n").alias("rows"),
                                   F.sum(F.col("_bad") + jump).alias("violations"))


def is_close(a: Column, b: Column, rel: float, abs_tol: float) -> Column:
    """|a - b| <= abs + rel |b|; two missing values agree, one does not."""
    near = F.abs(a - b) <= F.lit(abs_tol) + F.lit(rel) * F.abs(b)
    return F.when(a.isNull() & b.isNull(), True).otherwise(F.coalesce(near, F.lit(False)))


def close_violations(df: DataFrame, estimate: str, target: str, rel: float = 0.0,
                     abs_tol: float = 0.0) -> DataFrame:
    """Rows whose estimate is not within abs + rel |target| of the target, and the largest gap."""
    e, t = F.col(estimate).cast("double"), F.col(target).cast("double")
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.count_if(~is_close(e, t, rel, abs_tol)).alias("violations"),
                  F.max(F.abs(e - t)).alias("largest_gap"))


def frames_agree(left: DataFrame, right: DataFrame, on: Sequence[str], rel: float = 1e-9,
                 abs_tol: float = 1e-9) -> DataFrame:
    """Differences of two tables matched on ``on``: one row per finding with its count.

    Rows per side, repeated keys, keys on one side only, and mismatches per shared column. Each side
    is reduced to one row per key before the join, so a repeated key cannot multiply.
    """
    on = list(on)
    expect_columns(left, on)
    expect_columns(right, on)
    shared = [c for c in left.columns if c in right.columns and c not in on]
    if not shared:
        raise ValueError(f"the tables share no columns besides {on}")

    def one(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy(*on).agg(F.count(F.lit(1)).alias(f"_n{tag}"),
                                   *[F.min(c).alias(f"{c}{tag}") for c in shared])

    both = one(left, "_a").join(one(right, "_b"), on, "full")
    matched = F.col("_n_a").isNotNull() & F.col("_n_b").isNotNull()
    types = dict(left.dtypes)
    cells = [("rows left", F.coalesce(F.sum("_n_a"), F.lit(0))),
             ("rows right", F.coalesce(F.sum("_n_b"), F.lit(0))),
             ("repeated keys left", F.count_if(F.col("_n_a") > 1)),
             ("repeated keys right", F.count_if(F.col("_n_b") > 1)),
             ("only left", F.count_if(F.col("_n_b").isNull())),
             ("only right", F.count_if(F.col("_n_a").isNull()))]
    numeric = {f.name for f in left.schema.fields if isinstance(f.dataType, T.NumericType)}
    for c in shared:
        a, b = F.col(f"{c}_a"), F.col(f"{c}_b")
        if c in numeric:
            same = is_close(a.cast("double"), b.cast("double"), rel, abs_tol)
        else:
            same = a.eqNullSafe(b.cast(types[c]))
        cells.append((f"differs {c}", F.count_if(matched & ~same)))
    return both.agg(F.array(*[F.struct(F.lit(k).alias("finding"), v.cast("bigint").alias("n"))
                              for k, v in cells]).alias("r")).select(F.inline("r"))


def leakage_check(features: Callable[[DataFrame], DataFrame], tx: DataFrame, cutoff,
                  key: str = "customer_id", date: str = "date", amount: str = "amount"
                  ) -> DataFrame:
    """Features must not change when rows after the cutoff are deleted or scrambled."""
    late = F.col(date).cast("date") > F.lit(str(cutoff)).cast("date")
    full = features(tx)
    out = None
    for name, other in (("deleted", tx.filter(~late)),
                        ("scrambled", tx.withColumn(amount, F.when(late, -7.0 * F.col(amount))
                                                    .otherwise(F.col(amount))))):
        found = frames_agree(full, features(other), [key]).withColumn("trial", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out
