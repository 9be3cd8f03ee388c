"""Bootstrap weights.

A resample of n rows with replacement gives each row a multinomial count. Drawing exactly n needs the
whole table in one place, so every row gets an independent Poisson(1) weight instead: the same
bootstrap in the limit, with a random total size. Weights come from hashes, so they can be replayed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.uniform import digest, drawn_at_all, poisson_one_below, poisson_one_of


def in_all_tasks(df: DataFrame, *key: str | Column) -> DataFrame:
    """``df`` dealt by ``key`` to as many tasks as the session has, however few bytes it holds.

    Where rows come dealt by the very columns of ``key`` Spark leaves this out; a hash of them is dealt anew.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *key)


def with_resamples(df: DataFrame, key: Sequence[str], resamples: int, salt: str = "boot",
                   name: str = "weight") -> DataFrame:
    """Each row once per resample it is drawn into: columns ``b`` (1..B) and the weight.

    Rows drawn zero times are left out before any shuffle. The rows are dealt anew by ``key`` before they are multiplied: a few
    small partitions would become few very long tasks.
    """
    rows = in_all_tasks(df, *key).select("*", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("b"))
    # the filter reads the digest once a row; a filter on the weight would read it once for every cut
    text = digest(salt, *key, "b")
    return rows.filter(drawn_at_all(text)).withColumn("_digest", text).withColumn(name, poisson_one_of(F.col("_digest"))).drop("_digest")


def resample_weights(key: Sequence[str], resamples: int, salt: str = "boot") -> Column:
    """The weights of :func:`with_resamples` as one array: position b - 1 is resample b's."""
    texts = F.transform(F.sequence(F.lit(1), F.lit(resamples)), lambda b: digest(salt, *key, b))
    return F.transform(texts, poisson_one_below)


def sum_each(values: Column, size: int, factor: Column | None = None) -> Column:
    """Position by position sums of arrays of ``size``, an ordinary partial aggregate: rows are not multiplied."""
    at = (F.get(values, F.lit(i)) for i in range(size))
    return F.array(*[F.sum(x if factor is None else x * factor) for x in at])


def resampled_sums(df: DataFrame, sums: Mapping[str, Column], key: Sequence[str], resamples: int, salt: str = "boot",
                   by: Sequence[str] = ()) -> DataFrame:
    """Weighted sums of every resample: ``by``, b and a column per entry of ``sums``, from one pass over the rows."""
    rows = df.select(*by, *[c.alias(f"_{n}") for n, c in sums.items()], resample_weights(key, resamples, salt).alias("_w"))
    vectors = rows.groupBy(*by).agg(*[sum_each(F.col("_w"), resamples, F.col(f"_{n}")).alias(n) for n in sums])
    return by_resample(vectors, list(sums), by)


def by_resample(vectors: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Arrays of sums as long rows (``by``, b, ``names``)."""
    return vectors.select(*by, F.posexplode(F.arrays_zip(*names)).alias("_at", "_s")).select(
        *by, (F.col("_at") + 1).alias("b"), *[F.col(f"_s.{n}").alias(n) for n in names])
