"""Ordered computations against pandas/numpy, in several range buckets, on skewed groups."""

import glob

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyfield.operators import ordering as O
from tallyfield.operators.asof import asof_left_join
from tallyfield.session import shared_folder


@pytest.fixture(scope="module", autouse=True)
def many_buckets(spark):
    """Small tables would be dealt to one bucket."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    n = 6000
    key = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 40, n))  # one key has over a third
    pdf = pd.DataFrame({"k": key, "id": np.arange(n), "v": rng.normal(size=n).round(2)})
    return pdf, spark.createDataFrame(pdf).repartition(5).cache()


def test_running_sums(skewed):
    pdf, df = skewed
    got = O.cumulate(df, ["v", "id"], {"s": "v"}, ["k"]).toPandas().set_index("id")["s"]
    want = pdf.sort_values(["v", "id"]).set_index("id").groupby("k")["v"].cumsum()
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)


def test_global_rank(skewed):
    pdf, df = skewed
    got = O.ranked(df, ["v", "id"]).toPandas().set_index("id")["rank"].sort_index()
    want = pdf.sort_values(["v", "id"]).reset_index(drop=True)
    assert (want["id"].map(got).to_numpy() == np.arange(1, len(pdf) + 1)).all()


def test_quantiles(skewed):
    pdf, df = skewed
    probs = {"a": 0.03, "b": 0.5, "c": 0.97}
    got = O.exact_quantiles(df, "v", probs, ["k"]).toPandas().set_index("k").sort_index()
    want = pdf.groupby("k")["v"].quantile([0.03, 0.5, 0.97]).unstack()
    np.testing.assert_allclose(got[["a", "b", "c"]].to_numpy(), want.to_numpy(), atol=1e-12)
    one = O.exact_quantiles(df, "v", probs).first()
    np.testing.assert_allclose([one["a"], one["b"], one["c"]],
                               np.quantile(pdf["v"], [0.03, 0.5, 0.97]), atol=1e-12)


def test_ntile_and_average_rank(skewed):
    pdf, df = skewed
    tiles = O.with_ntile(df.limit(6000), 7, ["v", "id"], "t").toPandas()
    sizes = tiles.groupby("t").size()
    assert sizes.max() - sizes.min() <= 1 and list(sizes.index) == list(range(1, 8))
    assert tiles.groupby("t")["v"].max().is_monotonic_increasing
    ranks = O.average_rank(df, "v", "r").toPandas().set_index("id")["r"].sort_index()
    np.testing.assert_allclose(ranks.to_numpy(), pdf["v"].rank().to_numpy())


def test_buckets_are_balanced_and_ordered(skewed):
    _, df = skewed
    rows = O.with_range_bucket(df, ["v", "id"]).groupBy("_bucket").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).toPandas()
    rows = rows.sort_values("_bucket")
    assert len(rows) == 8 and rows["n"].max() < 2 * rows["n"].mean()
    assert (rows["hi"].to_numpy()[:-1] <= rows["lo"].to_numpy()[1:]).all()


def test_groups_named_by_null(spark):
    df = spark.createDataFrame([(None, i, 1) for i in range(20)] + [(1, i, 2) for i in range(5)], "k int, i int, v int")
    got = O.cumulate(df, ["i"], {"s": "v"}, ["k"]).groupBy("k").agg(F.max("s").alias("s"), F.count("*").alias("n"))
    assert {r["k"]: (r["s"], r["n"]) for r in got.collect()} == {None: (20, 20), 1: (10, 5)}


@pytest.mark.parametrize("width", [3600, 86400, 10**9])
def test_asof_matches_merge_asof(spark, width):
    rng = np.random.default_rng(5)
    base = pd.Timestamp("2024-01-01")

    def stamps(n):
        return base + pd.to_timedelta(rng.integers(0, 40 * 24 * 60, n), unit="min")

    left = pd.DataFrame({"lid": range(800), "k": np.where(rng.random(800) < 0.5, 0,
                                                         rng.integers(1, 9, 800)), "t": stamps(800)})
    right = pd.DataFrame({"rid": range(700), "k": np.where(rng.random(700) < 0.5, 0,
                                                          rng.integers(1, 9, 700)), "u": stamps(700)})
    right.loc[:3, "u"] = left["t"].iloc[:4].to_numpy()  # equal times match
    right.loc[:3, "k"] = left["k"].iloc[:4].to_numpy()
    got = asof_left_join(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "t", "u",
                         "rid", ["rid"], width).toPandas().set_index("lid")["rid"].sort_index()
    want = pd.merge_asof(left.sort_values("t"), right.sort_values(["u", "rid"]), left_on="t",
                         right_on="u", by="k").set_index("lid")["rid"].sort_index()
    pd.testing.assert_series_equal(got.astype(float), want.astype(float), check_names=False)


def test_asof_null_keys_never_match(spark):
    left = spark.createDataFrame([(1, None, "2024-01-02")], "id int, k int, t string").withColumn(
        "t", F.col("t").cast("timestamp"))
    right = spark.createDataFrame([(5, None, "2024-01-01")], "rid int, k int, u string").withColumn(
        "u", F.col("u").cast("timestamp"))
    assert asof_left_join(left, right, ["k"], "t", "u", "rid", ["rid"]).first()["rid"] is None


def test_average_ranks_of_values_that_differ_when_computed_again(spark):
    import random

    noisy = F.udf(lambda i: random.random(), "double").asNondeterministic()
    df = spark.range(50).select("id", noisy("id").alias("v"))
    got = O.average_rank(df, "v", "r").collect()
    assert sorted(r["r"] for r in got) == list(range(1, 51))


def test_a_batch_of_a_stream_is_more_than_one_file(spark):
    from tallyfield.plans.streams import arriving
    from tallyfield.streaming.jobs import run_available

    stream = arriving(spark.range(10000).repartition(4), "arriving", "id")
    written = glob.glob(f"{shared_folder(spark)}/arriving-*/*.parquet".removeprefix("file:"))
    assert len(written) > 3
    got = run_available(stream, "batches", "append")
    assert got.count() == 10000 and got.select("batch").distinct().count() == 3
