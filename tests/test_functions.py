import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tallyfield.functions import special, uniform


def column(spark, values, expr):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_lgamma_and_digamma(spark):
    xs = [0.05, 0.3, 1.0, 1.5, 2.0, 7.25, 30.0, 400.0, 12345.6]
    for x, got in zip(xs, column(spark, xs, special.lgamma), strict=True):
        assert got == pytest.approx(math.lgamma(x), abs=1e-9, rel=1e-12)
    h = 1e-5
    for x, got in zip(xs, column(spark, xs, special.digamma), strict=True):
        want = (math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h)
        assert got == pytest.approx(want, abs=2e-5, rel=1e-5)
    assert column(spark, [1.0], special.digamma)[0] == pytest.approx(-0.5772156649015329, abs=1e-11)


def test_erfc(spark):
    xs = [0.0, 0.1, 0.7, 1.5, 2.9, 3.1, 4.0, 6.0]
    for x, got in zip(xs, column(spark, xs, special.erfc), strict=True):
        assert got == pytest.approx(math.erfc(x), rel=1e-9, abs=1e-15)


def test_hyp2f1_against_known_closed_forms(spark):
    rows = [(1.0, 1.0, 2.0, z) for z in (0.1, 0.5, 0.9, 0.99)]
    df = spark.createDataFrame(rows, "a double, b double, c double, z double")
    got = df.select("z", special.hyp2f1("a", "b", "c", "z").alias("f")).collect()
    for r in got:
        assert r["f"] == pytest.approx(-math.log(1 - r["z"]) / r["z"], rel=1e-10)
    zero = spark.createDataFrame([(3.0, 0.4, 1.2, 0.0)], "a double, b double, c double, z double")
    assert zero.select(special.hyp2f1("a", "b", "c", "z")).first()[0] == 1.0


def test_uniform_is_the_md5_of_the_key(spark):
    df = spark.createDataFrame([(7, "a")], "k int, s string")
    got = df.select(uniform.uniform("salt", "k", "s")).first()[0]
    want = int(hashlib.md5(b"salt|7|a").hexdigest()[:8], 16) / 2**32
    assert got == want


def test_poisson_weights_have_mean_and_variance_one(spark):
    w = spark.range(20000).select(uniform.poisson_one(uniform.uniform("p", "id")).alias("w"))
    row = w.agg(F.avg("w"), F.var_samp("w")).first()
    assert row[0] == pytest.approx(1.0, abs=0.03)
    assert row[1] == pytest.approx(1.0, abs=0.05)


def test_normal_draws(spark):
    z = spark.range(20000).select(uniform.standard_normal("z", "id").alias("z"))
    row = z.agg(F.avg("z"), F.stddev_samp("z")).first()
    assert row[0] == pytest.approx(0.0, abs=0.03)
    assert row[1] == pytest.approx(1.0, abs=0.03)


def test_gauss_near_one():
    """Against the plain series with many terms."""
    import numpy as np

    from tallyfield.functions.special import gauss

    for a, b, c in ((0.24, 2.43, 2.22), (1.4, 0.6, 3.1)):
        for z in (0.3, 0.8, 0.97, 0.9999):
            n = np.arange(400_000.0)
            want = 1 + np.exp(np.cumsum(np.log((a + n) * (b + n) / ((c + n) * (n + 1)) * z))).sum()
            got = gauss(*(np.array([v]) for v in (a, b, c, z)))[0]
            assert abs(got / want - 1) < 1e-10
    assert np.isnan(gauss(*(np.array([v]) for v in (1.0, 1.0, 2.0, 1.5)))[0])


def test_weights_read_from_text_are_those_read_from_numbers(spark):
    ids = spark.range(20000)
    text = uniform.digest("t", "id")
    rows = ids.select(uniform.poisson_one(uniform.uniform("t", "id")).alias("a"), uniform.poisson_one_of(text).alias("b"), uniform.drawn_at_all(text).alias("c"))
    assert rows.where("a <> b or c <> (a > 0)").count() == 0
    cuts = spark.createDataFrame([(f"{math.ceil(c * 2**32) + d:08x}", c) for c in uniform.poisson_one_cuts() for d in (-1, 0)], "text string, cut double")
    exact = F.conv("text", 16, 10).cast("double") / 2.0**32
    assert cuts.where(uniform.poisson_one(exact) != uniform.poisson_one_of(F.col("text"))).count() == 0
    assert all(len(c) == 8 for c in [r["text"] for r in cuts.collect()])
