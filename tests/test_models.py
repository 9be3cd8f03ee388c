"""Likelihoods, draws, survival and regression against hand values or plain numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyfield.operators import clv as C
from tallyfield.operators import draws as I
from tallyfield.operators import survival as V
from tallyfield.operators.fitting import FitError
from tallyfield.operators.linear import ols
from tallyfield.operators.resample import resample_weights, with_resamples


def test_sbg_fit_reproduces_published_estimates(spark):
    # survivors by year of two published cohorts (fixed values)
    curves = {"regular": [1000, 631, 468, 382, 326, 289, 262, 241],
              "highend": [1000, 869, 743, 653, 593, 551, 517, 491]}
    want = {"regular": (0.704, 1.182), "highend": (0.668, 3.806)}
    for name, alive in curves.items():
        df = spark.createDataFrame([(name, y, n) for y, n in enumerate(alive)],
                                   "cohort string, year int, alive int")
        rows = C.counts_to_customers(df)
        assert rows.count() == 1000
        got = C.sbg_fit(rows)
        assert got["alpha"] == pytest.approx(want[name][0], rel=0.01)
        assert got["beta"] == pytest.approx(want[name][1], rel=0.01)


def test_counts_to_customers(spark):
    df = spark.createDataFrame([("a", k, n) for k, n in enumerate([12, 9, 9, 2])], "cohort string, year int, alive int")
    got = C.counts_to_customers(df).groupBy("recency", "T").count().collect()
    # 3 leave in the first period, none in the second, 7 in the third, 2 are left
    assert {(r["recency"], r["T"]): r["count"] for r in got} == {(1, 4): 3, (3, 4): 7, (4, 4): 2}


def simulated_rfm(n=4000, seed=11):
    rng = np.random.default_rng(seed)
    r, alpha, a, b = 0.9, 6.0, 0.8, 2.5
    lam, p = rng.gamma(r, 1 / alpha, n), rng.beta(a, b, n)
    big_t = rng.uniform(20, 50, n)
    x, tx = np.zeros(n), np.zeros(n)
    for i in range(n):
        t = 0.0
        while True:
            t += rng.exponential(1 / lam[i])
            if t > big_t[i]:
                break
            x[i], tx[i] = x[i] + 1, t
            if rng.random() < p[i]:
                break
    nu = rng.gamma(4.0, 1 / 15.0, n)
    z = np.array([rng.gamma(6.0 * max(k, 1), 1 / (v * max(k, 1)))
                  for k, v in zip(x, nu, strict=True)])
    return pd.DataFrame({"customer_id": np.arange(n), "frequency": x, "recency": tx, "T": big_t,
                         "monetary_value": z})


@pytest.fixture(scope="module")
def rfm(spark):
    return spark.createDataFrame(simulated_rfm()).cache()


def test_bgnbd_recovers_parameters_and_gradient(spark, rfm):
    got = C.bgnbd_fit(rfm)
    assert got["r"] == pytest.approx(0.9, rel=0.2)
    assert got["alpha"] == pytest.approx(6.0, rel=0.25)
    assert got["a"] / (got["a"] + got["b"]) == pytest.approx(0.8 / 3.3, rel=0.15)
    total = C.bgnbd_loglik(rfm, got).agg(F.sum("loglik")).first()[0]
    for name in got:  # no small move improves the likelihood
        for f in (0.98, 1.02):
            other = C.bgnbd_loglik(rfm, {**got, name: got[name] * f}).agg(F.sum("loglik")).first()[0]
            assert other < total


def test_derivatives_are_those_of_the_likelihood(spark, rfm):
    from tallyfield.operators.fitting import totals

    one = rfm.limit(300).withColumn("n", F.lit(2))
    for model, at, data in ((C.bgnbd_model, {"r": 0.8, "alpha": 5.0, "a": 0.7, "b": 2.0}, one),
                            (C.gamma_gamma_model, {"p": 5.0, "q": 3.0, "v": 12.0}, one.filter("frequency > 0"))):
        data = data.cache()
        names = list(at)
        _, grad, hess = totals(data, "n", names, model, at)
        for i, n in enumerate(names):
            h = 1e-5 * at[n]
            up, down = (totals(data, "n", names, model, {**at, n: at[n] + d}) for d in (h, -h))
            assert (up[0] - down[0]) / (2 * h) == pytest.approx(grad[i], rel=1e-4, abs=1e-7)
            np.testing.assert_allclose((up[1] - down[1]) / (2 * h), hess[i], rtol=1e-4, atol=1e-7)


def test_bgnbd_forecasts_agree(spark):
    params = {"r": 0.9, "alpha": 6.0, "a": 1.8, "b": 2.5}
    df = spark.createDataFrame([(0.0, 0.0, 0.0)], "frequency double, recency double, T double")
    for t in (1.0, 26.0, 500.0):  # a customer without history is a new customer
        old = C.bgnbd_expected_purchases(df, params, t).first()["expected_purchases"]
        new = C.bgnbd_expected_new(spark.createDataFrame([(t,)], "t double"), params).first()
        assert old == pytest.approx(new["expected_purchases"], rel=1e-9)
    never = C.bgnbd_p_alive(df, params).first()["p_alive"]
    assert never == 1.0


def test_gamma_gamma(spark, rfm):
    repeat = rfm.filter("frequency > 0")
    got = C.gamma_gamma_fit(repeat)
    mean = got["p"] * got["v"] / (got["q"] - 1)
    assert mean == pytest.approx(6.0 * 15.0 / 3.0, rel=0.1)
    assert got["q"] == pytest.approx(4.0, rel=0.2)
    with pytest.raises(ValueError):
        C.gamma_gamma_fit(rfm)  # customers without a repeat purchase


def test_impossible_rfm_is_refused(spark):
    bad = spark.createDataFrame([(1.0, 9.0, 3.0)], "frequency double, recency double, T double")
    with pytest.raises(ValueError):
        C.bgnbd_fit(bad)
    same = spark.createDataFrame([(3.0, 30.0, 30.0)] * 5, "frequency double, recency double, T double")
    with pytest.raises(FitError):
        C.bgnbd_fit(same)


def test_new_customer_value(spark):
    cumulative = [0.0, 0.4, 1.1, 1.2]
    df = spark.createDataFrame([("c", k, v, 25.0) for k, v in enumerate(cumulative)],
                               "channel string, month int, cumulative double, spend double")
    got = C.new_customer_value(df, ["channel"], 0.05, 0.3).first()["value"]
    assert got == pytest.approx(0.3 * 25 * (1 + 0.4 / 1.05 + 0.7 / 1.05**2 + 0.1 / 1.05**3))


def test_retarget_thresholds(spark):
    df = spark.createDataFrame([(v,) for v in (0.1, 0.2, 0.45, 0.9)], "p_alive double")
    row = C.retarget_table(df, [0.08], 0.6, 25.0).first()
    # 0.6 / (25 * .08) = .3: the first two stop, each gives up 25 * .08 times its chance
    assert (row["threshold"], row["stopped"], row["share"]) == (pytest.approx(0.3), 2, 0.5)
    assert row["margin_given_up"] == pytest.approx(0.6)


def test_pnbd_special_case_is_the_limit(spark):
    df = spark.createDataFrame([(26.0,)], "t double")
    near = C.pnbd_expected_new(df, 0.5, 10.0, 1.00001, 12.0).first()["expected_purchases"]
    one = C.pnbd_expected_new(df, 0.5, 10.0, 1.0, 12.0).first()["expected_purchases"]
    assert near == pytest.approx(one, rel=1e-4)


# ---- draws ---------------------------------------------------------------------------------------
def reference_hdi(x, prob):
    x = np.sort(x)
    n = len(x)
    k = max(1, min(n - 1, int(math.ceil(prob * n)) - 1))
    i = int(np.argmin(x[k:] - x[: n - k]))
    return x[i], x[i + k]


def test_hdi(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"key": np.repeat(["a", "b", "c"], [900, 37, 2]), "draw": np.arange(939),
                        "value": np.r_[rng.gamma(2, 1, 900), rng.normal(size=37), 1.0, 2.0]})
    df = spark.createDataFrame(pdf).union(spark.createDataFrame(
        [("a", -1, float("nan")), ("d", -2, 1.0)], "key string, draw int, value double"))
    for prob in (0.5, 0.94):
        got = {r["key"]: (r["hdi_low"], r["hdi_high"]) for r in I.hdi(df, ["key"], prob).collect()}
        assert set(got) == {"a", "b", "c"}  # one draw has no interval, NaN does not count
        for key, g in pdf.groupby("key"):
            assert got[key] == pytest.approx(reference_hdi(g["value"].to_numpy(), prob))


def test_verdict(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(10)] + [("b", -1.0), ("c", 1.0),
                                                                      ("c", -1.0)], "k string, value double")
    got = {r["k"]: r["verdict"] for r in I.verdict(df, -0.5, ["k"]).collect()}
    assert got == {"a": "pays back", "b": "does not pay back", "c": "undecided"}


# ---- survival --------------------------------------------------------------------------------------
def durations(spark, t, e):
    return spark.createDataFrame([(float(a), int(b)) for a, b in zip(t, e, strict=True)],
                                 "tenure_months double, churned int")


SPELLS = [1, 4, 4, 4, 6, 7, 7, 10, 12, 12]
ENDED = [1, 1, 0, 1, 0, 1, 1, 0, 1, 0]


def survival_by_hand(t, e):
    """S just after each event time."""
    t, e, s, out = np.array(t), np.array(e), 1.0, {}
    for u in np.unique(t[e == 1]):
        s *= 1 - ((t == u) & (e == 1)).sum() / (t >= u).sum()
        out[float(u)] = s
    return out


def test_kaplan_meier(spark):
    for t, e in ((SPELLS, ENDED), ([3, 3, 3, 8], [1, 1, 1, 0]), ([2, 5, 5], [1, 1, 1])):
        got = {r["t"]: r["survival"] for r in V.kaplan_meier(durations(spark, t, e)).collect()}
        assert got == {k: pytest.approx(v, abs=1e-12) for k, v in survival_by_hand(t, e).items()}


def test_restricted_mean(spark):
    steps = survival_by_hand(SPELLS, ENDED)
    level, at, want = 1.0, 0.0, 0.0
    for u, s in [*steps.items(), (11.0, None)]:
        if u > 11 or s is None:
            want += level * (11 - at)
            break
        want, level, at = want + level * (u - at), s, u
    assert V.rmst(durations(spark, SPELLS, ENDED), 11.0).first()["rmst"] == pytest.approx(want)
    assert V.rmst(durations(spark, [6, 9], [0, 0]), 5.0).first()["rmst"] == 5.0


def test_km_interval_holds_the_estimate(spark):
    rows = {r["time"]: r for r in V.km_interval(V.life_table(durations(spark, SPELLS, ENDED)), [0.5, 5, 9]).collect()}
    assert set(rows) == {5.0, 9.0}
    for r in rows.values():
        assert r["lower"] < r["survival"] < r["upper"]


def test_short_curve_is_an_error(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 0.5)], "period int, survival double")
    assert V.expected_periods(df, 2).first()[0] == 1.5
    with pytest.raises(Exception, match="too short"):
        V.expected_periods(df, 3).collect()


def cox_numpy(t, e, x, steps=30):
    """Efron partial likelihood, event by event."""
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        r = np.exp(x @ beta)
        grad, info = np.zeros(len(beta)), np.zeros((len(beta), len(beta)))
        for u in np.unique(t[e == 1]):
            risk, dead = t >= u, (t == u) & (e == 1)
            d = dead.sum()
            for part in range(d):
                w = r * risk - part / d * r * dead
                m = (w @ x) / w.sum()
                grad += x[dead].sum(0) / d - m
                info += (x.T * w) @ x / w.sum() - np.outer(m, m)
        step = np.linalg.solve(info, grad)
        beta = beta + step
        if np.max(np.abs(step)) < 1e-10:
            break
    return beta, np.sqrt(np.diag(np.linalg.inv(info)))


def test_cox_matches_a_direct_computation(spark):
    rng = np.random.default_rng(8)
    n = 250
    x = np.column_stack([rng.integers(0, 2, n), rng.integers(0, 3, n)]).astype(float)
    t = np.ceil(rng.exponential(6 / np.exp(x @ np.array([0.7, -0.4]))))  # many ties
    e = (rng.random(n) < 0.8).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"tenure_months": t, "churned": e, "a": x[:, 0],
                                             "b": x[:, 1]}))
    beta, se = cox_numpy(t, e, x)
    got = V.cox_fit(df, ["a", "b"]).toPandas()
    np.testing.assert_allclose(got["coef"], beta, atol=1e-7)
    np.testing.assert_allclose(got["se"], se, atol=1e-7)
    p = V.ph_test(df, ["a", "b"]).toPandas()
    assert ((p["p_value"] >= 0) & (p["p_value"] <= 1)).all()


def test_landmark_and_dashboards(spark):
    df = durations(spark, [1, 5, 7], [1, 1, 0])
    parts = V.landmark_split(df, 3.0).collect()
    before = sorted((r["tenure_months"], r["churned"]) for r in parts if r["part"] == "before")
    after = sorted((r["tenure_months"], r["churned"]) for r in parts if r["part"] == "after")
    assert before == [(1.0, 1), (3.0, 0), (3.0, 0)] and after == [(2.0, 1), (4.0, 0)]
    row = V.dashboard_rates(df, 4.0).first()
    assert row["all_subscribers"] == pytest.approx(2 / 3) and row["known_status"] == pytest.approx(2 / 3)
    with pytest.raises(Exception, match="known"):
        V.dashboard_rates(durations(spark, [1], [0]), 4.0).collect()


def test_ols(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2))
    y = 1 + x @ np.array([2.0, -3.0]) + rng.normal(size=400) * (1 + np.abs(x[:, 0]))
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y}))
    design = np.column_stack([np.ones(400), x])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    inv = np.linalg.inv(design.T @ design)
    e = y - design @ beta
    hc1 = np.sqrt(np.diag(inv @ (design.T * e**2) @ design @ inv) * 400 / 397)
    got = ols(df, "y", ["a", "b"], robust="HC1").toPandas()
    np.testing.assert_allclose(got["estimate"], beta, atol=1e-10)
    np.testing.assert_allclose(got["se"], hc1, atol=1e-10)


# ---- resamples ----------------------------------------------------------------------------------
def test_a_resample_hashes_a_row_once_for_the_filter(spark):
    rows = with_resamples(spark.range(10), ["id"], 3)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert [line.count("md5(") for line in plan.splitlines() if "Filter" in line] == [1]
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_weights_of_arrays_stop_at_their_cut_and_equal_those_of_rows(spark):
    df = spark.range(40)
    one = df.select("id", F.posexplode(resample_weights(["id"], 30))).select("id", (F.col("pos") + 1).alias("b"), F.col("col").alias("weight"))
    assert {tuple(r) for r in one.where("weight > 0").collect()} == {
        (r["id"], r["b"], r["weight"]) for r in with_resamples(df, ["id"], 30).collect()}
    plan = df.select(resample_weights(["id"], 30))._jdf.queryExecution().optimizedPlan().toString()
    assert "conv(" not in plan


def test_gains_are_computed_once_for_their_value(spark):
    gains = spark.range(1, 5).select(F.col("id").cast("int").alias("b"), F.col("id").cast("double").alias("gain"))
    got = V.nudge_value(gains, (0.5,), 2.0, 1.0)
    assert "Range" not in got._jdf.queryExecution().optimizedPlan().toString()
    row = got.first()
    assert (row["value"], row["p_pays"]) == (2.5, 0.75)


def test_few_subscribers_are_hashed_in_all_tasks(spark, monkeypatch):
    seen, real = [], V.with_range_bucket
    monkeypatch.setattr(V, "with_range_bucket", lambda df, keys: seen.append(df) or real(df, keys))
    df = spark.range(40).groupBy("id").agg(F.lit(1.0).alias("tenure_months"), F.lit(1).alias("churned"), F.lit("x").alias("plan"))
    V.resampled_rmst(df, 2.0, "id", 3, "s", ["plan"])
    assert "REPARTITION_BY_NUM" in seen[0]._jdf.queryExecution().executedPlan().toString()


def test_stratified_bootstrap_keeps_sizes_and_the_stratum_without_a_name(spark):
    df = spark.range(60).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("s"))
    for r in I.stratified_bootstrap(df, lambda w: F.sum(w), ["id"], ["s"], 5).collect():
        assert r["value"] == pytest.approx(60)
