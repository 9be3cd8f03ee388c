"""Experiments, uplift, double ML, geo, media, attribution and policies on hand-made tables."""

from math import comb

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyfield.operators import attribution as A
from tallyfield.operators import dml as D
from tallyfield.operators import experiments as X
from tallyfield.operators import geo as G
from tallyfield.operators import media as MM
from tallyfield.operators import policy as N
from tallyfield.operators import uplift as U


def units(spark, y, t, s=None):
    rows = [(i, float(a), int(b), float(c)) for i, (a, b, c) in enumerate(
        zip(y, t, s or [0.0] * len(y), strict=True))]
    return spark.createDataFrame(rows, "id int, spend double, treatment int, score double")


# ---- experiments --------------------------------------------------------------------------------
def test_ratio_delta(spark):
    num, den = np.array([2.0, 7, 1, 8, 2, 8]), np.array([1.0, 2, 4, 5, 9, 4])
    df = spark.createDataFrame(list(zip(num.tolist(), den.tolist(), strict=True)), "num double, den double")
    row = X.ratio_delta(df, "num", "den").first()
    ratio = num.sum() / den.sum()
    rest = num - ratio * den  # linearised: its standard error over the mean denominator
    assert row["ratio"] == pytest.approx(ratio)
    assert row["se"] == pytest.approx(rest.std(ddof=1) / np.sqrt(6) / den.mean())


def test_srm(spark):
    counts = spark.createDataFrame([(0, 720), (1, 280)], "treatment int, units int")
    row = X.srm_test(counts, {0: 0.72, 1: 0.28}).first()
    assert row["statistic"] == pytest.approx(0.0, abs=1e-20) and row["p_value"] == pytest.approx(1.0)
    off = X.srm_test(counts, {0: 0.5, 1: 0.5}).first()  # twice 220 squared over 500
    assert off["statistic"] == pytest.approx(193.6) and off["p_value"] < 1e-12
    # 21, 33, 36 against 30 each: (81 + 9 + 36) / 30 = 4.2, two degrees of freedom
    three = spark.createDataFrame([(0, 21), (1, 33), (2, 36)], "treatment int, units int")
    assert X.srm_test(three, {0: 1, 1: 1, 2: 1}).first()["p_value"] == pytest.approx(np.exp(-2.1), rel=1e-9)


def test_chi_square_tail_odd(spark):
    df = spark.createDataFrame([(7.815,)], "x double")
    assert df.select(X.chi_square_tail(F.col("x"), 3)).first()[0] == pytest.approx(0.05, abs=1e-4)


def test_lose_share_and_split(spark):
    df = units(spark, range(100), [i % 2 for i in range(100)])
    kept = X.lose_share(df, 0.1, "id")
    assert kept.count() == 95 and kept.filter("treatment = 0").count() == 50
    assert U.random_split(df, "id").filter("in_train").count() == 50


# ---- uplift ---------------------------------------------------------------------------------------
def curves_by_hand(y, t, score):
    """Qini and uplift values after each distinct score, highest first, with a leading zero."""
    y, t, score = np.array(y, float), np.array(t), np.array(score)
    x, g, f = [0.0], [0.0], [0.0]
    for level in np.unique(score)[::-1]:
        top = score >= level
        n1, n0 = (top & (t == 1)).sum(), (top & (t == 0)).sum()
        y1, y0 = y[top & (t == 1)].sum(), y[top & (t == 0)].sum()
        x.append(top.mean())
        g.append(y1 - (y0 * n1 / n0 if n0 else 0))
        f.append(((y1 / n1 if n1 else 0) - (y0 / n0 if n0 else 0)) * (n1 + n0))
    return np.array(x), np.array(g), np.array(f)


def test_uplift_curves(spark):
    y, t = [3, 0, 2, 5, 1, 0, 4], [1, 0, 1, 0, 1, 1, 0]
    score = [0.95, 0.7, 0.6, 0.55, 0.3, 0.2, 0.1]
    df = units(spark, y, t, score)
    x, g, f = curves_by_hand(y, t, score)
    assert [r["value"] for r in U.qini_curve(df).orderBy("fraction").collect()] == pytest.approx(g)
    assert [r["value"] for r in U.uplift_curve(df).orderBy("fraction").collect()] == pytest.approx(f)
    row = U.qini_coefficient(df, normalize=True).first()
    qini = np.trapezoid(g, x) - g[-1] / 2
    # the best order: treated by falling, then control by rising outcome
    order = np.lexsort([np.where(np.array(t) == 1, -np.array(y), y), -np.array(t)])
    best = np.empty(7)
    best[order] = np.arange(7, 0, -1)
    same = [best[[j for j in range(7) if (t[j], y[j]) == (t[i], y[i])]].max() for i in range(7)]
    bx, bg, _ = curves_by_hand(y, t, same)
    perfect = np.trapezoid(bg, bx) - bg[-1] / 2
    assert row["qini"] == pytest.approx(qini) and row["normalized"] == pytest.approx(qini / perfect)
    assert U.auuc(df).first()[0] == pytest.approx(np.trapezoid(f, x))
    # the best four: treated 3 and 2, control 0 and 5
    assert U.uplift_at_k(df, 0.5, "id").first()["uplift"] == pytest.approx(0.0)
    assert U.uplift_at_k(df, 1.0, "id").first()["uplift"] == pytest.approx(6 / 4 - 9 / 3)
    with pytest.raises(Exception, match="one arm"):
        U.uplift_at_k(df, 0.1, "id").collect()


def test_qini_ties(spark):
    y, t, score = [2, 1, 6, 3, 0, 1], [1, 0, 1, 1, 0, 0], [5, 5, 5, 2, 2, 2]
    rows = U.qini_curve(units(spark, y, t, score)).orderBy("fraction").collect()
    # both ties are one step: 8 - 1 * 2 / 1, then 11 - 2 * 3 / 3
    assert [(r["fraction"], r["value"]) for r in rows] == [(0, 0), (0.5, 6), (1, 9)]


def test_policy_values(spark):
    rng = np.random.default_rng(3)
    y, t = rng.uniform(0, 20, 40), rng.integers(0, 2, 40)
    cate, p = rng.normal(size=40) * 3, rng.integers(0, 2, 40)
    df = spark.createDataFrame(pd.DataFrame({"spend": y, "treatment": t, "true_cate": cate, "p": p}))
    margin, cost, share = 0.4, 0.7, 0.5
    assert U.policy_value_true(df, F.col("p"), margin, cost).first()[0] == pytest.approx(
        np.mean(p * (margin * cate - cost)))
    gain = np.where(t == 1, (margin * y - cost) / share, -margin * y / (1 - share))  # the cost falls on who was treated
    assert U.policy_value(df, F.col("p"), margin, cost).first()[0] == pytest.approx(np.mean(p * gain))
    with pytest.raises(ValueError):
        U.policy_value(df, F.col("p"), margin, cost, 1.0)


# ---- double ML ------------------------------------------------------------------------------------
def test_dml_estimates(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"y": rng.normal(size=30).round(1), "t": rng.integers(0, 2, 30),
                        "y_hat": rng.normal(size=30).round(1), "t_hat": rng.uniform(0.01, 0.99, 30).round(2)})
    df = spark.createDataFrame(pdf)

    def by_hand(d):
        ry, rt = (d["y"] - d["y_hat"]).to_numpy(), (d["t"] - d["t_hat"]).to_numpy()
        theta = rt @ ry / (rt @ rt)
        return theta, np.sqrt(((rt * (ry - theta * rt)) ** 2).sum()) / (rt @ rt)

    row = D.dml_estimate(df).first()
    assert (row["theta"], row["se"]) == pytest.approx(by_hand(pdf))
    kept = pdf[pdf["t_hat"].between(0.1, 0.9)]
    weight = pdf["t_hat"] * (1 - pdf["t_hat"])
    row = D.trimmed_estimate(df, 0.1, 0.9).first()
    assert 0 < len(kept) < 30 and row["theta"] == pytest.approx(by_hand(kept)[0])
    assert row["share_kept"] == pytest.approx(len(kept) / 30)
    assert row["weight_share_dropped"] == pytest.approx(1 - weight[kept.index].sum() / weight.sum())


def test_baseline_estimates(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"w": rng.normal(size=50)})
    pdf["t"] = (pdf["w"] + rng.normal(size=50) > 0).astype(int)
    pdf["y"] = 4 - 1.5 * pdf["t"] + 2 * pdf["w"]
    got = {r["method"]: r for r in D.baseline_estimates(spark.createDataFrame(pdf), "y", "t", ["w"]).collect()}
    a, b = pdf["y"][pdf["t"] == 1], pdf["y"][pdf["t"] == 0]
    assert got["naive"]["estimate"] == pytest.approx(a.mean() - b.mean())
    assert got["naive"]["se"] == pytest.approx(np.sqrt(a.var() / len(a) + b.var() / len(b)))
    assert got["regression"]["estimate"] == pytest.approx(-1.5)
    assert got["regression"]["se"] == pytest.approx(0, abs=1e-6)


def test_cross_fit_is_out_of_fold(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"id": range(60), "x": rng.normal(size=60), "t": rng.integers(0, 2, 60)})
    pdf["y"] = 2 * pdf["x"] + rng.normal(size=60)
    df = D.folds(spark.createDataFrame(pdf), "id", 5)
    got = D.cross_fit(df, "y", ["x"], "h").toPandas()
    for f, g in got.groupby("fold"):
        rest = got[got["fold"] != f]
        b, a = np.polyfit(rest["x"], rest["y"], 1)
        np.testing.assert_allclose(g["h"], a + b * g["x"], atol=1e-9)
    sizes = got.groupby(["t", "fold"]).size().unstack()
    assert (sizes.max(axis=1) - sizes.min(axis=1)).max() <= 1


# ---- geo and media --------------------------------------------------------------------------------------
def test_simplex_weights():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 6)) + 5
    true = np.array([0.5, 0.3, 0.2, 0, 0, 0])
    np.testing.assert_allclose(G.simplex_weights(x.T @ x, x.T @ (x @ true)), true, atol=1e-8)
    y = x @ true + rng.normal(size=40) * 0.3
    w = G.simplex_weights(x.T @ x, x.T @ y)
    assert w.min() >= 0 and w.sum() == pytest.approx(1)
    grad = x.T @ (x @ w - y)  # optimality: equal on the support, no smaller elsewhere
    level = grad[w > 1e-9]
    assert np.ptp(level) < 1e-6 and (grad[w <= 1e-9] >= level.min() - 1e-6).all()


def panel(spark, lift=1.1):
    rows = []
    rng = np.random.default_rng(9)
    base = rng.uniform(50, 150, 8)
    for p in range(60):
        common = 1 + 0.1 * np.sin(p / 5)
        for g in range(8):
            s = base[g] * common * np.exp(rng.normal() * 0.01)
            treated, post = int(g < 2), int(p >= 50)
            rows.append((f"2024-01-{1:02d}", p, f"g{g}", float(s * (lift if treated and post else 1)),
                         treated, post))
    return spark.createDataFrame(rows, "d string, p int, geo string, sales double, treated int,"
                                       " post int").withColumn(
        "date", F.date_add(F.col("d").cast("date"), F.col("p") * 7)).drop("d")


def test_placebo_windows_equal_a_plain_fit_of_each_window(spark):
    df = panel(spark).filter("not (geo = 'g4' and p = 30) and not (geo = 'g5' and p < 28)")
    pre = df.filter("post = 0").toPandas()
    wide = pre.pivot_table(index="p", columns="geo", values="sales", aggfunc="sum").fillna(0.0)
    y, got = wide[["g0", "g1"]].sum(axis=1).to_numpy(), {r["start"]: r["lift_pct"] for r in G.placebo_in_time(df, 6, 26).collect()}
    assert sorted(got) == list(range(26, 45))
    for s, lift in got.items():
        x = wide[[f"g{g}" for g in range(2, 8) if wide[f"g{g}"][:s].sum() > 0]].to_numpy()
        x = x / x[:s].mean(axis=0)
        m = y[:s].mean()
        w = G.simplex_weights(x[:s].T @ x[:s], x[:s].T @ (y[:s] / m))
        synthetic = (x @ w * m)[s:s + 6].sum()
        assert lift == pytest.approx(100 * (y[s:s + 6].sum() - synthetic) / synthetic, abs=1e-6)
    with pytest.raises(Exception, match="no sales before period"):
        G.placebo_in_time(df, 6, 26, silent_donors="error").collect()


def test_missing_cells_count_as_no_sales_or_are_an_error(spark):
    df = panel(spark)
    holed = df.filter("not (geo = 'g4' and p = 30)")
    zeros = df.withColumn("sales", F.when((F.col("geo") == "g4") & (F.col("p") == 30), 0.0).otherwise(F.col("sales")))
    a, b = ({r["unit"]: r["weight"] for r in G.sc_weights(G.unit_series(x)).collect()} for x in (holed, zeros))
    assert a == pytest.approx(b)
    assert G.unit_series(df, missing="error").count() == 7 * 60
    with pytest.raises(ValueError, match="1 cells"):
        G.unit_series(holed, missing="error")


def test_geo_readouts_find_the_lift(spark):
    df = panel(spark)
    start = df.filter("post = 1").agg(F.min("date")).first()[0]
    end = df.agg(F.max("date")).first()[0]
    assert G.did(df, start, end).first()["lift_pct"] == pytest.approx(10, abs=1)
    sc = G.synthetic_control(df).first()
    assert sc["relative_effect"] == pytest.approx(0.1, abs=0.02)
    p = G.permutation_pvalue(G.placebo_in_space(df)).first()
    assert p["p_value"] == pytest.approx(1 / 7)
    power = {r["lift"]: r["power"] for r in G.geo_power(df, [0.0, 20.0]).collect()}
    assert power[0.0] <= 0.1 and power[20.0] == 1.0


def test_window_roas_and_scorecard(spark):
    gain, spend = [2.0, 0.5, 3.5, 1.0, 6.0], [5.0, 1.0, 4.0, 2.5, 2.0]
    c = spark.createDataFrame([("a", 1, w, v) for w, v in enumerate(gain, 1)],
                              "channel string, draw int, week int, contribution double")
    s = spark.createDataFrame([("a", w, v) for w, v in enumerate(spend, 1)],
                              "channel string, week int, spend double")
    # weeks 2 to 4: 5 over 7.5
    assert MM.window_roas(c, s, {"w": (2, 4)}).first()["value"] == pytest.approx(2 / 3)


def test_contributions_are_not_multiplied_by_windows_and_fill_all_tasks(spark):
    c = spark.createDataFrame([("a", d, w, float(d * w)) for d in (1, 2) for w in range(6)],
                              "channel string, draw int, week int, contribution double")
    s = spark.createDataFrame([("a", w, 1.0) for w in range(6)], "channel string, week int, spend double")
    got = MM.window_roas(c, s, {"all": (0, 9), "late": (4, 5), "never": (50, 60)})
    assert {(r["window"], r["draw"]): r["value"] for r in got.collect()} == {
        ("all", 1): 2.5, ("all", 2): 5.0, ("late", 1): 4.5, ("late", 2): 9.0}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(") == 1  # of the spend
    from tallyfield.plans.media import contrib
    assert contrib(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_optimal_allocation_meets_its_conditions(spark):
    rows = [("s", c, b, lam, 100.0, 0.0, 300.0, 0.0) for c, b, lam in
            (("a", 50.0, 2.0), ("b", 80.0, 1.0), ("c", 10.0, 3.0))]
    df = spark.createDataFrame(rows, "scenario string, channel string, beta double, lam double,"
                                     " scale double, lower double, upper double, linear double")
    got = MM.optimal_allocation(df, 200.0).toPandas()
    assert got["spend"].sum() == pytest.approx(200, abs=1e-6)
    marginal = {}
    for _, b, lam in (("a", 50.0, 2.0), ("b", 80.0, 1.0), ("c", 10.0, 3.0)):
        c = _
        x = float(got.loc[got["channel"] == c, "spend"].iloc[0])
        if 0 < x < 300:
            marginal[c] = b * lam / 200 * (1 - np.tanh(lam * x / 200) ** 2)
    assert np.ptp(list(marginal.values())) < 1e-9
    with pytest.raises(Exception, match="bounds"):
        MM.optimal_allocation(df, 5000.0).collect()


# ---- attribution ------------------------------------------------------------------------------------------
PATHS = [("ABC", 1), ("C", 0), ("CA", 1), ("B", 0), ("BB", 1), ("AC", 0), ("CBA", 0), ("A", 1)]
TINY = [(list(p), c) for p, c in PATHS]


@pytest.fixture(scope="module")
def tiny(spark):
    return A.path_counts(spark.createDataFrame(TINY, "path array<string>, converted int"))


def credit(df):
    return {r["channel"]: r["credit"] for r in df.collect()}


def test_heuristics(spark, tiny):
    facts = A.path_facts(tiny, ["A", "B", "C", "D"])
    won = [p for p, c in PATHS if c]
    by_hand = {"last": lambda c: sum(p[-1] == c for p in won), "first": lambda c: sum(p[0] == c for p in won),
               "linear": lambda c: sum(p.count(c) / len(p) for p in won)}
    for rule, of in by_hand.items():
        got = credit(A.heuristic_credit(facts, ["A", "B", "C", "D"], rule, n="n"))
        assert got == pytest.approx({c: of(c) for c in "ABCD"})
    with pytest.raises(ValueError):
        A.heuristic_credit(facts, ["A"], "middle")
    with pytest.raises(Exception, match="not listed"):
        A.heuristic_credit(A.path_facts(tiny, ["A", "B", "C"]), ["A", "B"], "last", n="n").collect()


def absorbed(paths, gone=None):
    """P(conversion) from the start by repeated steps; ``gone`` leads to null."""
    moves = {}
    for p, c in paths:
        states = ["start", *p, "conv" if c else "null"]
        for a, b in zip(states, states[1:], strict=False):
            moves.setdefault(a, []).append(b)
    value = dict.fromkeys(moves, 0.0) | {"conv": 1.0, "null": 0.0}
    for _ in range(500):
        value |= {a: 0.0 if a == gone else np.mean([value[b] for b in to]) for a, to in moves.items()}
    return value["start"]


def test_markov(spark, tiny):
    effects = A.markov(A.transition_matrix(tiny), ["A", "B", "C"])
    rows = {r["channel"]: r for r in effects.collect()}
    whole = absorbed(PATHS)
    removal = {c: 1 - absorbed(PATHS, c) / whole for c in "ABC"}
    for c in "ABC":
        assert rows[c]["conversion_probability"] == pytest.approx(whole)
        assert rows[c]["removal_effect"] == pytest.approx(removal[c])
    total = A.converted_total(tiny, n="n")
    assert credit(A.markov_credit(effects, total)) == pytest.approx(
        {c: 4 * removal[c] / sum(removal.values()) for c in "ABC"})
    with pytest.raises(Exception, match="not listed"):
        A.markov(A.transition_matrix(tiny), ["A", "B"]).collect()


def test_touch_forms_equal_path_forms(spark):
    rng = np.random.default_rng(12)
    n = 3000
    pdf = pd.DataFrame({"j": np.where(rng.random(n) < 0.4, 0, rng.integers(1, 200, n)),
                        "event_id": range(n), "channel": rng.choice(["A", "B", "C"], n),
                        "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(
                            rng.integers(0, 86400 * 3, n), unit="s")})
    touches = spark.createDataFrame(pdf)
    bought = spark.createDataFrame([(int(j),) for j in range(0, 200, 3)], "j int")
    counts = A.path_counts(A.journeys(touches, bought, ["j"]))
    facts = A.journey_facts(touches, bought, ["j"], ["A", "B", "C"])
    a = A.transition_matrix(counts).toPandas().set_index(["s", "s2"]).sort_index()
    b = A.touch_transitions(touches, facts, ["j"]).toPandas().set_index(["s", "s2"]).sort_index()
    pd.testing.assert_frame_equal(a, b[a.columns])
    chan = ["A", "B", "C"]
    x = A.all_heuristics(facts, chan).toPandas().set_index(["method", "channel"]).sort_index()
    y = A.all_heuristics(A.path_facts(counts, chan), chan, n="n").toPandas().set_index(
        ["method", "channel"]).sort_index()
    pd.testing.assert_frame_equal(x, y)


def test_shapley(spark):
    rates = {"A": (50, 8), "B": (80, 4), "AB": (40, 10)}  # journeys and conversions of exactly these channels
    rows = [(list(k), int(i < won)) for k, (n, won) in rates.items() for i in range(n)]
    counts = A.path_counts(spark.createDataFrame(rows, "path array<string>, converted int"))
    table = A.coalition_table(A.path_facts(counts, ["A", "B"]), n="n")
    got = credit(A.shapley_credit(table, ["A", "B"]))
    # v(A) = .16, v(B) = .05, v(AB) = .25: A is worth (.16 + .20) / 2 of .25, B (.05 + .09) / 2
    assert got["A"] == pytest.approx(8 + 10 * 0.18 / 0.25)
    assert got["B"] == pytest.approx(4 + 10 * 0.07 / 0.25)
    missing = table.filter("set <> 'B'")
    with pytest.raises(Exception, match="exactly"):
        A.shapley_credit(missing, ["A", "B"]).collect()
    assert credit(A.shapley_count_based(table, ["A", "B"])) == {"A": 13.0, "B": 9.0}


def test_subset_weights(spark):
    cases = [(n, m) for n in (1, 2, 5, 21, 40) for m in range(n)]
    rows = spark.createDataFrame(cases, "n int, m int").withColumn("w", A.subset_weight(F.col("n"), F.col("m")))
    for r in rows.collect():
        assert r["w"] == pytest.approx(1 / (r["n"] * comb(r["n"] - 1, r["m"])))


def test_credit_vs_truth(spark):
    credits = {"m1": (6.0, 1.0, 3.0), "m2": (1.0, 8.0, 1.0)}
    rows = [(m, c, v) for m, vs in credits.items() for c, v in zip("ABC", vs, strict=True)]
    df = spark.createDataFrame(rows, "method string, channel string, credit double")
    truth = spark.createDataFrame([("A", 9.0), ("B", 3.0), ("C", 8.0)], "channel string, incremental double")
    got = {r["method"]: r for r in A.credit_vs_truth(df, truth).collect()}
    # true shares .45, .15, .40; gaps .15, -.05, -.10 and -.35, .65, -.30
    assert got["m1"]["tvd"] == pytest.approx(0.15) and got["m2"]["tvd"] == pytest.approx(0.65)
    assert (got["m1"]["largest_gap_channel"], got["m2"]["largest_gap_channel"]) == ("A", "B")
    assert got["m1"]["largest_gap"] == pytest.approx(0.15)


def test_resampled_totals(spark):
    counts = spark.createDataFrame([(["A"], 1, 3), (["B"], 0, 1200), (["A", "B"], 1, 80_000)],
                                   "path array<string>, converted int, n bigint")
    got = A.resampled_counts(counts, 300).groupBy("n").agg(
        F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q")).toPandas().set_index("n")
    for n in (3, 1200, 80_000):
        mean = got.loc[n, "s"] / 300
        var = got.loc[n, "q"] / 300 - mean**2
        assert mean == pytest.approx(n, abs=4 * np.sqrt(n / 300))
        assert var == pytest.approx(n, rel=0.35)


# ---- policies ----------------------------------------------------------------------------------------------
def test_forward_margin(spark):
    margins = {7: [5.0, 0.0, 2.5, 1.0], 9: [0.5, 4.0, 0.0, 3.0]}
    rows = [(u, d, v) for u, vs in margins.items() for d, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "user_id int, day int, margin double")
    got = {(r["user_id"], r["day"]): r["margin_fwd"] for r in N.forward_margin(df, 3).collect()}
    assert got == {(u, d): sum(vs[d:d + 3]) if d + 3 <= 4 else None for u, vs in margins.items() for d in range(4)}


def test_incremental_per_send(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"eligible": rng.integers(0, 2, 60), "sent": rng.integers(0, 2, 60),
                        "session": rng.integers(0, 2, 60), "margin": rng.uniform(0, 9, 60)})
    got = {r["outcome"]: r for r in N.incremental_per_send(spark.createDataFrame(pdf)).collect()}
    live = pdf[pdf["eligible"] == 1]
    for name, column in (("sessions_per_send", "session"), ("margin_per_send", "margin")):
        a, b = live[column][live["sent"] == 1], live[column][live["sent"] == 0]
        assert got[name]["estimate"] == pytest.approx(a.mean() - b.mean())
        assert got[name]["se"] == pytest.approx(np.sqrt(a.var() / len(a) + b.var() / len(b)))


def test_volume_curve(spark):
    rows = [(0, 0, 0), (2, 14, 3), (2, 10, 0), (2, 16, 7), (5, 50, 9)]
    df = spark.createDataFrame(rows, "arm int, sends int, opens int").withColumns(
        {c: F.lit(0.0) for c in ("opens_7d", "margin_7d", "margin", "opted_out")})
    got = {r["arm"]: r["open_rate"] for r in N.volume_curve(df).collect()}
    assert got[2] == pytest.approx(10 / 40) and got[5] == pytest.approx(0.18) and got[0] == 0.0


def test_q_iteration(spark):
    # three states; a send mixes two next states, a skip stays
    reward = {(0, 0): 0.2, (0, 1): 1.5, (1, 0): 0.7, (1, 1): -0.4, (2, 0): 0.0, (2, 1): 0.3}
    to = {(s, 0): {s: 1.0} for s in range(3)} | {(0, 1): {1: 0.75, 2: 0.25}, (1, 1): {0: 0.5, 2: 0.5}, (2, 1): {0: 1.0}}
    rows = [(s, a, s2, 1, p, 40, reward[s, a]) for (s, a), nxt in to.items() for s2, p in nxt.items()]
    model = spark.createDataFrame(rows, "s int, a int, s2 int, n int, p double, visits int, reward double")
    value, gamma = np.zeros(3), 0.6
    for _ in range(200):
        want = {k: reward[k] + gamma * sum(p * value[s2] for s2, p in to[k].items()) for k in to}
        value = np.array([max(want[s, 0], want[s, 1]) for s in range(3)])
    got = {(r["s"], r["a"]): r["q"] for r in N.q_iteration(model, gamma).collect()}
    assert got == {k: pytest.approx(v, abs=1e-8) for k, v in want.items()}
    with pytest.raises(RuntimeError, match="sweeps"):
        N.q_iteration(model, gamma, sweeps=3)
    q = spark.createDataFrame([(*k, v) for k, v in got.items()], "s int, a int, q double")
    policy = {r["s"]: r["action"] for r in N.greedy_policy(q, model, 30).collect()}
    assert policy == {s: int(want[s, 1] > want[s, 0]) for s in range(3)}
    untried = N.greedy_policy(q, model.withColumn("visits", F.lit(5)), 30).collect()
    assert {r["action"] for r in untried} == {0}


def test_guardrail(spark):
    df = spark.createDataFrame([("a", 10.0, 0.1), ("b", 20.0, 0.5), ("c", 12.0, 0.2)],
                               "policy string, margin double, opt_out double")
    row = N.guardrail_choice(df, 0.3).first()
    assert (row["choice"], row["best_any"], row["within"]) == ("c", "b", 2)


def test_counterfactual_spend_is_laid_out_once_for_all_draws(spark):
    spend = spark.createDataFrame([(w, "tv", float(1 + w % 3)) for w in range(6)], "week int, channel string, spend double")
    params = spark.createDataFrame([(d, "tv", 0.5, 2.0, 10.0 * d) for d in (1, 2)], "draw int, channel string, alpha double, lam double, beta double")
    got = MM.counterfactual_window_roas(spend, params, 2, 3, 3)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    x = np.array([1 + w % 3 for w in range(6)]) / 3
    cut = np.where([2 <= w <= 3 for w in range(6)], 0, x)

    def response(v):
        stock = np.array([sum(0.5**k * (v[w - k] if w >= k else 0) for k in range(3)) for w in range(6)]) / 1.75
        return (1 - np.exp(-2 * stock)) / (1 + np.exp(-2 * stock))

    lost = (response(x) - response(cut))[2:].sum() / 4  # 3 + 1 were spent inside
    assert {r["draw"]: round(r["value"], 9) for r in got.collect()} == {d: round(10 * d * lost, 9) for d in (1, 2)}
