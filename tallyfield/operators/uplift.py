"""Uplift curves, targeting rules and policy values.

Rows are first added up per distinct score, so ties are one group as they must be; the running sums
then go through range buckets. Areas need the previous point of a curve, which is the running sum less
the row's own counts: no second ordered pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.uniform import uniform
from tallyfield.operators.ordering import average_rank, cumulate, exact_quantiles, ranked
from tallyfield.session import cut_lineage


def one_hot_features(df: DataFrame, numeric: Sequence[str],
                     levels: dict[str, Sequence[str]]) -> DataFrame:
    """Numeric columns as doubles and a 0/1 column per listed level (the reference is left out)."""
    dummies = [F.coalesce(F.col(c) == v, F.lit(False)).cast("double").alias(f"{c}_{v.lower()}")
               for c, vs in levels.items() for v in vs]
    rest = [c for c in df.columns if c not in numeric and c not in levels]
    return df.select(*rest, *[F.col(c).cast("double").alias(c) for c in numeric], *dummies)


def random_split(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Exactly half of the rows train, by the order of a seeded hash."""
    keys = df.select(key).withColumn("_u", uniform(f"split{seed}", key))
    order = ranked(keys, ["_u", key], name="_rank")
    size = order.agg(F.floor(F.max("_rank") / 2).alias("h")).scalar()
    sides = order.withColumn("_half", size).select(
        key, (F.col("_rank") <= F.col("_half")).alias("in_train"))
    return df.join(sides, key)


def uplift_learners(train: DataFrame, score: DataFrame, features: Sequence[str],
                    y: str = "spend", t: str = "treatment", rounds: int = 10,
                    depth: int = 3, propensity: float = 0.5) -> DataFrame:
    """Effect predictions of the S-, T- and X-learner with boosted trees."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    def fit(rows: DataFrame, cols: Sequence[str], label: str, out: str):
        data = VectorAssembler(inputCols=list(cols), outputCol="_x").transform(rows)
        model = GBTRegressor(featuresCol="_x", labelCol=label, predictionCol=out, maxIter=rounds,
                             maxDepth=depth, seed=7).fit(data)
        return lambda df: model.transform(VectorAssembler(
            inputCols=list(cols), outputCol="_x").transform(df)).drop("_x")

    train = cut_lineage(train.withColumn("_t", F.col(t).cast("double")))
    treated, control = train.filter("_t = 1"), train.filter("_t = 0")
    mu1, mu0 = fit(treated, features, y, "_m1"), fit(control, features, y, "_m0")
    single = fit(train, [*features, "_t"], y, "_s")
    gain1 = fit(mu0(treated).withColumn("_d", F.col(y) - F.col("_m0")), features, "_d", "_x1")
    gain0 = fit(mu1(control).withColumn("_d", F.col("_m1") - F.col(y)), features, "_d", "_x0")
    out = gain0(gain1(mu0(mu1(score))))
    out = single(out.withColumn("_t", F.lit(1.0))).withColumnRenamed("_s", "_s1")
    out = single(out.withColumn("_t", F.lit(0.0))).withColumnRenamed("_s", "_s0")
    return out.withColumns({
        "s_learner": F.col("_s1") - F.col("_s0"), "t_learner": F.col("_m1") - F.col("_m0"),
        "x_learner": propensity * F.col("_x0") + (1 - propensity) * F.col("_x1")}).drop(
        "_t", "_s1", "_s0", "_m1", "_m0", "_x1", "_x0")


# ---- curves ----------------------------------------------------------------------------------------
_SUMS = ("n_t", "n_c", "y_t", "y_c")


def cumulative_by_score(df: DataFrame, y: str = "spend", t: str = "treatment",
                        score: str = "score", by: Sequence[str] = (),
                        leading_zero: bool = True) -> DataFrame:
    """Counts and outcomes of both arms after each group of equal scores, highest first.

    A struct as score gives the order itself, its fields ascending. The own counts of the group stay as ``d_*`` columns; a leading all-zero row is optional.
    """
    by = list(by)
    yy = F.col(y).cast("double")
    per = df.groupBy(*by, score).agg(
        F.count_if(F.col(t) == 1).alias("d_n_t"), F.count_if(F.col(t) == 0).alias("d_n_c"),
        F.coalesce(F.sum(F.when(F.col(t) == 1, yy)), F.lit(0.0)).alias("d_y_t"),
        F.coalesce(F.sum(F.when(F.col(t) == 0, yy)), F.lit(0.0)).alias("d_y_c"))
    falling = F.col(score) if dict(per.dtypes)[score].startswith("struct") else -F.col(score)
    run = cumulate(per.withColumn("_order", falling), ["_order"],
                   {c: f"d_{c}" for c in _SUMS}, by).drop("_order")
    if not leading_zero:
        return run
    head = run.select(*by).distinct() if by else df.sparkSession.range(1).select()
    zero = head.select(*by, F.lit(None).cast("double").alias(score),
                       *[F.lit(0).alias(c) for c in ("n_t", "n_c")],
                       *[F.lit(0.0).alias(c) for c in ("y_t", "y_c")])
    return run.unionByName(zero, allowMissingColumns=True)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0)))


def qini_value(n_t: Column, n_c: Column, y_t: Column, y_c: Column) -> Column:
    return y_t - y_c * _ratio(n_t, n_c)


def uplift_value(n_t: Column, n_c: Column, y_t: Column, y_c: Column) -> Column:
    return (_ratio(y_t, n_t) - _ratio(y_c, n_c)) * (n_t + n_c)


def _curve(df: DataFrame, y: str, t: str, score: str, by: Sequence[str], value) -> DataFrame:
    run = cumulative_by_score(df, y, t, score, by)
    at = value(*[F.col(c) for c in _SUMS])
    size = run.groupBy(*by).agg(F.max(F.col("n_t") + F.col("n_c")).alias("_size"))
    run = run.join(size, list(by)) if by else run.withColumn("_size", size.scalar())
    return run.select(*by, score, ((F.col("n_t") + F.col("n_c")) / F.col("_size"))
                      .alias("fraction"), at.alias("value"))


def qini_curve(df: DataFrame, y: str = "spend", t: str = "treatment", score: str = "score",
               by: Sequence[str] = ()) -> DataFrame:
    """Incremental outcome against the fraction targeted."""
    return _curve(df, y, t, score, by, qini_value)


def uplift_curve(df: DataFrame, y: str = "spend", t: str = "treatment", score: str = "score",
                 by: Sequence[str] = ()) -> DataFrame:
    """Difference of arm means times the number targeted, against the fraction targeted."""
    return _curve(df, y, t, score, by, uplift_value)


def _area(df: DataFrame, y: str, t: str, score: str, by: Sequence[str], value) -> DataFrame:
    """Trapezoid area under a curve and the curve's last value, per group."""
    run = cumulative_by_score(df, y, t, score, by, leading_zero=False)
    now = value(*[F.col(c) for c in _SUMS])
    before = value(*[F.col(c) - F.col(f"d_{c}") for c in _SUMS])
    width = F.col("d_n_t") + F.col("d_n_c")
    everyone = F.sum(width)
    last = F.max_by(now, F.col("n_t") + F.col("n_c"))
    return run.groupBy(*by).agg((F.sum(width * (now + before) / 2.0) / everyone).alias("area"),
                                last.alias("last"))


def qini_coefficient(df: DataFrame, y: str = "spend", t: str = "treatment", score: str = "score",
                     by: Sequence[str] = (), normalize: bool = False) -> DataFrame:
    """Area between the Qini curve and the random line, optionally over the perfect order's area."""
    by = list(by)
    out = _area(df, y, t, score, by, qini_value).select(
        *by, (F.col("area") - F.col("last") / 2).alias("qini"))
    if not normalize:
        return out
    # the best order there is: treated rows first, larger outcomes first; then control rows, smaller outcomes first
    arm = (F.col(t) == 1).cast("int")
    best = df.withColumn("_perfect", F.struct(-arm, F.when(arm == 1, -F.col(y)).otherwise(F.col(y))))
    ideal = _area(best, y, t, "_perfect", by, qini_value).select(
        *by, (F.col("area") - F.col("last") / 2).alias("perfect"))
    both = out.join(ideal, by) if by else out.withColumn(
        "perfect", ideal.select("perfect").scalar())
    return both.withColumn("normalized", F.try_divide("qini", "perfect"))


def auuc(df: DataFrame, y: str = "spend", t: str = "treatment", score: str = "score",
         by: Sequence[str] = (), subtract_random: bool = False) -> DataFrame:
    """Area under the uplift curve over the fraction targeted."""
    a = _area(df, y, t, score, by, uplift_value)
    value = F.col("area") - F.col("last") / 2 if subtract_random else F.col("area")
    return a.select(*by, value.alias("auuc"))


def uplift_at_k(df: DataFrame, k: float, key: str, y: str = "spend", t: str = "treatment",
                score: str = "score") -> DataFrame:
    """Difference of arm means among the top ceil(k n) by score; ties in key order.

    One arm only in the top is an error.
    """
    if not 0 < k <= 1:
        raise ValueError("k is a fraction in (0, 1]")
    rows = df.select(key, y, t, (-F.col(score)).alias("_o"))
    order = ranked(rows, ["_o", key], name="_rank")
    size = order.agg(F.ceil(F.max("_rank") * F.lit(float(k))).alias("m")).scalar()
    top = order.withColumn("_m", size).filter("_rank <= _m")
    one = top.agg(F.avg(F.when(F.col(t) == 1, F.col(y))).alias("m1"),
                  F.avg(F.when(F.col(t) == 0, F.col(y))).alias("m0"),
                  F.count(F.lit(1)).alias("targeted"))
    gap = F.when(F.col("m1").isNull() | F.col("m0").isNull(), F.raise_error(
        F.lit("the top k holds only one arm; use a larger k"))).otherwise(
        F.col("m1") - F.col("m0"))
    return one.select("targeted", gap.alias("uplift"))


def qini_table(scores: DataFrame, y: str = "spend", t: str = "treatment",
               model: str = "model") -> DataFrame:
    """Qini coefficient per model (long scores)."""
    return qini_coefficient(scores, y, t, "score", [model])


NOISE_CELLS = 1024


def qini_noise_band(df: DataFrame, key: str, repeats: int = 200, prob: float = 0.99,
                    y: str = "spend", t: str = "treatment") -> DataFrame:
    """The band random scores fall into: a quantile of their absolute Qini coefficients.

    Random scores have NOISE_CELLS values. Rows of equal score count as one group anyway, so a repeat shrinks to that
    many rows in the tasks that read the log, and only those are ordered.
    """
    rows = df.select(key, y, t, F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("rep"))
    random = rows.withColumn("score", F.floor(uniform("noise", key, "rep") * NOISE_CELLS))
    q = qini_coefficient(random, y, t, "score", ["rep"]).withColumn("size", F.abs("qini"))
    return exact_quantiles(q, "size", {"band": prob})


# ---- rules and policy values ------------------------------------------------------------------------
def targeting_rule(cate: str, margin: float, cost: float) -> Column:
    """Treat when the predicted effect is worth more than it costs."""
    return (F.col(cate) * margin > cost).cast("int")


def _propensity(e: float | str) -> Column:
    if isinstance(e, str):
        c = F.col(e)
        return F.when((c > 0) & (c < 1), c).otherwise(F.raise_error(
            F.lit("the propensity must lie strictly between 0 and 1")))
    if not 0 < e < 1:
        raise ValueError("the propensity must lie strictly between 0 and 1")
    return F.lit(float(e))


def policy_value(df: DataFrame, policy: Column, margin: float, cost: float,
                 propensity: float | str = 0.5, y: str = "spend",
                 t: str = "treatment") -> DataFrame:
    """Inverse-propensity estimate of profit per customer, relative to treating nobody."""
    e = _propensity(propensity)
    term = F.when(F.col(t) == 1, (margin * F.col(y) - cost) / e).otherwise(
        -margin * F.col(y) / (1 - e))
    return df.agg(F.avg(policy.cast("double") * term).alias("value"))


def policy_value_true(df: DataFrame, policy: Column, margin: float, cost: float,
                      cate: str = "true_cate") -> DataFrame:
    """The same from known effects."""
    return df.agg(F.avg(policy.cast("double") * (margin * F.col(cate) - cost)).alias("value"))


def targeting_profit(df: DataFrame, margin: float, cost: float, cate: str = "score",
                     truth: str = "true_cate") -> DataFrame:
    """Share targeted, profit the model expects and profit by the true effects."""
    send = targeting_rule(cate, margin, cost)
    return df.agg(F.avg(send.cast("double")).alias("share_targeted"),
                  F.avg(send * (margin * F.col(cate) - cost)).alias("expected_profit"),
                  F.avg(send * (margin * F.col(truth) - cost)).alias("true_profit"))


def targeting_profit_test(df: DataFrame, send: Column, margin: float, cost: float,
                          y: str = "spend", t: str = "treatment", prob: float = 0.94) -> DataFrame:
    """Profit per customer of a targeting list, estimated from the randomized test alone."""
    z = NormalDist().inv_cdf(0.5 + prob / 2)
    cells = [F.avg(send.cast("double")).alias("share")]
    for arm in (1, 0):
        v = F.when(send & (F.col(t) == arm), F.col(y))
        cells += [F.avg(v).alias(f"m{arm}"), F.var_samp(v).alias(f"v{arm}"),
                  F.count(v).alias(f"n{arm}")]
    one = df.agg(*cells)
    est = F.col("share") * (margin * (F.col("m1") - F.col("m0")) - cost)
    se = F.col("share") * margin * F.sqrt(F.try_divide("v1", "n1") + F.try_divide("v0", "n0"))
    nobody = F.col("share") == 0
    return one.select("share", *[F.when(nobody, 0.0).otherwise(c).alias(n) for n, c in (
        ("estimate", est), ("lo", est - z * se), ("hi", est + z * se))])


def cate_accuracy(scores: DataFrame, truth: str = "true_cate", model: str = "model") -> DataFrame:
    """RMSE and Spearman correlation of effect estimates per model."""
    a = average_rank(scores, "score", "_r1", [model])
    b = average_rank(a, truth, "_r2", [model])
    gap = F.col("score") - F.col(truth)
    return b.groupBy(model).agg(F.sqrt(F.avg(gap * gap)).alias("rmse"),
                                F.corr("_r1", "_r2").alias("spearman"))


def aipw_column(y: str, t: str, mu1: str, mu0: str, e: Column) -> Column:
    """Doubly robust score of one unit."""
    return (F.col(mu1) - F.col(mu0) + F.col(t) * (F.col(y) - F.col(mu1)) / e
            - (1 - F.col(t)) * (F.col(y) - F.col(mu0)) / (1 - e))


def aipw_scores(df: DataFrame, e: float | str = 0.5, y: str = "spend", t: str = "treatment",
                mu1: str = "mu1", mu0: str = "mu0") -> DataFrame:
    return df.withColumn("gamma", aipw_column(y, t, mu1, mu0, _propensity(e)))


def policy_comparison(scores: DataFrame, rules: dict[str, Column], margin: float, cost: float,
                      against: str, per: float = 1000.0, gamma: str = "gamma") -> DataFrame:
    """Profit of each rule, and of each rule less the rule ``against``, with 95% intervals."""
    profit = margin * F.col(gamma) - cost
    terms = {name: rule.cast("double") * profit for name, rule in rules.items()}
    for name in rules:
        if name != against:
            terms[f"{name} minus {against}"] = terms[name] - terms[against]
    n = F.count(F.lit(1))
    cells = [F.struct(F.lit(k).alias("rule"), (per * F.avg(v)).alias("mean"),
                      (per * F.stddev_samp(v) / F.sqrt(n)).alias("se")) for k, v in terms.items()]
    rows = scores.agg(F.array(*cells).alias("c")).select(F.inline("c"))
    return rows.select("rule", "mean", (F.col("mean") - 1.96 * F.col("se")).alias("lo"),
                       (F.col("mean") + 1.96 * F.col("se")).alias("hi"))


def _toc_groups(scores: DataFrame, gamma: str, priority: str) -> DataFrame:
    per = scores.groupBy(priority).agg(F.sum(gamma).alias("_g"), F.count(F.lit(1)).alias("_m"))
    return cumulate(per.withColumn("_o", -F.col(priority)), ["_o"], {"_sum": "_g", "_cnt": "_m"})


def toc_rate(scores: DataFrame, gamma: str = "gamma", priority: str = "priority") -> DataFrame:
    """Rank-weighted average effect with weight q on TOC(q); tied units share their mean score.

    A tie group's units are summed in closed form.
    """
    run = _toc_groups(scores, gamma, priority)
    overall = scores.agg(F.struct(F.avg(gamma).alias("ate"), F.count(F.lit(1)).alias("n")).alias("s"))
    m, n = F.col("_m"), F.col("_all.n")
    before, seen = F.col("_sum") - F.col("_g"), F.col("_cnt") - m
    tops = m * before + F.col("_g") / m * m * (m + 1) / 2
    ranks = m * seen + m * (m + 1) / 2
    return run.withColumn("_all", overall.scalar()).agg(
        F.max("_all.ate").alias("ate"),
        (F.sum((tops - ranks * F.col("_all.ate")) / n) / F.max(n)).alias("rate"))


def toc_curve(scores: DataFrame, points: int = 10, gamma: str = "gamma",
              priority: str = "priority") -> DataFrame:
    """TOC at q = 1/points, ..., 1: mean score of the top ceil(q n) less the overall mean."""
    run = _toc_groups(scores, gamma, priority)
    overall = scores.agg(F.struct(F.avg(gamma).alias("ate"), F.count(F.lit(1)).alias("n")).alias("s"))
    marks = F.transform(F.sequence(F.lit(1), F.lit(points)), lambda i: F.struct(
        i.alias("point"), F.ceil(F.col("_all.n") * i / points).alias("i")))
    seen = F.col("_cnt") - F.col("_m")
    at = run.withColumn("_all", overall.scalar()).withColumn("_k", F.explode(F.filter(
        marks, lambda k: (k["i"] > seen) & (k["i"] <= F.col("_cnt")))))
    i = F.col("_k.i")
    top = F.col("_sum") - F.col("_g") + (i - seen) * F.col("_g") / F.col("_m")
    return at.select((F.col("_k.point") / points).alias("q"), (top / i - F.col("_all.ate"))
                     .alias("toc"))
