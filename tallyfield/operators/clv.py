"""Customer lifetime value: purchase and spend models, value arithmetic, decisions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfield.functions.special import digamma, hyp2f1, lgamma, log_beta, trigamma
from tallyfield.operators.draws import hdi, mean_and_hdi
from tallyfield.operators.fitting import Derivatives, maximize
from tallyfield.operators.ordering import exact_quantiles
from tallyfield.operators.resample import resampled_sums
from tallyfield.session import cut_lineage

WEEKS_PER_MONTH = 30.4375 / 7
BGNBD_START = {"r": 1.0, "alpha": 10.0, "a": 1.0, "b": 2.0}
GAMMA_GAMMA_START = {"p": 2.0, "q": 3.0, "v": 10.0}


def _lits(params: Mapping[str, float]) -> dict[str, Column]:
    return {k: F.lit(float(v)) for k, v in params.items()}


# ---- purchase model --------------------------------------------------------------------------
def _rising(base: Column, x: Column, power: int) -> Column:
    """Over k = 0 .. x - 1: sum of ln(base + k) for power 0, of 1 / (base + k) ** power otherwise."""
    ks = F.when(x > 0, F.sequence(F.lit(0), x.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    of = (lambda k: F.log(base + k)) if power == 0 else lambda k: F.pow(base + k, -float(power))
    return F.aggregate(ks, F.lit(0.0), lambda total, k: total + of(k))


def bgnbd_model(p: dict[str, Column]) -> Derivatives:
    """One customer's log-likelihood with its derivatives.

    For whole counts the gamma and beta ratios are finite products. What is left is a mixture: still a
    customer at the end (``u``), or gone after the last purchase (``v``, repeat buyers only), with the posterior share ``w`` of the
    latter. The mixture's second derivatives are the components' means plus the variance of their first ones.
    """
    x, since, age = F.col("frequency"), F.col("recency"), F.col("T")
    r, alpha, a, b = (p[n] for n in ("r", "alpha", "a", "b"))
    repeat = x > 0
    last = F.when(repeat, b + x - 1).otherwise(F.lit(1.0))
    u = -(r + x) * F.log(alpha + age)
    v = F.log(a) - F.log(last) - (r + x) * F.log(alpha + since)
    w = F.when(repeat, 1 / (1 + F.exp(u - v))).otherwise(F.lit(0.0))
    mixed = F.when(repeat, F.greatest(u, v) + F.log1p(F.exp(-F.abs(u - v)))).otherwise(u)
    value = _rising(r, x, 0) + _rising(b, x, 0) - _rising(a + b, x, 0) + r * F.log(alpha) + mixed
    zero = F.lit(0.0)
    du = {"r": -F.log(alpha + age), "alpha": -(r + x) / (alpha + age), "a": zero, "b": zero}
    dv = {"r": -F.log(alpha + since), "alpha": -(r + x) / (alpha + since), "a": 1 / a, "b": -1 / last}
    second_u = {("r", "alpha"): -1 / (alpha + age), ("alpha", "alpha"): (r + x) / (alpha + age) ** 2}
    second_v = {("r", "alpha"): -1 / (alpha + since), ("alpha", "alpha"): (r + x) / (alpha + since) ** 2,
                ("a", "a"): -1 / a**2, ("b", "b"): 1 / last**2}
    both = _rising(a + b, x, 2)
    product_first = {"r": _rising(r, x, 1) + F.log(alpha), "alpha": r / alpha, "a": -_rising(a + b, x, 1),
                     "b": _rising(b, x, 1) - _rising(a + b, x, 1)}
    product_second = {("r", "r"): -_rising(r, x, 2), ("r", "alpha"): 1 / alpha, ("alpha", "alpha"): -r / alpha**2,
                      ("a", "a"): both, ("a", "b"): both, ("b", "b"): both - _rising(b, x, 2)}
    names = ("r", "alpha", "a", "b")
    first = {n: product_first[n] + (1 - w) * du[n] + w * dv[n] for n in names}
    second = {}
    for i, m in enumerate(names):
        for n in names[i:]:
            second[m, n] = (product_second.get((m, n), zero) + (1 - w) * second_u.get((m, n), zero)
                            + w * second_v.get((m, n), zero) + w * (1 - w) * (dv[m] - du[m]) * (dv[n] - du[n]))
    return Derivatives(value, first, second)


def bgnbd_loglik_column(p: dict[str, Column]) -> Column:
    """Log-likelihood of one customer's (frequency, recency, T)."""
    return bgnbd_model(p).value


def bgnbd_loglik(rfm: DataFrame, params: Mapping[str, float]) -> DataFrame:
    """The RFM table with each customer's log-likelihood; rows must have 0 <= recency <= T."""
    return rfm.withColumn("loglik", bgnbd_loglik_column(_lits(params)))


def check_rfm(rfm: DataFrame) -> None:
    """Raise unless there are rows, all with frequency >= 0 and 0 <= recency <= T."""
    bad = ((F.col("frequency") < 0) | (F.col("recency") < 0)
           | (F.col("recency") > F.col("T") + 1e-12))
    row = rfm.agg(F.count(F.lit(1)).alias("n"),
                  F.count_if(F.coalesce(bad, F.lit(True))).alias("bad")).first()
    if row["n"] == 0:
        raise ValueError("the RFM table has no rows")
    if row["bad"]:
        raise ValueError(f"{row['bad']} rows of the RFM table have a negative count or a recency outside [0, T]")


def bgnbd_fit(rfm: DataFrame, start: Mapping[str, float] | None = None) -> dict[str, float]:
    """Maximum likelihood over distinct (frequency, recency, T) with their counts."""
    cases = cut_lineage(rfm.groupBy("frequency", "recency", "T").agg(
        F.count(F.lit(1)).alias("n")))
    check_rfm(cases)
    start = start or BGNBD_START
    return maximize(cases, "n", ["r", "alpha", "a", "b"], start, bgnbd_model)


def bgnbd_p_alive(rfm: DataFrame, params: Mapping[str, float]) -> DataFrame:
    """Probability that the customer still buys at the end of the observation."""
    p = _lits(params)
    x, tx, t = F.col("frequency"), F.col("recency"), F.col("T")
    odds = F.when(x > 0, p["a"] / (p["b"] + x - 1) * F.pow(
        (p["alpha"] + t) / (p["alpha"] + tx), p["r"] + x)).otherwise(0.0)
    return rfm.withColumn("p_alive", 1.0 / (1.0 + odds))


def bgnbd_expected_purchases(rfm: DataFrame, params: Mapping[str, float],
                             horizon: float) -> DataFrame:
    """Expected repeat purchases of each customer over the next ``horizon`` time units."""
    p = _lits(params)
    r, alpha, a, b = p["r"], p["alpha"], p["a"], p["b"]
    x, t = F.col("frequency"), F.col("T")
    later = alpha + t + float(horizon)
    series = hyp2f1(r + x, b + x, a + b + x - 1, F.lit(float(horizon)) / later)
    decline = F.pow((alpha + t) / later, r + x) * series
    scored = bgnbd_p_alive(rfm, params)
    gain = (a + b + x - 1) / (a - 1) * (1 - decline)
    return scored.withColumn("expected_purchases", gain * F.col("p_alive"))


def bgnbd_expected_new(times: DataFrame, params: Mapping[str, float], t: str = "t") -> DataFrame:
    """Expected repeat purchases of a new customer in the first ``t`` time units."""
    p = _lits(params)
    r, alpha, a, b = p["r"], p["alpha"], p["a"], p["b"]
    at = F.col(t)
    series = hyp2f1(r, b, a + b - 1, at / (alpha + at))
    return times.withColumn("expected_purchases", (a + b - 1) / (a - 1)
                            * (1 - F.pow(alpha / (alpha + at), r) * series))


def pnbd_expected_new(times: DataFrame, r: float, alpha: float, s: float, beta: float,
                      t: str = "t") -> DataFrame:
    """Closed form for a new Pareto/NBD customer; s = 1 is the logarithmic case."""
    at = F.col(t)
    if abs(s - 1.0) < 1e-8:
        value = F.lit(r / alpha * beta) * F.log1p(at / beta)
    else:
        value = F.lit(r / alpha * beta / (s - 1)) * (1 - F.pow(beta / (beta + at), s - 1))
    return times.withColumn("expected_purchases", value)


# ---- spend model ---------------------------------------------------------------------------------
def gamma_gamma_model(p: dict[str, Column]) -> Derivatives:
    """One repeat buyer's log-likelihood of the mean spend z over x repeats, with its derivatives.

    y = x z / (x z + v) has a Beta(p x, q) distribution, so the log density of z is that of y plus the log of
    dy / dz = y (1 - y) / z.
    """
    x, z = F.col("frequency"), F.col("monetary_value")
    m, q, v = p["p"] * x, p["q"], p["v"]
    pool = x * z + v
    log_y, log_rest = F.log(x * z / pool), F.log(v / pool)
    value = m * log_y + q * log_rest - F.log(z) - log_beta(m, q)
    top, top2 = digamma(m + q), trigamma(m + q)
    first = {"p": x * (log_y + top - digamma(m)), "q": log_rest + top - digamma(q), "v": (q * x * z / v - m) / pool}
    second = {("p", "p"): x * x * (top2 - trigamma(m)), ("p", "q"): x * top2, ("q", "q"): top2 - trigamma(q),
              ("p", "v"): -x / pool, ("q", "v"): x * z / (v * pool), ("v", "v"): (m + q) / pool**2 - q / v**2}
    return Derivatives(value, first, second)


def gamma_gamma_loglik_column(p: dict[str, Column]) -> Column:
    return gamma_gamma_model(p).value


def check_repeat_spend(rfm: DataFrame) -> None:
    """Raise unless every row is a repeat buyer with a positive mean spend."""
    row = rfm.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("frequency") <= 0).alias("x"),
                  F.count_if(F.col("monetary_value") <= 0).alias("z")).first()
    if row["n"] == 0 or row["x"] or row["z"]:
        raise ValueError(f"the spend model needs repeat buyers with positive spend: {row['n']} rows,"
                         f" {row['x']} without a repeat, {row['z']} without positive spend")


def gamma_gamma_loglik(rfm: DataFrame, params: Mapping[str, float]) -> DataFrame:
    """Log-likelihood of each repeat buyer's mean spend."""
    return rfm.withColumn("loglik", gamma_gamma_loglik_column(_lits(params)))


def gamma_gamma_fit(rfm: DataFrame, start: Mapping[str, float] | None = None) -> dict[str, float]:
    """Maximum likelihood on repeat buyers; the table is written once and scanned per step."""
    cases = cut_lineage(rfm.groupBy("frequency", "monetary_value").agg(
        F.count(F.lit(1)).alias("n")))
    check_repeat_spend(cases)
    start = start or GAMMA_GAMMA_START
    return maximize(cases, "n", ["p", "q", "v"], start, gamma_gamma_model)


def gamma_gamma_expected_spend(rfm: DataFrame, params: Mapping[str, float]) -> DataFrame:
    """Own mean spend shrunk to the population mean p v / (q - 1)."""
    p, q, v = (float(params[k]) for k in ("p", "q", "v"))
    px = F.lit(p) * F.col("frequency")
    w = px / (px + (q - 1))
    return rfm.withColumn("expected_spend",
                          (1 - w) * (p * v / (q - 1)) + w * F.col("monetary_value"))


def revenue_scores(rfm: DataFrame, bg: Mapping[str, float], gg: Mapping[str, float],
                   horizon: float) -> DataFrame:
    """Expected purchases times expected spend per customer."""
    scored = gamma_gamma_expected_spend(bgnbd_expected_purchases(rfm, bg, horizon), gg)
    return scored.withColumn("score", F.col("expected_purchases") * F.col("expected_spend"))


# ---- decisions on scores -----------------------------------------------------------------------
def closest_to_bar(scores: DataFrame, gain: str, bar: float, k: int,
                   customer: str = "customer_id") -> DataFrame:
    """The k largest gains above the bar and the k listed customers closest to it."""
    listed = scores.filter(F.col(gain) > bar).select(customer, gain)
    top = listed.orderBy(F.col(gain).desc(), customer).limit(k).withColumn(
        "list", F.lit("largest"))
    near = listed.orderBy(gain, customer).limit(k).withColumn("list", F.lit("closest"))
    return top.unionByName(near)


def retarget_table(scores: DataFrame, response_rates: Sequence[float], contact_cost: float = 0.5,
                   margin: float = 20.0, p: str = "p_alive") -> DataFrame:
    """Per assumed response rate: whom to stop contacting, what that saves and gives up."""
    cells = []
    for u in response_rates:
        tau = contact_cost / (margin * u)
        stop = F.col(p) < tau
        cells.append(F.struct(
            F.lit(u).alias("response_rate"), F.lit(tau).alias("threshold"),
            F.count_if(stop).alias("stopped"), F.avg(stop.cast("double")).alias("share"),
            (F.count_if(stop) * contact_cost).alias("cost_saved"),
            (F.coalesce(F.sum(F.when(stop, F.col(p))), F.lit(0.0)) * (margin * u))
            .alias("margin_given_up")))
    return scores.agg(F.array(*cells).alias("r")).select(F.inline("r"))


def breakeven_lift(cost: float, margin: str, expected: str) -> Column:
    """Lift at which a contact pays for itself."""
    return F.lit(float(cost)) / (F.col(margin) * F.col(expected))


def campaign_table(lifts: DataFrame, segment: str = "segment", lift: str = "lift") -> DataFrame:
    """Per segment: size, median break-even lift, customers below 5, 10 and 20 percent."""
    counts = lifts.groupBy(segment).agg(
        F.count(F.lit(1)).alias("customers"), F.count_if(F.col(lift) < 0.05).alias("below_5pct"),
        F.count_if(F.col(lift) < 0.10).alias("below_10pct"),
        F.count_if(F.col(lift) < 0.20).alias("below_20pct"))
    return counts.join(exact_quantiles(lifts, lift, {"median_lift": 0.5}, [segment]), segment,
                       "left")


def holdout_comparison(scored: DataFrame, predicted: str = "expected_purchases",
                       actual: str = "holdout_purchases", top: int = 7) -> DataFrame:
    """Actual and predicted mean by frequency 0..top, the last group open-ended."""
    group = F.least(F.col("frequency").cast("int"), F.lit(top))
    label = F.when(group == top, F.concat(group.cast("string"), F.lit("+"))).otherwise(
        group.cast("string"))
    return scored.groupBy(label.alias("group")).agg(
        F.count(F.lit(1)).alias("customers"), F.avg(actual).alias("actual"),
        F.avg(predicted).alias("predicted"))


def holdout_scorecard(predictions: DataFrame, actual: str = "actual",
                      predicted: str = "predicted") -> DataFrame:
    """MAE, RMSE and summed bias by method and group (long predictions)."""
    e = F.col(predicted) - F.col(actual)
    return predictions.groupBy("method", "group").agg(
        F.count(F.lit(1)).alias("customers"), F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e).alias("bias"))


def mae_difference_bootstrap(errors: DataFrame, a: str, b: str, key: str = "customer_id",
                             resamples: int = 200, salt: str = "mae") -> DataFrame:
    """Bootstrap draws of MAE(a) - MAE(b) over customers (Poisson weights)."""
    gap = F.abs(F.col(a)) - F.abs(F.col(b))
    sums = resampled_sums(errors, {"total": gap, "size": F.lit(1)}, [key], resamples, salt)
    return sums.select("b", F.try_divide("total", "size").alias("value"))


def gbt_forecast(design: DataFrame, features: Sequence[str], target: str = "target",
                 rounds: int = 20, depth: int = 3, seed: int = 7) -> DataFrame:
    """Boosted trees trained on the train split, predicted on the holdout (squared loss)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    data = VectorAssembler(inputCols=list(features), outputCol="_features").transform(design)
    model = GBTRegressor(featuresCol="_features", labelCol=target, predictionCol="predicted",
                         maxIter=rounds, maxDepth=depth, seed=seed)
    fitted = model.fit(cut_lineage(data.filter("split = 'train'")))
    return fitted.transform(data.filter("split = 'holdout'")).drop("_features")


# ---- value from monthly forecasts ----------------------------------------------------------------
def purchases_in_month(cumulative: DataFrame, keys: Sequence[str], month: str = "month",
                       value: str = "cumulative") -> DataFrame:
    """Monthly increments of a cumulative forecast; the first month counts from 0.

    Groups are (draw, customer) paths of at most the forecast's months.
    """
    w = W.partitionBy(*keys).orderBy(month)
    return cumulative.withColumn("in_month", F.col(value) - F.coalesce(F.lag(value).over(w),
                                                                       F.lit(0.0)))


def discounted_clv(by_month: DataFrame, keys: Sequence[str], monthly_rate: float,
                   spend: str = "spend", month: str = "month") -> DataFrame:
    """Sum over months of spend times purchases, discounted by (1 + rate)^month."""
    factor = F.pow(F.lit(1.0 + monthly_rate), F.col(month))
    return by_month.groupBy(*keys).agg(
        F.sum(F.col("in_month") * F.col(spend) / factor).alias("clv"))


def clv_grid(by_month: DataFrame, horizons: Sequence[int], rates: Sequence[float],
             spend: str = "spend", month: str = "month", draw: str = "draw",
             prob: float = 0.94) -> DataFrame:
    """Total value, mean and interval over draws, for each horizon and discount rate.

    All cells are summed in one aggregate per draw, then unfolded to rows.
    """
    cells = []
    for h in horizons:
        for d in rates:
            flow = F.col("in_month") * F.col(spend) / F.pow(F.lit(1.0 + d), F.col(month))
            cells.append(F.struct(
                F.lit(h).alias("horizon_months"), F.lit(float(d)).alias("monthly_rate"),
                F.coalesce(F.sum(F.when(F.col(month) <= h, flow)), F.lit(0.0)).alias("value")))
    totals = by_month.groupBy(draw).agg(F.array(*cells).alias("c")).select(
        draw, F.inline("c"))
    return mean_and_hdi(totals, ["horizon_months", "monthly_rate"], prob, draw=draw)


def new_customer_value(cumulative: DataFrame, keys: Sequence[str], monthly_rate: float,
                       margin: float, first: bool = True, spend: str = "spend") -> DataFrame:
    """Margin of the first purchase plus discounted repeat purchases per channel (and draw)."""
    steps = purchases_in_month(cumulative, keys).filter(F.col("month") > 0)
    flow = F.sum(F.col("in_month") / F.pow(F.lit(1.0 + monthly_rate), F.col("month")))
    return steps.groupBy(*keys).agg(
        (F.lit(margin) * F.max(spend) * (flow + (1.0 if first else 0.0))).alias("value"))


def cac_cap(values: DataFrame, channel: str = "channel", q: float | None = 0.2,
            value: str = "value") -> DataFrame:
    """Highest acquisition cost per channel: the mean of the draws or their q-quantile."""
    if q is None:
        return values.groupBy(channel).agg(F.avg(value).alias("cac_cap"))
    return exact_quantiles(values, value, {"cac_cap": q}, [channel])


def p_value_above_cac(values: DataFrame, cac: Mapping[str, float], channel: str = "channel",
                      value: str = "value") -> DataFrame:
    """Share of draws whose value exceeds the channel's current acquisition cost."""
    table = F.create_map(*[F.lit(x) for pair in cac.items() for x in pair])
    above = (F.col(value) > table[F.col(channel)]).cast("double")
    return values.groupBy(channel).agg(F.avg(above).alias("p_above_cac"))


def segment_value(draws: DataFrame, segment: str = "segment", draw: str = "draw",
                  value: str = "value", prob: float = 0.94) -> DataFrame:
    """Per segment: customers, total and mean value with intervals over draws."""
    per = draws.groupBy(segment, draw).agg(F.count(F.lit(1)).alias("customers"),
                                           F.sum(value).alias("total"), F.avg(value).alias("mean"))
    out = per.groupBy(segment).agg(F.max("customers").alias("customers"),
                                   F.avg("total").alias("total_mean"),
                                   F.avg("mean").alias("per_customer_mean"))
    for col, low, high in (("total", "total_low", "total_high"),
                           ("mean", "per_customer_low", "per_customer_high")):
        ends = hdi(per, [segment], prob, col, draw).withColumnsRenamed(
            {"hdi_low": low, "hdi_high": high})
        out = out.join(ends, segment)
    return out


def prob_greater(draws: DataFrame, a: str, b: str, segment: str = "segment", draw: str = "draw",
                 value: str = "value") -> DataFrame:
    """Share of draws in which segment a's mean exceeds segment b's."""
    per = draws.groupBy(draw).agg(F.avg(F.when(F.col(segment) == a, F.col(value))).alias("a"),
                                  F.avg(F.when(F.col(segment) == b, F.col(value))).alias("b"))
    return per.agg(F.avg((F.col("a") > F.col("b")).cast("double")).alias("p_greater"))


def clv_by_channel(scores: DataFrame, channel: str = "channel", value: str = "clv") -> DataFrame:
    """Total value per channel and over all."""
    rows = scores.rollup(channel).agg(F.grouping(channel).alias("_all"), F.sum(value).alias("clv"),
                                      F.count(F.lit(1)).alias("customers"))
    return rows.withColumn(channel, F.when(F.col("_all") == 1, "all").otherwise(F.col(channel))
                           ).drop("_all")


def true_expected_revenue(df: DataFrame, weeks: float, rate: str = "lam", drop: str = "mu",
                          alive: str = "alive", spend: str = "mean_spend") -> DataFrame:
    """Expected spend over the next weeks when rate and dropout rate are known."""
    mu = F.col(drop)
    span = F.when(mu > 0, -F.expm1(-mu * weeks) / F.nullif(mu, F.lit(0.0))).otherwise(
        F.lit(float(weeks)))
    return df.withColumn("expected_revenue", F.col(alive) * F.col(spend) * F.col(rate) * span)


# ---- contractual retention -------------------------------------------------------------------------
def counts_to_customers(survivors: DataFrame, cohort: str = "cohort", year: str = "year",
                        alive: str = "alive") -> DataFrame:
    """One row per customer from survivor counts: the year of leaving, or n + 1 if still there.

    The curve has one row per cohort and year; the customers of one row are unfolded in blocks, so a
    large cohort is spread over tasks.
    """
    w = W.partitionBy(cohort)
    last = F.max(year).over(w)
    left = F.col(alive) - F.coalesce(F.lead(alive).over(w.orderBy(year)), F.lit(0))
    rows = survivors.select(cohort, (F.col(year) + 1).alias("recency"), (last + 1).alias("T"),
                            left.alias("n")).filter("n > 0")
    block = 100_000
    blocks = rows.withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block))))
    size = F.least(F.lit(block), F.col("n") - F.col("_b") * block)
    return (blocks.repartition(F.col("_b"), F.col("recency"))
            .select(cohort, "recency", "T",
                    F.explode(F.sequence(F.lit(1), size.cast("int"))).alias("_i"))
            .drop("_i"))


def sbg_survival(times: DataFrame, alpha: float, beta: float, t: str = "t") -> DataFrame:
    """Survival and retention rate of the shifted beta-geometric at whole periods."""
    def curve(at: Column) -> Column:
        top = lgamma(F.lit(beta) + at) - lgamma(F.lit(alpha + beta) + at)
        base = lgamma(F.lit(float(beta))) - lgamma(F.lit(float(alpha + beta)))
        return F.exp(top - base)

    at = F.col(t).cast("double")
    return times.withColumn("survival", curve(at)).withColumn(
        "retention", F.when(at > 0, (F.lit(beta - 1.0) + at) / (F.lit(alpha + beta - 1.0) + at)))


def sbg_model(p: dict[str, Column]) -> Derivatives:
    """One customer's log-likelihood: survived ``recency`` - 1 periods, then left in the next one unless recency = T."""
    a, b, s = p["alpha"], p["beta"], F.col("recency") - 1
    both = a + b
    gone = (F.col("recency") < F.col("T")).cast("double")
    last = both + s
    value = _rising(b, s, 0) - _rising(both, s, 0) + gone * (F.log(a) - F.log(last))
    out, bend = _rising(both, s, 1) + gone / last, _rising(both, s, 2) + gone / last**2
    return Derivatives(value, {"alpha": gone / a - out, "beta": _rising(b, s, 1) - out},
                       {("alpha", "alpha"): bend - gone / a**2, ("alpha", "beta"): bend, ("beta", "beta"): bend - _rising(b, s, 2)})


def sbg_fit(customers: DataFrame, start: Mapping[str, float] | None = None) -> dict[str, float]:
    """Fit alpha and beta to (recency, T) rows; recency = T means still a customer."""
    cases = cut_lineage(customers.groupBy("recency", "T").agg(F.count(F.lit(1)).alias("n")))
    return maximize(cases, "n", ["alpha", "beta"], start or {"alpha": 1.0, "beta": 1.5}, sbg_model)
