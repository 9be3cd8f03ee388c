"""Tenure, Kaplan-Meier curves, restricted means, Cox regression.

Durations are counted per distinct time first. What is ordered afterwards has one row per distinct
time (and group), and goes through range buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfield.functions.special import erfc
from tallyfield.operators.ordering import cumulate, exact_quantiles, with_range_bucket
from tallyfield.operators.resample import by_resample, in_all_tasks, resample_weights, sum_each
from tallyfield.session import cut_lineage

DAYS_PER_MONTH = 30.4375


def tenure_and_churn(subs: DataFrame, end, start: str = "start_date",
                     cancel: str = "cancel_date") -> DataFrame:
    """Months from start to cancellation or the end of observation, and the churn flag."""
    stop = F.coalesce(F.col(cancel), F.lit(str(end)).cast("date"))
    return subs.withColumns({
        "tenure_months": F.datediff(stop, F.col(start)) / DAYS_PER_MONTH,
        "churned": F.col(cancel).isNotNull().cast("int")})


def plan_indicators(subs: DataFrame, plan: str = "plan",
                    levels: Sequence[str] = ("standard", "premium")) -> DataFrame:
    """0/1 columns per plan; the one not listed is the reference."""
    return subs.withColumns({f"plan_{v}": (F.col(plan) == v).cast("int") for v in levels})


def share_onboarded(subs: DataFrame, plan: str = "plan", onboarded: str = "onboarded") -> DataFrame:
    return subs.groupBy(plan).agg(F.avg(F.col(onboarded).cast("double")).alias("share_onboarded"),
                                  F.count(F.lit(1)).alias("subscribers"))


# ---- Kaplan-Meier --------------------------------------------------------------------------------
def time_counts(df: DataFrame, duration: str = "tenure_months", event: str = "churned",
                by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Events and leavers per distinct time, written out once."""
    w = F.col(weight) if weight else F.lit(1)
    return cut_lineage(df.groupBy(*by, F.col(duration).alias("t")).agg(
        F.sum(F.when(F.col(event) == 1, w).otherwise(0)).alias("d"), F.sum(w).alias("leaving")))


def life_table(df: DataFrame, duration: str = "tenure_months", event: str = "churned",
               by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Per time: events d, at risk n (ties and those censored at t included), and S around t.

    ``before`` and ``survival`` are S just before and just after t; ``greenwood`` is the running sum
    of d / (n (n - d)).
    """
    return life_table_of(time_counts(df, duration, event, by, weight), by)


def life_table_of(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The life table of written time counts."""
    by = list(by)
    risk = cumulate(counts.withColumn("_down", -F.col("t")), ["_down"], {"n": "leaving"}, by)
    died = risk.filter("d > 0").select(*by, "t", "d", "n")
    alive = F.greatest(F.col("n") - F.col("d"), F.lit(0))
    gone = alive <= F.col("n") * 1e-12
    steps = died.withColumns({
        "_log": F.when(~gone, F.log(alive / F.col("n"))).otherwise(0.0),
        "_end": gone.cast("int"),
        "_v": F.when(~gone, F.col("d") / (F.col("n") * alive)).otherwise(0.0)})
    run = cumulate(steps, ["t"], {"_logs": "_log", "_ends": "_end", "greenwood": "_v"}, by)

    def curve(logs: Column, ends: Column) -> Column:
        return F.when(ends > 0, 0.0).otherwise(F.exp(logs))

    return run.select(
        *by, "t", "d", "n", curve(F.col("_logs"), F.col("_ends")).alias("survival"),
        curve(F.col("_logs") - F.col("_log"), F.col("_ends") - F.col("_end")).alias("before"),
        "greenwood")


def kaplan_meier(df: DataFrame, duration: str = "tenure_months", event: str = "churned",
                 by: Sequence[str] = ()) -> DataFrame:
    """S just after each time with at least one event."""
    return life_table(df, duration, event, by).select(*by, "t", "survival")


def km_interval(table: DataFrame, times: Sequence[float], alpha: float = 0.05,
                by: Sequence[str] = ()) -> DataFrame:
    """S and its pointwise interval at the chosen times (log-log form with Greenwood's variance).

    The value at a time is that of the latest event at or before it; before the first event there is
    no row.
    """
    z = NormalDist().inv_cdf(1 - alpha / 2)
    marks = F.filter(F.array(*[F.lit(float(x)) for x in times]), lambda x: x >= F.col("t"))
    rows = table.withColumn("time", F.explode(marks)).groupBy(*by, "time").agg(
        F.max_by(F.struct("survival", "greenwood"), "t").alias("k"))
    s, v = F.col("k.survival"), F.col("k.greenwood")
    inside = (s > 0) & (s < 1)
    width = z * F.sqrt(v) / F.log(F.when(inside, s))
    return rows.select(*by, "time", s.alias("survival"),
                       F.when(inside, F.pow(s, F.exp(-width))).otherwise(s).alias("lower"),
                       F.when(inside, F.pow(s, F.exp(width))).otherwise(s).alias("upper"))


def expected_periods(curve: DataFrame, horizon: int, period: str = "period",
                     survival: str = "survival", by: Sequence[str] = ()) -> DataFrame:
    """S(0) + ... + S(horizon - 1); a shorter curve is an error."""
    rows = curve.filter((F.col(period) >= 0) & (F.col(period) < horizon)).groupBy(*by).agg(
        F.sum(survival).alias("s"), F.countDistinct(period).alias("n"))
    enough = F.when(F.col("n") == horizon, F.col("s")).otherwise(F.raise_error(F.concat(
        F.lit(f"the curve is too short for a horizon of {horizon}; periods known: "),
        F.col("n").cast("string"))))
    return rows.select(*by, enough.alias("expected_periods"))


def restricted_mean(table: DataFrame, horizon: float, by: Sequence[str] = ()) -> DataFrame:
    """Area under the step curve: each drop at t <= horizon takes away drop x (horizon - t)."""
    drop = F.when(F.col("t") <= horizon, (F.col("before") - F.col("survival"))
                  * (horizon - F.col("t"))).otherwise(0.0)
    return table.groupBy(*by).agg((F.lit(float(horizon)) - F.sum(drop)).alias("rmst"))


def rmst(df: DataFrame, horizon: float, duration: str = "tenure_months", event: str = "churned",
         by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Restricted mean survival time; a group without any event gets the whole horizon."""
    by = list(by)
    counts = time_counts(df, duration, event, by, weight)
    area = restricted_mean(life_table_of(counts, by), horizon, by)
    if not by:
        return area.select(F.coalesce("rmst", F.lit(float(horizon))).alias("rmst"))
    return counts.select(*by).distinct().join(area, by, "left").withColumn(
        "rmst", F.coalesce("rmst", F.lit(float(horizon))))


def target_weights(subs: DataFrame, plan: str = "plan", onboarded: str = "onboarded") -> DataFrame:
    """Plan shares of the target population: the subscribers who did not onboard."""
    target = subs.filter(F.col(onboarded) == 0)
    size = target.agg(F.count(F.lit(1)).alias("n")).scalar()
    return target.groupBy(plan).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_all", size).select(plan, (F.col("_n") / F.col("_all")).alias("weight"))


def rmst_by_plan(subs: DataFrame, horizon: float, weights: DataFrame | Mapping[str, float],
                 plan: str = "plan", onboarded: str = "onboarded",
                 by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Restricted means onboarded and not, their difference and its weighted part, per plan."""
    by = list(by)
    if not isinstance(weights, DataFrame):
        if abs(sum(weights.values()) - 1) >= 1e-9:
            raise ValueError(f"plan shares add up to {sum(weights.values()):.6g} instead of 1")
        weights = subs.sparkSession.createDataFrame(list(weights.items()),
                                                    f"{plan} string, weight double")
    area = rmst(subs, horizon, by=[*by, plan, onboarded], weight=weight)
    return _plan_gaps(area, weights, by, plan, onboarded)


def _plan_gaps(area: DataFrame, weights: DataFrame, by: Sequence[str], plan: str, onboarded: str) -> DataFrame:
    wide = area.groupBy(*by, plan).agg(
        F.max(F.when(F.col(onboarded) == 1, F.col("rmst"))).alias("rmst_onboarded"),
        F.max(F.when(F.col(onboarded) == 0, F.col("rmst"))).alias("rmst_not"))
    gap = F.col("rmst_onboarded") - F.col("rmst_not")
    return wide.join(weights, plan).select(
        *by, plan, "rmst_onboarded", "rmst_not", gap.alias("difference"), "weight",
        (F.col("weight") * gap).alias("weighted"))


def rmst_gain(subs: DataFrame, horizon: float, weights: DataFrame | Mapping[str, float],
              **columns) -> DataFrame:
    """Plan-weighted gain in restricted mean from onboarding."""
    table = rmst_by_plan(subs, horizon, weights, **columns)
    by = list(columns.get("by", ()))
    return table.groupBy(*by).agg(F.sum("weighted").alias("gain"))


def rmst_bootstrap(subs: DataFrame, horizon: float, weights: DataFrame | Mapping[str, float],
                   key: str = "customer_id", resamples: int = 200,
                   salt: str = "rmst") -> DataFrame:
    """Bootstrap draws (b, gain). Plan and onboarding cells are the strata; a Kaplan-Meier curve does
    not change when a cell's weights are rescaled, so Poisson weights need no correction here."""
    if not isinstance(weights, DataFrame):
        weights = subs.sparkSession.createDataFrame(list(weights.items()), "plan string, weight double")
    area = resampled_rmst(subs, horizon, key, resamples, salt, ["plan", "onboarded"])
    return _plan_gaps(area, weights, ["b"], "plan", "onboarded").groupBy("b").agg(F.sum("weighted").alias("gain"))


def resampled_rmst(df: DataFrame, horizon: float, key: str, resamples: int, salt: str, by: Sequence[str],
                   duration: str = "tenure_months", event: str = "churned") -> DataFrame:
    """Restricted mean of every resample and group (``by``, b, rmst); a group that a resample does not draw has no row.

    Leavers and events of all resamples are arrays beside each distinct time, so nothing is multiplied by the number of
    resamples before it is summed. The times are dealt to range partitions once; each partition's curves run from the
    numbers at risk behind it and give its factor and its area, and these few rows are chained.
    """
    by = list(by)
    gone = F.when(F.col(event) == 1, 1).otherwise(0)
    # subscribers are few bytes but many digests each: dealt to all tasks, which Spark would not do by their size
    rows = in_all_tasks(df.select(*by, key, F.col(duration).cast("double").alias("t"), gone.alias("_e")), F.xxhash64(key)).select(
        *by, "t", "_e", resample_weights([key], resamples, salt).alias("_w"))
    times = rows.groupBy(*by, "t").agg(sum_each(F.col("_w"), resamples).alias("leaving"),
                                       sum_each(F.col("_w"), resamples, F.col("_e")).alias("d"))
    dealt = with_range_bucket(times, [*by, "t"])
    left = by_resample(dealt.groupBy(*by, "_bucket").agg(sum_each(F.col("leaving"), resamples).alias("n")), ["n"], [*by, "_bucket"])
    later = W.partitionBy(*by, "b").orderBy(F.desc("_bucket")).rowsBetween(W.unboundedPreceding, -1)
    behind = left.withColumn("_behind", F.coalesce(F.sum("n").over(later), F.lit(0)))
    offsets = behind.groupBy(*by, "_bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "_behind"))),
                                                             lambda x: x["_behind"]).alias("_behind"))
    same = F.col("_bucket") == F.col("_part")
    for c in by:  # a group may be named by null
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    named = offsets.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_bucket").alias("_part"), "_behind")
    whole = dealt.join(named, same).drop(*[f"_of_{c}" for c in by], "_part")

    def curves(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        d, out = np.stack(pdf["d"]).astype(float), np.stack(pdf["leaving"]).astype(float)
        risk = pdf["_behind"].iloc[0] + np.cumsum(out[::-1], 0)[::-1]
        alive = np.maximum(risk - d, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(d > 0, np.where(alive <= risk * 1e-12, 0.0, alive / risk), 1.0)
        after = np.cumprod(step, 0)
        before = np.vstack([np.ones((1, d.shape[1])), after[:-1]])
        t = pdf["t"].to_numpy()[:, None]
        lost = np.where(t <= horizon, (before - after) * (horizon - t), 0.0).sum(0)
        head = {c: [pdf[c].iloc[0]] * d.shape[1] for c in [*by, "_bucket"]}
        return pd.DataFrame({**head, "b": np.arange(1, d.shape[1] + 1), "factor": after[-1], "lost": lost, "drawn": out.sum(0)})

    kinds = dict(dealt.dtypes)
    pieces = cut_lineage(whole.groupBy(*by, "_bucket").applyInPandas(
        curves, ", ".join(f"{c} {kinds[c]}" for c in [*by, "_bucket"]) + ", b int, factor double, lost double, drawn double"))
    earlier = W.partitionBy(*by, "b").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    # a factor of 0 ends the curve: logs of the others, and whether one came before
    start = F.when(F.coalesce(F.min("factor").over(earlier), F.lit(1.0)) > 0, F.exp(F.coalesce(F.sum(
        F.when(F.col("factor") > 0, F.log("factor")).otherwise(0.0)).over(earlier), F.lit(0.0)))).otherwise(0.0)
    return (pieces.withColumn("_start", start).groupBy(*by, "b")
            .agg((F.lit(float(horizon)) - F.sum(F.col("_start") * F.col("lost"))).alias("rmst"), F.sum("drawn").alias("_drawn"))
            .filter("_drawn > 0").drop("_drawn"))


# ---- splits and rates ------------------------------------------------------------------------------
def landmark_split(subs: DataFrame, landmark: float) -> DataFrame:
    """Both halves of a landmark analysis in one table, told apart by ``part``.

    before: everyone, followed to the landmark; after: those still at risk, the clock restarted.
    """
    late = F.col("tenure_months") > landmark
    before = subs.withColumns({
        "churned": F.when(late, 0).otherwise(F.col("churned")),
        "tenure_months": F.least("tenure_months", F.lit(float(landmark)))})
    after = subs.filter(late).withColumn("tenure_months", F.col("tenure_months") - landmark)
    return before.withColumn("part", F.lit("before")).unionByName(
        after.withColumn("part", F.lit("after")))


def monthly_churn(subs: DataFrame, months: int = 24, by: str = "intro_offer") -> DataFrame:
    """Cancellations in month k over subscribers active at its start, for k = 1..months.

    Every month is a pair of conditional counts in one pass; months without anyone active stay, with
    no rate.
    """
    t, gone = F.col("tenure_months"), F.col("churned") == 1
    cells = [F.struct(F.lit(k).alias("month"), F.count_if(t > k - 1).alias("active"),
                      F.count_if((t > k - 1) & (t <= k) & gone).alias("cancellations"))
             for k in range(1, months + 1)]
    rows = subs.groupBy(by).agg(F.array(*cells).alias("c")).select(by, F.inline("c"))
    return rows.withColumn("rate", F.try_divide("cancellations", "active"))


def dashboard_rates(subs: DataFrame, months: float = 12.0) -> DataFrame:
    """Two retention rates that ignore censoring; nobody of known status is an error."""
    out = (F.col("churned") == 1) & (F.col("tenure_months") <= months)
    beyond = F.col("tenure_months") > months
    one = subs.agg((1 - F.avg(out.cast("double"))).alias("all_subscribers"),
                   F.count_if(out | beyond).alias("known"), F.count_if(beyond).alias("beyond"))
    share = F.when(F.col("known") > 0, F.col("beyond") / F.nullif("known", F.lit(0))).otherwise(
        F.raise_error(F.lit("no subscriber's status is known at that time")))
    return one.select("all_subscribers", share.alias("known_status"))


# ---- Cox regression -----------------------------------------------------------------------------------
BLOCK = 100_000


def _risk_sums(cells: DataFrame, xs: Sequence[str], beta: np.ndarray) -> DataFrame:
    """Per event time: risk-set sums (s*) and the sums of those who leave by event (e*)."""
    k = len(xs)
    score = F.lit(0.0)
    for x, b in zip(xs, beta, strict=True):
        score = score + F.col(x) * float(b)
    r = F.exp(score) * F.col("count")
    died = F.col("event") == 1
    terms = {"0": r}
    for i in range(k):
        terms[f"1_{i}"] = r * F.col(xs[i])
        for j in range(i, k):
            terms[f"2_{i}_{j}"] = r * F.col(xs[i]) * F.col(xs[j])
    aggs = [F.sum(v).alias(f"l{n}") for n, v in terms.items()]
    aggs += [F.sum(F.when(died, v).otherwise(0.0)).alias(f"e{n}") for n, v in terms.items()]
    aggs += [F.sum(F.when(died, F.col("count")).otherwise(0)).alias("d"),
             F.sum(F.when(died, F.col("count") * score).otherwise(0.0)).alias("xb")]
    aggs += [F.sum(F.when(died, F.col("count") * F.col(x)).otherwise(0.0)).alias(f"x{i}")
             for i, x in enumerate(xs)]
    per = cells.groupBy("t").agg(*aggs).withColumn("_down", -F.col("t"))
    return cumulate(per, ["_down"], {f"s{n}": f"l{n}" for n in terms}).filter("d > 0")


def _efron(sums: DataFrame, k: int) -> DataFrame:
    """Log-likelihood, gradient and information with Efron's treatment of ties.

    Each of the d events of a tied time sees the risk set less a share l / d of the tied events; the
    events of one time are unfolded in blocks, so a time with very many does not need one long row.
    """
    blocks = sums.withColumn("_b", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.floor((F.col("d") - 1) / BLOCK))))
    size = F.least(F.lit(BLOCK).cast("bigint"), F.col("d") - F.col("_b") * BLOCK)
    rows = blocks.withColumn("_l", F.explode(F.sequence(F.lit(0).cast("bigint"), size - 1)))
    share = (F.col("_b") * BLOCK + F.col("_l")) / F.col("d")

    def left(n: str) -> Column:
        return F.col(f"s{n}") - share * F.col(f"e{n}")

    d = F.col("d")
    phi = left("0")
    aggs = [F.sum(F.col("xb") / d - F.log(phi)).alias("ll"), F.sum(F.lit(1.0)).alias("events")]
    for i in range(k):
        mi = left(f"1_{i}") / phi
        aggs.append(F.sum(F.col(f"x{i}") / d - mi).alias(f"g{i}"))
        for j in range(i, k):
            mj = left(f"1_{j}") / phi
            aggs.append(F.sum(left(f"2_{i}_{j}") / phi - mi * mj).alias(f"h{i}_{j}"))
    return rows.agg(*aggs)


def _cox_cells(df: DataFrame, xs: Sequence[str], duration: str, event: str) -> DataFrame:
    """Rows with equal time, event and covariates counted together, written out once."""
    return cut_lineage(df.groupBy(
        F.col(duration).alias("t"), F.col(event).cast("int").alias("event"),
        *[F.col(x).cast("double").alias(x) for x in xs]).agg(F.count(F.lit(1)).alias("count")))


def _cox_newton(cells: DataFrame, xs: Sequence[str], steps: int = 30):
    k = len(xs)

    def at(beta: np.ndarray):
        row = _efron(_risk_sums(cells, xs, beta), k).first()
        grad = np.array([row[f"g{i}"] for i in range(k)])
        info = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                info[i, j] = info[j, i] = row[f"h{i}_{j}"]
        return row["ll"], grad, info

    beta = np.zeros(k)
    ll, grad, info = at(beta)
    for _ in range(steps):
        step = np.linalg.solve(info, grad)
        scale = 1.0
        while True:
            new = at(beta + scale * step)
            if new[0] >= ll - 1e-9 * abs(ll) or scale < 1e-3:
                break
            scale /= 2
        beta = beta + scale * step
        ll, grad, info = new
        if np.max(np.abs(scale * step)) < 1e-8:
            return beta, np.linalg.inv(info), ll
    raise RuntimeError(f"the Cox fit did not settle within {steps} steps")


def cox_fit(df: DataFrame, covariates: Sequence[str], alpha: float = 0.05,
            duration: str = "tenure_months", event: str = "churned") -> DataFrame:
    """Hazard ratios with Wald intervals. Newton's method; each step is one distributed pass."""
    beta, cov, _ = _cox_newton(_cox_cells(df, covariates, duration, event), covariates)
    z = NormalDist().inv_cdf(1 - alpha / 2)
    se = np.sqrt(np.diag(cov))
    rows = [(x, float(b), float(s), float(np.exp(b)), float(np.exp(b - z * s)),
             float(np.exp(b + z * s))) for x, b, s in zip(covariates, beta, se, strict=True)]
    return df.sparkSession.createDataFrame(
        rows, "covariate string, coef double, se double, hr double, lower double, upper double")


def ph_test(df: DataFrame, covariates: Sequence[str], duration: str = "tenure_months",
            event: str = "churned") -> DataFrame:
    """Test of proportional hazards: scaled Schoenfeld residuals against the rank of the event time.

    Tied events share the mean of their ranks and the risk-set mean of their time.
    """
    k = len(covariates)
    cells = _cox_cells(df, covariates, duration, event)
    beta, cov, _ = _cox_newton(cells, covariates)
    sums = _risk_sums(cells, covariates, beta)
    resid = [(F.col(f"x{i}") - F.col("d") * F.col(f"s1_{i}") / F.col("s0")).alias(f"r{i}")
             for i in range(k)]
    ranked = cumulate(sums.select("t", "d", *resid), ["t"], {"cum": "d"})
    g = F.col("cum") - (F.col("d") - 1) / 2.0
    one = ranked.agg(
        F.sum("d").alias("n"), F.sum(g * F.col("d")).alias("sg"),
        F.sum(g * g * F.col("d")).alias("sgg"),
        *[F.sum(F.col(f"r{i}")).alias(f"r{i}") for i in range(k)],
        *[F.sum(g * F.col(f"r{i}")).alias(f"gr{i}") for i in range(k)]).first()
    n = float(one["n"])
    mean = one["sg"] / n
    spread = one["sgg"] - n * mean * mean
    crossed = np.array([one[f"gr{i}"] - mean * one[f"r{i}"] for i in range(k)])
    scaled = n * (cov @ crossed)
    stat = scaled**2 / (n * np.diag(cov) * spread)
    rows = [(x, float(s)) for x, s in zip(covariates, stat, strict=True)]
    out = df.sparkSession.createDataFrame(rows, "covariate string, statistic double")
    return out.withColumn("p_value", erfc(F.sqrt(F.col("statistic") / 2)))


# ---- decision -----------------------------------------------------------------------------------------
def nudge_value(gains: DataFrame, q_grid: Sequence[float], margin: float, cost: float,
                value: str = "gain", prob: float = 0.95) -> DataFrame:
    """Per success probability q: value of a call with its interval, share of resamples that pay,
    and the break-even q with its interval."""
    lo, hi = (1 - prob) / 2, (1 + prob) / 2
    gains = cut_lineage(gains)  # read three times
    # a resample without any gain pays at no success probability
    draws = gains.withColumn("_need", F.when(F.col(value) == 0, F.lit(float("inf"))).otherwise(
        F.lit(cost) / F.nullif(F.col(value) * margin, F.lit(0.0))))
    ends = exact_quantiles(draws, value, {"lo": lo, "hi": hi})
    need = exact_quantiles(draws, "_need", {"q_lo": lo, "q_hi": hi})
    cells = [F.struct(F.lit(float(q)).alias("q"), F.avg(
        (q * margin * F.col(value) > cost).cast("double")).alias("p_pays")) for q in q_grid]
    rows = draws.agg(F.avg(value).alias("mean"), F.array(*cells).alias("c")).select(
        "mean", F.inline("c"))
    both = rows.withColumn("_e", ends.select(F.struct("lo", "hi")).scalar()).withColumn(
        "_q", need.select(F.struct("q_lo", "q_hi")).scalar())
    unit = F.col("q") * margin
    return both.select("q", (unit * F.col("mean")).alias("value"),
                       (unit * F.col("_e.lo")).alias("lo"), (unit * F.col("_e.hi")).alias("hi"),
                       "p_pays", F.col("_q.q_lo").alias("breakeven_lo"),
                       F.col("_q.q_hi").alias("breakeven_hi"))
