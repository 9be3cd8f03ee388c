"""Media mix: transforms of weekly spend, summaries of posterior draws, budget decisions.

Spend is long (week, channel, spend). Weeks and channels are few; what grows is the number of draws,
series, candidates or scenarios, and every operator is parallel in those.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfield.operators.draws import hdi, mean_and_hdi, verdict
from tallyfield.operators.linear import moment_columns, moment_matrix, ols
from tallyfield.operators.ordering import exact_quantiles
from tallyfield.session import cut_lineage


# ---- transforms -----------------------------------------------------------------------------------
def adstock_column(spend: str, alpha: Column, window, l_max: int = 8,
                   normalize: bool = True) -> Column:
    """Finite lag-weighted sum over an ordered window; nothing happened before the first row."""
    return adstock_of(past_values(spend, window, l_max), alpha, normalize)


def past_values(spend: str, window, l_max: int = 8) -> list[Column]:
    """The value of a row and of the ``l_max - 1`` rows before it, 0 before the first."""
    return [F.col(spend)] + [F.coalesce(F.lag(spend, lag).over(window), F.lit(0.0)) for lag in range(1, l_max)]


def adstock_of(past: Sequence[Column], alpha: Column, normalize: bool = True) -> Column:
    """Sum of past values, the latest first, weighted by powers of ``alpha``."""
    total, weights = F.lit(0.0), F.lit(0.0)
    for lag, value in enumerate(past):
        w = F.pow(alpha, F.lit(float(lag)))
        total = total + w * value
        weights = weights + w
    return total / weights if normalize else total


def geometric_adstock(weekly: DataFrame, alpha: float | Column, keys: Sequence[str] = ("channel",),
                      week: str = "week", spend: str = "spend", l_max: int = 8,
                      normalize: bool = True) -> DataFrame:
    """Carry spend over to later weeks within each series of ``keys``."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    window = W.partitionBy(*keys).orderBy(week)
    return weekly.withColumn("adstock", adstock_column(spend, a, window, l_max, normalize))


def logistic_saturation(x: Column, lam: Column) -> Column:
    e = F.exp(-lam * x)
    return (1 - e) / (1 + e)


def response_curve(spend: Column, beta: Column, lam: Column, scale: Column) -> Column:
    """Weekly response to constant weekly spend."""
    return beta * logistic_saturation(spend / scale, lam)


def marginal_roas(spend: Column, curve: Callable[[Column], Column], eps: float = 1.0) -> Column:
    """Central difference of a response curve."""
    return (curve(spend + eps) - curve(spend - eps)) / (2 * eps)


def spend_share_scale(weekly: DataFrame, channel: str = "channel",
                      spend: str = "spend") -> DataFrame:
    """Prior scale per channel: number of channels times its share of total spend."""
    totals = weekly.groupBy(channel).agg(F.sum(spend).alias("total"))
    everything = W.partitionBy()
    return totals.select(channel, "total", (
        F.count(F.lit(1)).over(everything) * F.col("total") / F.sum("total").over(everything))
        .alias("scale"))


# ---- summaries of draws ---------------------------------------------------------------------------
def roas_draws(contrib: DataFrame, spend: DataFrame) -> DataFrame:
    """ROAS per draw and channel: summed contribution over summed spend."""
    cost = spend.groupBy("channel").agg(F.sum("spend").alias("cost"))
    return (contrib.groupBy("draw", "channel").agg(F.sum("contribution").alias("c"))
            .join(cost, "channel").select("draw", "channel", (F.col("c") / F.col("cost"))
                                          .alias("value")))


def roas_table(draws: DataFrame, truth: DataFrame, break_even: float = 1.0,
               prob: float = 0.94) -> DataFrame:
    """Mean, interval, truth, relative bias, coverage and P(above break-even) per channel."""
    above = draws.groupBy("channel").agg(
        F.avg((F.col("value") > break_even).cast("double")).alias("p_above"))
    t = mean_and_hdi(draws, ["channel"], prob).join(above, "channel").join(truth, "channel")
    return t.select("channel", "mean", "hdi_low", "hdi_high", "truth", "p_above",
                    ((F.col("mean") - F.col("truth")) / F.col("truth")).alias("rel_bias"),
                    F.col("truth").between(F.col("hdi_low"), F.col("hdi_high")).alias("covered"))


def contribution_share(contrib: DataFrame, prob: float = 0.94) -> DataFrame:
    """Each channel's share of a draw's total contribution: mean and interval over draws."""
    per = contrib.groupBy("draw", "channel").agg(F.sum("contribution").alias("c"))
    share = per.withColumn("value", F.col("c") / F.sum("c").over(W.partitionBy("draw")))
    return mean_and_hdi(share, ["channel"], prob)


def with_windows(df: DataFrame, windows: Mapping[str, tuple], at: str = "week") -> DataFrame:
    """Each row once per named window it falls into (both ends included)."""
    cells = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
                      for n, (lo, hi) in windows.items()])
    inside = F.filter(cells, lambda w: F.col(at).between(w["lo"], w["hi"]))
    return df.select("*", F.explode(F.transform(inside, lambda w: w["name"])).alias("window"))


def window_roas(contrib: DataFrame, spend: DataFrame, windows: Mapping[str, tuple]) -> DataFrame:
    """ROAS draws (window, channel, draw, value) of named windows.

    A window is a conditional sum of one pass: the rows of contributions are not multiplied by the windows they fall into.
    """
    cost = with_windows(spend, windows).groupBy("window", "channel").agg(
        F.sum("spend").alias("cost"))
    cells = []
    for name, (lo, hi) in windows.items():
        inside = F.col("week").between(lo, hi)
        cells.append(F.struct(F.lit(name).alias("window"), F.count_if(inside).alias("n"),
                              F.sum(F.when(inside, F.col("contribution"))).alias("c")))
    sales = contrib.groupBy("channel", "draw").agg(F.array(*cells).alias("_cells")).select(
        "channel", "draw", F.inline("_cells")).filter("n > 0")
    return sales.join(cost, ["window", "channel"]).select(
        "window", "channel", "draw", (F.col("c") / F.col("cost")).alias("value"))


def counterfactual_window_roas(spend: DataFrame, params: DataFrame, start: int, end: int,
                               l_max: int = 8) -> DataFrame:
    """ROAS of a window by removing its spend: carry-in stays, carry-over counts to the end.

    ``params`` has draw, channel, alpha, lam, beta, one row per draw and channel; spend is scaled by each channel's maximum.
    Past spend is laid beside the weeks of a channel once, so the draws are neither shuffled nor sorted by week.
    """
    inside = F.col("week").between(start, end)
    top = F.max("spend").over(W.partitionBy("channel"))
    weekly = spend.withColumn("_x", F.col("spend") / top).withColumn(
        "_cut", F.when(inside, 0.0).otherwise(F.col("_x")))
    cost = spend.filter(inside).groupBy("channel").agg(F.sum("spend").alias("cost"))
    w = W.partitionBy("channel").orderBy("week")
    laid = cut_lineage(weekly.select("channel", "week", *[F.array(*past_values(c, w, l_max)).alias(c) for c in ("_x", "_cut")])
                       .filter(F.col("week") >= start))
    a, lam = F.col("alpha"), F.col("lam")

    def response(column: str) -> Column:
        return logistic_saturation(adstock_of([F.get(column, F.lit(i)) for i in range(l_max)], a), lam)

    lost = params.join(laid, "channel").withColumn("_d", F.col("beta") * (response("_x") - response("_cut")))
    return lost.groupBy("draw", "channel").agg(F.sum("_d").alias("c")).join(cost, "channel").select(
        "draw", "channel", (F.col("c") / F.col("cost")).alias("value"))


def residual_spend_corr(resid: DataFrame, spend: DataFrame, weeks_per_year: int = 52) -> DataFrame:
    """Correlation of residuals with each channel's spend within each year."""
    both = spend.join(resid, "week").withColumn("year", F.floor(F.col("week") / weeks_per_year))
    return both.groupBy("year", "channel").agg(F.corr("residual", "spend").alias("correlation"))


def drift_ratio(paths: DataFrame, early: tuple, late: tuple, value: str = "value") -> DataFrame:
    """Late mean over early mean per draw and channel."""
    def mean(span: tuple) -> Column:
        return F.avg(F.when(F.col("week").between(*span), F.col(value)))

    return paths.groupBy("draw", "channel").agg((mean(late) / mean(early)).alias("value"))


def baseline_comparison(draws: DataFrame, truth: DataFrame, prob: float = 0.94) -> DataFrame:
    """Per channel and baseline: mean, interval, truth, absolute error, coverage."""
    t = mean_and_hdi(draws, ["channel", "baseline"], prob).join(truth, "channel")
    return t.withColumns({
        "abs_error": F.abs(F.col("mean") - F.col("truth")),
        "covered": F.col("truth").between(F.col("hdi_low"), F.col("hdi_high"))})


def calibration_effect(before: DataFrame, after: DataFrame) -> DataFrame:
    """How calibration moved the mean, the interval width and the coverage (two ROAS tables)."""
    def side(t: DataFrame, tag: str) -> DataFrame:
        return t.select("channel", F.col("mean").alias(f"mean_{tag}"),
                        (F.col("hdi_high") - F.col("hdi_low")).alias(f"width_{tag}"),
                        F.col("covered").alias(f"covered_{tag}"))

    return side(before, "before").join(side(after, "after"), "channel").withColumn(
        "shift", F.col("mean_after") - F.col("mean_before"))


def cv_scorecard(pred: DataFrame) -> DataFrame:
    """Test rows with a forecast: weeks, MAPE and coverage per fold and overall.

    Columns: cv, split, mean, observed, lower, upper.
    """
    test = pred.filter((F.col("split") == "test") & F.col("mean").isNotNull())
    ape = F.abs(F.col("mean") - F.col("observed")) / F.col("observed")
    inside = F.col("observed").between(F.col("lower"), F.col("upper")).cast("double")
    rows = test.rollup("cv").agg(F.grouping("cv").alias("_all"), F.count(F.lit(1)).alias("weeks"),
                                 F.avg(ape).alias("mape"), F.avg(inside).alias("coverage"))
    return rows.withColumn("cv", F.when(F.col("_all") == 1, "overall").otherwise(F.col("cv"))
                           ).drop("_all")


def fold_roas(contrib: DataFrame, spend: DataFrame, folds: Mapping[str, tuple],
              prob: float = 0.94) -> DataFrame:
    """ROAS over each fold's own training weeks: mean and interval."""
    draws = cut_lineage(window_roas(contrib, spend, folds))  # read by the mean and by the interval
    return mean_and_hdi(draws, ["window", "channel"], prob).withColumnRenamed("window", "cv")


def time_slice_folds(weeks: DataFrame, n_init: int, horizon: int, step: int,
                     week: str = "week") -> DataFrame:
    """Label each week train or test in every fold of an expanding window.

    Fold f trains on the first n_init + f * step weeks and tests on the next ``horizon``.
    """
    last = weeks.agg(F.max(week)).scalar()
    at = F.col(week)
    folds = F.floor((F.col("_last") + 1 - n_init - horizon) / step)
    rows = weeks.withColumn("_last", last).filter(folds >= 0).select(
        week, F.explode(F.sequence(F.lit(0).cast("bigint"), folds)).alias("cv"))
    edge = F.lit(n_init) + F.col("cv") * step
    split = F.when(at < edge, "train").when(at < edge + horizon, "test")
    return rows.withColumn("split", split).filter("split is not null")


def next_lift_test(before: DataFrame, after: DataFrame, moves: DataFrame, stakes: DataFrame,
                   break_even: float = 1.0, tolerance: float = 0.25) -> DataFrame:
    """Act or test per channel, and the channel to test next.

    A channel is acted on when the calibrated verdict is decided and its estimate is stable between
    folds; the next test goes to the largest spend among the others.
    """
    old = verdict(before, break_even, ["channel"]).select(
        "channel", F.col("verdict").alias("verdict_before"))
    table = (verdict(after, break_even, ["channel"]).join(old, "channel").join(moves, "channel")
             .join(stakes, "channel").withColumn("stable", F.col("move") <= tolerance))
    act = (F.col("verdict") != "undecided") & F.col("stable")
    table = table.withColumn("action", F.when(act, "act").otherwise("test first"))
    pick = table.filter("action = 'test first'").agg(
        F.max_by("channel", F.struct("stake", "channel")).alias("c"))
    return table.withColumn("_next", pick.scalar()).withColumn(
        "next_test", F.coalesce(F.col("channel") == F.col("_next"), F.lit(False))).drop("_next")


# ---- budgets ----------------------------------------------------------------------------------------
def optimal_allocation(curves: DataFrame, budget: float, keys: Sequence[str] = ("scenario",),
                       margin: float = 1.0) -> DataFrame:
    """Split a budget over channels with concave responses, within bounds, for every scenario.

    ``curves``: keys, channel, beta, lam, scale, lower, upper, linear. A channel starts to take more than its lower
    bound when the common marginal value ``eta`` falls below the channel's marginal there, and is full at its marginal at the upper
    bound. Sorted, these values cut eta into segments in which the same channels are active, and the spend at the
    cuts tells the segment; inside it eta solves one smooth equation. A scenario is one row with its channels, so
    scenarios are independent. A budget that the bounds do not allow is an error.
    """
    keys = list(keys)
    numbers = ("beta", "lam", "scale", "lower", "upper", "linear")
    channel = F.struct("channel", *[F.col(c).cast("double").alias(c) for c in numbers])
    rows = curves.groupBy(*keys).agg(F.sort_array(F.collect_list(channel)).alias("_c"))
    flat = rows.select(*keys, *[F.col(f"_c.{c}").alias(f"_{c}") for c in ("channel", *numbers)])

    def solve(parts):
        for pdf in parts:
            etas, spends = [], []
            for _, *values in pdf[[f"_{c}" for c in ("channel", *numbers)]].itertuples(index=False):
                eta, spend = _share_out(*(np.asarray(v, float) for v in values), budget, margin)
                etas.append(eta)
                spends.append(spend)
            out = pdf[[*keys, "_channel"]].assign(eta=etas, _spend=spends)
            yield out

    types = dict(flat.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", _channel array<string>, eta double, _spend array<double>"
    pairs = F.arrays_zip(F.col("_channel").alias("channel"), F.col("_spend").alias("spend"))
    return flat.mapInPandas(solve, schema).select(*keys, "eta", F.inline(pairs).alias("channel", "spend"))


def _share_out(beta, lam, scale, lower, upper, linear, budget: float, margin: float):
    """eta and the spends of one scenario; response beta * tanh(lam * s / (2 scale)) plus linear * s."""
    if not lower.sum() - 1e-9 <= budget <= upper.sum() + 1e-9:
        raise ValueError(f"a budget of {budget:g} is not within the bounds' sums {lower.sum():g} and {upper.sum():g}")
    width = 2 * scale / lam
    peak = margin * beta / width
    marginal = lambda s: linear + peak / np.cosh(s / width) ** 2
    enters, leaves = marginal(lower), marginal(upper)

    def spend(eta):
        with np.errstate(divide="ignore", invalid="ignore"):
            free = width * np.arccosh(np.sqrt(np.maximum(peak / (eta - linear), 1.0)))
        return np.where(eta >= enters, lower, np.where(eta <= leaves, upper, np.clip(free, lower, upper)))

    cuts = np.unique(np.concatenate([enters, leaves]))[::-1]
    totals = np.array([spend(c).sum() for c in cuts])
    behind = int(np.searchsorted(totals, budget))  # totals grow as eta falls
    if behind == 0:
        return float(cuts[0]), spend(cuts[0])
    if behind == len(cuts):
        return float(cuts[-1]), spend(cuts[-1])
    high, low = cuts[behind - 1], cuts[behind]
    active = (enters >= high) & (leaves <= low)
    eta = high + (low - high) * (budget - totals[behind - 1]) / (totals[behind] - totals[behind - 1])
    for _ in range(100):  # secants and slopes inside the segment
        s = spend(eta)
        miss = s.sum() - budget
        if abs(miss) <= 1e-12 * max(1.0, budget):
            break
        low, high = (eta, high) if miss > 0 else (low, eta)
        value = eta - linear[active]
        slope = -np.sum(width[active] / (2 * value * np.tanh(np.maximum(s[active] / width[active], 1e-12))))
        new = eta - miss / slope
        eta = new if low < new < high else (low + high) / 2
        if high - low <= 1e-15 * abs(high):
            break
    return float(eta), spend(eta)


def plan_values(params: DataFrame, plans: Mapping[str, Mapping[str, float]], current: str,
                margin: float = 1.0) -> DataFrame:
    """Value of every plan in every draw, and its gain over the current plan.

    ``params``: draw, channel, beta, lam, scale, linear. All plans are valued in one aggregate.
    """
    sums = {}
    for name, plan in plans.items():
        spend = F.create_map(*[F.lit(x) for c, s in plan.items() for x in (c, float(s))])
        x = spend[F.col("channel")]
        sums[name] = F.sum(F.lit(margin) * response_curve(x, F.col("beta"), F.col("lam"),
                                                          F.col("scale")) + F.col("linear") * x)
    cells = [F.struct(F.lit(n).alias("plan"), v.alias("value"), (v - sums[current]).alias("gain"))
             for n, v in sums.items()]
    return params.groupBy("draw").agg(F.array(*cells).alias("p")).select("draw", F.inline("p"))


def plan_summary(values: DataFrame, q: float = 0.10) -> DataFrame:
    """Per plan: mean value, mean gain with its interval, P(beats current), low quantile."""
    base = values.groupBy("plan").agg(F.avg("value").alias("mean_value"),
                                      F.avg("gain").alias("mean_gain"),
                                      F.avg((F.col("gain") > 0).cast("double")).alias("p_beats"))
    low = exact_quantiles(values, "value", {"low_quantile": q}, ["plan"])
    ends = hdi(values, ["plan"], value="gain")
    return base.join(low, "plan").join(ends, "plan")


def allocation_risk(values: DataFrame, q: float = 0.10, keys: Sequence[str] = ("plan",),
                    value: str = "value") -> DataFrame:
    """Mean, q-quantile and the mean of the draws at or below it."""
    keys = list(keys)
    cut = exact_quantiles(values, value, {"quantile": q}, keys)
    return values.join(cut, keys).groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.max("quantile").alias("quantile"),
        F.avg(F.when(F.col(value) <= F.col("quantile"), F.col(value))).alias("cvar"))


def media_clv(values: DataFrame, mapping: DataFrame) -> DataFrame:
    """Value of a media channel's new customer: weights over acquisition channels."""
    return (mapping.join(values, "acquisition_channel").groupBy("media")
            .agg(F.sum(F.col("weight") * F.col("value")).alias("value")))


# ---- regressions --------------------------------------------------------------------------------------
def wide_transforms(rows: DataFrame, channels: Sequence[str], keys: Sequence[str],
                    value: str) -> DataFrame:
    """Channels as columns; the channel list is given, so no job looks it up."""
    return rows.groupBy(*keys).agg(*[
        F.max(F.when(F.col("channel") == c, F.col(value))).alias(c) for c in channels])


def mmm_ols(weekly: DataFrame, outcome: DataFrame, channels: Sequence[str],
            controls: Sequence[str], alpha: float, lam: float) -> DataFrame:
    """Least squares of the outcome on transformed media and controls."""
    top = F.max("spend").over(W.partitionBy("channel"))
    scaled = weekly.withColumn("spend", F.col("spend") / top)
    curved = geometric_adstock(scaled, alpha).withColumn(
        "media", logistic_saturation(F.col("adstock"), F.lit(float(lam))))
    wide = wide_transforms(curved, channels, ["week"], "media").join(outcome, "week")
    return ols(wide, "y", [*channels, *controls])


def mmm_grid_search(weekly: DataFrame, outcome: DataFrame, channels: Sequence[str],
                    controls: Sequence[str], alphas: Sequence[float],
                    lams: Sequence[float]) -> DataFrame:
    """Fit every (alpha, lam) candidate and rank by root mean squared error over the outcome's range.

    Candidates share the scan; each is reduced to its cross products, and the k x k systems are solved
    in parallel, one row per candidate.
    """
    grid = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.lit(float(v)).alias("lam"))
                     for a in alphas for v in lams])
    top = F.max("spend").over(W.partitionBy("channel"))
    rows = (weekly.withColumn("spend", F.col("spend") / top)
            .select("week", "channel", "spend", F.inline(grid)))
    curved = geometric_adstock(rows, F.col("alpha"), ["alpha", "lam", "channel"]).withColumn(
        "media", logistic_saturation(F.col("adstock"), F.col("lam")))
    wide = wide_transforms(curved, channels, ["alpha", "lam", "week"], "media").join(outcome, "week")
    names = [*channels, *controls]
    design = [("one", F.lit(1.0)), *[(c, F.col(c).cast("double")) for c in names],
              ("y", F.col("y"))]
    k = len(design) - 1
    sums = wide.groupBy("alpha", "lam").agg(
        F.count(F.lit(1)).alias("n"), (F.max("y") - F.min("y")).alias("range"),
        *moment_columns(design))

    def solve(parts):
        for pdf in parts:
            out = []
            for row in pdf.to_dict("records"):
                m = moment_matrix(row, k + 1)
                beta = np.linalg.lstsq(m[:k, :k], m[:k, k], rcond=None)[0]
                sse = m[k, k] - 2 * beta @ m[:k, k] + beta @ m[:k, :k] @ beta
                nrmse = float(np.sqrt(max(sse, 0.0) / row["n"]) / row["range"])
                out.append((row["alpha"], row["lam"], nrmse))
            yield pd.DataFrame(out, columns=["alpha", "lam", "nrmse"])

    fitted = sums.mapInPandas(solve, "alpha double, lam double, nrmse double")
    return fitted.withColumn("rank", F.row_number().over(W.orderBy("nrmse", "alpha", "lam")))
