"""Geo experiments on a long panel (date, geo, sales, treated, post).

The panel is already an aggregate, one row per geo and period. Estimators stay long. A convex weight fit
(treated unit, placebo geo or placebo window) needs the Gram matrix of its units alone, which is a
distributed aggregate; fits run in parallel.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfield.operators.ordering import exact_quantiles
from tallyfield.session import cut_lineage


def panel_wide(panel: DataFrame, geos: Sequence[str], outcome: str = "sales") -> DataFrame:
    """Periods x geos for display; the geos are given, so no job looks them up."""
    return panel.groupBy("date").pivot("geo", list(geos)).agg(F.sum(outcome))


def _date(value) -> Column:
    return F.lit(str(value)).cast("date")


def geo_index(panel: DataFrame, start, outcome: str = "sales") -> DataFrame:
    """Sales over the geo's pre-period mean, averaged by group and date."""
    pre = F.avg(F.when(F.col("date") < _date(start), F.col(outcome))).over(W.partitionBy("geo"))
    return panel.withColumn("index", F.col(outcome) / pre).groupBy("date", "treated").agg(
        F.avg("index").alias("index"))


def _did_cells(treated: Column, test: Column, value: Column) -> list[Column]:
    def cell(a: Column, b: Column, name: str) -> Column:
        return F.avg(F.when(a & b, value)).alias(name)

    return [cell(treated, test, "t1"), cell(treated, ~test, "t0"), cell(~treated, test, "c1"),
            cell(~treated, ~test, "c0")]


def did(panel: DataFrame, start, end, outcome: str = "sales",
        by: Sequence[str] = ()) -> DataFrame:
    """Difference-in-differences on log sales up to ``end``; the test starts at ``start``."""
    rows = panel.filter(F.col("date") <= _date(end))
    treated, test = F.col("treated") == 1, F.col("date") >= _date(start)
    one = rows.groupBy(*by).agg(
        *_did_cells(treated, test, F.log(outcome)),
        F.sum(F.when(treated & test, F.col(outcome))).alias("window"),
        F.count_if(treated & test).alias("cells"))
    change = F.col("t1") - F.col("t0")
    delta = change - (F.col("c1") - F.col("c0"))
    incremental = F.col("window") * (1 - F.exp(-delta))
    return one.select(
        *by, delta.alias("log_lift"), (100 * F.expm1(delta)).alias("lift_pct"),
        incremental.alias("incremental_sales"),
        (incremental / F.col("cells")).alias("effect_per_geo_period"),
        (100 * F.expm1(change)).alias("naive_lift_pct"))


def event_study(panel: DataFrame, start, outcome: str = "sales") -> DataFrame:
    """Treated minus control mean log per period, less its pre-period mean, times 100."""
    t = F.col("treated") == 1
    gaps = panel.groupBy("date").agg(
        (F.avg(F.when(t, F.log(outcome))) - F.avg(F.when(~t, F.log(outcome)))).alias("gap"))
    pre = gaps.agg(F.avg(F.when(F.col("date") < _date(start), F.col("gap"))).alias("m"))
    return gaps.withColumn("_m", pre.scalar()).select(
        "date", (100 * (F.col("gap") - F.col("_m"))).alias("event"))


# ---- convex weights --------------------------------------------------------------------------------
#: Units of one fit at most: a fit's solver holds their Gram matrix.
UNITS = 4096
#: Name of the treated mean among the units; no geo can have it.
TARGET = "\x00treated"


def simplex_weights(gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Weights >= 0 that sum to 1 and minimize |y - x w|^2, from ``gram`` = x'x and ``cross`` = x'y.

    Accelerated projected gradient steps from the unit closest to the target, on the Gram matrix divided by its
    trace; then the equality problem is solved exactly on the support that is left. An error if the steps do not settle.
    """
    size = float(np.trace(gram)) or 1.0
    gram, cross = gram / size, cross / size
    rate = 1.0 / max(float(np.linalg.norm(gram, 2)), 1e-12)
    w = np.zeros(len(cross))
    w[int(np.argmin(np.diag(gram) - 2 * cross))] = 1.0
    probe, inertia = w, 0
    for _ in range(200_000):
        nearer = _to_simplex(probe - rate * (gram @ probe - cross))
        change = nearer - w
        # momentum starts again when it points uphill
        inertia = 0 if (probe - nearer) @ change > 0 else inertia + 1
        probe, w = nearer + inertia / (inertia + 3) * change, nearer
        if np.abs(change).max() < 1e-13:
            return _polish(w, gram, cross)
    raise RuntimeError("the weights did not settle")


def _to_simplex(v: np.ndarray) -> np.ndarray:
    """Euclidean projection onto the simplex."""
    u = np.sort(v)[::-1]
    excess = (np.cumsum(u) - 1.0) / np.arange(1, len(v) + 1)
    keep = int(np.flatnonzero(u > excess)[-1])
    return np.maximum(v - excess[keep], 0.0)


def _polish(w: np.ndarray, gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
    on = np.flatnonzero(w > 1e-9)
    m = len(on)
    system = np.zeros((m + 1, m + 1))
    system[:m, :m] = gram[np.ix_(on, on)]
    system[:m, m] = system[m, :m] = 1.0
    solved = np.linalg.lstsq(system, np.append(cross[on], 1.0), rcond=None)[0][:m]
    if np.all(solved >= 0):
        better = np.zeros_like(w)
        better[on] = solved / solved.sum()
        if better @ gram @ better - 2 * cross @ better <= w @ gram @ w - 2 * cross @ w + 1e-12:
            return better
    return w / w.sum()


def unit_series(panel: DataFrame, outcome: str = "sales", missing: str = "zero") -> DataFrame:
    """``unit, date, pre, value``: every control geo, and the mean of the treated geos as TARGET.

    A control without a row in some period has no row here, which the fits read as a period without sales;
    with ``missing="error"`` it is an error.
    """
    pre = (1 - F.col("post")).alias("pre")
    controls = panel.filter("treated = 0").select(F.col("geo").alias("unit"), "date", pre, F.col(outcome).alias("value"))
    target = panel.filter("treated = 1").groupBy("date", "post").agg(F.avg(outcome).alias("value")).select(
        F.lit(TARGET).alias("unit"), "date", pre, "value")
    if missing == "error":
        size = panel.agg(F.countDistinct("geo", "date").alias("cells"), F.countDistinct("geo").alias("geos"),
                         F.countDistinct("date").alias("dates")).first()
        if size["cells"] != size["geos"] * size["dates"]:
            raise ValueError(f"{size['geos'] * size['dates'] - size['cells']} cells of the panel have no row")
    elif missing != "zero":
        raise ValueError(f"missing is 'zero' or 'error', not {missing!r}")
    return controls.unionByName(target)


def _products(rows: DataFrame, by: str) -> DataFrame:
    """``a <= b`` and the product of their values in each period: one join on the period. Summed map-side by its readers,
    so what is shuffled is the half of units x units."""
    left = rows.select(by, F.col("unit").alias("a"), F.col("value").alias("_x"))
    right = rows.select(F.col(by).alias("_by"), F.col("unit").alias("b"), F.col("value").alias("_y"))
    return left.join(right, (F.col(by) == F.col("_by")) & (F.col("a") <= F.col("b"))).select(
        by, "a", "b", (F.col("_x") * F.col("_y")).alias("product"))


def _square(a: np.ndarray, b: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names in order, and the symmetric matrix of the pairs."""
    names, at = np.unique(np.concatenate([a, b]).astype(str), return_inverse=True)
    i, j = at[:len(a)], at[len(a):]
    out = np.zeros((len(names), len(names)))
    out[i, j] = out[j, i] = value
    return names, out


def sc_weights(series: DataFrame, placebos: bool = False) -> DataFrame:
    """``fit, unit, weight`` from the rows of ``unit_series``: the fit ``treated`` of the TARGET on all controls and, with
    ``placebos``, one fit of every control on the others.

    The pre-period Gram matrix of all units is one distributed aggregate. Every fit is that matrix less the rows and columns
    of its target and of TARGET, so no fit sees the panel again; fits are solved in parallel tasks. An error if there are more than
    UNITS units.
    """
    spark = series.sparkSession
    pairs = _products(series.filter("pre = 1"), "date").groupBy("a", "b").agg(F.sum("product").alias("s"))
    held = pairs.limit(UNITS * (UNITS + 1) // 2 + 1).toPandas()
    names, gram = _square(held["a"].to_numpy(), held["b"].to_numpy(), held["s"].to_numpy(float))
    if len(names) > UNITS:
        raise ValueError(f"{len(names)} units; a fit holds the Gram matrix of {UNITS} at most")
    donors = names != TARGET
    fits = series.filter((F.col("pre") == 1) & (F.lit(placebos) | (F.col("unit") == TARGET))).select("unit").distinct()

    def solve(frames):
        for pdf in frames:
            for target in pdf["unit"]:
                of, own = donors & (names != target), int(np.flatnonzero(names == target)[0])
                w = simplex_weights(gram[np.ix_(of, of)], gram[of, own]) if of.any() else np.empty(0)
                yield pd.DataFrame({"fit": "treated" if target == TARGET else target, "unit": names[of], "weight": w})

    tasks = max(1, min(len(names), spark.sparkContext.defaultParallelism))
    return fits.repartition(tasks, "unit").mapInPandas(solve, "fit string, unit string, weight double")


def synthetic_gaps(panel: DataFrame, outcome: str = "sales", placebos: bool = True, missing: str = "zero") -> DataFrame:
    """Actual and synthetic series per fit: the treated mean and each placebo geo.

    Only units with a weight are joined to their series, so rows grow with the weights' support.
    """
    series = cut_lineage(unit_series(panel, outcome, missing))
    weights = cut_lineage(sc_weights(series, placebos))
    parts = (weights.filter("weight > 0").join(series, "unit").select("fit", "date", "pre", (F.col("weight") * F.col("value")).alias("_s"),
                                                                     F.lit(0.0).alias("_a")))
    named = F.when(F.col("unit") == TARGET, "treated").otherwise(F.col("unit"))
    own = series.filter(F.lit(placebos) | (F.col("unit") == TARGET)).select(
        named.alias("fit"), "date", "pre", F.lit(0.0).alias("_s"), F.col("value").alias("_a"))
    return (parts.unionByName(own).groupBy("fit", "date", "pre").agg(F.sum("_s").alias("synthetic"), F.sum("_a").alias("actual"))
            .withColumn("gap", F.col("actual") - F.col("synthetic")))


def fit_statistics(gaps: DataFrame) -> DataFrame:
    """Per fit: relative effect, RMSPE ratio and pre-period error, from the gap series."""
    pre, post = F.col("pre") == 1, F.col("pre") == 0
    gap2 = F.col("gap") * F.col("gap")
    one = gaps.groupBy("fit").agg(
        F.sqrt(F.avg(F.when(pre, gap2))).alias("rmspe_pre"),
        F.sqrt(F.avg(F.when(post, gap2))).alias("rmspe_post"),
        F.avg(F.when(pre, F.col("actual"))).alias("mean_pre"),
        F.sum(F.when(post, F.col("gap"))).alias("gap_post"),
        F.sum(F.when(post, F.col("synthetic"))).alias("synthetic_post"))
    return one.select("fit", (F.col("gap_post") / F.col("synthetic_post")).alias("relative_effect"),
                      F.try_divide("rmspe_post", "rmspe_pre").alias("rmspe_ratio"),
                      (F.col("rmspe_pre") / F.col("mean_pre")).alias("pre_rmspe"),
                      "gap_post", "synthetic_post")


def synthetic_control(panel: DataFrame, outcome: str = "sales") -> DataFrame:
    """The treated fit: incremental outcome over all treated geos and its fit statistics."""
    stats = fit_statistics(synthetic_gaps(panel, outcome, placebos=False))
    n = panel.filter("treated = 1").agg(F.countDistinct("geo").alias("n")).scalar()
    return stats.withColumn("n_treated", n).select(
        (F.col("gap_post") * F.col("n_treated")).alias("incremental"), "relative_effect",
        "rmspe_ratio", "pre_rmspe", "n_treated",
        (F.col("synthetic_post") * F.col("n_treated")).alias("synthetic_post_total"))


def placebo_in_space(panel: DataFrame, outcome: str = "sales") -> DataFrame:
    """Fit statistics of the treated mean and of every control geo against the other controls."""
    return fit_statistics(synthetic_gaps(panel, outcome, placebos=True))


def permutation_pvalue(stats: DataFrame, statistic: str = "rmspe_ratio",
                       treated: str = "treated") -> DataFrame:
    """(1 + placebos at least as extreme) / (1 + placebos)."""
    mine = stats.filter(F.col("fit") == treated).agg(F.max(statistic).alias("s")).scalar()
    others = stats.withColumn("_mine", mine).filter(F.col("fit") != treated)
    n = F.count(F.lit(1))
    return others.agg(n.alias("placebos"), F.max("_mine").alias("statistic"), (
        (1 + F.count_if(F.col(statistic) >= F.col("_mine"))) / (1 + n)).alias("p_value"))


def placebo_in_time(panel: DataFrame, window: int = 10, history: int = 26,
                    outcome: str = "sales", silent_donors: str = "drop") -> DataFrame:
    """Estimated lift in every pre-period window that has ``history`` periods before it.

    Series are indexed to their mean before the window, as levels differ. A window that starts at
    period s sees periods up to its own end only: its Gram matrix is the running sum of the units' products up to s - 1,
    its totals are differences of running sums, so a window's fit gets units x units numbers and no panel. A geo without a
    row in some period had no sales in it. A control without sales before a window can't be indexed: it is left out of
    that window's donors, or is an error with ``silent_donors="error"``.
    """
    if silent_donors not in ("drop", "error"):
        raise ValueError(f"silent_donors is 'drop' or 'error', not {silent_donors!r}")
    pre = panel.filter("post = 0")
    periods = pre.select("date").distinct()
    # periods are calendar dates: as many rows as the panel is long
    time = periods.select("date", (F.row_number().over(W.orderBy("date")) - 1).alias("t"))
    count = periods.count()
    unit = F.when(F.col("treated") == 1, F.lit(TARGET)).otherwise(F.col("geo"))
    sales = pre.join(time, "date").groupBy(unit.alias("unit"), "t").agg(F.sum(outcome).alias("value"))
    # every unit has every period, so that running sums stand at every start
    grid = sales.select("unit").distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(max(count, 1) - 1))))
    cells = cut_lineage(grid.join(sales, ["unit", "t"], "left").select("unit", "t", F.coalesce("value", F.lit(0.0)).alias("value")))
    starts = (F.col("start") >= history) & (F.col("start") <= count - window)
    running = W.partitionBy("a", "b").orderBy("t")
    grams = (_products(cells, "t").select("a", "b", (F.col("t") + 1).alias("start"), F.sum("product").over(running).alias("s"))
             .filter(starts))
    so_far = W.partitionBy("unit").orderBy("t")
    totals = cells.select("unit", (F.col("t") + 1).alias("start"), F.sum("value").over(so_far).alias("before"),
                          F.sum("value").over(so_far.rowsBetween(1, window)).alias("within")).filter(starts)

    def estimate(gram: pd.DataFrame, total: pd.DataFrame) -> pd.DataFrame:
        start = int(total["start"].iloc[0])
        names, g = _square(gram["a"].to_numpy(), gram["b"].to_numpy(), gram["s"].to_numpy(float))
        total = total.set_index("unit").reindex(names)
        mean = total["before"].to_numpy() / start
        own, donors = names == TARGET, (names != TARGET) & (mean > 0)
        if silent_donors == "error" and donors.sum() + 1 < len(names):
            raise ValueError(f"a control has no sales before period {start}")
        m = mean[own][0]
        x = mean[donors]
        w = simplex_weights(g[np.ix_(donors, donors)] / np.outer(x, x), g[donors][:, own][:, 0] / (x * m))
        within = total["within"].to_numpy()
        extra = within[own][0] - m * float(within[donors] / x @ w)
        return pd.DataFrame({"start": [start], "lift_pct": [100 * extra / (within[own][0] - extra)]})

    return grams.groupBy("start").cogroup(totals.groupBy("start")).applyInPandas(estimate, "start int, lift_pct double")


def placebo_interval(errors: DataFrame, lift_pct: float) -> DataFrame:
    """Interval of an estimated lift from the 5th and 95th percentile of placebo errors."""
    ends = exact_quantiles(errors, "lift_pct", {"p05": 0.05, "p95": 0.95})
    return ends.select((lift_pct - F.col("p95")).alias("lift_low"),
                       (lift_pct - F.col("p05")).alias("lift_high"))


# ---- power -------------------------------------------------------------------------------------------
def placebo_did(panel: DataFrame, window: int = 10, history: int = 26, outcome: str = "sales",
                by: Sequence[str] = ()) -> DataFrame:
    """Difference-in-differences of every pre-period window without any lift.

    Logs are summed per period and group first, so the expansion to windows touches two rows per
    period, whatever the number of geos.
    """
    by = list(by)
    pre = panel.filter("post = 0")
    time = pre.select("date").distinct().select(
        "date", (F.row_number().over(W.orderBy("date")) - 1).alias("t"))
    sums = (pre.join(time, "date").groupBy(*by, "t", "treated")
            .agg(F.sum(F.log(outcome)).alias("s"), F.count(F.lit(1)).alias("n")))
    count = time.agg(F.count(F.lit(1)).alias("c")).scalar()
    low = F.greatest(F.lit(history), F.col("t") - (window - 1))
    rows = sums.withColumn("_last", count - window).filter(low <= F.col("_last")).select(
        *by, "t", "treated", "s", "n",
        F.explode(F.sequence(low.cast("int"), F.col("_last").cast("int"))).alias("start"))
    test, tr = F.col("t") >= F.col("start"), F.col("treated") == 1

    def mean(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("s"))) / F.sum(F.when(cond, F.col("n")))

    delta = (mean(tr & test) - mean(tr & ~test)) - (mean(~tr & test) - mean(~tr & ~test))
    return rows.groupBy(*by, "start").agg(delta.alias("log_lift"))


def geo_power(panel: DataFrame, lifts: Sequence[float], window: int = 10, history: int = 26,
              outcome: str = "sales", by: Sequence[str] = ()) -> DataFrame:
    """Share of past windows in which an injected lift would exceed the no-lift 95th percentile.

    Multiplying treated test sales by 1 + lift adds log(1 + lift) to the estimate of the window, so
    every lift is read off the same no-lift estimates.
    """
    by = list(by)
    none = placebo_did(panel, window, history, outcome, by).withColumn(
        "lift_pct", 100 * F.expm1("log_lift"))
    bar = exact_quantiles(none, "lift_pct", {"bar": 0.95}, by)
    rows = none.join(bar, by) if by else none.withColumn("bar", bar.scalar())
    cells = [F.struct(F.lit(float(x)).alias("lift"), F.avg(
        (100 * F.expm1(F.col("log_lift") + F.log1p(F.lit(x / 100.0))) > F.col("bar"))
        .cast("double")).alias("power")) for x in lifts]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("windows"),
                                 F.array(*cells).alias("c")).select(*by, "windows", F.inline("c"))


def lift_test_row(stats: DataFrame, treated: str, n_treated: int, share: float, periods: float,
                  channel: str, base_spend: float, extra_spend: float) -> DataFrame:
    """One calibration row (x, delta_x, delta_y, sigma) from a readout and its placebos.

    Sigma comes from the relative effects of placebos that fit before the test (error at most twice
    the median error).
    """
    others = stats.filter(F.col("fit") != treated)
    median = exact_quantiles(others, "pre_rmspe", {"m": 0.5}).scalar()
    spread = (others.withColumn("_m", median).filter(F.col("pre_rmspe") <= 2 * F.col("_m"))
              .agg(F.stddev_samp("relative_effect").alias("sd")).scalar())
    scale = share * periods
    mine = stats.filter(F.col("fit") == treated).withColumn("_sd", spread)
    return mine.select(
        F.lit(channel).alias("channel"), F.lit(base_spend).alias("x"),
        F.lit(extra_spend / scale).alias("delta_x"),
        (F.col("gap_post") * n_treated / scale).alias("delta_y"),
        (F.col("_sd") * F.col("synthetic_post") * n_treated / scale).alias("sigma"))


def contaminated_controls(panel: DataFrame, leaked: str, outcome: str = "sales") -> DataFrame:
    """The readout with one treated geo wrongly left among the controls, next to the right one."""
    wrong = panel.withColumn("treated", F.when(F.col("geo") == leaked, 0).otherwise(
        F.col("treated")))
    clean = synthetic_control(panel, outcome).withColumn("pool", F.lit("clean"))
    return clean.unionByName(synthetic_control(wrong, outcome).withColumn(
        "pool", F.lit("contaminated")))


def market_candidates(panel: DataFrame, candidates: Mapping[str, Sequence[str]], lift: float,
                      window: int = 10, history: int = 26, outcome: str = "sales") -> DataFrame:
    """Score candidate test markets: spread of placebo estimates and power at a lift.

    Every candidate set is treated in turn, with all other geos as controls.
    """
    sets = F.create_map(*[x for name, geos in candidates.items()
                          for x in (F.lit(name), F.array(*[F.lit(g) for g in geos]))])
    names = F.array(*[F.lit(n) for n in candidates])
    rows = panel.withColumn("candidate", F.explode(names)).withColumn(
        "treated", F.array_contains(sets[F.col("candidate")], F.col("geo")).cast("int"))
    none = placebo_did(rows, window, history, outcome, ["candidate"])
    spread = none.groupBy("candidate").agg(
        F.avg("log_lift").alias("placebo_bias"), F.stddev_samp("log_lift").alias("placebo_sd"))
    power = geo_power(rows, [lift], window, history, outcome, ["candidate"])
    return spread.join(power, "candidate")
