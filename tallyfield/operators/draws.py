"""Posterior draws in long form (draw, key..., value): intervals, coverage, verdicts.

A key's draws are ranked with range buckets, so neither many keys nor one key with most of the draws
lands in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.operators.ordering import exact_quantiles, ranked
from tallyfield.operators.resample import with_resamples
from tallyfield.session import cut_lineage


def _finite(value: str) -> Column:
    v = F.col(value)
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def hdi(draws: DataFrame, keys: Sequence[str], prob: float = 0.94, value: str = "value",
        draw: str = "draw") -> DataFrame:
    """Shortest interval that holds ceil(prob * n) of a key's finite draws; the first on ties.

    Each draw is paired with the one ``k`` ranks above it by an equality join on (key, rank). Keys
    with fewer than two draws give no row.
    """
    if not 0 < prob < 1:
        raise ValueError("prob must lie strictly between 0 and 1")
    keys = list(keys)
    good = draws.filter(_finite(value)).select(*keys, F.col(value).alias("_v"),
                                               F.col(draw).alias("_draw"))
    order = ranked(good, ["_v", "_draw"], keys, "_rank")
    n = F.col("_n")
    span = F.greatest(F.lit(1), F.least(n - 1, F.ceil(F.lit(prob) * n) - 1))
    if keys:
        sized = order.join(good.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys)
    else:
        sized = order.withColumn("_n", good.agg(F.count(F.lit(1)).alias("c")).scalar())
    low = sized.select(*keys, F.col("_v").alias("_low"), (F.col("_rank") + span).alias("_rank"))
    pairs = low.join(order.select(*keys, "_rank", F.col("_v").alias("_high")), [*keys, "_rank"])
    best = F.min(F.struct((F.col("_high") - F.col("_low")).alias("w"), F.col("_rank").alias("r"),
                          F.col("_low").alias("lo"), F.col("_high").alias("hi")))
    return pairs.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, F.col("_b.lo").alias("hdi_low"), F.col("_b.hi").alias("hdi_high"))


def eti(draws: DataFrame, keys: Sequence[str], prob: float = 0.94,
        value: str = "value") -> DataFrame:
    """Equal-tailed interval with linear interpolation."""
    return exact_quantiles(draws.filter(_finite(value)), value,
                           {"eti_low": (1 - prob) / 2, "eti_high": 1 - (1 - prob) / 2}, keys)


def mean_and_hdi(draws: DataFrame, keys: Sequence[str], prob: float = 0.94, value: str = "value",
                 draw: str = "draw") -> DataFrame:
    """Mean of the draws next to their highest-density interval."""
    keys = list(keys)
    mean = draws.groupBy(*keys).agg(F.avg(value).alias("mean"))
    return mean.join(hdi(draws, keys, prob, value, draw), keys)


def recovery_table(draws: DataFrame, truth: DataFrame, keys: Sequence[str],
                   prob: float = 0.94) -> DataFrame:
    """Per parameter: truth, mean, interval, whether the interval covers the truth."""
    table = mean_and_hdi(draws, keys, prob).join(truth, list(keys))
    return table.withColumn("covered", F.col("truth").between(F.col("hdi_low"),
                                                              F.col("hdi_high")))


def k_of_k_coverage(intervals: DataFrame, truths: DataFrame, keys: Sequence[str], k: int,
                    low: str = "lower", high: str = "upper", truth: str = "truth") -> DataFrame:
    """How many true values their intervals hold, and whether that is at least ``k``."""
    both = truths.join(intervals, list(keys), "left")
    inside = F.coalesce(F.col(truth).between(F.col(low), F.col(high)), F.lit(False))
    return both.agg(F.count(F.lit(1)).alias("total"), F.count_if(inside).alias("inside"),
                    (F.count_if(inside) >= k).alias("enough"))


def path_coverage(draws: DataFrame, path: DataFrame, keys: Sequence[str], date: str,
                  prob: float = 0.94) -> DataFrame:
    """Share of dates whose true value lies in that date's interval, and the runs of missed dates."""
    keys = list(keys)
    inside = (hdi(draws, [*keys, date], prob).join(path, [*keys, date])
              .withColumn("inside", F.col("truth").between(F.col("hdi_low"), F.col("hdi_high"))))
    w = W.partitionBy(*keys).orderBy(date)
    starts = (~F.col("inside")) & F.coalesce(F.lag("inside").over(w), F.lit(True))
    marked = inside.withColumn("_start", starts)
    return marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("dates"), F.avg(F.col("inside").cast("double")).alias("coverage"),
        F.count_if("_start").alias("missed_runs"))


def missed_runs(draws: DataFrame, path: DataFrame, date: str, prob: float = 0.94) -> DataFrame:
    """First and last date of each run of consecutive missed dates (one path, integer dates)."""
    inside = hdi(draws, [date], prob).join(path, date)
    missed = inside.filter(~F.col("truth").between(F.col("hdi_low"), F.col("hdi_high")))
    run = F.col(date) - F.row_number().over(W.orderBy(date))
    return missed.select(date, run.alias("_run")).groupBy("_run").agg(
        F.min(date).alias("first"), F.max(date).alias("last")).drop("_run")


def weekly_band(draws: DataFrame, observed: DataFrame, date: str, prob: float = 0.94) -> DataFrame:
    """Each week's interval and whether the observed value lies outside it."""
    band = hdi(draws, [date], prob).join(observed, date)
    return band.withColumn("outside", ~F.col("observed").between(F.col("hdi_low"),
                                                                F.col("hdi_high")))


def flatten(df: DataFrame) -> DataFrame:
    """A row of nested structs as (parameter, value) rows; names joined by dots."""
    cells = []

    def walk(prefix: str, schema: T.StructType) -> None:
        for f in schema.fields:
            path = f"{prefix}{f.name}"
            if isinstance(f.dataType, T.StructType):
                walk(path + ".", f.dataType)
            elif isinstance(f.dataType, T.NumericType):
                cells.append(F.struct(F.lit(path).alias("parameter"),
                                      F.col(path).cast("double").alias("value")))

    walk("", df.schema)
    return df.select(F.inline(F.array(*cells)))


def compare(truth: DataFrame, estimate: DataFrame, tolerance: DataFrame | float = 0.2) -> DataFrame:
    """Truth against estimate for the parameters both have (parameter, value).

    ``tolerance`` is one relative bound, or a table (parameter, kind rel/abs, bound); parameters
    without an entry get no verdict.
    """
    both = truth.withColumnRenamed("value", "truth").join(
        estimate.withColumnRenamed("value", "estimate"), "parameter")
    if isinstance(tolerance, DataFrame):
        both = both.join(tolerance, "parameter", "left")
    else:
        both = both.withColumn("kind", F.lit("rel")).withColumn("bound", F.lit(float(tolerance)))
    err = F.abs(F.col("estimate") - F.col("truth"))
    rel = F.coalesce(F.try_divide(err, F.abs("truth")), F.lit(float("inf")))
    return both.select(
        "parameter", "truth", "estimate", err.alias("abs_error"), rel.alias("rel_error"), "kind",
        "bound", F.when(F.col("kind") == "rel", rel <= F.col("bound")).when(
            F.col("kind") == "abs", err <= F.col("bound")).alias("within"))


def stratified_bootstrap(df: DataFrame, stat: Callable[[str], Column], key: Sequence[str],
                         by: Sequence[str] = (), resamples: int = 200,
                         salt: str = "boot") -> DataFrame:
    """Bootstrap draws (b, value) of ``stat(weight)``, a weighted aggregate.

    Weights are Poisson(1) per row and resample, rescaled so that every stratum of ``by`` keeps its
    size in every resample. This replaces drawing exactly n rows, which needs a stratum in one place.
    """
    if not by:
        return with_resamples(df, key, resamples, salt, "_w").groupBy("b").agg(stat("_w").alias("value"))
    by = list(by)
    names = {b: f"_by_{b}" for b in by}
    drawn = (with_resamples(df.select(*by, *[k for k in key if k not in by]), key, resamples, salt, "_w")
             .groupBy(*by, "b").agg(F.sum("_w").alias("_drawn")).groupBy(*by)
             .agg(F.map_from_entries(F.collect_list(F.struct("b", "_drawn"))).alias("_drawn")))
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).withColumnsRenamed(names)
    every = F.sequence(F.lit(1), F.lit(resamples))
    # a row per stratum, its factors by resample: joined to the rows before they are multiplied; a stratum may be named by null
    factors = cut_lineage(drawn.join(sizes, [drawn[b].eqNullSafe(sizes[n]) for b, n in names.items()]).select(
        *names.values(), F.transform(every, lambda b: F.col("_n") / F.col("_drawn")[b]).alias("_f")))
    rows = df.join(factors, [df[b].eqNullSafe(factors[n]) for b, n in names.items()]).drop(*names.values())
    rows = with_resamples(rows, key, resamples, salt, "_w").withColumn("_w", F.col("_w") * F.get("_f", F.col("b") - 1))
    return rows.groupBy("b").agg(stat("_w").alias("value"))


def bootstrap_interval(boot: DataFrame, prob: float = 0.95, value: str = "value") -> DataFrame:
    """Percentile interval and standard error of bootstrap draws; counts draws not finite.

    The draws are written once: several aggregates read them, and each would draw all resamples again.
    """
    boot = cut_lineage(boot.select(value))
    ends = exact_quantiles(boot.filter(_finite(value)), value,
                           {"lower": (1 - prob) / 2, "upper": (1 + prob) / 2})
    spread = boot.agg(F.stddev_samp(value).alias("se"), F.count(F.lit(1)).alias("resamples"),
                      F.count_if(~_finite(value)).alias("not_finite"))
    for c in ("se", "resamples", "not_finite"):
        ends = ends.withColumn(c, spread.select(c).scalar())
    return ends


def verdict(draws: DataFrame, threshold: float, keys: Sequence[str], value: str = "value",
            sure: float = 0.9, labels: Sequence[str] = ("pays back", "does not pay back",
                                                         "undecided")) -> DataFrame:
    """P(draw > threshold) per key and the verdict at ``sure``."""
    yes, no, maybe = labels
    p = F.avg((F.col(value) > threshold).cast("double"))
    return draws.groupBy(*keys).agg(p.alias("p_above")).withColumn(
        "verdict", F.when(F.col("p_above") >= sure, yes)
        .when(F.col("p_above") <= F.lit(1.0) - F.lit(sure), no).otherwise(maybe))
