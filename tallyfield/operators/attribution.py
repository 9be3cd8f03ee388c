"""Multi-touch attribution.

Two inputs are possible. *Touches* are long rows (journey keys, time, channel): first and last touch,
channel sets, counts and transitions come from them by partial aggregates and bounded windows, so a
journey may be of any length. *Paths* are rows with ``path`` (array of channels in time order) and
``converted``, as stored journeys are; they are collapsed to distinct (path, converted) with a count,
as no credit rule can tell equal journeys apart. Operators take ``by`` columns, so bootstrap resamples
run side by side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfield.functions.uniform import TWO_32
from tallyfield.operators.ordering import exact_quantiles, ranked
from tallyfield.operators.resample import by_resample, sum_each
from tallyfield.session import cut_lineage

START, CONV, NULL = "start", "conv", "null"
RULES = ("last", "first", "linear")


def journeys(touches: DataFrame, conversions: DataFrame, keys: Sequence[str],
             channel: str = "channel", ts: str = "ts", touch_id: str = "event_id") -> DataFrame:
    """Touches in time order as a path per journey, and whether the journey converted.

    ``keys`` name a journey, e.g. user and day. A path is one row, so this is for journeys that fit
    one; :func:`journey_facts` and :func:`touch_transitions` do without paths.
    """
    touch = F.struct(F.col(ts).alias("t"), F.col(touch_id).alias("i"), F.col(channel).alias("c"))
    paths = touches.groupBy(*keys).agg(F.array_sort(F.collect_list(touch)).alias("_p")).select(
        *keys, F.transform("_p", lambda x: x["c"]).alias("path"))
    bought = conversions.select(*keys).distinct().withColumn("_c", F.lit(1))
    return paths.join(bought, list(keys), "left").select(
        *keys, "path", F.coalesce("_c", F.lit(0)).alias("converted"))


def path_counts(made: DataFrame) -> DataFrame:
    """Distinct (path, converted) with the number of journeys ``n``."""
    return made.groupBy("path", "converted").agg(F.count(F.lit(1)).alias("n"))


def journey_facts(touches: DataFrame, conversions: DataFrame, keys: Sequence[str],
                  channels: Sequence[str], channel: str = "channel", ts: str = "ts",
                  touch_id: str = "event_id") -> DataFrame:
    """Per journey: first and last channel, touches, distinct channels, touches per channel, converted.

    Everything is a partial aggregate; the set holds at most the listed channels.
    """
    at = F.struct(ts, touch_id)
    per = F.array(*[F.struct(F.lit(c).alias("channel"), F.count_if(F.col(channel) == c).alias("k"))
                    for c in channels])
    facts = touches.groupBy(*keys).agg(
        F.min_by(channel, at).alias("first"), F.max_by(channel, at).alias("last"),
        F.count(F.lit(1)).alias("touches"),
        F.array_sort(F.collect_set(channel)).alias("channels"), per.alias("per_channel"))
    bought = conversions.select(*keys).distinct().withColumn("_c", F.lit(1))
    return facts.join(bought, list(keys), "left").withColumn(
        "converted", F.coalesce("_c", F.lit(0))).drop("_c")


def path_facts(counts: DataFrame, channels: Sequence[str]) -> DataFrame:
    """The same facts from paths, with the count ``n`` of equal journeys."""
    def touches_of(c: str) -> Column:
        return F.size(F.filter("path", lambda x: x == c)).cast("bigint")

    per = F.array(*[F.struct(F.lit(c).alias("channel"), touches_of(c).alias("k"))
                    for c in channels])
    return counts.withColumns({
        "first": F.element_at("path", 1), "last": F.element_at("path", -1),
        "touches": F.size("path").cast("bigint"),
        "channels": F.array_sort(F.array_distinct("path")), "per_channel": per})


def touch_positions(touches: DataFrame, keys: Sequence[str], channel: str = "channel",
                    ts: str = "ts", touch_id: str = "event_id") -> DataFrame:
    """Journeys as long rows: the position of each touch, from 1, for journeys of any length."""
    return ranked(touches.select(*keys, ts, touch_id, channel), [ts, touch_id], keys, "position")


def touch_transitions(touches: DataFrame, facts: DataFrame, keys: Sequence[str],
                      channel: str = "channel", ts: str = "ts", touch_id: str = "event_id",
                      bucket_seconds: int = 3600) -> DataFrame:
    """First-order transitions (s, s2, n, p) counted from touches.

    The touch before is found inside a time bucket of the journey; the first touch of a bucket takes
    the last touch of the journey's bucket before (one row per journey and bucket).
    """
    keys = list(keys)
    rows = touches.select(*keys, F.col(channel).alias("s2"), F.struct(ts, touch_id).alias("_at"),
                          F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / bucket_seconds)
                          .alias("_b"))
    inside = W.partitionBy(*keys, "_b").orderBy("_at")
    seen = rows.withColumn("_prev", F.lag("s2").over(inside))
    ends = rows.groupBy(*keys, "_b").agg(F.max_by("s2", "_at").alias("_end"))
    earlier = ends.withColumn("_carry", F.lag("_end").over(W.partitionBy(*keys).orderBy("_b"))).drop(
        "_end")
    moves = seen.join(earlier, [*keys, "_b"]).select(
        F.coalesce("_prev", "_carry", F.lit(START)).alias("s"), "s2").groupBy("s", "s2").agg(
        F.count(F.lit(1)).cast("double").alias("n"))
    closing = facts.groupBy(F.col("last").alias("s"), F.when(F.col("converted") == 1, CONV).otherwise(
        NULL).alias("s2")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return _with_absorbing(moves.unionByName(closing), ())


def position_table(facts: DataFrame, channels: Sequence[str], n: str | None = None) -> DataFrame:
    """Per channel: share of journeys it is in; among its journeys with two or more channels, how
    often it opens and closes. One pass over journey facts (``n`` counts equal journeys)."""
    w = F.col(n) if n else F.lit(1)
    multi = F.size("channels") >= 2

    def share(hit: Column, among: Column) -> Column:
        return F.try_divide(F.sum(F.when(hit & among, w).otherwise(0)),
                            F.sum(F.when(among, w).otherwise(0)))

    cells = []
    for c in channels:
        has = F.array_contains("channels", c)
        cells.append(F.struct(F.lit(c).alias("channel"), share(has, F.lit(True)).alias("share"),
                              share(F.col("first") == c, has & multi).alias("opens"),
                              share(F.col("last") == c, has & multi).alias("closes")))
    return facts.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def _zero_filled(credit: DataFrame, channels: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row per channel (and ``by``), absent ones with credit 0."""
    sums = {c: F.coalesce(F.sum(F.when(F.col("channel") == c, F.col("credit"))), F.lit(0.0))
            for c in channels}
    cells = [F.struct(F.lit(c).alias("channel"), v.alias("credit")) for c, v in sums.items()]
    return credit.groupBy(*by).agg(F.array(*cells).alias("c")).select(*by, F.inline("c"))


def _only_listed(channels: Sequence[str], value: Column) -> Column:
    """``value``, or an error for a journey through a channel that is not in the list: its credit would be lost."""
    other = F.array_except("channels", F.array(*[F.lit(c) for c in channels]))
    return F.when(F.size(other) > 0, F.raise_error(F.concat(
        F.lit("a journey has channels that are not listed: "), F.array_join(other, ", ")))).otherwise(value)


def heuristic_credit(facts: DataFrame, channels: Sequence[str], rule: str,
                     by: Sequence[str] = (), n: str | None = None) -> DataFrame:
    """Conversions credited to each channel by the last, first or linear rule."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}, not {rule!r}")
    return all_heuristics(facts, channels, by, n, (rule,)).drop("method")


def all_heuristics(facts: DataFrame, channels: Sequence[str], by: Sequence[str] = (),
                   n: str | None = None, rules: Sequence[str] = RULES) -> DataFrame:
    """The rules as long rows (method, channel, credit), all counted in one pass."""
    w = _only_listed(channels, (F.col(n) if n else F.lit(1)).cast("double"))

    def touches_of(c: str) -> Column:
        return F.filter("per_channel", lambda x: x["channel"] == c)[0]["k"]

    per = {"last": lambda c: F.when(F.col("last") == c, w).otherwise(0.0),
           "first": lambda c: F.when(F.col("first") == c, w).otherwise(0.0),
           "linear": lambda c: w * touches_of(c) / F.col("touches")}
    cells = [F.struct(F.lit(r).alias("method"), F.lit(c).alias("channel"),
                      F.coalesce(F.sum(F.when(F.col("converted") == 1, per[r](c))), F.lit(0.0))
                      .alias("credit")) for r in rules for c in channels]
    return facts.groupBy(*by).agg(F.array(*cells).alias("c")).select(*by, F.inline("c"))


# ---- Markov chain -----------------------------------------------------------------------------------
def transition_matrix(counts: DataFrame, by: Sequence[str] = (), n: str = "n") -> DataFrame:
    """First-order transitions (s, s2, n, p) from start through the touches to conv or null.

    The two absorbing states keep themselves with probability 1.
    """
    by = list(by)
    moves = _moves(counts, n, by).groupBy(*by, "s", "s2").agg(F.sum(n).cast("double").alias("n"))
    return _with_absorbing(moves, by)


def _moves(counts: DataFrame, n: str, by: Sequence[str] = ()) -> DataFrame:
    """A row per step of each path from start to conv or null, with its count ``n``."""
    end = F.when(F.col("converted") == 1, CONV).otherwise(NULL)
    states = F.concat(F.array(F.lit(START)), F.col("path"), F.array(end))
    pairs = F.zip_with(F.slice(states, F.lit(1), F.size(states) - 1),
                       F.slice(states, F.lit(2), F.size(states) - 1),
                       lambda a, b: F.struct(a.alias("s"), b.alias("s2")))
    return counts.select(*by, n, F.inline(pairs))


def _with_absorbing(moves: DataFrame, by: Sequence[str]) -> DataFrame:
    absorbing = F.array(*[F.struct(F.lit(a).alias("s"), F.lit(a).alias("s2"), F.lit(1.0).alias("n"))
                          for a in (CONV, NULL)])
    head = moves.select(*by).distinct() if by else moves.sparkSession.range(1).select()
    rows = moves.unionByName(head.select(*by, F.inline(absorbing)))
    out = F.sum("n").over(W.partitionBy(*by, "s"))
    return rows.withColumn("p", F.col("n") / out)


def _absorb(p: np.ndarray, conv: np.ndarray, start: int) -> float:
    return float(np.linalg.solve(np.eye(len(p)) - p, conv)[start])


def markov(transitions: DataFrame, channels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Conversion probability and every channel's removal effect, per ``by`` group.

    Removing a channel sends its journeys to null. A group is one transition matrix: (channels + 3)
    states squared at most, whatever the number of journeys.
    """
    by = list(by)
    states = [START, *channels]
    index = {s: i for i, s in enumerate(states)}

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        q = np.zeros((len(states), len(states)))
        conv = np.zeros(len(states))
        unknown = (set(pdf["s"]) | set(pdf["s2"])) - set(states) - {CONV, NULL}
        if unknown:
            raise ValueError(f"transitions pass through channels that are not listed: {sorted(unknown)}")
        for s, s2, p in zip(pdf["s"], pdf["s2"], pdf["p"], strict=True):
            if s in index and s2 in index:
                q[index[s], index[s2]] = p
            elif s in index and s2 == CONV:
                conv[index[s]] = p
        whole = _absorb(q, conv, 0)
        rows = []
        for c in channels:
            q2, conv2 = q.copy(), conv.copy()
            q2[index[c], :], conv2[index[c]] = 0.0, 0.0
            rows.append((c, whole, 1 - _absorb(q2, conv2, 0) / whole if whole else np.nan))
        out = pd.DataFrame(rows, columns=["channel", "conversion_probability", "removal_effect"])
        for b in by:
            out.insert(0, b, pdf[b].iloc[0])
        return out

    types = dict(transitions.dtypes)
    keyed = transitions if by else transitions.withColumn("_one", F.lit(1))
    schema = ", ".join([f"{b} {types[b]}" for b in reversed(by)] + [
        "channel string", "conversion_probability double", "removal_effect double"])
    return keyed.groupBy(*(by or ["_one"])).applyInPandas(solve, schema)


def markov_credit(effects: DataFrame, conversions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Conversions shared out in proportion to removal effects (``conversions``: by, conversions)."""
    by = list(by)
    share = F.col("removal_effect") / F.sum("removal_effect").over(W.partitionBy(*by))
    rows = effects.withColumn("_share", share)
    if by:
        rows = rows.join(conversions, by)
    else:
        rows = rows.withColumn("conversions", conversions.select("conversions").scalar())
    return rows.select(*by, "channel", (F.col("conversions") * F.col("_share")).alias("credit"))


def converted_total(facts: DataFrame, by: Sequence[str] = (), n: str | None = None) -> DataFrame:
    w = F.col(n) if n else F.lit(1)
    return facts.groupBy(*by).agg(
        F.sum(F.when(F.col("converted") == 1, w).otherwise(0)).alias("conversions"))


# ---- Shapley values ----------------------------------------------------------------------------------
def coalition_table(facts: DataFrame, by: Sequence[str] = (), n: str | None = None) -> DataFrame:
    """Per exact set of channels: its size, journeys, conversions and conversion rate."""
    w = F.col(n) if n else F.lit(1)
    return facts.groupBy(*by, "channels").agg(
        F.sum(w).alias("journeys"),
        F.sum(F.when(F.col("converted") == 1, w).otherwise(0)).alias("conversions")).select(
        *by, F.array_join("channels", " + ").alias("set"), "channels",
        F.size("channels").alias("size"), "journeys", "conversions",
        (F.col("conversions") / F.col("journeys")).alias("rate"))


def subset_weight(n: Column, m: Column) -> Column:
    """Shapley weight of a subset of ``m`` of the n - 1 other players: 1 / (n C(n - 1, m)), by a product that cannot overflow."""
    steps = F.when(m > 0, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>"))
    return 1 / (n * F.aggregate(steps, F.lit(1.0), lambda c, i: c * (n - 1 - m + i) / i))


def shapley_credit(coalitions: DataFrame, channels: Sequence[str], by: Sequence[str] = (),
                   absent: float | None = None) -> DataFrame:
    """Credit by Shapley shares of v(T) = rate of exactly T, within each converting set.

    A subset U of a set S adds v(U) to its members and takes it from the others of S, with the usual
    weights; so each set is unfolded to its subsets once and joined to the table by key. A subset
    nobody has is an error, unless ``absent`` gives its value.
    """
    by = list(by)
    value = coalitions.select(*by, F.col("set").alias("_u"), F.col("rate").alias("_v"))
    won = coalitions.filter("conversions > 0")
    fits = F.when(F.col("size") <= 62, F.col("size")).otherwise(F.raise_error(F.lit("a set has more than 62 channels")))
    mask = F.explode(F.sequence(F.lit(1).cast("bigint"), (F.pow(F.lit(2.0), fits) - 1).cast("bigint")))
    subsets = won.select(*by, "channels", "size", "conversions", "rate", mask.alias("_m"))
    member = F.expr("filter(channels, (c, i) -> (shiftright(_m, i) & 1) = 1)")
    keyed = subsets.withColumn("_in", member).withColumn("_u", F.array_join("_in", " + "))
    joined = keyed.join(value, [*by, "_u"], "left")
    fallback = F.lit(float(absent)) if absent is not None else F.raise_error(F.concat(
        F.lit("no journey has exactly the channels "), F.col("_u")))
    k, n = F.size("_in"), F.col("size")
    gives, takes = subset_weight(n, k - 1), -subset_weight(n, F.least(k, n - 1))
    rows = joined.withColumn("_v", F.when(F.col("_v").isNull(), fallback).otherwise(F.col("_v")))
    rows = rows.withColumn("channel", F.explode("channels"))
    part = F.when(F.array_contains("_in", F.col("channel")), gives).otherwise(takes)
    credit = F.col("conversions") * part * F.col("_v") / F.col("rate")
    return _zero_filled(rows.select(*by, "channel", credit.alias("credit")), channels, by)


def shapley_count_based(coalitions: DataFrame, channels: Sequence[str],
                        by: Sequence[str] = ()) -> DataFrame:
    """Shapley values when v(S) counts the conversions inside S: an equal split per set."""
    rows = coalitions.select(*by, F.explode("channels").alias("channel"),
                             (F.col("conversions") / F.col("size")).alias("credit"))
    return _zero_filled(rows, channels, by)


# ---- all methods, comparison, bootstrap ----------------------------------------------------------------
def all_methods(counts: DataFrame, channels: Sequence[str], by: Sequence[str] = (), n: str = "n",
                absent: float | None = None) -> DataFrame:
    """Long credit (by, method, channel, credit) of the five methods, from path counts."""
    by = list(by)
    facts = path_facts(counts, channels)
    chain = markov(transition_matrix(counts, by, n), channels, by)
    removal = markov_credit(chain, converted_total(facts, by, n), by)
    shapley = shapley_credit(coalition_table(facts, by, n), channels, by, absent)
    return (all_heuristics(facts, channels, by, n)
            .unionByName(removal.withColumn("method", F.lit("markov")))
            .unionByName(shapley.withColumn("method", F.lit("shapley"))))


def credit_vs_truth(credit: DataFrame, truth: DataFrame) -> DataFrame:
    """Per method: total variation distance of the shares and the channel with the largest gap.

    ``truth``: channel, incremental. The first channel by name wins a tie.
    """
    everyone = W.partitionBy()
    true_share = truth.select("channel", (F.col("incremental") / F.sum("incremental").over(everyone))
                              .alias("_true"))
    share = F.col("credit") / F.sum("credit").over(W.partitionBy("method"))
    gaps = credit.withColumn("_share", share).join(true_share, "channel").withColumn(
        "gap", F.col("_share") - F.col("_true"))
    size = F.round(F.abs("gap"), 12)
    worst = F.min(F.struct((-size).alias("s"), F.col("channel").alias("c"), F.col("gap").alias("g")))
    return gaps.groupBy("method").agg((0.5 * F.sum(F.abs("gap"))).alias("tvd"),
                                      worst.alias("_w")).select(
        "method", "tvd", F.col("_w.c").alias("largest_gap_channel"),
        F.col("_w.g").alias("largest_gap"))


POISSON_BLOCK = 500


@lru_cache(maxsize=POISSON_BLOCK)
def poisson_cdf(m: int) -> np.ndarray:
    """P(X <= k) of Poisson(m) for k = 0, 1, ... to where less than 1e-14 is left."""
    k = np.arange(int(m + 12 * np.sqrt(m) + 20) + 1)
    return np.cumsum(np.exp(-m + np.concatenate([[0.0], np.cumsum(np.log(m / k[1:]))])))


def _drawn(resamples: int):
    """Poisson counts of each row's block, by inverting the CDF at the md5 uniforms of ``_key|b|_block``."""
    names = [f"|{b}|" for b in range(1, resamples + 1)]

    def run(batches):
        for rb in batches:
            out = np.empty((rb.num_rows, resamples), np.int64)
            for r, (key, m, block) in enumerate(zip(*(rb.column(c).to_pylist() for c in ("_key", "_m", "_block")), strict=True)):
                head = hashlib.md5(key.encode())
                u = np.empty(resamples)
                for i, name in enumerate(names):
                    h = head.copy()
                    h.update(f"{name}{block}".encode())
                    u[i] = int.from_bytes(h.digest()[:4], "big") / TWO_32
                out[r] = np.searchsorted(poisson_cdf(m), u, "right")
            ends = np.arange(0, out.size + 1, resamples, dtype=np.int32)
            keep = [c for c in rb.schema.names if c not in ("_key", "_m", "_block")]
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))],
                                             names=[*keep, "w"])
    return run


def resampled_weights(counts: DataFrame, resamples: int, salt: str = "journeys") -> DataFrame:
    """``counts`` with the array ``w``: how often each resample draws the path, each journey Poisson(1) times.

    The n equal journeys of a path are drawn in blocks of POISSON_BLOCK, a row each, and added up: the draw is exact for
    any n, and a path with very many journeys is work for many tasks.
    """
    spark = counts.sparkSession
    last = F.floor((F.col("n") - 1) / POISSON_BLOCK).cast("bigint")
    rows = (counts.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_block"))
            # few bytes, much work: keep the partitions that were asked for
            .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "converted", "_block"))
    size = F.least(F.lit(POISSON_BLOCK), F.col("n") - F.col("_block") * POISSON_BLOCK).cast("int")
    keyed = rows.withColumns({"_key": F.concat_ws("|", F.lit(salt), F.array_join("path", ">"), F.col("converted").cast("string")), "_m": size})
    kinds = ", ".join(f"{c} {t}" for c, t in counts.dtypes)
    drawn = keyed.mapInArrow(_drawn(resamples), f"{kinds}, w array<bigint>")
    return drawn.groupBy(*counts.columns).agg(sum_each(F.col("w"), resamples).alias("w"))


def resampled_counts(counts: DataFrame, resamples: int, salt: str = "journeys") -> DataFrame:
    """Path counts ``w`` of every resample b that draws the path."""
    return (resampled_weights(counts, resamples, salt).select(*counts.columns, F.posexplode("w").alias("_at", "w"))
            .withColumn("b", F.col("_at") + 1).drop("_at").filter("w > 0"))


def bootstrap_credit(counts: DataFrame, channels: Sequence[str], resamples: int = 200,
                     salt: str = "journeys", absent: float | None = None) -> DataFrame:
    """Credit of all five methods on every resample (b, method, channel, credit).

    Paths carry the weights of all resamples as one array. What the methods need of them (credit by rule, transitions,
    conversions by set of channels) is summed position by position; only these sums, whose number the channels bound, are laid
    out by resample.
    """
    drawn = cut_lineage(resampled_weights(counts, resamples, salt))
    facts = path_facts(drawn, channels)

    def summed(rows: DataFrame, keys: Sequence[str], factor: Column | None = None, name: str = "n") -> DataFrame:
        return by_resample(rows.groupBy(*keys).agg(sum_each(F.col("w"), resamples, factor).alias(name)), [name], keys)

    per = F.filter("per_channel", lambda x: x["k"] > 0)
    cell = lambda rule, c, share: F.struct(F.lit(rule).alias("method"), c.alias("channel"), share.alias("share"))
    shares = F.concat(F.array(cell("last", F.col("last"), F.lit(1.0))), F.array(cell("first", F.col("first"), F.lit(1.0))),
                      F.transform(per, lambda x: cell("linear", x["channel"], x["k"] / F.col("touches"))))
    won = facts.filter("converted = 1").select(F.inline(_only_listed(channels, shares)), "w")
    grid = F.array(*[F.struct(F.lit(r).alias("method"), F.lit(c).alias("channel")) for r in RULES for c in channels])
    given = cut_lineage(summed(won, ["method", "channel"], F.col("share"), "credit"))
    # every resample that drew anything has a row for every rule and channel
    sets = cut_lineage(summed(facts, ["channels", "converted"]).groupBy("b", "channels").agg(
        F.sum("n").alias("journeys"), F.sum(F.when(F.col("converted") == 1, F.col("n")).otherwise(0)).alias("conversions"))
        .filter("journeys > 0"))
    totals = sets.groupBy("b").agg(F.sum("conversions").alias("conversions"))
    rules = (totals.select("b", F.inline(grid)).join(given, ["b", "method", "channel"], "left")
             .select("b", "method", "channel", F.coalesce("credit", F.lit(0.0)).alias("credit")))
    moves = summed(_moves(drawn, "w"), ["s", "s2"]).filter("n > 0").select("b", "s", "s2", F.col("n").cast("double").alias("n"))
    chain = markov(_with_absorbing(moves, ["b"]), channels, ["b"])
    removal = markov_credit(chain, totals, ["b"])
    coalitions = sets.select("b", F.array_join("channels", " + ").alias("set"), "channels", F.size("channels").alias("size"),
                             "journeys", "conversions", (F.col("conversions") / F.col("journeys")).alias("rate"))
    shapley = shapley_credit(coalitions, channels, ["b"], absent)
    return (rules.unionByName(removal.withColumn("method", F.lit("markov")))
            .unionByName(shapley.withColumn("method", F.lit("shapley"))))


# ---- decisions -------------------------------------------------------------------------------------------
def cost_per_credit(boot: DataFrame, credit: DataFrame, spend: Mapping[str, float],
                    scalable: Sequence[str]) -> DataFrame:
    """Spend per credited conversion with a 95% percentile interval, and the cheapest scalable
    channel of each method."""
    table = F.create_map(*[F.lit(x) for c, s in spend.items() for x in (c, float(s))])
    cost = F.try_divide(table[F.col("channel")], "credit")
    ends = exact_quantiles(boot.withColumn("_cost", cost), "_cost", {"lo": 0.025, "hi": 0.975},
                           ["method", "channel"])
    rows = credit.withColumn("cost", cost).join(ends, ["method", "channel"], "left")
    best = F.min(F.when(F.col("channel").isin(*scalable), F.struct("cost", "channel"))).over(
        W.partitionBy("method"))
    return rows.withColumn("cheapest", F.coalesce(best["channel"] == F.col("channel"), F.lit(False)))


def holdout_mde(facts: DataFrame, credit: DataFrame, channel: str, spend: float, share: float,
                margin: float, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """What a holdout of the channel could detect, against what would make its spend pay.

    ``credit``: channel, credit of the method the decision rests on.
    """
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    reached = facts.filter(F.array_contains("channels", channel)).agg(
        F.count(F.lit(1)).alias("reached"), F.avg(F.col("converted").cast("double")).alias("rate"))
    n0 = F.bround(F.lit(share) * F.col("reached"))
    n1 = F.col("reached") - n0
    mde = z * F.sqrt(F.col("rate") * (1 - F.col("rate")) * (1 / n1 + 1 / n0))
    mine = credit.filter(F.col("channel") == channel).agg(F.max("credit").alias("c")).scalar()
    rows = reached.withColumn("_credit", mine).withColumn("mde", mde)
    return rows.select(
        F.lit(channel).alias("channel"), "reached", "rate", "mde",
        (F.col("mde") * F.col("reached")).alias("detectable_conversions"),
        F.lit(spend / margin).alias("break_even"),
        (F.lit(share * margin) * F.col("_credit")).alias("margin_at_risk"),
        (F.col("mde") * F.col("reached") < spend / margin).alias("test_first"))
