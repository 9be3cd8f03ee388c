"""Draw queries: embeddings read as posterior draws (draw = vector, key = position)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions.uniform import poisson_one_cuts, uniform
from tallyfield.operators import draws as I
from tallyfield.operators import purchases as P
from tallyfield.plans import roles as R
from tallyfield.plans.registry import query


def hdi_sql(src: str, keys: str, value: str = "value", prob: float = 0.94) -> str:
    """Shortest window over the sorted list of each key's values."""
    return f"""
    SELECT {keys}, min_by(v[i], (v[i + k] - v[i], i)) AS hdi_low,
           min_by(v[i + k], (v[i + k] - v[i], i)) AS hdi_high
    FROM (SELECT *, unnest(range(1, n - k + 1)) AS i
          FROM (SELECT *, CAST(greatest(1, least(n - 1, ceil(CAST({prob} AS DOUBLE) * n) - 1))
                          AS BIGINT) AS k
                FROM (SELECT {keys}, list({value} ORDER BY {value}) AS v, count(*) AS n
                      FROM {src} GROUP BY {keys}) AS l) AS s) AS w GROUP BY {keys}"""


def mean_hdi_sql(src: str, keys: str, value: str = "value") -> str:
    return f"""
    SELECT h.*, mean FROM ({hdi_sql(src, keys, value)}) AS h
    JOIN (SELECT {keys}, avg({value}) AS mean FROM {src} GROUP BY {keys}) AS m USING ({keys})"""


def poisson_sql(u: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {u} >= CAST({c} AS DOUBLE) THEN 1 ELSE 0 END"
                            for c in poisson_one_cuts()) + ")"


@query("I1", "hdi", "key:i hdi_low:6 hdi_high:6", "draws", hdi_sql("draws", "key"))
def _(spark, sf):
    return I.hdi(R.draws(spark, sf), ["key"])


@query("I2", "eti", "key:i eti_low:6 eti_high:6", "draws", """
    SELECT key, quantile_cont(value, 0.03) AS eti_low, quantile_cont(value, 0.97) AS eti_high
    FROM draws GROUP BY 1""")
def _(spark, sf):
    return I.eti(R.draws(spark, sf), ["key"])


R.role_sql("truths", "draws", f"""
    SELECT key, 1 + 0.5 * ({R.sql_uniform('truth', 'key')} - 0.5) AS truth
    FROM (SELECT DISTINCT key FROM draws) AS k""")


def truths(spark, sf):
    return R.draws(spark, sf).select("key").distinct().withColumn(
        "truth", 1 + 0.5 * (uniform("truth", "key") - 0.5))


@query("I3", "recovery_table", "key:i truth:6 mean:6 hdi_low:6 hdi_high:6 covered:b",
       "draws truths", f"""
    SELECT *, truth BETWEEN hdi_low AND hdi_high AS covered
    FROM ({mean_hdi_sql('draws', 'key')}) AS t JOIN truths USING (key)""")
def _(spark, sf):
    return I.recovery_table(R.draws(spark, sf), truths(spark, sf), ["key"])


@query("I4", "k_of_k_coverage", "total:i inside:i enough:b", "draws truths", """
    SELECT count(*) AS total, count(*) FILTER (WHERE truth BETWEEN lower AND upper) AS inside,
           count(*) FILTER (WHERE truth BETWEEN lower AND upper) >= 60 AS enough
    FROM truths JOIN (SELECT key, quantile_cont(value, 0.1) AS lower,
                             quantile_cont(value, 0.9) AS upper FROM draws GROUP BY 1) AS i
    USING (key)""")
def _(spark, sf):
    ends = I.eti(R.draws(spark, sf), ["key"], 0.8).withColumnsRenamed(
        {"eti_low": "lower", "eti_high": "upper"})
    return I.k_of_k_coverage(ends, truths(spark, sf), ["key"], 60)


R.role_sql("paths", "draws", f"""
    SELECT draw, key // 32 AS path, key % 32 AS week, value FROM draws""")
R.role_sql("path_truth", "paths", f"""
    SELECT path, week, 1 + 2 * ({R.sql_uniform('path', 'path', 'week')} - 0.5) AS truth
    FROM (SELECT DISTINCT path, week FROM paths) AS k""")


def paths(spark, sf):
    d = R.draws(spark, sf).select("draw", F.floor(F.col("key") / 32).alias("path"),
                                  (F.col("key") % 32).alias("week"), "value")
    truth = d.select("path", "week").distinct().withColumn(
        "truth", 1 + 2 * (uniform("path", "path", "week") - 0.5))
    return d, truth


@query("I5", "path_coverage", "path:i dates:i coverage:6 missed_runs:i", "paths path_truth", f"""
    SELECT path, count(*) AS dates, avg(CASE WHEN inside THEN 1.0 ELSE 0 END) AS coverage,
           count(*) FILTER (WHERE NOT inside AND coalesce(prev, true)) AS missed_runs
    FROM (SELECT *, lag(inside) OVER (PARTITION BY path ORDER BY week) AS prev
          FROM (SELECT *, truth BETWEEN hdi_low AND hdi_high AS inside
                FROM ({hdi_sql('paths', 'path, week', prob=0.8)}) AS h
                JOIN path_truth USING (path, week)) AS i) AS l GROUP BY 1""")
def _(spark, sf):
    d, truth = paths(spark, sf)
    return I.path_coverage(d, truth, ["path"], "week", 0.8)


@query("I5", "missed_runs", "first:i last:i", "draws truths", f"""
    SELECT min(key) AS first, max(key) AS last FROM (
      SELECT key, key - row_number() OVER (ORDER BY key) AS run
      FROM ({hdi_sql('draws', 'key', prob=0.25)}) AS h JOIN truths USING (key)
      WHERE NOT truth BETWEEN hdi_low AND hdi_high) AS m GROUP BY run""")
def _(spark, sf):
    return I.missed_runs(R.draws(spark, sf), truths(spark, sf), "key", 0.25)


@query("I6", "weekly_band", "key:i hdi_low:6 hdi_high:6 observed:6 outside:b", "draws truths", f"""
    SELECT key, hdi_low, hdi_high, truth AS observed, NOT truth BETWEEN hdi_low AND hdi_high
             AS outside
    FROM ({hdi_sql('draws', 'key', prob=0.5)}) AS h JOIN truths USING (key)""")
def _(spark, sf):
    return I.weekly_band(R.draws(spark, sf), truths(spark, sf).withColumnRenamed(
        "truth", "observed"), "key", 0.5)


@query("I7", "compare", "parameter:s truth:4 estimate:4 abs_error:4 rel_error:6 within:b", "rfmh", """
    SELECT p AS parameter, t AS truth, e AS estimate, abs(e - t) AS abs_error,
           abs(e - t) / abs(t) AS rel_error, abs(e - t) / abs(t) <= 0.2 AS within
    FROM (SELECT unnest(['counts.repeat', 'counts.total', 'mean']) AS p, unnest([a, b, c]) AS t,
                 unnest([d, e, f]) AS e
          FROM (SELECT CAST(sum(frequency) AS DOUBLE) AS a, CAST(count(*) AS DOUBLE) AS b,
                       avg(frequency) AS c, CAST(sum(holdout_purchases) * 4 AS DOUBLE) AS d,
                       CAST(count(*) FILTER (WHERE holdout_purchases > 0) AS DOUBLE) AS e,
                       avg(holdout_purchases) * 4 AS f FROM rfmh) AS s) AS u""")
def _(spark, sf):
    cal = P.calibration_holdout(R.transactions(spark, sf), R.CAL_END, R.HOLD_END)
    truth = cal.agg(F.struct(F.sum("frequency").alias("repeat"), F.count(F.lit(1)).alias("total"))
                    .alias("counts"), F.avg("frequency").alias("mean"))
    held = F.col("holdout_purchases")
    est = cal.agg(F.struct((F.sum(held) * 4).alias("repeat"), F.count_if(held > 0).alias("total"))
                  .alias("counts"), (F.avg(held) * 4).alias("mean"))
    return I.compare(I.flatten(truth), I.flatten(est))


@query("I8", "stratified_bootstrap", "b:i value:6", "experiment", f"""
    SELECT b, sum(w * f * spend) / sum(w * f) AS value
    FROM (SELECT *, count_all / sum(w) OVER (PARTITION BY segment, b) AS f
          FROM (SELECT *, {poisson_sql(R.sql_uniform('boot', 'customer_id', 'b'))} AS w
                FROM (SELECT *, unnest(range(1, 201)) AS b,
                             count_seg AS count_all
                      FROM (SELECT *, count(*) OVER (PARTITION BY segment) AS count_seg
                            FROM experiment) AS e) AS x) AS y) AS z
    GROUP BY b""")
def _(spark, sf):
    def stat(w):
        return F.sum(F.col(w) * F.col("spend")) / F.sum(w)
    return I.stratified_bootstrap(R.experiment(spark, sf), stat, ["customer_id"], ["segment"], 200)


@query("I8", "bootstrap_interval", "lower:6 upper:6 se:6 resamples:i not_finite:i", "experiment", f"""
    SELECT quantile_cont(value, 0.025) AS lower, quantile_cont(value, 0.975) AS upper,
           stddev_samp(value) AS se, count(*) AS resamples, 0 AS not_finite
    FROM (SELECT b, max(spend) FILTER (WHERE w > 0) - sum(w * spend) / sum(w) AS value
          FROM (SELECT *, {poisson_sql(R.sql_uniform('gap', 'customer_id', 'b'))} AS w
                FROM (SELECT *, unnest(range(1, 201)) AS b FROM experiment) AS x) AS y
          GROUP BY b) AS z""")
def _(spark, sf):
    def stat(w):
        return F.max("spend") - F.sum(F.col(w) * F.col("spend")) / F.sum(w)
    boot = I.stratified_bootstrap(R.experiment(spark, sf), stat, ["customer_id"], (), 200, "gap")
    return I.bootstrap_interval(boot)


@query("I9", "verdict", "key:i p_above:6 verdict:s", "draws", """
    SELECT key, p_above, CASE WHEN p_above >= 0.9 THEN 'pays back' WHEN p_above <= CAST(1 AS DOUBLE)
             - CAST(0.9 AS DOUBLE) THEN 'does not pay back' ELSE 'undecided' END AS verdict
    FROM (SELECT key, avg(CASE WHEN value > 0.6 + key / 80.0 THEN 1.0 ELSE 0 END) AS p_above
          FROM draws GROUP BY 1) AS p""")
def _(spark, sf):
    shifted = R.draws(spark, sf).withColumn("value", F.col("value") - 0.6 - F.col("key") / 80.0)
    return I.verdict(shifted, 0.0, ["key"])
