"""Media queries: weekly order value by priority, parameter draws from embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions.uniform import uniform
from tallyfield.operators import media as X
from tallyfield.operators.resample import in_all_tasks
from tallyfield.plans import roles as R
from tallyfield.plans.draws import hdi_sql, mean_hdi_sql
from tallyfield.plans.registry import query
from tallyfield.session import cut_lineage

CHANNELS = ["tv", "search", "social", "display", "email"]
WINDOWS = {"all": (0, 400), "first_year": (0, 51), "second_year": (52, 103), "late": (250, 300)}


def dbl(x: float) -> str:
    return f"CAST({x} AS DOUBLE)"


POSITIONS, GROUPS = 64, 15  # of a vector; a parameter is the mean size of every 15th position


def params(spark, sf):
    """Draws of (alpha, lam, beta) per channel, from all positions of the embeddings."""
    def size(k):
        at = range(k, POSITIONS, GROUPS)
        return sum((F.abs(F.get("embedding", F.lit(i)).cast("double")) for i in at), F.lit(0.0)) / len(at)

    rows = R.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("draw"), F.explode(F.array(*[F.struct(
            F.lit(c).alias("channel"), *[size(3 * i + j).alias(f"e{j}") for j in range(3)])
            for i, c in enumerate(CHANNELS)])).alias("p")).select("draw", "p.*")
    return rows.select("draw", "channel", (0.2 + F.col("e0")).alias("alpha"),
                       (2 + 5 * F.col("e1")).alias("lam"), (300 + 900 * F.col("e2")).alias("beta"))


def _size_sql(k: int) -> str:
    at = range(k, POSITIONS, GROUPS)
    return f"(0.0::DOUBLE + {' + '.join(f'abs(CAST(embedding[{i + 1}] AS DOUBLE))' for i in at)}) / {len(at)}"


R.role_sql("params", "", " UNION ALL ".join(f"""
    SELECT vec_id AS draw, '{c}' AS channel, 0.2 + {_size_sql(3 * i)} AS alpha,
           2 + 5 * {_size_sql(3 * i + 1)} AS lam,
           300 + 900 * {_size_sql(3 * i + 2)} AS beta FROM embeddings"""
                                            for i, c in enumerate(CHANNELS)))


def adstock_sql(x: str, alpha: str, part: str, order: str = "week") -> str:
    """Normalized eight-week carry-over as a sum of lags."""
    top = " + ".join(f"pow({alpha}, {k}) * " + (x if k == 0 else
                     f"coalesce(lag({x}, {k}) OVER (PARTITION BY {part} ORDER BY {order}), 0)")
                     for k in range(8))
    return f"({top}) / ({' + '.join(f'pow({alpha}, {k})' for k in range(8))})"


def sat_sql(x: str, lam: str) -> str:
    return f"((1 - exp(-({lam}) * ({x}))) / (1 + exp(-({lam}) * ({x}))))"


@query("X1", "geometric_adstock", "week:i channel:s adstock:5", "media",
       f"SELECT week, channel, {adstock_sql('spend', dbl(0.6), 'channel')} AS adstock FROM media")
def _(spark, sf):
    return X.geometric_adstock(R.media_weekly(spark, sf), 0.6)


@query("X2", "logistic_saturation", "week:i channel:s value:8", "media",
       f"SELECT week, channel, {sat_sql('spend / 5000', '1.7')} AS value FROM media")
def _(spark, sf):
    return R.media_weekly(spark, sf).withColumn(
        "value", X.logistic_saturation(F.col("spend") / 5000, F.lit(1.7)))


@query("X3", "response_curve", "week:i channel:s value:6", "media",
       f"SELECT week, channel, 900 * {sat_sql('spend / 800', '2.2')} AS value FROM media")
def _(spark, sf):
    return R.media_weekly(spark, sf).withColumn("value", X.response_curve(
        F.col("spend"), F.lit(900.0), F.lit(2.2), F.lit(800.0)))


@query("X4", "marginal_roas", "week:i channel:s value:6", "media", f"""
    SELECT week, channel, (900 * {sat_sql('(spend + 1) / 800', '2.2')}
                           - 900 * {sat_sql('(spend - 1) / 800', '2.2')}) / 2 AS value FROM media""")
def _(spark, sf):
    return R.media_weekly(spark, sf).withColumn("value", X.marginal_roas(
        F.col("spend"), lambda s: X.response_curve(s, F.lit(900.0), F.lit(2.2), F.lit(800.0))))


@query("X5", "spend_share_scale", "channel:s total:2 scale:6", "media", """
    SELECT channel, total, count(*) OVER () * total / sum(total) OVER () AS scale
    FROM (SELECT channel, sum(spend) AS total FROM media GROUP BY 1) AS t""")
def _(spark, sf):
    return X.spend_share_scale(R.media_weekly(spark, sf))


def contrib(spark, sf):
    """Contribution draws (draw, channel, week): saturated spend times the draw's beta."""
    # a written copy is known to be small, so that draws need not be dealt by channel, of which there are few
    weekly = cut_lineage(R.media_weekly(spark, sf))
    # a small file has few splits: draws go to all tasks before they are multiplied by the weeks
    rows = in_all_tasks(params(spark, sf), "draw", "channel").join(weekly, "channel")
    value = X.response_curve(F.col("spend"), F.col("beta"), F.col("lam"), F.lit(3000.0))
    return rows.select("draw", "channel", "week", value.alias("contribution"))


R.role_sql("contrib", "params media", f"""
    SELECT draw, channel, week, beta * {sat_sql('spend / 3000', 'lam')} AS contribution
    FROM params JOIN media USING (channel)""")
R.role_sql("cost", "media", "SELECT channel, sum(spend) AS cost FROM media GROUP BY 1")
R.role_sql("roas", "contrib cost", """
    SELECT draw, channel, c / cost AS value FROM (
      SELECT draw, channel, sum(contribution) AS c FROM contrib GROUP BY 1, 2) AS s
    JOIN cost USING (channel)""")
R.role_sql("roas_truth", "roas", f"""
    SELECT channel, avg(value) * (0.9 + 0.2 * {R.sql_uniform('t', 'channel')}) AS truth FROM roas
    GROUP BY 1""")


def roas(spark, sf):
    return cut_lineage(X.roas_draws(contrib(spark, sf), R.media_weekly(spark, sf)))


def roas_truth(draws):
    return draws.groupBy("channel").agg(F.avg("value").alias("m")).select(
        "channel", (F.col("m") * (0.9 + 0.2 * uniform("t", "channel"))).alias("truth"))


def roas_table_sql(src: str) -> str:
    return f"""
    SELECT t.*, truth, p_above, (mean - truth) / truth AS rel_bias,
           truth BETWEEN hdi_low AND hdi_high AS covered
    FROM ({mean_hdi_sql(src, 'channel')}) AS t JOIN roas_truth USING (channel)
    JOIN (SELECT channel, avg(CASE WHEN value > 0.4 THEN 1.0 ELSE 0 END) AS p_above
          FROM {src} GROUP BY 1) AS p USING (channel)"""


@query("X6", "roas_table", "channel:s mean:7 hdi_low:7 hdi_high:7 truth:7 p_above:6 rel_bias:6"
       " covered:b", "roas roas_truth", roas_table_sql("roas"))
def _(spark, sf):
    draws = roas(spark, sf)
    return X.roas_table(draws, roas_truth(draws), 0.4)


R.role_sql("shares", "contrib", """
    SELECT draw, channel, c / sum(c) OVER (PARTITION BY draw) AS value
    FROM (SELECT draw, channel, sum(contribution) AS c FROM contrib GROUP BY 1, 2) AS s""")


@query("X7", "contribution_share", "channel:s mean:7 hdi_low:7 hdi_high:7", "shares",
       mean_hdi_sql("shares", "channel"))
def _(spark, sf):
    return X.contribution_share(contrib(spark, sf))


R.role_sql("spans", "", " UNION ALL ".join(
    f"SELECT '{n}' AS name, {lo} AS lo, {hi} AS hi" for n, (lo, hi) in WINDOWS.items()))
R.role_sql("window_draws", "contrib media spans", """
    SELECT name, channel, draw, c / cost AS value
    FROM (SELECT name, channel, draw, sum(contribution) AS c FROM contrib
          JOIN spans ON week BETWEEN lo AND hi GROUP BY 1, 2, 3) AS s
    JOIN (SELECT name, channel, sum(spend) AS cost FROM media JOIN spans ON week BETWEEN lo AND hi
          GROUP BY 1, 2) AS k USING (name, channel)""")


@query("X8", "window_roas", "window:s channel:s draw:i value:7", "window_draws",
       'SELECT name AS "window", channel, draw, value FROM window_draws')
def _(spark, sf):
    return X.window_roas(contrib(spark, sf), R.media_weekly(spark, sf), WINDOWS)


@query("X9", "counterfactual_window_roas", "draw:i channel:s value:7", "params media", f"""
    SELECT draw, channel, sum(CASE WHEN week >= 100 THEN beta * ({sat_sql('a', 'lam')}
             - {sat_sql('b', 'lam')}) ELSE 0 END)
             / max(cost) AS value
    FROM (SELECT *, {adstock_sql('x', 'alpha', 'draw, channel')} AS a,
                 {adstock_sql('cut', 'alpha', 'draw, channel')} AS b
          FROM (SELECT *, CASE WHEN week BETWEEN 100 AND 112 THEN 0 ELSE x END AS cut
                FROM (SELECT *, spend / max(spend) OVER (PARTITION BY channel) AS x,
                             sum(CASE WHEN week BETWEEN 100 AND 112 THEN spend END)
                               OVER (PARTITION BY channel) AS cost FROM media) AS m
                JOIN params USING (channel)) AS j) AS z GROUP BY 1, 2""")
def _(spark, sf):
    return X.counterfactual_window_roas(R.media_weekly(spark, sf), params(spark, sf), 100, 112)


R.role_sql("resid", "outcome", """
    SELECT week, y - avg(y) OVER () AS residual FROM outcome""")


@query("X10", "residual_spend_corr", "year:i channel:s correlation:6", "resid media", """
    SELECT week // 52 AS year, channel, corr(residual, spend) AS correlation
    FROM media JOIN resid USING (week) GROUP BY 1, 2 HAVING count(*) > 2""")
def _(spark, sf):
    y = R.media_outcome(spark, sf)
    resid = y.withColumn("m", y.agg(F.avg("y").alias("m")).scalar()).select(
        "week", (F.col("y") - F.col("m")).alias("residual"))
    return X.residual_spend_corr(resid, R.media_weekly(spark, sf))


@query("X11", "drift_ratio", "draw:i channel:s value:7", "contrib", """
    SELECT draw, channel, avg(contribution) FILTER (WHERE week BETWEEN 200 AND 299)
             / avg(contribution) FILTER (WHERE week BETWEEN 0 AND 99) AS value
    FROM contrib GROUP BY 1, 2""")
def _(spark, sf):
    return X.drift_ratio(contrib(spark, sf), (0, 99), (200, 299), "contribution")


R.role_sql("baselines", "roas", """
    SELECT draw, channel, 'own' AS baseline, value FROM roas
    UNION ALL SELECT draw, channel, 'trend', value * 1.05 + 0.01 FROM roas""")


@query("X12", "baseline_comparison", "channel:s baseline:s mean:7 hdi_low:7 hdi_high:7 truth:7"
       " abs_error:7 covered:b", "baselines roas_truth", f"""
    SELECT *, abs(mean - truth) AS abs_error, truth BETWEEN hdi_low AND hdi_high AS covered
    FROM ({mean_hdi_sql('baselines', 'channel, baseline')}) AS t JOIN roas_truth USING (channel)""")
def _(spark, sf):
    draws = roas(spark, sf)
    other = draws.withColumn("value", F.col("value") * 1.05 + 0.01)
    both = draws.withColumn("baseline", F.lit("own")).unionByName(
        other.withColumn("baseline", F.lit("trend")))
    return X.baseline_comparison(both, roas_truth(draws))


R.role_sql("calibrated", "roas", """
    SELECT draw, channel, value * 0.9 + 0.02 AS value FROM roas""")


@query("X13", "calibration_effect", "channel:s mean_before:7 mean_after:7 shift:7 width_before:7"
       " width_after:7 covered_before:b covered_after:b", "roas calibrated roas_truth", f"""
    SELECT channel, b.mean AS mean_before, a.mean AS mean_after, a.mean - b.mean AS shift,
           b.hdi_high - b.hdi_low AS width_before, a.hdi_high - a.hdi_low AS width_after,
           b.covered AS covered_before, a.covered AS covered_after
    FROM ({roas_table_sql('roas')}) AS b JOIN ({roas_table_sql('calibrated')}) AS a USING (channel)
    """)
def _(spark, sf):
    draws = roas(spark, sf)
    truth = roas_truth(draws)
    after = draws.withColumn("value", F.col("value") * 0.9 + 0.02)
    return X.calibration_effect(X.roas_table(draws, truth, 0.4), X.roas_table(after, truth, 0.4))


R.role_sql("folds", "outcome", """
    SELECT week, cv, CASE WHEN week < 104 + cv * 26 THEN 'train' ELSE 'test' END AS split
    FROM (SELECT week, unnest(range(0, ((SELECT max(week) FROM outcome) + 1 - 104 - 13) // 26 + 1))
            AS cv FROM outcome) AS f
    WHERE week < 104 + cv * 26 + 13""")


def folds(spark, sf):
    return X.time_slice_folds(R.media_outcome(spark, sf).select("week"), 104, 13, 26)


@query("X23", "time_slice_folds", "week:i cv:i split:s", "folds", "SELECT * FROM folds")
def _(spark, sf):
    return folds(spark, sf)


R.role_sql("forecasts", "folds outcome", """
    SELECT week, f.cv, split, y AS observed, m AS mean, m - 1.6 * s AS lower, m + 1.6 * s AS upper
    FROM folds AS f JOIN outcome USING (week)
    JOIN (SELECT cv, avg(y) AS m, stddev_samp(y) AS s FROM folds JOIN outcome USING (week)
          WHERE split = 'train' GROUP BY 1) AS t ON t.cv = f.cv""")


@query("X14", "cv_scorecard", "cv:s weeks:i mape:7 coverage:6", "forecasts", """
    SELECT CASE WHEN grouping(cv) = 1 THEN 'overall' ELSE CAST(cv AS VARCHAR) END AS cv,
           count(*) AS weeks, avg(abs(mean - observed) / observed) AS mape,
           avg(CASE WHEN observed BETWEEN lower AND upper THEN 1.0 ELSE 0 END) AS coverage
    FROM forecasts WHERE split = 'test' GROUP BY ROLLUP (cv)""")
def _(spark, sf):
    rows = folds(spark, sf).join(R.media_outcome(spark, sf), "week")
    fit = rows.filter("split = 'train'").groupBy("cv").agg(F.avg("y").alias("mean"),
                                                           F.stddev_samp("y").alias("s"))
    pred = rows.join(fit, "cv").select(
        F.col("cv").cast("string").alias("cv"), "split", "mean", F.col("y").alias("observed"),
        (F.col("mean") - 1.6 * F.col("s")).alias("lower"),
        (F.col("mean") + 1.6 * F.col("s")).alias("upper"))
    return X.cv_scorecard(pred)


@query("X15", "fold_roas", "cv:s channel:s mean:7 hdi_low:7 hdi_high:7", "window_draws",
       "SELECT name AS cv, * FROM (" + mean_hdi_sql("window_draws", "name, channel") + ") AS t")
def _(spark, sf):
    return X.fold_roas(contrib(spark, sf), R.media_weekly(spark, sf), WINDOWS)


@query("X16", "next_lift_test", "channel:s p_above:6 verdict:s verdict_before:s stable:b stake:2"
       " action:s next_test:b", "roas calibrated cost", """
    SELECT *, coalesce(channel = max_by(CASE WHEN action = 'test first' THEN channel END,
             CASE WHEN action = 'test first' THEN stake END) OVER (), false) AS next_test
    FROM (SELECT *, CASE WHEN verdict <> 'undecided' AND stable THEN 'act' ELSE 'test first' END
                      AS action
          FROM (SELECT channel, p_above, CASE WHEN p_above >= 0.9 THEN 'pays back' WHEN p_above <= 0.1
                         THEN 'does not pay back' ELSE 'undecided' END AS verdict,
                       CASE WHEN p_before >= 0.9 THEN 'pays back' WHEN p_before <= 0.1
                         THEN 'does not pay back' ELSE 'undecided' END AS verdict_before,
                       move <= 0.25 AS stable, cost AS stake
                FROM (SELECT channel, avg(CASE WHEN value > 0.2 THEN 1.0 ELSE 0 END) AS p_above
                      FROM calibrated GROUP BY 1) AS a
                JOIN (SELECT channel, avg(CASE WHEN value > 0.2 THEN 1.0 ELSE 0 END) AS p_before,
                             stddev_samp(value) / avg(value) AS move FROM roas GROUP BY 1) AS b
                USING (channel) JOIN cost USING (channel)) AS v) AS w""")
def _(spark, sf):
    before = roas(spark, sf)
    after = before.withColumn("value", F.col("value") * 0.9 + 0.02)
    moves = before.groupBy("channel").agg((F.stddev_samp("value") / F.avg("value")).alias("move"))
    stakes = R.media_weekly(spark, sf).groupBy("channel").agg(F.sum("spend").alias("stake"))
    return X.next_lift_test(before, after, moves, stakes, 0.2, 0.25)


def curves(spark, sf):
    return params(spark, sf).withColumns({
        "scale": F.lit(3000.0), "linear": F.lit(0.0), "lower": F.lit(100.0),
        "upper": F.lit(3000.0)})


# Bisection on the common marginal value, by recursion: sixty halvings.
ALLOC = """
    WITH RECURSIVE c AS (SELECT draw, channel, beta * lam / 6000 AS k, 6000 / lam AS width FROM params),
    step AS (
      SELECT 0 AS i, draw, CAST(0 AS DOUBLE) AS lo, max(k) AS hi FROM c GROUP BY draw
      UNION ALL
      SELECT i + 1, draw, CASE WHEN over THEN mid ELSE lo END, CASE WHEN over THEN hi ELSE mid END
      FROM (SELECT i, draw, lo, hi, mid, sum(least(3000, greatest(100,
                     CASE WHEN mid / k >= 1 THEN 0 ELSE width * atanh(sqrt(1 - mid / k)) END))) > 5000
                     AS over
            FROM (SELECT i, draw, lo, hi, (lo + hi) / 2 AS mid FROM step WHERE i < 60) AS s
            JOIN c USING (draw) GROUP BY i, draw, lo, hi, mid) AS h)
    SELECT draw, channel, least(3000, greatest(100, CASE WHEN (lo + hi) / 2 / k >= 1 THEN 0
             ELSE width * atanh(sqrt(1 - (lo + hi) / 2 / k)) END)) AS spend
    FROM step JOIN c USING (draw) WHERE i = 60"""


@query("X17", "optimal_allocation", "draw:i channel:s spend:2", "params", ALLOC)
def _(spark, sf):
    return X.optimal_allocation(curves(spark, sf), 5000.0, ["draw"])


PLANS = {"current": {c: 1000.0 for c in CHANNELS},
         "tilt": {"tv": 500.0, "search": 1500.0, "social": 1000.0, "display": 1500.0,
                  "email": 500.0},
         "cut": {c: 700.0 for c in CHANNELS}}
R.role_sql("plans", "", " UNION ALL ".join(
    f"SELECT '{p}' AS plan, '{c}' AS channel, {dbl(s)} AS x" for p, m in PLANS.items()
    for c, s in m.items()))
R.role_sql("plan_draws", "params plans", f"""
    SELECT draw, plan, value, value - max(CASE WHEN plan = 'current' THEN value END)
             OVER (PARTITION BY draw) AS gain
    FROM (SELECT draw, plan, sum(0.4 * beta * {sat_sql('x / 3000', 'lam')}) AS value
          FROM params JOIN plans USING (channel) GROUP BY 1, 2) AS v""")


def plan_draws(spark, sf):
    return X.plan_values(curves(spark, sf), PLANS, "current", 0.4)


@query("X18", "plan_values", "draw:i plan:s value:6 gain:6", "plan_draws",
       "SELECT * FROM plan_draws")
def _(spark, sf):
    return plan_draws(spark, sf)


@query("X18", "plan_summary", "plan:s mean_value:6 mean_gain:6 p_beats:6 low_quantile:6 hdi_low:6"
       " hdi_high:6", "plan_draws", f"""
    SELECT s.*, hdi_low, hdi_high
    FROM (SELECT plan, avg(value) AS mean_value, avg(gain) AS mean_gain,
                 avg(CASE WHEN gain > 0 THEN 1.0 ELSE 0 END) AS p_beats,
                 quantile_cont(value, 0.1) AS low_quantile FROM plan_draws GROUP BY 1) AS s
    JOIN ({hdi_sql('plan_draws', 'plan', 'gain')}) AS h USING (plan)""")
def _(spark, sf):
    return X.plan_summary(plan_draws(spark, sf))


@query("X19", "allocation_risk", "plan:s mean:6 quantile:6 cvar:6", "plan_draws", """
    SELECT plan, avg(value) AS mean, any_value(q) AS quantile,
           avg(value) FILTER (WHERE value <= q) AS cvar
    FROM (SELECT d.*, q FROM plan_draws AS d JOIN (SELECT plan, quantile_cont(value, 0.1) AS q
                                                   FROM plan_draws GROUP BY 1) AS c USING (plan)) AS j
    GROUP BY 1""")
def _(spark, sf):
    return X.allocation_risk(plan_draws(spark, sf))


MIX = {"tv": {"search": 0.5, "social": 0.3, "referral": 0.2}, "search": {"search": 1.0},
       "social": {"social": 0.8, "referral": 0.2}}


@query("X20", "media_clv", "media:s value:4", "rfm customers", f"""
    SELECT media, sum(weight * value) AS value
    FROM (SELECT acquisition_channel, avg(monetary_value * frequency / 1000) AS value
          FROM rfm JOIN customers USING (customer_id) GROUP BY 1) AS v
    JOIN ({' UNION ALL '.join(f"SELECT '{m}' AS media, '{a}' AS acquisition_channel, {w} AS weight"
                              for m, s in MIX.items() for a, w in s.items())}) AS x
    USING (acquisition_channel) GROUP BY 1""")
def _(spark, sf):
    from tallyfield.operators import purchases as P

    rows = [(m, a, w) for m, s in MIX.items() for a, w in s.items()]
    mapping = spark.createDataFrame(rows, "media string, acquisition_channel string, weight double")
    values = P.rfm(R.transactions(spark, sf), R.CAL_END).join(
        R.customers(spark, sf), "customer_id").groupBy("acquisition_channel").agg(
        F.avg(F.col("monetary_value") * F.col("frequency") / 1000).alias("value"))
    return X.media_clv(values, mapping)


@query("X21", "mmm_ols", "term:s estimate:3 se:3")
def _(spark, sf):
    return X.mmm_ols(R.media_weekly(spark, sf), R.media_outcome(spark, sf), CHANNELS,
                     ["price_index", "week"], 0.5, 3.0)


@query("X22", "mmm_grid_search", "alpha:2 lam:2 nrmse:5 rank:i")
def _(spark, sf):
    return X.mmm_grid_search(R.media_weekly(spark, sf), R.media_outcome(spark, sf), CHANNELS,
                             ["price_index", "week"], [0.1, 0.3, 0.5, 0.7], [1.0, 3.0, 6.0])
