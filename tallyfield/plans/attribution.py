"""Attribution queries: a journey is one user's calendar day of non-purchase events."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from tallyfield.functions.uniform import uniform
from tallyfield.operators import attribution as A
from tallyfield.plans import roles as R
from tallyfield.plans.registry import query
from tallyfield.session import cut_lineage

CHANNELS = list(R.CHANNELS)
CH = "['" + "', '".join(CHANNELS) + "']"


def made(spark, sf):
    return A.journeys(R.touches(spark, sf), R.conversions(spark, sf), ["user_id", "day"])


def counts(spark, sf):
    """Distinct paths with their counts, written out once: several methods read them."""
    return cut_lineage(A.path_counts(made(spark, sf)))


def facts(spark, sf):
    return A.journey_facts(R.touches(spark, sf), R.conversions(spark, sf), ["user_id", "day"],
                           CHANNELS)


def chain(spark, sf):
    return A.touch_transitions(R.touches(spark, sf), facts(spark, sf), ["user_id", "day"])


@query("T1", "journeys", "user_id:i day:d path:s converted:i", "journeys", """
    SELECT user_id, day, array_to_string(path, ' > ') AS path, converted FROM journeys""")
def _(spark, sf):
    return made(spark, sf).withColumn("path", F.array_join("path", " > "))


@query("T2", "position_table", "channel:s share:6 opens:6 closes:6", "journeys", f"""
    SELECT c AS channel, avg(CASE WHEN has THEN 1.0 ELSE 0 END) AS share,
           avg(CASE WHEN path[1] = c THEN 1.0 ELSE 0 END) FILTER (WHERE has AND multi) AS opens,
           avg(CASE WHEN path[len(path)] = c THEN 1.0 ELSE 0 END) FILTER (WHERE has AND multi)
             AS closes
    FROM (SELECT path, c, list_contains(path, c) AS has, len(list_distinct(path)) >= 2 AS multi
          FROM journeys, (SELECT unnest({CH}) AS c) AS k) AS j GROUP BY 1""")
def _(spark, sf):
    return A.position_table(facts(spark, sf), CHANNELS)


CREDIT = {
    "last": "SELECT path[len(path)] AS channel, 1.0 AS credit FROM journeys WHERE converted = 1",
    "first": "SELECT path[1] AS channel, 1.0 AS credit FROM journeys WHERE converted = 1",
    "linear": "SELECT channel, 1.0 / CAST(n AS DOUBLE) AS credit FROM touch_rows"
              " WHERE converted = 1"}
R.role_sql("heuristics", "journeys touch_rows", " UNION ALL ".join(f"""
    SELECT '{m}' AS method, c AS channel, coalesce(sum(credit), 0) AS credit
    FROM (SELECT unnest({CH}) AS c) AS k LEFT JOIN ({sql}) AS r ON r.channel = c GROUP BY 2"""
                                                                   for m, sql in CREDIT.items()))


@query("T3", "heuristic_credit", "method:s channel:s credit:6", "heuristics",
       "SELECT * FROM heuristics")
def _(spark, sf):
    return A.all_heuristics(facts(spark, sf), CHANNELS)


@query("T1", "touch_positions", "user_id:i day:d position:i channel:s", "touch_rows", """
    SELECT user_id, day, pos AS position, channel FROM touch_rows""")
def _(spark, sf):
    return A.touch_positions(R.touches(spark, sf), ["user_id", "day"])


R.role_sql("chain", "journeys", """
    SELECT *, n / sum(n) OVER (PARTITION BY s) AS p
    FROM (SELECT s, s2, CAST(count(*) AS DOUBLE) AS n
          FROM (SELECT unnest(list_concat(['start'], path)) AS s,
                       unnest(list_concat(path, [CASE WHEN converted = 1 THEN 'conv' ELSE 'null' END]))
                         AS s2 FROM journeys) AS m GROUP BY 1, 2
          UNION ALL SELECT 'conv', 'conv', 1 UNION ALL SELECT 'null', 'null', 1) AS c""")


@query("T4", "transition_matrix", "s:s s2:s n:1 p:7", "chain", "SELECT * FROM chain")
def _(spark, sf):
    return chain(spark, sf)


@query("T4", "transition_matrix_of_paths", "s:s s2:s n:1 p:7", "chain", "SELECT * FROM chain")
def _(spark, sf):
    return A.transition_matrix(counts(spark, sf))


# Absorption by iterating the chain: mass still moving after 400 steps is below 1e-12.
def absorbed_sql(removed: str) -> str:
    """Conversion probability after sending one channel ('' for none) to null."""
    return f"""
    WITH RECURSIVE q AS (SELECT s, s2, p FROM chain WHERE s NOT IN ('conv', 'null', '{removed}')),
    walk AS (SELECT 0 AS k, 'start' AS s, CAST(1 AS DOUBLE) AS mass
             UNION ALL
             SELECT k + 1, q.s2, sum(mass * p) FROM walk JOIN q ON q.s = walk.s
             WHERE k < 400 GROUP BY 1, 2)
    SELECT sum(mass) AS p FROM walk WHERE s = 'conv'"""


@query("T5", "conversion_probability", "conversion_probability:7", "chain",
       f"SELECT p AS conversion_probability FROM ({absorbed_sql('')}) AS a")
def _(spark, sf):
    effects = A.markov(chain(spark, sf), CHANNELS)
    return effects.agg(F.max("conversion_probability").alias("conversion_probability"))


R.role_sql("removal", "chain", " UNION ALL ".join(
    f"SELECT '{c}' AS channel, 1 - (SELECT p FROM ({absorbed_sql(c)}) AS x)"
    f" / (SELECT p FROM ({absorbed_sql('')}) AS y) AS removal_effect" for c in CHANNELS))


@query("T6", "removal_effects", "channel:s removal_effect:7", "removal", "SELECT * FROM removal")
def _(spark, sf):
    return A.markov(chain(spark, sf), CHANNELS)


R.role_sql("markov", "removal journeys", """
    SELECT channel, (SELECT sum(converted) FROM journeys) * removal_effect
             / sum(removal_effect) OVER () AS credit FROM removal""")


@query("T7", "markov_credit", "channel:s credit:5", "markov", "SELECT * FROM markov")
def _(spark, sf):
    effects = A.markov(chain(spark, sf), CHANNELS)
    return A.markov_credit(effects, A.converted_total(facts(spark, sf)))


R.role_sql("coalitions", "journeys", """
    SELECT array_to_string(channels, ' + ') AS "set", channels, len(channels) AS size,
           count(*) AS journeys, sum(converted) AS conversions, avg(converted) AS rate
    FROM (SELECT list_sort(list_distinct(path)) AS channels, converted FROM journeys) AS j
    GROUP BY channels""")


@query("T8", "coalition_table", "set:s size:i journeys:i conversions:i rate:7", "coalitions",
       "SELECT * FROM coalitions")
def _(spark, sf):
    return A.coalition_table(facts(spark, sf))


R.role_sql("shapley", "coalitions", f"""
    SELECT c AS channel, coalesce(sum(conversions * part * v / rate), 0) AS credit
    FROM (SELECT unnest({CH}) AS c) AS k LEFT JOIN (
      SELECT s.*, u.rate AS v, unnest(s.channels) AS member, u.channels AS inside,
             u.size AS us FROM coalitions AS s JOIN coalitions AS u
        ON list_has_all(s.channels, u.channels) WHERE s.conversions > 0) AS x ON member = c
    CROSS JOIN LATERAL (SELECT CASE WHEN list_contains(inside, member)
        THEN CAST(factorial(CAST(us - 1 AS INT)) * factorial(CAST(size - us AS INT)) AS DOUBLE)
             / CAST(factorial(CAST(size AS INT)) AS DOUBLE)
        ELSE -CAST(factorial(CAST(us AS INT)) * factorial(CAST(greatest(size - us - 1, 0) AS INT))
             AS DOUBLE) / CAST(factorial(CAST(size AS INT)) AS DOUBLE) END AS part) AS w
    GROUP BY 1""")


@query("T9", "shapley_credit", "channel:s credit:6", "shapley", "SELECT * FROM shapley")
def _(spark, sf):
    return A.shapley_credit(A.coalition_table(facts(spark, sf)), CHANNELS)


@query("T10", "shapley_count_based", "channel:s credit:6", "coalitions", """
    SELECT channel, sum(conversions / size) AS credit
    FROM (SELECT unnest(channels) AS channel, conversions, size FROM coalitions) AS c GROUP BY 1""")
def _(spark, sf):
    return A.shapley_count_based(A.coalition_table(facts(spark, sf)), CHANNELS)


R.role_sql("credit", "heuristics markov shapley", """
    SELECT * FROM heuristics UNION ALL SELECT 'markov', * FROM markov
    UNION ALL SELECT 'shapley', * FROM shapley""")
R.role_sql("incremental", "credit", f"""
    SELECT channel, 1 + {R.sql_uniform('inc', 'channel')} AS incremental
    FROM (SELECT DISTINCT channel FROM credit) AS c""")


@query("T11", "credit_vs_truth", "method:s tvd:6 largest_gap_channel:s largest_gap:6",
       "credit incremental", """
    SELECT method, 0.5 * sum(abs(gap)) AS tvd,
           min_by(channel, (-round(abs(gap), 12), channel)) AS largest_gap_channel,
           min_by(gap, (-round(abs(gap), 12), channel)) AS largest_gap
    FROM (SELECT method, channel, credit / sum(credit) OVER (PARTITION BY method) - t AS gap
          FROM credit JOIN (SELECT channel, incremental / sum(incremental) OVER () AS t
                            FROM incremental) AS i USING (channel)) AS g GROUP BY 1""")
def _(spark, sf):
    credit = cut_lineage(A.all_methods(counts(spark, sf), CHANNELS))
    truth = credit.select("channel").distinct().withColumn(
        "incremental", 1 + uniform("inc", "channel"))
    return A.credit_vs_truth(credit, truth)


B = 200
R.role_sql("weights", "journeys", f"""
    SELECT path, converted, b, count(*) FILTER (WHERE u >= cdf) AS w
    FROM (SELECT path, converted, b, i, {R.sql_uniform('journeys', "array_to_string(path, '>')",
                                                       'converted', 'b', 'i')} AS u,
                 sum(exp(-m + k * ln(m) - lgamma(k + 1))) OVER (PARTITION BY path, converted, b, i
                                                                ORDER BY k) AS cdf
          FROM (SELECT *, unnest(range(0, CAST(m + 12 * sqrt(m) + 20 AS BIGINT) + 1)) AS k
                FROM (SELECT *, least(500, n - i * 500) AS m
                      FROM (SELECT *, unnest(range(0, CAST(floor((n - 1) / 500) AS BIGINT) + 1)) AS i
                            FROM (SELECT path, converted, CAST(count(*) AS DOUBLE) AS n,
                                         unnest(range(1, {B + 1})) AS b
                                  FROM journeys GROUP BY 1, 2) AS p) AS p1) AS p2) AS q) AS r
    GROUP BY path, converted, b""")


R.role_sql("boot_heuristics", "weights", f"""
    SELECT b, method, c AS channel, coalesce(sum(credit) FILTER (WHERE channel = c), 0) AS credit
    FROM (SELECT b, 'last' AS method, path[len(path)] AS channel, w AS credit FROM weights
          WHERE converted = 1
          UNION ALL SELECT b, 'first', path[1], w FROM weights WHERE converted = 1
          UNION ALL SELECT b, 'linear', unnest(path), CAST(w AS DOUBLE) / len(path) FROM weights
          WHERE converted = 1) AS r, (SELECT unnest({CH}) AS c) AS k GROUP BY 1, 2, 3""")


@query("T12", "bootstrap_heuristic_credit", "b:i method:s channel:s credit:5", "boot_heuristics", "SELECT * FROM boot_heuristics")
def _(spark, sf):
    drawn = A.path_facts(A.resampled_counts(counts(spark, sf), B), CHANNELS)
    return A.all_heuristics(drawn, CHANNELS, ["b"], "w")


# every resample's chain is walked with each channel sent to null, and with none
R.role_sql("boot_markov", "weights", f"""
    WITH RECURSIVE chain AS (
      SELECT b, s, s2, sum(w) / sum(sum(w)) OVER (PARTITION BY b, s) AS p
      FROM (SELECT b, w, unnest(list_concat(['start'], path)) AS s,
                   unnest(list_concat(path, [CASE WHEN converted = 1 THEN 'conv' ELSE 'null' END])) AS s2 FROM weights) AS m
      GROUP BY b, s, s2 HAVING sum(w) > 0),
    walk AS (
      SELECT DISTINCT b, removed, 0 AS k, 'start' AS s, CAST(1 AS DOUBLE) AS mass
      FROM chain, (SELECT unnest(list_concat([''], {CH})) AS removed) AS r
      UNION ALL
      SELECT walk.b, removed, k + 1, chain.s2, sum(mass * p) FROM walk JOIN chain ON chain.b = walk.b AND chain.s = walk.s
      WHERE k < 400 AND mass > 1e-14 AND walk.s <> removed GROUP BY 1, 2, 3, 4),
    reached AS (SELECT b, removed, coalesce(sum(mass) FILTER (s = 'conv'), 0) AS p FROM walk GROUP BY 1, 2),
    effects AS (SELECT r.b, r.removed AS channel, 1 - r.p / a.p AS effect
                FROM reached AS r JOIN reached AS a ON a.b = r.b AND a.removed = '' WHERE r.removed <> ''),
    won AS (SELECT b, sum(w) FILTER (converted = 1) AS conversions FROM weights GROUP BY b)
    SELECT b, channel, conversions * effect / sum(effect) OVER (PARTITION BY b) AS credit FROM effects JOIN won USING (b)""")
R.role_sql("boot_coalitions", "weights", """
    SELECT b, channels, len(channels) AS size, sum(w) AS journeys, coalesce(sum(w) FILTER (converted = 1), 0) AS conversions,
           coalesce(sum(w) FILTER (converted = 1), 0) / sum(w) AS rate
    FROM (SELECT b, w, converted, list_sort(list_distinct(path)) AS channels FROM weights) AS j GROUP BY b, channels HAVING sum(w) > 0""")
# a subset that a resample lacks has value 0
R.role_sql("boot_shapley", "boot_coalitions", f"""
    SELECT b, c AS channel, coalesce(sum(conversions * part * v / rate) FILTER (member = c), 0) AS credit
    FROM (SELECT s.b, s.size, s.conversions, s.rate, u.rate AS v, unnest(s.channels) AS member, u.channels AS inside, u.size AS us
          FROM boot_coalitions AS s JOIN boot_coalitions AS u ON s.b = u.b AND list_has_all(s.channels, u.channels)
          WHERE s.conversions > 0) AS x, (SELECT unnest({CH}) AS c) AS k
    CROSS JOIN LATERAL (SELECT CASE WHEN list_contains(inside, member)
        THEN CAST(factorial(CAST(us - 1 AS INT)) * factorial(CAST(size - us AS INT)) AS DOUBLE)
             / CAST(factorial(CAST(size AS INT)) AS DOUBLE)
        ELSE -CAST(factorial(CAST(us AS INT)) * factorial(CAST(greatest(size - us - 1, 0) AS INT))
             AS DOUBLE) / CAST(factorial(CAST(size AS INT)) AS DOUBLE) END AS part) AS w
    GROUP BY 1, 2""")
R.role_sql("boot_credit", "boot_heuristics boot_markov boot_shapley", """
    SELECT b, method, channel, credit FROM boot_heuristics UNION ALL SELECT b, 'markov', channel, credit FROM boot_markov
    UNION ALL SELECT b, 'shapley', channel, credit FROM boot_shapley""")


@query("T12", "bootstrap_credit", "b:i method:s channel:s credit:4", "boot_credit", "SELECT * FROM boot_credit")
def _(spark, sf):
    return A.bootstrap_credit(counts(spark, sf), CHANNELS, B, absent=0.0)


SPEND = {"click": 900.0, "error": 300.0, "signup": 700.0, "view": 500.0}


@query("T13", "cost_per_credit", "method:s channel:s credit:4 cost:5 lo:4 hi:4 cheapest:b", "boot_credit credit", f"""
    WITH spend AS (SELECT * FROM (VALUES {', '.join(f"('{c}', CAST({v} AS DOUBLE))" for c, v in SPEND.items())}) AS v(channel, spend)),
    ends AS (SELECT method, channel, quantile_cont(spend / credit, 0.025) AS lo, quantile_cont(spend / credit, 0.975) AS hi
             FROM boot_credit JOIN spend USING (channel) WHERE credit <> 0 GROUP BY 1, 2)
    SELECT *, coalesce(row_number() OVER (PARTITION BY method ORDER BY channel = 'error', cost, channel) = 1 AND channel <> 'error', false) AS cheapest
    FROM (SELECT method, channel, credit, CASE WHEN credit <> 0 THEN spend / credit END AS cost, lo, hi
          FROM credit JOIN spend USING (channel) LEFT JOIN ends USING (method, channel)) AS c""")
def _(spark, sf):
    paths = counts(spark, sf)
    boot = cut_lineage(A.bootstrap_credit(paths, CHANNELS, B, absent=0.0))
    return A.cost_per_credit(boot, A.all_methods(paths, CHANNELS), SPEND,
                             ["click", "signup", "view"])


ZP = NormalDist().inv_cdf(0.975) + NormalDist().inv_cdf(0.8)


@query("T14", "holdout_mde", "channel:s reached:i rate:6 mde:7 detectable_conversions:4 break_even:4"
       " margin_at_risk:4 test_first:b", "journeys markov", f"""
    SELECT 'click' AS channel, reached, rate, mde, mde * reached AS detectable_conversions,
           900.0 / 9.0 AS break_even,
           0.2 * 9.0 * (SELECT credit FROM markov WHERE channel = 'click') AS margin_at_risk,
           mde * reached < 900.0 / 9.0 AS test_first
    FROM (SELECT *, CAST({ZP} AS DOUBLE) * sqrt(rate * (1 - rate)
             * (1 / (reached - round_even(0.2 * reached, 0)) + 1 / round_even(0.2 * reached, 0))) AS mde
          FROM (SELECT CAST(count(*) AS DOUBLE) AS reached, avg(converted) AS rate FROM journeys
                WHERE list_contains(path, 'click')) AS r) AS m""")
def _(spark, sf):
    rows = cut_lineage(facts(spark, sf))
    credit = A.markov_credit(A.markov(chain(spark, sf), CHANNELS), A.converted_total(rows))
    return A.holdout_mde(rows, credit, "click", 900.0, 0.2, 9.0)
