"""Notification-policy queries on a dense user-day log made of events."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from tallyfield.functions.uniform import uniform
from tallyfield.operators import policy as N
from tallyfield.plans import roles as R
from tallyfield.plans.experiments import diff_sql
from tallyfield.plans.registry import query
from tallyfield.session import cut_lineage

Z = f"CAST({NormalDist().inv_cdf(0.975)} AS DOUBLE)"


def log(spark, sf):
    return R.user_days(spark, sf)


@query("N1", "segment_of", "segment:s users:i", "", """
    SELECT CASE WHEN n < 2 THEN 'low' WHEN n < 5 THEN 'mid' ELSE 'high' END AS segment,
           count(*) AS users
    FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'view' AND ts < TIMESTAMP '2024-01-08')
                   AS n FROM events GROUP BY 1) AS u GROUP BY 1""")
def _(spark, sf):
    early = (F.col("event_type") == "view") & (F.col("ts") < F.lit("2024-01-08").cast("timestamp_ntz"))
    per = R.table(spark, sf, "events").groupBy("user_id").agg(F.count_if(early).alias("n"))
    return per.groupBy(N.segment_of("n").alias("segment")).agg(F.count(F.lit(1)).alias("users"))


SENDS = """(SELECT 'sessions_per_send' AS outcome, session AS y, sent AS t FROM log WHERE eligible = 1
    UNION ALL SELECT 'margin_per_send', margin, sent FROM log WHERE eligible = 1) AS r"""


@query("N2", "incremental_per_send", "outcome:s estimate:6 se:6 lo:6 hi:6", "log",
       diff_sql(SENDS, "outcome"))
def _(spark, sf):
    return N.incremental_per_send(log(spark, sf))


@query("N3", "open_gap", "opened:i sends:i session:6 margin:6", "log", """
    SELECT opened, count(*) AS sends, avg(session) AS session, avg(margin) AS margin FROM log
    WHERE eligible = 1 AND sent = 1 GROUP BY 1""")
def _(spark, sf):
    return N.open_gap(log(spark, sf))


R.role_sql("fwd", "log", """
    SELECT *, CASE WHEN count(*) OVER w = 7 THEN sum(margin) OVER w END AS margin_fwd FROM log
    WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)""")


@query("N4", "forward_margin", "user_id:i day:i margin_fwd:4", "fwd", "SELECT * FROM fwd")
def _(spark, sf):
    return N.forward_margin(log(spark, sf))


@query("N5", "volume_curve", "arm:i users:i sends:6 open_rate:6 opens_week_1:6 opt_out:6 margin_7d:6"
       " margin:6", "per_user", """
    SELECT arm, count(*) AS users, avg(sends) AS sends,
           coalesce(sum(opens) / nullif(sum(sends), 0), 0) AS open_rate,
           avg(opens_7d) AS opens_week_1, avg(opted_out) AS opt_out, avg(margin_7d) AS margin_7d,
           avg(margin) AS margin FROM per_user GROUP BY 1""")
def _(spark, sf):
    return N.volume_curve(R.per_user(spark, sf))


@query("N6", "value_at_stake", "segment:s stake:6", "per_user", """
    SELECT segment, avg(margin) AS stake FROM per_user WHERE arm = 3 GROUP BY 1""")
def _(spark, sf):
    return N.value_at_stake(R.per_user(spark, sf))


@query("N7", "segment_uplift", "segment:s cate:6 se:6 lo:6 hi:6 p_optout:6 cost:6 send:b",
       "fwd per_user", f"""
    SELECT segment, cate, se, cate - {Z} * se AS lo, cate + {Z} * se AS hi, p_optout,
           p_optout * stake + 0.01 AS cost, cate > p_optout * stake + 0.01 AS send
    FROM (SELECT segment, avg(margin_fwd) FILTER (WHERE sent = 1)
                   - avg(margin_fwd) FILTER (WHERE sent = 0) AS cate,
                 sqrt(var_samp(margin_fwd) FILTER (WHERE sent = 1) / count(*) FILTER (WHERE sent = 1)
                   + var_samp(margin_fwd) FILTER (WHERE sent = 0) / count(*) FILTER (WHERE sent = 0))
                   AS se, avg(opted_out_today) FILTER (WHERE sent = 1) AS p_optout
          FROM fwd WHERE eligible = 1 AND margin_fwd IS NOT NULL GROUP BY 1) AS e
    JOIN (SELECT segment, avg(margin) AS stake FROM per_user GROUP BY 1) AS s USING (segment)""")
def _(spark, sf):
    rows = log(spark, sf)
    stake = N.user_rollup(rows).groupBy("segment").agg(F.avg("margin").alias("stake"))
    return N.segment_uplift(rows, stake, 0.01)


CONTEXT = """((CASE segment WHEN 'low' THEN 0 WHEN 'mid' THEN 1 ELSE 2 END) * 6
    + CASE WHEN fatigue_before >= 3 THEN 5 WHEN fatigue_before >= 2 THEN 4
           WHEN fatigue_before >= 1.5 THEN 3 WHEN fatigue_before >= 1 THEN 2
           WHEN fatigue_before >= 0.5 THEN 1 ELSE 0 END) * 3
    + CASE WHEN days_since_before >= 7 THEN 2 WHEN days_since_before >= 2 THEN 1 ELSE 0 END"""


@query("N8", "context_index", "context:i segment:s fatigue:s days_since:s user_days:i", "log", f"""
    SELECT context, ['low', 'mid', 'high'][context // 18 + 1] AS segment,
           ['<0.5', '0.5-1.0', '1.0-1.5', '1.5-2.0', '2.0-3.0', '>=3.0'][context // 3 % 6 + 1]
             AS fatigue, ['<2', '2-6', '>=7'][context % 3 + 1] AS days_since, user_days
    FROM (SELECT {CONTEXT} AS context, count(*) AS user_days FROM log GROUP BY 1) AS c""")
def _(spark, sf):
    rows = log(spark, sf).groupBy(N.context_index().alias("context")).agg(
        F.count(F.lit(1)).alias("user_days"))
    return N.context_labels(rows)


R.role_sql("model", "log", f"""
    SELECT s, a, s2, n, n / visits AS p, visits, r / visits AS reward
    FROM (SELECT s, a, s2, n, sum(n) OVER (PARTITION BY s, a) AS visits,
                 sum(r) OVER (PARTITION BY s, a) AS r
          FROM (SELECT s, a, s2, count(*) AS n, sum(r) AS r
                FROM (SELECT s, unnest(CASE WHEN s <> 54 THEN [action] WHEN action = 0 THEN [0, 1]
                                       ELSE [] END) AS a, s2, r
                      FROM (SELECT s, action, margin AS r, lead(s) OVER (PARTITION BY user_id
                                                                         ORDER BY day) AS s2
                            FROM (SELECT *, CASE WHEN eligible = 1 THEN {CONTEXT} ELSE 54 END AS s
                                  FROM log) AS l) AS d WHERE s2 IS NOT NULL) AS e
                GROUP BY 1, 2, 3) AS c) AS v""")


def model(spark, sf):
    return N.transition_model(log(spark, sf))


@query("N9", "transition_model", "s:i a:i s2:i n:i p:8 visits:i reward:8", "model",
       "SELECT * FROM model")
def _(spark, sf):
    return model(spark, sf)


# Value iteration by recursion, far beyond the sweep after which nothing moves.
R.role_sql("values_end", "model", """
    SELECT * FROM (
    WITH RECURSIVE pairs AS (SELECT s, count(DISTINCT a) AS arms FROM model GROUP BY 1),
    states AS (SELECT DISTINCT s FROM (SELECT s FROM model UNION ALL SELECT s2 FROM model) AS x),
    vi AS (
      SELECT 0 AS k, list(0.0::DOUBLE) AS v FROM range(0, 55) AS t
      UNION ALL
      SELECT k + 1, list(best ORDER BY s)
      FROM (SELECT k, g.s, coalesce(CASE WHEN max(arms) = 2 THEN max(q) ELSE greatest(max(q), 0) END, 0)
                     AS best
            FROM (SELECT k, unnest(range(0, 55)) AS s FROM vi WHERE k < 149) AS g
            LEFT JOIN (SELECT m.s, a, max(reward) + 0.8 * sum(p * v[s2 + 1]) AS q
                       FROM model AS m, vi WHERE vi.k < 149 GROUP BY 1, 2) AS q0 ON q0.s = g.s
            LEFT JOIN pairs ON pairs.s = g.s GROUP BY 1, 2) AS b GROUP BY k)
    SELECT v FROM vi WHERE k = 149) AS z""")


# both sides converge to about 1e-11; a value that ends in an exact 5 is first brought to nine decimals
@query("N10", "q_iteration", "s:i a:i q:5", "model values_end", """
    SELECT m.s, a, round(max(reward) + 0.8 * sum(p * v[s2 + 1]), 9) AS q FROM model AS m, values_end GROUP BY 1, 2
    """)
def _(spark, sf):
    return N.q_iteration(model(spark, sf), 0.8).withColumn("q", F.round("q", 9))


@query("N11", "greedy_policy", "s:i action:i", "model values_end", """
    SELECT s, coalesce(max_by(CASE WHEN visits >= 30 THEN a END,
                           CASE WHEN visits >= 30 THEN (round(q, 9), -a) END), 0) AS action
    FROM (SELECT m.s, a, max(visits) AS visits, max(reward) + 0.8 * sum(p * v[s2 + 1]) AS q
          FROM model AS m, values_end GROUP BY 1, 2) AS q GROUP BY 1""")
def _(spark, sf):
    triples = cut_lineage(model(spark, sf))
    return N.greedy_policy(N.q_iteration(triples, 0.8), triples, 30)


PENALTY = {"low": 5.0, "mid": 10.0, "high": 20.0}
R.role_sql("arms", "log", f"""
    SELECT {CONTEXT} AS context, action AS arm, count(*) AS n,
           sum(margin - opted_out_today * CASE segment WHEN 'low' THEN 5.0 WHEN 'mid' THEN 10.0
               ELSE 20.0 END) AS total FROM log WHERE eligible = 1 GROUP BY 1, 2""")


@query("N12", "arm_statistics", "context:i arm:i total:4 n:i", "arms", "SELECT * FROM arms")
def _(spark, sf):
    return N.arm_statistics(log(spark, sf), PENALTY)


def normal_sql(salt: str, *keys: str) -> str:
    return (f"sqrt(-2 * ln({R.sql_uniform(salt + '#1', *keys)} + {0.5 / 4294967296.0!r}::DOUBLE))"
            f" * cos(2 * pi() * {R.sql_uniform(salt + '#2', *keys)})")


@query("N13", "thompson_choose", "context:i arm:i draw:6", "arms", f"""
    SELECT context, max_by(arm, (draw, -arm)) AS arm, max(draw) AS draw
    FROM (SELECT k.context, k.arm, coalesce(total, 0) / (coalesce(n, 0) + 1)
                   + 3.0 / sqrt(coalesce(n, 0) + 1) * {normal_sql('thompson', 'k.context', 'k.arm')}
                   AS draw
          FROM (SELECT context, unnest([0, 1]) AS arm FROM (SELECT DISTINCT context FROM arms) AS c)
            AS k LEFT JOIN arms AS a ON a.context = k.context AND a.arm = k.arm) AS d GROUP BY 1""")
def _(spark, sf):
    return N.thompson_choose(N.arm_statistics(log(spark, sf), PENALTY), 3.0)


SUMMARY = """SELECT arm, count(*) AS users, avg(sends) AS sends_per_user,
    coalesce(sum(opens) / nullif(sum(sends), 0), 0) AS open_rate, avg(opted_out) AS opt_out,
    avg(margin_7d) AS margin_7d, avg(margin) AS margin, 1000 * avg(margin) AS margin_per_1000,
    stddev_samp(margin) / sqrt(count(*)) AS se_margin FROM per_user GROUP BY 1"""


@query("N14", "policy_summary", "arm:i users:i sends_per_user:6 open_rate:6 opt_out:6 margin_7d:6"
       " margin:6 margin_per_1000:4 se_margin:6", "per_user", SUMMARY)
def _(spark, sf):
    return N.policy_summary(R.per_user(spark, sf))


@query("N15", "paired_difference", "difference:6 se:6 lo:6 hi:6", "log", f"""
    SELECT d AS difference, se, d - {Z} * se AS lo, d + {Z} * se AS hi
    FROM (SELECT avg(a - b) AS d, stddev_samp(a - b) / sqrt(count(*)) AS se
          FROM (SELECT user_id, sum(CASE WHEN day < 15 THEN margin ELSE 0 END) AS a,
                       sum(CASE WHEN day >= 15 THEN margin ELSE 0 END) AS b FROM log GROUP BY 1)
            AS u) AS s""")
def _(spark, sf):
    halves = log(spark, sf).groupBy("user_id").agg(
        F.sum(F.when(F.col("day") < 15, F.col("margin")).otherwise(0.0)).alias("a"),
        F.sum(F.when(F.col("day") >= 15, F.col("margin")).otherwise(0.0)).alias("b"))
    return N.paired_difference(halves, "a", "b")


@query("N16", "guardrail_choice", "choice:i margin:6 best_any:i within:i", "per_user", f"""
    SELECT max_by(arm, margin) FILTER (WHERE opt_out <= 0.4) AS choice,
           max(margin) FILTER (WHERE opt_out <= 0.4) AS margin, max_by(arm, margin) AS best_any,
           count(*) FILTER (WHERE opt_out <= 0.4) AS within FROM ({SUMMARY}) AS s""")
def _(spark, sf):
    return N.guardrail_choice(N.policy_summary(R.per_user(spark, sf)), 0.4, "arm")


@query("N17", "user_rollup", "user_id:i segment:s sends:i opens:i sessions:i purchases:i margin:4"
       " margin_7d:4 opens_7d:i opted_out:i", "per_user", "SELECT * FROM per_user")
def _(spark, sf):
    return N.user_rollup(log(spark, sf))


@query("N17", "day_rollup", "day:i sends:i opens:i sessions:i margin:4 opt_outs:i active:i", "log", """
    SELECT *, (SELECT count(DISTINCT user_id) FROM log) - sum(opt_outs) OVER (ORDER BY day) AS active
    FROM (SELECT day, sum(sent) AS sends, sum(opened) AS opens, sum(session) AS sessions,
                 sum(margin) AS margin, sum(opted_out_today) AS opt_outs FROM log GROUP BY 1) AS d""")
def _(spark, sf):
    return N.day_rollup(log(spark, sf))


PIVOT = " ".join(f"{a}_{m}:6" for a in R.CADENCES for m in ("margin", "opt_out"))


@query("N18", "policy_by_segment", "segment:s " + PIVOT, "per_user", "SELECT segment, " + ", ".join(
    f'avg(margin) FILTER (WHERE arm = {a}) AS "{a}_margin",'
    f' avg(opted_out) FILTER (WHERE arm = {a}) AS "{a}_opt_out"' for a in R.CADENCES)
       + " FROM per_user GROUP BY 1")
def _(spark, sf):
    return N.policy_by_segment(R.per_user(spark, sf), R.CADENCES)


@query("N19", "same_day_effect", "user_days:i effect:6", "log", f"""
    SELECT count(*) AS user_days, avg(margin * 1.1 + {R.sql_uniform('po', 'user_id', 'day')} - margin)
             AS effect FROM log WHERE eligible = 1""")
def _(spark, sf):
    rows = log(spark, sf).withColumn(
        "if_send", F.col("margin") * 1.1 + uniform("po", "user_id", "day"))
    return N.same_day_effect(rows, "if_send", "margin")


@query("N20", "week_1_opens", "arm:i opens_week_1:6", "per_user", """
    SELECT arm, avg(opens_7d) AS opens_week_1 FROM per_user GROUP BY 1""")
def _(spark, sf):
    rows = log(spark, sf)
    return N.week_1_opens(rows, R.per_user(spark, sf).select("user_id", "arm"))
