"""Geo queries: nation x month sales, one region treated from the test start."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.operators import geo as G
from tallyfield.plans import roles as R
from tallyfield.plans.registry import query
from tallyfield.session import cut_lineage

GEOS = [f"NATION_{i}" for i in range(25)]
END = "2001-07-01"


@query("G1", "panel_wide", "date:d " + " ".join(f"{g}:2" for g in GEOS), "panel",
       "SELECT date, " + ", ".join(f"sum(sales) FILTER (WHERE geo = '{g}') AS {g}" for g in GEOS)
       + " FROM panel GROUP BY 1")
def _(spark, sf):
    return G.panel_wide(R.geo_panel(spark, sf), GEOS)


@query("G2", "geo_index", "date:d treated:i index:6", "panel", f"""
    SELECT date, treated, avg(sales / pre) AS index
    FROM (SELECT *, avg(CASE WHEN date < DATE '{R.TEST_START}' THEN sales END)
                      OVER (PARTITION BY geo) AS pre FROM panel) AS p GROUP BY 1, 2""")
def _(spark, sf):
    return G.geo_index(R.geo_panel(spark, sf), R.TEST_START)


def did_sql(src: str = "panel") -> str:
    return f"""
    SELECT delta AS log_lift, 100 * (exp(delta) - 1) AS lift_pct,
           w * (1 - exp(-delta)) AS incremental_sales,
           w * (1 - exp(-delta)) / n AS effect_per_geo_period,
           100 * (exp(t1 - t0) - 1) AS naive_lift_pct
    FROM (SELECT *, (t1 - t0) - (c1 - c0) AS delta
          FROM (SELECT avg(ln(sales)) FILTER (WHERE treated = 1 AND post = 1) AS t1,
                       avg(ln(sales)) FILTER (WHERE treated = 1 AND post = 0) AS t0,
                       avg(ln(sales)) FILTER (WHERE treated = 0 AND post = 1) AS c1,
                       avg(ln(sales)) FILTER (WHERE treated = 0 AND post = 0) AS c0,
                       sum(sales) FILTER (WHERE treated = 1 AND post = 1) AS w,
                       count(*) FILTER (WHERE treated = 1 AND post = 1) AS n FROM {src}) AS m) AS d"""


@query("G3", "did", "log_lift:7 lift_pct:6 incremental_sales:1 effect_per_geo_period:2"
       " naive_lift_pct:6", "panel", did_sql())
def _(spark, sf):
    return G.did(R.geo_panel(spark, sf), R.TEST_START, END)


@query("G4", "event_study", "date:d event:5", "panel", f"""
    SELECT date, 100 * (gap - avg(CASE WHEN date < DATE '{R.TEST_START}' THEN gap END) OVER ())
             AS event
    FROM (SELECT date, avg(ln(sales)) FILTER (WHERE treated = 1)
                       - avg(ln(sales)) FILTER (WHERE treated = 0) AS gap
          FROM panel GROUP BY 1) AS g""")
def _(spark, sf):
    return G.event_study(R.geo_panel(spark, sf), R.TEST_START)


def panel_once(spark, sf):
    """The small panel, written out: every fit reads it several times."""
    return cut_lineage(R.geo_panel(spark, sf))


# ---- synthetic control in SQL: pairs of weights are moved by exact line steps until no pair gains --------------------
def solved_sql(fits: str) -> str:
    """``fit, w`` of every row of ``fits(fit, g, c, open)``: Gram matrix, cross products, and which units may have a weight."""
    return f"""
    WITH RECURSIVE fits AS ({fits}),
    closest AS (
      SELECT *, list_transform(range(1, len(c) + 1), lambda x: CASE WHEN open[x] THEN g[x][x] - 2 * c[x] ELSE 1e300 END) AS far FROM fits),
    first AS (SELECT *, list_position(far, list_min(far)) AS i FROM closest),
    state AS (
      SELECT fit, 0 AS step, list_transform(range(1, len(c) + 1), lambda x: CASE WHEN x = i THEN 1.0::DOUBLE ELSE 0 END) AS w,
             list_transform(range(1, len(c) + 1), lambda x: g[x][i] - c[x]) AS slope, 1e300::DOUBLE AS gain
      FROM first
      UNION ALL
      SELECT fit, step + 1,
             list_transform(range(1, len(w) + 1), lambda x: w[x] + CASE WHEN x = i THEN t WHEN x = j THEN -t ELSE 0 END),
             list_transform(range(1, len(w) + 1), lambda x: slope[x] + t * (g[i][x] - g[j][x])), slope[j] - slope[i]
      FROM (SELECT *, least(w[j], (slope[j] - slope[i]) / (g[i][i] + g[j][j] - 2 * g[i][j])) AS t
            FROM (SELECT *, list_position(down, list_min(down)) AS i, list_position(up, list_max(up)) AS j
                  FROM (SELECT s.*, g, list_transform(range(1, len(w) + 1), lambda x: CASE WHEN open[x] THEN slope[x] ELSE 1e300 END) AS down,
                               list_transform(range(1, len(w) + 1), lambda x: CASE WHEN w[x] > 0 THEN slope[x] ELSE -1e300 END) AS up
                        FROM state AS s JOIN fits USING (fit) WHERE gain > 1e-14 AND step < 2000) AS a) AS b WHERE i <> j) AS d)
    SELECT fit, arg_max(w, step) AS w FROM state GROUP BY fit"""


def fits_sql(panel: str, name: str) -> None:
    """Roles ``name_series`` (unit, date, post, v) and ``name_weights`` (fit, unit, weight) of a panel."""
    R.role_sql(f"{name}_series", panel, f"""
    SELECT geo AS unit, date, post, sales AS v FROM {panel} WHERE treated = 0
    UNION ALL SELECT 'treated', date, post, avg(sales) FROM {panel} WHERE treated = 1 GROUP BY ALL""")
    R.role_sql(f"{name}_gram", f"{name}_series", f"""
    SELECT a.unit AS a, b.unit AS b, sum(a.v * b.v) / any_value(size) AS s
    FROM {name}_series AS a JOIN {name}_series AS b USING (date), (SELECT sum(v * v) AS size FROM {name}_series) AS z
    WHERE a.post = 0 GROUP BY 1, 2""")
    R.role_sql(f"{name}_weights", f"{name}_gram", f"""
    SELECT fit, unnest(u) AS unit, unnest(w) AS weight
    FROM ({solved_sql(f"""
      SELECT f.a AS fit, any_value(g) AS g, list(f.s ORDER BY f.b) AS c, list(f.a <> f.b ORDER BY f.b) AS open
      FROM {name}_gram AS f,
           (SELECT list(r ORDER BY a) AS g FROM (SELECT a, list(s ORDER BY b) AS r FROM {name}_gram
                                                WHERE a <> 'treated' AND b <> 'treated' GROUP BY a) AS h) AS q
      WHERE f.b <> 'treated' GROUP BY f.a""")}) AS solved,
      (SELECT list(DISTINCT a ORDER BY a) AS u FROM {name}_gram WHERE a <> 'treated') AS names""")
    R.role_sql(f"{name}_stats", f"{name}_weights {name}_series", f"""
    SELECT fit, sum(gap) FILTER (post = 1) / sum(synthetic) FILTER (post = 1) AS relative_effect,
           sqrt(avg(gap * gap) FILTER (post = 1)) / sqrt(avg(gap * gap) FILTER (post = 0)) AS rmspe_ratio,
           sqrt(avg(gap * gap) FILTER (post = 0)) / avg(v) FILTER (post = 0) AS pre_rmspe,
           sum(gap) FILTER (post = 1) AS gap_post, sum(synthetic) FILTER (post = 1) AS synthetic_post
    FROM (SELECT x.*, coalesce(y.v, 0) AS v, coalesce(y.v, 0) - synthetic AS gap
          FROM (SELECT fit, date, post, sum(weight * v) AS synthetic FROM {name}_weights JOIN {name}_series USING (unit) GROUP BY 1, 2, 3) AS x
          LEFT JOIN {name}_series AS y ON x.fit = y.unit AND x.date = y.date) AS gaps GROUP BY fit""")


R.role_sql("leaked_panel", "panel", """
    SELECT * REPLACE (CASE WHEN geo = 'NATION_1' THEN 0 ELSE treated END AS treated) FROM panel""")
fits_sql("panel", "sc")
fits_sql("leaked_panel", "leak")


def readout_sql(name: str, panel: str) -> str:
    return f"""
    SELECT gap_post * n_treated AS incremental, relative_effect, rmspe_ratio, pre_rmspe, n_treated,
           synthetic_post * n_treated AS synthetic_post_total
    FROM {name}_stats, (SELECT count(DISTINCT geo) AS n_treated FROM {panel} WHERE treated = 1) AS n WHERE fit = 'treated'"""


@query("G5", "sc_weights", "fit:s unit:s weight:4", "sc_weights", "SELECT * FROM sc_weights WHERE fit = 'treated'")
def _(spark, sf):
    return G.sc_weights(cut_lineage(G.unit_series(R.geo_panel(spark, sf))))


@query("G6", "synthetic_control", "incremental:0 relative_effect:4 rmspe_ratio:3 pre_rmspe:4"
       " n_treated:i synthetic_post_total:0", "sc_stats", readout_sql("sc", "panel"))
def _(spark, sf):
    return G.synthetic_control(panel_once(spark, sf))


@query("G7", "placebo_in_space", "fit:s relative_effect:4 rmspe_ratio:3 pre_rmspe:4", "sc_stats", "SELECT * FROM sc_stats")
def _(spark, sf):
    return G.placebo_in_space(panel_once(spark, sf))


PVALUE = """
    SELECT count(*) AS placebos, any_value(m.rmspe_ratio) AS statistic,
           (1 + count(*) FILTER (o.rmspe_ratio >= m.rmspe_ratio)) / (1.0 + count(*)) AS p_value
    FROM sc_stats AS o, (SELECT rmspe_ratio FROM sc_stats WHERE fit = 'treated') AS m WHERE fit <> 'treated'"""


@query("G7", "permutation_pvalue", "placebos:i statistic:3 p_value:6", "sc_stats", PVALUE)
def _(spark, sf):
    return G.permutation_pvalue(G.placebo_in_space(panel_once(spark, sf)))


R.role_sql("window_lifts", "panel", f"""
    WITH sales AS (
      SELECT CASE WHEN treated = 1 THEN 'treated' ELSE geo END AS unit, t, sum(sales) AS v
      FROM (SELECT *, dense_rank() OVER (ORDER BY date) - 1 AS t FROM panel WHERE post = 0) AS p GROUP BY 1, 2),
    starts AS (SELECT unnest(range(26, (SELECT max(t) + 1 - 10 + 1 FROM sales))) AS start),
    means AS (SELECT start, unit, sum(v) FILTER (t < start) / start AS m, coalesce(sum(v) FILTER (t >= start AND t < start + 10), 0) AS within
              FROM sales, starts GROUP BY 1, 2),
    kept AS (SELECT * FROM means WHERE m > 0),
    series AS (SELECT start, unit, t, v / m AS i FROM sales JOIN kept USING (unit) WHERE t < start),
    gram AS (SELECT a.start, a.unit AS a, b.unit AS b, sum(a.i * b.i) / any_value(a.start) AS s
             FROM series AS a JOIN series AS b USING (start, t) GROUP BY 1, 2, 3),
    square AS (SELECT start, list(r ORDER BY a) AS g FROM (
                 SELECT start, a, list(s ORDER BY b) AS r FROM gram WHERE a <> 'treated' AND b <> 'treated' GROUP BY 1, 2) AS q GROUP BY 1),
    weights AS (SELECT fit AS start, w FROM ({solved_sql("""
      SELECT start AS fit, any_value(g) AS g, list(s ORDER BY b) AS c, list(true ORDER BY b) AS open
      FROM gram JOIN square USING (start) WHERE a = 'treated' AND b <> 'treated' GROUP BY start""")}) AS x),
    totals AS (SELECT start, any_value(m) FILTER (unit = 'treated') AS m, any_value(within) FILTER (unit = 'treated') AS y,
                      list(CAST(within / m AS DOUBLE) ORDER BY unit) FILTER (unit <> 'treated') AS x FROM kept GROUP BY 1)
    SELECT start, 100 * extra / (y - extra) AS lift_pct
    FROM (SELECT start, y, y - m * list_inner_product(x, w) AS extra FROM totals JOIN weights USING (start)) AS e""")


@query("G8", "placebo_in_time", "start:i lift_pct:3", "window_lifts", "SELECT * FROM window_lifts")
def _(spark, sf):
    return G.placebo_in_time(panel_once(spark, sf))


@query("G8", "placebo_interval", "lift_low:3 lift_high:3", "window_lifts", """
    SELECT 2 - quantile_cont(lift_pct, 0.95) AS lift_low, 2 - quantile_cont(lift_pct, 0.05) AS lift_high FROM window_lifts""")
def _(spark, sf):
    return G.placebo_interval(G.placebo_in_time(panel_once(spark, sf)), 2.0)


def _windows_sql(panel: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    return f"""
    SELECT {keys}start, (avg(l) FILTER (WHERE treated = 1 AND t >= start)
             - avg(l) FILTER (WHERE treated = 1 AND t < start))
             - (avg(l) FILTER (WHERE treated = 0 AND t >= start)
             - avg(l) FILTER (WHERE treated = 0 AND t < start)) AS log_lift
    FROM (SELECT p.*, start FROM (SELECT *, ln(sales) AS l, dense_rank() OVER (ORDER BY date) - 1 AS t
                                  FROM {panel} AS q WHERE post = 0) AS p,
                 (SELECT unnest(range(26, (SELECT count(DISTINCT date) FROM panel WHERE post = 0)
                                      - 10 + 1)) AS start) AS s
          WHERE t <= start + 9) AS w GROUP BY {keys}start"""


@query("G9", "geo_power", "windows:i lift:2 power:6", "panel", f"""
    WITH w AS ({_windows_sql('panel')}), q AS (
      SELECT quantile_cont(100 * (exp(log_lift) - 1), 0.95) AS bar FROM w)
    SELECT count(*) AS windows, lift, avg(CASE WHEN 100 * (exp(log_lift) * (1 + lift / 100) - 1) > bar
             THEN 1.0 ELSE 0 END) AS power
    FROM w, q, (SELECT CAST(unnest([1, 2, 4, 8]) AS DOUBLE) AS lift) AS l GROUP BY lift""")
def _(spark, sf):
    return G.geo_power(R.geo_panel(spark, sf), [1, 2, 4, 8])


@query("G10", "lift_test_row", "channel:s x:2 delta_x:4 delta_y:0 sigma:0", "sc_stats", """
    SELECT 'search' AS channel, 5000 AS x, 24000 / 2.4 AS delta_x, gap_post * 5 / 2.4 AS delta_y, sd * synthetic_post * 5 / 2.4 AS sigma
    FROM sc_stats, (SELECT stddev_samp(relative_effect) AS sd FROM sc_stats, (
                      SELECT median(pre_rmspe) AS m FROM sc_stats WHERE fit <> 'treated') AS q
                    WHERE fit <> 'treated' AND pre_rmspe <= 2 * m) AS d
    WHERE fit = 'treated'""")
def _(spark, sf):
    stats = G.placebo_in_space(panel_once(spark, sf))
    return G.lift_test_row(stats, "treated", 5, 0.2, 12, "search", 5000.0, 24000.0)


@query("G11", "contaminated_controls", "pool:s incremental:0 relative_effect:4 rmspe_ratio:3", "sc_stats leak_stats leaked_panel", f"""
    SELECT 'clean' AS pool, * FROM ({readout_sql("sc", "panel")}) AS a
    UNION ALL SELECT 'contaminated', * FROM ({readout_sql("leak", "leaked_panel")}) AS b""")
def _(spark, sf):
    return G.contaminated_controls(panel_once(spark, sf), "NATION_1")


CANDIDATES = {f"region {r}": [f"NATION_{i}" for i in range(25) if i % 5 == r] for r in range(5)}


@query("G12", "market_candidates", "candidate:s placebo_bias:6 placebo_sd:6 windows:i lift:2 power:6",
       "panel", f"""
    WITH c AS (SELECT 'region ' || r AS candidate, date, geo, sales, post,
                      CASE WHEN region = r THEN 1 ELSE 0 END AS treated
               FROM panel, (SELECT unnest(range(5)) AS r) AS x),
         w AS ({_windows_sql('c', 'candidate')}), q AS (
      SELECT candidate, quantile_cont(100 * (exp(log_lift) - 1), 0.95) AS bar FROM w GROUP BY 1)
    SELECT candidate, avg(log_lift) AS placebo_bias, stddev_samp(log_lift) AS placebo_sd,
           count(*) AS windows, 4.0 AS lift,
           avg(CASE WHEN 100 * (exp(log_lift) * 1.04 - 1) > bar THEN 1.0 ELSE 0 END) AS power
    FROM w JOIN q USING (candidate) GROUP BY candidate""")
def _(spark, sf):
    return G.market_candidates(R.geo_panel(spark, sf), CANDIDATES, 4.0)
