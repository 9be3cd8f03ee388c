"""How the test tables play the inputs of the operators.

Each role exists twice: a Spark function of (spark, sf_dir) and a SQL CTE over the same tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfield.functions.uniform import uniform

CAL_END = "2000-07-31"
HOLD_END = "2001-07-30"  # 52 weeks later
LOG_END = "2001-08-01"
TEST_START = "2000-08-01"  # first month of the geo test
ONCE = {"chain", "model"}  # CTEs a recursion reads at every step
ROLE_SQL: dict[str, tuple[tuple[str, ...], str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def role_sql(name: str, deps: str, sql: str) -> None:
    ROLE_SQL[name] = (tuple(deps.split()), sql)


def sql_with(names: Sequence[str], body: str) -> str:
    """``body`` behind the CTEs it needs, dependencies first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in ROLE_SQL[name][0]:
            visit(dep)
        ordered.append(name)

    for n in names:
        visit(n)
    if not ordered:
        return body
    ctes = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in ONCE else ''}({ROLE_SQL[n][1]})"
                       for n in ordered)
    return f"WITH {ctes}\n{body}"


def sql_uniform(salt: str, *keys: str) -> str:
    text = " || '|' || ".join([f"'{salt}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) / 4294967296.0)"


# ---- purchase log: orders -----------------------------------------------------------------
def transactions(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("amount"))


role_sql("tx", "", """
    SELECT o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS date, o_totalprice AS amount
    FROM orders""")
role_sql("days", "tx", """
    SELECT customer_id, date AS purchase_date, sum(amount) AS day_amount
    FROM tx GROUP BY 1, 2""")
role_sql("rfm", "days", f"""
    SELECT customer_id, CAST(n - 1 AS DOUBLE) AS frequency, (b - a) / 7.0 AS recency,
           (DATE '{CAL_END}' - a) / 7.0 AS "T",
           CASE WHEN n = 1 THEN 0 ELSE (total - opening) / (n - 1) END AS monetary_value
    FROM (SELECT customer_id, count(*) AS n, min(purchase_date) AS a, max(purchase_date) AS b,
                 sum(day_amount) AS total, min_by(day_amount, purchase_date) AS opening
          FROM days WHERE purchase_date <= DATE '{CAL_END}' GROUP BY 1) AS per""")
role_sql("holdout", "days", f"""
    SELECT customer_id, count(*) AS holdout_purchases FROM days
    WHERE purchase_date > DATE '{CAL_END}' AND purchase_date <= DATE '{HOLD_END}'
    GROUP BY customer_id""")
role_sql("rfmh", "rfm holdout", """
    SELECT rfm.*, coalesce(holdout_purchases, 0) AS holdout_purchases
    FROM rfm LEFT JOIN holdout USING (customer_id)""")


# ---- customers with an acquisition channel --------------------------------------------------
CHANNEL_OF = {"MACHINERY": "search", "BUILDING": "search", "AUTOMOBILE": "social",
              "FURNITURE": "social", "HOUSEHOLD": "referral"}


def customers(spark, sf) -> DataFrame:
    channel = F.lit(None).cast("string")
    for segment, name in CHANNEL_OF.items():
        channel = F.when(F.col("c_mktsegment") == segment, name).otherwise(channel)
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer_id"), channel.alias("acquisition_channel"),
        F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("balance"),
        (channel == "social").cast("int").alias("channel_social"),
        (channel == "referral").cast("int").alias("channel_referral"))


role_sql("customers", "", f"""
    SELECT c_custkey AS customer_id, CASE c_mktsegment
             {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in CHANNEL_OF.items())} END
             AS acquisition_channel,
           c_mktsegment AS segment, c_nationkey AS nation, c_acctbal AS balance
    FROM customer""")


# ---- a log with dropout and heterogeneous rates, for the purchase models --------------------
# A customer keeps the orders whose priority digit is within a nation-dependent limit, and leaves
# after the first kept order whose price exceeds a balance-dependent level.
def dropout_log(spark, sf) -> DataFrame:
    cust = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    rows = (table(spark, sf, "orders").join(cust, F.col("o_custkey") == F.col("c_custkey"))
            .filter(F.substring("o_orderpriority", 1, 1).cast("int")
                    <= F.floor(F.col("c_nationkey") / 5) + 1))
    days = rows.groupBy(F.col("o_custkey").alias("customer_id"),
                        F.col("o_orderdate").cast("date").alias("date")).agg(
        F.sum(F.col("o_totalprice") / (F.col("c_nationkey") + 1) / 4001).alias("amount"),
        F.max((F.col("o_totalprice") / 500000 > F.col("c_acctbal") / 10000).cast("int"))
        .alias("leaves"))
    end = F.min(F.when(F.col("leaves") == 1, F.col("date"))).over(W.partitionBy("customer_id"))
    return days.withColumn("end", end).filter("end is null or date <= end").drop("end", "leaves")


role_sql("dropout_days", "", """
    SELECT customer_id, date AS purchase_date, amount AS day_amount FROM (
      SELECT *, min(CASE WHEN leaves = 1 THEN date END) OVER (PARTITION BY customer_id) AS last_day
      FROM (SELECT o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS date,
                   sum(o_totalprice / (c_nationkey + 1) / 4001) AS amount,
                   max(CASE WHEN o_totalprice / 500000 > c_acctbal / 10000 THEN 1 ELSE 0 END)
                     AS leaves
            FROM orders JOIN customer ON o_custkey = c_custkey
            WHERE CAST(substr(o_orderpriority, 1, 1) AS INT) <= c_nationkey // 5 + 1
            GROUP BY 1, 2) AS d) AS m
    WHERE last_day IS NULL OR date <= last_day""")
role_sql("drfm", "dropout_days", ROLE_SQL["rfm"][1].replace("FROM days", "FROM dropout_days"))


# ---- invoice lines: lineitem x orders --------------------------------------------------------
# Orders with status P are guests (no customer). A returned item is a cancellation line. Line
# number 7 is a fee. The second extract repeats the lines shipped on or after its start.
SECOND_START = "2000-01-01"
FIRST_END = "2000-12-31"
TASK_LINES = 500_000


def invoice_lines(spark, sf, order: str | None = None) -> DataFrame:
    """The two extracts put together, overlap included, with a unique line_id; ``order`` names a column for the order's key."""
    day = F.col("invoice_date").cast("date")
    in_one, in_two = day <= F.lit(FIRST_END).cast("date"), day >= F.lit(SECOND_START).cast("date")
    parts = F.array_compact(F.array(F.when(in_one, 0), F.when(in_two, 1)))
    rows = _lines(spark, sf, order).withColumn("_part", F.explode(parts))
    return rows.withColumn("line_id", F.col("line_id") * 2 + F.col("_part")).drop("_part")


def extracts(spark, sf) -> tuple[DataFrame, DataFrame]:
    base = _lines(spark, sf)
    day = F.col("invoice_date").cast("date")
    return (base.filter(day <= F.lit(FIRST_END).cast("date")),
            base.filter(day >= F.lit(SECOND_START).cast("date")))


def _lines(spark, sf, order: str | None = None) -> DataFrame:
    items = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_returnflag", "l_linestatus", "l_shipdate")
    # dealt once for the join, whatever its kind, and the windows; in a larger log by more tasks, which sort in memory
    tasks = -(-items.count() // TASK_LINES)
    more = tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    items = items.repartition(tasks, "l_orderkey") if more else items.repartition("l_orderkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    back = F.col("l_returnflag") == "R"
    fee = F.col("l_linenumber") == 7
    again = W.partitionBy("l_orderkey", "l_linenumber").orderBy(
        "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    return (items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000
         + F.row_number().over(again)).alias("line_id"),
        F.concat(F.when(back, "C").otherwise(""), F.col("l_orderkey")).alias("invoice"),
        F.when(fee, "POST").otherwise(F.lpad(F.col("l_partkey").cast("string"), 6, "0"))
        .alias("stock_code"),
        F.concat(F.lit("item "), F.col("l_partkey")).alias("description"),
        (F.col("l_quantity") * F.when(back, -1).otherwise(1)).cast("bigint").alias("quantity"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("invoice_date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("customer_id"),
        F.concat(F.lit("country "), F.col("l_linestatus")).alias("country"),
        *([] if order is None else [F.col("l_orderkey").alias(order)])))


LINE_COLUMNS = ("invoice", "stock_code", "description", "quantity", "invoice_date", "price",
                "customer_id", "country")
role_sql("base_lines", "", """
    SELECT (l_orderkey * 10 + l_linenumber) * 1000
             + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey,
                                  l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS line_id,
           CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END || l_orderkey AS invoice,
           CASE WHEN l_linenumber = 7 THEN 'POST'
                ELSE lpad(CAST(l_partkey AS VARCHAR), 6, '0') END AS stock_code,
           'item ' || l_partkey AS description,
           CAST(l_quantity * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS BIGINT) AS quantity,
           l_shipdate AS invoice_date, l_extendedprice / l_quantity AS price,
           CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS customer_id,
           'country ' || l_linestatus AS country
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
role_sql("extract_one", "base_lines", f"""
    SELECT * FROM base_lines WHERE CAST(invoice_date AS DATE) <= DATE '{FIRST_END}'""")
role_sql("extract_two", "base_lines", f"""
    SELECT * FROM base_lines WHERE CAST(invoice_date AS DATE) >= DATE '{SECOND_START}'""")
role_sql("lines", "extract_one extract_two", """
    SELECT * REPLACE (line_id * 2 AS line_id) FROM extract_one
    UNION ALL SELECT * REPLACE (line_id * 2 + 1 AS line_id) FROM extract_two""")
role_sql("flags", "lines", f"""
    SELECT l.line_id, l.customer_id IS NULL AS no_customer,
           try_cast(left(stock_code, 5) AS INT) IS NULL AS non_product,
           l.line_id <> min(l.line_id) OVER (PARTITION BY {', '.join(LINE_COLUMNS)}) AS duplicate
    FROM lines AS l""")
role_sql("kept", "lines flags", """
    SELECT lines.* FROM lines JOIN flags USING (line_id)
    WHERE NOT no_customer AND NOT non_product AND NOT duplicate""")
role_sql("matches", "kept", """
    SELECT cancel_id, original_id FROM (
      SELECT c.line_id AS cancel_id, p.line_id AS original_id,
             row_number() OVER (PARTITION BY c.line_id
                                ORDER BY p.invoice_date DESC, p.line_id DESC) AS rn
      FROM (SELECT * FROM kept WHERE starts_with(invoice, 'C')) AS c
      LEFT JOIN (SELECT * FROM kept WHERE NOT starts_with(invoice, 'C')) AS p
        ON c.customer_id = p.customer_id AND c.stock_code = p.stock_code
       AND c.invoice_date >= p.invoice_date) AS m
    WHERE rn = 1""")


# ---- touches and journeys: events ------------------------------------------------------------
def touches(spark, sf) -> DataFrame:
    """One row per non-purchase event; a journey is one user's calendar day."""
    return table(spark, sf, "events").filter("event_type <> 'purchase'").select(
        "event_id", "ts", "user_id", F.col("ts").cast("date").alias("day"),
        F.col("event_type").alias("channel"))


def conversions(spark, sf) -> DataFrame:
    return table(spark, sf, "events").filter("event_type = 'purchase'").select(
        "event_id", "ts", "user_id", F.col("ts").cast("date").alias("day"), "value")


CHANNELS = ("click", "error", "signup", "view")
role_sql("journeys", "", """
    SELECT t.user_id, t.day, t.path, CASE WHEN p.user_id IS NULL THEN 0 ELSE 1 END AS converted
    FROM (SELECT user_id, CAST(ts AS DATE) AS day, list(event_type ORDER BY ts, event_id) AS path
          FROM events WHERE event_type <> 'purchase' GROUP BY 1, 2) AS t
    LEFT JOIN (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events
               WHERE event_type = 'purchase') AS p ON t.user_id = p.user_id AND t.day = p.day""")
role_sql("touch_rows", "journeys", """
    SELECT user_id, day, converted, len(path) AS n, unnest(path) AS channel,
           unnest(range(1, len(path) + 1)) AS pos FROM journeys""")


# ---- user-day log: users x days ---------------------------------------------------------------
FIRST_DAY = "2024-01-01"  # day 0; the log runs from the first to the last day of the events


def user_days(spark, sf) -> DataFrame:
    """A dense log, one row per user and day."""
    day = F.datediff(F.col("ts").cast("date"), F.lit(FIRST_DAY).cast("date"))
    kind = F.col("event_type")

    def any_of(name):
        return F.max((kind == name).cast("int"))

    seen = table(spark, sf, "events").groupBy("user_id", day.alias("day")).agg(
        any_of("click").alias("sent"), any_of("signup").alias("opened"),
        any_of("view").alias("session"), any_of("purchase").alias("purchase"),
        F.sum(F.when(kind == "purchase", F.col("value")).otherwise(0.0)).alias("margin"),
        any_of("error").alias("err"))
    ends = seen.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    grid = seen.select("user_id").distinct().withColumns(
        {"_first": ends.select("first").scalar(), "_last": ends.select("last").scalar()}).select(
        "user_id", F.explode(F.sequence("_first", "_last")).alias("day"))
    zero = ("sent", "opened", "session", "purchase", "err")
    log = grid.join(seen, ["user_id", "day"], "left").fillna(0, subset=list(zero)).fillna(
        0.0, subset=["margin"])
    out_today = ((F.col("err") == 1) & (uniform("optout", "user_id", "day") < 0.05)).cast("int")
    before = W.partitionBy("user_id").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    recent = W.partitionBy("user_id").orderBy("day").rowsBetween(-4, -1)
    log = log.withColumn("opted_out_today", out_today)
    last_session = F.max(F.when(F.col("session") == 1, F.col("day"))).over(before)
    sessions = F.sum("session").over(W.partitionBy("user_id"))
    segment = F.when(sessions < 8, "low").when(sessions < 14, "mid").otherwise("high")
    log = log.select(
        "user_id", "day", segment.alias("segment"),
        (F.coalesce(F.max("opted_out_today").over(before), F.lit(0)) == 0).cast("int")
        .alias("eligible"),
        "sent", "opened", "session", "purchase", "margin", "opted_out_today",
        (F.coalesce(F.sum("sent").over(recent), F.lit(0)) * 0.75).alias("fatigue_before"),
        F.coalesce(F.col("day") - last_session, F.col("day") + 1).alias("days_since_before"))
    live = F.col("eligible") == 1
    for c in ("sent", "session", "purchase", "opted_out_today"):
        log = log.withColumn(c, F.when(live, F.col(c)).otherwise(0))
    return (log.withColumn("opened", F.when(live & (F.col("sent") == 1), F.col("opened"))
                           .otherwise(0))
            .withColumn("margin", F.when(live, F.col("margin")).otherwise(0.0))
            .withColumn("action", F.col("sent")))


role_sql("seen_days", "", f"""
    SELECT user_id, CAST(ts AS DATE) - DATE '{FIRST_DAY}' AS day,
           max(CAST(event_type = 'click' AS INT)) AS sent,
           max(CAST(event_type = 'signup' AS INT)) AS opened,
           max(CAST(event_type = 'view' AS INT)) AS session,
           max(CAST(event_type = 'purchase' AS INT)) AS purchase,
           sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS margin,
           max(CAST(event_type = 'error' AS INT)) AS err
    FROM events GROUP BY 1, 2""")
role_sql("dense_days", "seen_days", f"""
    SELECT user_id, day, coalesce(sent, 0) AS sent, coalesce(opened, 0) AS opened,
           coalesce(session, 0) AS session, coalesce(purchase, 0) AS purchase,
           coalesce(margin, 0.0) AS margin,
           CASE WHEN coalesce(err, 0) = 1 AND {sql_uniform('optout', 'user_id', 'day')} < 0.05
                THEN 1 ELSE 0 END AS out_today
    FROM (SELECT user_id, unnest(range((SELECT min(day) FROM seen_days), (SELECT max(day) FROM seen_days) + 1)) AS day
          FROM (SELECT DISTINCT user_id FROM seen_days) AS u) AS g
    LEFT JOIN seen_days USING (user_id, day)""")
role_sql("marked_days", "dense_days", """
    SELECT *, CASE WHEN sum(session) OVER (PARTITION BY user_id) < 8 THEN 'low'
                   WHEN sum(session) OVER (PARTITION BY user_id) < 14 THEN 'mid'
                   ELSE 'high' END AS segment,
           CASE WHEN coalesce(max(out_today) OVER b, 0) = 0 THEN 1 ELSE 0 END AS eligible,
           coalesce(sum(sent) OVER (PARTITION BY user_id ORDER BY day
                    ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0) * 0.75 AS fatigue_before,
           coalesce(day - max(CASE WHEN session = 1 THEN day END) OVER b, day + 1)
             AS days_since_before
    FROM dense_days
    WINDOW b AS (PARTITION BY user_id ORDER BY day
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
role_sql("log", "marked_days", """
    SELECT user_id, day, segment, eligible, sent * eligible AS sent,
           opened * sent * eligible AS opened, session * eligible AS session,
           purchase * eligible AS purchase,
           CASE WHEN eligible = 1 THEN margin ELSE 0.0 END AS margin,
           out_today * eligible AS opted_out_today, fatigue_before, days_since_before,
           sent * eligible AS action
    FROM marked_days""")
CADENCES = (0, 1, 3, 7)


def per_user(spark, sf) -> DataFrame:
    """Outcome per user with the assigned cadence (a hash quarter each)."""
    from tallyfield.operators.policy import user_rollup

    rolled = user_rollup(user_days(spark, sf))
    u = uniform("arm", "user_id")
    arm = F.when(u < 0.25, 0).when(u < 0.5, 1).when(u < 0.75, 3).otherwise(7)
    return rolled.withColumn("arm", arm)


role_sql("per_user", "log", f"""
    SELECT *, CASE WHEN {sql_uniform('arm', 'user_id')} < 0.25 THEN 0
                   WHEN {sql_uniform('arm', 'user_id')} < 0.5 THEN 1
                   WHEN {sql_uniform('arm', 'user_id')} < 0.75 THEN 3 ELSE 7 END AS arm
    FROM (SELECT user_id, max(segment) AS segment, sum(sent) AS sends, sum(opened) AS opens,
                 sum(session) AS sessions, sum(purchase) AS purchases, sum(margin) AS margin,
                 sum(CASE WHEN day < 7 THEN margin ELSE 0 END) AS margin_7d,
                 sum(CASE WHEN day < 7 THEN opened ELSE 0 END) AS opens_7d,
                 max(opted_out_today) AS opted_out
          FROM log GROUP BY user_id) AS r""")


# ---- experiment: customers ----------------------------------------------------------------------
def experiment(spark, sf) -> DataFrame:
    """Every customer, treated by a hash coin, with spend before and after the start.

    The hidden true effect is known because the outcome of the treated gets it added.
    """
    before = F.col("date").cast("date") <= F.lit(CAL_END).cast("date")
    spend = transactions(spark, sf).groupBy("customer_id").agg(
        F.sum(F.when(before, F.col("amount")).otherwise(0.0)).alias("pre"),
        F.sum(F.when(~before, F.col("amount")).otherwise(0.0)).alias("post"),
        F.count_if(before).alias("pre_orders"), F.count_if(~before).alias("post_orders"))
    base = customers(spark, sf).select("customer_id", "acquisition_channel", "segment", "nation",
                                       "balance")
    joined = base.join(spend, "customer_id", "left").fillna(
        0, subset=["pre", "post", "pre_orders", "post_orders"])
    t = (uniform("treat", "customer_id") < 0.5).cast("int")
    effect = F.col("balance") / 2000.0
    y = F.col("post") / 10000.0 + F.when(t == 1, effect).otherwise(0.0)
    return joined.select(
        "customer_id", "acquisition_channel", "segment", "nation", "balance",
        t.alias("treatment"), (F.col("pre") / 100000.0).alias("history"), y.alias("spend"),
        (F.col("post_orders") > 0).cast("int").alias("conversion"), "pre_orders", "post_orders",
        effect.alias("true_cate"), (effect * 0.8 + uniform("noise", "customer_id") - 0.3)
        .alias("score"), F.floor(F.col("balance") / 500.0).cast("double").alias("coarse_score"))


role_sql("experiment", "tx customers", f"""
    SELECT customer_id, acquisition_channel, segment, nation, balance, treatment,
           pre / 100000.0 AS history,
           post / 10000.0 + CASE WHEN treatment = 1 THEN balance / 2000.0 ELSE 0 END AS spend,
           CASE WHEN post_orders > 0 THEN 1 ELSE 0 END AS conversion, pre_orders, post_orders,
           balance / 2000.0 AS true_cate,
           balance / 2000.0 * 0.8 + {sql_uniform('noise', 'customer_id')} - 0.3 AS score,
           floor(balance / 500.0) AS coarse_score
    FROM (SELECT c.*, CASE WHEN {sql_uniform('treat', 'c.customer_id')} < 0.5 THEN 1 ELSE 0 END
                        AS treatment,
                 coalesce(s.pre, 0) AS pre, coalesce(s.post, 0) AS post,
                 coalesce(s.pre_orders, 0) AS pre_orders, coalesce(s.post_orders, 0) AS post_orders
          FROM customers AS c LEFT JOIN (
            SELECT customer_id, sum(CASE WHEN date <= DATE '{CAL_END}' THEN amount ELSE 0 END) AS pre,
                   sum(CASE WHEN date > DATE '{CAL_END}' THEN amount ELSE 0 END) AS post,
                   count(*) FILTER (WHERE date <= DATE '{CAL_END}') AS pre_orders,
                   count(*) FILTER (WHERE date > DATE '{CAL_END}') AS post_orders
            FROM tx GROUP BY customer_id) AS s ON s.customer_id = c.customer_id) AS e""")


# ---- geo panel: nation x month -------------------------------------------------------------------
# The log ends on the first day of August 2001; that partial month is left out.
TREATED_REGION = 1


def geo_panel(spark, sf) -> DataFrame:
    sales = (table(spark, sf, "orders")
             .join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"),
                   F.col("o_custkey") == F.col("c_custkey"))
             .groupBy(F.col("c_nationkey").alias("n_nationkey"),
                      F.trunc("o_orderdate", "month").alias("date"))
             .agg(F.sum("o_totalprice").alias("sales")))
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("geo"),
                                               F.col("n_regionkey").alias("region"))
    treated = (F.col("region") == TREATED_REGION).cast("int")
    # months that the log covers to their end
    end = table(spark, sf, "orders").agg(
        F.trunc(F.date_add(F.max("o_orderdate").cast("date"), 1), "month").alias("end"))
    return (sales.withColumn("_end", end.scalar()).filter(F.col("date") < F.col("_end")).drop("_end")
            .join(nation, "n_nationkey")
            .select("date", "geo", "region", "sales", treated.alias("treated"),
                    (F.col("date") >= F.lit(TEST_START).cast("date")).cast("int").alias("post")))


role_sql("panel", "", f"""
    SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, n_name AS geo,
           n_regionkey AS region, sum(o_totalprice) AS sales,
           CASE WHEN n_regionkey = {TREATED_REGION} THEN 1 ELSE 0 END AS treated,
           CASE WHEN CAST(date_trunc('month', o_orderdate) AS DATE) >= DATE '{TEST_START}'
                THEN 1 ELSE 0 END AS post
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderdate < (SELECT date_trunc('month', CAST(max(o_orderdate) AS DATE) + 1) FROM orders)
    GROUP BY 1, 2, 3""")


# ---- weekly media: orders by priority --------------------------------------------------------------
# Weeks begin with the first order's. The outcome ends with the last week that the orders cover to its end: shipments go on, but
# no spend is known beside them.
MEDIA = {"1-URGENT": "tv", "2-HIGH": "search", "3-MEDIUM": "social", "4-NOT SPECIFIED": "display",
         "5-LOW": "email"}
MEDIA_EPOCH = "1994-12-26"  # the Monday before the first order


def media_weekly(spark, sf) -> DataFrame:
    """Long table (week, channel, spend): each channel's order value in units of 10,000."""
    channel = F.lit(None).cast("string")
    for priority, name in MEDIA.items():
        channel = F.when(F.col("o_orderpriority") == priority, name).otherwise(channel)
    week = F.floor(F.datediff(F.col("o_orderdate").cast("date"),
                              F.lit(MEDIA_EPOCH).cast("date")) / 7)
    return (table(spark, sf, "orders").withColumn("week", week)
            .groupBy("week", channel.alias("channel"))
            .agg((F.sum("o_totalprice") / 10000.0).alias("spend")))


def media_outcome(spark, sf) -> DataFrame:
    """Weekly outcome y: shipped revenue of the week, in units of 10,000, and a price index."""
    week = F.floor(F.datediff(F.col("l_shipdate").cast("date"),
                              F.lit(MEDIA_EPOCH).cast("date")) / 7)
    last = table(spark, sf, "orders").agg((F.floor(F.datediff(
        F.date_add(F.max("o_orderdate").cast("date"), 1), F.lit(MEDIA_EPOCH).cast("date")) / 7) - 1).alias("week"))
    return (table(spark, sf, "lineitem").withColumn("week", week).withColumn("_last", last.scalar())
            .filter(F.col("week") <= F.col("_last"))
            .groupBy("week").agg((F.sum("l_extendedprice") / 10000.0).alias("y"),
                                 F.avg("l_discount").alias("price_index")))


role_sql("media", "", f"""
    SELECT (CAST(o_orderdate AS DATE) - DATE '{MEDIA_EPOCH}') // 7 AS week,
           CASE o_orderpriority {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in MEDIA.items())} END
             AS channel, sum(o_totalprice) / 10000.0 AS spend
    FROM orders GROUP BY 1, 2""")
role_sql("outcome", "", f"""
    SELECT (CAST(l_shipdate AS DATE) - DATE '{MEDIA_EPOCH}') // 7 AS week,
           sum(l_extendedprice) / 10000.0 AS y, avg(l_discount) AS price_index
    FROM lineitem
    WHERE (CAST(l_shipdate AS DATE) - DATE '{MEDIA_EPOCH}') // 7
          <= (SELECT (max(CAST(o_orderdate AS DATE)) + 1 - DATE '{MEDIA_EPOCH}') // 7 - 1 FROM orders)
    GROUP BY 1""")


# ---- subscribers: customers and the gaps in their orders -----------------------------------------
def subscribers(spark, sf) -> DataFrame:
    """First order = start; a last order 180 days before the log's end = cancellation 180 days on."""
    per = transactions(spark, sf).groupBy("customer_id").agg(
        F.min("date").cast("date").alias("start_date"), F.max("date").cast("date").alias("last"),
        F.count(F.lit(1)).alias("orders"))
    gone = F.datediff(F.lit(LOG_END).cast("date"), F.col("last")) > 180
    plan = F.when(F.col("segment").isin("MACHINERY", "BUILDING"), "basic").when(
        F.col("segment") == "HOUSEHOLD", "premium").otherwise("standard")
    return per.join(customers(spark, sf), "customer_id").select(
        "customer_id", "start_date", F.when(gone, F.date_add("last", 180)).alias("cancel_date"),
        plan.alias("plan"), (F.col("orders") >= 10).cast("int").alias("onboarded"),
        (uniform("offer", "customer_id") < 0.5).cast("int").alias("intro_offer"))


role_sql("subs_raw", "tx customers", f"""
    SELECT p.customer_id, start_date,
           CASE WHEN DATE '{LOG_END}' - last > 180 THEN last + 180 END AS cancel_date,
           CASE WHEN segment IN ('MACHINERY', 'BUILDING') THEN 'basic'
                WHEN segment = 'HOUSEHOLD' THEN 'premium' ELSE 'standard' END AS plan,
           CASE WHEN orders >= 10 THEN 1 ELSE 0 END AS onboarded,
           CASE WHEN {sql_uniform('offer', 'p.customer_id')} < 0.5 THEN 1 ELSE 0 END AS intro_offer
    FROM (SELECT customer_id, min(date) AS start_date, max(date) AS last, count(*) AS orders
          FROM tx GROUP BY customer_id) AS p JOIN customers USING (customer_id)""")
role_sql("subs", "subs_raw", f"""
    SELECT *, (coalesce(cancel_date, DATE '{LOG_END}') - start_date) / 30.4375 AS tenure_months,
           CASE WHEN cancel_date IS NOT NULL THEN 1 ELSE 0 END AS churned,
           coalesce(cancel_date, DATE '{LOG_END}') - start_date AS tenure_days
    FROM subs_raw""")


# ---- posterior draws: embeddings -------------------------------------------------------------------
def draws(spark, sf) -> DataFrame:
    """Long draws: draw = vector id, key = position, value in units that read like a ROAS."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("draw"), F.posexplode("embedding").alias("key", "v")).select(
        "draw", "key", (F.col("v").cast("double") * 4 + 1).alias("value"))


role_sql("draws", "", """
    SELECT vec_id AS draw, unnest(range(len(embedding))) AS key,
           CAST(unnest(embedding) AS DOUBLE) * 4 + 1 AS value FROM embeddings""")


# ---- observational study: customers -------------------------------------------------------------------
def study(spark, sf) -> DataFrame:
    """Experiment rows with a treatment that depends on the balance, and known nuisances."""
    e = F.least(F.lit(0.97), F.greatest(F.lit(0.03), (F.col("balance") + 1000) / 11000))
    x = experiment(spark, sf).withColumn("e", e)
    t = (uniform("adopt", "customer_id") < F.col("e")).cast("int")
    base = F.col("balance") / 1000.0 + F.col("history")
    noise = uniform("noise2", "customer_id") * 4
    return x.select(
        "customer_id", "segment", "acquisition_channel", "balance", "history", "pre_orders",
        t.alias("t"), F.col("e"), F.col("true_cate").alias("tau"), base.alias("true_baseline"),
        (base + noise + F.when(t == 1, F.col("true_cate")).otherwise(0.0)).alias("y"),
        (base + 2 + F.col("e") * F.col("true_cate") + F.col("history") * 0.1).alias("y_hat"),
        (F.col("e") * 0.9 + 0.05).alias("t_hat"))


role_sql("study", "experiment", f"""
    SELECT *, base AS true_baseline, base + {sql_uniform('noise2', 'customer_id')} * 4
             + CASE WHEN t = 1 THEN tau ELSE 0 END AS y,
           base + 2 + e * tau + history * 0.1 AS y_hat, e * 0.9 + 0.05 AS t_hat
    FROM (SELECT *, CASE WHEN {sql_uniform('adopt', 'customer_id')} < e THEN 1 ELSE 0 END AS t
          FROM (SELECT customer_id, segment, acquisition_channel, balance, history, pre_orders,
                       true_cate AS tau, balance / 1000.0 + history AS base,
                       least(0.97, greatest(0.03, (balance + 1000) / 11000)) AS e
                FROM experiment) AS a) AS b""")
