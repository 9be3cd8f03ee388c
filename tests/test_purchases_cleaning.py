import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tallyfield.operators import cleaning as M
from tallyfield.operators import purchases as P
from tallyfield.operators import quality as Q
from tallyfield.sources import tables as S

LINES = ("line_id int, invoice string, stock_code string, description string, quantity bigint,"
         " invoice_date string, price double, customer_id bigint, country string")


def lines(spark, rows):
    return spark.createDataFrame(rows, LINES).withColumn(
        "invoice_date", F.col("invoice_date").cast("timestamp_ntz"))


def tx(spark, rows):
    return spark.createDataFrame(rows, "customer_id int, date string, amount double").withColumn(
        "date", F.col("date").cast("date"))


def test_clean_invoices(spark):
    inv = ["100", "100", "101", "C102", "103", "103", "104", "105"]
    cust = [1, 1, None, 1, 2, 2, 2, 3]
    qty = [2, 1, 5, -1, 0, 3, 1, -2]
    price = [3.0, 4.0, 1.0, 3.0, 2.0, 2.0, 0.0, 5.0]
    rows = [(i, a, "85123", "d", q, "2024-01-01 09:00:00", p, c, "UK")
            for i, (a, c, q, p) in enumerate(zip(inv, cust, qty, price, strict=True))]
    got = {r["invoice"]: r["amount"] for r in P.clean_invoices(lines(spark, rows)).collect()}
    assert got == {"100": 10.0, "103": 6.0}


def test_confusion(spark):
    df = spark.createDataFrame([(True, 0), (True, 1), (False, 0), (False, 1)], "f boolean, a int")
    row = P.confusion(df, F.col("f"), F.col("a") == 1).first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (1, 1, 1, 1)


def test_make_features(spark):
    log = tx(spark, [(1, "2024-01-01", 10.0), (1, "2024-01-01", 5.0), (1, "2024-03-01", 20.0),
                     (2, "2024-03-20", 8.0), (3, "2024-04-15", 50.0)])
    rows = {r["customer_id"]: r for r in P.make_features(log, "2024-03-31").collect()}
    assert set(rows) == {1, 2}
    one, two = rows[1], rows[2]
    assert (one["frequency"], one["mean_spend"]) == (1.0, 17.5)
    assert one["recency"] == pytest.approx(60 / 7) and one["T"] == pytest.approx(90 / 7)
    assert one["weeks_since_last"] == pytest.approx(30 / 7)
    assert (one["purchases_4w"], one["purchases_13w"]) == (0, 2)
    assert (two["frequency"], two["recency"], two["mean_spend"]) == (0.0, 0.0, 8.0)
    assert (two["purchases_4w"], two["purchases_13w"]) == (1, 1)


def test_rfm_units(spark):
    log = tx(spark, [(1, "2024-01-01", 1.0), (1, "2024-01-07", 2.0), (1, "2024-01-08", 4.0),
                     (1, "2024-03-01", 8.0), (2, "2024-03-05", 5.0)])
    week = P.rfm_summary(log, "W").filter("customer_id = 1").first()
    assert (week["frequency"], week["recency"], week["T"]) == (2.0, 8.0, 9.0)
    assert week["monetary_value"] == 6.0
    month = P.rfm_summary(log, "M", end="2024-02-15").collect()
    assert len(month) == 1
    assert (month[0]["frequency"], month[0]["T"], month[0]["monetary_value"]) == (0.0, 1.0, 0.0)
    assert "monetary_value" not in P.rfm_summary(log, "D", amount=None).columns
    with pytest.raises(ValueError):
        P.rfm_summary(log, "Q")


def test_flag_lines(spark):
    d = "2024-01-05 10:00:00"
    rows = [
        (0, "1", "85123", "a", 1, d, 2.0, 7, "UK"), (1, "1", "85123", "a", 1, d, 2.0, 7, "UK"),
        (2, "1", "85123", "a", 2, d, 2.0, 7, "UK"), (3, "2", "POST", "p", 1, d, 9.0, 7, "UK"),
        (4, "2", "M", "m", 1, d, 9.0, 7, "UK"), (5, "2", "TEST001", "t", 1, d, 9.0, 7, "UK"),
        (6, "3", "15056BL", "b", 1, d, 3.0, 7, "UK"), (7, "4", "85123", "a", 1, d, 2.0, None, "UK"),
        (8, "4", "85123", "a", 1, d, 2.0, None, "UK")]
    got = {r["line_id"]: r for r in M.flag_lines(lines(spark, rows)).collect()}
    assert [i for i in got if got[i]["duplicate"]] == [1, 8] or {
        i for i in got if got[i]["duplicate"]} == {1, 8}
    assert {i for i in got if got[i]["non_product"]} == {3, 4, 5}
    assert {i for i in got if got[i]["no_customer"]} == {7, 8}


def test_match_cancellations(spark):
    def line(i, inv, q, when, code="85123", price=2.0, cust=1):
        return (i, inv, code, "d", q, when, price, cust, "UK")

    rows = [
        line(1, "10", 5, "2024-01-01 09:00:00"), line(2, "C11", -5, "2024-01-01 15:00:00"),
        line(3, "12", 6, "2024-01-02 09:00:00"), line(4, "C13", -2, "2024-01-03 09:00:00"),
        line(5, "C14", -9, "2024-01-03 09:00:00"), line(6, "15", 9, "2024-01-04 09:00:00"),
        line(7, "16", 3, "2024-01-05 09:00:00"), line(8, "17", 3, "2024-01-06 09:00:00"),
        line(9, "C18", -3, "2024-01-07 09:00:00"),
        line(10, "19", 7, "2024-01-08 09:00:00", cust=2), line(11, "C20", -7, "2024-01-09 09:00:00"),
        line(12, "21", 8, "2024-01-08 09:00:00", code="99999"),
        line(13, "C22", -8, "2024-01-09 09:00:00"),
        line(14, "23", 4, "2024-01-08 09:00:00", price=2.5),
        line(15, "C24", -4, "2024-01-09 09:00:00"), line(16, "C25", -3, "2024-01-10 09:00:00"),
        line(17, "26", 2, "2024-01-11 09:00:00"), line(18, "C27", -2, "2024-01-11 09:00:00")]
    got = {r["cancel_id"]: r["original_id"] for r in M.match_cancellations(
        lines(spark, rows)).collect()}
    assert got == {2: 1, 4: None, 5: None, 9: 8, 11: None, 13: None, 15: None, 16: 8, 18: 17}


def test_last_click(spark):
    def stamp(df, c):
        return df.withColumn(c, F.col(c).cast("timestamp"))

    clicks = stamp(spark.createDataFrame(
        [(1, 1, "2024-03-01 09:00:00", "a"), (2, 1, "2024-03-04 18:00:00", "b"),
         (3, 2, "2024-03-05 12:00:00", "c")],
        "click_id int, customer_id int, clicked_at string, campaign string"), "clicked_at")
    orders = stamp(spark.createDataFrame(
        [(101, 1, "2024-03-02 10:00:00"), (102, 1, "2024-03-06 08:00:00"),
         (103, 2, "2024-03-05 11:00:00"), (104, 3, "2024-03-06 09:00:00")],
        "order_id int, customer_id int, ordered_at string"), "ordered_at")
    got = {r["order_id"]: r["campaign"] for r in M.last_click(orders, clicks).collect()}
    assert got == {101: "a", 102: "b", 103: None, 104: None}


def test_contact_list_is_strict(spark):
    df = spark.createDataFrame([(2.0,), (2.0,), (0.5,)], "n double").withColumn("s", F.lit(16.0))
    for cost, want in ((4.0, 0), (3.5, 2)):
        flag = M.contact_list("n", "s", cost, 0.25, 0.5).cast("int")
        assert df.agg(F.sum(flag)).first()[0] == want


def test_purchase_units_and_rules(spark):
    rows = [(1, "1", "85123", "a", 2, "2024-01-01 09:00:00", 5.0, 7, "UK"),
            (2, "1", "POST", "p", 1, "2024-01-01 09:00:00", 3.0, 7, "UK"),
            (3, "2", "85124", "b", 1, "2024-01-01 18:00:00", 4.0, 7, "UK"),
            (4, "C3", "85124", "b", -1, "2024-01-02 09:00:00", 4.0, 7, "UK")]
    df = lines(spark, rows)
    flags = M.flag_lines(df)
    matches = M.match_cancellations(M.kept_lines(df, flags))
    day = M.purchases(df, flags, matches).collect()
    assert [(r["date"], r["amount"]) for r in day] == [(dt.date(2024, 1, 1), 10.0)]
    kept = M.purchases(df, flags, matches, ("cancellation", "non_product"), "invoice")
    assert sorted(r["amount"] for r in kept.collect()) == [4.0, 13.0]
    assert M.purchases(df, flags, matches, ("cancellation",), "line").count() == 2
    with pytest.raises(ValueError):
        M.purchases(df, flags, matches, unit="week")


def test_rfm_violations_catch_a_swap(spark):
    good = spark.createDataFrame([(1, 1.0, 4.0, 9.0), (2, 0.0, 0.0, 3.0)],
                                 "customer_id int, frequency double, recency double, T double")
    clean = Q.rfm_violations(good).first().asDict()
    assert clean.pop("rows") == 2 and not any(clean.values())
    swapped = good.withColumnsRenamed({"frequency": "x", "recency": "frequency"}).withColumnRenamed(
        "x", "recency")
    assert Q.rfm_violations(swapped).first()["frequency_over_recency"] == 1
    broken = good.union(spark.createDataFrame([(1, -1.5, -2.0, float("nan"))], good.schema))
    row = Q.rfm_violations(broken).first()
    assert (row["repeated_customers"], row["not_finite"], row["frequency_negative"],
            row["recency_negative"]) == (1, 1, 1, 1)


def test_monotone_and_frames(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 2.0, 1.5, 3.0])],
                               "i int, v double")
    assert Q.monotone_violations(df, "v", ["i"]).first()["violations"] == 1
    assert Q.monotone_violations(df, "v", ["i"], strict=True).first()["violations"] == 2
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, "y"), (2, 2.0, "y")], "k int, v double, s string")
    b = spark.createDataFrame([(1, 1.0 + 1e-12, "x"), (2, 2.5, None), (3, 1.0, "z")], a.schema)
    found = {r["finding"]: r["n"] for r in Q.frames_agree(a, b, ["k"]).collect()}
    assert found == {"rows left": 3, "rows right": 3, "repeated keys left": 1,
                     "repeated keys right": 0, "only left": 0, "only right": 1, "differs v": 1,
                     "differs s": 1}
    with pytest.raises(ValueError):
        Q.expect_columns(a, ["k", "missing"])


def test_leakage_is_found(spark):
    log = tx(spark, [(1, "2024-01-01", 10.0), (1, "2024-06-01", 20.0), (2, "2024-02-01", 5.0)])

    def leaky(t):
        return t.groupBy("customer_id").agg(F.sum("amount").alias("total"))

    found = Q.leakage_check(leaky, log, "2024-03-31").filter("finding = 'differs total'").collect()
    assert [r["n"] for r in found] == [1, 1]
    clean = Q.leakage_check(lambda t: P.make_features(t, "2024-03-31"), log, "2024-03-31")
    assert clean.filter("finding like 'differs%' and n > 0").count() == 0


def test_score_upsert(spark, tmp_path):
    path = str(tmp_path / "scores")

    def table(rows):
        return spark.createDataFrame(rows, "customer_id string, p_alive double, clv_mean double,"
                                           " clv_hdi_low double, clv_hdi_high double, segment string")

    first = table([("a", 0.5, 1.0, 0.5, 2.0, "s"), ("b", 0.6, 2.0, 1.0, 3.0, "s")])
    assert S.write_scores(first, path, "v1", "2024-01-01") == 2
    assert S.write_scores(first, path, "v1", "2024-01-01") == 2  # a rerun replaces
    assert S.write_scores(table([("b", 0.9, 2.0, 1.0, 3.0, "s")]), path, "v1", "2024-01-02") == 2
    assert S.write_scores(first, path, "v2", "2024-01-03") == 2  # a new version adds
    rows = {(r["customer_id"], r["model_version"]): r["p_alive"]
            for r in S.read_scores(spark, path).collect()}
    assert rows == {("a", "v1"): 0.5, ("b", "v1"): 0.9, ("a", "v2"): 0.5, ("b", "v2"): 0.6}
    audit = S.audit_scores(S.read_scores(spark, path), "2024-01-01", "v1").first()
    assert (audit["incomplete"], audit["p_outside"], audit["mean_outside"], audit["wrong_tags"]) == (
        0, 0, 0, 3)


def test_entities_and_extracts(spark):
    df = spark.createDataFrame([(i % 50, i) for i in range(500)] + [(None, 0)], "k int, v int")
    ten = S.sample_entities(df, "k", 10, 3)
    assert ten.select("k").distinct().count() == 10 and ten.count() == 100
    with pytest.raises(ValueError):
        S.sample_entities(df, "k", 1.5)
    a = spark.createDataFrame([("1", "x"), ("1", "x"), ("2", "y")], "k string, s string")
    b = spark.createDataFrame([("2", "other"), ("3", "z"), ("3", "z")], "k string, s string")
    assert S.union_overlapping_extracts(a, b, ["k"]).count() == 5


def variant_scores(spark):
    rows = [("reference", 1, 10.0), ("reference", 2, 90.0), ("a", 1, 10.0), ("b", 7, 50.0), ("c", 1, 10.0), ("c", 2, 95.0), ("c", 3, 60.0)]
    return spark.createDataFrame(rows, "variant string, customer_id int, score double")


def test_variants_that_lack_customers(spark):
    from tallyfield.operators import cleaning as M

    got = {r["variant"]: (round(r["total_change_pct"], 9), r["customers_moved"]) for r in M.variant_effects(variant_scores(spark)).collect()}
    assert got == {"reference": (0.0, 0), "a": (-90.0, 1), "b": (-50.0, 2), "c": (65.0, 0)}


def test_contact_lists_without_shared_customers(spark):
    from tallyfield.operators import cleaning as M

    got = {r["variant"]: (r["added"], r["dropped"], r["moved"]) for r in M.contact_list_moves(variant_scores(spark), "reference", 1.0, 1.0, 40.0).collect()}
    assert got == {"a": (0, 1, 1), "b": (1, 1, 2), "c": (1, 0, 1)}


def test_lines_that_carry_their_flags(spark):
    d = "2024-01-05 10:00:00"
    rows = [(0, "1", "85123", "a", 1, d, 2.0, 7, "UK"), (1, "1", "85123", "a", 1, d, 2.0, 7, "UK"), (2, "1", "85123", "a", 2, d, 2.0, 7, "UK"),
            (3, "C2", "85123", "a", -2, d, 2.0, 7, "UK"), (4, "3", "POST", "p", 1, d, 9.0, None, "UK"), (5, "3", "POST", "p", 1, d, 9.0, None, "UK")]
    df = lines(spark, rows)
    dealt = df.withColumn("order_id", F.ltrim(F.lit("C"), "invoice")).repartition("order_id")
    flagged = M.flagged_lines(dealt, dealt_by="order_id")
    plan = flagged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the lines are not dealt again
    flags = M.flag_lines(df)
    assert sorted(flagged.select(flags.columns).collect()) == sorted(flags.collect())
    matches = M.match_cancellations(M.kept_lines(flagged))
    assert sorted(matches.collect()) == sorted(M.match_cancellations(M.kept_lines(df, flags)).collect()) == [(3, 2)]
    for f in (M.reference_flags, M.purchases):
        assert sorted(f(flagged, None, matches).collect()) == sorted(f(df, flags, matches).collect())
    assert M.rule_shares(None, flagged).collect() == M.rule_shares(flags, df).collect()


def test_equal_spend_ties_whatever_the_order_of_the_lines(spark, monkeypatch):
    from tallyfield.plans import cleaning as plan

    # 0.1 + 0.2 + 0.3 and 0.3 + 0.2 + 0.1 differ in the last digit as floating-point numbers
    rows = [(c * 10 + i, str(c), "85123", f"{i}", 1, "2024-01-01 09:00:00", p, c, "UK")
            for c, prices in ((1, (0.1, 0.2, 0.3)), (2, (0.3, 0.2, 0.1))) for i, p in enumerate(prices)]
    df = M.flagged_lines(lines(spark, rows).coalesce(1))
    none = spark.createDataFrame([], "cancel_id int, original_id int")
    monkeypatch.setattr(plan, "_parts", lambda *_: (df, None, none))
    scores = plan.variant_scores(spark, "").where("variant = 'reference'").collect()
    assert [r["score"] for r in scores] == [0.6, 0.6]


def test_the_cleaning_step_writes_and_deals_each_column_once(spark, monkeypatch):
    from tallyfield.operators import cleaning
    from tallyfield.plans import cleaning as plans

    again = []
    monkeypatch.setattr(cleaning, "cut_lineage", lambda df: again.append(df) or df)
    lines, _, matches = plans._parts(spark, "/root/testdata/sf0.001")
    assert not again  # the match reads the lines that were written
    assert not {"description", "country", "order_id"} & set(lines.columns)
    deals = [line for line in matches._jdf.queryExecution().optimizedPlan().toString().splitlines() if "AS _left" in line or "AS _right" in line]
    assert deals
    for line in deals:  # keys and ids stand beside the structs, not in them
        assert not any(f"{name}, {c}" in line for name in ("named_struct(customer_id", "stock_code") for c in ("customer_id", "stock_code"))
        assert ", original_id, original_id" not in line


def test_a_larger_log_is_dealt_to_more_tasks(spark, monkeypatch):
    from tallyfield.plans import roles

    sf = "/root/testdata/sf0.001"
    few = roles.invoice_lines(spark, sf, "order_id")
    monkeypatch.setattr(roles, "TASK_LINES", 100)
    many = roles.invoice_lines(spark, sf, "order_id")
    tasks = -(-roles.table(spark, sf, "lineitem").count() // 100)
    assert re.search(rf"hashpartitioning\(l_orderkey#\d+L?, {tasks}\)", many._jdf.queryExecution().executedPlan().toString())
    assert sorted(few.collect(), key=str) == sorted(many.collect(), key=str)


def test_purchases_without_a_cancellation_of_their_keys_are_not_ordered(spark):
    d = "2024-01-05 10:00:00"
    rows = [(0, "1", "85123", "a", 2, d, 2.0, 7, "UK"), (1, "C2", "85123", "a", -2, d, 2.0, 7, "UK"), (2, "3", "85124", "a", 1, d, 2.0, 7, "UK"),
            (3, "C4", "85125", "a", -1, d, 2.0, None, "UK"), (4, "5", "85125", "a", 1, d, 2.0, None, "UK")]
    matches = M.match_cancellations(lines(spark, rows))
    assert sorted(matches.collect()) == [(1, 0), (3, None)]
    assert "LeftSemi" in matches._jdf.queryExecution().optimizedPlan().toString()
