"""Cleaning rules for invoice-line logs and the comparisons between cleaning variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfield.operators.asof import asof_left_join
from tallyfield.operators.ordering import exact_quantiles
from tallyfield.operators.purchases import up_to
from tallyfield.session import cut_lineage

LINE_COLUMNS = ("invoice", "stock_code", "description", "quantity", "invoice_date", "price",
                "customer_id", "country")


FLAGS = ("no_customer", "non_product", "duplicate")


def is_cancellation(invoice: str = "invoice") -> Column:
    return F.col(invoice).startswith("C")


def flag_lines(lines: DataFrame, columns: Sequence[str] = LINE_COLUMNS, dealt_by: str | None = None) -> DataFrame:
    """Per line: no customer, not a product code, an exact copy of an earlier line."""
    return flagged_lines(lines, columns, dealt_by).select("line_id", *FLAGS)


def flagged_lines(lines: DataFrame, columns: Sequence[str] = LINE_COLUMNS, dealt_by: str | None = None) -> DataFrame:
    """``lines`` with the three flags of :func:`flag_lines` beside their columns.

    The first line of each set of copies comes from a partial aggregate (NULLs count as equal there).
    Its id is unique, so marking the rest is a join on ``line_id`` with no hot key, however many
    copies one line has. Where copies share a further column ``dealt_by``, by which a join has dealt the rows already, a
    window finds the first line where the rows are: nothing is shuffled again.
    """
    if dealt_by is None:
        firsts = lines.groupBy(*columns).agg(F.min("line_id").alias("line_id")).select(
            "line_id", F.lit(True).alias("_first"))
        marked = lines.join(firsts, "line_id", "left").withColumn("duplicate", F.col("_first").isNull()).drop("_first")
    else:
        copies = W.partitionBy(dealt_by, *columns).orderBy("line_id")
        marked = lines.withColumn("duplicate", F.row_number().over(copies) > 1)
    return marked.withColumn("no_customer", F.col("customer_id").isNull()).withColumn(
        "non_product", ~F.col("stock_code").rlike("^[0-9]{5}"))


def _with_flags(lines: DataFrame, flags: DataFrame | None) -> DataFrame:
    """Lines beside their flags; without ``flags`` they carry them (:func:`flagged_lines`)."""
    return lines if flags is None else lines.join(flags, "line_id")


def kept_lines(lines: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """Lines that none of the three flags drops."""
    good = "not no_customer and not non_product and not duplicate"
    if flags is None:
        return lines.filter(good)
    return lines.join(flags.filter(good).select("line_id"), "line_id")


def match_cancellations(kept: DataFrame,
                        keys: Sequence[str] = ("customer_id", "stock_code", "price", "quantity"),
                        written: bool = False) -> DataFrame:
    """Each cancellation line with the latest purchase line at or before it.

    The pair shares the ``keys``; a ``quantity`` key means the opposite quantity. Unmatched
    cancellations keep a NULL ``original_id``; one purchase may match twice. The few columns needed
    are written out once, as both sides and both passes of the match read them, unless ``kept`` says it is ``written``: a
    filter of a written copy. Only purchases whose keys some cancellation has take part in the ordered passes.
    """
    needed = dict.fromkeys([*keys, "quantity", "invoice_date", "invoice", "line_id"])
    kept = kept.select(*needed)
    if not written:
        kept = cut_lineage(kept)
    cancel = kept.filter(is_cancellation()).withColumn("quantity", -F.col("quantity")).select(
        *keys, "invoice_date", F.col("line_id").alias("cancel_id"))
    bought = kept.filter(~is_cancellation()).select(
        *keys, "invoice_date", F.col("line_id").alias("original_id")).join(
        cancel.select(*keys).distinct(), list(keys), "left_semi")
    return asof_left_join(cancel, bought, keys, "invoice_date", "invoice_date", "original_id",
                          ["original_id"]).select("cancel_id", "original_id")


def last_click(orders: DataFrame, clicks: DataFrame, customer: str = "customer_id",
               ordered_at: str = "ordered_at", clicked_at: str = "clicked_at",
               click_id: str = "click_id", carry: Sequence[str] = ("clicked_at", "campaign")
               ) -> DataFrame:
    """Each order with the customer's latest click at or before it."""
    return asof_left_join(orders, clicks, [customer], ordered_at, clicked_at, click_id, carry)


def reference_flags(lines: DataFrame, flags: DataFrame | None, matches: DataFrame) -> DataFrame:
    """All five rules per line: the three flags, cancellation and nonpositive."""
    return with_reference_flags(lines, flags, matches).select("line_id", *FLAGS, "cancellation", "nonpositive")


def with_reference_flags(lines: DataFrame, flags: DataFrame | None, matches: DataFrame) -> DataFrame:
    """``lines`` with all five rules beside their columns; without ``flags`` they carry the first three."""
    gone = matches.select(F.explode(F.array_compact(F.array("cancel_id", "original_id"))).alias("line_id")).distinct().withColumn(
        "_gone", F.lit(True))
    bad = (F.col("quantity") <= 0) | (F.col("price") <= 0)
    return (_with_flags(lines, flags).join(gone, "line_id", "left").withColumn("cancellation", F.coalesce("_gone", F.lit(False)))
            .withColumn("nonpositive", bad).drop("_gone"))


def purchases(lines: DataFrame, flags: DataFrame | None, matches: DataFrame,
              keep_rules: Sequence[str] = (), unit: str = "day") -> DataFrame:
    """Purchases after the cleaning rules, except the rules named in ``keep_rules``. Without ``flags`` the lines carry them.

    ``unit`` is day (one row per customer and day), invoice (one per invoice, dated by its first
    stamp) or line.
    """
    if unit not in ("day", "invoice", "line"):
        raise ValueError("unit is 'day', 'invoice' or 'line'")
    unknown = set(keep_rules) - {"non_product", "duplicate", "cancellation"}
    if unknown:
        raise ValueError(f"keep_rules names no cleaning rule: {', '.join(sorted(unknown))}")
    drop = F.col("no_customer")
    for rule in ("non_product", "duplicate"):
        if rule not in keep_rules:
            drop = drop | F.col(rule)
    rows = lines.filter(~is_cancellation() & (F.col("quantity") > 0) & (F.col("price") > 0)
                        & F.col("customer_id").isNotNull())
    rows = _with_flags(rows, None if flags is None else flags.filter(~drop).select("line_id"))
    if flags is None:
        rows = rows.filter(~drop)
    if "cancellation" not in keep_rules:
        taken = matches.filter("original_id is not null").select(
            F.col("original_id").alias("line_id"))
        rows = rows.join(taken, "line_id", "left_anti")
    money = F.col("quantity") * F.col("price")
    if unit == "line":
        return rows.select("customer_id", F.col("invoice_date").alias("date"),
                           money.alias("amount"), F.col("line_id").alias("tiebreak"))
    if unit == "invoice":
        return rows.groupBy("customer_id", "invoice").agg(
            F.min("invoice_date").alias("date"), F.sum(money).alias("amount")).select(
            "customer_id", "date", "amount", F.col("invoice").alias("tiebreak"))
    return rows.groupBy("customer_id", F.col("invoice_date").cast("date").alias("date")).agg(
        F.sum(money).alias("amount"))


def rfm_by_invoice(tx: DataFrame, cal_end, tiebreak: str = "tiebreak") -> DataFrame:
    """RFM when every row is a purchase; the first row is the earliest (date, tiebreak).

    One aggregate per customer: nothing is sorted, so a customer with many rows costs no more.
    """
    end = F.lit(str(cal_end)).cast("date")
    rows = tx.filter(up_to("date", cal_end))
    n = F.count(F.lit(1))
    first = F.min_by("amount", F.struct("date", tiebreak))
    mean = (F.sum("amount") - first) / F.nullif(n - 1, F.lit(0))
    return rows.groupBy("customer_id").agg(
        (n - 1).cast("double").alias("frequency"),
        (F.datediff(F.max("date"), F.min("date")) / 7).alias("recency"),
        (F.datediff(end, F.min("date").cast("date")) / 7).alias("T"),
        F.coalesce(mean, F.lit(0.0)).alias("monetary_value"))


def clean_log_diff(got: DataFrame, want: DataFrame, rel: float = 1e-9,
                   abs_tol: float = 1e-9) -> DataFrame:
    """Customers whose RFM differs between two logs, and in what way."""
    g = got.select("customer_id", F.col("frequency").alias("f1"),
                   F.col("monetary_value").alias("m1"))
    w = want.select("customer_id", F.col("frequency").alias("f2"),
                    F.col("monetary_value").alias("m2"))

    def far(a: str, b: str) -> Column:
        return F.abs(F.col(a) - F.col(b)) > abs_tol + rel * F.abs(F.col(b))

    both = g.join(w, "customer_id", "full")
    kind = (F.when(F.col("f1").isNull(), "missing").when(F.col("f2").isNull(), "extra")
            .when(far("f1", "f2"), "frequency").when(far("m1", "m2"), "monetary_value"))
    return both.withColumn("difference", kind).filter("difference is not null").select(
        "customer_id", "difference", (F.col("f1") - F.col("f2")).alias("frequency_gap"),
        (F.col("m1") - F.col("m2")).alias("monetary_gap"))


def straddling_cancellations(matches: DataFrame, lines: DataFrame, cal_end) -> DataFrame:
    """Matched pairs, and those bought in the calibration period but cancelled after it."""
    stamp = lines.select("line_id", F.col("invoice_date").cast("date").alias("day"))
    end = F.lit(str(cal_end)).cast("date")
    pairs = (matches.filter("original_id is not null")
             .join(stamp.select(F.col("line_id").alias("original_id"),
                                F.col("day").alias("bought")), "original_id")
             .join(stamp.select(F.col("line_id").alias("cancel_id"),
                                F.col("day").alias("cancelled")), "cancel_id"))
    return pairs.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if((F.col("bought") <= end) & (F.col("cancelled") > end)).alias("straddling"))


def rule_shares(flags: DataFrame | None, lines: DataFrame,
                rules: Sequence[str] = ("no_customer", "non_product", "duplicate")) -> DataFrame:
    """Lines flagged per rule, and lines the new rules flag among those an older rule set keeps.

    The older rules keep lines with a customer, no cancellation and a positive quantity and price. Without ``flags`` the lines carry
    them.
    """
    old = (F.col("customer_id").isNotNull() & ~is_cancellation() & (F.col("quantity") > 0) & (F.col("price") > 0)).alias("old")
    if flags is None:
        both = lines.select(*rules, old)
    else:
        both = flags.join(lines.select("line_id", old), "line_id")
    new = F.lit(False)
    for r in rules:
        if r != "no_customer":
            new = new | F.col(r)
    one = both.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(r)).alias(r) for r in rules],
        F.count_if(F.col("old")).alias("kept"), F.count_if(F.col("old") & new).alias("newly"))
    cells = [F.struct(F.lit(r).alias("rule"), F.col(r).alias("lines"),
                      (F.col(r) / F.col("n")).alias("share")) for r in rules]
    cells.append(F.struct(F.lit("newly flagged").alias("rule"), F.col("newly").alias("lines"),
                          (F.col("newly") / F.col("kept")).alias("share")))
    return one.select(F.inline(F.array(*cells)))


def standalone_fee_customers(lines: DataFrame, fee_code: str = "POST") -> DataFrame:
    """Customers with a fee line on a day that has only one invoice of theirs."""
    days = (lines.filter(F.col("customer_id").isNotNull())
            .groupBy("customer_id", F.col("invoice_date").cast("date").alias("day"), "invoice")
            .agg(F.max((F.col("stock_code") == fee_code).cast("int")).alias("fee"))
            .groupBy("customer_id", "day")
            .agg(F.count(F.lit(1)).alias("invoices"), F.max("fee").alias("fee")))
    return days.filter("invoices = 1 and fee = 1").groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("fee_days"))


def variant_effects(scores: DataFrame, reference: str = "reference",
                    threshold: float = 0.10) -> DataFrame:
    """Per cleaning variant: change of the total, customers moved by more than the threshold.

    ``scores`` is long: variant, customer_id, score, one row per variant and customer. Totals are over all customers
    of the variant and of the reference. A reference customer whom the variant lacks has moved; one whom
    only the variant has counts in its total alone.
    """
    ref = _reference_scores(scores, reference)
    whole = ref.agg(F.count(F.lit(1)).alias("n"), F.sum("ref").alias("total"))
    near = F.coalesce(F.abs(F.try_divide("score", "ref") - 1) <= threshold, F.lit(False))
    per = scores.join(ref, "customer_id", "left").groupBy("variant").agg(
        F.sum("score").alias("_sum"), F.count_if(F.col("ref").isNotNull() & near).alias("_stayed"))
    return (per.withColumn("_ref", whole.select("total").scalar()).withColumn("_n", whole.select("n").scalar())
            .select("variant", (100 * (F.col("_sum") / F.col("_ref") - 1)).alias("total_change_pct"),
                    (F.col("_n") - F.col("_stayed")).alias("customers_moved")))


def largest_changes(scores: DataFrame, reference: str = "reference") -> DataFrame:
    """Per variant, the customer with the largest relative and the largest absolute change.

    The smaller customer id wins a tie.
    """
    both = _with_reference(scores, reference).filter(F.col("variant") != reference)
    rel = F.abs(F.try_divide("score", "ref") - 1)
    gap = F.abs(F.col("score") - F.col("ref"))
    return both.groupBy("variant").agg(
        F.max_by("customer_id", F.struct(rel, -F.col("customer_id"))).alias("largest_pct_customer"),
        (100 * F.max(rel)).alias("largest_change_pct"),
        F.max_by("customer_id", F.struct(gap, -F.col("customer_id"))).alias("largest_abs_customer"),
        F.max(gap).alias("largest_change_abs"))


def _reference_scores(scores: DataFrame, reference: str) -> DataFrame:
    return scores.filter(F.col("variant") == reference).select("customer_id", F.col("score").alias("ref"))


def _with_reference(scores: DataFrame, reference: str) -> DataFrame:
    """Scores of customers whom the reference has as well."""
    return scores.join(_reference_scores(scores, reference), "customer_id")


def largest_purchase_days(tx: DataFrame, k: int, wholesale: Column) -> DataFrame:
    """The k largest purchase days with a wholesale flag, next to the median amount."""
    top = tx.orderBy(F.col("amount").desc(), "customer_id", "date").limit(k)
    median = exact_quantiles(tx, "amount", {"median": 0.5})
    return top.withColumn("wholesale", wholesale).withColumn("median_amount",
                                                             median.select("median").scalar())


def amount_cap(tx: DataFrame, pct: float, cal_end) -> DataFrame:
    """The exact percentile of calibration amounts (one row)."""
    cal = tx.filter(up_to("date", cal_end))
    return exact_quantiles(cal, "amount", {"cap": pct / 100.0})


def cap_amounts(tx: DataFrame, pct: float, cal_end) -> DataFrame:
    """Clip every amount at the calibration percentile."""
    cap = amount_cap(tx, pct, cal_end).select("cap").scalar()
    return tx.withColumn("cap", cap).withColumn("amount", F.least("amount", "cap"))


def contact_list(purchases: str, spend: str, cost: float, margin: float, lift: float) -> Column:
    """Contact when the expected gain exceeds the cost (strictly)."""
    return F.lit(lift * margin) * F.col(purchases) * F.col(spend) > cost


def contact_list_moves(scores: DataFrame, base: str, lift: float, margin: float,
                       cost: float) -> DataFrame:
    """Customers added to and dropped from the contact list by each variant.

    A customer whom a variant or the base does not score is not on its list, so a variant that shares nobody
    with the base drops the whole list.
    """
    listed = F.coalesce(F.col("score"), F.lit(0.0)) * (lift * margin) > cost
    ref = scores.filter(F.col("variant") == base).select("customer_id", listed.alias("was"))
    now = scores.filter(F.col("variant") != base).select("variant", "customer_id", listed.alias("now"))
    was = F.coalesce("was", F.lit(False))
    on = now.join(ref, "customer_id", "left").groupBy("variant").agg(
        F.count_if(F.col("now") & ~was).alias("added"), F.count_if(F.col("now") & was).alias("stayed"))
    size = ref.agg(F.count_if("was").alias("n")).scalar()
    return on.withColumn("_n", size).select(
        "variant", "added", (F.col("_n") - F.col("stayed")).alias("dropped"),
        (F.col("added") + F.col("_n") - F.col("stayed")).alias("moved"))


def holdout_forecast_error(forecast: DataFrame, tx: DataFrame, cal_end, hold_end,
                           predicted: str = "expected_purchases") -> DataFrame:
    """Forecast total against the distinct holdout purchase days that happened."""
    d = F.col("date").cast("date")
    window = tx.filter(~up_to("date", cal_end) & up_to("date", hold_end))
    actual = window.select("customer_id", d.alias("d")).distinct().agg(
        F.count(F.lit(1)).alias("actual"))
    total = forecast.agg(F.sum(predicted).alias("forecast"))
    both = total.withColumn("actual", actual.scalar())
    return both.select("forecast", "actual",
                       (100 * (F.col("forecast") / F.col("actual") - 1)).alias("error_pct"))


def parameter_changes(fits: DataFrame, reference: str = "reference") -> DataFrame:
    """The reference variant's parameters as they are, the other variants in percent of them.

    ``fits`` is long: variant, parameter, value.
    """
    ref = fits.filter(F.col("variant") == reference).select("parameter",
                                                            F.col("value").alias("ref"))
    shown = F.when(F.col("variant") == reference, F.col("value")).otherwise(
        100 * (F.try_divide("value", "ref") - 1))
    return fits.join(ref, "parameter").select("variant", "parameter", shown.alias("shown"))


