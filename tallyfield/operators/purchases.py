"""Purchase logs: customer tables, RFM, cohorts, feature tables and inactivity rules.

Every log is first reduced to one row per customer and day. That reduction is a partial aggregate, so
a customer holding a third of the log costs no more than its number of calendar days afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfield.operators.ordering import with_ntile

DAYS_PER_WEEK = 7


def _day(date: str) -> Column:
    return F.col(date).cast("date")


def _as_date(value) -> Column:
    return F.lit(str(value)).cast("date")


def up_to(date: str, end) -> Column:
    """On or before the day ``end``, with the column left bare so that the scan can use the filter."""
    return F.col(date) < F.date_add(_as_date(end), 1)


def customer_table(tx: DataFrame, customer: str = "customer_id", date: str = "date",
                   amount: str = "amount") -> DataFrame:
    """First and last purchase, number of transactions and total spend per customer."""
    return tx.groupBy(customer).agg(
        F.min(_day(date)).alias("first_purchase"), F.max(_day(date)).alias("last_purchase"),
        F.count(F.lit(1)).alias("transactions"), F.sum(amount).alias("total_spend"))


def repeat_purchases(tx: DataFrame, customer: str = "customer_id",
                     date: str = "date") -> DataFrame:
    """Distinct purchase days and repeat purchase days (days - 1) per customer."""
    days = tx.select(customer, _day(date).alias("_d")).distinct()
    return days.groupBy(customer).agg(
        F.count(F.lit(1)).alias("purchase_days"),
        (F.count(F.lit(1)) - 1).alias("repeat_days"))


def clean_invoices(lines: DataFrame) -> DataFrame:
    """One row per customer and invoice, without guests, cancellations and non-sales."""
    kept = lines.filter(F.col("customer_id").isNotNull() & ~F.col("invoice").startswith("C")
                        & (F.col("quantity") > 0) & (F.col("price") > 0))
    return kept.groupBy("customer_id", "invoice").agg(
        F.min("invoice_date").cast("date").alias("invoice_date"),
        F.sum(F.col("quantity") * F.col("price")).alias("amount"))


def purchase_days(tx: DataFrame, customer: str = "customer_id", date: str = "date",
                  amount: str = "amount") -> DataFrame:
    """One row per customer and day with the summed amount."""
    return tx.groupBy(F.col(customer), _day(date).alias("purchase_date")).agg(
        F.sum(amount).alias("day_amount"))


def purchase_gaps(tx: DataFrame, customer: str = "customer_id", date: str = "date",
                  amount: str = "amount") -> DataFrame:
    """Purchase index and days since the customer's previous purchase day."""
    days = purchase_days(tx, customer, date, amount)
    w = W.partitionBy(customer).orderBy("purchase_date")
    return days.select(
        customer, "purchase_date", "day_amount", F.row_number().over(w).alias("purchase_index"),
        F.datediff("purchase_date", F.lag("purchase_date").over(w)).alias("days_since_prev"))


def short_gap_share(gaps: DataFrame, days: int = DAYS_PER_WEEK) -> DataFrame:
    """Number of gaps and the share below ``days``."""
    known = gaps.filter(F.col("days_since_prev").isNotNull())
    return known.agg(F.count(F.lit(1)).alias("gaps"),
                     F.avg((F.col("days_since_prev") < days).cast("double")).alias("share_short"))


def gap_histogram(gaps: DataFrame, width: int = DAYS_PER_WEEK) -> DataFrame:
    """Gaps counted in bins of ``width`` days."""
    known = gaps.filter(F.col("days_since_prev").isNotNull())
    return known.groupBy(F.floor(F.col("days_since_prev") / width).alias("bin")).agg(
        F.count(F.lit(1)).alias("gaps"))


def rfm(tx: DataFrame, cutoff, unit_days: int = DAYS_PER_WEEK, customer: str = "customer_id",
        date: str = "date", amount: str = "amount") -> DataFrame:
    """Frequency, recency, age and mean repeat spend on purchase days up to the cutoff."""
    end = _as_date(cutoff)
    days = purchase_days(tx.filter(up_to(date, cutoff)), customer, date, amount)
    n = F.count(F.lit(1))
    mean = (F.sum("day_amount") - F.min_by("day_amount", "purchase_date")) / F.nullif(
        n - 1, F.lit(0))
    return days.groupBy(customer).agg(
        (n - 1).cast("double").alias("frequency"),
        (F.datediff(F.max("purchase_date"), F.min("purchase_date")) / unit_days).alias("recency"),
        (F.datediff(end, F.min("purchase_date")) / unit_days).alias("T"),
        F.coalesce(mean, F.lit(0.0)).alias("monetary_value"))


def period_ordinal(date: str, unit: str) -> Column:
    """Integer number of the calendar period: D, W (Monday to Sunday), M or h."""
    ts = F.col(date).cast("timestamp")
    day = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date"))
    if unit == "D":
        return day.cast("bigint")
    if unit == "W":
        return F.floor((day + 3) / 7)
    if unit == "M":
        return (F.year(ts) * 12 + F.month(ts)).cast("bigint")
    if unit.lower() == "h":
        return F.floor(F.unix_timestamp(ts) / 3600)
    raise ValueError(f"unit must be 'D', 'W', 'M' or 'h', not {unit!r}")


def rfm_summary(tx: DataFrame, unit: str = "D", scaler: float = 1.0, end=None,
                customer: str = "customer_id", date: str = "date",
                amount: str | None = "amount") -> DataFrame:
    """RFM on calendar periods; purchases of one period count once.

    ``end`` defaults to the last date of the log. Without ``amount`` there is no monetary value.
    """
    rows = tx.withColumn("_ord", period_ordinal(date, unit))
    if end is None:
        last = rows.agg(F.max("_ord")).scalar()
        rows = rows.withColumn("_end", last)
    else:
        stamp = tx.sparkSession.range(1).select(F.lit(str(end)).cast("timestamp").alias("e"))
        rows = rows.withColumn("_end", stamp.select(period_ordinal("e", unit)).scalar())
        rows = rows.filter(F.col("_ord") <= F.col("_end"))
    money = F.sum(amount) if amount else F.lit(None).cast("double")
    per = rows.groupBy(customer, "_ord").agg(money.alias("_money"), F.max("_end").alias("_end"))
    out = per.groupBy(customer).agg(
        (F.count(F.lit(1)) - 1).cast("double").alias("frequency"),
        ((F.max("_ord") - F.min("_ord")) / scaler).alias("recency"),
        ((F.max("_end") - F.min("_ord")) / scaler).alias("T"),
        ((F.sum("_money") - F.min_by("_money", "_ord"))
         / F.nullif(F.count(F.lit(1)) - 1, F.lit(0))).alias("_mean"))
    if amount is None:
        return out.drop("_mean")
    return out.withColumn("monetary_value", F.coalesce("_mean", F.lit(0.0))).drop("_mean")


def calibration_holdout(tx: DataFrame, cal_end, hold_end, customer: str = "customer_id",
                        date: str = "date") -> DataFrame:
    """RFM (weeks) on calibration days and the number of holdout purchase days.

    Only customers seen in the calibration period are kept.
    """
    cal = _as_date(cal_end)
    days = tx.filter(up_to(date, hold_end)).select(customer, _day(date).alias("d")).distinct()
    in_cal = F.col("d") <= cal
    cal_day = F.when(in_cal, F.col("d"))
    out = days.groupBy(customer).agg(
        F.count(cal_day).alias("_n"), F.min(cal_day).alias("_first"), F.max(cal_day).alias("_last"),
        F.count(F.when(~in_cal, 1)).alias("holdout_purchases")).filter("_n > 0")
    return out.select(
        customer, (F.col("_n") - 1).cast("double").alias("frequency"),
        (F.datediff("_last", "_first") / DAYS_PER_WEEK).alias("recency"),
        (F.datediff(cal, F.col("_first")) / DAYS_PER_WEEK).alias("T"), "holdout_purchases")


def customer_rfm_with_attributes(tx: DataFrame, customers: DataFrame, cal_end, hold_end,
                                 channel: str = "acquisition_channel",
                                 levels: Sequence[str] = ("social", "referral"),
                                 customer: str = "customer_id", date: str = "date",
                                 amount: str = "amount") -> DataFrame:
    """RFM with holdout counts, the test length in weeks, the channel and its indicators."""
    base = rfm(tx, cal_end, DAYS_PER_WEEK, customer, date, amount)
    hold = calibration_holdout(tx, cal_end, hold_end, customer, date).select(
        customer, "holdout_purchases")
    weeks = F.datediff(_as_date(hold_end), _as_date(cal_end)) / DAYS_PER_WEEK
    out = (base.join(hold, customer, "left").join(customers.select(customer, channel), customer,
                                                  "left")
           .withColumn("test_weeks", weeks))
    for level in levels:
        out = out.withColumn(f"channel_{level}",
                             F.coalesce(F.col(channel) == level, F.lit(False)).cast("int"))
    return out


def cohort_retention(tx: DataFrame, customer: str = "customer_id",
                     date: str = "date") -> DataFrame:
    """Share of each first-purchase-month cohort that is active k months later.

    The cohort size is the largest monthly count, which is the cohort's month 0.
    """
    months = tx.select(customer, F.trunc(_day(date), "month").alias("month")).distinct()
    cohort = F.min("month").over(W.partitionBy(customer))
    cells = (months.withColumn("cohort_month", cohort)
             .groupBy("cohort_month", "month").agg(F.count(F.lit(1)).alias("active")))
    since = F.months_between("month", "cohort_month").cast("int")
    size = F.max("active").over(W.partitionBy("cohort_month"))
    return cells.select("cohort_month", since.alias("months_since_first"),
                        size.alias("cohort_size"), (F.col("active") / size).alias("active_share"))


def recency_rule(days: float, unit_days: int = DAYS_PER_WEEK) -> Column:
    """True when the customer has been silent for more than ``days`` (strictly)."""
    return (F.col("T") - F.col("recency")) * unit_days > days


def confusion(df: DataFrame, flag: Column, alive: Column) -> DataFrame:
    """Counts with "churned" as the positive class."""
    return df.agg(F.count_if(flag & ~alive).alias("tp"), F.count_if(flag & alive).alias("fp"),
                  F.count_if(~flag & ~alive).alias("fn"), F.count_if(~flag & alive).alias("tn"))


def inactivity_rule_economics(rfm_holdout: DataFrame, days_grid: Sequence[int], quarters: float,
                              cost_per_quarter: float = 1.5, margin: float = 6.0,
                              alive: Column | None = None) -> DataFrame:
    """What each "silent for N days" rule would save and lose.

    All rules are counted in one pass; the single row is then unfolded to one row per rule. Without
    a true alive flag a customer counts as alive if it bought in the holdout.
    """
    living = alive if alive is not None else F.col("holdout_purchases") > 0
    sums = []
    for n in days_grid:
        drop = recency_rule(n)
        sums.append(F.struct(
            F.lit(n).alias("days"), F.count_if(drop).alias("dropped"),
            F.count_if(drop & living).alias("dropped_alive"),
            F.coalesce(F.sum(F.when(drop & living, F.col("holdout_purchases"))), F.lit(0))
            .alias("lost_purchases")))
    rows = rfm_holdout.agg(F.array(*sums).alias("g")).select(F.inline("g"))
    lost = F.col("lost_purchases") * margin
    saved = F.col("dropped") * (cost_per_quarter * quarters)
    return rows.select("*", lost.alias("margin_lost"), saved.alias("cost_saved"),
                       (saved - lost).alias("net"))


def purchases_between(tx: DataFrame, start, end, customer: str = "customer_id",
                      date: str = "date") -> DataFrame:
    """Distinct purchase days per customer after ``start`` and up to ``end``."""
    d = _day(date)
    window = tx.filter(~up_to(date, start) & up_to(date, end))
    return (window.select(customer, d.alias("d")).distinct().groupBy(customer)
            .agg(F.count(F.lit(1)).alias("purchases")))


def make_features(tx: DataFrame, cutoff, customers: DataFrame | None = None,
                  customer: str = "customer_id", date: str = "date",
                  amount: str = "amount") -> DataFrame:
    """Predictors known at the cutoff; nothing later enters."""
    end = _as_date(cutoff)
    days = purchase_days(tx.filter(up_to(date, cutoff)), customer, date, amount)
    ago = F.datediff(end, F.col("purchase_date"))
    out = days.groupBy(customer).agg(
        (F.count(F.lit(1)) - 1).cast("double").alias("frequency"),
        (F.datediff(F.max("purchase_date"), F.min("purchase_date")) / 7).alias("recency"),
        (F.datediff(end, F.min("purchase_date")) / 7).alias("T"),
        F.avg("day_amount").alias("mean_spend"),
        (F.datediff(end, F.max("purchase_date")) / 7).alias("weeks_since_last"),
        F.count_if(ago < 28).alias("purchases_4w"), F.count_if(ago < 91).alias("purchases_13w"))
    if customers is None:
        return out
    extra = [c for c in customers.columns if c.startswith("channel_")]
    return out.join(customers.select(customer, *extra), customer, "left")


def train_holdout_design(tx: DataFrame, cutoff, horizon_weeks: int,
                         customer: str = "customer_id", date: str = "date",
                         amount: str = "amount") -> DataFrame:
    """Features at cutoff - H with the target up to the cutoff, and the same one horizon later."""
    import datetime

    at = datetime.date.fromisoformat(str(cutoff))
    step = datetime.timedelta(weeks=horizon_weeks)
    parts = []
    for split, start in (("train", at - step), ("holdout", at)):
        target = purchases_between(tx, start, start + step, customer, date).withColumnRenamed(
            "purchases", "target")
        feats = make_features(tx, start, None, customer, date, amount)
        parts.append(feats.join(target, customer, "left").withColumn("split", F.lit(split))
                     .fillna(0, subset=["target"]))
    return parts[0].unionByName(parts[1])


def frequency_group(frequency: str = "frequency") -> Column:
    """Bands 0, 1, 2-3, 4-7, 8+ of a repeat count."""
    f = F.col(frequency)
    return (F.when(f <= 0, "0").when(f <= 1, "1").when(f <= 3, "2-3").when(f <= 7, "4-7")
            .otherwise("8+"))


def customer_segments(channel: str = "acquisition_channel",
                      frequency: str = "frequency") -> Column:
    """Channel and repeat band (0, 1-3, 4+) as one label."""
    f = F.col(frequency)
    band = F.when(f <= 0, "0 repeat").when(f <= 3, "1-3 repeat").otherwise("4+ repeat")
    return F.concat_ws(" · ", F.col(channel), band)


def rfm_quintiles(rfm_table: DataFrame, alive: Column, customer: str = "customer_id") -> DataFrame:
    """Alive share in the 25 cells of recency quintile x frequency quintile."""
    tiles = with_ntile(rfm_table, 5, ["recency", customer], "recency_quintile")
    tiles = with_ntile(tiles, 5, ["frequency", customer], "frequency_quintile")
    return tiles.groupBy("recency_quintile", "frequency_quintile").agg(
        F.count(F.lit(1)).alias("customers"), F.avg(alive.cast("double")).alias("alive_share"))


def spend_frequency_correlation(rfm_table: DataFrame) -> DataFrame:
    """Correlation of purchase frequency and mean spend among repeat buyers."""
    repeat = rfm_table.filter(F.col("frequency") > 0)
    return repeat.agg(F.count(F.lit(1)).alias("repeat_buyers"),
                      F.corr("frequency", "monetary_value").alias("correlation"))


def cumulative_repeat_purchases(tx: DataFrame, start, customer: str = "customer_id",
                                date: str = "date") -> DataFrame:
    """Cumulative repeat purchase days by week since ``start``.

    The running sum goes over one row per week of the log, whatever its size.
    """
    days = tx.select(customer, _day(date).alias("d")).distinct()
    first = F.min("d").over(W.partitionBy(customer))
    repeat = days.withColumn("first", first).filter("d > first")
    weekly = repeat.groupBy(
        F.floor(F.datediff(F.col("d"), _as_date(start)) / 7).alias("week")).agg(
        F.count(F.lit(1)).alias("repeat_purchases"))
    run = W.orderBy("week").rowsBetween(W.unboundedPreceding, 0)
    return weekly.withColumn("cumulative", F.sum("repeat_purchases").over(run))
