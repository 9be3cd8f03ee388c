"""Declared schemas of the input tables (fixed values: names and types of the data model)."""

from __future__ import annotations

from pyspark.sql import types as T

TRANSACTIONS = "customer_id bigint, date date, amount double"
DATED_LOG = "id bigint, date int, cds_bought int, spent double"
INVOICE_LINES = ("invoice string, stock_code string, description string, quantity bigint,"
                 " invoice_date timestamp_ntz, price double, customer_id bigint, country string")
CUSTOMERS = ("customer_id bigint, acquisition_channel string, first_date date,"
             " channel_social int, channel_referral int")
RFM = "customer_id bigint, frequency double, recency double, T double, monetary_value double"
SCORES = ("customer_id string, p_alive double, clv_mean double, clv_hdi_low double,"
          " clv_hdi_high double, segment string, model_version string, scored_at date")
EXPERIMENT = ("recency int, history double, mens int, womens int, zip_code string, newbie int,"
              " channel string, treatment int, conversion int, spend double, true_cate double")
GEO_PANEL = "date date, geo string, region string, sales double, treated int, post int"
WEEKLY_MEDIA = ("date_week date, tv double, search double, social double, display double,"
                " price_index double, holiday int, t int, y double")
LIFT_TESTS = ("channel string, x double, delta_x double, delta_y double, sigma double, date date,"
              " test_start date, test_weeks int")
DRAWS = "draw bigint, key string, value double"
JOURNEYS = "user_id bigint, path string, converted int"
SUBSCRIBERS = ("customer_id bigint, start_date date, cancel_date date, plan string,"
               " onboarded int, intro_offer int")
USER_DAY_LOG = ("user_id bigint, segment string, day int, eligible tinyint, action tinyint,"
                " sent tinyint, opened tinyint, session tinyint, purchase tinyint, margin float,"
                " opted_out_today tinyint, fatigue_before float, days_since_before smallint")
APP_USERS = ("customer_id bigint, acquisition_channel string, tenure_months double,"
             " orders_12m double, days_since_last_order double, avg_order_value double,"
             " email_open_rate double, mobile_share double, loyalty_member int, app_installed int,"
             " spend_next_26w double")
RETENTION_COUNTS = "year int, regular int, highend int"

TABLES = {
    "retailer_transactions": TRANSACTIONS, "retailer_customers": CUSTOMERS,
    "email_experiment": EXPERIMENT, "geo_panel": GEO_PANEL, "mmm_weekly": WEEKLY_MEDIA,
    "mmm_lift_tests": LIFT_TESTS, "subscribers": SUBSCRIBERS, "journeys": JOURNEYS,
    "user_days": USER_DAY_LOG, "app_install_customers": APP_USERS, "rfm": RFM, "draws": DRAWS,
    "sbg_retention": RETENTION_COUNTS,
}


def schema(name: str) -> T.StructType:
    """The declared schema of a named table."""
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}; known: {sorted(TABLES)}")
    return T._parse_datatype_string(TABLES[name])
