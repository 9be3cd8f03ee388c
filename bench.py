"""Headline queries at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS].

Prints one JSON line. Every query is planned, run and written to a sink that drops the rows; the first
same query's SQL on the same tables, where it has one. With $BENCH_SMALL_DIR (say the tables of a tenth of the size)
``growth`` has each query's seconds here over its seconds there.
"""

from __future__ import annotations

import json
import os
import sys
import time

os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

GROUPS = {
    "warm-up: customer table": ["customer_table", "repeat_purchases"],
    "customer base": ["clean_invoices", "purchase_gaps", "rfm", "cohort_retention",
                      "inactivity_rule_economics", "rfm_quintiles"],
    "purchase and spend models": ["bgnbd_fit", "gamma_gamma_fit", "revenue_scores"],
    "experiments": ["srm_test", "sample_size", "cuped", "ratio_delta", "ratio_bootstrap",
                    "sequential_looks"],
    "geo": ["did", "placebo_in_space", "placebo_in_time", "geo_power"],
    "media and draws": ["hdi", "roas_table", "plan_summary", "optimal_allocation"],
    "uplift and double ML": ["qini_table", "policy_comparison", "dml_estimate", "cross_fit"],
    "messy log": ["flag_lines", "match_cancellations", "purchases_by_day", "variant_effects"],
    "survival": ["kaplan_meier", "rmst_gain", "rmst_bootstrap", "cox_fit"],
    "attribution": ["transition_matrix", "markov_credit", "shapley_credit", "bootstrap_credit"],
    "notifications": ["incremental_per_send", "segment_uplift", "transition_model", "q_iteration"],
}


def duckdb_seconds(registry, names, sf_dir: str, cpus: str) -> dict[str, float]:
    try:
        import duckdb
    except ImportError:
        return {}
    con = duckdb.connect()
    con.execute(f"SET threads = {int(cpus)}")
    for file in sorted(os.listdir(sf_dir)):
        if file.endswith(".parquet"):
            con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{sf_dir}/{file}'")
    out = {}
    for n in names:
        if registry[n].sql is not None:
            start = time.perf_counter()
            con.execute(registry[n].sql).fetchall()
            out[n] = round(time.perf_counter() - start, 3)
    return out


def main() -> None:
    from tallyfield.plans import load
    from tallyfield.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "tallyfield-bench")
    spark.sparkContext.setLogLevel("ERROR")
    registry = load()

    def run(name: str, folder: str = sf_dir) -> float:
        start = time.perf_counter()
        registry[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("customer_table")
    times = {n: round(run(n), 3) for names in GROUPS.values() for n in names}
    small = os.environ.get("BENCH_SMALL_DIR")
    growth = {n: round(t / max(run(n, small), 1e-3), 2) for n, t in times.items()} if small else {}
    print(json.dumps({
        "metric": "total seconds of headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
        "cpus": cpus, "duckdb": duckdb_seconds(registry, times, sf_dir, cpus), "growth": growth, "groups": {g: round(sum(times[n] for n in names), 3)
                                 for g, names in GROUPS.items()}}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
