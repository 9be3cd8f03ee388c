"""Compare registered queries with their SQL on the same tables.

Usage: python tests/compare.py SF_DIR [--buckets] [area or query name ...]

With --buckets every ordered sum takes the range-bucket path, whatever its size.
"""

from __future__ import annotations

import glob
import importlib
import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canon(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NA:
            return "null"
        if isinstance(v, float):
            return repr(v + 0.0)
        return str(v)

    cols = sorted(df.columns)
    return sorted(tuple(cell(v) for v in row) for row in df[cols].itertuples(index=False, name=None))


def mismatch(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(sql_df.columns)}"
    kinds = {c: (spark_df[c].dtype.kind, sql_df[c].dtype.kind) for c in spark_df.columns}
    if len(spark_df):
        odd = {c: k for c, k in kinds.items() if k[0] != k[1]}
        if odd:
            return f"types {odd}"
    a, b = canon(spark_df), canon(sql_df)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, e.g. {sorted(spark_df.columns)} {bad[:2]}"
    return None


def main() -> None:
    from tallyfield import plans
    from tallyfield.session import local_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    areas = [a for a in plans.AREAS if a in wanted] or plans.AREAS
    for area in areas:
        if os.path.exists(os.path.join(os.path.dirname(plans.__file__), f"{area}.py")):
            importlib.import_module(f"tallyfield.plans.{area}")
    from tallyfield.plans.registry import REGISTRY

    names = [n for n, q in REGISTRY.items() if not wanted or n in wanted or q.area in wanted]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failed = 0
    for name in names:
        q = REGISTRY[name]
        try:
            t0 = time.time()
            got = q.run(spark, sf).toPandas()
            t1 = time.time()
            note = "no sql"
            t2 = t1
            if q.sql is not None:
                want = con.execute(q.sql).df()
                t2 = time.time()
                note = mismatch(got, want) or "ok"
            if len(got) == 0:
                note += " EMPTY"
        except Exception as err:  # report and go on with the next query
            note = f"ERROR {type(err).__name__}: {str(err)[:700]}"
            t1 = t2 = time.time()
            got = pd.DataFrame()
        if note not in ("ok", "no sql"):
            failed += 1
        print(f"{q.survey_id:4s} {name:34s} rows {len(got):6d} spark {t1 - t0:6.2f}s"
              f" sql {t2 - t1:6.2f}s  {note}", flush=True)
        if note == "no sql" and len(got) <= 12:
            print(got.to_string(), flush=True)
    print(f"{len(names)} queries, {failed} failed")


if __name__ == "__main__":
    main()
