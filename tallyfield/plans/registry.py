"""How a query is declared.

A query has a column specification, e.g. ``"customer_id:i first:d spend:2 label:s"``. Both sides are
cast to it, so Spark and the SQL engine return the same names and types: ``i`` bigint, ``s`` string,
``d`` date as text, ``b`` boolean, and a digit for a double rounded to that many places.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.plans.roles import sql_with


@dataclass(frozen=True)
class Query:
    survey_id: str
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    area: str


REGISTRY: dict[str, Query] = {}


def query(survey_id: str, name: str, spec: str, roles: str = "", sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``sql`` may use the CTEs named in ``roles``."""
    columns = [c.split(":") for c in spec.split()]

    def wrap(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return shaped(fn(spark, sf_dir), columns)

        text = None if sql is None else sql_with(roles.split(), sql_shape(sql, columns))
        area = fn.__module__.rsplit(".", 1)[-1]
        REGISTRY[name] = Query(survey_id, name, run, text, area)
        return fn

    return wrap


def shaped(df: DataFrame, columns) -> DataFrame:
    out = []
    for name, kind in columns:
        c = F.col(name)
        if kind == "i":
            c = c.cast("bigint")
        elif kind in ("s", "d"):
            c = (c.cast("date") if kind == "d" else c).cast("string")
        elif kind == "b":
            c = c.cast("boolean")
        else:
            c = F.round(c.cast("double"), int(kind)) + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(*out)


def sql_shape(sql: str, columns) -> str:
    out = []
    for name, kind in columns:
        if kind == "i":
            c = f'CAST("{name}" AS BIGINT)'
        elif kind == "d":
            c = f'CAST(CAST("{name}" AS DATE) AS VARCHAR)'
        elif kind == "s":
            c = f'CAST("{name}" AS VARCHAR)'
        elif kind == "b":
            c = f'CAST("{name}" AS BOOLEAN)'
        else:
            c = f'round(CAST("{name}" AS DOUBLE), {kind}) + 0.0'
        out.append(f'{c} AS "{name}"')
    return f"SELECT {', '.join(out)} FROM ({sql}) AS result"
