"""Registration of checked queries: a Spark callable and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import Inputs, duckdb_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def _columns(spec: str) -> list[tuple[str, str]]:
    """``name`` (number or text as is), ``name:d`` rounded double, ``name:l`` BIGINT, ``name:b`` boolean."""
    return [(c.split(":") + [""])[:2] for c in spec.replace(",", " ").split()]


def _rounded(x: Column) -> Column:
    """``x`` to ``DIGITS`` digits, halves away from zero, as DuckDB's ``round``; Spark's goes through decimals, which takes longer than a join."""
    scaled = x * 10.0**DIGITS
    whole = F.rint(scaled)
    part = F.abs(scaled - whole)
    half = (scaled + F.signum(scaled) * 0.5) / 10.0**DIGITS
    return F.when(part < 0.5, whole / 10.0**DIGITS).when(part == 0.5, half).otherwise(x)


def _spark_shape(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for name, kind in _columns(spec):
        c = F.col(name)
        if kind == "d":
            c = _rounded(c.cast("double")) + F.lit(0.0)
        elif kind == "l":
            c = c.cast("long")
        elif kind == "b":
            c = c.cast("boolean")
        out.append(c.alias(name))
    return df.select(*out)


def _sql_shape(sql: str, spec: str) -> str:
    out = []
    for name, kind in _columns(spec):
        if kind == "d":
            out.append(f"round(CAST({name} AS DOUBLE), {DIGITS}) + 0e0 AS {name}")
        elif kind == "l":
            out.append(f"CAST({name} AS BIGINT) AS {name}")
        elif kind == "b":
            out.append(f"CAST({name} AS BOOLEAN) AS {name}")
        else:
            out.append(name)
    return f"SELECT {', '.join(out)} FROM (\n{sql}\n) shaped"


def check(name: str, spec: str, sql: str | None = None, views: str = ""):
    """Register ``fn(inputs)`` under ``name``; both sides get the columns of ``spec``."""

    def add(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: _spark_shape(fn(Inputs(spark, sf_dir)), spec)
        if sql is not None:
            ORACLES[name] = duckdb_sql(views.split(), _sql_shape(sql, spec))
        return fn

    return add
