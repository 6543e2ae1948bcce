"""Registered queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _rounded(df: DataFrame, digits: Mapping[str, int]) -> DataFrame:
    """Doubles rounded (6 digits unless named) and without a negative zero."""
    out = []
    for f in df.schema.fields:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            column = F.round(column, digits.get(f.name, 6)) + F.lit(0.0)
        elif isinstance(f.dataType, T.TimestampType):
            # The SQL side has wall-clock timestamps.
            column = column.cast("timestamp_ntz")
        out.append(column.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, doubles: str = "", **digits: int):
    """Registers a query. ``doubles`` names the double columns the SQL side must round alike."""

    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf: _rounded(fn(spark, sf), digits)
        if sql is not None:
            names = doubles.split()
            rounds = ", ".join(f"round(CAST({c} AS DOUBLE), {digits.get(c, 6)}) + 0.0 AS {c}" for c in names)
            ORACLES[name] = f"SELECT * REPLACE ({rounds}) FROM ({sql}) AS q" if names else sql
        return fn

    return register


# SQL pieces for tail probabilities: Simpson's rule over the density from 0, up to a point
# beyond which the tail is below the compared digits.

_STEPS = 4000


def _simpson(upper: str, density: str) -> str:
    weight = f"(CASE WHEN i = 0 OR i = {_STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    point = f"(i * ({upper}) / {_STEPS}.0)"
    body = density.replace("$x", point)
    return f"(list_sum(list_transform(range(0, {_STEPS + 1}), lambda i: {weight} * ({body}))) * ({upper}) / {_STEPS}.0 / 3.0)"


def t_p_sql(t: str, df: str) -> str:
    front = f"exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(({df}) * pi())"
    density = f"{front} * pow(1 + $x * $x / ({df}), -((({df}) + 1) / 2.0))"
    return f"greatest(0.0, 1 - 2 * {_simpson(f'least(abs({t}), 40.0)', density)})"


def z_p_sql(z: str) -> str:
    return f"greatest(0.0, 1 - 2 * {_simpson(f'least(abs({z}), 40.0)', 'exp(-$x * $x / 2) / sqrt(2 * pi())')})"


def chi2_p_sql(x: str, k: str) -> str:
    half = f"(({k}) / 2.0)"
    density = f"CASE WHEN $x = 0 AND ({k}) > 2 THEN 0 WHEN $x = 0 THEN 0.5 ELSE exp(({half} - 1) * ln($x) - $x / 2 - {half} * ln(2) - lgamma({half})) END"
    return f"greatest(0.0, 1 - {_simpson(f'least({x}, 400.0)', density)})"


def f_p_sql(f: str, d1: str, d2: str) -> str:
    a, b = f"(({d1}) / 2.0)", f"(({d2}) / 2.0)"
    density = (
        f"CASE WHEN $x = 0 AND ({d1}) > 2 THEN 0 WHEN $x = 0 THEN 1 ELSE exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln(({d1}) / ({d2})) "
        f"+ ({a} - 1) * ln($x) - ({a} + {b}) * ln(1 + ({d1}) * $x / ({d2}))) END"
    )
    return f"greatest(0.0, 1 - {_simpson(f'least({f}, 60.0)', density)})"
