"""Registry of runnable queries and of the SQL text that checks each of them.

A query is registered with its Spark callable, the names of the shared SQL views its check text needs and
the number of digits its DOUBLE columns are rounded to on both sides (order of summation differs
between engines, so unrounded doubles cannot be compared by hash).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfield.plans.views import with_clause

Run = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Run] = {}
ORACLE: dict[str, str] = {}
_TEXT: dict[str, tuple[str, str]] = {}


def _digits(spec: str | dict[str, int] | None) -> dict[str, int]:
    if spec is None:
        return {}
    if isinstance(spec, dict):
        return spec
    out = {}
    for word in spec.split():
        name, _, n = word.partition(":")
        out[name] = int(n) if n else 6
    return out


def query(name: str, sql: str | None = None, views: str = "", dbl: str | dict[str, int] | None = None):
    """Register ``name``. ``dbl`` lists DOUBLE columns as ``"a b:3"`` (6 digits unless given)."""
    digits = _digits(dbl)

    def register(fn: Run) -> Run:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            if not digits:
                return df
            return df.select(
                *[
                    (F.round(F.col(k), digits[k]) + F.lit(0.0)).alias(k) if k in digits else F.col(k)
                    for k in df.columns
                ]
            )

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            text = sql
            if digits:
                rep = ", ".join(f"round({k}, {n}) + 0e0 AS {k}" for k, n in digits.items())
                text = f"SELECT * REPLACE ({rep}) FROM ({sql})"
            _TEXT[name] = (views, text)
        return fn

    return register


def build_oracle() -> None:
    """Fill ``ORACLE`` once every module has declared its views."""
    for name, (views, text) in _TEXT.items():
        ORACLE[name] = with_clause(views) + text
