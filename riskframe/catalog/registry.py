"""Where queries and their DuckDB counterparts are collected."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskframe.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


def r6(c: str | Column, alias: str | None = None) -> Column:
    """Round to the six places that both engines agree on."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(alias or c)
