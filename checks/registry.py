"""Collects one case per operator: the Spark query and, where SQL can say it, the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.views import Views, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def case(name: str, sql: str | None = None):
    """Register ``fn(v: Views) -> DataFrame`` as query *name* with oracle *sql*."""
    def add(fn: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, folder: plain(fn(Views(spark, folder)))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn

    return add


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and doubles to six digits, so both engines show one value."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.IntegralType) or (isinstance(f.dataType, T.DecimalType) and f.dataType.scale == 0):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c, 6)
        out.append(c.alias(f.name))
    return df.select(*out)
