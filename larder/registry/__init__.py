"""Registered queries over the driver tables, each with its SQL statement where SQL can express it."""
from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from ..sources.driver_views import Views
from .common_sql import compose

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals: the order of addition is free, so the last digits of a sum are not
    fixed. Nine decimals first, so that an exact half survives that noise and goes to even."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType)]
    return df.withColumns({c: F.rint(F.rint(F.col(c) * 1e9) / 1e9 * 1e6) / 1e6 + F.lit(0.0) for c in doubles}) if doubles else df


def query(key: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame`` under ``key``, with its SQL statement if there is one."""

    def register(fn: Callable[[Views], DataFrame]):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(Views(spark, sf_dir)))

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = compose(sql)
        return fn

    return register


def load() -> None:
    """Import the modules that register queries."""
    from . import costing, demand, forecasting, models  # noqa: F401
