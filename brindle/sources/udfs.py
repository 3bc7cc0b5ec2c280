"""User functions: scalar (Arrow), aggregate, table, collations; registered for SQL by name."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def scalar(spark: SparkSession, name: str, fn: Callable, returns: str, deterministic: bool = True, vectorized: bool = True):
    """fn takes values, or Series if vectorized; either way it runs on Arrow batches."""
    u = F.pandas_udf(fn, returns) if vectorized else F.udf(fn, returns, useArrow=True)
    if not deterministic:
        u = u.asNondeterministic()
    return spark.udf.register(name, u)


def aggregate(spark: SparkSession, name: str, fn: Callable[[pd.Series], object], returns: str):
    """fn(Series) -> value, once per group."""

    def typed(x: pd.Series) -> object:
        return fn(x)

    typed.__annotations__ = {"x": pd.Series, "return": float}
    return spark.udf.register(name, F.pandas_udf(typed, returns))


def table(spark: SparkSession, name: str, cls: type, returns: str):
    return spark.udtf.register(name, F.udtf(cls, returnType=returns))


def unregister(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")


def collation(key: Callable[[str], str]) -> Callable[[Column], Column]:
    """A custom collation as a sort-key column."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else key(v))

    return run
