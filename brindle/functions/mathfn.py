"""Math functions. A domain error gives NaN, not NULL."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _nan() -> Column:
    return F.lit(float("nan"))


def rounded(x: Column, n: int | None = None) -> Column:
    """Half away from zero; without digits an INTEGER where it fits."""
    n = 0 if n is None else min(max(n, 0), 30)
    out = F.round(x.cast("double"), n)
    return F.coalesce(out.try_cast("bigint")) if n == 0 else out


def trunc(x: Column, n: int = 0) -> Column:
    scale = 10.0**n
    out = F.when(x < 0, F.call_function("ceil", x.cast("double") * scale)).otherwise(F.call_function("floor", x.cast("double") * scale)).cast("double") / scale
    return out.cast("bigint") if n == 0 else out


def ceil(x: Column) -> Column:
    return F.ceil(x.cast("double")).cast("double")


def floor(x: Column) -> Column:
    return F.floor(x.cast("double")).cast("double")


def ln(x: Column) -> Column:
    x = x.cast("double")
    return F.when(x < 0, _nan()).when(x == 0, F.lit(float("-inf"))).otherwise(F.ln(x))


def log(x: Column, base: Column | None = None) -> Column:
    """The natural logarithm, or that to a base given first in the dialect."""
    return ln(x) if base is None else ln(x) / ln(base)


def log10(x: Column) -> Column:
    return F.when(x < 0, _nan()).when(x == 0, F.lit(float("-inf"))).otherwise(F.log10(x.cast("double")))


def log2(x: Column) -> Column:
    return F.when(x < 0, _nan()).when(x == 0, F.lit(float("-inf"))).otherwise(F.log2(x.cast("double")))


def sqrt(x: Column) -> Column:
    return F.sqrt(x.cast("double"))


def sign(x: Column) -> Column:
    return F.signum(x.cast("double")).cast("bigint")


def mod(x: Column, y: Column) -> Column:
    return F.try_mod(x.cast("bigint"), y.cast("bigint"))


def random() -> Column:
    """Any 64-bit integer."""
    return F.shiftleft((F.rand() * 2**32).cast("bigint") - 2**31, 32).bitwiseOR((F.rand() * 2**32).cast("bigint"))


@F.pandas_udf(T.BinaryType())
def _bytes(n: pd.Series) -> pd.Series:
    return n.map(lambda k: os.urandom(max(1, int(k))))


def randomblob(n: Column) -> Column:
    return _bytes.asNondeterministic()(n)


#: Built-in functions of the same meaning: all through DOUBLE.
SAME = ("exp", "sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh", "radians", "degrees")


def call(name: str, x: Column) -> Column:
    if name not in SAME:
        raise ValueError(f"unknown function {name}")
    return F.call_function(name, x.cast("double"))
