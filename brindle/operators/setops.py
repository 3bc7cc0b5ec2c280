"""Set operations: UNION and friends remove duplicates, INTERSECT binds tighter, a trailing ORDER BY/LIMIT holds for all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def _same_width(a: DataFrame, b: DataFrame, name: str) -> None:
    if len(a.columns) != len(b.columns):
        raise ValueError(f"SELECTs to the left and right of {name} do not have the same number of result columns")


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    _same_width(a, b, "UNION ALL")
    return a.unionAll(b)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    _same_width(a, b, "UNION")
    return a.unionAll(b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    _same_width(a, b, "INTERSECT")
    return a.intersect(b)


def except_(a: DataFrame, b: DataFrame) -> DataFrame:
    _same_width(a, b, "EXCEPT")
    return a.subtract(b)


def limited(df: DataFrame, order: list[Column], limit: int = -1, offset: int = 0) -> DataFrame:
    """ORDER BY with LIMIT/OFFSET; a negative limit is none. Sort and limit together become a top-k."""
    out = df.orderBy(*order) if order else df
    if offset > 0:
        out = out.offset(offset)
    return out.limit(limit) if limit >= 0 else out
