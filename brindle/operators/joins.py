"""Joins whose star keeps all columns of both sides, as the dialect wants. Physical strategies are Catalyst's choice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def using(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """USING: equality on the columns, both copies kept. Frames need aliases if they share a lineage."""
    cond = reduce(lambda a, b: a & b, [left[c] == right[c] for c in columns])
    return left.join(right, cond, how)


def natural(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """NATURAL: all common names; without one a cross join."""
    common = [c for c in left.columns if c in right.columns]
    return using(left, right, common, how) if common else left.crossJoin(right)


def theta(left: DataFrame, right: DataFrame, cond: Column, how: str = "inner") -> DataFrame:
    return left.join(right, cond, how)


def exists(left: DataFrame, right: DataFrame, cond: Column) -> DataFrame:
    return left.join(right, cond, "left_semi")


def not_exists(left: DataFrame, right: DataFrame, cond: Column) -> DataFrame:
    return left.join(right, cond, "left_anti")


def banded(left: DataFrame, right: DataFrame, at: str, low: str, high: str, width: float, keep: list[str] | None = None) -> DataFrame:
    """Range join low <= at <= high through an equi key: the range is cut into bands of a width, each band a join key, so that
    it runs as a shuffle or broadcast hash join instead of nested loops."""
    from pyspark.sql import functions as F

    l = left.withColumn("__band", F.floor(F.col(at) / width))
    r = right.withColumn("__band", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    out = l.join(r, "__band").filter((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("__band")
    return out.select(*keep) if keep else out


def correlated(outer: DataFrame, inner: DataFrame, keys: dict[str, str], found: dict[str, Column], counts: tuple[str, ...] = ()) -> DataFrame:
    """outer with correlated scalar subqueries over inner as columns: aggregates `found` over the inner rows whose keys (outer name:
    inner name) are equal. An aggregate may also compare inner with outer columns, as in count(when(inner > outer, 1)); those in
    `counts` are 0 where no row matches, the others NULL.

    One hash join by the keys and one aggregation per distinct outer row, however the aggregate compares: written as a subquery, a
    comparison beside the equality makes Catalyst join by nested loops."""
    each = outer.distinct()
    on = reduce(lambda a, b: a & b, [F.col(o) == F.col(i) for o, i in keys.items()])
    per = each.join(inner, on).groupBy(*outer.columns).agg(*[e.alias(n) for n, e in found.items()])
    per = per.select(*[F.col(x).alias(f"__{x}") for x in outer.columns], *found)
    same = reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(f"__{x}")) for x in outer.columns])
    return outer.join(per, same, "left").select(*outer.columns, *[F.coalesce(F.col(n), F.lit(0)).alias(n) if n in counts else F.col(n) for n in found])
