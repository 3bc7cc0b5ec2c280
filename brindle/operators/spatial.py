"""Boxes as plain columns min/max per dimension; predicates are pushed into the scan as comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Box = list[tuple[float, float]]


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def overlaps(dims: list[tuple[str, str]], box: Box) -> Column:
    return _all([(F.col(lo) <= b) & (F.col(hi) >= a) for (lo, hi), (a, b) in zip(dims, box)])


def within(dims: list[tuple[str, str]], box: Box) -> Column:
    """The row's box lies in the given one."""
    return _all([(F.col(lo) >= a) & (F.col(hi) <= b) for (lo, hi), (a, b) in zip(dims, box)])


def contains(dims: list[tuple[str, str]], box: Box) -> Column:
    """The row's box encloses the given one."""
    return _all([(F.col(lo) <= a) & (F.col(hi) >= b) for (lo, hi), (a, b) in zip(dims, box)])


def overlap_join(left: DataFrame, right: DataFrame, dims: list[tuple[str, str]], cell: list[float], keys: tuple[str, str]) -> DataFrame:
    """Pairs (left_key, right_key) of overlapping boxes. Boxes are dealt to grid cells, an equi key; a pair is reported only by
    the cell of its overlap's least corner, so no distinct is needed. Empty or inverted boxes join nothing."""

    def cells(df: DataFrame, side: str) -> DataFrame:
        out = df.select(F.col(keys[side == "r"]).alias(f"{side}_key"), *[F.col(c).cast("double").alias(f"{side}_{i}_{k}") for i, (lo, hi) in enumerate(dims) for k, c in (("lo", lo), ("hi", hi))])
        for i, w in enumerate(cell):
            out = out.filter(F.col(f"{side}_{i}_lo") <= F.col(f"{side}_{i}_hi"))
            out = out.withColumn(f"cell{i}", F.explode(F.sequence(F.floor(F.col(f"{side}_{i}_lo") / w), F.floor(F.col(f"{side}_{i}_hi") / w))))
        return out

    on = [f"cell{i}" for i in range(len(cell))]
    both = cells(left, "l").join(cells(right, "r"), on)
    for i, w in enumerate(cell):
        low = F.greatest(f"l_{i}_lo", f"r_{i}_lo")
        both = both.filter((F.col(f"l_{i}_lo") <= F.col(f"r_{i}_hi")) & (F.col(f"r_{i}_lo") <= F.col(f"l_{i}_hi")) & (F.col(f"cell{i}") == F.floor(low / w)))
    return both.select(F.col("l_key").alias("left_key"), F.col("r_key").alias("right_key"))


def nearest(df: DataFrame, key: str, dims: list[tuple[str, str]], point: list[float], k: int) -> DataFrame:
    """(key, dist): the k boxes nearest to a point by Euclidean distance, ties by key. A top-k, not a full sort."""
    gap = [F.greatest(F.lit(p) - F.col(hi), F.col(lo) - F.lit(p), F.lit(0.0)) for (lo, hi), p in zip(dims, point)]
    return df.select(key, F.sqrt(reduce(lambda a, b: a + b, [g * g for g in gap])).alias("dist")).orderBy("dist", key).limit(k)


def nearest_vectors(df: DataFrame, key: str, column: str, query: list[float], k: int) -> DataFrame:
    """(key, dist): the k nearest rows of an array column by Euclidean distance."""
    q = F.array(*[F.lit(float(x)) for x in query])
    d = F.sqrt(F.aggregate(F.zip_with(F.col(column), q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))
    return df.select(key, d.alias("dist")).orderBy("dist", key).limit(k)
