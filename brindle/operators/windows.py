"""Window frames that Spark lacks: GROUPS frames, EXCLUDE, DISTINCT and FILTER in window aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

UNBOUNDED = None


def spec(partition: list[str], order: list[Column]) -> WindowSpec:
    w = Window.partitionBy(*partition) if partition else Window.partitionBy()
    return w.orderBy(*order)


def groups_frame(df: DataFrame, partition: list[str], order: list[Column], low: int | None, high: int | None) -> tuple[DataFrame, WindowSpec]:
    """GROUPS BETWEEN: peers get a number, and the frame is a range over it. None is unbounded."""
    df = df.withColumn("__group", F.dense_rank().over(spec(partition, order)))
    w = spec(partition, [F.col("__group")]).rangeBetween(Window.unboundedPreceding if low is None else low, Window.unboundedFollowing if high is None else high)
    return df, w


def excluding(df: DataFrame, partition: list[str], order: list[Column], tie: Column, value: Column, frame: Callable[[WindowSpec], WindowSpec], exclude: str, fold: Callable[[Column], Column], name: str) -> DataFrame:
    """EXCLUDE CURRENT ROW / GROUP / TIES: the frame's rows are collected and the excluded ones filtered. fold makes the
    result from the array of kept values. Memory is the frame of one row, as the definition needs."""
    df = df.withColumn("__p", F.row_number().over(spec(partition, [*order, tie]))).withColumn("__g", F.dense_rank().over(spec(partition, order)))
    rows = F.collect_list(F.struct(F.col("__p").alias("p"), F.col("__g").alias("g"), value.alias("v"))).over(frame(spec(partition, order)))
    keep = {
        "NO OTHERS": lambda e: F.lit(True),
        "CURRENT ROW": lambda e: e["p"] != F.col("__p"),
        "GROUP": lambda e: e["g"] != F.col("__g"),
        "TIES": lambda e: ~((e["g"] == F.col("__g")) & (e["p"] != F.col("__p"))),
    }[exclude]
    df = df.withColumn("__rows", rows)
    return df.withColumn(name, fold(F.transform(F.filter("__rows", keep), lambda e: e["v"]))).drop("__rows", "__p", "__g")


def array_sum(a: Column, kind: str = "bigint") -> Column:
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0).cast(kind), lambda s, x: s + x.cast(kind)))


def distinct_count(x: Column, w: WindowSpec) -> Column:
    return F.size(F.collect_set(x).over(w)).cast("bigint")


def concat_over(x: Column, w: WindowSpec, separator: str = ",") -> Column:
    return F.array_join(F.collect_list(x).over(w), separator)
