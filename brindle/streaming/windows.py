"""Event-time aggregation, an extension beyond the dialect: the same function serves a batch and a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, ts: str, width: str, keys: list[str], value: str, late: str | None = None) -> DataFrame:
    d = df.withColumn("__ts", F.col(ts).cast("timestamp"))
    if late:
        d = d.withWatermark("__ts", late)
    return d.groupBy(F.window("__ts", width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(df: DataFrame, ts: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    d = df.withColumn("__ts", F.col(ts).cast("timestamp"))
    if late:
        d = d.withWatermark("__ts", late)
    return d.groupBy(F.session_window("__ts", gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
