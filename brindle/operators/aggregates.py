"""Aggregates of the dialect; all combine map-side except the ordered collections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions import jsonfn


def total(x: Column) -> Column:
    """0.0 on empty input, always REAL."""
    return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))


def sum_or_real(x: Column) -> Column:
    """SUM of integers that becomes REAL on overflow: the result is DOUBLE."""
    return F.coalesce(F.try_sum(x).cast("double"), F.sum(x.cast("double")))


def group_concat(x: Column, separator: str = ",", order: Column | None = None, distinct: bool = False) -> Column:
    """NULLs are skipped; ordered by `order`, or by the text itself, so that the result is determined."""
    text = x.cast("string")
    if distinct:
        items = F.array_sort(F.collect_set(text))
    else:
        key = order if order is not None else text
        items = F.transform(F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(key.alias("k"), text.alias("v"))))), lambda s: s["v"])
    return F.when(F.size(items) > 0, F.array_join(items, separator))


def filtered(x: Column, where: Column) -> Column:
    """The argument of agg(x) FILTER (WHERE p)."""
    return F.when(where, x)


def json_group_array(x: Column, order: Column) -> Column:
    """NULLs stay as null; '[]' on empty input."""
    items = F.array_sort(F.collect_list(F.struct(order.alias("k"), jsonfn.quote(x).alias("v"))))
    return F.concat(F.lit("["), F.array_join(F.transform(items, lambda s: s["v"]), ","), F.lit("]"))


def json_group_object(key: Column, x: Column) -> Column:
    items = F.array_sort(F.collect_list(F.struct(key.cast("string").alias("k"), jsonfn.quote(x).alias("v"))))
    return F.concat(F.lit("{"), F.array_join(F.transform(items, lambda s: F.concat(jsonfn.quote(s["k"]), F.lit(":"), s["v"])), ","), F.lit("}"))


def representative(x: Column, of_max: Column | None = None, of_min: Column | None = None) -> Column:
    """A bare column beside aggregates: the value in the row of the only MAX or MIN, else any."""
    return F.max_by(x, of_max) if of_max is not None else F.min_by(x, of_min) if of_min is not None else F.any_value(x)
