"""Table-valued functions: generate_series, json_each, json_tree."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StringType, StructField, StructType

_ROW = StructType([StructField(n, LongType() if n in ("id", "parent") else StringType()) for n in ("key", "value", "type", "atom", "id", "parent", "fullkey", "path")])


def generate_series(spark: SparkSession, start: int, stop: int | None = None, step: int = 1) -> DataFrame:
    """(value, start, stop, step), inclusive; one argument is the stop of a series from 0. Made by tasks, not on the driver."""
    if stop is None:
        start, stop = 0, start
    if step == 0:
        raise ValueError("generate_series: step cannot be 0")
    n = max(0, (stop - start) // step + 1)
    return spark.range(n).select((F.col("id") * step + start).alias("value"), *[F.lit(v).cast("bigint").alias(k) for k, v in (("start", start), ("stop", stop), ("step", step))])


def _kind(v) -> str:
    return "null" if v is None else "true" if isinstance(v, bool) else "integer" if isinstance(v, int) else "real" if isinstance(v, float) else "text" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def _text(v) -> str | None:
    if v is None:
        return None
    if isinstance(v, bool):
        return "1" if v else "0"
    return json.dumps(v, separators=(",", ":"), sort_keys=True, ensure_ascii=False) if isinstance(v, (list, dict)) else v if isinstance(v, str) else json.dumps(v)


def _children(v):
    return sorted(v.items()) if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else []


def _at(doc, path: str):
    from brindle.functions.jsonfn import _steps

    for s in _steps(path):
        doc = doc[s]
    return doc


def _row(key, v, number: int, parent: int | None, full: str, path: str) -> tuple:
    atom = None if isinstance(v, (list, dict)) else _text(v)
    return (None if key is None else str(key), _text(v), _kind(v), atom, number, parent, full, path)


def _full(path: str, key) -> str:
    return f"{path}[{key}]" if isinstance(key, int) else f"{path}.{key}"


def each_rows(text: str | None, path: str | None = "$"):
    try:
        v = _at(json.loads(text), path or "$")
    except (ValueError, TypeError, KeyError, IndexError):
        return
    path = path or "$"
    if not isinstance(v, (list, dict)):
        yield _row(None, v, 0, None, path, path)
    for number, (key, x) in enumerate(_children(v), 1):
        yield _row(key, x, number, None, _full(path, key), path)


def tree_rows(text: str | None, path: str | None = "$"):
    try:
        v = _at(json.loads(text), path or "$")
    except (ValueError, TypeError, KeyError, IndexError):
        return
    stack, number = [(None, v, None, path or "$", path or "$")], 0
    while stack:
        key, x, parent, full, where = stack.pop()
        yield _row(key, x, number, parent, full, where)
        stack += [(k, y, number, _full(full, k), full) for k, y in reversed(list(_children(x)))]
        number += 1


@udtf(returnType=_ROW)
class JsonEach:
    """Members of the array or object at a path; object keys sorted; bad JSON gives no rows."""

    def eval(self, text: str, path: str = "$"):
        yield from each_rows(text, path)


@udtf(returnType=_ROW)
class JsonTree:
    """The value at a path and, below it, everything in depth-first order."""

    def eval(self, text: str, path: str = "$"):
        yield from tree_rows(text, path)


def json_each_native(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """The correlated join t, json_each(t.col) for objects and arrays without Python: keys and values as text."""
    v = F.try_parse_json(F.col(column))
    df = df.select(*keep, F.to_json(v).alias("__j"))
    members = F.coalesce(
        F.transform(F.map_entries(F.from_json("__j", "map<string,string>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))),
        F.transform(F.from_json("__j", "array<string>"), lambda x, i: F.struct(i.cast("string").alias("key"), x.alias("value"))),
    )
    return df.select(*keep, F.explode(members).alias("m")).select(*keep, "m.key", "m.value")


def register(spark: SparkSession) -> None:
    """json_each and json_tree as table functions for SQL, also LATERAL."""
    spark.udtf.register("json_each", JsonEach)
    spark.udtf.register("json_tree", JsonTree)
