"""JSON functions over text. Reading stays in the JVM; the mutators are Arrow-batched."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def valid(x: Column) -> Column:
    return F.when(x.isNotNull(), F.try_parse_json(x).isNotNull().cast("bigint"))


def minify(x: Column) -> Column:
    """Bad JSON is NULL; object keys come out sorted."""
    return F.to_json(F.try_parse_json(x))


def extract(x: Column, *paths: str, type_name: str = "string") -> Column:
    """One path: its value, cast to type_name; many paths: a JSON array of the values."""
    if len(paths) == 1:
        return F.get_json_object(x, paths[0]).try_cast(type_name)
    parts = [F.coalesce(F.to_json(F.try_variant_get(F.try_parse_json(x), p, "variant")), F.lit("null")) for p in paths]
    return F.when(valid(x) == 1, F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")))


def extract_text(x: Column, path: str) -> Column:
    return F.get_json_object(x, path)


def array_length(x: Column, path: str | None = None) -> Column:
    y = F.get_json_object(x, path) if path else x
    return F.json_array_length(y).cast("bigint")


def kind(x: Column, path: str = "$") -> Column:
    """null, true, integer, real, text, array, object; `true` for both booleans."""
    v = F.try_variant_get(F.try_parse_json(x), path, "variant")
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), F.lit(None)).when(s == "VOID", "null").when(s == "BOOLEAN", "true").when(s == "BIGINT", "integer")
        .when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), "real").when(s == "STRING", "text").when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object")
    )


def quote(x: Column) -> Column:
    """JSON text of a scalar: strings in quotes, NULL as null."""
    plain = F.regexp_replace(F.to_json(F.struct(x.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", "$1")
    return F.when(x.isNull(), "null").otherwise(plain)


def array(*xs: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *[quote(x) for x in xs]), F.lit("]"))


def obj(**pairs: Column) -> Column:
    """Keys sorted."""
    parts = [F.concat(F.lit(json.dumps(k) + ":"), quote(pairs[k])) for k in sorted(pairs)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


_STEP = re.compile(r"\.([^.\[]+)|\[(\d+)\]")


def _steps(path: str) -> list:
    return [m[1] if m[1] is not None else int(m[2]) for m in _STEP.finditer(path)]


def _change(doc, path: str, value, insert: bool, overwrite: bool):
    steps = _steps(path)
    if not steps:
        return value if overwrite else doc
    at = doc
    for s, following in zip(steps, steps[1:]):
        if isinstance(at, dict) and isinstance(s, str):
            if s not in at:
                if not insert:
                    return doc
                at[s] = [] if isinstance(following, int) else {}
            at = at[s]
        elif isinstance(at, list) and isinstance(s, int) and s < len(at):
            at = at[s]
        else:
            return doc
    s = steps[-1]
    if isinstance(at, dict) and isinstance(s, str):
        if overwrite if s in at else insert:
            at[s] = value
    elif isinstance(at, list) and isinstance(s, int):
        if s < len(at) and overwrite:
            at[s] = value
        elif s == len(at) and insert:
            at.append(value)
    return doc


def _remove(doc, path: str):
    steps = _steps(path)
    at = doc
    for s in steps[:-1]:
        if isinstance(at, dict) and s in at or isinstance(at, list) and isinstance(s, int) and s < len(at):
            at = at[s]
        else:
            return doc
    s = steps[-1] if steps else None
    if isinstance(at, dict) and s in at or isinstance(at, list) and isinstance(s, int) and s < len(at):
        del at[s]
    return doc


def _patch(doc, change):
    if not isinstance(change, dict):
        return change
    out = dict(doc) if isinstance(doc, dict) else {}
    for k, v in change.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = _patch(out.get(k), v)
    return out


def _each(x: pd.Series, other, fn) -> pd.Series:
    def one(a, b):
        if a is None or b is None:
            return None
        try:
            return json.dumps(fn(json.loads(a), json.loads(b)), separators=(",", ":"), sort_keys=True, ensure_ascii=False)
        except ValueError:
            return None

    return pd.Series([one(a, b) for a, b in zip(x, other)], dtype=object)


def _mutator(insert: bool, overwrite: bool):
    def make(x: Column, path: str, value: Column) -> Column:
        @F.pandas_udf("string")
        def run(doc: pd.Series, v: pd.Series) -> pd.Series:
            return _each(doc, v, lambda d, value: _change(d, path, value, insert, overwrite))

        return run(x, quote(value))

    return make


insert = _mutator(True, False)
overwrite = _mutator(False, True)
upsert = _mutator(True, True)


def remove(x: Column, path: str) -> Column:
    @F.pandas_udf("string")
    def run(doc: pd.Series) -> pd.Series:
        return _each(doc, ["0"] * len(doc), lambda d, _: _remove(d, path))

    return run(x)


def patch(x: Column, change: Column) -> Column:
    @F.pandas_udf("string")
    def run(doc: pd.Series, c: pd.Series) -> pd.Series:
        return _each(doc, c, _patch)

    return run(x, change)
