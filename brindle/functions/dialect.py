"""Operators of the dialect as Columns: arithmetic, casts, bits, patterns, collations. Everything stays in JVM expressions.

Types are static: integers are BIGINT, REAL is DOUBLE, TEXT is STRING, BLOB is BINARY; truth values projected as BIGINT."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
_INTEGER = r"^\s*([+-]?\d+)"


def flag(p: Column) -> Column:
    """A predicate as 0/1 (NULL stays NULL)."""
    return p.cast("bigint")


def numeric_prefix(text: Column) -> Column:
    """Leading number of a text as DOUBLE, 0.0 without one."""
    return F.when(text.isNotNull(), F.coalesce(F.regexp_extract(text, _NUMBER, 1).try_cast("double"), F.lit(0.0)))


def integer_prefix(text: Column) -> Column:
    return F.when(text.isNotNull(), F.coalesce(F.regexp_extract(text, _INTEGER, 1).try_cast("bigint"), F.lit(0).cast("bigint")))


def add(a: Column, b: Column) -> Column:
    """BIGINT + BIGINT whose overflow becomes a float: the result is DOUBLE."""
    return F.coalesce(F.try_add(a, b).cast("double"), a.cast("double") + b.cast("double"))


def subtract(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_subtract(a, b).cast("double"), a.cast("double") - b.cast("double"))


def multiply(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_multiply(a, b).cast("double"), a.cast("double") * b.cast("double"))


def divide(a: Column, b: Column, integers: bool = False) -> Column:
    """x/0 is NULL; integers are divided towards zero."""
    return F.call_function("div", a, F.nullif(b, F.lit(0))) if integers else F.try_divide(a.cast("double"), b.cast("double"))


def modulo(a: Column, b: Column) -> Column:
    return F.try_mod(a.cast("bigint"), b.cast("bigint"))


def shift_left(x: Column, n: Column) -> Column:
    """Counts below 0 or above 63 give 0 (Spark alone would mask the count)."""
    return F.when((n < 0) | (n >= 64), F.lit(0).cast("bigint")).otherwise(F.call_function("shiftleft", x.cast("bigint"), n.cast("int")))


def shift_right(x: Column, n: Column) -> Column:
    """A count above 63 fills with the sign."""
    return F.when(n < 0, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftright", x.cast("bigint"), F.least(n, F.lit(63)).cast("int")))


def affinity(type_name: str) -> str:
    """Storage class of a declared type: by substring, in this order."""
    t = type_name.upper()
    if "INT" in t:
        return "integer"
    if any(x in t for x in ("CHAR", "CLOB", "TEXT")):
        return "text"
    if not t or "BLOB" in t:
        return "blob"
    return "real" if any(x in t for x in ("REAL", "FLOA", "DOUB")) else "numeric"


SPARK_TYPES = {"integer": "bigint", "text": "string", "blob": "binary", "real": "double", "numeric": "double"}


def real_text(x: Column) -> Column:
    """Text of a REAL: 1.0 -> '1.0', 1e20 -> '1.0e+20'."""
    return F.regexp_replace(F.regexp_replace(x.cast("string"), "E(\\d)", "e+$1"), "E-", "e-")


def cast(x: Column, type_name: str, source: str) -> Column:
    """CAST that never fails. source: the storage class of x (integer, real, text, blob)."""
    to = affinity(type_name)
    if source == "blob" and to != "blob":
        x, source = F.decode(x, "UTF-8"), "text"
    if to == "text":
        return real_text(x) if source == "real" else x.cast("string")
    if to == "blob":
        return x if source == "blob" else F.encode(cast(x, "text", source), "UTF-8")
    if to == "integer":
        if source == "real":
            limit = 9.223372036854775e18
            return F.when(x >= limit, F.lit(2**63 - 1)).when(x <= -limit, F.lit(-(2**63))).otherwise(x.try_cast("bigint"))
        return integer_prefix(x) if source == "text" else x.cast("bigint")
    return numeric_prefix(x) if source == "text" else x.cast("double")


def ascii_lower(x: Column) -> Column:
    return F.translate(x, string.ascii_uppercase, string.ascii_lowercase)


def like(x: Column, pattern: Column | str, escape: str | None = None) -> Column:
    """LIKE folds ASCII letters only. Without ESCAPE no character escapes; with it, the character after it is literal."""
    if isinstance(pattern, str):
        out, i = [], 0
        while i < len(pattern):
            ch = pattern[i]
            if ch == escape and i + 1 < len(pattern):
                i += 1
                ch = pattern[i]
                out.append("\\" + ch if ch in "%_\\" else ch)
            else:
                out.append("\\\\" if ch == "\\" else ch)
            i += 1
        p = F.lit("".join(out))
    else:
        p = F.replace(pattern, F.lit("\\"), F.lit("\\\\"))
    return F.call_function("like", ascii_lower(x), ascii_lower(p))


def glob_regex(pattern: str) -> str:
    """* ? [a-z] [^a-z] as an anchored regular expression."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[" and (end := pattern.find("]", i + (2 if pattern[i + 1 : i + 2] != "^" else 3))) > 0:
            body = pattern[i + 1 : end]
            no = body.startswith("^")
            out.append("[" + "^" * no + re.sub(r"([\\\[\]&~])", r"\\\1", body[no:]) + "]")
            i = end
        else:
            out.append({"*": "(?s:.*)", "?": "(?s:.)"}.get(c) or re.escape(c))
        i += 1
    return r"\A" + "".join(out) + r"\z"


def glob(x: Column, pattern: str) -> Column:
    return x.rlike(glob_regex(pattern))


def collate(x: Column, name: str) -> Column:
    """Sort and comparison key: BINARY, NOCASE (ASCII), RTRIM."""
    return {"BINARY": lambda c: c, "NOCASE": ascii_lower, "RTRIM": lambda c: F.rtrim(c)}[name.upper()](x)


def same(a: Column, b: Column) -> Column:
    """IS / IS NOT DISTINCT FROM."""
    return a.eqNullSafe(b)


def concat(*parts: Column) -> Column:
    """|| : NULL if any part is."""
    return F.concat(*[p.cast("string") for p in parts])


def text_compare_key(text: Column) -> Column:
    """Order of mixed values kept as text: NULL, numbers by value, then other text."""
    n = text.try_cast("double")
    return F.struct(F.when(text.isNull(), 0).when(n.isNotNull(), 1).otherwise(2), n, text)
