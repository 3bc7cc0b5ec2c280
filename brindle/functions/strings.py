"""String, blob and conditional functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.dialect import real_text


def substr(x: Column, start: Column | int, count: Column | int | None = None) -> Column:
    """1-based; a start below 0 counts from the end; start 0 loses one character of the count; a count below 0 takes characters before."""
    n = F.length(x).cast("bigint")
    y = F.lit(start) if isinstance(start, int) else start
    y = y.cast("bigint")
    if count is None:
        return F.substring(x, F.greatest(F.when(y < 0, n + y).otherwise(y - 1), F.lit(0)).cast("int") + 1, F.length(x))
    z = (F.lit(count) if isinstance(count, int) else count).cast("bigint")
    size = F.abs(z)
    first = F.when(y < 0, n + y).when(y > 0, y - 1).otherwise(F.lit(0))
    size = F.when((y == 0) & (size > 0), size - 1).otherwise(size)
    size = F.when(first < 0, F.greatest(size + first, F.lit(0))).otherwise(size)
    first = F.greatest(first, F.lit(0))
    back = first - size
    size = F.when((z < 0) & (back < 0), size + back).otherwise(size)
    first = F.when(z < 0, F.greatest(back, F.lit(0))).otherwise(first)
    return F.when(size <= 0, F.when(x.isNotNull(), "")).otherwise(F.substring(x, (F.least(first, n) + 1).cast("int"), F.least(size, n).cast("int")))


def trim(x: Column, chars: str | None = None) -> Column:
    return F.btrim(x, F.lit(chars)) if chars is not None else F.btrim(x)


def replace(x: Column, a: Column, b: Column) -> Column:
    return F.when(a == "", x).otherwise(F.replace(x, a, b))


def instr(x: Column, y: Column) -> Column:
    return F.call_function("instr", x, y).cast("bigint")


def unhex(x: Column, ignore: str = "") -> Column:
    """Bad input gives NULL."""
    y = F.translate(x, ignore, "") if ignore else x
    return F.when((F.length(y) % 2 == 0) & y.rlike(r"\A[0-9A-Fa-f]*\z"), F.unhex(y))


def quote(x: Column) -> Column:
    """SQL literal of a text or number."""
    kind = F.typeof(x)
    return F.when(x.isNull(), "NULL").when(kind == "string", F.concat(F.lit("'"), F.replace(x.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))).when(kind == "double", real_text(x.try_cast("double"))).otherwise(x.cast("string"))


def quote_blob(x: Column) -> Column:
    return F.when(x.isNull(), "NULL").otherwise(F.concat(F.lit("X'"), F.hex(x), F.lit("'")))


def unicode(x: Column) -> Column:
    """First code point; '' gives NULL."""
    return F.when(F.length(x) > 0, F.ascii(x).cast("bigint"))


def char(*codes: Column) -> Column:
    """Characters of code points; NULLs are skipped; out of range gives U+FFFD."""
    one = [F.when(c.isNull(), "").when((c < 0) | (c > 0x10FFFF) | c.between(0xD800, 0xDFFF), "�").otherwise(F.decode(F.unhex(F.lpad(F.hex(c.cast("bigint")), 8, "0")), "UTF-32")) for c in codes]
    return F.concat(*one) if one else F.lit("")


def typeof(x: Column) -> Column:
    kind = F.typeof(x)
    return F.when(x.isNull(), "null").when(kind == "string", "text").when(kind.isin("double", "float") | kind.startswith("decimal"), "real").when(kind == "binary", "blob").otherwise("integer")


def iif(c: Column, a: Column, b: Column) -> Column:
    """A NULL condition takes b."""
    return F.when(c, a).otherwise(b)


def likely(x: Column) -> Column:
    """Hints are identities."""
    return x


unlikely = likely


def likelihood(x: Column, p: float) -> Column:
    if not 0 <= p <= 1:
        raise ValueError("likelihood takes a probability between 0.0 and 1.0")
    return x


def zeroblob(n: Column) -> Column:
    return F.unhex(F.repeat(F.lit("00"), F.greatest(n, F.lit(0)).cast("int")))


def scalar_min(*xs: Column) -> Column:
    """NULL arguments are skipped."""
    return F.least(*xs)


def scalar_max(*xs: Column) -> Column:
    return F.greatest(*xs)


def soundex(x: Column) -> Column:
    """'?000' for NULL or a text without letters."""
    letters = F.regexp_replace(x, "[^A-Za-z]", "")
    return F.when(letters.isNull() | (letters == ""), "?000").otherwise(F.soundex(letters))


def snippet(x: Column, term: str, before: str = "<b>", after: str = "</b>", around: int = 30) -> Column:
    """The first occurrence of a term (ASCII case folded) with its surroundings."""
    found = F.regexp_extract(x, f"(?is)(.{{0,{around}}})\\b({re.escape(term)})\\b(.{{0,{around}}})", 0)
    return highlight(found, term, before, after)


def highlight(x: Column, term: str, before: str = "<b>", after: str = "</b>") -> Column:
    return F.regexp_replace(x, f"(?i)\\b({re.escape(term)})\\b", f"{before}$1{after}")


_SPEC = re.compile(r"%([-+ 0#,!]*)(\*|\d+)?(?:\.(\*|\d+))?(?:l{0,2})([a-zA-Z%])")


@F.pandas_udf(T.StringType())
def _general(value: pd.Series, spec: pd.Series) -> pd.Series:
    """%g and %G: the one conversion that Java writes differently."""
    return pd.Series([None if v is None or v != v else s % v for v, s in zip(value, spec)])


def printf(fmt: str, *args: Column) -> Column:
    """printf with a literal format, taken apart when the plan is made. A missing or NULL argument is '' or 0."""
    left, out, at = list(args), [], 0

    def take() -> Column | None:
        return left.pop(0) if left else None

    for m in _SPEC.finditer(fmt):
        out.append(F.lit(fmt[at : m.start()]))
        at = m.end()
        flags, width, precision, kind = m.groups()
        if kind == "%":
            out.append(F.lit("%"))
            continue
        if kind == "n":
            continue
        if "*" in (width, precision):
            raise ValueError("a * width is not a literal; put the number into the format")
        if kind not in "diufFeEgGxXoszcqQpw":
            out.append(F.lit(m[0]))  # unknown: echoed, no argument taken
            continue
        x = take()
        flags = flags.replace("!", "")
        w = flags.replace("#", "") + (width or "") if width or flags else ""
        if kind in "diu":
            v = F.coalesce(x.try_cast("bigint"), F.lit(0).cast("bigint")) if x is not None else F.lit(0).cast("bigint")
            out.append(F.format_string(f"%{w}d", v))
        elif kind in "xXop":
            v = F.coalesce(x.try_cast("bigint"), F.lit(0).cast("bigint")) if x is not None else F.lit(0).cast("bigint")
            out.append(F.format_string(f"%{w}{'X' if kind == 'p' else kind}", v))
        elif kind in "fFeE":
            v = F.coalesce(x.try_cast("double"), F.lit(0.0)) if x is not None else F.lit(0.0)
            s = F.format_string(f"%{w}.{precision or 6}{'f' if kind in 'fF' else 'e'}", v)
            out.append(F.upper(s) if kind == "E" else s)
        elif kind in "gG":
            v = F.coalesce(x.try_cast("double"), F.lit(0.0)) if x is not None else F.lit(0.0)
            out.append(_general(v, F.lit(f"%{flags}{width or ''}.{precision or 6}{kind}")))
        else:
            text = F.lit(None).cast("string") if x is None else x.cast("string")
            if kind in "qw":
                text = F.replace(F.coalesce(text, F.lit("(NULL)")), F.lit("'" if kind == "q" else '"'), F.lit("''" if kind == "q" else '""'))
            elif kind == "Q":
                text = quote(text)
            elif kind == "c":
                text = F.substring(F.coalesce(text, F.lit("")), 1, 1)
            text = F.coalesce(text, F.lit(""))
            if precision is not None and kind != "c":
                text = F.substring(text, 1, int(precision))
            if width:
                text = F.rpad(text, F.greatest(F.length(text), F.lit(int(width))), F.lit(" ")) if "-" in flags else F.lpad(text, F.greatest(F.length(text), F.lit(int(width))), F.lit(" "))
            out.append(text)
    out.append(F.lit(fmt[at:]))
    return F.concat(*out)
