"""A front door for the dialect's SQL: spellings that Spark SQL does not take are rewritten; all planning is Catalyst's."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from brindle.plans import operators

_LEX = re.compile(r"""('(?:[^']|'')*')|("(?:[^"]|"")*")|(`[^`]*`)|(\[[A-Za-z_][^\]\n]*\])|(--[^\n]*)|(/\*.*?\*/)|(==)|(0[xX][0-9a-fA-F]+)|([A-Za-z_][A-Za-z0-9_]*)|(;)|(\s+)|(.)""", re.S)

def split(sql: str) -> list[str]:
    """Statements, split at semicolons outside of quotes and comments."""
    out, now = [], []
    for m in _LEX.finditer(sql):
        if m[10]:
            out.append("".join(now))
            now = []
        else:
            now.append(m[0])
    return [s.strip() for s in [*out, "".join(now)] if s.strip()]


def rewrite(sql: str) -> str:
    """"x" and [x] to backticks, == to =, hex integers, TOTAL, NOT NULL / ISNULL / NOTNULL postfixes, GLOB with a
    literal pattern, LIMIT m, n, IFNULL as is. A [ that follows a name or a bracket stays an array index."""
    from brindle.functions.dialect import glob_regex

    out: list[str] = []
    items = [(m.lastindex, m[0]) for m in _LEX.finditer(sql)]
    i = 0

    def following(at: int) -> int:
        while at < len(items) and items[at][0] in (5, 6, 11):
            at += 1
        return at

    while i < len(items):
        kind, text = items[i]
        low = text.lower()
        if kind == 2:
            out.append("`" + text[1:-1].replace('""', '"').replace("`", "``") + "`")
        elif kind == 4:
            out.append("`" + text[1:-1] + "`")
        elif kind == 7:
            out.append("=")
        elif kind == 8:
            v = int(text, 16)
            out.append(str(v - (1 << 64) if v >= 1 << 63 else v))
        elif kind == 9 and low == "isnull":
            out.append("IS NULL")
        elif kind == 9 and low == "notnull":
            out.append("IS NOT NULL")
        elif kind == 9 and low == "total" and (j := following(i + 1)) < len(items) and items[j][1] == "(":
            depth, k = 0, j
            while k < len(items):
                depth += {"(": 1, ")": -1}.get(items[k][1], 0)
                if depth == 0:
                    break
                k += 1
            inner = rewrite("".join(t for _, t in items[j + 1 : k]))
            out.append(f"coalesce(sum(cast({inner} as double)), 0.0D)")
            i = k
        elif kind == 9 and low == "glob" and (j := following(i + 1)) < len(items) and items[j][0] == 1:
            pattern = glob_regex(items[j][1][1:-1].replace("''", "'"))
            out.append("RLIKE '" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'")
            i = j
        elif kind == 9 and low == "regexp":
            out.append("RLIKE")
        elif kind == 9 and low == "limit" and (m := re.match(r"limit\s+(\d+)\s*,\s*(-?\d+)", "".join(t for _, t in items[i:]), re.I)):
            out.append(f"LIMIT {m[2]} OFFSET {m[1]}" if int(m[2]) >= 0 else f"OFFSET {m[1]}")
            used = len(m[0])
            while used > 0:
                used -= len(items[i][1])
                i += 1
            i -= 1
        elif kind == 1:
            out.append("'" + text[1:-1].replace("\\", "\\\\").replace("''", "\\'") + "'")
        else:
            out.append(text)
        i += 1
    return "".join(out)


#: Type names of integers. Fixed values.
INTEGERS = {"tinyint", "smallint", "int", "bigint"}
_EXPLAIN = re.compile(r"explain\s+query\s+plan\b", re.I)
_PRAGMA = re.compile(r"pragma\s+(table_info|table_list)\s*(?:\(\s*(\w+)\s*\))?\Z", re.I)


def integer_columns(spark: SparkSession, text: str) -> set[str]:
    """Columns of the tables that a statement names which are integers wherever they occur."""
    kinds: dict[str, set[str]] = {}
    for name in {t.strip('`"').lower() for t in operators.tokens(text) if re.match(r"[A-Za-z_`\"]", t)}:
        if re.fullmatch(r"\w+", name) and spark.catalog.tableExists(name):
            for column, kind in spark.table(name).dtypes:
                kinds.setdefault(column.lower(), set()).add(kind)
    return {c for c, k in kinds.items() if k <= INTEGERS}


def pragma(spark: SparkSession, name: str, table: str | None) -> DataFrame:
    """table_info(t): cid, name, type, notnull, dflt_value, pk. table_list: name, type of the session's tables and views."""
    if name == "table_info" and table:
        rows = [(i, f.name, f.dataType.simpleString(), int(not f.nullable), None, 0) for i, f in enumerate(spark.table(table).schema)]
        return spark.createDataFrame(rows, "cid int, name string, type string, notnull int, dflt_value string, pk int")
    return spark.createDataFrame([(t.name, "view" if t.isTemporary else "table") for t in spark.catalog.listTables()], "name string, type string")


def _parameters(text: str, args: dict | list | None) -> tuple[str, dict | list | None]:
    """?N, @name and $name as :name; a list of values is numbered from 1 where ?N is used."""
    ts = operators.tokens(text)
    numbered = any(re.fullmatch(r"\?\d+", t) for t in ts)
    out = [f":_{t[1:]}" if re.fullmatch(r"\?\d+", t) else ":" + t[1:] if t[0] in "@$" and len(t) > 1 else t for t in ts]
    if numbered and isinstance(args, (list, tuple)):
        args = {f"_{i}": v for i, v in enumerate(args, 1)}
    return "".join(out), args


def translate(spark: SparkSession, statement: str) -> str:
    """One statement of the dialect as Spark SQL."""
    statement = _EXPLAIN.sub("EXPLAIN FORMATTED", statement)
    integers = integer_columns(spark, statement) if "/" in statement else set()
    return rewrite("".join(operators.rewrite(operators.tokens(statement), integers)))


def sql(spark: SparkSession, text: str, args: dict | list | None = None) -> DataFrame:
    """Run the statements of a text; the result of the last one. Parameters: :name, @name, $name with a dict; ?, ?N with a list."""
    result = None
    for s in split(text):
        if m := _PRAGMA.match(s):
            result = pragma(spark, m[1].lower(), m[2])
            continue
        s, values = _parameters(s, args)
        result = spark.sql(translate(spark, s), args=values) if values else spark.sql(translate(spark, s))
    if result is None:
        raise ValueError("no statement")
    return result
