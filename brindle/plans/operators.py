"""Operators and calls of the dialect whose meaning differs from Spark's, rewritten over tokens before Catalyst parses them.

Division of integers truncates and division by zero is NULL; LIKE ignores the case of ASCII letters; -> and ->> read JSON by a
literal path; COLLATE names the dialect's collations; group_concat separates by commas; substr counts position 0 as one
character before the text; strftime takes its format first."""

from __future__ import annotations

import re

TOKEN = re.compile(r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|--[^\n]*|/\*.*?\*/|->>|->|\|\||<<|>>|<=|>=|<>|!=|==|\?\d*|[:@$][A-Za-z_]\w*|0[xX][0-9a-fA-F]+|\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|[A-Za-z_]\w*|\s+|.""", re.S)
#: Collations of the dialect in Spark. Fixed values.
COLLATIONS = {"nocase": "UTF8_LCASE", "binary": "UTF8_BINARY", "rtrim": "UTF8_BINARY_RTRIM"}
#: Codes of strftime as date patterns. Fixed values.
DATE_CODES = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "%": "%"}
#: Functions whose value is an integer, and those that keep the type of their arguments.
INTEGER_CALLS = {"length", "instr", "count", "unicode", "char_length", "sign"}
KEEPING_CALLS = {"abs", "sum", "min", "max", "coalesce", "ifnull", "nullif"}
_WORD = re.compile(r"[A-Za-z_]\w*\Z")
#: Words that an operand cannot end with. Fixed values.
_BREAKS = {"select", "where", "and", "or", "not", "on", "when", "then", "else", "by", "having", "from", "case", "in", "is", "like", "between", "limit", "offset", "as", "distinct", "all", "union", "except", "intersect", "values", "set", "using", "join"}


def tokens(sql: str) -> list[str]:
    return TOKEN.findall(sql)


def _blank(t: str) -> bool:
    return t.isspace() or t.startswith(("--", "/*"))


def _operand_end(t: str) -> bool:
    return t == ")" or t == "]" or t[0] in "'\"`?:@$" or t[0].isdigit() or bool(_WORD.match(t)) and t.lower() not in _BREAKS


def _close(ts: list[str], at: int) -> int:
    """The index behind the bracket that closes the one at `at`."""
    depth = 0
    for i in range(at, len(ts)):
        depth += {"(": 1, ")": -1}.get(ts[i], 0)
        if depth == 0:
            return i + 1
    return len(ts)


def _pop_operand(out: list[str]) -> list[str]:
    """Take the primary expression at the end of out: a literal, a name with its qualifiers, a call or a bracket."""
    end = len(out)
    while end and _blank(out[end - 1]):
        end -= 1
    at = end - 1
    if at >= 0 and out[at] == ")":
        depth = 0
        for at in range(end - 1, -1, -1):
            depth += {")": 1, "(": -1}.get(out[at], 0)
            if depth == 0:
                break
        before = next((k for k in range(at - 1, -1, -1) if not _blank(out[k])), -1)
        if before >= 0 and out[before].lower() in ("over", "filter"):  # the call that this belongs to
            tail = out[before:end]
            del out[before:]
            return [*_pop_operand(out), " ", *tail]
        if at and _WORD.match(out[at - 1]) and out[at - 1].lower() not in _BREAKS:
            at -= 1
    while at >= 2 and out[at - 1] == "." and _operand_end(out[at - 2]):
        at -= 2
    taken = out[at:end]
    del out[at:]
    return taken


def _next_operand(ts: list[str], at: int) -> tuple[list[str], int]:
    """The primary expression that begins at `at` (a sign belongs to it), and the index behind it."""
    begin = at
    while at < len(ts) and (_blank(ts[at]) or ts[at] in "+-~"):
        at += 1
    if at < len(ts) and ts[at] == "(":
        return ts[begin : (end := _close(ts, at))], end
    at += 1
    while at + 1 < len(ts) and ts[at] == ".":
        at += 2
    if at < len(ts) and ts[at] == "(" and _WORD.match(ts[at - 1]):
        at = _close(ts, at)
        while (k := next((k for k in range(at, len(ts)) if not _blank(ts[k])), len(ts))) < len(ts) and ts[k].lower() in ("over", "filter"):
            k = next((k for k in range(k + 1, len(ts)) if not _blank(ts[k])), len(ts))
            at = _close(ts, k) if k < len(ts) and ts[k] == "(" else k + 1
    return ts[begin:at], at


def _integral(ts: list[str], integers: set[str]) -> bool:
    """Whether an operand is an integer: every literal and column in it is, and its calls keep that."""
    at = 0
    while at < len(ts):
        t, at = ts[at], at + 1
        low = t.strip("`\"").lower()
        after = next((x for x in ts[at:] if not _blank(x)), "")
        if _blank(t) or t in "()+-*%~,." or t.isdigit() or low in ("div", "distinct") or after == ".":
            continue
        if after == "(" and low in (*INTEGER_CALLS, "over", "filter"):
            at = _close(ts, ts.index("(", at))
        elif not (after == "(" and low in KEEPING_CALLS or after != "(" and low in integers):
            return False
    return any(not _blank(t) for t in ts)


def _arguments(ts: list[str]) -> list[list[str]]:
    out, depth = [[]], 0
    for t in ts:
        depth += {"(": 1, ")": -1}.get(t, 0)
        if t == "," and depth == 0:
            out.append([])
        else:
            out[-1].append(t)
    return out


def _path(t: str) -> str | None:
    """A JSON path for the right side of -> and ->>: a path, a key or an index."""
    if t.isdigit():
        return f"'$[{t}]'"
    if t.startswith("'"):
        return t if t.startswith("'$") else "'$." + t[1:]
    return None


def _call(name: str, inner: list[str], integers: set[str]) -> list[str] | None:
    args = ["".join(a).strip() for a in _arguments(inner)]
    if name == "iif" and len(args) == 3:
        return [f"if({args[0]}, {args[1]}, {args[2]})"]
    if name == "group_concat" and len(args) in (1, 2):
        kind, what = ("DISTINCT ", args[0][9:]) if args[0].lower().startswith("distinct ") else ("", args[0])
        return [f"listagg({kind}cast({what} as string), {args[1] if len(args) == 2 else "','"})"]
    if name in ("substr", "substring") and len(args) == 3 and args[1] == "0":
        return [f"substr({args[0]}, 1, greatest({args[2]} - 1, 0))"]
    if name in ("substr", "substring") and len(args) == 2 and args[1] == "0":
        return [f"substr({args[0]}, 1)"]
    if name == "json_extract" and len(args) == 2 and args[1].startswith("'"):
        return [f"get_json_object({args[0]}, {args[1]})"]
    if name == "strftime" and len(args) == 2 and args[0].startswith("'"):
        codes = re.findall(r"%(.)|([^%]+)", args[0][1:-1])
        if all(not c or c in DATE_CODES for c, _ in codes):
            pattern = "".join(DATE_CODES[c] if c else re.sub(r"[A-Za-z]+", lambda m: f"''{m[0]}''", rest) for c, rest in codes)
            return [f"date_format(cast({args[1]} as timestamp), '{pattern}')"]
    if name == "unicode" and len(args) == 1:
        return [f"ascii({args[0]})"]
    return None


def rewrite(ts: list[str], integers: set[str]) -> list[str]:
    """integers: names of columns that hold integers."""
    out: list[str] = []
    i = 0
    while i < len(ts):
        t, low = ts[i], ts[i].lower()
        after = next((k for k in range(i + 1, len(ts)) if not _blank(ts[k])), len(ts))
        if t == "(":
            end = _close(ts, i)
            inner = rewrite(ts[i + 1 : end - 1], integers)
            name = out[-1].lower() if out and _WORD.match(out[-1]) else ""
            call = _call(name, inner, integers) if name else None
            if call:
                out.pop()
                out += call
            else:
                out += ["(", *inner, ")"]
            i = end
        elif t == "/" and out and any(_operand_end(x) for x in out[-1:] if not _blank(x)) | (bool(out) and _blank(out[-1])):
            # products and quotients before it belong to the left side, since all of them group from the left
            left = _pop_operand(out)
            while (k := max((j for j in range(len(out)) if not _blank(out[j])), default=-1)) > 0 and out[k] in "*%":
                op = out[k]
                del out[k:]
                left = [*_pop_operand(out), " ", op, " ", *left]
            right, i = _next_operand(ts, i + 1)
            right = rewrite(right, integers)
            whole = _integral(left, integers) and _integral(right, integers)
            a, b = "".join(left).strip(), "".join(right).strip()
            out += ["(", *tokens(f"({a}) div nullif({b}, 0)" if whole else f"try_divide({a}, {b})"), ")"]
        elif t in ("->", "->>") and after < len(ts) and _path(ts[after]):
            what, path = "".join(_pop_operand(out)), _path(ts[after])
            out += tokens(f"get_json_object({what}, {path})" if t == "->>" else f"to_json(try_variant_get(try_parse_json({what}), {path}, 'variant'))")
            i = after + 1
        elif low == "like":
            out.append("ILIKE")
            i += 1
        elif low == "collate" and after < len(ts) and ts[after].lower() in COLLATIONS:
            out += ["COLLATE ", COLLATIONS[ts[after].lower()]]
            i = after + 1
        else:
            out.append(t)
            i += 1
    return out
