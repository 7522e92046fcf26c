"""Shims from the wider model dialect to Spark SQL.

Only what Spark's parser lacks is rewritten: QUALIFY, star with EXCLUDE or REPLACE, ``->>``, ``//`` and
type names.  Text in quotes and comments is never touched.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import SparkSession

from .. import types

_TOKEN = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|->>|//|::|\w+|\s+|.", re.S)


def tokens(sql: str) -> list[str]:
    return _TOKEN.findall(sql)


def _word(t: str, word: str) -> bool:
    return t.upper() == word


def _close(ts: list[str], i: int) -> int:
    """Index of the parenthesis that closes the one at i."""
    depth = 0
    for j in range(i, len(ts)):
        depth += (ts[j] == "(") - (ts[j] == ")")
        if depth == 0:
            return j
    raise ValueError("a parenthesis is not closed")


def _next(ts: list[str], i: int) -> int:
    while i < len(ts) and (ts[i].isspace() or ts[i].startswith(("--", "/*"))):
        i += 1
    return i


def _types(ts: list[str]) -> list[str]:
    """Type names behind :: as Spark has them."""
    out, i = [], 0
    while i < len(ts):
        out.append(ts[i])
        if ts[i] == "::":
            j = _next(ts, i + 1)
            if j < len(ts) and re.fullmatch(r"\w+", ts[j]) and not (j + 1 < len(ts) and ts[j + 1] in "(["):
                kind = types.parse(ts[j]).simpleString()
                out.append(kind if ts[j].upper() in types.ALIASES else ts[j])
                i = j
        i += 1
    return out


def _operators(ts: list[str]) -> list[str]:
    """a // b as a div b; a ->> 'path' as get_json_object(a, 'path')."""
    out: list[str] = []
    i = 0
    while i < len(ts):
        if ts[i] == "//":
            out.append(" div ")
        elif ts[i] == "->>":
            left: list[str] = []
            while out and out[-1].isspace():
                out.pop()
            while out and (re.fullmatch(r"[\w.`\"]+|`[^`]*`|\"[^\"]*\"", out[-1])):
                left.insert(0, out.pop())
            j = _next(ts, i + 1)
            path = ts[j].strip("'")
            path = path if path.startswith("$") else f"$.{path}"
            out.append(f"get_json_object({''.join(left)}, '{path}')")
            i = j
        else:
            out.append(ts[i])
        i += 1
    return out


def _stars(ts: list[str], columns: Callable[[str], list[str]] | None) -> list[str]:
    out, i = [], 0
    while i < len(ts):
        j = _next(ts, i + 1)
        if ts[i] == "*" and j < len(ts) and ts[j].upper() in ("EXCLUDE", "REPLACE"):
            open_ = _next(ts, j + 1)
            end = _close(ts, open_) if ts[open_] == "(" else open_
            inner = ts[open_ + 1 : end] if end > open_ else [ts[open_]]
            if _word(ts[j], "EXCLUDE"):
                out.append(f"* EXCEPT ({''.join(inner)})")
            else:
                parts, depth, now = [], 0, ""
                for t in inner:
                    depth += (t == "(") - (t == ")")
                    if t == "," and depth == 0:
                        parts.append(now)
                        now = ""
                    else:
                        now += t
                swap = {m[2].strip('"`').lower(): m[1] for m in (re.fullmatch(r"\s*(.*?)\s+AS\s+(\S+)\s*", p, re.S | re.I) for p in [*parts, now]) if m}
                k = next(k for k in range(end + 1, len(ts)) if _word(ts[k], "FROM"))
                name = ts[_next(ts, k + 1)]
                if columns is None or name == "(":
                    raise ValueError("* REPLACE needs a named table")
                out.append(", ".join(f"{swap[c.lower()]} AS `{c}`" if c.lower() in swap else f"`{c}`" for c in columns(name)))
            i = end + 1
            continue
        out.append(ts[i])
        i += 1
    return out


def _qualify(ts: list[str]) -> list[str]:
    """SELECT list FROM .. QUALIFY p  ->  the list over a subquery that has p as a column."""
    for i, t in enumerate(ts):
        if _word(t, "QUALIFY"):
            depth, start = 0, 0
            for j in range(i - 1, -1, -1):
                depth += (ts[j] == ")") - (ts[j] == "(")
                if depth < 0:
                    break
                if depth == 0 and _word(ts[j], "SELECT"):
                    start = j
                    break
            depth, end = 0, len(ts)
            for j in range(i + 1, len(ts)):
                depth += (ts[j] == "(") - (ts[j] == ")")
                if depth < 0 or depth == 0 and ts[j].upper() in ("ORDER", "LIMIT", "UNION", "EXCEPT", "INTERSECT"):
                    end = j
                    break
            depth = 0
            for at in range(start, i):
                depth += (ts[at] == "(") - (ts[at] == ")")
                if depth == 0 and _word(ts[at], "FROM"):
                    break
            condition = "".join(ts[i + 1 : end])
            inner = "".join(ts[start:at]).rstrip() + f", ({condition}) AS __qualify " + "".join(ts[at:i])
            return _qualify([*ts[:start], f"SELECT * EXCEPT (__qualify) FROM ({inner}) WHERE __qualify ", *ts[end:]])
    return ts


def to_spark(spark: SparkSession, sql: str, columns: Callable[[str], list[str]] | None = None) -> str:
    """Spark SQL for model SQL; ``columns`` names a table's columns, for * REPLACE."""
    ts = _operators(_types(tokens(sql)))
    return "".join(_qualify(_stars(ts, columns)))
