"""Session variables of model SQL: getvariable('name') becomes a literal."""

from __future__ import annotations

import re
from datetime import UTC, date, datetime
from decimal import Decimal

from .functions.dialect import tokens


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float, Decimal)):
        return str(value)
    if isinstance(value, datetime):
        return f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S.%f}'"
    if isinstance(value, date):
        return f"DATE '{value}'"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def substitute(sql: str, variables: dict[str, object]) -> str:
    """Unknown variables are NULL.  Quotes and comments are left alone."""
    ts, out, i = tokens(sql), [], 0
    while i < len(ts):
        if ts[i].lower() == "getvariable" and i + 3 < len(ts) and ts[i + 1] == "(" and ts[i + 2].startswith("'") and ts[i + 3] == ")":
            out.append(literal(variables.get(ts[i + 2][1:-1])))
            i += 4
        else:
            out.append(ts[i])
            i += 1
    return "".join(out)


def parse_settings(text: str) -> dict[str, object]:
    """SET VARIABLE name = value; of a variables file."""
    out: dict[str, object] = {}
    for m in re.finditer(r"SET\s+VARIABLE\s+(\w+)\s*=\s*('(?:[^']|'')*'|[^;]+);?", re.sub(r"--[^\n]*", "", text), re.I):
        v = m[2].strip()
        if v.startswith("'"):
            out[m[1]] = v[1:-1].replace("''", "'")
        elif re.fullmatch(r"[+-]?\d+", v):
            out[m[1]] = int(v)
        elif re.fullmatch(r"[+-]?\d*\.\d+", v):
            out[m[1]] = float(v)
        elif v.lower() in ("true", "false"):
            out[m[1]] = v.lower() == "true"
        else:
            out[m[1]] = v
    return out


def run_variables(load_id: str) -> dict[str, object]:
    return {"run_time": datetime.now(UTC).replace(tzinfo=None), "load_id": load_id}
