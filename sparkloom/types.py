"""Type names of model SQL and their Spark types.

Names, aliases and the widening lattice are fixed values of the model dialect.
"""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Canonical names by alias.
ALIASES: dict[str, str] = {
    "TINYINT": "TINYINT", "INT1": "TINYINT",
    "SMALLINT": "SMALLINT", "INT2": "SMALLINT", "INT16": "SMALLINT", "SHORT": "SMALLINT",
    "INTEGER": "INTEGER", "INT": "INTEGER", "INT4": "INTEGER", "INT32": "INTEGER", "SIGNED": "INTEGER",
    "BIGINT": "BIGINT", "INT8": "BIGINT", "INT64": "BIGINT", "LONG": "BIGINT",
    "HUGEINT": "HUGEINT", "INT128": "HUGEINT", "UHUGEINT": "UHUGEINT",
    "UTINYINT": "UTINYINT", "USMALLINT": "USMALLINT", "UINTEGER": "UINTEGER", "UBIGINT": "UBIGINT",
    "FLOAT": "FLOAT", "FLOAT4": "FLOAT", "REAL": "FLOAT",
    "DOUBLE": "DOUBLE", "FLOAT8": "DOUBLE", "DOUBLE PRECISION": "DOUBLE",
    "DECIMAL": "DECIMAL", "NUMERIC": "DECIMAL", "DEC": "DECIMAL",
    "BOOLEAN": "BOOLEAN", "BOOL": "BOOLEAN", "LOGICAL": "BOOLEAN",
    "DATE": "DATE", "TIME": "TIME", "TIMETZ": "TIMETZ", "TIME_NS": "TIME",
    "TIMESTAMP": "TIMESTAMP", "DATETIME": "TIMESTAMP", "TIMESTAMP_US": "TIMESTAMP", "TIMESTAMP_MS": "TIMESTAMP",
    "TIMESTAMP_S": "TIMESTAMP", "TIMESTAMP_NS": "TIMESTAMP", "TIMESTAMP_NTZ": "TIMESTAMP",
    "TIMESTAMPTZ": "TIMESTAMPTZ", "TIMESTAMP WITH TIME ZONE": "TIMESTAMPTZ",
    "INTERVAL": "INTERVAL",
    "VARCHAR": "VARCHAR", "TEXT": "VARCHAR", "STRING": "VARCHAR", "CHAR": "VARCHAR", "BPCHAR": "VARCHAR", "NVARCHAR": "VARCHAR", "ENUM": "VARCHAR",
    "JSON": "JSON", "UUID": "UUID", "BIT": "BIT", "BITSTRING": "BIT",
    "BLOB": "BLOB", "BYTEA": "BLOB", "BINARY": "BLOB", "VARBINARY": "BLOB",
    "VARIANT": "VARIANT", "UNION": "VARIANT",
}
# What a type may be widened to.
PROMOTIONS: dict[str, tuple[str, ...]] = {
    "TINYINT": ("SMALLINT", "INTEGER", "BIGINT", "HUGEINT", "FLOAT", "DOUBLE"),
    "SMALLINT": ("INTEGER", "BIGINT", "HUGEINT", "FLOAT", "DOUBLE"),
    "INTEGER": ("BIGINT", "HUGEINT", "FLOAT", "DOUBLE"),
    "BIGINT": ("HUGEINT", "DOUBLE"),
    "FLOAT": ("DOUBLE",),
}
_SPARK: dict[str, T.DataType] = {
    "TINYINT": T.ByteType(), "SMALLINT": T.ShortType(), "INTEGER": T.IntegerType(), "BIGINT": T.LongType(),
    "HUGEINT": T.DecimalType(38, 0), "UHUGEINT": T.DecimalType(38, 0),
    "UTINYINT": T.ShortType(), "USMALLINT": T.IntegerType(), "UINTEGER": T.LongType(), "UBIGINT": T.DecimalType(20, 0),
    "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType(), "DATE": T.DateType(),
    "TIME": T.StringType(), "TIMETZ": T.StringType(), "TIMESTAMP": T.TimestampNTZType(), "TIMESTAMPTZ": T.TimestampType(),
    "INTERVAL": T.DayTimeIntervalType(), "VARCHAR": T.StringType(), "JSON": T.StringType(), "UUID": T.StringType(), "BIT": T.StringType(),
    "BLOB": T.BinaryType(), "VARIANT": T.VariantType(),
}
#: Patterns for text types without a Spark type of their own.
TEXT_FORMS = {
    "UUID": r"(?i)\{?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?",
    "TIME": r"([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,9})?)?",
}


def _split(text: str) -> list[str]:
    """Parts between commas at depth 0."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "(<[") - (c in ")>]")
        if c == "," and depth == 0:
            parts.append(text[start:i].strip())
            start = i + 1
    return [*parts, text[start:].strip()]


def parse(name: str) -> T.DataType:
    """The Spark type of a type name; an unknown name is text."""
    text = name.strip()
    upper = text.upper()
    if text.endswith("]"):
        return T.ArrayType(parse(text[: text.rindex("[")]))
    m = re.fullmatch(r"(\w+)\s*\((.*)\)", text, re.S)
    if m:
        head, inner = m[1].upper(), m[2]
        if ALIASES.get(head) == "DECIMAL":
            p, *s = [int(x) for x in _split(inner)]
            return T.DecimalType(p, s[0] if s else 0)
        if head in ("STRUCT", "ROW"):
            fields = [re.fullmatch(r'"?(\w+)"?\s+(.*)', f, re.S) for f in _split(inner)]
            return T.StructType([T.StructField(f[1], parse(f[2])) for f in fields if f])
        if head == "MAP":
            return T.MapType(*[parse(x) for x in _split(inner)])
        if head in ("LIST", "ARRAY"):
            return T.ArrayType(parse(inner))
        return _SPARK.get(ALIASES.get(head, "VARCHAR"), T.StringType())
    if ALIASES.get(upper) == "DECIMAL":
        return T.DecimalType(18, 3)
    return _SPARK.get(ALIASES.get(upper, "VARCHAR"), T.StringType())


def canonical(kind: T.DataType) -> str:
    """The type name of a Spark type."""
    if isinstance(kind, T.DecimalType):
        return "HUGEINT" if (kind.precision, kind.scale) == (38, 0) else f"DECIMAL({kind.precision},{kind.scale})"
    if isinstance(kind, T.ArrayType):
        return f"{canonical(kind.elementType)}[]"
    if isinstance(kind, T.MapType):
        return f"MAP({canonical(kind.keyType)}, {canonical(kind.valueType)})"
    if isinstance(kind, T.StructType):
        return f"STRUCT({', '.join(f'{f.name} {canonical(f.dataType)}' for f in kind.fields)})"
    if isinstance(kind, T.DayTimeIntervalType | T.YearMonthIntervalType):
        return "INTERVAL"
    order = ("TINYINT", "SMALLINT", "INTEGER", "BIGINT", "FLOAT", "DOUBLE", "BOOLEAN", "DATE", "TIMESTAMP", "TIMESTAMPTZ", "VARCHAR", "BLOB", "VARIANT")
    return next((n for n in order if _SPARK[n] == kind), kind.simpleString().upper())


def normalize(name: str) -> str:
    """Canonical name for comparing schemas; here NUMERIC is DOUBLE, and other names stay as they are."""
    upper = name.strip().upper()
    if upper in ("NUMERIC", "DEC"):
        return "DOUBLE"
    return ALIASES.get(upper, upper)


def promotable(old: str, new: str) -> bool:
    a, b = normalize(old), normalize(new)
    return a == b or b in PROMOTIONS.get(a, ())


def json_schema(kind: T.DataType) -> dict:
    """JSON Schema of a type."""
    if isinstance(kind, T.BooleanType):
        return {"type": "boolean"}
    if isinstance(kind, T.IntegralType):
        return {"type": "integer"}
    if isinstance(kind, T.NumericType):
        return {"type": "number"}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType)}
    if isinstance(kind, T.MapType):
        return {"type": "object", "additionalProperties": json_schema(kind.valueType)}
    if isinstance(kind, T.StructType):
        return {"type": "object", "properties": {f.name: json_schema(f.dataType) for f in kind.fields}}
    form = {T.DateType: "date", T.TimestampType: "date-time", T.TimestampNTZType: "date-time"}.get(type(kind))
    return {"type": "string"} | ({"format": form} if form else {})
