"""Scalar helpers and relation macros of model SQL."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, functions as F

from .. import types


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b == 0, F.lit(None)).otherwise(a / b)


def cents_to_dollars(cents: Column) -> Column:
    return cents / F.lit(100.0)


def schema_string(df: DataFrame) -> str:
    return "|".join(f"{f.name}:{types.canonical(f.dataType)}" for f in df.schema.fields)


def schema_hash(df: DataFrame) -> str:
    """md5 of the sorted columns; the same for any order of them."""
    return hashlib.md5("|".join(sorted(schema_string(df).split("|"))).encode()).hexdigest()


def normalized_sql(sql: str) -> str:
    """Without comments, white space as single spaces, lower case outside quotes."""
    out = []
    for quoted, comment, space, other in re.findall(r"('(?:[^']|'')*'|\"[^\"]*\")|(--[^\n]*|/\*.*?\*/)|(\s+)|(.)", sql, re.S):
        out.append(quoted or (" " if comment or space else other.lower()))
    return re.sub(r" +", " ", "".join(out)).strip()


def sql_hash(sql: str) -> str:
    return hashlib.md5(normalized_sql(sql).encode()).hexdigest()


def column_names(df: DataFrame) -> list[str]:
    return df.columns


def column_exists(df: DataFrame, name: str) -> bool:
    return name in df.columns


def column_type(df: DataFrame, name: str) -> str | None:
    return types.canonical(df.schema[name].dataType) if name in df.columns else None


def has_rows(df: DataFrame) -> bool:
    return not df.isEmpty()


def column_profile(df: DataFrame, name: str) -> DataFrame:
    """One row: rows, nulls, distinct, least and greatest of a column, in one pass."""
    c = F.col(f"`{name}`")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(c.isNull()).alias("nulls"), F.countDistinct(c).alias("distinct_values"), F.min(c).alias("least"), F.max(c).alias("greatest"))


def batch_type_check(pairs: list[tuple[str, str]]) -> bool:
    return all(types.promotable(a, b) for a, b in pairs)
