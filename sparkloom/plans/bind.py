"""Binding a query's relations to DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .refs import relations


def bind(spark: SparkSession, sql: str, source: Callable[[str], DataFrame | None]) -> DataFrame:
    """Run a query with its relations replaced: ``source`` gives a DataFrame for a name, or None to leave it.

    Names in comments, quotes and CTE scopes are not touched.  A relation without an alias gets its
    table's name as one, so qualified columns still resolve.
    """
    parts, frames, end = [], {}, 0
    for i, r in enumerate(relations(spark, sql)):
        df = source(r.name)
        if df is None:
            continue
        parts.append(sql[end : r.start].replace("{", "{{").replace("}", "}}"))
        parts.append(f"{{r{i}}}" if r.aliased else f"{{r{i}}} AS `{r.name.split('.')[-1]}`")
        frames[f"r{i}"] = df
        end = r.stop + 1
    tail = sql[end:]
    if not frames:
        return spark.sql(sql)
    return spark.sql("".join(parts) + tail.replace("{", "{{").replace("}", "}}"), **frames)
