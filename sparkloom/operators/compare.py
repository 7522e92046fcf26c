"""Comparing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .kinds import SCD2_COLUMNS


def table_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only, with ``_source`` (left or right)."""
    right = right.select(*[f"`{c}`" for c in left.columns])
    only = left.subtract(right).withColumn("_source", F.lit("left"))
    return only.unionByName(right.subtract(left).withColumn("_source", F.lit("right")))


def compare_tables(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: only_left, only_right, matching (distinct rows), in one grouping of both sides."""
    cols = left.columns
    sides = left.withColumn("__l", F.lit(1)).withColumn("__r", F.lit(0)).unionByName(
        right.select(*[f"`{c}`" for c in cols]).withColumn("__l", F.lit(0)).withColumn("__r", F.lit(1))
    )
    rows = sides.groupBy(*[f"`{c}`" for c in cols]).agg(F.max("__l").alias("l"), F.max("__r").alias("r"))
    return rows.agg(
        F.count_if(F.col("r") == 0).alias("only_left"),
        F.count_if(F.col("l") == 0).alias("only_right"),
        F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("matching"),
    )


def duplicate_count(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: rows beyond the first of each group of equal columns."""
    groups = df.groupBy(*[f"`{c}`" for c in cols]).count()
    return groups.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("duplicates"))


def sandbox_diff(prod: DataFrame, sandbox: DataFrame, limit: int = 5) -> dict[str, DataFrame]:
    """added, removed and counts between two versions; validity columns do not count."""
    drop = [c for c in SCD2_COLUMNS if c in prod.columns and c in sandbox.columns]
    a, b = prod.drop(*drop), sandbox.drop(*drop)
    common = [c for c in a.columns if c in b.columns]
    a, b = (x.select(*[f"`{c}`" for c in common]) for x in (a, b))
    added, removed = b.subtract(a), a.subtract(b)
    counts = compare_tables(a, b).select(F.col("only_right").alias("added"), F.col("only_left").alias("removed"), "matching")
    return {"added": added, "removed": removed, "counts": counts, "added_sample": added.limit(limit), "removed_sample": removed.limit(limit)}
