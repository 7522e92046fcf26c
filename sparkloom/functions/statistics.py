"""Statistics without a built-in of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def entropy_frame(df: DataFrame, col: str) -> DataFrame:
    """One row, one column ``entropy``: Shannon entropy in bits over non-null values; 0 without any.

    With counts n of N rows it is log2(N) - sum(n log2 n) / N, so values are grouped once.
    """
    counts = df.where(F.col(f"`{col}`").isNotNull()).groupBy(F.col(f"`{col}`").alias("v")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = counts.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return total.select(F.coalesce(F.log2("t") - F.col("s") / F.col("t"), F.lit(0.0)).alias("entropy"))
