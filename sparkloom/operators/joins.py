"""Joins and picks that Spark SQL has no syntax for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..shared import written


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, columns: list[str]) -> DataFrame:
    """Each left row with the right row of equal ``by`` and the greatest time not after its own.

    Both sides are put together and one window carries the last right row forward, so there is one
    shuffle on ``by`` and no join.  Without a match the right columns are null.  Among right rows of
    equal time the one with the greatest columns is taken.
    """
    pick = F.struct(*[F.col(f"`{c}`") for c in columns])
    keys = [F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(by)]
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    a = left.select(*keys, F.col(f"`{left_time}`").alias("__t"), F.lit(1).alias("__side"), row.alias("__row"), F.lit(None).cast(right.select(pick.alias("p")).schema["p"].dataType).alias("__pick"))
    b = right.where(F.col(f"`{right_time}`").isNotNull()).select(
        *keys, F.col(f"`{right_time}`").alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(row.alias("r")).schema["r"].dataType).alias("__row"), pick.alias("__pick")
    )
    names = [f"__k{i}" for i in range(len(by))]
    w = Window.partitionBy(*names).orderBy("__t", "__side", "__pick").rowsBetween(Window.unboundedPreceding, 0)
    known = F.last("__pick", ignorenulls=True).over(w)
    carried = a.unionByName(b).withColumn("__got", F.when(F.col("__t").isNotNull(), known)).where("__side = 1")
    return carried.select(*[F.col(f"__row.`{c}`").alias(c) for c in left.columns], *[F.col(f"__got.`{c}`").alias(c) for c in columns])


def interval_overlaps(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows whose interval begins before an earlier one has ended, by a running maximum.

    Rows are ranged by their start over partitions (written once, so all uses see the same ranges); a
    task runs over one range, and the largest end of all ranges before it is carried in.  What is
    broadcast is a row for each partition.
    """
    ranged = written(df.where(F.col(start).isNotNull()).repartitionByRange(start).withColumn("__p", F.spark_partition_id()), "overlaps")
    within = F.max(end).over(Window.partitionBy("__p").orderBy(start).rowsBetween(Window.unboundedPreceding, -1))
    edges = ranged.groupBy("__p").agg(F.min(start).alias("__first"), F.max(end).alias("__last"))
    carried = F.max("__last").over(Window.orderBy("__first").rowsBetween(Window.unboundedPreceding, -1))
    seen = ranged.withColumn("__within", within).join(F.broadcast(edges.select("__p", carried.alias("__carried"))), "__p")
    return seen.where(F.greatest("__within", "__carried") > F.col(start)).select(*[f"`{c}`" for c in df.columns])


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")
