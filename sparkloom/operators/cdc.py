"""Change data capture between versions of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Kinds of changes.
INSERT, DELETE, BEFORE, AFTER = "insert", "delete", "update_preimage", "update_postimage"


def delta(current: DataFrame, old: DataFrame) -> DataFrame:
    """Rows of ``current`` that ``old`` has not, as a set: repeats collapse, deletions give nothing."""
    names = [c for c in current.columns if c in old.columns]
    if len(names) < len(current.columns):
        return current.distinct()
    return current.subtract(old.select(*[f"`{c}`" for c in current.columns]))


def empty(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False))


def row_changes(old: DataFrame, new: DataFrame, rowid: str) -> DataFrame:
    """Changes from old to new by row id: change_type and the row's columns.

    One join on the id; an update gives its row before and after.
    """
    values = [c for c in new.columns if c != rowid]
    for c in set(values) - set(old.columns):
        old = old.withColumn(c, F.lit(None).cast(new.schema[c].dataType))
    pack = lambda df: df.select(F.col(rowid), F.struct(*[F.col(f"`{c}`") for c in values]).alias("row"))
    both = pack(old).withColumnRenamed("row", "__a").join(pack(new).withColumnRenamed("row", "__b"), rowid, "full")
    kind = lambda name, row: F.struct(F.lit(name).alias("change_type"), F.col(row).alias("row"))
    found = (
        F.when(F.col("__a").isNull(), F.array(kind(INSERT, "__b")))
        .when(F.col("__b").isNull(), F.array(kind(DELETE, "__a")))
        .otherwise(F.array(kind(BEFORE, "__a"), kind(AFTER, "__b")))
    )
    changed = both.where(~F.col("__a").eqNullSafe(F.col("__b")))
    return changed.select(rowid, F.inline(found)).select(rowid, "change_type", *[F.col(f"row.`{c}`").alias(c) for c in values])


def insert_only(changes: DataFrame) -> DataFrame:
    """snapshot_id, insert_only: whether a snapshot has neither deletions nor new values of old rows."""
    return changes.groupBy("snapshot_id").agg(F.every(~F.col("change_type").isin(DELETE, AFTER)).alias("insert_only"))


def cursor_state(target: DataFrame | None, cursor: str, initial: str = "1970-01-01T00:00:00Z") -> str:
    """The largest cursor value as text, or the initial one without rows."""
    if target is None:
        return initial
    found = target.agg(F.max(F.col(f"`{cursor}`")).cast("string")).first()[0]
    return initial if found is None else found


def after_cursor(df: DataFrame, cursor: str, last: str | Column) -> DataFrame:
    return df.where(F.col(f"`{cursor}`") > (F.lit(last) if isinstance(last, str) else last).cast(df.schema[cursor].dataType))
