"""Materialization: what a model's new result does to its table.

Every kind is a pure function of the current table (None on the first run) and the source, and says
which rows it leaves, which it adds, and how many it affected.  Nothing is collected; joins are on the
keys only, so the source may be a small delta against a large table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Columns that kinds add.
SCD2_COLUMNS = ("valid_from_snapshot", "valid_to_snapshot", "is_current")
HASH_COLUMN = "_content_hash"


class KeyError_(ValueError):
    """A key that is missing, null or not unique."""


@dataclass
class Result:
    """table: the whole new content; affected: a frame of one long column ``rows``."""

    table: DataFrame
    affected: DataFrame


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def key_name(df: DataFrame, key: str) -> str:
    found = next((c for c in df.columns if c.lower() == key.lower()), None)
    if found is None:
        raise KeyError_(f"key column {key} is not in the result")
    return found


def check_keys(source: DataFrame, keys: list[str], unique: bool) -> None:
    """Raise where a key column is missing or null, or (``unique``) a key comes twice."""
    names = [key_name(source, k) for k in keys]
    nulls = source.agg(*[F.count_if(F.col(f"`{k}`").isNull()).alias(f"n{i}") for i, k in enumerate(names)]).first()
    if bad := [k for i, k in enumerate(names) if nulls[i]]:
        raise KeyError_(f"key column {bad[0]} has nulls")
    if unique and not source.groupBy(*names).count().where("count > 1").isEmpty():
        raise KeyError_(f"key {', '.join(names)} comes more than once in the source")


def full_table(source: DataFrame) -> Result:
    """Kind ``table``: the source replaces everything."""
    return Result(source, _count(source))


def append(target: DataFrame | None, source: DataFrame) -> Result:
    """Kind ``append``: the source is added, by name; missing columns are null."""
    return Result(source if target is None else target.unionByName(source, allowMissingColumns=True), _count(source))


def _same(left: str, right: str, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`"))
    return out


def merge(target: DataFrame | None, source: DataFrame, key: str) -> Result:
    """Kind ``merge``: rows of equal key (null equals null) are replaced, others added, none deleted."""
    key = key_name(source, key)
    if target is None:
        return Result(source, _count(source))
    stay = target.alias("t").join(source.select(f"`{key}`").alias("s"), _same("t", "s", [key]), "left_anti")
    return Result(stay.unionByName(source, allowMissingColumns=True), _count(source))


def scd2_first(source: DataFrame, snapshot: int) -> DataFrame:
    start, end, current = SCD2_COLUMNS
    return source.withColumns({start: F.lit(snapshot).cast("long"), end: F.lit(None).cast("long"), current: F.lit(True)})


def scd2_changes(current: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """key, __old and __new (structs of the source's other columns, or null) of keys that are new, changed or gone.

    ``current`` are the open rows; a column that they lack counts as null.
    """
    key = key_name(source, key)
    values = [c for c in source.columns if c != key]
    for c in set(values) - set(current.columns):
        current = current.withColumn(c, F.lit(None).cast(source.schema[c].dataType))
    pack = lambda df, name: df.select(F.col(f"`{key}`"), F.struct(F.lit(1), *[F.col(f"`{c}`") for c in values]).alias(name))
    return pack(current, "__old").join(pack(source, "__new"), key, "full").where(~F.col("__old").eqNullSafe(F.col("__new")))


def scd2_closed(rows: DataFrame, changes: DataFrame, key: str, snapshot: int) -> DataFrame:
    """History rows, those closed whose key is among the changes."""
    _, end, current = SCD2_COLUMNS
    touched = changes.where("__old is not null").select(F.col(f"`{key}`")).withColumn("__closed", F.lit(True))
    close = F.col(current) & F.coalesce(F.col("__closed"), F.lit(False))
    marked = rows.join(touched, key, "left").withColumns({end: F.when(close, F.lit(snapshot - 1).cast("long")).otherwise(F.col(end)), current: F.col(current) & ~close})
    return marked.select(*[F.col(f"`{c}`") for c in rows.columns])


def scd2_opened(changes: DataFrame, key: str, columns: list[str], snapshot: int) -> DataFrame:
    new = changes.where("__new is not null")
    return scd2_first(new.select(*[F.col(f"`{c}`") if c == key else F.col(f"__new.`{c}`").alias(c) for c in columns]), snapshot)


def scd2(target: DataFrame | None, source: DataFrame, key: str, snapshot: int) -> Result:
    """Kind ``scd2``: history by validity.  Keys that changed or went are closed at ``snapshot`` - 1,
    new and changed ones opened at ``snapshot``."""
    key = key_name(source, key)
    if target is None:
        return Result(scd2_first(source, snapshot), _count(source))
    changes = scd2_changes(target.where(F.col(SCD2_COLUMNS[2])), source, key)
    opened = scd2_opened(changes, key, source.columns, snapshot)
    return Result(scd2_closed(target, changes, key, snapshot).unionByName(opened, allowMissingColumns=True), _count(opened))


def content_hash(columns: list[str]) -> Column:
    """A group's hash: the sum of its rows' hashes, so it does not depend on order but counts repeats.

    Null flags go between the values, as the hash function skips nulls.
    """
    parts: list[Column] = []
    for c in sorted(columns):
        parts += [F.col(f"`{c}`").isNull(), F.col(f"`{c}`")]
    return F.sum(F.xxhash64(*(parts or [F.lit(0)])).cast("decimal(20,0)")).cast("string")


def group_hashes(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*[f"`{k}`" for k in keys]).agg(content_hash(columns).alias(HASH_COLUMN))


def hashed(source: DataFrame, keys: list[str]) -> DataFrame:
    """The source with each row's group hash."""
    keys = [key_name(source, k) for k in keys]
    values = [c for c in source.columns if c not in keys and c != HASH_COLUMN]
    groups = group_hashes(source, keys, values)
    return source.drop(HASH_COLUMN).join(groups, keys)


def tracked_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys and __kept (false where the group is gone) of groups whose hash is new, changed or gone.

    Both sides need the keys and the group hash; each group counts once.
    """
    ids = lambda df, name: df.select(*[F.col(f"`{k}`") for k in keys], F.col(HASH_COLUMN).alias(name)).distinct()
    both = ids(old, "__a").join(ids(new, "__b"), keys, "full")
    return both.where(~F.col("__a").eqNullSafe(F.col("__b"))).select(*[F.col(f"`{k}`") for k in keys], F.col("__b").isNotNull().alias("__kept"))


def tracked(target: DataFrame | None, source: DataFrame, keys: list[str]) -> Result:
    """Kind ``tracked``: groups whose content changed are replaced whole, missing ones deleted."""
    keys = [key_name(source, k) for k in keys]
    new = hashed(source, keys)
    if target is None:
        return Result(new, _count(new))
    changes = tracked_changes(target, new, keys)
    upserts = new.join(changes, keys, "left_semi").select(*[f"`{c}`" for c in new.columns])
    stay = target.join(changes, keys, "left_anti").select(*[f"`{c}`" for c in target.columns])
    return Result(stay.unionByName(upserts, allowMissingColumns=True), _count(upserts))
