"""Tables of the lake: reading at a version, changes, staged writes.

Every row has a hidden ``__rowid``.  It is made once, when the row is first written, from the commit, the
task and the row's place in the task, so no counter is shared and no sort is needed; rows that are
only carried over keep theirs.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators import cdc
from ..operators.evolve import adapt
from .commit_log import Commit, CommitLog, FileSystem

ROWID = "__rowid"
#: A row id's fields: commit << 42 | task << 24 | row.
_TASK, _ROW = 18, 24


def new_rowids(snapshot: int) -> Column:
    m = F.monotonically_increasing_id()
    task, row = F.shiftright(m, 33), m.bitwiseAND(F.lit((1 << 33) - 1))
    bad = (task >= 1 << _TASK) | (row >= 1 << _ROW)
    made = F.lit(snapshot << (_TASK + _ROW)).cast("long").bitwiseOR(F.shiftleft(task, _ROW)).bitwiseOR(row)
    return F.when(bad, F.raise_error(F.lit("more rows in a task than a row id can count; use more partitions")).cast("long")).otherwise(made)


class Lake:
    """A catalog of versioned tables under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(spark, self.root)
        self.files = FileSystem(spark, self.root)

    # -- reading

    def exists(self, name: str, version: int | None = None) -> bool:
        return self.log.state(name, version) is not None

    def schema(self, name: str, version: int | None = None) -> StructType:
        entry = self._entry(name, version)
        return StructType.fromJson(entry["schema"])

    def _entry(self, name: str, version: int | None) -> dict:
        entry = self.log.state(name, version)
        if entry is None:
            raise KeyError(f"no table {name}" + (f" at version {version}" if version is not None else ""))
        return entry

    def _scan(self, files: list[str], schema: StructType, rowid: bool, external: bool = False) -> DataFrame:
        full = StructType([*schema.fields, StructField(ROWID, LongType())])
        if not files:
            out = self.spark.createDataFrame([], full)
        elif external:
            out = self.spark.read.schema(schema).parquet(*files).withColumn(ROWID, new_rowids(0))
        else:
            out = self.spark.read.schema(full).parquet(*files)
        return out if rowid else out.drop(ROWID)

    def read(self, name: str, version: int | None = None, rowid: bool = False) -> DataFrame:
        """A table as of a snapshot (the last one if None)."""
        entry = self._entry(name, version)
        return self._scan(entry["files"], StructType.fromJson(entry["schema"]), rowid, entry.get("external", False))

    def changes(self, name: str, low: int, high: int) -> DataFrame:
        """snapshot_id, rowid, change_type and the row, for snapshots low to high; only files that differ are read."""
        schema = self.schema(name, high)
        out = None
        for id in [i for i in self.log.ids() if low <= i <= high and name in self.log.get(i).tables]:
            old, new = self.log.state(name, id - 1), self.log.get(id).tables[name]
            before, after = set(old["files"]) if old else set(), set(new["files"])
            was = self._scan(sorted(before - after), StructType.fromJson(old["schema"]) if old else schema, True)
            now = self._scan(sorted(after - before), StructType.fromJson(new["schema"]), True)
            full = StructType([*schema.fields, StructField(ROWID, LongType())])
            found = cdc.row_changes(adapt(was, full), adapt(now, full), ROWID).withColumn("snapshot_id", F.lit(id).cast("long"))
            out = found if out is None else out.unionByName(found)
        if out is None:
            out = self.spark.createDataFrame([], StructType([*schema.fields, StructField(ROWID, LongType())])).select("*", F.lit("").alias("change_type"), F.lit(0).cast("long").alias("snapshot_id"))
        return out.withColumnRenamed(ROWID, "rowid").select("snapshot_id", "rowid", "change_type", *[f"`{f.name}`" for f in schema.fields])

    def snapshots(self) -> DataFrame:
        """snapshot_id, snapshot_time, model, kind, run_type, rows_affected, depends of every commit."""
        rows = [
            (c.id, c.time, c.info.get("model"), c.info.get("kind"), c.info.get("run_type"), c.info.get("rows_affected"), c.info.get("duration_ms"), c.info.get("depends") or [], c.info.get("sql_hash"))
            for c in self.log.all()
        ]
        kind = "snapshot_id long, snapshot_time string, model string, kind string, run_type string, rows_affected long, duration_ms long, depends array<string>, sql_hash string"
        return self.spark.createDataFrame(rows, kind)

    # -- writing

    def stage(self, df: DataFrame, name: str, snapshot: int, partitioned_by: list[str] = (), sorted_by: list[str] = ()) -> list[str]:
        """Write rows to files that nothing refers to yet.  Rows without a row id get one."""
        if ROWID in df.columns:
            df = df.withColumn(ROWID, F.coalesce(ROWID, new_rowids(snapshot)))
        else:
            df = df.withColumn(ROWID, new_rowids(snapshot))
        df = df.select(*[F.col(f"`{c}`") for c in df.columns if c != ROWID], F.col(ROWID).cast("long").alias(ROWID))
        hints = [storage_transform(h) for h in partitioned_by]
        if hints:
            df = df.repartition(*hints)
        if hints or sorted_by:
            df = df.sortWithinPartitions(*hints, *[F.col(c) for c in sorted_by])
        path = f"{self.root}/{name.replace('.', '/')}/{snapshot:012d}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return sorted(p for p, n, _ in self.files.list(path, True) if p.endswith(".parquet"))

    def entry(self, schema: StructType, files: list[str], kind: str, **more) -> dict:
        plain = StructType([f for f in schema.fields if f.name != ROWID])
        return {"schema": plain.jsonValue(), "files": files, "kind": kind, **more}

    def commit(self, tables: dict[str, dict], info: dict | None = None, acks: list[str] = (), base: int | None = None) -> Commit:
        return self.log.append(tables, info, acks, base)

    def attach(self, name: str, path: str) -> Commit:
        """Register Parquet files outside the lake as a table; nothing is copied."""
        df = self.spark.read.parquet(path)
        return self.commit({name: {"schema": df.schema.jsonValue(), "files": [path], "kind": "source", "external": True}}, {"attach": path})

    def drop(self, name: str) -> Commit:
        return self.commit({name: {"dropped": True, "files": [], "schema": StructType([]).jsonValue()}}, {"drop": name})

    def touched_files(self, name: str, keys: DataFrame, by: list[str], where: str = "true") -> list[str]:
        """The files with a row that has one of the keys (null equals null): all that a change has to rewrite."""
        entry = self._entry(name, None)
        names = [f"k{i}" for i in range(len(by))]
        rows = self.read(name, rowid=True).where(where).select(*[F.col(f"`{k}`").alias(n) for k, n in zip(by, names)], F.input_file_name().alias("file"))
        wanted = keys.select(*[F.col(f"`{k}`").alias(f"s{i}") for i, k in enumerate(by)])
        same = F.lit(True)
        for i, n in enumerate(names):
            same = same & F.col(n).eqNullSafe(F.col(f"s{i}"))
        found = {_plain(unquote(r.file)) for r in rows.join(wanted, same, "left_semi").select("file").distinct().collect()}
        files = [f for f in entry["files"] if _plain(f) in found]
        if len(files) != len(found):
            raise RuntimeError(f"{name}: rows come from files that its snapshot does not list: {sorted(found)[:3]}")
        return files


def _plain(path: str) -> str:
    """A listed path, as Hadoop writes it; files that a query names are URL-encoded and come decoded."""
    return path.replace("file:///", "file:/")


def storage_transform(hint: str) -> Column:
    """year(c), month(c), day(c), hour(c), bucket(n, c), or a column."""
    import re

    m = re.fullmatch(r"\s*(\w+)\s*\(\s*(?:(\d+)\s*,\s*)?(\w+)\s*\)\s*", hint)
    if not m:
        return F.col(hint.strip())
    if m[1].lower() == "bucket":
        return F.pmod(F.xxhash64(m[3]), F.lit(int(m[2])))
    return {"year": F.year, "month": lambda c: F.date_trunc("month", c), "day": F.to_date, "hour": lambda c: F.date_trunc("hour", c)}[m[1].lower()](F.col(m[3]))
