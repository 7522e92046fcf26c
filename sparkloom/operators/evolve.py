"""Schema evolution: what changed between two schemas, and rows brought to the new one."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .. import types

Columns = list[tuple[str, str]]


@dataclass
class SchemaChange:
    """kind: none, additive, type_change or destructive."""

    kind: str
    added: Columns = field(default_factory=list)
    dropped: Columns = field(default_factory=list)
    retyped: list[tuple[str, str, str]] = field(default_factory=list)
    renamed: list[tuple[str, str]] = field(default_factory=list)

    def message(self) -> str:
        parts = [f"{old} → {new}" for old, new in self.renamed]
        parts += [f"+{n} {t}" for n, t in self.added] + [f"-{n}" for n, _ in self.dropped]
        parts += [f"{n}: {a} → {b}" for n, a, b in self.retyped]
        return "schema evolution: " + ", ".join(parts) if parts else ""


def columns_of(schema: StructType) -> Columns:
    return [(f.name, types.canonical(f.dataType)) for f in schema.fields]


def classify(old: Columns, new: Columns) -> SchemaChange:
    was, now = {n.lower(): (n, t) for n, t in old}, {n.lower(): (n, t) for n, t in new}
    out = SchemaChange("none")
    out.added = [c for k, c in now.items() if k not in was]
    out.dropped = [c for k, c in was.items() if k not in now]
    out.retyped = [(c[0], was[k][1], c[1]) for k, c in now.items() if k in was and types.normalize(was[k][1]) != types.normalize(c[1])]
    if out.dropped or any(not types.promotable(a, b) for _, a, b in out.retyped):
        out.kind = "destructive"
    elif out.retyped:
        out.kind = "type_change"
    elif out.added:
        out.kind = "additive"
    return out


def with_renames(change: SchemaChange, renamed: list[tuple[str, str]]) -> SchemaChange:
    """The change without the columns that were only renamed."""
    olds, news = {a.lower() for a, _ in renamed}, {b.lower() for _, b in renamed}
    out = SchemaChange(
        change.kind,
        [c for c in change.added if c[0].lower() not in news],
        [c for c in change.dropped if c[0].lower() not in olds],
        change.retyped,
        renamed,
    )
    if change.kind == "destructive" and not out.dropped and all(types.promotable(a, b) for _, a, b in out.retyped):
        out.kind = "type_change" if out.retyped else "additive"
    return out


def adapt(df: DataFrame, schema: StructType, renamed: list[tuple[str, str]] = ()) -> DataFrame:
    """Rows under the new schema: renamed columns keep values, widened ones are cast, others are null."""
    back = {new.lower(): old.lower() for old, new in renamed}
    have = {c.lower(): c for c in df.columns}
    out = []
    for f in schema.fields:
        source = have.get(back.get(f.name.lower(), f.name.lower()))
        if source is None:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        old = df.schema[source].dataType
        if old == f.dataType:
            out.append(F.col(f"`{source}`").alias(f.name))
        elif types.promotable(types.canonical(old), types.canonical(f.dataType)):
            out.append(F.col(f"`{source}`").cast(f.dataType).alias(f.name))
        else:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*out)


def schema_diff(left: Columns, right: Columns) -> list[tuple[str, str | None, str | None, str]]:
    """(column, left type, right type, added/removed/changed/same), by name."""
    a, b = dict(left), dict(right)
    state = lambda n: "added" if n not in a else "removed" if n not in b else "same" if a[n] == b[n] else "changed"
    return [(n, a.get(n), b.get(n), state(n)) for n in sorted(a.keys() | b.keys())]
