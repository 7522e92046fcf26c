"""History, statistics and descriptions from the commit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import types
from .lake import Lake
from .operators.joins import top_n
from .plans.lineage import impact



def history(lake: Lake, model: str | None = None, limit: int = 20) -> DataFrame:
    out = lake.snapshots().where("model IS NOT NULL")
    if model:
        out = out.where(F.lower("model") == model.lower())
    return out.orderBy(F.desc("snapshot_id")).limit(limit)


def latest_per_model(snapshots: DataFrame) -> DataFrame:
    return top_n(snapshots.where("model IS NOT NULL").withColumn("__m", F.lower("model")), ["__m"], [F.desc("snapshot_id")], 1).drop("__m")


def kind_breakdown(snapshots: DataFrame) -> DataFrame:
    """kind, models, rows: over each model's last commit."""
    return latest_per_model(snapshots).groupBy("kind").agg(F.count(F.lit(1)).alias("models"), F.coalesce(F.sum("rows_affected"), F.lit(0)).alias("rows"))


def run_stats(snapshots: DataFrame) -> DataFrame:
    """One row: commits, models, mean and greatest duration in ms."""
    return snapshots.where("model IS NOT NULL").agg(
        F.count(F.lit(1)).alias("commits"), F.countDistinct("model").alias("models"), F.round(F.avg("duration_ms"), 3).alias("mean_ms"), F.max("duration_ms").alias("max_ms")
    )


def downstream(snapshots: DataFrame, target: str) -> DataFrame:
    """Models whose last commit depends on ``target``, whatever the case."""
    hit = F.exists("depends", lambda d: F.lower(d) == target.lower())
    return latest_per_model(snapshots).where(hit).select("model")


def impact_of(lake: Lake, target: str) -> dict[str, list[str]]:
    edges = {}
    for c in lake.log.all():
        if c.info.get("model"):
            edges[c.info["model"]] = c.info.get("depends") or []
    return impact(edges, target)


def describe(lake: Lake, name: str) -> dict:
    entry, commit = lake.log.state(name), lake.log.latest(name)
    if entry is None:
        raise KeyError(name)
    df = lake.read(name)
    return {
        "name": name, "kind": entry.get("kind"), "comment": entry.get("comment"), "rows": df.count(), "files": len(entry["files"]),
        "columns": [{"name": f.name, "type": f.dataType.simpleString(), "comment": (entry.get("columns") or {}).get(f.name)} for f in df.schema.fields],
        "depends": commit.info.get("depends") if commit else [], "last_run": commit.time if commit else None, "lineage": commit.info.get("column_lineage") if commit else [],
    }


def summarize(df: DataFrame) -> DataFrame:
    """One row for each column: type, least, greatest, distinct (approximate), rows and share of nulls; one pass over the table."""
    parts = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        text = lambda x: x.cast("string")
        parts.append(
            F.struct(
                F.lit(i).alias("place"), F.lit(f.name).alias("column_name"), F.lit(types.canonical(f.dataType)).alias("column_type"), text(F.min(c)).alias("least"), text(F.max(c)).alias("greatest"),
                F.approx_count_distinct(c).alias("approx_unique"), F.count(F.lit(1)).alias("rows"), F.round(F.try_divide(F.count_if(c.isNull()) * 100.0, F.count(F.lit(1))), 2).alias("null_percentage"),
            )
        )
    return df.agg(F.array(*parts).alias("c")).select(F.inline("c")).orderBy("place").drop("place")


def _edges(lake: Lake) -> dict[str, list[str]]:
    """model -> what its last commit read."""
    out: dict[str, list[str]] = {}
    for c in lake.log.all():
        if c.info.get("model"):
            out[c.info["model"]] = list(c.info.get("depends") or [])
    return out


def lineage_overview(lake: Lake) -> DataFrame:
    """level, model, reads, read_by: all models, sources of others first; a level is the longest way from a source."""
    edges = _edges(lake)
    names = sorted({*edges, *(d for x in edges.values() for d in x)})
    levels: dict[str, int] = {}

    def level(n: str, above: tuple = ()) -> int:
        if n not in levels:
            levels[n] = 1 + max((level(d, (*above, n)) for d in edges.get(n, []) if d not in above), default=-1)
        return levels[n]

    rows = [(level(n), n, len(edges.get(n, [])), sum(n in x for x in edges.values())) for n in names]
    return lake.spark.createDataFrame(sorted(rows), "level int, model string, reads int, read_by int")


def lineage_tree(lake: Lake, model: str, down: bool = False) -> list[str]:
    """A model and what it reads (or what reads it, ``down``), as lines of a tree."""
    edges = _edges(lake)
    near = (lambda n: sorted(m for m, x in edges.items() if n in x)) if down else (lambda n: sorted(edges.get(n, [])))

    def lines(n: str, lead: str, above: tuple) -> list[str]:
        out = []
        for i, child in enumerate(some := [c for c in near(n) if c not in above]):
            last = i == len(some) - 1
            out.append(f"{lead}{'└─ ' if last else '├─ '}{child}")
            out += lines(child, lead + ("   " if last else "│  "), (*above, child))
        return out

    return [model, *lines(model, "", (model,))]


def column_trace(lake: Lake, model: str, column: str) -> DataFrame:
    """step, model, column, source_table, source_column, transformation: a column's way back to its sources."""
    rows, todo, seen = [], [(0, model, column)], set()
    while todo:
        step, m, c = todo.pop(0)
        commit = lake.log.latest(m)
        if commit is None or (m, c) in seen:
            continue
        seen.add((m, c))
        for o in commit.info.get("column_lineage", []):
            if o["column"].lower() == c.lower():
                for x in o["sources"]:
                    rows.append((step, m, o["column"], x["table"], x["column"], x["transformation"]))
                    todo.append((step + 1, x["table"], x["column"]))
    return lake.spark.createDataFrame(rows, "step int, model string, column string, source_table string, source_column string, transformation string")
