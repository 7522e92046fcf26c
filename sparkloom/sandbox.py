"""Sandboxes: a lake that reads production and writes its own commits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from . import decide
from .lake import Lake
from .model import Model
from .operators import compare, evolve
from .runner import Runner, RunResult
from .sources.state import State


def fork(spark: SparkSession, prod: Lake, root: str) -> Lake:
    """A lake with production's commits up to now; data files are shared, as they never change."""
    out = Lake(spark, root)
    for commit in prod.log.all():
        out.log.append(commit.tables, commit.info, commit.acks, base=out.log.last())
    return out


@dataclass
class TableDiff:
    name: str
    rows_before: int
    rows_after: int
    added: int
    removed: int
    schema: list[tuple[str, str | None, str | None, str]]


def checked_decision(model: Model, decision: decide.Decision) -> decide.Decision:
    """In a sandbox a model with checks or tags is always run, so that they are seen."""
    if decision.run_type == decide.SKIP and (model.audits or model.constraints or model.warnings or any(model.tags.values())):
        return decide.Decision(decide.BACKFILL, "sandbox: checks")
    return decision


class SandboxRunner(Runner):
    def run(self, model: Model, decision: decide.Decision | None = None, run: str | None = None) -> RunResult:
        decision = decision or decide.decide(model, decide.model_hash(model, self.config), self.lake.log)
        return super().run(model, checked_decision(model, decision), run)


def preview(spark: SparkSession, prod: Lake, root: str, models: list[Model]) -> tuple[Lake, list[RunResult]]:
    lake = fork(spark, prod, root)
    return lake, SandboxRunner(spark, lake, State(), fallback=prod).run_all(models)


def diff(prod: Lake, sandbox: Lake, name: str) -> TableDiff:
    new = sandbox.read(name)
    if not prod.exists(name):
        n = new.count()
        return TableDiff(name, 0, n, n, 0, evolve.schema_diff([], evolve.columns_of(new.schema)))
    old = prod.read(name)
    found = compare.sandbox_diff(old, new)["counts"].first()
    schema = evolve.schema_diff(evolve.columns_of(old.schema), evolve.columns_of(new.schema))
    return TableDiff(name, old.count(), new.count(), found.added, found.removed, schema)


def changed_tables(prod: Lake, sandbox: Lake) -> list[str]:
    """Tables whose files differ; no data is read."""
    files = lambda lake, n: sorted((lake.log.state(n) or {}).get("files", []))
    return [n for n in sandbox.log.tables() if files(prod, n) != files(sandbox, n)]


def sample(prod: Lake, sandbox: Lake, name: str, n: int = 5) -> tuple[DataFrame, DataFrame]:
    found = compare.sandbox_diff(prod.read(name), sandbox.read(name), n)
    return found["added_sample"], found["removed_sample"]
