"""Running models: decide, bind, stage, check, materialize, commit."""

from __future__ import annotations

import secrets
import time
import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from . import decide
from .dag import Graph
from .functions.dialect import to_spark
from .functions.masking import apply_masks
from .functions.sqlmacros import Macros, register_checks
from .lake import Lake
from .lake.table import ROWID
from .model import Model
from .operators import cdc, evolve, kinds
from .operators.checks import Context, failures, split_arguments
from .plans.bind import bind
from .plans.lineage import Output, Source, aggregated_tables, column_lineage, renames
from .plans.refs import dependencies, primary_table, relations, row_limits
from .sources import fetch as fetching
from .sources import push as pushing
from .sources.files import READERS
from .sources.state import State
from .variables import run_variables, substitute


class RunError(RuntimeError):
    """A model that did not commit."""


@dataclass
class RunResult:
    model: str
    kind: str
    run_type: str
    reason: str
    rows: int = 0
    snapshot: int | None = None
    warnings: list[str] = field(default_factory=list)
    error: str | None = None
    steps: dict[str, int] = field(default_factory=dict)


def run_id() -> str:
    return f"{datetime.now(UTC):%Y%m%d-%H%M%S}-{secrets.token_hex(3)}"


class Runner:
    """Runs models against a lake.

    ``fallback`` is a lake that is read where ``lake`` lacks a table (production, under a sandbox).
    """

    def __init__(self, spark: SparkSession, lake: Lake, state: State | None = None, variables: dict | None = None, config_hash: str = "", fallback: Lake | None = None, macros: list[str] = (), macro_prefix: str = ""):
        self.spark, self.lake, self.state = spark, lake, state or State()
        self.variables, self.config, self.fallback = dict(variables or {}), config_hash, fallback
        self.macros = Macros(list(macros), macro_prefix, lake, self.table, run_variables(run_id()) | {"dag_start": lake.log.last()})
        register_checks(self.macros, lambda text: to_spark(spark, text))

    # -- sources

    def table(self, name: str, version: int | None = None) -> DataFrame:
        if self.lake.exists(name, version) or self.fallback is None:
            return self.lake.read(name, version)
        return self.fallback.read(name, version)

    def text(self, model: Model, variables: dict) -> str:
        """A model's query as Spark SQL: macros expanded, variables put in, the dialect rewritten."""
        return to_spark(self.spark, substitute(self.macros.expand(model.sql), variables), lambda n: self.table(n).columns)

    def _known(self, name: str) -> bool:
        return self.lake.exists(name) or self.fallback is not None and self.fallback.exists(name)

    def _changed(self, name: str, since: int) -> str:
        """no, yes or schema: what became of a table since a snapshot."""
        if not self.lake.exists(name):
            return "no"
        old, new = self.lake.log.state(name, since), self.lake.log.state(name)
        if old is None:
            return "schema"
        if old["schema"] != new["schema"]:
            return "schema"
        return "no" if old["files"] == new["files"] else "yes"

    def _call(self, text: str, model: Model, known: dict) -> tuple[DataFrame, bool]:
        """Rows of a table function in a FROM clause, and whether it says that nothing changed."""
        name, _, inner = text.partition("(")
        args = [a.strip("'") if a.startswith("'") else float(a) if "." in a else int(a) if a.lstrip("-").isdigit() else a for a in split_arguments(inner.rstrip()[:-1])]
        name = name.strip()
        if name in READERS:
            return READERS[name](self.spark, *args), False
        lib = fetching.REGISTRY[name]
        if lib.fetch_kinds and model.kind not in lib.fetch_kinds:
            raise RunError(f"{model.target}: {name} does not give kind {model.kind}")
        left = self.state.fetch_of(model.target)
        if left and left[0] in self.lake.log.acked():  # committed, but the run ended before the buffer was cleared
            self.state.clear_buffer(model.target)
        got = fetching.fetch_rows(lib, args, self.state, model.target, **known)
        self._claims += [got.claim] if got.claim else []
        if not got.rows and not lib.columns and self.lake.exists(model.target):
            return self.lake.read(model.target).limit(0), got.no_change
        df = fetching.to_frame(self.spark, got.rows, lib.columns or None)
        if lib.supported_columns and (odd := [c for c in df.columns if c not in lib.supported_columns]):
            raise RunError(f"{model.target}: {name} does not give column {odd[0]}")
        return df, got.no_change

    def query(self, model: Model, run_type: str, known: dict) -> tuple[DataFrame, str, bool]:
        """(result, run type, nothing fetched): the model's query on full, changed or empty inputs."""
        variables = self.variables | known
        text = self.text(model, variables)
        last, self._claims = self.lake.log.latest(model.target), []
        spans = {r.name: text[r.start : r.stop + 1] for r in relations(self.spark, text) if r.table_function}
        called = {n: self._call(t, model, known) for n, t in spans.items() if n in READERS or n in fetching.REGISTRY}
        quiet = bool(called) and all(q for _, q in called.values())
        frames: dict[str, DataFrame] = {n: df for n, (df, _) in called.items()}
        if model.kind in ("append", "merge") and run_type == decide.INCREMENTAL and last is not None:
            deps = dependencies(self.spark, text)
            lineage = column_lineage(self.spark, text)
            watched = {d for d in deps if d == primary_table(self.spark, text) or d in aggregated_tables(lineage)}
            states = {d: self._changed(d, last.id) for d in watched}
            if "schema" in states.values():
                run_type = decide.BACKFILL
            else:
                for d, s in states.items():
                    frames[d] = cdc.delta(self.table(d), self.lake.read(d, last.id)) if s == "yes" else cdc.empty(self.table(d))
        source = lambda n: frames[n] if n in frames else self.table(n) if self._known(n) else None
        try:
            return bind(self.spark, text, source), run_type, quiet
        except AnalysisException:
            if run_type != decide.INCREMENTAL or not frames:
                raise
            plain = lambda n: called[n][0] if n in called else self.table(n) if self._known(n) else None
            return bind(self.spark, text, plain), decide.BACKFILL, quiet

    # -- one model

    def run(self, model: Model, decision: decide.Decision | None = None, run: str | None = None) -> RunResult:
        began, run = time.time(), run or run_id()
        hash_ = decide.model_hash(model, self.config)
        decision = decision or decide.decide(model, hash_, self.lake.log)
        out = RunResult(model.target, model.kind, decision.run_type, decision.reason)
        if decision.run_type == decide.SKIP:
            self._push(model, out)
            return out

        def step(name: str, since: float) -> float:
            out.steps[name] = round((time.time() - since) * 1000)
            return time.time()

        at = time.time()
        if limits := row_limits(self.spark, self.text(model, self.variables)):
            raise RunError(f"{model.target}: {' and '.join(limits)} not allowed in a model; use row_number() and a filter")
        base = self.lake.log.last()
        exists = self.lake.exists(model.target)
        backfill = decision.run_type == decide.BACKFILL
        known = self._incremental(model, backfill or not exists) | run_variables(run)
        df, out.run_type, quiet = self.query(model, decision.run_type, known)
        tags = model.tags
        df = apply_masks(df, tags, model.keys) if any(tags.values()) else df
        try:
            staged = self._staged(df)
        except Exception:
            if out.run_type != decide.INCREMENTAL or model.kind not in ("append", "merge"):
                raise
            self._drop_staged()
            out.warnings.append("the query failed on changed rows only: full run")
            known = self._incremental(model, True) | run_variables(run)
            df, out.run_type, quiet = self.query(model, decide.BACKFILL, known)
            staged = self._staged(apply_masks(df, tags, model.keys) if any(tags.values()) else df)
        at = step("query", at)
        try:
            change, renamed = self._evolution(model, staged, out)
            if model.kind in ("merge", "scd2", "tracked"):
                if not model.keys:
                    raise RunError(f"{model.target}: kind {model.kind} needs {'@group_key' if model.kind == 'tracked' else '@unique_key'}")
                kinds.check_keys(staged, model.keys, unique=model.kind != "tracked")
            context = Context(table=self.table, variables=self.variables)
            if bad := failures(staged, "constraint", model.constraints, context):
                raise RunError(f"{model.target}: constraint failed: {'; '.join(bad)}")
            at = step("constraints", at)
            incremental = exists and (out.run_type == decide.INCREMENTAL or change.kind != "none" and out.run_type != decide.BACKFILL)
            made = self._materialize(model, staged, base, incremental, renamed)
            at = step("materialize", at)
            if made is None and not (change.kind != "none" or model.audits):
                out.rows = 0
                self.state.clear_buffer(model.target)
                self._push(model, out)
                return out
            schema, files, out.rows = made if made is not None else self._unchanged(model)
            if model.audits:
                new = self.lake._scan(files, schema, False)
                if bad := failures(new, "audit", model.audits, context):
                    raise RunError(f"{model.target}: audit failed: {'; '.join(bad)}")
                at = step("audits", at)
            lineage = [{"column": o.column, "sources": [vars(s) for s in o.sources]} for o in column_lineage(self.spark, self.text(model, known))]
            info = {
                "model": model.target, "kind": model.kind, "sql_hash": hash_, "run_type": out.run_type, "reason": out.reason, "rows_affected": out.rows, "dag_run_id": run,
                "depends": dependencies(self.spark, self.text(model, known)), "columns": [{"name": n, "type": t} for n, t in evolve.columns_of(staged.schema)],
                "column_lineage": lineage, "source_file": model.path, "duration_ms": round((time.time() - began) * 1000), "steps": out.steps,
            }
            entry = self.lake.entry(schema, files, model.kind, comment=model.description, columns=model.columns, tags=model.tags)
            out.snapshot = self.lake.commit({model.target: entry}, info, self._claims, base=base).id
            self.state.clear_buffer(model.target)
        finally:
            self._drop_staged()
        self._warn(model, out, base)
        self._push(model, out, base, backfill)
        return out

    def _incremental(self, model: Model, reset: bool) -> dict:
        if not model.incremental:
            return {}
        target = None if reset or not self.lake.exists(model.target) else self.lake.read(model.target)
        last = cdc.cursor_state(target, model.incremental, model.initial)
        commit = self.lake.log.latest(model.target)
        return {"incr_last_value": last, "incr_last_run": commit.time if commit and not reset else model.initial, "incr_is_backfill": reset, "incr_cursor": model.incremental}

    def _staged(self, df: DataFrame) -> DataFrame:
        """One evaluation of the query: everything after reads these files."""
        self._stage = f"{self.lake.root}/_staging/{uuid.uuid4().hex}"
        self._extra: list[str] = []
        df.write.parquet(self._stage)
        return self.spark.read.schema(df.schema).parquet(self._stage)

    def _drop_staged(self) -> None:
        for path in (self._stage, *self._extra):
            self.lake.files.delete(path)

    def _evolution(self, model: Model, staged: DataFrame, out: RunResult) -> tuple[evolve.SchemaChange, list[tuple[str, str]]]:
        last = self.lake.log.latest(model.target)
        if last is None or not self.lake.exists(model.target) or not last.info.get("columns"):
            return evolve.SchemaChange("none"), []
        change = evolve.classify([(c["name"], c["type"]) for c in last.info["columns"]], evolve.columns_of(staged.schema))
        if change.kind == "none":
            return change, []
        if change.added and change.dropped:
            old = [Output(o["column"], [Source(**s) for s in o["sources"]]) for o in last.info.get("column_lineage", [])]
            change = evolve.with_renames(change, renames(old, column_lineage(self.spark, self.text(model, self.variables))))
        out.warnings.append(change.message())
        retyped = {n.lower() for n, _, _ in change.retyped}
        if any(k.lower() in retyped for k in model.keys):
            out.run_type = decide.BACKFILL
            out.warnings.append("a key changed its type: backfill")
        else:
            out.run_type = decide.FULL if change.kind == "destructive" else decide.INCREMENTAL
        return change, change.renamed

    def _unchanged(self, model: Model) -> tuple[StructType, list[str], int]:
        entry = self.lake.log.state(model.target)
        return StructType.fromJson(entry["schema"]), entry["files"], 0

    def _materialize(self, model: Model, staged: DataFrame, base: int, incremental: bool, renamed) -> tuple[StructType, list[str], int] | None:
        """(schema, files, rows affected) of the new version, or None where nothing changed."""
        lake, snapshot, target = self.lake, base + 1, model.target
        write = lambda df: lake.stage(df, target, snapshot, model.partitioned_by, model.sorted_by)
        plain = lambda df: StructType([f for f in df.schema.fields if f.name != ROWID])
        if not incremental or model.kind == "table":
            first = staged
            if model.kind == "scd2":
                first = kinds.scd2(None, staged, model.unique_key, base).table
            elif model.kind == "tracked":
                first = kinds.tracked(None, staged, model.group_key).table
            return plain(first), write(first), staged.count()
        entry = lake.log.state(target)
        extra = [f for f in StructType.fromJson(entry["schema"]).fields if f.name in (*kinds.SCD2_COLUMNS, kinds.HASH_COLUMN)]
        wanted = StructType([*staged.schema.fields, *extra])
        same = wanted == StructType.fromJson(entry["schema"])
        rows = lambda files: evolve.adapt(
            lake._scan(files, StructType.fromJson(entry["schema"]), True), StructType([*wanted.fields, lake.read(target, rowid=True).schema[ROWID]]), renamed
        )
        if model.kind == "append":
            old = entry["files"] if same else write(rows(entry["files"]))
            return wanted, [*old, *write(staged)], staged.count()
        if model.kind == "merge":
            files = lake.touched_files(target, staged, [model.unique_key]) if same else entry["files"]
            touched, key = rows(files), kinds.key_name(staged, model.unique_key)
            ids = touched.select(F.col(f"`{key}`").alias("__k"), ROWID)
            new = staged.join(ids, F.col(f"`{key}`").eqNullSafe(F.col("__k")), "left").drop("__k")
            merged = kinds.merge(touched, new, key)
            return wanted, [*[f for f in entry["files"] if f not in files], *write(merged.table)], staged.count()
        whole = rows(entry["files"])
        keys = [kinds.key_name(staged, k) for k in model.keys]
        if model.kind == "scd2":
            found = kinds.scd2_changes(whole.where("is_current"), staged, keys[0])
        else:
            new = kinds.hashed(staged, keys)
            found = kinds.tracked_changes(whole, new, keys)
        changes = self._kept(found)  # read several times below; only keys that changed
        if same and changes.isEmpty():
            return None
        # files without a changed key stay as they are
        if model.kind == "scd2":
            files = lake.touched_files(target, changes.where("__old is not null"), keys, "is_current") if same else entry["files"]
            more = kinds.scd2_opened(changes, keys[0], staged.columns, base)
            left = kinds.scd2_closed(rows(files), changes, keys[0], base)
        else:
            files = lake.touched_files(target, changes, keys) if same else entry["files"]
            more = new.join(changes, keys, "left_semi").select(*[f"`{c}`" for c in new.columns])
            left = rows(files).join(changes, keys, "left_anti").select(*[f"`{c}`" for c in [*[f.name for f in wanted.fields], ROWID]])
        made = write(left.unionByName(more, allowMissingColumns=True))
        return wanted, [*[f for f in entry["files"] if f not in files], *made], more.count()

    def _kept(self, df: DataFrame) -> DataFrame:
        """Written beside the staged result, and gone with it."""
        path = f"{self._stage}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self._extra.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _warn(self, model: Model, out: RunResult, base: int) -> None:
        if not model.warnings:
            return
        previous = [c for c in self.lake.log.all() if c.info.get("model") == model.target and c.id < out.snapshot]
        changes = self.lake.changes(model.target, previous[-1].id + 1, out.snapshot) if previous else None
        out.warnings += failures(self.lake.read(model.target), "warning", model.warnings, Context(table=self.table, changes=changes, variables=self.variables))

    def _push(self, model: Model, out: RunResult, base: int | None = None, backfill: bool = False) -> None:
        lib = fetching.REGISTRY.get(model.push or "")
        if lib is None:
            return
        if out.snapshot is not None:
            self.state.enqueue(model.target, pushing.delta_events(self.lake, model.target, (base or 0) + 1, out.snapshot), replace=backfill)
        if lib.push_kinds and model.kind not in lib.push_kinds:
            raise RunError(f"{model.target}: {lib.name} does not take kind {model.kind}")
        mode = lib.mode or ("async" if lib.submit and lib.push is None else "sync")
        done = pushing.push(self.lake, self.state, lib, model.target, lib.batch_size, mode, lib.workers)
        out.warnings += done.warnings + done.errors

    # -- all models

    def run_all(self, models: list[Model]) -> list[RunResult]:
        """In the order of the graph; what depends on a failed model is skipped.

        Decisions are made once for all and again only for direct dependents of a model that ran.
        """
        graph, run = Graph.of(self.spark, models), run_id()
        order = graph.order()
        decisions = decide.decide_all([graph.models[t] for t in order], self.lake.log, self.config)
        failed: set[str] = set()
        out = []
        for t in order:
            model = graph.models[t]
            if t in failed:
                out.append(RunResult(t, model.kind, decide.SKIP, "skipped: upstream model failed"))
                continue
            decision = decisions.get(t) or decide.decide(model, decide.model_hash(model, self.config), self.lake.log)
            try:
                found = self.run(model, decision, run)
            except Exception as e:
                found = RunResult(t, model.kind, decision.run_type, decision.reason, error=str(e))
                failed |= graph.downstream(t)
            if found.run_type != decide.SKIP and found.error is None:
                for d in graph.downstream(t, direct=True):
                    decisions.pop(d, None)
            out.append(found)
        return out
