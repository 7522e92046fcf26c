"""Static findings on models, without running them."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.errors import ParseException
from pyspark.sql import SparkSession

from .dag import CycleError, Graph
from .model import Model, ModelError, parse_model, target_of
from .plans.refs import _seq, name_of, parse, relations, row_limits
from .sources.api import library_files, write_faults
from .sources.fetch import REGISTRY

BLOCKER, WARN, INFO = "BLOCKER", "WARN", "INFO"


@dataclass(frozen=True)
class Finding:
    rule: str
    severity: str
    target: str
    message: str

    def asdict(self) -> dict:
        return asdict(self)


def _projection(spark: SparkSession, sql: str) -> tuple[object, list]:
    """The outermost query node below sorts and filters, and its select list."""
    node, above = parse(spark, sql), []
    while name_of(node) not in ("Project", "Aggregate", "Union", "UnresolvedRelation") and _seq(node.children()):
        above.append(name_of(node))
        node = _seq(node.children())[0]
    items = _seq(node.projectList()) if name_of(node) == "Project" else _seq(node.aggregateExpressions()) if name_of(node) == "Aggregate" else []
    return (node, above), items


def _casts(items: list, rules: str, target: str) -> list[Finding]:
    out = []
    for e in items:
        if name_of(e) == "UnresolvedStar":
            out.append(Finding(f"{rules}.select_star_disallowed", BLOCKER, target, "name every column"))
        elif name_of(e) != "Alias":
            out.append(Finding(f"{rules}.alias_required", BLOCKER, target, f"{e.sql()} needs an alias"))
        elif name_of(e.children().apply(0)) not in ("Cast", "TryCast"):
            out.append(Finding(f"{rules}.cast_required", BLOCKER, target, f"{e.name()} needs a cast"))
    return out


def strict_fetch(spark: SparkSession, model: Model) -> list[Finding]:
    """A fetch model is one library call whose columns are all cast and named, and nothing else."""
    (node, above), items = _projection(spark, model.sql)
    out = _casts(items, "strict_fetch", model.target)
    calls = [r for r in relations(spark, model.sql) if r.table_function]
    if not calls:
        out.append(Finding("strict_fetch.no_lib_call", BLOCKER, model.target, "no library is called"))
    if len(calls) > 1:
        out.append(Finding("strict_fetch.multiple_lib_calls", BLOCKER, model.target, "one library call only"))
    kinds = {name_of(node), *above}
    children = {name_of(c) for c in _seq(node.children())}
    for found, rule in (("Aggregate", "group_by"), ("Distinct", "distinct"), ("Sort", "order_by"), ("Union", "union")):
        if found in kinds:
            out.append(Finding(f"strict_fetch.{rule}_disallowed", BLOCKER, model.target, f"no {rule.replace('_', ' ').upper()} in a fetch model"))
    if "Filter" in children:
        out.append(Finding("strict_fetch.where_clause_disallowed", BLOCKER, model.target, "no WHERE in a fetch model"))
    return out


def strict_push(spark: SparkSession, model: Model, known: set[str] | None = None) -> list[Finding]:
    """A pushed model casts and names its outer columns and calls no library."""
    _, items = _projection(spark, model.sql)
    out = _casts(items, "strict_push", model.target)
    if any(r.table_function and r.name in (REGISTRY if known is None else known) for r in relations(spark, model.sql)):
        out.append(Finding("strict_push.lib_call_disallowed", BLOCKER, model.target, "a pushed model calls no library"))
    if model.kind == "scd2":
        out.append(Finding("push.kind_not_supported", BLOCKER, model.target, "kind scd2 cannot be pushed"))
    if model.kind == "merge" and not model.unique_key:
        out.append(Finding("push.missing_unique_key", BLOCKER, model.target, "merge needs @unique_key"))
    if model.kind == "tracked" and not model.group_key:
        out.append(Finding("push.missing_group_key", BLOCKER, model.target, "tracked needs @group_key"))
    return out


def validate(spark: SparkSession, models: list[Model], libraries: set[str] = frozenset()) -> list[Finding]:
    """Findings on models that may call registered libraries and those named."""
    out, good, known = [], [], {*REGISTRY, *libraries}
    for m in models:
        try:
            limits = row_limits(spark, m.sql)
            calls = relations(spark, m.sql)
        except ParseException as e:
            out.append(Finding("parser.other", BLOCKER, m.target, str(e).splitlines()[0]))
            continue
        good.append(m)
        out += [Finding(f"read_only.{n.lower()}_disallowed", BLOCKER, m.target, f"{n} in a model") for n in limits]
        out += [Finding("cross_ast.unknown_lib", BLOCKER, m.target, f"unknown library {r.name}") for r in calls if r.table_function and m.fetch and r.name not in known]
        out += strict_fetch(spark, m) if m.fetch else []
        out += strict_push(spark, m, known) if m.push else []
    graph = Graph.of(spark, good)
    try:
        graph.order()
    except CycleError as e:
        out.append(Finding("dag.cycle_detected", BLOCKER, "", str(e)))
    for target, names in graph.external().items():
        out += [Finding("dag.external_reference", INFO, target, f"{n} is no model") for n in names]
    return out


def push_settings(apis: dict[str, dict], models: list[Model]) -> list[Finding]:
    """Settings of the pushed models' sinks that do not fit each other."""
    return [Finding(rule, BLOCKER, m.target, f"{m.push}: {why}") for m in models if m.push in apis for rule, why in write_faults(apis[m.push].get("push") or {})]


def validate_folder(spark: SparkSession, folder: str) -> list[Finding]:
    models, out, seen = [], [], set()
    for path in sorted(Path(folder, "models").rglob("*.sql")):
        target = target_of(str(path.relative_to(folder)))
        if target in seen:
            out.append(Finding("parser.duplicate_target", BLOCKER, target, f"{path} makes it again"))
        seen.add(target)
        try:
            models.append(parse_model(path.read_text(), target, str(path)))
        except ModelError as e:
            out.append(Finding(f"parser.{e.rule}", BLOCKER, target, str(e)))
    apis: dict[str, dict] = {}
    try:
        apis = {name: parts["API"] for name, parts in library_files(folder).items() if isinstance(parts["API"], dict)}
    except Exception as e:  # a library is the project's own code
        out.append(Finding("parser.library", BLOCKER, "", f"lib: {type(e).__name__}: {e}"))
    return out + push_settings(apis, models) + validate(spark, models, set(apis))
