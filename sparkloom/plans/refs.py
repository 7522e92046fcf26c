"""What a query refers to, from Spark's own parser.

The unresolved plan gives every relation with its place in the text, so relations are replaced by
splicing text; there is no SQL parser of our own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Relation:
    """name as written; start and stop (inclusive) in the text; alias if it has one."""

    name: str
    start: int
    stop: int
    aliased: bool
    table_function: bool = False


def parse(spark: SparkSession, sql: str):
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def _seq(s) -> list:
    return [s.apply(i) for i in range(s.size())]


def name_of(node) -> str:
    return node.getClass().getSimpleName()


def inner_plans(node) -> list:
    """Plans inside a node's expressions (IN, EXISTS, scalar subqueries)."""
    out = []

    def walk(e):
        if hasattr_plan(e):
            out.append(e.plan())
        for c in _seq(e.children()):
            walk(c)

    for e in _seq(node.expressions()):
        walk(e)
    return out


def hasattr_plan(e) -> bool:
    return name_of(e) in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "InSubquery") and name_of(e) != "InSubquery"


def cte_names(node) -> list[tuple[str, object]]:
    """(name, plan) of a WITH node."""
    return [(_seq_pair(p)[0], _seq_pair(p)[1]) for p in _seq(node.cteRelations())]


def _seq_pair(p):
    return p._1(), p._2()


def relations(spark: SparkSession, sql: str) -> list[Relation]:
    """All tables and table functions that a query reads, in the order of the text; CTE names are left out in their scope."""
    out: list[Relation] = []

    def walk(node, ctes: frozenset[str], aliased: bool):
        kind = name_of(node)
        if kind == "UnresolvedWith":
            names = set(ctes)
            for name, plan in cte_names(node):
                walk(plan, frozenset(names | ({name.lower()} if node.allowRecursion() else set())), True)
                names.add(name.lower())
            walk(node.child(), frozenset(names), False)
            return
        if kind in ("UnresolvedRelation", "UnresolvedTableValuedFunction"):
            at = node.origin()
            if kind == "UnresolvedRelation":
                parts = _seq(node.multipartIdentifier())
                if len(parts) > 1 or parts[0].lower() not in ctes:
                    out.append(Relation(".".join(parts), at.startIndex().get(), at.stopIndex().get(), aliased))
            else:
                out.append(Relation(".".join(_seq(node.name())), at.startIndex().get(), at.stopIndex().get(), aliased, True))
        for plan in inner_plans(node):
            walk(plan, ctes, False)
        for child in _seq(node.children()):
            walk(child, ctes, kind == "SubqueryAlias")

    walk(parse(spark, sql), frozenset(), False)
    return sorted(set(out), key=lambda r: r.start)


def dependencies(spark: SparkSession, sql: str) -> list[str]:
    """Physical tables with a schema, without system ones, each once and sorted."""
    system = ("information_schema.", "pg_")
    found = {r.name for r in relations(spark, sql) if not r.table_function and "." in r.name}
    return sorted(n for n in found if not n.lower().startswith(system) and not n.split(".")[-1].lower().startswith(("tmp_", "temp_")))


def primary_table(spark: SparkSession, sql: str) -> str | None:
    """The leftmost physical table of the main FROM, through CTEs and derived tables."""

    def walk(node, ctes: dict):
        kind = name_of(node)
        if kind == "UnresolvedWith":
            inner = dict(ctes)
            for name, plan in cte_names(node):
                inner[name.lower()] = (plan, dict(inner))
            return walk(node.child(), inner)
        if kind == "UnresolvedRelation":
            name = ".".join(_seq(node.multipartIdentifier()))
            if name.lower() in ctes:
                plan, scope = ctes[name.lower()]
                return walk(plan, scope)
            return name
        for child in _seq(node.children()):
            if (found := walk(child, ctes)) is not None:
                return found
        return None

    return walk(parse(spark, sql), {})


def row_limits(spark: SparkSession, sql: str) -> list[str]:
    """LIMIT and OFFSET at any depth; models may not have them."""
    names = {"GlobalLimit": "LIMIT", "LocalLimit": "LIMIT", "Offset": "OFFSET"}
    found: set[str] = set()

    def walk(node):
        if (n := names.get(name_of(node))) is not None:
            found.add(n)
        if name_of(node) == "UnresolvedWith":
            for _, plan in cte_names(node):
                walk(plan)
        for plan in inner_plans(node):
            walk(plan)
        for child in _seq(node.children()):
            walk(child)

    walk(parse(spark, sql))
    return sorted(found)


def is_read_only(spark: SparkSession, sql: str) -> bool:
    """One statement that only reads."""
    try:
        plan = parse(spark, sql)
    except Exception:
        return False
    kind = name_of(plan)
    allowed = ("ExplainCommand", "DescribeRelation", "DescribeQueryCommand", "ShowTables", "ShowColumns", "ShowNamespaces")
    bases, c = [], plan.getClass()
    while c is not None:
        bases += [i.getSimpleName() for i in c.getInterfaces()]
        c = c.getSuperclass()
    return kind in allowed or not any("Command" in b for b in bases) and "Command" not in kind and not kind.startswith(("Create", "Drop", "Insert", "Delete", "Update", "Merge"))
