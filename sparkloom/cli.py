"""Command line: ``python -m sparkloom.cli COMMAND``.  Exit codes: 0 clean, 1 findings or failures, 2 bad call."""

from __future__ import annotations

import argparse
import csv
import io
import json
import re
import sys
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from . import decide, inspect, maintain, sandbox, validate
from .config import find_project
from .functions.dialect import to_spark
from .functions.sqlmacros import Macros
from .lake import Lake
from .model import load_models
from .plans.bind import bind
from .plans.refs import is_read_only
from .runner import Runner
from .shared import own_folder
from .sources.api import load_libraries
from .sources.state import State
from .variables import run_variables

MAINTENANCE = ("merge", "expire", "cleanup", "checkpoint")


def render(df: DataFrame, form: str) -> str:
    """Rows as csv, json or a markdown table."""
    rows = [r.asDict(recursive=True) for r in df.collect()]
    if form == "json":
        return json.dumps(rows, default=str)
    if form == "csv":
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(df.columns)
        writer.writerows([["" if r[c] is None else r[c] for c in df.columns] for r in rows])
        return out.getvalue()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *["| " + " | ".join(cell(r[c]) for c in df.columns) + " |" for r in rows]])


def envelope(data: object, warnings: list[str] = ()) -> str:
    return json.dumps({"version": 1, "data": data, "warnings": list(warnings)}, default=str)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    top = argparse.ArgumentParser(prog="sparkloom")
    top.add_argument("--project", default=".")
    top.add_argument("--json", action="store_true")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("run", "sandbox"):
        sub.add_parser(name).add_argument("model", nargs="?")
    sub.add_parser("validate")
    sub.add_parser("stats")
    sub.add_parser("history").add_argument("model", nargs="?")
    for name in ("describe", "lineage"):
        sub.add_parser(name).add_argument("model")
    for name, what in (("sql", "text"), ("query", "table")):
        p = sub.add_parser(name)
        p.add_argument(what)
        p.add_argument("--format", choices=("csv", "json", "markdown"), default="markdown")
        p.add_argument("--limit", type=int)
    for name in MAINTENANCE:
        sub.add_parser(name)
    try:
        args = top.parse_args(argv)
        project = find_project(args.project)
    except SystemExit as e:
        return 2 if e.code else 0
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("sparkloom").getOrCreate()
    lake = Lake(spark, project.lake_path)
    show = lambda data, warnings=(): print(envelope(data, warnings) if args.json else json.dumps(data, indent=1, default=str))

    if args.command in ("run", "sandbox"):
        load_libraries(project.folder, project.env or None)
        models = [m for m in load_models(project.folder) if args.model in (None, m.target)]
        if args.command == "run":
            results = Runner(spark, lake, State(project.state_path), project.variables, decide.config_hash(project.folder), None, project.macros, project.macro_prefix).run_all(models)
            show([asdict(r) for r in results], [w for r in results for w in r.warnings])
        else:
            fork, results = sandbox.preview(spark, lake, own_folder(spark, "sandbox"), models)
            show([asdict(sandbox.diff(lake, fork, n)) for n in sandbox.changed_tables(lake, fork)], [w for r in results for w in r.warnings])
        return int(any(r.error for r in results))
    if args.command == "validate":
        found = validate.validate_folder(spark, project.folder)
        show([f.asdict() for f in found])
        return int(any(f.severity == validate.BLOCKER for f in found))
    if args.command == "stats":
        show([r.asDict() for r in inspect.kind_breakdown(lake.snapshots()).collect()])
    elif args.command == "history":
        show([r.asDict() for r in inspect.history(lake, args.model).collect()])
    elif args.command == "describe":
        if not lake.exists(args.model):
            print(f"no table {args.model}", file=sys.stderr)
            return 1
        show(inspect.describe(lake, args.model))
    elif args.command == "lineage":
        show(inspect.impact_of(lake, args.model))
    elif args.command in ("sql", "query"):
        if args.command == "query":
            if not lake.exists(args.table):
                print(f"no table {args.table}", file=sys.stderr)
                return 1
            df = lake.read(args.table)
        else:
            text = to_spark(spark, Macros(project.macros, project.macro_prefix, lake, run=run_variables("sql")).expand(args.text))
            if m := re.fullmatch(r"\s*SUMMARIZE\s+([\w.]+)\s*;?\s*", text, re.I):
                df = inspect.summarize(lake.read(m[1]))
            elif is_read_only(spark, text):
                df = bind(spark, text, lambda n: lake.read(n) if lake.exists(n) else None)
            else:
                print("only statements that read", file=sys.stderr)
                return 1
        print(render(df.limit(args.limit) if args.limit else df, args.format))
    elif args.command == "merge":
        show({n: maintain.merge_files(lake, n) for n in lake.log.tables()})
    else:
        show(getattr(maintain, args.command)(lake))
    return 0


if __name__ == "__main__":
    sys.exit(main())
