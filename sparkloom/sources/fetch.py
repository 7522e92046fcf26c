"""Fetch: table functions that call Python to get rows from outside.

Paginated libraries give ``{"rows": [...], "next": cursor}`` per page; asynchronous ones are submitted,
polled and collected.  Rows go to a durable buffer first, with the place of the next page in the same
transaction, under one claim for the whole fetch.  A run after a crash goes on behind the last page that
was kept; the claim is acknowledged in the commit that takes the rows, so a crash between the commit and
the buffer's clearing does not load them again.
"""

from __future__ import annotations

import inspect
import json
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from .. import types
from .state import State


class FetchError(RuntimeError):
    pass


class Abort(Exception):
    """Raised by a library to end with no rows."""


@dataclass
class Library:
    name: str
    fetch: Callable | None = None
    submit: Callable | None = None
    check: Callable | None = None
    result: Callable | None = None
    push: Callable | None = None
    finalize: Callable | None = None
    interval: float = 1.0
    backoff: float = 1.5
    timeout: float = 600.0
    columns: dict[str, str] = field(default_factory=dict)
    batch_size: int = 100
    mode: str | None = None
    workers: int = 1
    supported_columns: list[str] | None = None
    fetch_kinds: list[str] | None = None
    push_kinds: list[str] | None = None


class Save:
    """Handed to a library that saves its rows one by one instead of returning them."""

    def __init__(self):
        self.rows: list[dict] = []

    def row(self, values: dict) -> None:
        self.rows.append(dict(values))


REGISTRY: dict[str, Library] = {}


def library(lib: Library) -> Library:
    REGISTRY[lib.name] = lib
    return lib


def call(fn: Callable, *args, **known):
    """Call with those keyword arguments that the function takes."""
    params = inspect.signature(fn).parameters
    if any(p.kind is p.VAR_KEYWORD for p in params.values()):
        return fn(*args, **known)
    return fn(*args, **{k: v for k, v in known.items() if k in params})


@dataclass
class Fetched:
    rows: list[dict]
    no_change: bool = False
    claim: str | None = None


def fetch_rows(lib: Library, args: list, state: State, target: str, sleep: Callable[[float], None] = time.sleep, **known) -> Fetched:
    """All rows of a call, through the buffer of ``target``; rows left by a crashed run come first."""
    no_change, seen, known = False, set(), known | {"target": target}
    left = state.fetch_of(target)
    claim, page, done = left or (uuid.uuid4().hex, None, False)
    page = json.loads(page) if page else None
    try:
        if done:
            pass
        elif lib.submit is not None:
            job, wait, began = call(lib.submit, *args, **known), lib.interval, time.monotonic()
            while not call(lib.check, job, **known):
                if time.monotonic() - began > lib.timeout:
                    raise FetchError(f"{lib.name}: no result after {lib.timeout:g} s")
                sleep(wait)
                wait *= lib.backoff
            state.keep_page(target, claim, _rows(call(lib.result, job, **known)), None, True)
        else:
            while not done:
                save = Save()
                got = call(lib.fetch, *args, page=page, save=save, **known)
                got = got if isinstance(got, dict) else {"rows": list(got or [])}
                got["rows"] = [*(got.get("rows") or []), *save.rows]
                no_change = got.get("empty_result") == "no_change"
                page = got.get("next")
                done = page in (None, "")
                mark = json.dumps(page, sort_keys=True, default=str)
                if not done and mark in seen:
                    raise FetchError(f"{lib.name}: page {page} came twice")
                seen.add(mark)
                state.keep_page(target, claim, got["rows"], None if done else mark, done)
    except Abort:
        state.clear_buffer(target)
        return Fetched([], False)
    rows = state.buffered(target)
    return Fetched(rows, no_change and not rows, claim)


def _rows(got) -> Iterable[dict]:
    return got.get("rows") or [] if isinstance(got, dict) else got or []


def infer_schema(rows: list[dict]) -> StructType:
    """By the first value of each column that is not null; lists and dicts are JSON text."""
    kinds: dict[str, object] = {}
    for row in rows:
        for name, v in row.items():
            if v is None:
                kinds.setdefault(name, None)
                continue
            kind = BooleanType() if isinstance(v, bool) else LongType() if isinstance(v, int) or isinstance(v, float) and v.is_integer() else DoubleType() if isinstance(v, float) else StringType()
            if kinds.get(name) is None:
                kinds[name] = kind
            elif isinstance(kinds[name], LongType) and isinstance(kind, DoubleType):
                raise FetchError(f"column {name} began with whole numbers and has {v}")
    return StructType([StructField(n, k or StringType()) for n, k in kinds.items()])


def to_frame(spark: SparkSession, rows: list[dict], columns: dict[str, str] | None = None) -> DataFrame:
    """Rows as a DataFrame; declared columns fix names and types, also without rows."""
    schema = StructType([StructField(n, types.parse(t)) for n, t in columns.items()]) if columns else infer_schema(rows)

    def fit(v, kind):
        if v is None:
            return None
        if isinstance(v, (dict, list)) and isinstance(kind, StringType):
            return json.dumps(v)
        if isinstance(kind, LongType) and isinstance(v, float):
            return int(v)
        if isinstance(kind, DoubleType) and not isinstance(v, bool) and isinstance(v, int):
            return float(v)
        return str(v) if isinstance(kind, StringType) and not isinstance(v, str) else v

    return spark.createDataFrame([tuple(fit(r.get(f.name), f.dataType) for f in schema.fields) for r in rows], schema)
