"""Models: one SELECT each, with directives in its header comments."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

# Kinds, and directives of a model.
KINDS = ("table", "append", "merge", "scd2", "tracked")
REMOVED_KINDS = ("view", "events", "partition")
SINGLE = ("kind", "unique_key", "incremental", "incremental_initial", "description", "expose")
LISTS = ("group_key", "partitioned_by", "sorted_by", "constraint", "audit", "warning", "extension")
FLAGS = ("fetch", "push", "push_config", "column")
REMOVED = {"sink": "deprecated_sink", "script": "deprecated_script", "sink_detect_deletes": "deprecated_sink_detect_deletes", "sink_delete_threshold": "deprecated_sink_delete_threshold"}
RESERVED = "__"
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


class ModelError(ValueError):
    """A model that cannot be read; ``rule`` names what is wrong."""

    def __init__(self, rule: str, message: str):
        super().__init__(message)
        self.rule = rule


@dataclass
class Model:
    target: str
    sql: str
    kind: str = "table"
    unique_key: str | None = None
    group_key: list[str] = field(default_factory=list)
    partitioned_by: list[str] = field(default_factory=list)
    sorted_by: list[str] = field(default_factory=list)
    incremental: str | None = None
    initial: str = "1970-01-01T00:00:00Z"
    constraints: list[str] = field(default_factory=list)
    audits: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    extensions: list[str] = field(default_factory=list)
    description: str | None = None
    columns: dict[str, str] = field(default_factory=dict)
    tags: dict[str, list[str]] = field(default_factory=dict)
    fetch: bool = False
    push: str | None = None
    path: str | None = None

    @property
    def keys(self) -> list[str]:
        return self.group_key if self.kind == "tracked" else [self.unique_key] if self.unique_key else []


def target_of(path: str, root: str = "models") -> str:
    """schema.table of a file: deeper folders are joined by __; without a folder the schema is main."""
    parts = Path(path).with_suffix("").parts
    if root not in parts:
        return f"tmp.{parts[-1]}"
    inside = parts[parts.index(root) + 1 :]
    if len(inside) == 1:
        return f"main.{inside[0]}"
    return f"{inside[0]}.{'__'.join(inside[1:])}"


def _statements(body: str) -> list[str]:
    """The statements of a text, without those that are empty; quotes and comments are respected."""
    out, now = [], ""
    for m in re.finditer(r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|/\*.*?\*/|;|[^;'\"/-]+|.", body, re.S):
        if m[0] == ";":
            out.append(now)
            now = ""
        else:
            now += m[0]
    bare = lambda s: re.sub(r"--[^\n]*|/\*.*?\*/", "", s, flags=re.S).strip()
    return [s.strip() for s in [*out, now] if bare(s)]


def _split(text: str) -> list[str]:
    from .operators.checks import split_arguments

    return [t for t in split_arguments(text) if t]


def parse_model(text: str, target: str, path: str | None = None) -> Model:
    if text.count("/*") > text.count("*/"):
        raise ModelError("unterminated_block_comment", "a block comment does not end")
    lines = text.splitlines()
    head = 0
    while head < len(lines) and (not lines[head].strip() or lines[head].strip().startswith("--")):
        head += 1
    body = "\n".join(lines[head:])
    if m := re.search(r"^\s*--\s*@(\w+)\s*:", body, re.M):
        raise ModelError("invalid_directive", f"@{m[1]} stands behind the query's start")
    found = _statements(body)
    if len(found) > 1:
        raise ModelError("multi_statement", "a model is one statement")
    if not found:
        raise ModelError("missing_directive" if head == 0 else "other", "a model needs a query")
    model = Model(target, found[0], path=path)
    for line in lines[:head]:
        if not (m := re.match(r"\s*--\s*@(\w+)\s*(?::\s*(.*?))?\s*$", line)):
            continue
        name, value = m[1].lower(), (m[2] or "").strip()
        if name in REMOVED:
            raise ModelError(REMOVED[name], f"@{name} is no longer used")
        _directive(model, name, value)
    _check(model)
    return model


def _directive(model: Model, name: str, value: str) -> None:
    if name not in (*SINGLE, *LISTS, *FLAGS):
        raise ModelError("invalid_directive", f"unknown directive @{name}")
    if not value and name not in ("fetch", "push", "expose"):
        raise ModelError("invalid_directive", f"@{name} needs a value")
    if name == "kind":
        if value not in KINDS:
            raise ModelError("invalid_kind", f"unknown kind {value}" + (" (removed)" if value in REMOVED_KINDS else ""))
        model.kind = value
    elif name in ("constraint", "audit", "warning"):
        getattr(model, f"{name}s").extend(_split(value))
    elif name == "extension":
        model.extensions.append(value)
    elif name in ("group_key", "partitioned_by", "sorted_by"):
        getattr(model, name).extend(_split(value))
    elif name == "incremental_initial":
        model.initial = value.strip("'\"")
    elif name == "column":
        m = re.fullmatch(r"(\w+)\s*=\s*(.*)", value)
        if not m:
            raise ModelError("invalid_directive", f"@column: {value}")
        text, *tags = [p.strip() for p in m[2].split("|")]
        model.columns[m[1]], model.tags[m[1]] = text, tags
    elif name == "fetch":
        model.fetch = True
    elif name == "push":
        model.push = value or "default"
    elif name in ("unique_key", "incremental", "description"):
        setattr(model, name, value)


def _check(model: Model) -> None:
    def name(value: str, rule: str) -> None:
        if not NAME.fullmatch(value) or value.lower().startswith(RESERVED):
            raise ModelError(rule, f"not a column name: {value}")

    if model.unique_key:
        if model.kind not in ("merge", "scd2"):
            raise ModelError("invalid_unique_key", f"@unique_key has no meaning for kind {model.kind}")
        name(model.unique_key, "invalid_unique_key")
    for k in model.group_key:
        name(k, "invalid_unique_key")
    if model.incremental:
        name(model.incremental, "invalid_incremental")
    for c in model.sorted_by:
        name(c.split()[0], "invalid_sorted_by")
    for h in model.partitioned_by:
        if not re.fullmatch(r"\w+|(year|month|day|hour)\(\s*\w+\s*\)|bucket\(\s*\d+\s*,\s*\w+\s*\)", h, re.I):
            raise ModelError("invalid_partitioned_by", f"not a partition transform: {h}")


def load_models(folder: str) -> list[Model]:
    """All models under ``folder``/models."""
    out: dict[str, Model] = {}
    for path in sorted(Path(folder, "models").rglob("*.sql")):
        target = target_of(str(path.relative_to(folder)))
        if target in out:
            raise ModelError("duplicate_target", f"{target} has two models")
        out[target] = parse_model(path.read_text(), target, str(path))
    return list(out.values())
