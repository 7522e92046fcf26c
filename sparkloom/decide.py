"""Whether and how models run, from their hashes and the commit log."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from pathlib import Path

from .functions.macros import normalized_sql
from .lake import CommitLog
from .model import Model

# Run types.
SKIP, BACKFILL, FULL, INCREMENTAL = "skip", "backfill", "full", "incremental"


@dataclass(frozen=True)
class Decision:
    run_type: str
    reason: str


def model_hash(model: Model, config_hash: str = "") -> str:
    """Checks and descriptions do not count."""
    parts = [normalized_sql(model.sql), model.kind, model.unique_key, ",".join(model.group_key), ",".join(model.partitioned_by), model.incremental, model.initial, model.fetch, model.push, config_hash]
    return hashlib.sha256("\x1f".join("" if p is None else str(p) for p in parts).encode()).hexdigest()


def config_hash(folder: str) -> str:
    """Of all SQL files under ``folder``/config, in order."""
    h = hashlib.sha256()
    for p in sorted(Path(folder, "config").rglob("*.sql")):
        h.update(str(p.relative_to(folder)).encode() + b"\0" + p.read_bytes())
    return h.hexdigest()


def decide(model: Model, hash_: str, log: CommitLog, version: int | None = None) -> Decision:
    last = log.latest(model.target, version)
    if last is None or not last.info.get("sql_hash"):
        return Decision(BACKFILL, "first run")
    if last.info["sql_hash"] != hash_:
        return Decision(BACKFILL, "sql changed")
    if model.kind != "table":
        return Decision(INCREMENTAL, "incremental run")
    if model.fetch:
        return Decision(FULL, "fetch source")
    depends = last.info.get("depends")
    if depends is None:
        return Decision(FULL, "missing depends metadata")
    if not isinstance(depends, list):
        return Decision(FULL, "invalid depends metadata")
    if not depends:
        return Decision(SKIP, "no dependencies")
    changed, unknown = [], []
    for d in depends:
        seen = [i for i in log.ids() if (version is None or i <= version) and any(t.lower() == d.lower() for t in log.get(i).tables)]
        if not seen:
            unknown.append(d)
        elif seen[-1] > last.id:
            changed.append(d)
    if unknown:
        return Decision(FULL, f"unverifiable dep: {min(unknown)}")
    if changed:
        return Decision(FULL, f"dep changed: {min(changed)}")
    return Decision(SKIP, "deps unchanged")


def decide_all(models: list[Model], log: CommitLog, config: str = "") -> dict[str, Decision]:
    return {m.target: decide(m, model_hash(m, config), log) for m in models}
