"""A project's folder: environment, variables and the places of its parts."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from pathlib import Path

from .variables import parse_settings


def load_env(path: Path) -> dict[str, str]:
    out: dict[str, str] = {}
    if path.exists():
        for line in path.read_text().splitlines():
            m = re.fullmatch(r"\s*(?:export\s+)?(\w+)\s*=\s*(.*?)\s*", line)
            if m and not line.lstrip().startswith("#"):
                out[m[1]] = m[2].strip("'\"")
    return out


def expand(text: str, env: dict[str, str]) -> str:
    """${NAME} and $NAME; unknown ones are empty."""
    return re.sub(r"\$\{(\w+)\}|\$(\w+)", lambda m: env.get(m[1] or m[2], os.environ.get(m[1] or m[2], "")), text)


@dataclass
class Project:
    folder: str
    env: dict[str, str] = field(default_factory=dict)
    variables: dict[str, object] = field(default_factory=dict)
    macros: list[str] = field(default_factory=list)

    @property
    def macro_prefix(self) -> str:
        return self.env.get("MACRO_PREFIX", "")

    @property
    def lake_path(self) -> str:
        named = self.env.get("LAKE_PATH")
        return expand(named, self.env) if named else f"file://{Path(self.folder).resolve()}/lake"

    @property
    def state_path(self) -> str:
        return str(Path(self.folder, "state.db"))


def find_project(start: str = ".") -> Project:
    """The nearest folder upwards that has ``models``."""
    at = Path(start).resolve()
    for folder in (at, *at.parents):
        if (folder / "models").is_dir():
            env = load_env(folder / ".env")
            variables: dict[str, object] = {}
            for name in ("constants", "global"):
                for p in sorted((folder / "config" / "variables").glob(f"{name}*.sql")):
                    variables |= parse_settings(expand(p.read_text(), env))
            macros = [expand(p.read_text(), env) for p in sorted((folder / "config" / "macros").rglob("*.sql"))]
            return Project(str(folder), env, variables, macros)
    raise FileNotFoundError("no project: no models folder here or above")
