"""The graph of models."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from .model import Model
from .plans.refs import dependencies


class CycleError(ValueError):
    pass


@dataclass
class Graph:
    models: dict[str, Model]
    depends: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def of(cls, spark: SparkSession, models: list[Model]) -> Graph:
        out = cls({m.target: m for m in models})
        out.depends = {m.target: dependencies(spark, m.sql) for m in models}
        return out

    def order(self) -> list[str]:
        """Dependencies first, ties by name."""
        done, path, out = set(), set(), []

        def visit(t: str) -> None:
            if t in done or t not in self.models:
                return
            if t in path:
                raise CycleError(f"circular dependency detected: {t}")
            path.add(t)
            for d in sorted(self.depends.get(t, ())):
                visit(d)
            path.discard(t)
            done.add(t)
            out.append(t)

        for t in sorted(self.models):
            visit(t)
        return out

    def downstream(self, target: str, direct: bool = False) -> set[str]:
        first = {m for m, d in self.depends.items() if target in d}
        if direct:
            return first
        out = set(first)
        for m in first:
            out |= self.downstream(m)
        return out

    def external(self) -> dict[str, list[str]]:
        """Tables that models read and no model makes."""
        return {m: sorted(set(d) - set(self.models)) for m, d in self.depends.items() if set(d) - set(self.models)}
