"""Engine queries over the test tables, and their SQL."""

from importlib import import_module

MODULES = ("check_queries", "kind_queries", "relational_queries", "pipeline_queries", "lake_queries")
QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = import_module(f"{__name__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
