"""A versioned table store on immutable Parquet files and JSON commits."""

from .commit_log import Commit, CommitLog, Conflict
from .table import Lake

__all__ = ["Commit", "CommitLog", "Conflict", "Lake"]
