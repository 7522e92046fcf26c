"""Masking functions, applied to columns by tag."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

PREFIXES = ("mask", "hash", "redact")
MASKS: dict[str, Callable[[Column], Column]] = {}


def mask(name: str):
    def keep(fn):
        MASKS[name] = fn
        return fn

    return keep


@mask("mask_email")
def mask_email(c: Column) -> Column:
    """The first character, then *** up to the last @; text without one is left."""
    return F.regexp_replace(c.cast("string"), "(.).*@", "$1***@")


@mask("mask_ssn")
def mask_ssn(c: Column) -> Column:
    return F.concat(F.lit("***-**-"), F.right(c.cast("string"), F.lit(4)))


@mask("hash_pii")
def hash_pii(c: Column) -> Column:
    return F.sha2(c.cast("string"), 256)


@mask("redact")
def redact(c: Column) -> Column:
    return F.lit("[REDACTED]")


def masking_tag(tags: list[str]) -> str | None:
    """The first tag that is a mask, or begins with the prefix of one."""
    return next((t for t in tags if any(t == p or t.startswith(f"{p}_") for p in PREFIXES)), None)


def apply_masks(df: DataFrame, tags: dict[str, list[str]], keys: list[str] = ()) -> DataFrame:
    """Columns with a masking tag go through that mask; key columns never do."""
    chosen = {c: masking_tag(t) for c, t in sorted(tags.items()) if c not in keys and c in df.columns}
    unknown = [t for t in chosen.values() if t and t not in MASKS]
    if unknown:
        raise ValueError(f"unknown mask: {unknown[0]}")
    return df.withColumns({c: MASKS[t](F.col(f"`{c}`")) for c, t in chosen.items() if t})
