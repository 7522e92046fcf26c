"""Names and keys of columns that operators add."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with underscores put before it until no column has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def spread(key: Column, text: Column | None = None) -> Column:
    """A second join key that deals rows of null ``key``, which match nothing, over all tasks by their ``text``.

    Beside any other key it is 0, on both sides.
    """
    zero = key.bitwiseXOR(key)
    return zero if text is None else F.when(key.isNull(), F.xxhash64(text)).otherwise(zero)
