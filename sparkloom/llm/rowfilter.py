"""A filter of hashed row ids whose size is fixed."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: The map has 2**BITS bits, 2 MB, whatever the input's size.
BITS = 24


class RowFilter:
    """Lets every id of ``rows`` (one long column of hashes, no nulls) through, and others by chance.

    One bit an id in a map of fixed size is broadcast, so what it lets through needs an exact join or
    may be too much; with very many ids it keeps back little, which costs work but no result.
    """

    def __init__(self, rows: DataFrame):
        place = F.col(rows.columns[0]).bitwiseAND(F.lit((1 << BITS) - 1))
        bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
        words = rows.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
        table = np.zeros(1 << (BITS - 6), dtype=np.int64)
        table[words.column("at").to_numpy()] = words.column("bits").to_numpy()
        self.shared = rows.sparkSession.sparkContext.broadcast(table)

    def test(self) -> Callable[[np.ndarray], np.ndarray]:
        """A function of an int64 array, for executors."""
        shared, mask = self.shared, (1 << BITS) - 1

        def passes(ids: np.ndarray) -> np.ndarray:
            place = ids & mask
            return (shared.value[place >> 6] >> (place & 63)) & 1 == 1

        return passes

    def column(self, ids: Column) -> Column:
        """The same as a boolean column; only the ids go to Python."""
        passes = self.test()

        @F.pandas_udf("boolean")
        def may_pass(values: pd.Series) -> pd.Series:
            return pd.Series(passes(values.to_numpy(dtype=np.int64)))

        return may_pass(ids)
