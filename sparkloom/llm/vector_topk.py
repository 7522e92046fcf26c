"""Exact top-k inner-product search with vector-approximation files.

Vectors are written once with their approximation: every component's cell, a byte, on a grid of
``CELLS`` cells between the extremes of its dimension.  A search first scans the cells of a block of
vectors for upper and lower bounds of all scores, then reads exact vectors in the order of their
upper bounds until the kth exact score is no less than the next bound, so it never misses a result.

Queries and vectors are dealt to tiles, a group of queries against a part of the vectors, each a
task of its own.  A tile's vectors are read as a stream, block by block, and the best of each query
are kept, so a task holds one group of queries and one block, and what is merged is a few more than k
rows for each query and tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .scratch import Scratch

CELLS = 256
BLOCK = 1024
#: Queries of a group, about, and the most vectors of a part, about.
QUERIES, PART = 8192, 1 << 22
#: A part has no fewer vectors than this, about, if that leaves work for all cores.
LEAST_PART = 4096


class Grid:
    """The cells of vectors of one size."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low = low
        self.width = np.maximum((high - low) / CELLS, 1e-9)

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        return np.clip((vectors - self.low) / self.width, 0, CELLS - 1).astype(np.uint8)

    def bounds(self, cells: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) of every score, queries by vectors, with room for rounding."""
        step = queries * self.width
        base = (queries @ self.low)[:, None] + step @ cells.T.astype(np.float64)
        slack = 1e-6 * (1 + np.abs(queries) @ (np.abs(self.low) + CELLS * self.width))[:, None]
        return base + np.minimum(step, 0).sum(1)[:, None] - slack, base + np.maximum(step, 0).sum(1)[:, None] + slack


#: A query's best: vec_ids, scores, and which of them are the query's own row.
Best = tuple[np.ndarray, np.ndarray, np.ndarray]
NONE: Best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))


def search_block(grid: Grid, cells: np.ndarray, ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, best: list[Best], k: int) -> None:
    """Fold a block into best: the k highest scores of each query, ties by vec_id."""
    low, high = grid.bounds(cells, queries)
    for q in range(len(queries)):
        have, scores, own = best[q]
        # k lower bounds that are certain here or before give the least score worth reading
        certain = np.concatenate((scores, low[q]))
        floor = np.partition(certain, len(certain) - k)[len(certain) - k] if len(certain) >= k else -np.inf
        at = np.flatnonzero(high[q] >= floor)
        at = at[np.argsort(-high[q][at], kind="stable")]
        for i in range(0, len(at), 2 * k):
            part = at[i : i + 2 * k]
            if len(have) == k and scores[-1] > high[q][part[0]]:
                break
            twins = ids[part] == query_ids[q]
            if twins.any():
                twins &= (vectors[part] == queries[q]).all(1)
            have, scores, own = np.concatenate((have, ids[part])), np.concatenate((scores, vectors[part] @ queries[q])), np.concatenate((own, twins))
            order = np.lexsort((have, -scores))[:k]
            have, scores, own = have[order], scores[order], own[order]
        best[q] = (have, scores, own)


def _extremes(data: DataFrame) -> dict[int, Grid]:
    """A grid for each size of vectors that there is; what is collected are two numbers a dimension."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for n, _, rows in _by_size(batch.column(0)):
                low, high = rows.min(0), rows.max(0)
                if n in held:
                    low, high = np.minimum(low, held[n][0]), np.maximum(high, held[n][1])
                held[n] = (low, high)
        for n, (low, high) in held.items():
            yield pa.record_batch([pa.array(np.full(n, n)), pa.array(np.arange(n)), pa.array(low), pa.array(high)], ["n", "at", "low", "high"])

    found = data.select("embedding").mapInArrow(scan, "n long, at long, low double, high double")
    rows = found.groupBy("n", "at").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas().sort_values(["n", "at"])
    return {int(n): Grid(x["low"].to_numpy(), x["high"].to_numpy()) for n, x in rows.groupby("n")}


def _by_size(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, rows of the column, their vectors as a matrix) of the vectors of each size."""
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        yield n, at, flat[first[at][:, None] + np.arange(n)]


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k highest inner products of each query among all vectors but its own row.

    Both tables have vec_id (integer) and embedding (array of integers as double, no nulls; scores
    must stay below 2**53); other columns are not read.  Returns query_id long, rank int from 1, vec_id
    long, score long; fewer than k rows where there are fewer vectors; ties go to the smaller vec_id.
    Only vectors of as many components as the query are its candidates; rows of null vec_id, or of a
    null or empty embedding, take no part.  A query's own row is one that has its vec_id and its
    embedding; if there are several, one of them is left out.  Rows that repeat a vec_id count each, as
    queries and as candidates.  An empty table on either side gives an empty table.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    plain = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and size(embedding) > 0")
    grids = spark.sparkContext.broadcast(_extremes(plain(vectors)))

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells: list[bytes] = [b""] * batch.num_rows
            for n, at, rows in _by_size(batch.column(2)):
                for i, c in zip(at.tolist(), grids.value[n].cells(rows)):
                    cells[i] = c.tobytes()
            yield pa.record_batch([*batch.columns, pa.array(cells, pa.binary())], ["row", "vec_id", "embedding", "cells"])

    numbered = lambda df: plain(df).select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding")
    data = scratch.keep(numbered(vectors).mapInArrow(approximate, "row long, vec_id long, embedding array<double>, cells binary"), "approximation")
    asked = scratch.keep(numbered(queries), "queries")

    rows, cores = data.count(), spark.sparkContext.defaultParallelism
    groups = max(1, -(-asked.count() // QUERIES))
    parts = max(1, -(-rows // PART), min(-(-cores // groups), rows // LEAST_PART))
    place = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tile = (F.col("group") * parts + F.col("part")).alias("tile")
    ask = asked.select("*", F.lit(None).cast("binary").alias("cells"), place(groups).alias("group"), every(parts).alias("part"))
    scan = data.select("*", place(parts).alias("part"), every(groups).alias("group"))
    sides = [df.select(tile, F.lit(side).alias("side"), "row", "vec_id", "embedding", "cells") for side, df in enumerate((ask, scan))]
    dealt = sides[0].unionByName(sides[1]).repartitionById(groups * parts, "tile").sortWithinPartitions("tile", "side")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}  # by size: rows, ids, vectors
        best: dict[int, list[Best]] = {}

        def results() -> Iterator[pa.RecordBatch]:
            for n, held in best.items():
                row, ids, _ = asked[n][0]
                for i in range(0, len(ids), BLOCK):
                    some = held[i : i + BLOCK]
                    times = [len(x[0]) for x in some]
                    found, scores, own = (np.concatenate([x[c] for x in some]) for c in range(3))
                    yield pa.record_batch(
                        [pa.array(np.repeat(row[i : i + BLOCK], times)), pa.array(np.repeat(ids[i : i + BLOCK], times)), pa.array(found.astype(np.int64)), pa.array(np.rint(scores).astype(np.int64)), pa.array(own.astype(bool))],
                        ["row", "query_id", "vec_id", "score", "own"],
                    )

        now = None
        for batch in batches:
            tiles, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((tiles[1:] != tiles[:-1]) | (side[1:] != side[:-1])) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if i == j:
                    continue
                if tiles[i] != now:
                    yield from results()
                    now, asked, best = tiles[i], {}, {}
                part = batch.slice(i, j - i)
                row, ids = part.column(2).to_numpy(), part.column(3).to_numpy()
                if side[i] == 0:
                    for n, at, found in _by_size(part.column(4)):
                        asked.setdefault(n, []).append((row[at], ids[at], found))
                    continue
                for n, at, found in _by_size(part.column(4)):
                    if n not in asked:
                        continue
                    if n not in best:
                        asked[n] = [tuple(np.concatenate(x) for x in zip(*asked[n]))]
                        best[n] = [NONE] * len(asked[n][0][1])
                    _, qids, qs = asked[n][0]
                    cells = np.frombuffer(b"".join(part.column(5).take(pa.array(at)).to_pylist()), np.uint8).reshape(-1, n)
                    for a in range(0, len(at), BLOCK):
                        for q in range(0, len(qids), BLOCK):
                            held = best[n][q : q + BLOCK]
                            search_block(grids.value[n], cells[a : a + BLOCK], ids[at[a : a + BLOCK]], found[a : a + BLOCK], qids[q : q + BLOCK], qs[q : q + BLOCK], held, k + 1)
                            best[n][q : q + BLOCK] = held
        yield from results()

    found = dealt.mapInArrow(search, "row long, query_id long, vec_id long, score long, own boolean")
    place_ = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id", F.col("own").desc()))
    first = found.withColumn("place", place_).where(F.col("place") <= k + 1)
    gone = F.min(F.when(F.col("own"), F.col("place"))).over(Window.partitionBy("row"))
    left = first.withColumn("gone", F.coalesce(gone, F.lit(k + 2))).where("place <> gone")
    rank = (F.col("place") - F.when(F.col("place") > F.col("gone"), 1).otherwise(0)).cast("int")
    return left.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
