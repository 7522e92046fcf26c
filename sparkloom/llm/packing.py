"""Hierarchical multi-length packing of tokenised documents.

Documents are routed by length to context-size tiers (2048, 1024, ...).  What is longer than the
longest window is cut into full windows and a rest.  Each tier is packed by best fit; gaps of long
windows are filled from the shorter tiers, the last bit of a gap by cutting a document.  Windows of
different tiers are dealt to step groups so that every group has about the same tokens.

Packing happens where the documents are: a task packs its partition in a stream, in groups of
``GROUP`` tokens, and hands what does not fill a window on to the next group.  Nothing is shuffled,
memory is bounded by one group and one document, and a lost task is simply run again.  At the end of
a partition the rest goes into windows of the smaller powers of two, so no sequence is padded.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .bytebpe import encoder
from .wordhash import BLOCK, slices

WINDOW = 2048
TIERS = (2048, 1024, 512, 256)
GROUP = 256 * WINDOW
STEP = 32 * WINDOW
#: A piece: document's row in the group's store, first token, length.
Piece = tuple[int, int, int]


class Pool:
    """Pieces by length; takes the longest that fits, or cuts the shortest one."""

    def __init__(self) -> None:
        self.pieces: list[tuple[int, int, int]] = []  # (length, doc, start), ascending

    def add(self, piece: Piece) -> None:
        insort(self.pieces, (piece[2], piece[0], piece[1]))

    def __len__(self) -> int:
        return len(self.pieces)

    def fitting(self, room: int) -> Piece | None:
        i = bisect_right(self.pieces, (room, np.inf, 0))
        if not i:
            return None
        length, doc, start = self.pieces.pop(i - 1)
        return doc, start, length

    def cut(self, room: int) -> Piece:
        length, doc, start = self.pieces.pop(0)
        insort(self.pieces, (length - room, doc, start + room))
        return doc, start, room


def pack_group(pieces: list[Piece], last: bool) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """((window, its pieces) of full windows, pieces left over); ``last`` leaves nothing over."""
    full: list[tuple[int, list[Piece]]] = []
    tiers = {t: Pool() for t in TIERS}
    for doc, start, length in pieces:
        while length >= WINDOW:
            full.append((WINDOW, [(doc, start, WINDOW)]))
            start, length = start + WINDOW, length - WINDOW
        if length:
            tiers[min(t for t in TIERS if t >= length)].add((doc, start, length))
    for k, tier in enumerate(TIERS):
        below = [tiers[t] for t in TIERS[k:]]
        while len(tiers[tier]):
            window, room = [], tier
            for pool in below:  # whole pieces, longer tiers first
                while room and (piece := pool.fitting(room)):
                    window.append(piece)
                    room -= piece[2]
            while room and (pool := next((p for p in reversed(below) if len(p)), None)):
                piece = pool.cut(room) if pool.pieces[0][0] > room else pool.fitting(pool.pieces[0][0])
                window.append(piece)
                room -= piece[2]
            if room:  # nothing is left to fill this one
                for piece in window:
                    tiers[TIERS[-1]].add(piece)
                break
            full.append((tier, window))
        if k + 1 < len(TIERS):
            for length, doc, start in tiers[tier].pieces:
                tiers[TIERS[k + 1]].add((doc, start, length))
            tiers[tier].pieces = []
    rest = [(doc, start, length) for length, doc, start in tiers[TIERS[-1]].pieces]
    if last:
        total = sum(p[2] for p in rest)
        queue = deque(rest)
        for size in (1 << b for b in range(total.bit_length() - 1, -1, -1)):
            if not total & size:
                continue
            window, room = [], size
            while room:
                doc, start, length = queue.popleft()
                if length > room:
                    queue.appendleft((doc, start + room, length - room))
                    length = room
                window.append((doc, start, length))
                room -= length
            full.append((size, window))
        rest = []
    return full, rest


def step_groups(sizes: list[int]) -> list[int]:
    """A step group for each window: longest first, each to the group with the fewest tokens."""
    import heapq

    n = max(1, round(sum(sizes) / STEP))
    heap = [(0, g) for g in range(n)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        tokens, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (tokens + sizes[i], g))
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Pack all rows of ``docs`` into sequences of at most 2048 tokens.

    Needs doc_id (integer) and text; other columns are not read.  A document's tokens are the ids of
    ``tokenizer`` (a ``tokenizers`` file, the same path on every machine) and then ``end_id``; a null
    or empty text has ``end_id`` alone.  Returns one row per piece: doc_id, start, length, doc_tokens,
    ids (binary, little-endian uint32), sequence_id, offset, window (the sequence's length, a power
    of two) and step_group.  Every id lies in exactly one piece and all sequences are full.  Rows
    with equal or null doc_id are packed each on its own.  An empty table gives an empty table.
    """
    names = ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset", "window", "step_group"]
    types = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, base = encoder(tokenizer), TaskContext.get().partitionId() << 32
        store: dict[int, tuple[int | None, np.ndarray]] = {}
        pieces: list[Piece] = []
        held = made = steps = row = 0

        def close(last: bool) -> pa.RecordBatch:
            nonlocal pieces, held, made, steps, store
            full, pieces = pack_group(pieces, last)
            groups = step_groups([w for w, _ in full])
            rows = []
            for (window, parts), group in zip(full, groups):
                offset = 0
                for doc, start, length in parts:
                    doc_id, ids = store[doc]
                    rows.append((doc_id, start, length, len(ids), ids[start : start + length].tobytes(), base + made, offset, window, base + steps + group))
                    offset += length
                made += 1
            steps += max(groups, default=-1) + 1
            store = {doc: store[doc] for doc, _, _ in pieces}
            held = sum(p[2] for p in pieces)
            cols = list(zip(*rows)) if rows else [()] * len(names)
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names)

        for batch in slices(batches, 1, BLOCK):
            for doc_id, ids in zip(batch.column(0).to_pylist(), bpe.encode(batch.column(1).to_pylist())):
                ids = np.append(ids, np.array([end_id], dtype="<u4"))
                store[row] = (doc_id, ids)
                pieces.append((row, 0, len(ids)))
                row, held = row + 1, held + len(ids)
                if held >= GROUP:
                    yield close(False)
        yield close(True)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names)
    return texts.mapInArrow(run, kinds)
