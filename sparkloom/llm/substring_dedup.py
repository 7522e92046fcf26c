"""Substring dedup by content-defined chunking with a gear rolling hash.

A gear hash over the last 32 bytes chooses where chunks end, so an insertion moves boundaries only
near it and a passage is cut alike wherever it stands.  Chunks are compared by a digest of 128 bits over
the whole corpus.  Of equal chunks the first, by doc_id and position, stays.  Others are removed where a run of
them is at least ``least_words`` words long, so that phrases which merely recur are left alone, or is
the whole text, so that short copies go too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .columns import spread
from .scratch import Scratch
from .wordhash import BLOCK, hash_spans, mix64, slices, text_buffers, word_bounds

REACH = 32
LEAST, MOST = 16, 96
#: A boundary at one byte in 2**BITS, on average.
BITS = 5
LEAST_WORDS = 15
#: Values of bytes in the second half of a digest.
_SECOND = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) >> np.uint64(32)).astype(np.uint32)


def gear(raw: np.ndarray) -> np.ndarray:
    """At each byte the sum of the last REACH bytes' values, each shifted by its distance, modulo 2**32."""
    h = _GEAR[raw]
    step = 1
    while step < REACH:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return h


def chunk_ends(raw: np.ndarray) -> np.ndarray:
    """Ends of the chunks of one text; no chunk ends within a UTF-8 character.

    Where no boundary comes within MOST bytes, the last one of a weaker kind (four times as frequent)
    is taken, which is as independent of the chunk's start; a plain cut is left for texts without either.
    """
    n, last = len(raw), 0
    if not n:
        return np.zeros(0, np.int64)
    inner = (raw[1:] & 0xC0) != 0x80  # byte i + 1 starts a character
    high = gear(raw)[:-1] >> np.uint32(32 - BITS)
    weak = np.flatnonzero((high < 4) & inner) + 1
    weak = weak[np.searchsorted(weak, REACH) :]
    strong = weak[high[weak - 1] == 0].tolist()
    out: list[int] = []
    for mark in [*strong, n]:
        while mark - last > MOST:
            i = int(np.searchsorted(weak, last + MOST, side="right")) - 1
            cut = int(weak[i]) if i >= 0 and weak[i] - last >= LEAST else last + MOST
            while raw[cut] & 0xC0 == 0x80:
                cut -= 1
            out.append(last := cut)
        if mark - last >= LEAST or mark == n > last:
            out.append(last := mark)
    return np.array(out, dtype=np.int64)


def _chunked(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, chunk ends) of each text."""
    raw, offsets = text_buffers(column)
    for a, b in zip(offsets[:-1], offsets[1:]):
        yield raw[a:b], chunk_ends(raw[a:b])


def _digests(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each chunk."""
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    return hash_spans(raw, starts, ends, lower=False).view(np.int64), hash_spans(raw, starts, ends, lower=False, values=_SECOND).view(np.int64)


def _all_chunks(texts: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, BLOCK):
            digests = [_digests(raw, ends) if len(ends) else (np.zeros(0, np.int64),) * 2 for raw, ends in _chunked(batch.column(1))]
            sizes = np.array([len(d) for d, _ in digests], dtype=np.int64)
            first = np.repeat(np.cumsum(sizes) - sizes, sizes)
            halves = [pa.array(np.concatenate([d[i] for d in digests])) for i in (0, 1)]
            yield pa.record_batch(
                [*halves, pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes)), pa.array((np.arange(len(first)) - first).astype(np.int32))],
                ["digest", "check", "doc_id", "pos"],
            )

    return texts.mapInArrow(cut, "digest long, check long, doc_id long, pos int")


def dedup_substrings(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, text without repeated passages, n_chunks, n_repeated, n_recurring, spans.

    Needs doc_id (integer) and text; other columns are not read.  n_recurring counts the chunks that
    stand earlier in the corpus and n_repeated those of them that were removed; spans (array of (start,
    end), code points of the old text, end exclusive) are what was removed.  Null and empty texts come
    back as they are.  Rows of null doc_id keep their text and repeat nothing.  Rows that share a doc_id
    share what is removed by position.  Texts are cut whole, however long.  An empty table gives an
    empty table.  Chunks are known by a digest of 128 bits.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = _all_chunks(texts.where("doc_id is not null"))
    first = chunks.groupBy("digest", "check").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("first")).where("n > 1")
    first = scratch.keep(first.select("digest", "check", F.col("first.doc_id").alias("first_doc"), F.col("first.pos").alias("first_pos")), "first")
    again = chunks.join(first, ["digest", "check"]).where("doc_id <> first_doc or pos <> first_pos")
    drops = again.groupBy("doc_id").agg(F.collect_set("pos").alias("drops")).withColumn("salt", spread(F.col("doc_id")))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, BLOCK):
            old, dropped = batch.column(1), batch.column(2).to_pylist()
            rows = []
            for i, (raw, ends) in enumerate(_chunked(old)):
                text, spans, removed = None, [], 0
                if dropped[i]:
                    spans, removed = _removals(raw, ends, np.array(sorted(dropped[i])), least_words)
                if spans:
                    kept = np.ones(len(raw), dtype=bool)
                    for a, b in spans:
                        kept[a:b] = False
                    text = raw[kept].tobytes().decode("utf-8")
                    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                    spans = [{"start": int(points[a]), "end": int(points[b])} for a, b in spans]
                rows.append((old[i].as_py() if text is None else text, len(ends), removed, len(dropped[i] or ()), spans))
            cols = list(zip(*rows)) if rows else [()] * 5
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.record_batch(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.int32(), span)))], ["doc_id", "text", "n_chunks", "n_repeated", "n_recurring", "spans"]
            )

    dealt = texts.withColumn("salt", spread(F.col("doc_id"), F.col("text"))).join(drops, ["doc_id", "salt"], "left")
    return dealt.select("doc_id", "text", "drops").mapInArrow(rebuild, "doc_id long, text string, n_chunks int, n_repeated int, n_recurring int, spans array<struct<start:int,end:int>>")


def _removals(raw: np.ndarray, ends: np.ndarray, repeated: np.ndarray, least_words: int) -> tuple[list[tuple[int, int]], int]:
    """Byte spans of the runs of repeated chunks that have enough words or are the whole text, and their chunks' number."""
    repeated = repeated[repeated < len(ends)]
    starts, _ = word_bounds(raw, np.array([0, len(raw)]))
    out, chunks = [], 0
    for run in np.split(repeated, np.flatnonzero(np.diff(repeated) > 1) + 1):
        if not len(run):
            continue
        a, b = int(ends[run[0] - 1]) if run[0] else 0, int(ends[run[-1]])
        if len(run) == len(ends) or np.searchsorted(starts, b) - np.searchsorted(starts, a) >= least_words:
            out.append((a, b))
            chunks += len(run)
    return out, chunks
