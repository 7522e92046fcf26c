"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps what was measured and one bit for each
rule that failed; policies are versioned masks over those bits, so another policy, or the effect of
leaving a rule out, is a bitwise aggregation over the ledger and reads no text again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .wordhash import BLOCK, hash_spans, mix64, slices, text_buffers, windows, word_bounds

_U = np.uint64
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
WINDOW = 8

#: Rule by bit: its name and when it fails, in integers only.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeats", "100 * n_repeat_words > 30 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("symbols", "2 * n_symbols > n_words"),
    ("dup_lines", "2 * n_dup_lines > n_lines"),
)
#: Policies by version: the names of the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeats"),
    "v1": tuple(name for name, _ in RULES),
}
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def mask(policy: str) -> int:
    return sum(1 << i for i, (name, _) in enumerate(RULES) if name in POLICIES[policy])


def _repeated(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """By text: how many words lie in windows of WINDOW words found twice or more in it."""
    found = windows(words, WINDOW)
    if not len(found):
        return np.zeros(len(first) - 1, np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = doc[: len(found)] == doc[WINDOW - 1 :]
    at = np.flatnonzero(inside)
    keys = mix64(found[at] + doc[at].astype(_U) * _U(0x9E3779B97F4A7C15))
    _, which, many = np.unique(keys, return_inverse=True, return_counts=True)
    at = at[many[which] > 1]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    total = np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))
    return total[first[1:]] - total[first[:-1]]


def measure(col: pa.Array) -> dict[str, np.ndarray]:
    """MEASURES of each text."""
    raw, offsets = text_buffers(col)
    starts, ends = word_bounds(raw, offsets)
    first = np.searchsorted(starts, offsets, side="left")
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    chars = np.concatenate(([0], np.cumsum(points[ends] - points[starts])))
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[raw])))

    # a line ends at a line feed or with its text; only lines with a word count
    breaks = np.flatnonzero(raw == 10)
    line_from = np.sort(np.concatenate((breaks + 1, offsets[:-1])), kind="stable")
    line_to = np.sort(np.concatenate((breaks, offsets[1:])), kind="stable")
    worded = np.searchsorted(starts, line_to, side="left") > np.searchsorted(starts, line_from, side="left")
    line_from, line_to = line_from[worded], line_to[worded]
    line_doc = np.searchsorted(offsets, line_from, side="right") - 1
    lines = mix64(hash_spans(raw, line_from, line_to, lower=False) + line_doc.astype(_U) * _U(0x9E3779B97F4A7C15))
    _, seen = np.unique(lines, return_index=True)
    n = len(offsets) - 1
    n_lines = np.bincount(line_doc, minlength=n)
    return {
        "n_words": np.diff(first).astype(np.int64),
        "word_chars": chars[first[1:]] - chars[first[:-1]],
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_lines": n_lines.astype(np.int64),
        "n_dup_lines": (n_lines - np.bincount(line_doc[seen], minlength=n)).astype(np.int64),
        "n_repeat_words": _repeated(hash_spans(raw, starts, ends, lower=False), first).astype(np.int64),
    }


def failed_bits(entry: str) -> Column:
    """One bit for each rule that fails on the measures in the struct ``entry``."""
    fails = [re.sub(r"\b[a-z_]+\b", lambda m: f"`{entry}`.{m[0]}", condition) for _, condition in RULES]
    return reduce(Column.bitwiseOR, [F.when(F.expr(c), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(fails)])


def annotate(docs: DataFrame, into: str) -> DataFrame:
    """``docs`` with one more column ``into``: a struct of the MEASURES (long) and ``failed`` (long).

    Needs text only.  ``failed`` has bit i for RULES[i].  Null and empty texts measure 0 everywhere,
    so they fail ``few_words`` only.  All columns come through, whatever their names; one named
    ``into`` is replaced.  Repeated rows give repeated results, an empty table an empty one.
    """
    held = docs.drop(into)
    names, column = held.columns, held.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, 2 * BLOCK):
            found = measure(batch.column(column))
            struct = pa.StructArray.from_arrays([pa.array(found[m], pa.int64()) for m in MEASURES], list(MEASURES))
            yield pa.record_batch([*batch.columns, struct], [*names, into])

    kind = StructType([StructField(m, LongType()) for m in MEASURES])
    out = held.mapInArrow(scan, StructType([*held.schema.fields, StructField(into, kind)]))
    return out.withColumn(into, F.struct(*[F.col(f"`{into}`.{m}").alias(m) for m in MEASURES], failed_bits(into).alias("failed")))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the MEASURES and ``failed`` of every row of ``docs`` (doc_id integer, text), as in ``annotate``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return annotate(texts, "entry").select("doc_id", "entry.*")


def passes(policy: str, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask(policy))) == 0


def ablation(entries: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: rule, rejected (fails it) and only_by_it (kept if it were left out)."""
    names = [(i, name) for i, (name, _) in enumerate(RULES) if name in POLICIES[policy]]
    hit = F.col("failed").bitwiseAND(F.lit(mask(policy)))
    sums = entries.agg(
        *[F.count_if(hit.bitwiseAND(F.lit(1 << i)) != 0).alias(f"r{i}") for i, _ in names], *[F.count_if(hit == (1 << i)).alias(f"o{i}") for i, _ in names]
    )
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("rejected"), F.col(f"o{i}").alias("only_by_it")) for i, n in names])
    return sums.select(F.inline(rows))
