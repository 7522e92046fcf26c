"""Language identification by string kernels.

The kernel of two texts is the cosine of their blended-spectrum presence vectors: which character
n-grams of orders 1 to 3 occur at all, hashed to ``DIMENSIONS`` places.  Kernel ridge regression, one
language against the rest, is fitted on Nystroem features of landmark texts.  A landmark model is
linear in the presence vector, so its weights are folded into one matrix of DIMENSIONS by languages
and whole batches of texts are scored by one matrix product.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .wordhash import BLOCK, slices

DIMENSIONS = 1 << 15
ORDERS = (1, 2, 3)
#: Bounds of what is fitted on: texts per language and in all, landmarks per language and in all.
PER_LANGUAGE, SAMPLE = 400, 4096
LANDMARKS, MARKS = 64, 1024
#: The rows of a language are ranked in so many shares before they meet.
SHARES = 64
RIDGE = 1e-2
BATCH = 64


def _letters(start: int, stop: int) -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(start, stop)])


_LETTER = _letters(0, 0x10000)


@cache
def _every_letter() -> np.ndarray:
    """Over all code points; made where a text needs it."""
    return np.concatenate((_LETTER, _letters(0x10000, 0x110000)))


def presence(text: str | None) -> np.ndarray | None:
    """Places of the text's n-grams, or None if it has no letter.  Runs of other characters are one space."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = (_LETTER if codes.max() < 0x10000 else _every_letter())[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32).astype(np.uint32)
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    codes = np.concatenate(([32], codes[keep], [32])).astype(np.uint32)
    flags = np.zeros(DIMENSIONS, dtype=bool)
    acc = np.zeros(len(codes), dtype=np.uint32)
    for order in range(1, max(ORDERS) + 1):
        acc = acc[: len(codes) - order + 1] * np.uint32(0x01000193) + codes[order - 1 :] * np.uint32(0x9E3779B1) + np.uint32(order)
        if order in ORDERS:
            flags[((acc ^ (acc >> np.uint32(13))) * np.uint32(0x85EBCA6B)) >> np.uint32(17)] = True
    return flags


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # DIMENSIONS x languages, float32

    def score(self, flags: np.ndarray) -> np.ndarray:
        """One row of scores per text of a batch of presence vectors."""
        x = flags.astype(np.float32)
        return (x @ self.weights) / np.sqrt(x.sum(1, keepdims=True))


def fit(flags: np.ndarray, languages: list[str], landmarks: int = LANDMARKS) -> Model:
    """Nystroem kernel ridge regression; the first texts of each language, up to ``landmarks``, are landmarks."""
    names, labels = np.unique(np.array(languages, dtype=object), return_inverse=True)
    names = names.tolist()
    x = flags.astype(np.float32)
    x /= np.sqrt(x.sum(1, keepdims=True))
    each = max(1, min(landmarks, MARKS // len(names)))
    marks = x[np.concatenate([np.flatnonzero(labels == i)[:each] for i in range(len(names))])[:MARKS]]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    features = (x @ marks.T) @ root
    targets = np.where(labels[:, None] == np.arange(len(names)), 1.0, -1.0)
    balance = (1.0 / np.bincount(labels))[labels][:, None]
    w = np.linalg.solve(features.T @ (features * balance) + RIDGE * np.eye(features.shape[1]), features.T @ (targets * balance))
    return Model(names, (marks.T @ (root @ w)).astype(np.float32))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray | None]]]:
    for batch in slices(batches, 1, BLOCK):
        for i in range(0, batch.num_rows, BATCH):
            part = batch.slice(i, BATCH)
            yield part, [presence(t) for t in part.column(1).to_pylist()]


def train(labelled: DataFrame) -> Model | None:
    """Fit on (doc_id, text, lang): the PER_LANGUAGE rows of least hash of each language, SAMPLE in all.

    The sample's bounds are the module's parameters; it does not grow with the table.  Every language
    gets its first row before any gets a second, so all are learned, however many there are, up to
    SAMPLE.  Rows of null lang are left out, and rows that repeat both doc_id and text count once.
    None if no row has a letter.
    """
    known = labelled.where("lang is not null").withColumn("row", F.xxhash64("doc_id", "text"))
    found = known.select("lang", "row", F.pmod("row", F.lit(SHARES)).alias("share")).distinct()
    for by in (["lang", "share"], ["lang"]):
        found = found.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("row"))).where(F.col("r") <= PER_LANGUAGE)
    chosen = found.orderBy("r", "lang").limit(SAMPLE).select("lang", "row")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _batches(batches):
            bits = [None if f is None else np.packbits(f).tobytes() for f in found]
            yield pa.record_batch([part.column(0), part.column(2), pa.array(bits, pa.binary())], ["row", "lang", "bits"])

    # the sample's size is bounded by SAMPLE
    rows = known.join(F.broadcast(chosen), ["lang", "row"]).select("row", "text", "lang").mapInArrow(look, "row long, lang string, bits binary").where("bits is not null")
    rows = sorted(rows.dropDuplicates(["lang", "row"]).collect(), key=lambda r: (r.lang, r.row))
    if not rows:
        return None
    return fit(np.stack([np.unpackbits(np.frombuffer(r.bits, np.uint8)) for r in rows]).astype(bool), [r.lang for r in rows])


def identify(docs: DataFrame, training: Column) -> DataFrame:
    """Predict the language of every row of ``docs``, learning from the rows where ``training`` holds.

    Needs doc_id (integer), text and lang.  Returns doc_id, lang_pred (a learned language; ``und`` where
    the text is null or has no letter, or nothing could be learned) and score (0 to 1, the winner's
    share; 0 for ``und``), one row per row: repeated rows and rows of null doc_id get answers like all
    others.  Predictions read the whole text alone, so equal texts get equal answers; ties go to the
    first language by name.  Other columns are not read.  An empty table gives an empty table.
    """
    labelled = docs.where(training).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = train(labelled)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part, found in _batches(batches):
            langs, scores = ["und"] * len(found), [0.0] * len(found)
            at = [i for i, f in enumerate(found) if f is not None]
            if at and model is not None:
                raw = model.score(np.stack([found[i] for i in at]))
                share = np.exp(4 * (raw - raw.max(1, keepdims=True)).astype(np.float64))
                share /= share.sum(1, keepdims=True)
                for i, best, p in zip(at, raw.argmax(1), share):
                    langs[i], scores[i] = model.languages[best], float(p[best])
            yield pa.record_batch([part.column(0), pa.array(langs), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(predict, "doc_id long, lang_pred string, score double")
