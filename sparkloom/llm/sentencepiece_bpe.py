"""SentencePiece models on the ``tokenizers`` library.

The model file is a protocol buffer; its wire format is read here, without a schema compiler.  From it
come the normaliser (its compiled character map, white-space rules and dummy prefix), the marker for
spaces, the pieces with their scores, and byte fallback.  Unigram models keep their scores; for BPE
models the merges are rebuilt from the pieces: every split of a piece into two pieces is a merge, in
the order of the scores.  Batches are encoded by the library's own threads, and every batch can be
held against SentencePiece itself.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .wordhash import BLOCK, slices

SPACE = "▁"
THREADS = 2
#: Words whose ids a worker keeps, and the longest of them.
CACHE, LONGEST = 1 << 19, 48
#: What is checked of an encoding.
PARITY, ROUND_TRIP = 1, 2
TOGETHER = 500
#: Fixed by the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields; length-delimited values are bytes, fixed ones as well."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + n]
            at += n


@dataclass
class Spec:
    """What of a model file decides how texts are encoded."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    unknown: int = 0
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix: bool = False


def read_model(path: str) -> Spec:
    with open(path, "rb") as f:
        data = f.read()
    spec = Spec()
    for number, value in fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            spec.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in fields(value):
                if n == 3:
                    spec.kind = v
                elif n == 24:
                    spec.suffix = bool(v)
                elif n == 35:
                    spec.byte_fallback = bool(v)
        elif number == 3:
            for n, v in fields(value):
                if n == 2:
                    spec.charsmap = v
                elif n == 3:
                    spec.dummy_prefix = bool(v)
                elif n == 4:
                    spec.squeeze = bool(v)
                elif n == 5:
                    spec.escape = bool(v)
    spec.unknown = next((i for i, p in enumerate(spec.pieces) if p[2] == UNKNOWN), 0)
    return spec


def merges_of(spec: Spec) -> list[tuple[str, str]]:
    """Every split of a piece into two pieces, best piece first, then by the parts' places."""
    place = {p: i for i, (p, _, kind) in enumerate(spec.pieces) if kind in (NORMAL, USER)}
    found = []
    for piece, i in place.items():
        for cut in range(1, len(piece)):
            a, b = place.get(piece[:cut]), place.get(piece[cut:])
            if a is not None and b is not None:
                found.append((-spec.pieces[i][1], i, a, b))
    return [(spec.pieces[a][0], spec.pieces[b][0]) for _, _, a, b in sorted(found)]


def build(spec: Spec):
    """A ``tokenizers.Tokenizer`` that encodes and decodes as the model does."""
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if spec.suffix or not spec.escape:
        raise ValueError("models with white space as a suffix, or left as it is, are not supported")
    if spec.kind == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in spec.pieces], unk_id=spec.unknown, byte_fallback=spec.byte_fallback)
    elif spec.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
        unk = spec.pieces[spec.unknown][0]
        model = models.BPE(vocab, merges_of(spec), unk_token=unk, fuse_unk=True, byte_fallback=spec.byte_fallback)
    else:
        raise ValueError(f"model kind {spec.kind} is not supported")
    out = Tokenizer(model)
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.squeeze:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    # a text that is empty by now stays empty: the prefix goes before a first character only
    if spec.dummy_prefix:
        steps.append(normalizers.Replace(Regex(r"\A(?=[\s\S])"), " "))
    steps.append(normalizers.Replace(" ", SPACE))
    out.normalizer = normalizers.Sequence(steps)
    # no piece holds a marker after another character, so no token crosses such a place
    if not any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _, kind in spec.pieces if kind in (NORMAL, USER)):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"), "isolated")
    tail = [decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return out


class SentencePieceCodec:
    """Encodes and decodes batches, and holds the ids against SentencePiece's own.

    No token crosses the start of a word where the model has no piece with a marker inside.  Plain
    texts (single spaces, none at the ends) are then encoded, and compared, by distinct word, which
    comes to the same as doing it text by text; all other texts are taken whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.spec = read_model(path)
        self.tokenizer = build(self.spec)
        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.by_word = self.tokenizer.pre_tokenizer is not None and not self.spec.charsmap and not self.spec.squeeze and self.spec.dummy_prefix
        self.starts = np.array([p.startswith(SPACE) for p, _, _ in self.spec.pieces])
        self.words: dict[str, bytes] = {}
        self.wrong: dict[str, int] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        """The rebuilt tokenizer's ids, by its own threads."""
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _checks(self, texts: list[str], ids: list[np.ndarray], verify: bool) -> list[int]:
        """PARITY with SentencePiece and ROUND_TRIP of each text."""
        if not verify:
            return [PARITY | ROUND_TRIP] * len(texts)
        theirs = self.own.encode(texts, out_type=int, num_threads=THREADS)
        back = self.decode(ids)
        return [PARITY * np.array_equal(a, np.array(b, dtype="<u4")) | ROUND_TRIP * (t == x) for a, b, t, x in zip(ids, theirs, texts, back)]

    def _whole(self, texts: list[str], verify: bool) -> tuple[list[bytes], list[int]]:
        """(ids, checks) of whole texts."""
        ids = self._ids(texts)
        return [x.tobytes() for x in ids], self._checks(texts, ids, verify)

    def _by_word(self, words: list[str], verify: bool) -> tuple[list[bytes], list[int]]:
        """``_whole`` of words, many in one text of a batch: a word's ids start at each piece that starts with a marker."""
        parts = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        texts = [" ".join(part) for part in parts]
        found = self._ids(texts)
        held = self._checks(texts, found, verify)
        ids: list[bytes] = []
        checks: list[int] = []
        for part, x, ok in zip(parts, found, held):
            first = np.flatnonzero(self.starts[x])
            if len(first) != len(part) or ok != PARITY | ROUND_TRIP:
                a, b = self._whole(part, verify)
                ids, checks = ids + a, checks + b
                continue
            raw, at = x.tobytes(), [*(4 * first).tolist(), 4 * len(x)]
            ids += [raw[a:b] for a, b in zip(at, at[1:])]
            checks += [ok] * len(part)
        return ids, checks

    def _plain(self, text: str) -> bool:
        return self.by_word and bool(text) and text[0] != " " and text[-1] != " " and "  " not in text and SPACE not in text

    def encode(self, texts: list[str | None], verify: bool = False) -> tuple[list[np.ndarray], list[int]]:
        """(uint32 ids, checks that hold; all with verify=False) of each text."""
        plain = {i: t.split(" ") for i, t in enumerate(texts) if t and self._plain(t)}
        need = {w for x in plain.values() for w in x}
        new = list(need.difference(self.words))
        if len(self.words) + len(new) > CACHE:
            self.words, self.wrong, new = {}, {}, list(need)
        ids, checks = self._by_word(new, verify)
        self.wrong.update((w, c) for w, c in zip(new, checks) if c != PARITY | ROUND_TRIP)
        known = self.words
        known.update(zip(new, ids))
        rest = [i for i in range(len(texts)) if i not in plain]
        found, held = self._whole([texts[i] or "" for i in rest], verify) if rest else ([], [])
        out, ok = dict(zip(rest, found)), dict(zip(rest, held))
        for i, x in plain.items():
            out[i] = b"".join([known[w] for w in x])
            ok[i] = PARITY | ROUND_TRIP
            for w in self.wrong.keys() & set(x) if self.wrong else ():
                ok[i] &= self.wrong[w]
        for w in new:
            if len(w) > LONGEST:
                del known[w]
        return [np.frombuffer(out[i], dtype="<u4") for i in range(len(texts))], [ok[i] for i in range(len(texts))]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.tokenizer.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)


_codecs: dict[str, SentencePieceCodec] = {}


def codec(path: str) -> SentencePieceCodec:
    """One for each file and worker process."""
    if path not in _codecs:
        _codecs[path] = SentencePieceCodec(path)
    return _codecs[path]


def encode(docs: DataFrame, model: str, verify: bool = True) -> DataFrame:
    """doc_id, ids (binary, little-endian uint32), n_tokens, parity, round_trip of every row of ``docs``.

    Needs doc_id (integer) and text; other columns are not read.  ``model`` is the same path on every
    machine.  Null and empty texts have no ids.  The ids are the rebuilt tokenizer's; parity is whether
    SentencePiece itself gives the same, round_trip whether they decode to the text (both null with
    verify=False).  Whole texts are encoded, however long.  Rows are encoded one by one, so repeated rows
    and rows of null doc_id get ids like all others.  An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in slices(batches, 1, BLOCK):
            ids, checks = own.encode(batch.column(1).to_pylist(), verify)
            flags = [pa.array([bool(c & bit) if verify else None for c in checks], pa.bool_()) for bit in (PARITY, ROUND_TRIP)]
            yield pa.record_batch(
                [batch.column(0), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64()), *flags],
                ["doc_id", "ids", "n_tokens", "parity", "round_trip"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, ids binary, n_tokens long, parity boolean, round_trip boolean")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of every row of (doc_id, ids); other columns are not read.

    Null and empty ids decode to an empty text.  Repeated rows and rows of null doc_id are decoded like
    all others, ids of any length whole.  An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            ids = [np.frombuffer(x or b"", dtype="<u4") for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(own.decode(ids), pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
