"""Byte-level BPE ids of a ``tokenizers`` file.

The merges of such a file are also a rank table: where its ids follow the order of the merges, the
table is handed to tiktoken, which gives the same ids several times faster.  The two libraries use
different regular-expression engines, so a text goes that way only if it is made of characters on
which Unicode versions agree (up to U+024F) and holds no added token; all other texts, and all files
without that order, are encoded by ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Fixed by the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_RARE = re.compile("[^\x00-\x1b\x20-ɏ]")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteBpe:
    """encode(texts) -> one uint32 array of ids per text, without special tokens; None counts as empty."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [x["content"] for x in spec["added_tokens"]]
        self.fast = self._ranked(spec)

    @staticmethod
    def _ranked(spec: dict):
        import tiktoken

        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or model["type"] != "BPE":
            return None
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [model["vocab"].get(a + b) for a, b in merges]
        if order != sorted(order, key=lambda i: -1 if i is None else i) or None in order or min(order, default=0) < 256:
            return None
        letters, added = byte_letters(), {x["content"] for x in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        slow = []
        for i, text in enumerate(texts):
            if not text:
                out[i] = np.zeros(0, dtype="<u4")
            elif self.fast is None or _RARE.search(text) or any(a in text for a in self.added):
                slow.append(i)
            else:
                out[i] = np.array(self.fast.encode_ordinary(text), dtype="<u4")
        if slow:
            for i, e in zip(slow, self.tokenizer.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False)):
                out[i] = np.array(e.ids, dtype="<u4")
        return out


_encoders: dict[str, ByteBpe] = {}


def encoder(path: str) -> ByteBpe:
    """One for each file and worker process."""
    if path not in _encoders:
        _encoders[path] = ByteBpe(path)
    return _encoders[path]
