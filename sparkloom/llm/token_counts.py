"""Edit-aware token counts.

A document keeps a segment tree over its pre-tokens: leaves hold the lengths and token counts of a few
pre-tokens each, inner nodes the sums.  An edit re-encodes only what it can have changed: scanning
starts at the last pre-token that cannot see the edit and stops at the first old boundary behind it,
because what a pre-token is depends on the text from its start to a few characters behind its end.  The
leaves' new counts then go up the tree, so an edit costs its own size and the tree's height.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .bytebpe import _RARE, PATTERN, ByteBpe, encoder
from .wordhash import BLOCK, slices

LEAF = 32
#: How far behind its end, and before an edit, a pre-token can look; with added tokens as far as the longest.
CONTEXT = 2
WINDOW = 256
CACHE, LONGEST = 1 << 18, 48
_pattern = regex.compile(PATTERN)


class PreTokens:
    """Pre-tokens and their token counts under one tokenizer file.

    The string of an added token is a pre-token of one token, the longest where several start.
    """

    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe
        self.known: dict[str, int] = {}
        self.added = sorted(filter(None, bpe.added), key=len, reverse=True)
        self.context = max([CONTEXT, *map(len, self.added[:1])])
        self._parts = re.compile(f"({'|'.join(map(re.escape, self.added))})") if self.added else None

    def split(self, text: str) -> list[str]:
        if any(a in text for a in self.added):
            parts = self._parts.split(text)
            return [p for i, part in enumerate(parts) if part for p in ([part] if i % 2 else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if self.bpe.fast is not None and not _RARE.search(text):
            return _pattern.findall(text)
        cuts = [at for _, at in self.bpe.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return [text[a:b] for a, b in cuts]

    def _count(self, pieces: list[str]) -> dict[str, int]:
        """Tokens of pre-tokens."""
        if self.bpe.fast is not None and not any(map(_RARE.search, pieces)):
            encode = self.bpe.fast.encode_ordinary
            return {p: len(encode(p)) for p in pieces} | {a: 1 for a in self.added if a in pieces}
        return dict(zip(pieces, map(len, self.bpe.encode(pieces))))

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        new = list({p for p in pieces if p not in known})
        if new:
            if len(known) + len(new) > CACHE:
                self.known = known = {}
                new = list(set(pieces))
            found = self._count(new)
            out = [known[p] if p in known else found[p] for p in pieces]
            known.update((p, n) for p, n in found.items() if len(p) <= LONGEST)
            return out
        return [known[p] for p in pieces]


class TokenTree:
    """Sums of characters and tokens over leaves of pre-tokens."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self._fill(chars, tokens)

    def _fill(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        both = np.stack((chars, tokens)).astype(np.int64)
        cuts = np.arange(0, max(len(chars), 1), LEAF)
        self.leaves = [(both[0, i : i + LEAF], both[1, i : i + LEAF]) for i in cuts.tolist()]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), dtype=np.int64)
        if len(chars):
            self.sums[self.size : self.size + len(cuts)] = np.add.reduceat(both, cuts, axis=1).T
        at = self.size
        while at > 1:  # level by level
            self.sums[at // 2 : at] = self.sums[at : 2 * at : 2] + self.sums[at + 1 : 2 * at : 2]
            at //= 2

    @classmethod
    def of(cls, text: str, pre: PreTokens) -> TokenTree:
        pieces = pre.split(text)
        return cls(np.array([len(p) for p in pieces], dtype=np.int64), np.array(pre.counts(pieces), dtype=np.int64))

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def find(self, at: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds character ``at``, or the last one."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if at >= before + self.sums[node, 0] and self.sums[node + 1, 0]:
                before += int(self.sums[node, 0])
                node += 1
        return node - self.size, before

    def _set(self, leaf: int, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.leaves[leaf] = (chars, tokens)
        node = leaf + self.size
        self.sums[node] = chars.sum(), tokens.sum()
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def edit(self, text: str, start: int, stop: int, new: str, pre: PreTokens) -> tuple[str, int]:
        """Replace text[start:stop]; (the new text, how many pre-tokens were encoded anew)."""
        start = min(max(start, 0), len(text))
        stop = min(max(stop, start), len(text))
        after = text[:start] + new + text[stop:]
        if not len(text):
            fresh = TokenTree.of(after, pre)
            self.leaves, self.size, self.sums = fresh.leaves, fresh.size, fresh.sums
            return after, sum(len(c) for c, _ in self.leaves)
        shift = len(new) - (stop - start)
        # the first pre-token that may see the edit
        leaf, at = self.find(max(start - pre.context, 0))
        chars, tokens = self.leaves[leaf]
        ends = at + np.cumsum(chars)
        i = int(np.searchsorted(ends, start - pre.context, side="right"))
        begin = at if i == 0 else int(ends[i - 1])
        head = chars[:i], tokens[:i]
        # old pre-tokens are taken up leaf by leaf as the scan goes on
        old_leaf, old_i, old_end = leaf, i, begin
        pieces: list[str] = []
        scan, window, done = begin, WINDOW, False
        while not done:
            part = after[scan : scan + window]
            bound = scan + len(part)
            last = bound == len(after)
            moved = False
            for piece in pre.split(part):
                end = scan + len(piece)
                if not last and end + pre.context > bound:
                    break
                pieces.append(piece)
                scan, moved = end, True
                while old_end + shift < scan or old_end < stop:
                    nxt = self._next(old_leaf, old_i)
                    if nxt is None:
                        break
                    old_leaf, old_i, length = nxt
                    old_end += length
                if old_end + shift == scan and old_end >= stop:
                    done = True
                    break
            if scan == len(after):
                done = True
                old_leaf, old_i = len(self.leaves) - 1, len(self.leaves[-1][0])
            if not done and not moved:
                window *= 2
        tail = self.leaves[old_leaf][0][old_i:], self.leaves[old_leaf][1][old_i:]
        fresh = np.array([len(p) for p in pieces], dtype=np.int64), np.array(pre.counts(pieces), dtype=np.int64)
        merged = [np.concatenate((h, f, t)) for h, f, t in zip(head, fresh, tail)]
        empty = np.zeros(0, dtype=np.int64)
        for k in range(leaf + 1, old_leaf + 1):
            self._set(k, empty, empty)
        self._set(leaf, *merged)
        if len(merged[0]) > 4 * LEAF:
            self._fill(np.concatenate([c for c, _ in self.leaves]), np.concatenate([t for _, t in self.leaves]))
        return after, len(pieces)

    def _next(self, leaf: int, i: int) -> tuple[int, int, int] | None:
        """(leaf, place behind it, length) of the pre-token at a place, or None at the end."""
        while leaf < len(self.leaves) and i >= len(self.leaves[leaf][0]):
            leaf, i = leaf + 1, 0
        return None if leaf == len(self.leaves) else (leaf, i + 1, int(self.leaves[leaf][0][i]))

    def dump(self) -> bytes:
        return np.stack([np.concatenate([x[k] for x in self.leaves]) for k in (0, 1)]).astype("<i4").tobytes()

    @classmethod
    def load(cls, data: bytes) -> TokenTree:
        both = np.frombuffer(data, dtype="<i4").reshape(2, -1)
        return cls(both[0], both[1])


_pre: dict[str, PreTokens] = {}


def _pre_tokens(path: str) -> PreTokens:
    if path not in _pre:
        _pre[path] = PreTokens(encoder(path))
    return _pre[path]


def build_trees(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text, tree (binary), n_tokens of every row of ``docs`` (doc_id integer, text).

    ``tokenizer`` is a ``tokenizers`` file with byte-level BPE, the same path on every machine.  The
    string of an added token counts as one token (its flags, such as lstrip, are not read).  Null texts
    stay null, and count as empty: no tokens.  Whole texts are counted, however long; repeated rows and
    rows of null doc_id each get a tree.  Other columns are not read.  An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = _pre_tokens(tokenizer)
        for batch in slices(batches, 1, BLOCK):
            trees = [TokenTree.of(t or "", pre) for t in batch.column(1).to_pylist()]
            yield pa.record_batch(
                [batch.column(0), batch.column(1).cast(pa.string()), pa.array([t.dump() for t in trees], pa.binary()), pa.array([t.tokens for t in trees], pa.int64())],
                ["doc_id", "text", "tree", "n_tokens"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, text string, tree binary, n_tokens long")


def apply_edits(trees: DataFrame, tokenizer: str) -> DataFrame:
    """Apply the edits of each row to its text and tree.

    ``trees`` has doc_id, text, tree and edits: array of (start int, stop int, replacement string), in
    code points of the text as the edits before have left it.  Places outside the text count as its
    ends, null edits and null arrays as none, a null replacement as empty, a null text as empty.
    Returns doc_id, text, tree, n_before, n_tokens and n_encoded (pre-tokens that were encoded anew), a
    row for each row, repeated ones and those of null doc_id too; other columns are not read.  An empty
    table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = _pre_tokens(tokenizer)
        for batch in slices(batches, 1, BLOCK):
            rows = []
            for text, data, edits in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                tree, fresh = TokenTree.load(data), 0
                before = tree.tokens
                for e in edits or ():
                    if e is not None:
                        text, n = tree.edit(text or "", e["start"] or 0, e["stop"] or 0, e["replacement"] or "", pre)
                        fresh += n
                rows.append((text, tree.dump(), before, tree.tokens, fresh))
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "text", "tree", "n_before", "n_tokens", "n_encoded"])

    return trees.select("doc_id", "text", "tree", "edits").mapInArrow(run, "doc_id long, text string, tree binary, n_before long, n_tokens long, n_encoded long")
