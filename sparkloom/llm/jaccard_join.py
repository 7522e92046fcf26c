"""N-gram Jaccard self-join by count vectors in R-trees.

A document is the set of its distinct word shingles.  Shingles are hashed to ``GROUPS`` groups and a
document's counts by group are a point: for two documents the sum of the coordinates' minima is an
upper bound of the number of shingles they share, and the sum over a box's upper corner bounds the
overlap with everything in the box.  Points are kept in R-trees (boxes packed by size and position);
only pairs whose bound reaches what the similarity asks for are verified on the whole sets.

One tree over a corpus would be searched by one machine, so the forest has one tree per *cell*: the
documents that agree on a whole part of their sets.  The hash range is cut into 2**level equal parts;
a shingle in which two sets differ spoils one part of each, and sets that are similar enough differ in
at most ``d`` shingles, a number that their sizes give.  So with more than ``d`` parts that hold
anything, sets that link have a part in common, and under one order of all parts' contents (those of
many shingles first) they have one among the first ``d`` + 1 of each: no link lies outside all cells.
Several shingles agree at once hardly ever by chance, so cells hold near copies and little else, and
their number is in proportion to the input.  A set whose shingles fall into ``d`` parts or fewer is put
into cells of single shingles too, of the first ``n - ceil(t n) + 1``, with others of its kind.

Copies never meet pair by pair.  Equal sets are one node, and cells of the same nodes are one.  First
every node is compared with the least node of each of its cells; components follow from those links.
Then trees are searched for pairs in different components, in rounds: a node is verified against the
likeliest node of a cell, against a few more, and in the last round against all that the trees leave,
but those that the rounds before have joined.  A cell of many components is cut into blocks of bounded
size, and a node that many others are verified against is dealt to several tasks.

Identity: a set is known by a 64-bit fingerprint, a shingle and a cell by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import connected_components
from .rowfilter import RowFilter
from .scratch import Scratch
from .wordhash import mix64, shingle_sets, slices

GROUPS, FULL = 256, 255
BLOCK_ROWS = 512
LEAF = 16
#: Cells of so many nodes or fewer are compared in full by their first and their last node.
COVERED = 3
#: Verified candidates of a node in a cell, by round; None is all.
ROUNDS = (1, 8, None)
#: Rows of a key that one batch sends to be counted; the others are known to have company.
PLENTY = 16
_U = np.uint64
_GOLD, _PART, _LEVEL, _SINGLE = (_U(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
#: The most differences that a level allows: an eighth more parts than differences, and two.
LEVELS = np.array([((8 << level) - 16) // 9 for level in range(48)], dtype=np.int64)


def needed(size_a, size_b, percent: int):
    """Least intersection with 100 * intersection >= percent * union."""
    return -(-percent * (size_a + size_b) // (100 + percent))


def differences(size_a, size_b, percent: int):
    """Most shingles in one of two sets only that link."""
    return (100 - percent) * (size_a + size_b) // (100 + percent)


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(all values, where each set begins, with a closing total)."""
    ends = np.cumsum([0, *map(len, sets)])
    return np.concatenate(sets) if sets else np.zeros(0, _U), ends


def fingerprints(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit identity of each set."""
    sums = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(mix64(values), out=sums[1:])
    return mix64(sums[ends[1:]] - sums[ends[:-1]] + np.diff(ends).astype(_U) * _GOLD).view(np.int64)


def cell_keys(values: np.ndarray, ends: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, the set of each key): the cells of sorted sets."""
    sizes = np.diff(ends)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    fewest = np.maximum(differences(sizes, -(-percent * sizes // 100), percent), 1)
    most = differences(sizes, 100 * sizes // percent, percent)
    low = np.searchsorted(LEVELS, fewest)
    high = np.where(most > 0, np.searchsorted(LEVELS, most), low - 1)
    mixed = mix64(values)
    keys, owners = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for turn in range(int((high - low).max(initial=-1)) + 1):
        level = low + turn
        used = level <= high
        at = used[owner]
        s, of = values[at], owner[at]
        part = s >> (_U(64) - level[of].astype(_U))
        cut = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (of[1:] != of[:-1])))) if len(s) else np.zeros(0, np.int64)
        by = of[cut]
        held = np.diff(np.append(cut, len(s)))
        content = mix64((np.add.reduceat(mixed[at], cut) if len(cut) else np.zeros(0, _U)) + part[cut] * _PART + level[by].astype(_U) * _LEVEL)
        allowed = np.minimum(most, LEVELS[level])
        parts = np.bincount(by, minlength=len(sizes))
        poor = used & (parts <= allowed)
        order = np.lexsort((content, -held, by))
        by = by[order]
        rank = np.arange(len(by)) - (np.cumsum(parts) - parts)[by]
        take = rank <= allowed[by]
        keys.append(content[order][take])
        owners.append(by[take])
        for i in np.flatnonzero(poor).tolist():
            n = int(sizes[i])
            first = values[ends[i] : ends[i] + n - -(-percent * n // 100) + 1]
            keys.append(mix64(first + np.array([level[i]], dtype=_U) * _SINGLE))
            owners.append(np.full(len(first), i))
    return np.concatenate(keys).view(np.int64), np.concatenate(owners)


def count_vectors(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Counts by group in a byte each; FULL stands for itself and more."""
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    flat = np.bincount(owner * GROUPS + (values & _U(GROUPS - 1)).astype(np.int64), minlength=(len(ends) - 1) * GROUPS)
    return np.minimum(flat, FULL).astype(np.uint8).reshape(-1, GROUPS)


def overlap_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Summed minima of count vectors, row by row; no bound where a minimum is FULL."""
    least = np.minimum(a, b)
    return np.where((least == FULL).any(1), np.iinfo(np.int64).max, least.sum(1, dtype=np.int64))


class CountVectorTree:
    """Static R-tree over count vectors: leaves of LEAF points, boxes kept as upper corners."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        # pack by size, then by the heaviest half of the groups
        self.order = np.lexsort((points[:, : GROUPS // 2].sum(1, dtype=np.int64), sizes)) if len(sizes) else np.zeros(0, np.int64)
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][1]) > LEAF:
            top, low, high = self.levels[-1]
            cut = np.arange(0, len(low), LEAF)
            self.levels.append((np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))

    def search(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Positions of all points whose bound reaches the needed overlap with (point, size)."""
        return self.ranked(point, size, percent)[0]

    def ranked(self, point: np.ndarray, size: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, bounds) of all points whose bound reaches the needed overlap with (point, size)."""
        top, low, high = self.levels[-1]
        at = np.arange(len(low))
        for level in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[level]
            at = at[(100 * size >= percent * low[at]) & (100 * high[at] >= percent * size)]
            bound = overlap_bound(top[at], point[None, :])
            fits = bound >= needed(size, np.maximum(low[at], -(-percent * size // 100)), percent)
            at, bound = at[fits], bound[fits]
            if level:
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = at[at < len(self.levels[level - 1][1])]
        return self.order[at], bound


def _lists(values: np.ndarray, owners: np.ndarray, n: int) -> pa.Array:
    """One list for each of n owners."""
    order = np.argsort(owners, kind="stable")
    ends = np.concatenate(([0], np.cumsum(np.bincount(owners, minlength=n))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[order], pa.int64()))


def _signatures(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, row, node, n, keys, shared) of rows (doc_id, row, text).

    keys are the cells of a set, given by one of the rows of a batch that have it.  A key that a batch
    has already given to PLENTY sets is in ``shared`` instead: it needs no counting.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            sets = list(shingle_sets(batch.column(2), words))
            values, ends = _flat(sets)
            nodes, sizes = fingerprints(values, ends), np.diff(ends)
            _, first = np.unique(nodes, return_index=True)
            first = np.sort(first[sizes[first] > 0])
            keys, of = cell_keys(*_flat([sets[i] for i in first]), percent)
            order = np.argsort(keys, kind="stable")
            begin = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1]))) if len(keys) else np.zeros(0, np.int64)
            turn = np.empty(len(keys), dtype=np.int64)
            turn[order] = np.arange(len(keys)) - np.repeat(begin, np.diff(np.append(begin, len(keys))))
            of, many = first[of] if len(first) else of, turn >= PLENTY
            yield pa.record_batch(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(nodes, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    _lists(keys[~many], of[~many], batch.num_rows),
                    _lists(keys[many], of[many], batch.num_rows),
                ],
                ["doc_id", "row", "node", "n", "keys", "shared"],
            )

    return rows.mapInArrow(sign, "doc_id long, row long, node long, n long, keys array<long>, shared array<long>")


def _in_company(keyed: DataFrame) -> DataFrame:
    """The distinct rows (key, node) whose key has two nodes or more."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, known = np.zeros(0, np.int64), np.zeros(0, np.int64), False
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate((keys, batch.column(0).to_numpy()))
            nodes = np.concatenate((nodes, batch.column(1).to_numpy()))
            new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])))
            keys, nodes = keys[new], nodes[new]
            same = keys[1:] == keys[:-1]
            before, after = np.concatenate(([known], same)), np.concatenate((same, [False]))
            out = np.flatnonzero((before | after)[:-1])
            if len(out):
                yield pa.record_batch([pa.array(keys[out]), pa.array(nodes[out])], ["key", "node"])
            # the last row waits for the next one
            keys, nodes, known = keys[-1:], nodes[-1:], bool(before[-1])
        if known:
            yield pa.record_batch([pa.array(keys), pa.array(nodes)], ["key", "node"])

    dealt = keyed.repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(find, "key long, node long")


def _sets(rows: DataFrame, wanted: RowFilter, words: int) -> DataFrame:
    """(node, n, vector, shingles as little-endian uint64) of the wanted rows (row, text), and of a few that the filter lets through."""
    passes = wanted.test()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(passes(batch.column(0).to_numpy())))
            for part in slices(iter([batch]), 1):
                sets = list(shingle_sets(part.column(1), words))
                values, ends = _flat(sets)
                nodes = fingerprints(values, ends)
                one = np.unique(nodes, return_index=True)[1]
                vectors = count_vectors(values, ends)
                yield pa.record_batch(
                    [
                        pa.array(nodes[one], pa.int64()),
                        pa.array(np.diff(ends)[one], pa.int64()),
                        pa.array([vectors[i].tobytes() for i in one], pa.binary()),
                        pa.array([sets[i].tobytes() for i in one], pa.binary()),
                    ],
                    ["node", "n", "vector", "shingles"],
                )

    return rows.mapInArrow(build, "node long, n long, vector binary, shingles binary")


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, GROUPS)


def _bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sizes and count vectors that allow a link."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            keep = pa.array(overlap_bound(_vectors(batch.column(4)), _vectors(batch.column(5))) >= needed(na, nb, percent))
            yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    side = {s: points.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("vector").alias(f"v{s}")) for s in "ab"}
    sized = pairs.join(side["b"], "b").join(side["a"], "a").where(f"100 * na >= {percent} * nb and 100 * nb >= {percent} * na")
    return sized.select("a", "b", "na", "nb", "va", "vb").mapInArrow(check, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links.

    Each set goes to the tasks of the nodes ``a`` that it is compared with; where those are many, a
    goes to several tasks.  A task holds one set and takes the others as they come.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"))
    spread = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    others = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("other"), F.col("b").alias("node"))
    rows = parts.select("a", spread, F.lit(False).alias("other"), F.col("a").alias("node")).unionByName(others)
    rows = rows.join(sets.select("node", "shingles"), "node").select("a", "part", "other", "node", "shingles")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, np.zeros(0, _U)
        for batch in batches:
            a, b = [], []
            for at, other, node, raw in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                values = np.frombuffer(raw, _U)
                if not other:
                    own, held = at, values
                    continue
                assert own == at
                place = np.minimum(np.searchsorted(held, values), len(held) - 1)
                if int((held[place] == values).sum()) >= needed(len(held), len(values), percent):
                    a.append(min(at, node))
                    b.append(max(at, node))
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = rows.repartition("a", "part").sortWithinPartitions("a", "part", "other")
    return dealt.mapInArrow(check, "a long, b long").distinct()


def _groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal values in the first ``by`` columns, each in one batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy() for i in range(by)]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            key = tuple(c[i] for c in cols)
            if held and key != last:
                yield pa.concat_batches(held) if len(held) > 1 else held[0]
                held = []
            held.append(batch.slice(i, j - i))
            last = key
    if held:
        yield pa.concat_batches(held) if len(held) > 1 else held[0]


def _across(labelled: DataFrame, points: DataFrame, percent: int, most: int | None) -> DataFrame:
    """(a, b, more): pairs within a cell, in different components, that the cell's R-trees leave over.

    Of each node's the ``most`` likeliest in each block are given, and ``more`` tells that there were
    others.  A cell's largest component needs no look inside: its other members ("guests") search all.
    Group (key, block, guests' block) holds about BLOCK_ROWS of either, however large the cell.
    """
    by_comp = labelled.groupBy("key", "comp").agg(F.count("*").alias("m"))
    cells = (
        by_comp.groupBy("key")
        .agg(F.max_by("comp", F.struct("m", "comp")).alias("largest"), F.sum("m").alias("m"), F.max("m").alias("inside"), F.count("*").alias("comps"))
        .where("comps > 1")
        .select(
            "key",
            "largest",
            F.ceil(F.col("m") / BLOCK_ROWS).cast("int").alias("blocks"),
            F.ceil((F.col("m") - F.col("inside")) / BLOCK_ROWS).cast("int").alias("guests"),
        )
    )
    rows = labelled.join(cells, "key").join(points, "node")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    cols = ["node", "n", "comp", "vector"]
    hosts = rows.select("key", place("blocks").alias("block"), spread("guests").alias("part"), F.lit(False).alias("guest"), *cols)
    guests = rows.where("comp <> largest").select("key", spread("blocks").alias("block"), place("guests").alias("part"), F.lit(True).alias("guest"), *cols)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            guest = group.column(3).to_numpy(zero_copy_only=False)
            ask, inside = np.flatnonzero(guest), np.flatnonzero(~guest)
            if not len(ask) or not len(inside):
                continue
            nodes, sizes, comps = (group.column(i).to_numpy() for i in (4, 5, 6))
            vectors = _vectors(group.column(7))
            tree = CountVectorTree(vectors[inside], sizes[inside])
            found: dict[tuple[int, int], bool] = {}
            for i in ask.tolist():
                at, bound = tree.ranked(vectors[i], int(sizes[i]), percent)
                at = inside[at]
                apart = comps[at] != comps[i]
                at, bound = at[apart], bound[apart]
                more = most is not None and len(at) > most
                if more:
                    union = sizes[at] + sizes[i] - np.minimum(bound, sizes[at])
                    at = at[np.lexsort((nodes[at], -(bound / np.maximum(union, 1))))[:most]]
                for j in at.tolist():
                    pair = (min(nodes[i], nodes[j]), max(nodes[i], nodes[j]))
                    found[pair] = found.get(pair, False) or more
            if found:
                pairs = np.array(list(found), dtype=np.int64)
                yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(list(found.values()), pa.bool_())], ["a", "b", "more"])

    dealt = hosts.unionByName(guests).repartition("key", "block", "part").sortWithinPartitions("key", "block", "part")
    return dealt.mapInArrow(search, "a long, b long, more boolean").groupBy("a", "b").agg(F.bool_or("more").alias("more"))


def jaccard_components(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """Link documents whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    ``docs`` needs doc_id (integer) and text; other columns are not read.  Returns one row per row of
    ``docs``: doc_id long, n_shingles long, component_id long (the least doc_id reachable by links,
    itself included).

    Texts are lower-cased in A-Z only; words are runs outside 0x20 and 0x09-0x0D, and whole texts
    count, however long.  With fewer than ``words`` words the whole sequence is one shingle.  Null and
    wordless texts have no shingle and link with nothing.  A row of null doc_id takes part; a
    component of such rows only has a null component_id.  Rows that repeat a doc_id are documents of
    their own, each with its own text's component.  Ties do not matter: components are the same under
    any order.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    row = F.xxhash64("doc_id", "text").alias("row")
    signed = scratch.keep(_signatures(texts.select("doc_id", row, "text"), words, percent), "signed")
    each = scratch.keep(signed.select("doc_id", "row", "node", "n"), "each")
    keyed = _in_company(signed.select(F.explode("keys").alias("key"), "node"))
    keyed = keyed.unionByName(signed.select(F.explode("shared").alias("key"), "node")).distinct()
    keyed = scratch.keep(keyed, "keyed")
    scratch.drop("signed")

    # cells of two nodes or more; those with the same nodes are one, known by the least key
    cells = keyed.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor("node").alias("x"), F.min("node").alias("a"), F.max("node").alias("b")).where("m > 1")
    cells = scratch.keep(cells.groupBy("m", "x", "a", "b").agg(F.min("key").alias("key")).select("key", "m", "a", "b"), "cells")
    members = scratch.keep(keyed.join(cells.where("m > 2"), "key").select("key", "m", "a", "b", "node"), "members")
    scratch.drop("keyed")

    two = cells.where("m = 2")
    inside = members.select("node").unionByName(two.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    nodes = scratch.keep(each.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.min("row").alias("row")), "nodes")
    sets = scratch.keep(_sets(texts.select(row, "text"), RowFilter(nodes.join(inside, "node", "left_semi").select("row")), words), "sets")
    points = scratch.keep(sets.select("node", "n", "vector").dropDuplicates(["node"]), "points")

    ends = F.when(F.col("m") > COVERED, F.array("a")).otherwise(F.array("a", "b"))
    stars = two.select("a", "b").unionByName(members.select(F.explode(ends).alias("a"), F.col("node").alias("b")))
    stars = stars.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tested = scratch.keep(_bounded(stars, points, percent), "near")
    labels = connected_components(scratch.keep(_verified(tested, sets, percent), "links"), scratch, "star")
    wide = members.where(F.col("m") > COVERED).select("key", "node")
    for turn, most in enumerate(ROUNDS):
        labelled = wide.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("comp"))
        found = scratch.keep(_across(scratch.keep(labelled, f"labelled-{turn}"), points, percent, most), f"found-{turn}")
        pairs = scratch.keep(found.select("a", "b").join(tested, ["a", "b"], "left_anti"), f"pairs-{turn}")
        if not pairs.isEmpty():
            more = scratch.keep(_verified(pairs, sets, percent), f"links-{turn}")
            tested = tested.unionByName(pairs)
            # labels are nodes, so new links between them carry the components on
            lifted = more.join(labels.toDF("a", "la"), "a", "left").join(labels.toDF("b", "lb"), "b", "left")
            lifted = scratch.keep(lifted.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b").distinct(), f"lifted-{turn}")
            over = connected_components(lifted, scratch, f"over-{turn}")
            known = labels.join(over.toDF("label", "up"), "label", "left").select("node", F.coalesce("up", "label").alias("label"))
            fresh = over.toDF("node", "label").join(labels.select("node"), "node", "left_anti")
            labels = scratch.keep(known.unionByName(fresh), f"labels-{turn}")
        if most is not None and found.where("more").isEmpty():
            break

    labelled = scratch.keep(nodes.join(labels, "node", "left").select("node", "first", F.coalesce("label", "node").alias("label")), "nodes-labelled")
    least = scratch.keep(labelled.groupBy("label").agg(F.min("first").alias("component_id")), "least")
    of = scratch.keep(labelled.join(least, "label").select("node", "component_id"), "of")
    scratch.keep_only("each", "of")
    grouped = each.where("n > 0").select("doc_id", "node", "n").join(of, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = each.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return grouped.unionByName(alone)
