"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of neighbouring lines chooses where a chunk of lines ends, so inserted
or removed lines move boundaries only next to them.  With a least size a boundary counts only where
its chunk has that many lines, and what is left at the end joins the chunk before it, so that every
line of a longer text lies in a chunk that can be removed.  Chunks of several lines that occur more than
once in the corpus are removed everywhere but at their first place, by doc_id and then position.
Chunks are grouped by digest and by their bytes; where different bytes share a digest, they are told
apart by the bytes themselves.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .columns import free_name, spread
from .scratch import Scratch

#: One line in so many ends a chunk.
DIVISOR = 3
LEAST_LINES = 2
#: Fixed by the definition of a word.
WORDED = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _chunks(df: DataFrame, lines: str, into: str, scrap: str, least: int) -> DataFrame:
    """Adds array<struct<first:int,n:int>>: the chunks' first lines and sizes.

    Texts of ``least`` lines or more have no smaller chunk.
    """
    hashes = F.transform(F.col(lines), lambda x: F.xxhash64(x))
    h, last = F.col(scrap), F.size(lines) - 1

    def ends(i: Column) -> Column:
        rolled = F.xxhash64(F.get(h, F.greatest(i - 1, F.lit(0))), F.get(h, i))
        return (i == last) | (F.pmod(rolled, F.lit(DIVISOR)) == 0)

    def apart(marks: Column) -> Column:
        inner = F.filter(marks, lambda i: i <= last - least)
        start = F.struct(F.lit(-1).alias("at"), F.array().cast("array<int>").alias("ends"))
        take = lambda a, i: F.struct(i.alias("at"), F.concat(a["ends"], F.array(i)).alias("ends"))
        return F.aggregate(inner, start, lambda a, i: F.when(i - a["at"] >= least, take(a, i)).otherwise(a), lambda a: F.concat(a["ends"], F.array(last)))

    at = F.filter(F.sequence(F.lit(0), last), ends)
    at = apart(at) if least > 1 else at
    spans = lambda e: F.zip_with(F.concat(F.array(F.lit(-1)), F.slice(e, 1, F.size(e) - 1)), e, lambda a, b: F.struct((a + 1).alias("first"), (b - a).alias("n")))
    return df.withColumn(scrap, hashes).withColumn(into, at).withColumn(into, spans(F.col(into))).drop(scrap)


def _digest(chunk: Column) -> Column:
    return F.unhex(F.md5(chunk))


def _text(lines: Column, chunk: Column) -> Column:
    return F.array_join(F.slice(lines, chunk["first"] + 1, chunk["n"]), "\n")


def dedup_lines(docs: DataFrame, least: int = 1) -> DataFrame:
    """``docs`` with ``text`` without repeated chunks, and four columns of what was done.

    Needs doc_id (integer) and text.  All columns come through; lines_before, lines_removed,
    chunks_removed (int) and chunks_all are added under the first free name (underscores in front
    where a column has it).  A line ends at a line feed; removed chunks go with their line feed.
    Null texts stay null and empty ones empty.  Rows of null doc_id keep all their chunks and make
    no others repeated.  Rows that repeat a doc_id and a position count as one place.  Chunks of one
    line, and chunks without a word, are never removed.  Texts are cut whole, however long; an empty
    table gives an empty table.  ``least`` is the least number of lines of a
    chunk: with 1 every boundary counts and a line between two of them stays; with LEAST_LINES, as in
    the queries, an exact copy of a text of several lines loses all its words.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _lines(F.col("text")).alias("lines")).where("doc_id is not null")
    # outer: a filter inferred from an inner one would have the chunks worked out once more for every line
    found = _chunks(plain, "lines", "chunks", "hashes", least).select("doc_id", "lines", F.posexplode_outer("chunks").alias("pos", "chunk")).where(F.col("chunk.n") >= LEAST_LINES)
    found = found.select("doc_id", "pos", _text(F.col("lines"), F.col("chunk")).alias("bytes")).where(F.col("bytes").rlike(WORDED))
    found = found.select("doc_id", "pos", "bytes", _digest(F.col("bytes")).alias("digest"))

    by_bytes = found.groupBy("digest", "bytes").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("first"))
    repeated = by_bytes.groupBy("digest").agg(F.sum("n").alias("n"), F.count("*").alias("texts"), F.min("first").alias("first")).where("n > 1")
    place = [F.col("first.doc_id").alias("first_doc"), F.col("first.pos").alias("first_pos")]
    repeated = scratch.keep(repeated.select("digest", "texts", *place), "repeated")
    again = found.select("doc_id", "pos", "digest").join(repeated.where("texts = 1"), "digest")
    mixed = repeated.where("texts > 1").select("digest")
    if not mixed.isEmpty():  # bytes that share a digest with others go by the bytes
        own = by_bytes.where("n > 1").join(mixed, "digest", "left_semi").select("digest", "bytes", *place)
        apart = found.join(mixed, "digest", "left_semi").join(own, ["digest", "bytes"])
        again = again.select("doc_id", "pos", "first_doc", "first_pos").unionByName(apart.select("doc_id", "pos", "first_doc", "first_pos"))
    again = again.where("doc_id <> first_doc or pos <> first_pos")

    names = {n: free_name(docs, n) for n in ("lines_before", "lines_removed", "chunks_all", "chunks_removed", "line_list", "chunk_list", "chunk_hash", "chunk_key", "chunk_salt", "chunk_drop")}
    key, salt = names["chunk_key"], names["chunk_salt"]
    drops = again.groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("pos").alias(names["chunk_drop"])).withColumn(salt, spread(F.col(key)))
    out = docs.withColumn(key, F.col("doc_id").cast("long")).withColumn(salt, spread(F.col(key), F.col("text").cast("string"))).join(drops, [key, salt], "left")
    none = F.array().cast("array<int>")
    out = out.withColumn(names["chunk_drop"], F.coalesce(names["chunk_drop"], none)).withColumn(names["line_list"], _lines(F.col("text")))
    out = _chunks(out, names["line_list"], names["chunk_list"], names["chunk_hash"], least)
    chunks, lines, dropped = (F.col(names[n]) for n in ("chunk_list", "line_list", "chunk_drop"))
    kept = F.filter(chunks, lambda c, i: ~F.array_contains(dropped, i))
    gone = F.filter(chunks, lambda c, i: F.array_contains(dropped, i))
    changed = F.size(dropped) > 0
    made = {
        "text": F.when(changed, F.array_join(F.transform(kept, lambda c: _text(lines, c)), "\n")).otherwise(F.col("text")),
        names["lines_before"]: F.size(lines),
        names["lines_removed"]: F.when(changed, F.aggregate(gone, F.lit(0), lambda a, c: a + c["n"])).otherwise(F.lit(0)),
        names["chunks_all"]: F.size(chunks),
        names["chunks_removed"]: F.size(dropped),
    }
    # a generator of one row: later filters on these columns stay above it and do not repeat the work
    one = F.inline_outer(F.array(F.struct(*[v.alias(k) for k, v in made.items()])))
    out = out.select(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], one)
    return out.select(*[f"`{c}`" for c in docs.columns], *[names[n] for n in ("lines_before", "lines_removed", "chunks_all", "chunks_removed")])
