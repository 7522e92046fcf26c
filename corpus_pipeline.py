"""Corpus preparation in five stages, each one operator of ``sparkloom.llm``.

Every stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and all
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.llm.columns import free_name
from sparkloom.llm.jaccard_join import jaccard_components
from sparkloom.llm.line_dedup import LEAST_LINES, WORDED, dedup_lines
from sparkloom.llm.packing import pack
from sparkloom.llm.quality_rules import annotate, passes
from sparkloom.llm.queries import tokenizer_path
from sparkloom.llm.rowfilter import RowFilter
from sparkloom.llm.scratch import Scratch
from sparkloom.llm.secret_scan import find_secrets, redacted
from sparkloom.llm.shipping import ship

POLICY = "v1"
#: Near duplicates: words of a shingle, and the least similarity in percent.
SHINGLE, SIMILARITY = 5, 80


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the policy rejects.

    Null, empty and wordless texts have too few words and go.  Rows are judged one by one, so repeated
    rows share their fate and a null doc_id changes nothing; texts are measured whole, however long.
    Further columns come through, whatever their names.  An empty table stays empty.
    """
    ship(spark)
    entry = free_name(docs, "ledger")
    return annotate(docs, entry).where(passes(POLICY, f"{entry}.failed")).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated chunks of lines, and documents of which no word is left.

    Null, empty and wordless texts go.  The first place of a chunk is that of the least doc_id, then
    position; rows of null doc_id keep their lines, and rows that repeat a doc_id and a position count
    as one place.  n_chars follows the text.  Long texts are cut like others; further columns come
    through.  An empty table stays empty.
    """
    left = dedup_lines(docs, LEAST_LINES).select(docs.columns)
    return _sized(left.where(F.col("text").rlike(WORDED)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates, of the least doc_id that is there.

    Rows without a word, null texts among them, are no group and stay.  A row is known by a 64-bit hash
    of its doc_id and text; of rows that have both in common one stays, and rows that share a doc_id
    but not the text are told apart.  Rows of null doc_id come after all others; among rows of the
    same doc_id the hash decides.  Whole texts count.  Further columns come through, those of the row
    that stays.  An empty table stays empty.

    Only rows that may go, a small share, are joined: a filter of fixed size tells them from the rest.
    """
    worded, key = F.coalesce(F.col("text").cast("string").rlike(WORDED), F.lit(False)), free_name(docs, "key")
    scratch, doc_id = Scratch(spark, "near"), F.col("doc_id").cast("long")
    keyed = docs.where(worded).withColumn(key, F.xxhash64(doc_id, F.col("text").cast("string")))
    groups = jaccard_components(keyed.select(F.col(key).alias("doc_id"), "text"), SHINGLE, SIMILARITY).select(F.col("doc_id").alias("row"), "component_id").distinct()
    rows = keyed.groupBy(F.col(key).alias("row")).agg(F.min(doc_id).alias("doc_id"), F.count("*").alias("n"))
    known = scratch.keep(groups.join(rows, "row"), "known")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    first = scratch.keep(known.groupBy("component_id").agg(least.alias("least")).select("component_id", F.col("least.row").alias("chosen")), "first")
    marked = known.join(first, "component_id").select("row", "n", (F.col("row") == F.col("chosen")).alias("stays")).where("n > 1 or not stays")
    marked = scratch.keep(marked, "marked")
    marked = marked.select(*[F.col(c).alias(free_name(keyed, f"marked_{c}")) for c in marked.columns])
    row, n, stays = marked.columns
    may_go = RowFilter(marked.select(row)).column(F.col(key))
    few = keyed.where(may_go).join(marked, F.col(key) == F.col(row), "left").where(F.coalesce(F.col(stays), F.lit(True)))
    one = few.where(F.coalesce(F.col(n), F.lit(1)) == 1).unionByName(few.where(F.col(n) > 1).dropDuplicates([key]))
    kept = keyed.where(~may_go).select(docs.columns).unionByName(one.select(docs.columns))
    return kept.unionByName(docs.where(~worded))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mark; no row goes.

    Null and empty texts stay as they are.  Every row's whole text is searched, whatever its doc_id,
    repeated or null.  n_chars follows the text; further columns come through.  An empty table stays
    empty.
    """
    spans = free_name(docs, "secrets")
    found = find_secrets(docs, spans)
    return _sized(found.withColumn("text", redacted(F.col("text"), F.col(spans))).select(docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a training sequence.

    Null and empty texts are one token, the end mark.  Rows that share a doc_id, or have none, are
    packed each on its own.  Long texts are cut into windows.  Further columns are not read.  An empty
    table gives no piece.
    """
    ship(spark)
    pieces = pack(docs, tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_group")


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("secret_scan", secrets),
    ("packing", packing),
]
#: Token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; every stage is written and read again, then its input goes."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.keep_only(name)
    return docs
