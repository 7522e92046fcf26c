"""The ten operators as queries over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .jaccard_join import jaccard_components
from .language_id import identify
from .line_dedup import LEAST_LINES, dedup_lines
from .packing import pack
from .quality_rules import MEASURES, ledger, passes
from .secret_scan import RULES, base_spans, find_secrets, span_text
from .sentencepiece_bpe import encode
from .shipping import ship
from .substring_dedup import dedup_substrings
from .token_counts import apply_edits, build_trees
from .vector_topk import exact_top_k

#: Fixed by the query contract: white space that separates words.
WORD = r"[^\x20\x09-\x0D]+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), "parity", "round_trip")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after three edits of every document: an insertion, a deletion and a replacement."""
    path = tokenizer_path()
    trees = build_trees(_table(spark, sf_dir, "documents"), path)
    at = lambda i: F.pmod(F.xxhash64("doc_id", F.lit(i)), F.length("text") + 1).cast("int")
    edit = lambda i, gone, new: F.struct(at(i).alias("start"), (at(i) + gone).alias("stop"), F.lit(new).alias("replacement"))
    edits = F.array(edit(1, 0, " as revised,"), edit(2, 40, ""), edit(3, 12, "2026\n"))
    out = apply_edits(trees.withColumn("edits", edits), path)
    return out.select("doc_id", F.col("n_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), "n_encoded", F.crc32(F.encode("text", "utf-8")).alias("text_crc32"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    base = base_spans(F.col("spans"))
    count = lambda i: F.size(F.filter(base, lambda s: s["kind"] == i)).cast("long")
    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(RULES) if r.base]
    return find_secrets(docs, "spans").select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = lambda: F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    out = identify(_table(spark, sf_dir, "documents"), ~held_out())
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["start"])
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", "n_chunks", "n_repeated", "n_recurring", removed.alias("removed_chars"), spans.alias("removed_spans"), "text")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), LEAST_LINES)
    return out.select("doc_id", "lines_before", "lines_removed", "chunks_all", "chunks_removed", F.sha2("text", 256).alias("text_sha256"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), words=3, percent=90)


def op5_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * 64).cast("double"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    vectors = _table(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull() & ~bad).select("vec_id", scaled.alias("embedding"))
    return exact_top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, kept = passes("base"), passes("v1")
    out = ledger(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", *[m for m in MEASURES if m != "n_lines"], (~base).alias("base_failed"), (base & kept).alias("kept"), "n_lines", "failed")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(_table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_group")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_token_counts": op2_token_counts,
    "op3_secret_scan": op3_secret_scan,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_vector_topk": op5_vector_topk,
    "op6_language_id": op6_language_id,
    "op7_line_dedup": op7_line_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_packing": op10_packing,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _secrets_sql() -> str:
    """Positions from the pieces between matches, as in a plain left-to-right scan."""
    found = []
    for i, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        found.append(f"""SELECT doc_id, {i} AS k, '{r.kind}' AS kind, regexp_extract_all(t, '{pattern}') AS m,
            regexp_extract_all(t, '{pattern}', {r.group}) AS g, string_split_regex(t, '{pattern}') AS p, {r.least} AS least FROM d WHERE regexp_matches(t, '{pattern}')""")
    base = ", ".join(str(i) for i, r in enumerate(RULES) if r.base)
    counts = ", ".join(f"count(*) FILTER (k = {i})::BIGINT AS n_{r.kind}" for i, r in enumerate(RULES) if r.base)
    names = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES if r.base)
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        f AS ({" UNION ALL ".join(found)}),
        u AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f),
        s AS (
            SELECT doc_id, k, kind, length(m[i]) AS n, (list_sum(list_transform(p[1:i], lambda x: length(x)))
                + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a
            FROM u WHERE length(g[i]) >= least),
        a AS (
            SELECT doc_id, {counts}, coalesce(string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) FILTER (k IN ({base})), '') AS base,
                string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) AS spans
            FROM s GROUP BY doc_id)
        SELECT d.doc_id, {names}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a ON a.doc_id = d.doc_id"""


ORACLES: dict[str, str] = {
    "op3_secret_scan": _secrets_sql(),
    "op4_jaccard_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{WORD}') AS w FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
            FROM w),
        n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
        x AS (SELECT doc_id, unnest(s) AS g FROM s),
        both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM both_ JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
        r(doc_id, at_) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.at_)
        SELECT n.doc_id, n.n AS n_shingles, min(r.at_) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY ALL""",
    "op5_vector_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op9_quality_rules": rf"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        w AS (
            SELECT doc_id, regexp_extract_all(text, '{WORD}') AS w, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM t),
        g AS (
            SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g
            FROM w WHERE len(w) >= 8),
        d AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
        p AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM d, range(8) r(o) GROUP BY doc_id),
        m AS (
            SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                n_symbols::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                coalesce(p.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines
            FROM w LEFT JOIN p ON p.doc_id = w.doc_id),
        f AS (
            SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (word_chars < 2 * n_words)::BIGINT
                + 8 * (word_chars > 20 * n_words)::BIGINT + 16 * (2 * n_symbols > n_words)::BIGINT + 32 * (2 * n_dup_lines > n_lines)::BIGINT AS failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, n_lines, failed FROM f""",
}
