"""Secret scan with a trigram inverted index.

Each rule is a regular expression.  Its Boolean trigram query is derived from the expression
(``regex_trigrams``); postings of the trigrams that occur in a query are kept by segment of
documents; intersecting and uniting postings gives each rule's candidates, and only candidates are
matched.  A rule without mandatory trigrams is matched on every document.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .columns import free_name, spread
from .regex_trigrams import ANY, grams_of, trigram_query

#: Documents in a segment, about; a posting list is no longer.
SEGMENT = 4096


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (leftmost, not overlapping) whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = True


#: The first three are fixed by the query contract.
RULES: tuple[Rule, ...] = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, base=False),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, base=False),
)


def trigram_postings(docs: DataFrame, grams: list[str], segments: int) -> DataFrame:
    """(segment int, gram, docs array<long>): where each trigram occurs, in lower case.

    ``docs`` has doc_id long and text.  Rows of null doc_id or text have no postings.
    """
    known = F.array(*[F.lit(g) for g in grams])
    # a one-element array binds the lower-cased text, so that it is made once and not for every trigram
    held = F.transform(F.array(F.lower("text")), lambda t: F.filter(known, lambda g: F.contains(t, g)))[0]
    segment = F.pmod(F.xxhash64("doc_id"), F.lit(segments)).cast("int").alias("segment")
    plain = docs.where("doc_id is not null and text is not null").select(segment, "doc_id", held.alias("grams"))
    # outer: a filter inferred from an inner explode would scan the text once more
    found = plain.select("segment", F.explode_outer("grams").alias("gram"), "doc_id").where("gram is not null")
    return found.groupBy("segment", "gram").agg(F.collect_set("doc_id").alias("docs"))


def _evaluate(query: tuple, postings: Column) -> Column:
    if query[0] == "gram":
        return F.coalesce(F.try_element_at(postings, F.lit(query[1])), F.array().cast("array<long>"))
    join = F.array_intersect if query[0] == "and" else F.array_union
    return reduce(join, [_evaluate(q, postings) for q in query[1:]])


def candidates(postings: DataFrame, queries: dict[int, tuple]) -> DataFrame:
    """(doc_id, rules long): bit i is set where queries[i] holds for the document's trigrams."""
    by_segment = postings.groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct("gram", "docs"))).alias("postings"))
    found = F.array(*[F.struct(F.lit(1 << i).cast("long").alias("rule"), _evaluate(q, F.col("postings")).alias("docs")) for i, q in queries.items()])
    return by_segment.select(F.inline(found)).select("rule", F.explode("docs").alias("doc_id")).groupBy("doc_id").agg(F.bit_or("rule").alias("rules"))


def _spans(text: Column, number: int, rule: Rule) -> Column:
    """Kept matches as (start, kind, end) in code points, by way of the pieces between matches."""
    pattern = F.lit(rule.pattern)
    whole, part = F.regexp_extract_all(text, pattern, 0), F.regexp_extract_all(text, pattern, rule.group)
    pieces = F.split(text, rule.pattern, -1)
    steps = F.arrays_zip(F.slice(pieces, 1, F.size(whole)).alias("p"), whole.alias("w"), part.alias("g"))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["w"])
        one = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(x["g"]) >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    return F.when(text.rlike(rule.pattern), F.aggregate(steps, start, step, lambda a: a["out"])).otherwise(empty)


def find_secrets(docs: DataFrame, into: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with one more column ``into``: array of (start int, kind int, end int), in order.

    Needs doc_id (integer) and text.  kind is the rule's number; start and end are code points, end
    exclusive; spans of different rules may overlap.  Null and empty texts have no span; others are
    searched whole, however long.  An empty table gives an empty table.  Rows of null
    doc_id are matched against every rule; rows that share a doc_id share candidates, which cannot
    lose a match.  All columns of ``docs`` come through, whatever their names; a column named
    ``into`` is replaced.
    """
    queries = {i: trigram_query(r.pattern) for i, r in enumerate(rules)}
    indexed = {i: q for i, q in queries.items() if q != ANY}
    held = docs.drop(into)
    mask, key, own, salt = (free_name(held, n) for n in ("secret_rules", "secret_key", "secret_text", "secret_salt"))
    held = held.withColumns({key: F.col("doc_id").cast("long"), own: F.coalesce(F.col("text").cast("string"), F.lit(""))})
    every = sum(1 << i for i in queries)
    full = every - sum(1 << i for i in indexed)
    if indexed:
        plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        segments = max(1, -(-docs.count() // SEGMENT))
        grams = sorted(set().union(*[grams_of(q) for q in indexed.values()]))
        hits = candidates(trigram_postings(plain, grams, segments), indexed).select(F.col("doc_id").alias(key), spread(F.col("doc_id")).alias(salt), F.col("rules").alias(mask))
        held = held.withColumn(salt, spread(F.col(key), F.col(own))).join(hits, [key, salt], "left")
        seen = F.when(F.col(key).isNull(), F.lit(every)).otherwise(F.coalesce(F.col(mask), F.lit(0)).bitwiseOR(F.lit(full)))
    else:
        seen = F.lit(full)
    parts = [F.when(seen.bitwiseAND(F.lit(1 << i)) != 0, _spans(F.col(own), i, r)).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>")) for i, r in enumerate(rules)]
    return held.withColumn(into, F.array_sort(F.concat(*parts))).drop(mask, key, own, salt)


def span_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_spans(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin([i for i, r in enumerate(rules) if r.base]))


def redacted(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by ``mark``."""

    def step(acc: Column, s: Column) -> Column:
        between = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        fresh = (s["start"] >= acc["at"]) & (s["end"] > acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, between).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
