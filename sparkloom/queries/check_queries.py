"""One query for each check: the check over a whole table, against plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.checks import EMAIL, Context, report
from .tables import sql, table

# Relations with nulls and odd values put in; the same text runs in both engines.
EVENTS = "SELECT event_id, ts, user_id, nullif(event_type, 'error') AS kind, CASE WHEN value > 50 THEN value END AS value, CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END AS uid FROM events"
PEOPLE = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN c_name ELSE concat('u', CAST(c_custkey AS VARCHAR(20)), '@example.com') END AS email, CASE WHEN c_custkey % 9 = 0 THEN 'x' ELSE '123e4567-e89b-12d3-a456-426614174000' END AS token, CASE WHEN c_custkey % 13 = 0 THEN 'n/a' ELSE CAST(c_custkey AS VARCHAR(20)) END AS code FROM customer"
STEPS = "SELECT o_orderkey, o_orderkey * 2 - CASE WHEN o_orderkey % 100 = 0 THEN 1 ELSE 0 END AS seq, o_orderdate FROM orders WHERE o_orderkey % 3 <> 0"
SPANS = "SELECT o_orderkey * 10 AS s, o_orderkey * 10 + CASE WHEN o_orderkey % 50 = 0 THEN 35 ELSE 5 END AS e FROM orders"
FLOATS = "SELECT event_id, CASE WHEN event_id % 17 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 19 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN event_id % 23 = 0 THEN NULL ELSE value END AS v FROM events"
PRICES = "SELECT l_orderkey, l_extendedprice, l_quantity, l_discount FROM lineitem"

#: query: (stage, directive, relation, violations in SQL over r)
CHECKS: dict[str, tuple[str, str, str, str]] = {
    "chk_not_null": ("constraint", "not_null(value)", EVENTS, "SELECT count(*) FROM r WHERE value IS NULL"),
    "chk_not_empty": ("constraint", "not_empty(kind)", EVENTS, "SELECT count(*) FROM r WHERE kind IS NULL OR trim(kind) = ''"),
    "chk_at_least_one": ("constraint", "at_least_one(kind)", EVENTS, "SELECT CASE WHEN count(kind) = 0 THEN 1 ELSE 0 END FROM r"),
    "chk_null_percent": ("constraint", "null_percent(uid, 10)", EVENTS, "SELECT CASE WHEN 100.0 * count(*) FILTER (uid IS NULL) / count(*) >= 10 THEN 1 ELSE 0 END FROM r"),
    "chk_unique": ("constraint", "unique(uid)", EVENTS, "SELECT count(*) FROM (SELECT uid FROM r GROUP BY uid HAVING count(*) > 1)"),
    "chk_composite_unique": ("constraint", "composite_unique(c_nationkey, c_mktsegment)", PEOPLE, "SELECT count(*) FROM (SELECT 1 FROM r GROUP BY c_nationkey, c_mktsegment HAVING count(*) > 1)"),
    "chk_primary_key": ("constraint", "primary_key(email)", PEOPLE, "SELECT (SELECT count(*) FROM r WHERE email IS NULL) + (SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM r GROUP BY email))"),
    "chk_compare": ("constraint", "compare(value, >=, 60)", EVENTS, "SELECT count(*) FROM r WHERE NOT (value >= 60)"),
    "chk_between": ("constraint", "between(l_discount, 0.01, 0.08)", PRICES, "SELECT count(*) FROM r WHERE l_discount < 0.01::DOUBLE OR l_discount > 0.08::DOUBLE"),
    "chk_in_list": ("constraint", "in_list(kind, 'click, view')", EVENTS, "SELECT count(*) FROM r WHERE kind NOT IN ('click', 'view')"),
    "chk_not_in": ("constraint", "not_in(kind, 'signup,purchase')", EVENTS, "SELECT count(*) FROM r WHERE kind IN ('signup', 'purchase')"),
    "chk_not_constant": ("constraint", "not_constant(c_mktsegment)", PEOPLE, "SELECT CASE WHEN count(DISTINCT c_mktsegment) < 2 THEN 1 ELSE 0 END FROM r"),
    "chk_like": ("constraint", "like(email, 'u%@example.com')", PEOPLE, "SELECT count(*) FROM r WHERE email NOT LIKE 'u%@example.com'"),
    "chk_not_like": ("constraint", "not_like(email, 'u1%')", PEOPLE, "SELECT count(*) FROM r WHERE email LIKE 'u1%'"),
    "chk_matches": ("constraint", "matches(code, '[0-9]{1,3}')", PEOPLE, "SELECT count(*) FROM r WHERE NOT regexp_full_match(code, '[0-9]{1,3}')"),
    "chk_email": ("constraint", "email(email)", PEOPLE, f"SELECT count(*) FROM r WHERE email IS NOT NULL AND NOT regexp_full_match(email, '{EMAIL}')"),
    "chk_uuid": ("constraint", "uuid(token)", PEOPLE, "SELECT count(*) FROM r WHERE token IS NOT NULL AND try_cast(token AS UUID) IS NULL"),
    "chk_valid_type": ("constraint", "valid_type(code, INTEGER)", PEOPLE, "SELECT count(*) FROM r WHERE code IS NOT NULL AND try_cast(code AS INTEGER) IS NULL"),
    "chk_length_between": ("constraint", "length_between(code, 2, 3)", PEOPLE, "SELECT count(*) FROM r WHERE length(code) < 2 OR length(code) > 3"),
    "chk_length_eq": ("constraint", "length_eq(code, 4)", PEOPLE, "SELECT count(*) FROM r WHERE length(code) <> 4"),
    "chk_references": ("constraint", "references(uid, customer, c_custkey)", EVENTS, "SELECT count(*) FROM r WHERE uid IS NOT NULL AND uid NOT IN (SELECT c_custkey FROM customer)"),
    "chk_references_null": ("constraint", "references(event_id, nullable, k)", EVENTS, "SELECT count(*) FROM r WHERE event_id NOT IN (SELECT nullif(c_custkey, 5) FROM customer)"),
    "chk_sequential": ("constraint", "sequential(seq)", STEPS, "SELECT count(*) FROM (SELECT seq - lag(seq) OVER (ORDER BY seq) AS d FROM r) WHERE d > 1"),
    "chk_sequential_step": ("constraint", "sequential_step(seq, 3)", STEPS, "SELECT count(*) FROM (SELECT seq - lag(seq) OVER (ORDER BY seq) AS d FROM r) WHERE d > 3"),
    "chk_distinct_count": ("constraint", "distinct_count(c_mktsegment, =, 4)", PEOPLE, "SELECT CASE WHEN count(DISTINCT c_mktsegment) = 4 THEN 0 ELSE 1 END FROM r"),
    "chk_duplicate_percent": ("constraint", "duplicate_percent(uid, 50)", EVENTS, "SELECT CASE WHEN (count(*) - count(DISTINCT uid)) * 100.0 / count(*) >= 50 THEN 1 ELSE 0 END FROM r"),
    "chk_no_overlap": ("constraint", "no_overlap(s, e)", SPANS, "SELECT count(*) FROM r b WHERE EXISTS (SELECT 1 FROM r a WHERE a.s < b.s AND a.s > b.s - 40 AND a.e > b.s)"),
    "chk_no_nan": ("constraint", "no_nan(v)", FLOATS, "SELECT count(*) FROM r WHERE isnan(v)"),
    "chk_finite": ("constraint", "finite(v)", FLOATS, "SELECT count(*) FROM r WHERE NOT isfinite(v)"),
    "chk_required_if": ("constraint", "required_if(uid, kind = 'click')", EVENTS, "SELECT count(*) FROM r WHERE kind = 'click' AND uid IS NULL"),
    "chk_check": ("constraint", "check(label, value < 100 OR kind = 'view')", EVENTS, "SELECT count(*) FROM r WHERE NOT (value < 100 OR kind = 'view')"),
    "aud_row_count": ("audit", "row_count(>=, 100000000)", EVENTS, "SELECT CASE WHEN count(*) >= 100000000 THEN 0 ELSE 1 END FROM r"),
    "aud_freshness": ("audit", "freshness(ts, 24h)", EVENTS, "SELECT CASE WHEN max(ts) IS NULL OR max(ts) < TIMESTAMP '2024-02-05 00:00:00' - INTERVAL 24 HOUR THEN 1 ELSE 0 END FROM r"),
    "aud_mean_between": ("audit", "mean_between(l_quantity, 20, 30)", PRICES, "SELECT CASE WHEN avg(l_quantity) BETWEEN 20 AND 30 THEN 0 ELSE 1 END FROM r"),
    "aud_mean": ("audit", "mean(l_quantity, <, 10)", PRICES, "SELECT CASE WHEN avg(l_quantity) < 10 THEN 0 ELSE 1 END FROM r"),
    "aud_median": ("audit", "median(l_quantity, >=, 20)", PRICES, "SELECT CASE WHEN median(l_quantity) >= 20 THEN 0 ELSE 1 END FROM r"),
    "aud_stddev": ("audit", "stddev(l_quantity, 10)", PRICES, "SELECT CASE WHEN stddev(l_quantity) >= 10 THEN 1 ELSE 0 END FROM r"),
    "aud_min": ("audit", "min(l_quantity, >=, 1)", PRICES, "SELECT CASE WHEN min(l_quantity) >= 1 THEN 0 ELSE 1 END FROM r"),
    "aud_max": ("audit", "max(l_quantity, <, 50)", PRICES, "SELECT CASE WHEN max(l_quantity) < 50 THEN 0 ELSE 1 END FROM r"),
    "aud_sum": ("audit", "sum(l_orderkey, >, 0)", PRICES, "SELECT CASE WHEN sum(l_orderkey) > 0 THEN 0 ELSE 1 END FROM r"),
    "aud_zscore": ("audit", "zscore(l_extendedprice, 1.5)", PRICES, "SELECT count(*) FROM r, (SELECT avg(l_extendedprice) AS m, stddev(l_extendedprice) AS s FROM r) WHERE abs(l_extendedprice - m) / s >= 1.5"),
    "aud_percentile": ("audit", "percentile(l_quantity, 0.9, <=, 40)", PRICES, "SELECT CASE WHEN quantile_cont(l_quantity, 0.9) <= 40 THEN 0 ELSE 1 END FROM r"),
    "aud_entropy": ("audit", "entropy(kind, >=, 1.5)", EVENTS, "SELECT CASE WHEN entropy(kind) >= 1.5 THEN 0 ELSE 1 END FROM r"),
    "aud_approx_distinct": ("audit", "approx_distinct(kind, <=, 100)", EVENTS, "SELECT CASE WHEN approx_count_distinct(kind) <= 100 THEN 0 ELSE 1 END FROM r"),
    "aud_reconcile_count": ("audit", "reconcile_count(customer)", EVENTS, "SELECT CASE WHEN count(*) <> (SELECT count(*) FROM customer) THEN 1 ELSE 0 END FROM r"),
    "aud_reconcile_sum": ("audit", "reconcile_sum(c_custkey, customer, c_custkey)", PEOPLE, "SELECT CASE WHEN sum(c_custkey) IS DISTINCT FROM (SELECT sum(c_custkey) FROM customer) THEN 1 ELSE 0 END FROM r"),
    "aud_column_exists": ("audit", "column_exists(nothing)", EVENTS, "SELECT 1"),
    "aud_column_type": ("audit", "column_type(user_id, BIGINT)", EVENTS, "SELECT CASE WHEN typeof(any_value(user_id)) <> 'BIGINT' THEN 1 ELSE 0 END FROM r"),
    "wrn_freshness": ("warning", "freshness(ts, 7d)", EVENTS, "SELECT CASE WHEN max(ts) < TIMESTAMP '2024-02-05 00:00:00' - INTERVAL 7 DAY THEN 1 ELSE 0 END FROM r"),
    "wrn_row_count": ("warning", "row_count(<, 10)", EVENTS, "SELECT CASE WHEN count(*) < 10 THEN 0 ELSE 1 END FROM r"),
    "wrn_row_count_delta": ("warning", "row_count_delta(5)", EVENTS, "SELECT CASE WHEN (SELECT count(*) FROM r WHERE event_id % 10 = 0) * 100.0 / count(*) > 5 THEN 1 ELSE 0 END FROM r"),
    "wrn_sum_delta": ("warning", "sum_delta(value, 20)", EVENTS, "SELECT CASE WHEN (SELECT count(*) FROM r WHERE event_id % 10 = 0) * 100.0 / count(*) > 20 THEN 1 ELSE 0 END FROM r"),
    "wrn_mean_delta": ("warning", "mean_delta(value, 2)", EVENTS, "SELECT CASE WHEN (SELECT count(*) FROM r WHERE event_id % 10 = 0) * 100.0 / count(*) > 2 THEN 1 ELSE 0 END FROM r"),
    "wrn_approaching_limit": ("warning", "approaching_limit(value)", EVENTS, "SELECT CASE WHEN max(value) > 0.9 * 100 THEN 1 ELSE 0 END FROM r"),
    "wrn_null_percent": ("warning", "null_percent(value, 1)", EVENTS, "SELECT CASE WHEN 100.0 * count(*) FILTER (value IS NULL) / count(*) >= 1 THEN 1 ELSE 0 END FROM r"),
    "wrn_not_null": ("warning", "not_null(kind)", EVENTS, "SELECT count(*) FROM r WHERE kind IS NULL"),
    "wrn_unique": ("warning", "unique(event_id)", EVENTS, "SELECT count(*) FROM (SELECT event_id FROM r GROUP BY event_id HAVING count(*) > 1)"),
    "wrn_min": ("warning", "min(value, >, 50)", EVENTS, "SELECT CASE WHEN min(value) > 50 THEN 0 ELSE 1 END FROM r"),
    "wrn_compare": ("warning", "compare(user_id, <, 100)", EVENTS, "SELECT count(*) FROM r WHERE NOT (user_id < 100)"),
    "wrn_mean": ("warning", "mean(value, >=, 1000)", EVENTS, "SELECT CASE WHEN avg(value) >= 1000 THEN 0 ELSE 1 END FROM r"),
    "wrn_low_entropy": ("warning", "low_entropy(c_mktsegment, 3)", PEOPLE, "SELECT CASE WHEN entropy(c_mktsegment) < 3 THEN 1 ELSE 0 END FROM r"),
    "wrn_cardinality": ("warning", "cardinality(kind, >=, 2)", EVENTS, "SELECT CASE WHEN approx_count_distinct(kind) >= 2 THEN 0 ELSE 1 END FROM r"),
}


def _query(stage: str, directive: str, relation: str):
    def run(spark, sf_dir):
        def other(name):
            if name == "nullable":
                return table(spark, sf_dir, "customer").select(F.nullif("c_custkey", F.lit(5)).alias("k"))
            return table(spark, sf_dir, name)

        changed = sql(spark, sf_dir, EVENTS).where("event_id % 10 = 0").select(F.lit("insert").alias("change_type"))
        now = F.lit("2024-02-05 00:00:00").cast("timestamp")
        ctx = Context(table=other, now=now, changes=changed, variables={"alert_amount_threshold": 100})
        return report(sql(spark, sf_dir, relation), stage, [directive], ctx)

    return run


def _oracle(directive: str, relation: str, violations: str) -> str:
    name = directive.replace("'", "''")
    return f"WITH r AS ({relation}), v AS (SELECT ({violations})::BIGINT AS violations) SELECT '{name}' AS \"check\", violations, violations = 0 AS passed FROM v"


BATCH = ["not_null(value)", "compare(value, >=, 60)", "in_list(kind, 'click, view')", "unique(event_id)", "distinct_count(kind, >=, 2)"]


def chk_batch(spark, sf_dir):
    """Several checks of one table: those on aggregates share a single pass."""
    return report(sql(spark, sf_dir, EVENTS), "constraint", BATCH)


QUERIES = {name: _query(*c[:3]) for name, c in CHECKS.items()} | {"chk_batch": chk_batch}
ORACLES = {name: _oracle(c[1], c[2], c[3]) for name, c in CHECKS.items()}
ORACLES["chk_batch"] = f"""
    WITH r AS ({EVENTS}), v AS (
        SELECT '{BATCH[0]}' AS c, (SELECT count(*) FROM r WHERE value IS NULL) AS n
        UNION ALL SELECT '{BATCH[1]}', (SELECT count(*) FROM r WHERE NOT (value >= 60))
        UNION ALL SELECT '{BATCH[2].replace("'", "''")}', (SELECT count(*) FROM r WHERE kind NOT IN ('click', 'view'))
        UNION ALL SELECT '{BATCH[3]}', (SELECT count(*) FROM (SELECT 1 FROM r GROUP BY event_id HAVING count(*) > 1))
        UNION ALL SELECT '{BATCH[4]}', (SELECT CASE WHEN count(DISTINCT kind) >= 2 THEN 0 ELSE 1 END FROM r))
    SELECT c AS "check", n::BIGINT AS violations, n = 0 AS passed FROM v"""
