"""Materialization kinds, change capture, comparison and masking over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.masking import apply_masks
from ..functions.macros import cents_to_dollars, column_profile, safe_divide
from ..operators import cdc, compare, kinds
from .tables import sql, table

ORDER = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"
# The state before, and the source of a later run: some orders gone, some changed, some new.
OLD = f"SELECT {ORDER} FROM orders WHERE o_orderkey % 5 <> 0"
NEW = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 11 <> 0"
COUNTS = "SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last_order FROM {} GROUP BY o_custkey"
CUSTOMER_OLD = "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 6 <> 0"
CUSTOMER_NEW = "SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 9 <> 0"
SNAPSHOT = 7


def _both(spark, sf_dir):
    return sql(spark, sf_dir, OLD), sql(spark, sf_dir, NEW)


def kind_table(spark, sf_dir):
    return kinds.full_table(sql(spark, sf_dir, NEW)).table


def kind_append(spark, sf_dir):
    old, new = _both(spark, sf_dir)
    return kinds.append(old, new).table


def kind_merge(spark, sf_dir):
    old, new = _both(spark, sf_dir)
    return kinds.merge(old, new, "o_orderkey").table


def kind_scd2(spark, sf_dir):
    old = kinds.scd2(None, sql(spark, sf_dir, CUSTOMER_OLD), "c_custkey", 3).table
    return kinds.scd2(old, sql(spark, sf_dir, CUSTOMER_NEW), "c_custkey", SNAPSHOT).table


def kind_scd2_affected(spark, sf_dir):
    old = kinds.scd2(None, sql(spark, sf_dir, CUSTOMER_OLD), "c_custkey", 3).table
    return kinds.scd2(old, sql(spark, sf_dir, CUSTOMER_NEW), "c_custkey", SNAPSHOT).affected


def _tracked(spark, sf_dir):
    old, new = _both(spark, sf_dir)
    return kinds.tracked(kinds.tracked(None, old, ["o_custkey"]).table, new, ["o_custkey"])


def kind_tracked(spark, sf_dir):
    return _tracked(spark, sf_dir).table.drop(kinds.HASH_COLUMN)


def kind_tracked_affected(spark, sf_dir):
    return _tracked(spark, sf_dir).affected


def cdc_delta(spark, sf_dir):
    old, new = _both(spark, sf_dir)
    return cdc.delta(new, old)


def cdc_empty(spark, sf_dir):
    return cdc.empty(sql(spark, sf_dir, NEW)).agg(F.count(F.lit(1)).alias("n"))


def cdc_delta_aggregate(spark, sf_dir):
    old, new = _both(spark, sf_dir)
    return cdc.delta(new, old).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


def cdc_delta_join_dimension(spark, sf_dir):
    """The fact's delta against the whole dimension."""
    old, new = _both(spark, sf_dir)
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return cdc.delta(new, old).join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def cdc_row_changes(spark, sf_dir):
    old, new = _both(spark, sf_dir)
    return cdc.row_changes(old, new, "o_orderkey")


def cdc_cursor(spark, sf_dir):
    last = cdc.cursor_state(table(spark, sf_dir, "events").where("ts < '2024-01-10'"), "ts")
    return cdc.after_cursor(table(spark, sf_dir, "events"), "ts", last).agg(F.count(F.lit(1)).alias("n"))


def diff_tables(spark, sf_dir):
    return compare.table_diff(*_both(spark, sf_dir))


def diff_counts(spark, sf_dir):
    return compare.compare_tables(*_both(spark, sf_dir))


def diff_sandbox(spark, sf_dir):
    return compare.sandbox_diff(*_both(spark, sf_dir))["counts"]


def macro_duplicates(spark, sf_dir):
    return compare.duplicate_count(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def macro_profile(spark, sf_dir):
    return column_profile(table(spark, sf_dir, "orders"), "o_custkey")


def macro_helpers(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return df.select("l_orderkey", F.round(safe_divide(F.col("l_extendedprice"), F.col("l_discount") + 0.0), 4).alias("ratio"), cents_to_dollars(F.col("l_linenumber")).cast("double").alias("dollars"))


MASKED = "SELECT c_custkey, concat(c_name, '@example.com') AS email, concat('123-45-', CAST(1000 + c_custkey AS VARCHAR(10))) AS ssn, c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer"


def mask_columns(spark, sf_dir):
    tags = {"email": ["pii", "mask_email"], "ssn": ["mask_ssn"], "name": ["hash_pii"], "segment": ["redact"], "c_custkey": ["hash_pii"]}
    return apply_masks(sql(spark, sf_dir, MASKED), tags, keys=["c_custkey"])


QUERIES = {
    f.__name__: f
    for f in (
        kind_table, kind_append, kind_merge, kind_scd2, kind_scd2_affected, kind_tracked, kind_tracked_affected, cdc_delta, cdc_empty, cdc_delta_aggregate,
        cdc_delta_join_dimension, cdc_row_changes, cdc_cursor, diff_tables, diff_counts, diff_sandbox, macro_duplicates, macro_profile, macro_helpers, mask_columns,
    )
}

_PAIR = f"WITH o AS ({OLD}), n AS ({NEW})"
_SCD2 = f"""WITH o AS ({CUSTOMER_OLD}), n AS ({CUSTOMER_NEW}),
    c AS (SELECT n.*, o.c_custkey IS NULL AS fresh, o.c_custkey IS NULL OR n.c_name IS DISTINCT FROM o.c_name OR n.c_mktsegment IS DISTINCT FROM o.c_mktsegment AS moved
        FROM n LEFT JOIN o ON n.c_custkey = o.c_custkey)"""
_TRACKED = f"""{_PAIR},
    og AS (SELECT o_custkey, string_agg(concat_ws('|', o_orderkey, o_orderstatus, o_totalprice), ';' ORDER BY o_orderkey) AS g FROM o GROUP BY o_custkey),
    ng AS (SELECT o_custkey, string_agg(concat_ws('|', o_orderkey, o_orderstatus, o_totalprice), ';' ORDER BY o_orderkey) AS g FROM n GROUP BY o_custkey)"""
ORACLES = {
    "kind_table": NEW,
    "kind_append": f"{OLD} UNION ALL {NEW}",
    "kind_merge": f"{_PAIR} SELECT * FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n) UNION ALL SELECT * FROM n",
    "kind_scd2": f"""{_SCD2}
        SELECT o.*, 3::BIGINT AS valid_from_snapshot, CASE WHEN c.c_custkey IS NULL OR c.moved THEN 6 END::BIGINT AS valid_to_snapshot,
            NOT (c.c_custkey IS NULL OR c.moved) AS is_current FROM o LEFT JOIN c ON c.c_custkey = o.c_custkey
        UNION ALL SELECT c_custkey, c_name, c_mktsegment, 7, NULL, true FROM c WHERE moved""",
    "kind_scd2_affected": f"{_SCD2} SELECT count(*) AS rows FROM c WHERE moved",
    "kind_tracked": NEW,
    "kind_tracked_affected": f"{_TRACKED} SELECT count(*) AS rows FROM n WHERE o_custkey IN (SELECT ng.o_custkey FROM ng LEFT JOIN og ON og.o_custkey = ng.o_custkey WHERE og.g IS DISTINCT FROM ng.g)",
    "cdc_delta": f"{NEW} EXCEPT {OLD}",
    "cdc_empty": "SELECT 0::BIGINT AS n",
    "cdc_delta_aggregate": f"WITH d AS ({NEW} EXCEPT {OLD}) SELECT o_custkey, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM d GROUP BY o_custkey",
    "cdc_delta_join_dimension": f"WITH d AS ({NEW} EXCEPT {OLD}) SELECT c_mktsegment, count(*) AS n FROM d JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "cdc_row_changes": f"""{_PAIR}, b AS (SELECT n.o_orderkey FROM n JOIN o ON o.o_orderkey = n.o_orderkey WHERE n.o_orderstatus IS DISTINCT FROM o.o_orderstatus)
        SELECT o_orderkey, 'insert' AS change_type, o_custkey, o_orderstatus, o_totalprice FROM n WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o)
        UNION ALL SELECT o_orderkey, 'delete', o_custkey, o_orderstatus, o_totalprice FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n)
        UNION ALL SELECT o_orderkey, 'update_preimage', o_custkey, o_orderstatus, o_totalprice FROM o WHERE o_orderkey IN (SELECT o_orderkey FROM b)
        UNION ALL SELECT o_orderkey, 'update_postimage', o_custkey, o_orderstatus, o_totalprice FROM n WHERE o_orderkey IN (SELECT o_orderkey FROM b)""",
    "cdc_cursor": "SELECT count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '2024-01-10')",
    "diff_tables": f"SELECT *, 'left' AS _source FROM ({OLD} EXCEPT {NEW}) UNION ALL SELECT *, 'right' FROM ({NEW} EXCEPT {OLD})",
    "diff_counts": f"SELECT (SELECT count(*) FROM ({OLD} EXCEPT {NEW})) AS only_left, (SELECT count(*) FROM ({NEW} EXCEPT {OLD})) AS only_right, (SELECT count(*) FROM ({NEW} INTERSECT {OLD})) AS matching",
    "diff_sandbox": f"SELECT (SELECT count(*) FROM ({OLD} EXCEPT {NEW})) AS removed, (SELECT count(*) FROM ({NEW} EXCEPT {OLD})) AS added, (SELECT count(*) FROM ({NEW} INTERSECT {OLD})) AS matching",
    "macro_duplicates": "SELECT sum(n - 1)::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)",
    "macro_profile": "SELECT count(*) AS rows, count(*) FILTER (o_custkey IS NULL) AS nulls, count(DISTINCT o_custkey) AS distinct_values, min(o_custkey) AS least, max(o_custkey) AS greatest FROM orders",
    "macro_helpers": "SELECT l_orderkey, round(CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice / l_discount END, 4) AS ratio, (l_linenumber / 100.0)::DOUBLE AS dollars FROM lineitem",
    "mask_columns": f"SELECT c_custkey, regexp_replace(email, '(.).*@', '\\1***@') AS email, '***-**-' || right(ssn, 4) AS ssn, sha256(name) AS name, '[REDACTED]' AS segment FROM ({MASKED})",
}
