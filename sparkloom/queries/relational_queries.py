"""Relational coverage: one query for each operator of model SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..functions.dialect import to_spark
from ..functions.statistics import entropy_frame
from ..operators.joins import as_of_join, interval_overlaps, top_n
from .tables import sql, table

#: Text that both engines run as it is.
SHARED: dict[str, str] = {
    "rel_project": "SELECT o_orderkey, o_totalprice * 2 AS twice, upper(o_orderstatus) AS st FROM orders",
    "rel_filter": "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 100000) AND NOT o_custkey IS NULL AND o_orderkey BETWEEN 10 AND 9000 AND o_orderpriority LIKE '%-%' AND o_orderstatus IN ('F', 'O')",
    "rel_inner_join": "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "rel_left_join": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000",
    "rel_right_join": "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'P'",
    "rel_full_join": "SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0) a FULL JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) b ON a.o_orderkey = b.o_orderkey",
    "rel_cross_join": "SELECT n_name, r_name FROM nation CROSS JOIN region",
    "rel_using": "SELECT doc_id, quality, lang FROM documents JOIN labels USING (doc_id)",
    "rel_self_join": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "rel_semi_in": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)",
    "rel_semi_exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')",
    "rel_anti_not_in": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)",
    "rel_anti_not_in_null": "SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 1) FROM orders)",
    "rel_anti_not_exists": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
    "rel_anti_left_join": "SELECT c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderkey IS NULL",
    "rel_null_safe": "SELECT count(*) AS n FROM (SELECT nullif(n_regionkey, 1) AS k FROM nation) a JOIN (SELECT nullif(r_regionkey, 1) AS k FROM region) b ON a.k IS NOT DISTINCT FROM b.k",
    "rel_correlated": "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "rel_derived": "SELECT st, n FROM (SELECT o_orderstatus AS st, count(*) AS n FROM orders GROUP BY o_orderstatus) AS t WHERE n > 10",
    "rel_cte": "WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), orders AS (SELECT * FROM a WHERE n > 5) SELECT o_custkey, n FROM orders",
    "rel_recursive": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT CAST(n AS BIGINT) AS n, CAST(n * n AS BIGINT) AS sq FROM t",
    "rel_group_by": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price, CAST(min(l_quantity) AS DOUBLE) AS lo, CAST(max(l_quantity) AS DOUBLE) AS hi, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "rel_group_by_all": "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL",
    "rel_group_by_position": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1",
    "rel_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "rel_having_only": "SELECT count(*) AS n FROM orders HAVING count(*) > 1",
    "rel_distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "rel_count_distinct": "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps FROM lineitem",
    "rel_filter_aggregate": "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders GROUP BY o_custkey",
    "rel_conditional": "SELECT user_id, count(CASE WHEN event_type = 'click' THEN 1 END) AS clicks, max(CASE WHEN event_type = 'view' THEN value END) AS best FROM events GROUP BY user_id",
    "rel_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "rel_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "rel_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "rel_union_all": "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region",
    "rel_union": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region",
    "rel_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    "rel_intersect": "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders",
    "rel_except_all": "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer",
    "rel_intersect_all": "SELECT l_linenumber AS k FROM lineitem INTERSECT ALL SELECT n_regionkey FROM nation",
    "rel_order_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5",
    "rel_order_nulls": "SELECT k, CAST(row_number() OVER (ORDER BY k ASC NULLS LAST, o) AS BIGINT) AS rn FROM (SELECT nullif(n_regionkey, 2) AS k, n_nationkey AS o FROM nation) AS t",
    "rel_case": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS s, CASE WHEN o_totalprice > 100000 THEN 1 END AS big FROM orders",
    "rel_cast": "SELECT o_orderkey, CAST(o_totalprice AS BIGINT) - CAST(o_totalprice AS BIGINT) AS z, CAST(o_orderkey AS VARCHAR(20)) AS t, try_cast(o_orderpriority AS INT) AS bad FROM orders",
    "rel_values": "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b)",
    "rel_sequence": "SELECT CAST(id AS BIGINT) AS n FROM range(0, 50) AS t(id)",
    "win_row_number": "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS rn FROM orders",
    "win_rank": "SELECT l_orderkey, l_linenumber, l_partkey, CAST(rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS BIGINT) AS d FROM lineitem",
    "win_lag_lead": "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events",
    "win_ntile": "SELECT c_custkey, CAST(ntile(7) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS BIGINT) AS bucket FROM customer",
    "win_first_last": "SELECT event_id, first_value(event_id) OVER w AS f, last_value(event_id) OVER w AS l, nth_value(event_id, 2) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
    "win_running": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM events",
    "win_range": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW) AS n FROM orders",
    "win_aggregate": "SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey) AS peers, count(*) OVER () AS everyone FROM customer",
    "agg_spread": "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sp, round(var_samp(l_quantity), 5) AS vs, round(var_pop(l_quantity), 5) AS vp FROM lineitem GROUP BY l_returnflag",
    "agg_median": "SELECT o_orderstatus, round(median(o_totalprice), 4) AS med FROM orders GROUP BY o_orderstatus",
    "fn_string": "SELECT p_partkey, trim(concat('  ', p_name, ' ')) AS t, CAST(length(p_name) AS BIGINT) AS n, lower(p_brand) AS lo, upper(p_name) AS up, p_name || '-' || p_brand AS cc, right(p_type, 3) AS r, substring(p_name, 2, 4) AS s, split_part(p_name, ' ', 1) AS sp, p_name LIKE '%a%' AS l FROM part",
    "fn_hash": "SELECT n_nationkey, md5(n_name) AS m FROM nation",
    "fn_math": "SELECT l_orderkey, l_partkey, abs(l_quantity - 25) AS a, l_partkey % 7 AS m, nullif(l_linenumber, 1) AS nf, coalesce(nullif(l_linenumber, 1), 0) AS c, l_linenumber / 4 AS d FROM lineitem",
    "fn_date": "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d, o_orderdate + INTERVAL '3' DAY AS later, CAST(date_trunc('month', o_orderdate) AS VARCHAR(10)) AS trunc FROM orders",
    "fn_null": "SELECT n_nationkey, nullif(n_regionkey, 1) IS DISTINCT FROM 1 AS d, coalesce(nullif(n_name, 'FRANCE'), 'none') AS c FROM nation",
}

#: (Spark text, DuckDB text) where the dialects differ.
PAIRS: dict[str, tuple[str, str]] = {
    "rel_theta": (
        "SELECT count(*) AS n FROM nation a JOIN region b ON a.n_nationkey > b.r_regionkey * 5",
        "SELECT count(*) AS n FROM nation a JOIN region b ON a.n_nationkey > b.r_regionkey * 5",
    ),
    "rel_lateral": (
        "SELECT c_custkey, top FROM customer c, LATERAL (SELECT max(o_totalprice) AS top FROM orders o WHERE o.o_custkey = c.c_custkey) t",
        "SELECT c_custkey, top FROM customer c, LATERAL (SELECT max(o_totalprice) AS top FROM orders o WHERE o.o_custkey = c.c_custkey) t",
    ),
    "rel_pivot": (
        "SELECT * FROM (SELECT user_id, event_type FROM events) PIVOT (count(*) FOR event_type IN ('click' AS click, 'view' AS view_, 'purchase' AS buy))",
        "SELECT user_id, nullif(count(*) FILTER (event_type = 'click'), 0) AS click, nullif(count(*) FILTER (event_type = 'view'), 0) AS view_, nullif(count(*) FILTER (event_type = 'purchase'), 0) AS buy FROM events GROUP BY user_id",
    ),
    "rel_unpivot": (
        "SELECT * FROM (SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS a, c_custkey * 2 AS b FROM customer) UNPIVOT (v FOR k IN (a, b))",
        "SELECT * FROM (SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS a, c_custkey * 2 AS b FROM customer) UNPIVOT (v FOR k IN (a, b))",
    ),
    "rel_star_except": ("SELECT * EXCEPT (r_name) FROM region", "SELECT * EXCLUDE (r_name) FROM region"),
    "rel_unnest": (
        "SELECT p_partkey, w FROM part LATERAL VIEW explode(split(p_name, ' ')) t AS w",
        "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part",
    ),
    "agg_percentile": (
        "SELECT o_orderstatus, round(percentile(o_totalprice, 0.9), 4) AS p FROM orders GROUP BY o_orderstatus",
        "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.9), 4) AS p FROM orders GROUP BY o_orderstatus",
    ),
    "agg_string": (
        "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    ),
    "agg_list": (
        "SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), ',') AS names, CAST(size(collect_set(n_nationkey)) AS BIGINT) AS n FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, array_to_string(list_sort(list(n_name)), ',') AS names, len(list(DISTINCT n_nationkey)) AS n FROM nation GROUP BY n_regionkey",
    ),
    "agg_first_last": (
        "SELECT o_custkey, min_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS f, max_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS l FROM orders GROUP BY o_custkey",
        "SELECT o_custkey, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS f, last(o_orderkey ORDER BY o_orderdate, o_orderkey) AS l FROM orders GROUP BY o_custkey",
    ),
    "fn_regex": (
        "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '*') AS r, p_type RLIKE '^[A-Z ]+$' AS m FROM part",
        "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '*', 'g') AS r, regexp_full_match(p_type, '[A-Z ]+') AS m FROM part",
    ),
    "fn_sha": ("SELECT n_nationkey, sha2(n_name, 256) AS s FROM nation", "SELECT n_nationkey, sha256(n_name) AS s FROM nation"),
    "fn_format": (
        "SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM-dd') AS d, format_string('%05d|%s', o_orderkey, o_orderstatus) AS p FROM orders",
        "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, printf('%05d|%s', o_orderkey, o_orderstatus) AS p FROM orders",
    ),
    "fn_div": (
        "SELECT l_orderkey, l_partkey, l_partkey div 3 AS d, isnan(l_quantity) AS nan FROM lineitem",
        "SELECT l_orderkey, l_partkey, l_partkey // 3 AS d, isnan(l_quantity) AS nan FROM lineitem",
    ),
    "fn_array": (
        "SELECT vec_id, CAST(size(embedding) AS BIGINT) AS n, embedding[0] AS first FROM embeddings",
        "SELECT vec_id, len(embedding) AS n, embedding[1] AS first FROM embeddings",
    ),
    "fn_ilike": ("SELECT p_partkey FROM part WHERE p_name ILIKE '%A%'", "SELECT p_partkey FROM part WHERE p_name ILIKE '%A%'"),
}

#: Text of the other dialect: Spark runs it through the dialect shims.
DIALECT: dict[str, str] = {
    "dia_qualify": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2",
    "dia_exclude": "SELECT * EXCLUDE (o_orderdate, o_orderpriority) FROM orders",
    "dia_replace": "SELECT * REPLACE (upper(n_name) AS n_name) FROM nation",
    "dia_json": "SELECT event_id, props->>'$.page' AS page FROM events",
    "dia_int_div": "SELECT l_orderkey, l_partkey, l_partkey // 5 AS d FROM lineitem",
    "dia_cast": "SELECT o_orderkey, o_orderkey::VARCHAR AS t, '5'::INTEGER AS five FROM orders",
}


def rel_as_of(spark, sf_dir):
    """Each purchase with the user's last view before it."""
    e = table(spark, sf_dir, "events")
    buys = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = e.where("event_type = 'view'").select(F.col("user_id").alias("u"), F.col("ts").alias("vts"), F.col("event_id").alias("view_id")).withColumnRenamed("u", "user_id")
    return as_of_join(buys, views, ["user_id"], "ts", "vts", ["vts", "view_id"]).select("event_id", "view_id")


def rel_top_n(spark, sf_dir):
    return top_n(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


def rel_overlaps(spark, sf_dir):
    spans = sql(spark, sf_dir, "SELECT n_nationkey * 10 AS s, n_nationkey * 10 + CASE WHEN n_nationkey % 5 = 0 THEN 25 ELSE 5 END AS e FROM nation")
    return interval_overlaps(spans, "s", "e")


def agg_entropy(spark, sf_dir):
    return entropy_frame(table(spark, sf_dir, "events"), "event_type").select(F.round("entropy", 9).alias("entropy"))


def _plain(text: str) -> Callable:
    return lambda spark, sf_dir: sql(spark, sf_dir, text)


def _shimmed(text: str) -> Callable:
    def run(spark, sf_dir):
        return sql(spark, sf_dir, to_spark(spark, text, lambda name: table(spark, sf_dir, name).columns))

    return run


QUERIES = (
    {n: _plain(t) for n, t in SHARED.items()}
    | {n: _plain(p[0]) for n, p in PAIRS.items()}
    | {n: _shimmed(t) for n, t in DIALECT.items()}
    | {"rel_as_of": rel_as_of, "rel_top_n": rel_top_n, "rel_overlaps": rel_overlaps, "agg_entropy": agg_entropy}
)
ORACLES = (
    dict(SHARED)
    | {n: p[1] for n, p in PAIRS.items()}
    | DIALECT
    | {
        "rel_as_of": """WITH b AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
            v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL)
            SELECT b.event_id, v.view_id FROM b ASOF LEFT JOIN v ON b.user_id = v.user_id AND b.ts >= v.ts""",
        "rel_top_n": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3",
        "rel_overlaps": "WITH t AS (SELECT n_nationkey * 10 AS s, n_nationkey * 10 + CASE WHEN n_nationkey % 5 = 0 THEN 25 ELSE 5 END AS e FROM nation) SELECT * FROM t b WHERE EXISTS (SELECT 1 FROM t a WHERE a.s < b.s AND a.e > b.s)",
        "agg_entropy": "SELECT round(entropy(event_type), 9) AS entropy FROM events",
    }
)
