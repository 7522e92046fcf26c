"""Whole runs: models, kinds, evolution, macros and files through the runner and the lake, next to the same in SQL."""

from __future__ import annotations

from .. import inspect
from ..functions.dialect import to_spark
from ..functions.sqlmacros import Macros
from ..lake import Lake
from ..model import parse_model
from ..operators import cdc
from ..plans.bind import bind
from ..runner import Runner
from ..shared import own_folder
from ..sources.files import READERS
from .tables import table

TABLES = ("orders", "customer", "nation")


def _lake(spark, sf_dir) -> Lake:
    lake = Lake(spark, own_folder(spark, "lake"))
    for name in TABLES:
        lake.attach(f"raw.{name}", f"{sf_dir}/{name}.parquet")
    return lake


def _runs(spark, sf_dir, name: str, *versions: str, macros: list[str] = ()) -> tuple[Lake, list]:
    """The table after a run of each version of its model; between runs the staging table changes with ``source``."""
    lake, results = _lake(spark, sf_dir), []
    for text in versions:
        source, _, model = text.partition("---")
        batch = [parse_model(source.strip(), "staging.s")] if model else []
        batch.append(parse_model((model or text).strip(), name))
        results += Runner(spark, lake, macros=macros).run_all(batch)
        if bad := [r.error for r in results if r.error]:
            raise RuntimeError(bad[0])
    return lake, results


EVEN = "SELECT o_orderkey AS id, o_custkey AS cust, o_totalprice AS price FROM raw.orders WHERE o_orderkey % 2 = 0"
THIRD = "SELECT o_orderkey AS id, o_custkey AS cust, o_totalprice + 1 AS price FROM raw.orders WHERE o_orderkey % 3 = 0"
MERGE = "-- @kind: merge\n-- @unique_key: id\nSELECT id, cust, price FROM staging.s"
SCD2 = "-- @kind: scd2\n-- @unique_key: id\nSELECT id, cust, price FROM staging.s"
TRACKED = "-- @kind: tracked\n-- @group_key: cust\nSELECT id, cust, price FROM staging.s"
APPEND = "-- @kind: append\nSELECT id, cust, price FROM staging.s"


def lake_time_travel(spark, sf_dir):
    lake, results = _runs(spark, sf_dir, "mart.t", f"{EVEN}---{MERGE}", f"{THIRD}---{MERGE}")
    return lake.read("mart.t", results[1].snapshot)


def lake_change_feed(spark, sf_dir):
    lake, results = _runs(spark, sf_dir, "mart.t", f"{EVEN}---{MERGE}", f"{THIRD}---{MERGE}")
    return lake.changes("mart.t", results[1].snapshot + 1, lake.log.last()).select("change_type", "id", "price")


def lake_snapshots(spark, sf_dir):
    lake, _ = _runs(spark, sf_dir, "mart.t", f"{EVEN}---{MERGE}", f"{THIRD}---{MERGE}")
    return lake.snapshots().where("model is not null").select("model", "kind", "run_type", "rows_affected")


def lake_insert_only(spark, sf_dir):
    lake, _ = _runs(spark, sf_dir, "mart.t", f"{EVEN}---{MERGE}", f"{THIRD}---{MERGE}")
    found = cdc.insert_only(lake.changes("mart.t", 0, lake.log.last()))
    return found.selectExpr("CAST(dense_rank() OVER (ORDER BY snapshot_id) AS INT) AS version", "insert_only")


def lin_overview(spark, sf_dir):
    lake, _ = _runs(spark, sf_dir, "mart.t", f"{EVEN}---{MERGE}")
    return inspect.lineage_overview(lake)


def lin_trace(spark, sf_dir):
    lake, _ = _runs(spark, sf_dir, "mart.t", f"{EVEN}---SELECT id, price * 2 AS twice FROM staging.s")
    return inspect.column_trace(lake, "mart.t", "twice")


def lin_tree(spark, sf_dir):
    lake, _ = _runs(spark, sf_dir, "mart.t", f"{EVEN}---{MERGE}")
    rows = [(way, i, x) for way in ("up", "down") for i, x in enumerate(inspect.lineage_tree(lake, "mart.t" if way == "up" else "raw.orders", way == "down"))]
    return spark.createDataFrame(rows, "way string, line int, text string")


def run_merge(spark, sf_dir):
    return _runs(spark, sf_dir, "mart.t", f"{EVEN}---{MERGE}", f"{THIRD}---{MERGE}")[0].read("mart.t")


def run_scd2(spark, sf_dir):
    found = _runs(spark, sf_dir, "mart.t", f"{EVEN}---{SCD2}", f"{THIRD}---{SCD2}")[0].read("mart.t")
    return found.selectExpr("id", "price", "is_current", "valid_to_snapshot IS NULL AS open")


def run_tracked(spark, sf_dir):
    return _runs(spark, sf_dir, "mart.t", f"{EVEN}---{TRACKED}", f"{THIRD}---{TRACKED}")[0].read("mart.t").select("id", "cust", "price")


def run_append(spark, sf_dir):
    return _runs(spark, sf_dir, "mart.t", f"{EVEN}---{APPEND}", f"{THIRD}---{APPEND}")[0].read("mart.t")


def run_gate(spark, sf_dir):
    """A run without a change adds nothing."""
    return _runs(spark, sf_dir, "mart.t", f"{EVEN}---{APPEND}", f"{EVEN}---{APPEND}", f"{EVEN}---{APPEND}")[0].read("mart.t")


def run_added_column(spark, sf_dir):
    """A new column: a full delta with it, old rows null."""
    wide = "SELECT o_orderkey AS id, o_custkey AS cust, o_totalprice AS price, o_orderdate AS day FROM raw.orders WHERE o_orderkey % 2 = 0"
    return _runs(spark, sf_dir, "mart.t", f"{EVEN}---{MERGE}", f"{wide}---{MERGE.replace('price FROM', 'price, day FROM')}")[0].read("mart.t")


def run_renamed_column(spark, sf_dir):
    """A column under a new name keeps its values; the changed query's rows are appended."""
    return _runs(spark, sf_dir, "mart.t", f"{EVEN}---{APPEND}", f"{EVEN}---{APPEND.replace('price FROM', 'price AS amount FROM')}")[0].read("mart.t").select("id", "cust", "amount")


def run_widened_column(spark, sf_dir):
    """INTEGER to BIGINT: the old rows are cast, the table keeps them."""
    text = "-- @kind: append\nSELECT id, CAST(cust AS {}) AS cust FROM staging.s"
    return _runs(spark, sf_dir, "mart.t", f"{EVEN}---{text.format('INT')}", f"{THIRD}---{text.format('BIGINT')}")[0].read("mart.t").select("id", "cust")


def run_key_type(spark, sf_dir):
    """A key of another type: the table is made anew."""
    return _runs(spark, sf_dir, "mart.t", f"{EVEN}---{MERGE}", f"{THIRD}---{MERGE.replace('SELECT id', 'SELECT CAST(id AS STRING) AS id')}")[0].read("mart.t")


def run_schema_change(spark, sf_dir):
    """A changed schema upstream: a backfill instead of a delta."""
    text = f"{EVEN}---{APPEND}"
    return _runs(spark, sf_dir, "mart.t", text, f"SELECT o_orderkey AS id, o_custkey AS cust, o_totalprice AS price, 1 AS more FROM raw.orders WHERE o_orderkey % 3 = 0---{APPEND}")[0].read("mart.t")


def run_cursor(spark, sf_dir):
    """Only rows behind the last run's greatest key."""
    text = "-- @kind: append\n-- @incremental: id\n-- @incremental_initial: 0\nSELECT id, cust, price FROM staging.s WHERE id > CAST(getvariable('incr_last_value') AS BIGINT)"
    first = EVEN.replace("% 2 = 0", "% 2 = 0 AND o_orderkey < 1000")
    return _runs(spark, sf_dir, "mart.t", f"{first}---{text}", f"{THIRD}---{text}")[0].read("mart.t")


def run_retry(spark, sf_dir):
    """The query fails on changed rows alone; a full run follows."""
    text = "-- @kind: append\nSELECT id, price, assert_true((SELECT min(id) FROM staging.s) < 10) AS ok FROM staging.s WHERE id >= 0"
    return _runs(spark, sf_dir, "mart.t", f"{EVEN}---{text}", f"{EVEN.replace('= 0', '= 0 OR o_orderkey > 100')}---{text}")[0].read("mart.t").select("id", "price")


def run_propagation(spark, sf_dir):
    """Run types of three runs: first, unchanged, and with the source's query changed."""
    _, results = _runs(spark, sf_dir, "mart.t", *[f"{s}---SELECT count(*) AS n FROM staging.s" for s in (EVEN, EVEN, THIRD)])
    rows = [(i // 2 + 1, r.model, r.run_type) for i, r in enumerate(results)]
    return spark.createDataFrame(rows, "run int, model string, run_type string")


def src_csv(spark, sf_dir):
    path = f"{own_folder(spark, 'files')}/nation"
    table(spark, sf_dir, "nation").selectExpr("n_nationkey", "n_name").write.option("header", True).csv(path)
    return READERS["read_csv"](spark, path).selectExpr("CAST(n_nationkey AS BIGINT) AS n_nationkey", "n_name")


def src_json(spark, sf_dir):
    path = f"{own_folder(spark, 'files')}/nation"
    table(spark, sf_dir, "nation").selectExpr("n_nationkey", "n_name").write.json(path)
    return READERS["read_json"](spark, path).selectExpr("CAST(n_nationkey AS BIGINT) AS n_nationkey", "n_name")


def src_summarize(spark, sf_dir):
    return inspect.summarize(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")).select("column_name", "least", "greatest", "rows", "null_percentage")


USER = ["CREATE OR REPLACE MACRO mem.gross(p, rate := 0.25) AS net(p) * (1 + rate);", "CREATE MACRO net(p) AS round(p, 1);\nCREATE MACRO orders_of(c) AS TABLE SELECT o_orderkey, o_totalprice FROM raw.orders WHERE o_custkey % 10 = c;"]
CHECK = ["CREATE MACRO constraint_below(t, col, lim) AS TABLE SELECT 1 AS bad FROM query_table(t) WHERE query_columns(col) >= lim;"]


def _asked(text: str, macros: list[str] = (), prefix: str = ""):
    def query(spark, sf_dir):
        lake = _lake(spark, sf_dir)
        run = {"run_time": "2024-01-02 03:04:05", "load_id": "load-1", "dag_start": lake.log.last()}
        return bind(spark, to_spark(spark, Macros(list(macros), prefix, lake, run=run).expand(text)), lambda n: lake.read(n) if lake.exists(n) else None)

    return query


def macro_check(spark, sf_dir):
    """A check of the project's own: a run that keeps it commits."""
    text = f"-- @constraint: below(price, 100000000)\n{EVEN}"
    return _runs(spark, sf_dir, "mart.t", text, macros=CHECK)[0].read("mart.t")


def macro_commits(spark, sf_dir):
    lake, _ = _runs(spark, sf_dir, "mart.t", f"{EVEN}---SELECT id FROM staging.s")
    macros = Macros([], "p_", lake, run={"dag_start": 3})
    text = """SELECT last_snapshot() AS last, prev_snapshot() AS prev, current_snapshot() AS now_, dag_start_snapshot() AS began, length(get_sql_hash('MART.T')) AS hash_length, get_sql_hash('no.such') AS none,
        get_json_object(get_commit_info('mart.t'), '$.kind') AS kind, get_json_object(get_prev_columns('mart.t'), '$[0].name') AS first_column, (SELECT max(model) FROM p_get_downstream('staging.s')) AS below"""
    return spark.sql(to_spark(spark, macros.expand(text)))


ASKED = {
    "macro_user": ("SELECT o_orderkey, gross(o_totalprice) AS gross, net(o_totalprice) AS net FROM orders_of(3) WHERE safe_divide(o_totalprice, 0) IS NULL", USER, ""),
    "macro_values": (
        "SELECT row_count('raw.orders') AS n, has_rows('raw.orders') AS some, x_min_value('raw.orders', 'o_custkey') AS least, max_value('raw.orders', 'o_custkey') AS greatest, distinct_count('raw.orders', 'o_custkey') AS customers, null_count('raw.orders', 'o_custkey') AS nulls, CAST(duplicate_count('raw.orders', [o_custkey]) AS BIGINT) AS repeats",
        [], "x_",
    ),
    "macro_columns": ("SELECT column_def FROM get_columns('raw', 'nation') UNION ALL SELECT column_def FROM get_columns_simple('raw.nation') UNION ALL SELECT column_def FROM get_columns_full('lake', 'raw', 'nation')", [], ""),
    "macro_names": ("SELECT column_name FROM get_column_names('raw.nation') UNION ALL SELECT column_name FROM get_column_names_schema('raw', 'nation') UNION ALL SELECT column_name FROM get_column_names_full('lake', 'raw', 'nation')", [], ""),
    "macro_facts": (
        "SELECT table_exists('raw', 'nation') AS a, table_exists_simple('raw.none') AS b, table_exists_full('lake', 'raw', 'nation') AS c, column_exists('raw.nation', 'n_name') AS d, column_exists('raw.nation', 'x') AS e, column_type('raw.nation', 'n_name') AS f, is_type_promotable('INTEGER', 'BIGINT') AS g, is_type_promotable('BIGINT', 'INTEGER') AS h, batch_type_check('INTEGER:BIGINT,FLOAT:DOUBLE') AS i, normalize_type('NUMERIC') AS j, sql_hash('SELECT  1 -- one') AS k, schema_string('raw.nation') AS l, schema_hash('raw.nation') AS m, schema_hash_qualified('raw', 'nation') AS n, load_id() AS o, z_now() AS p",
        [], "z_",
    ),
    "macro_diff": ("SELECT _source, o_orderkey FROM table_diff((SELECT o_orderkey FROM raw.orders WHERE o_orderkey % 2 = 0), (SELECT o_orderkey FROM raw.orders WHERE o_orderkey % 3 = 0))", [], ""),
    "macro_compare": ("SELECT * FROM compare_tables((SELECT o_custkey FROM raw.orders WHERE o_orderkey % 2 = 0), (SELECT o_custkey FROM raw.orders WHERE o_orderkey % 3 = 0))", [], ""),
    "macro_masks": ("SELECT c_custkey, mask_email(concat(c_name, '@x.org')) AS email, mask_ssn(c_name) AS ssn, hash_pii(c_name) AS hash, redact(c_name) AS gone, cents_to_dollars(c_custkey) AS dollars FROM raw.customer", [], ""),
    "fn_json_object": ("SELECT n_nationkey, json_object('key', n_nationkey, 'name', n_name) AS j FROM raw.nation", [], ""),
    "fn_json_group": ("SELECT n_regionkey, json_group_array(n_nationkey) AS j FROM (SELECT n_regionkey, n_nationkey FROM raw.nation WHERE n_nationkey = n_regionkey) GROUP BY n_regionkey", [], ""),
    "fn_json_each": ("""SELECT key, value FROM json_each('{"a": 1, "b": "two", "c": 3.5}')""", [], ""),
    "fn_json_transform": ("""SELECT n_nationkey, j.k AS k, j.s AS s FROM (SELECT n_nationkey, json_transform(concat('{"k": ', n_nationkey, ', "s": "', n_name, '"}'), '{"k": "INTEGER", "s": "VARCHAR"}') AS j FROM raw.nation)""", [], ""),
    "fn_strftime": ("SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d week of %B') AS day FROM raw.orders", [], ""),
    "fn_query": ("SELECT * FROM query('SELECT n_name FROM raw.nation') UNION ALL SELECT n_name FROM query_table('raw.nation')", [], ""),
}

_E = "SELECT o_orderkey AS id, o_custkey AS cust, o_totalprice AS price FROM orders WHERE o_orderkey % 2 = 0"
_T = "SELECT o_orderkey AS id, o_custkey AS cust, o_totalprice + 1 AS price FROM orders WHERE o_orderkey % 3 = 0"
_MERGED = f"SELECT * FROM ({_E}) WHERE id % 3 <> 0 UNION ALL {_T}"
_RUNS = (lake_time_travel, lake_change_feed, lake_snapshots, lake_insert_only, lin_overview, lin_trace, lin_tree, run_merge, run_scd2, run_tracked, run_append, run_gate, run_added_column, run_renamed_column, run_widened_column, run_key_type, run_schema_change, run_cursor, run_retry, run_propagation, src_csv, src_json, src_summarize, macro_check, macro_commits)

QUERIES = {f.__name__: f for f in _RUNS} | {n: _asked(*x) for n, x in ASKED.items()}
ORACLES = {
    "lake_time_travel": _E,
    "lake_change_feed": f"""SELECT 'insert' AS change_type, id, price FROM ({_T}) WHERE id % 2 <> 0 UNION ALL SELECT 'update_postimage', id, price FROM ({_T}) WHERE id % 2 = 0
        UNION ALL SELECT 'update_preimage', id, price FROM ({_E}) WHERE id % 3 = 0""",
    "lake_snapshots": f"""SELECT 'staging.s' AS model, 'table' AS kind, 'backfill' AS run_type, (SELECT count(*) FROM ({_E})) AS rows_affected UNION ALL SELECT 'mart.t', 'merge', 'backfill', (SELECT count(*) FROM ({_E}))
        UNION ALL SELECT 'staging.s', 'table', 'backfill', (SELECT count(*) FROM ({_T})) UNION ALL SELECT 'mart.t', 'merge', 'incremental', (SELECT count(*) FROM ({_T}))""",
    "lake_insert_only": f"SELECT 1 AS version, true AS insert_only UNION ALL SELECT 2, (SELECT count(*) FROM ({_T}) WHERE id % 2 = 0) = 0",
    "lin_overview": "SELECT * FROM (VALUES (0, 'raw.orders', 0, 1), (1, 'staging.s', 1, 1), (2, 'mart.t', 1, 0)) t(level, model, reads, read_by)",
    "lin_trace": "SELECT * FROM (VALUES (0, 'mart.t', 'twice', 'staging.s', 'price', 'ARITHMETIC'), (1, 'staging.s', 'price', 'raw.orders', 'o_totalprice', 'IDENTITY')) t(step, model, \"column\", source_table, source_column, transformation)",
    "lin_tree": "SELECT * FROM (VALUES ('up', 0, 'mart.t'), ('up', 1, '└─ staging.s'), ('up', 2, '   └─ raw.orders'), ('down', 0, 'raw.orders'), ('down', 1, '└─ staging.s'), ('down', 2, '   └─ mart.t')) t(way, line, \"text\")",
    "run_merge": _MERGED,
    "run_scd2": f"SELECT id, price, false AS is_current, false AS open FROM ({_E}) UNION ALL SELECT id, price, true, true FROM ({_T})",
    "run_tracked": _T,
    "run_append": f"{_E} UNION ALL {_T}",
    "run_gate": _E,
    "run_added_column": f"SELECT id, cust, price, o_orderdate AS day FROM ({_E}) JOIN orders ON o_orderkey = id",
    "run_renamed_column": "SELECT o_orderkey AS id, o_custkey AS cust, o_totalprice AS amount FROM orders, range(2) WHERE o_orderkey % 2 = 0",
    "run_widened_column": "SELECT o_orderkey AS id, o_custkey::BIGINT AS cust FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_custkey::BIGINT FROM orders WHERE o_orderkey % 3 = 0",
    "run_key_type": f"SELECT id::VARCHAR AS id, cust, price FROM ({_T})",
    "run_schema_change": "SELECT o_orderkey AS id, o_custkey AS cust, o_totalprice AS price FROM orders WHERE o_orderkey % 3 = 0",
    "run_cursor": f"SELECT * FROM ({_E}) WHERE id > 0 AND id < 1000 UNION ALL SELECT * FROM ({_T}) WHERE id > (SELECT max(id) FROM ({_E}) WHERE id < 1000)",
    "run_retry": "SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey > 100",
    "run_propagation": """SELECT * FROM (VALUES (1, 'staging.s', 'backfill'), (1, 'mart.t', 'backfill'), (2, 'staging.s', 'skip'), (2, 'mart.t', 'skip'), (3, 'staging.s', 'backfill'), (3, 'mart.t', 'full')) t(run, model, run_type)""",
    "src_csv": "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation",
    "src_json": "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation",
    "src_summarize": " UNION ALL ".join(f"SELECT '{c}' AS column_name, min({c})::VARCHAR AS least, max({c})::VARCHAR AS greatest, count(*) AS rows, round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 2)::DOUBLE AS null_percentage FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderdate")),
    "macro_check": _E,
    "macro_commits": "SELECT 4 AS last, 3 AS prev, 4 AS now_, 3 AS began, 64 AS hash_length, NULL::VARCHAR AS none, 'table' AS kind, 'id' AS first_column, 'mart.t' AS below",
    "macro_user": "SELECT o_orderkey, round(o_totalprice, 1) * (1 + 0.25) AS gross, round(o_totalprice, 1) AS net FROM orders WHERE o_custkey % 10 = 3",
    "macro_values": "SELECT count(*) AS n, true AS some, min(o_custkey) AS least, max(o_custkey) AS greatest, count(DISTINCT o_custkey) AS customers, count(*) FILTER (o_custkey IS NULL) AS nulls, (count(o_custkey) - count(DISTINCT o_custkey))::BIGINT AS repeats FROM orders",
    "macro_columns": "SELECT column_name || '|' || data_type AS column_def FROM information_schema.columns, range(3) WHERE table_name = 'nation'",
    "macro_names": "SELECT column_name FROM information_schema.columns, range(3) WHERE table_name = 'nation'",
    "macro_facts": """SELECT true AS a, false AS b, true AS c, true AS d, false AS e, (SELECT data_type FROM information_schema.columns WHERE table_name = 'nation' AND column_name = 'n_name') AS f, true AS g, false AS h, true AS i, 'DOUBLE' AS j, md5('select 1') AS k,
        string_agg(column_name || ':' || data_type, '|' ORDER BY ordinal_position) AS l, md5(string_agg(column_name || ':' || data_type, '|' ORDER BY column_name || ':' || data_type)) AS m,
        md5(string_agg(column_name || ':' || data_type, '|' ORDER BY column_name || ':' || data_type)) AS n, 'load-1' AS o, TIMESTAMP '2024-01-02 03:04:05' AS p FROM information_schema.columns WHERE table_name = 'nation'""",
    "macro_diff": "SELECT 'table1' AS _source, o_orderkey FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 UNION ALL SELECT 'table2', o_orderkey FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0",
    "macro_compare": """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 3 = 0)
        SELECT (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS only_in_1, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS only_in_2, (SELECT count(*) FROM a WHERE k IN (SELECT k FROM b)) AS matching""",
    "macro_masks": "SELECT c_custkey, left(c_name, 1) || '***@x.org' AS email, '***-**-' || right(c_name, 4) AS ssn, sha256(c_name) AS hash, '[REDACTED]' AS gone, c_custkey / 100.0 AS dollars FROM customer",
    "fn_json_object": "SELECT n_nationkey, json_object('key', n_nationkey, 'name', n_name)::VARCHAR AS j FROM nation",
    "fn_json_group": "SELECT n_regionkey, json_group_array(n_nationkey)::VARCHAR AS j FROM nation WHERE n_nationkey = n_regionkey GROUP BY n_regionkey",
    "fn_json_each": """SELECT * FROM (VALUES ('a', '1'), ('b', 'two'), ('c', '3.5')) t(key, value)""",
    "fn_json_transform": "SELECT n_nationkey, n_nationkey::INTEGER AS k, n_name AS s FROM nation",
    "fn_strftime": "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d week of %B') AS day FROM orders",
    "fn_query": "SELECT n_name FROM nation UNION ALL SELECT n_name FROM nation",
}
