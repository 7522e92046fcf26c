"""Decisions, introspection, event windows and a small graph of models."""

from __future__ import annotations


from .. import decide, inspect
from ..lake import Lake
from ..model import parse_model
from ..operators.evolve import schema_diff
from ..plans.lineage import column_lineage
from ..runner import Runner
from ..shared import own_folder
from ..streaming import events
from .tables import table

LOG = "SELECT * FROM (VALUES (1, 'raw.a', 'table', 10, 5), (2, 'staging.b', 'merge', 4, 7), (3, 'mart.c', 'table', 3, 9), (4, 'STAGING.B', 'merge', 6, 11), (5, 'mart.d', 'append', 2, 1)) AS t(snapshot_id, model, kind, rows_affected, duration_ms)"


def run_type_decisions(spark, sf_dir):
    """Decisions of a small log, next to the same rule in SQL."""
    lake = Lake(spark, own_folder(spark, "lake"))
    models = {n: parse_model(f"{h}SELECT 1 AS id", n) for n, h in (("raw.a", ""), ("mart.b", ""), ("mart.c", "-- @kind: append\n"), ("mart.d", ""))}
    entry = {"schema": {"type": "struct", "fields": []}, "files": []}
    log = [("raw.a", "h", []), ("mart.b", "h", ["raw.a"]), ("mart.c", "h", ["raw.a"]), ("mart.d", "old", ["raw.a"]), ("raw.a", "h", [])]
    for i, (n, h, deps) in enumerate(log):
        lake.commit({n: entry}, {"model": n, "sql_hash": h, "depends": deps}, base=i - 1)
    rows = [(n, *vars(decide.decide(m, "h", lake.log)).values()) for n, m in models.items()]
    return spark.createDataFrame(rows, "model string, run_type string, reason string")


def ins_kinds(spark, sf_dir):
    return inspect.kind_breakdown(spark.sql(LOG)).selectExpr("kind", "models", "CAST(rows AS BIGINT) AS rows")


def ins_stats(spark, sf_dir):
    return inspect.run_stats(spark.sql(LOG)).selectExpr("commits", "models", "mean_ms", "CAST(max_ms AS BIGINT) AS max_ms")


def ins_downstream(spark, sf_dir):
    log = spark.sql("SELECT * FROM (VALUES (1, 'mart.x', array('raw.a', 'raw.b')), (2, 'mart.y', array('raw.c')), (3, 'mart.z', array('RAW.A'))) AS t(snapshot_id, model, depends)")
    return inspect.downstream(log, "raw.a")


def evt_tumbling(spark, sf_dir):
    return events.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"])


def evt_sliding(spark, sf_dir):
    return events.sliding(table(spark, sf_dir, "events"), "ts", "2 hours", "1 hour")


def evt_sessions(spark, sf_dir):
    return events.sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"]).select("user_id", "start", "n")


LINEAGE = "WITH o AS (SELECT o_custkey, sum(o_totalprice) AS total FROM raw.orders GROUP BY o_custkey) SELECT c.c_name AS name, o.total * 2 AS twice, coalesce(o.total, 0) AS total, CAST(c.c_custkey AS STRING) AS k FROM raw.customer c JOIN o ON o.o_custkey = c.c_custkey"


def lin_columns(spark, sf_dir):
    rows = [(o.column, s.table, s.column, s.transformation) for o in column_lineage(spark, LINEAGE) for s in o.sources]
    return spark.createDataFrame(rows, "output string, source_table string, source_column string, transformation string")


def evo_schema_diff(spark, sf_dir):
    rows = schema_diff([("id", "INTEGER"), ("v", "VARCHAR"), ("w", "DATE")], [("id", "BIGINT"), ("v", "VARCHAR"), ("x", "DOUBLE")])
    return spark.createDataFrame(rows, "column string, old string, new string, state string")


STAR = {
    "staging.enriched": "-- @kind: append\n-- @constraint: not_null(o_orderkey), unique(o_orderkey)\nSELECT o.o_orderkey, o.o_custkey, o.o_totalprice, c.c_nationkey, c.c_mktsegment FROM raw.orders o JOIN raw.customer c ON o.o_custkey = c.c_custkey",
    "staging.latest": "-- @kind: merge\n-- @unique_key: o_orderkey\nSELECT o_orderkey, o_custkey, o_totalprice FROM raw.orders",
    "staging.history": "-- @kind: scd2\n-- @unique_key: c_custkey\nSELECT c_custkey, c_name, c_nationkey FROM raw.customer",
    "staging.by_nation": "-- @kind: tracked\n-- @group_key: c_nationkey\nSELECT c_nationkey, c_custkey, c_acctbal FROM raw.customer",
    "mart.revenue": "-- @audit: row_count(>, 0)\nSELECT c_mktsegment, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM staging.enriched GROUP BY c_mktsegment",
}


def graph_star(spark, sf_dir):
    """Seven tables: two sources, four kinds, one mart; the result is the mart."""
    lake = Lake(spark, own_folder(spark, "lake"))
    for name in ("orders", "customer"):
        lake.attach(f"raw.{name}", f"{sf_dir}/{name}.parquet")
    results = Runner(spark, lake).run_all([parse_model(t, n) for n, t in STAR.items()])
    if bad := [r.error for r in results if r.error]:
        raise RuntimeError(bad[0])
    return lake.read("mart.revenue")


QUERIES = {f.__name__: f for f in (run_type_decisions, ins_kinds, ins_stats, ins_downstream, evt_tumbling, evt_sliding, evt_sessions, lin_columns, evo_schema_diff, graph_star)}
ORACLES = {
    "run_type_decisions": """
        WITH log(id, model, h, deps) AS (VALUES (0, 'raw.a', 'h', []), (1, 'mart.b', 'h', ['raw.a']), (2, 'mart.c', 'h', ['raw.a']), (3, 'mart.d', 'old', ['raw.a']), (4, 'raw.a', 'h', [])),
        m(model, kind) AS (VALUES ('raw.a', 'table'), ('mart.b', 'table'), ('mart.c', 'append'), ('mart.d', 'table')),
        l AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY lower(model) ORDER BY id DESC) = 1),
        d AS (SELECT m.*, l.id, l.h, l.deps, (SELECT min(x.model) FROM log x WHERE list_contains(l.deps, x.model) AND x.id > l.id) AS newer FROM m LEFT JOIN l ON l.model = m.model)
        SELECT model, CASE WHEN h IS NULL OR h <> 'h' THEN 'backfill' WHEN kind <> 'table' THEN 'incremental' WHEN len(deps) = 0 THEN 'skip' WHEN newer IS NOT NULL THEN 'full' ELSE 'skip' END AS run_type,
            CASE WHEN h IS NULL THEN 'first run' WHEN h <> 'h' THEN 'sql changed' WHEN kind <> 'table' THEN 'incremental run' WHEN len(deps) = 0 THEN 'no dependencies'
                WHEN newer IS NOT NULL THEN 'dep changed: ' || newer ELSE 'deps unchanged' END AS reason FROM d""",
    "ins_kinds": f"SELECT kind, count(*) AS models, sum(rows_affected)::BIGINT AS rows FROM (SELECT * FROM ({LOG}) QUALIFY row_number() OVER (PARTITION BY lower(model) ORDER BY snapshot_id DESC) = 1) GROUP BY kind",
    "ins_stats": f"SELECT count(*) AS commits, count(DISTINCT model) AS models, round(avg(duration_ms), 3) AS mean_ms, max(duration_ms)::BIGINT AS max_ms FROM ({LOG})",
    "ins_downstream": "SELECT * FROM (VALUES ('mart.x'), ('mart.z')) AS t(model)",
    "evt_tumbling": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "evt_sliding": "SELECT s AS start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY s",
    "evt_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new_ FROM events),
        s AS (SELECT user_id, ts, sum(new_) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
    "lin_columns": """SELECT * FROM (VALUES ('name', 'raw.customer', 'c_name', 'IDENTITY'), ('twice', 'raw.orders', 'o_totalprice', 'ARITHMETIC'), ('total', 'raw.orders', 'o_totalprice', 'CONDITIONAL'),
        ('k', 'raw.customer', 'c_custkey', 'CAST')) AS t(output, source_table, source_column, transformation)""",
    "evo_schema_diff": "SELECT coalesce(a.n, b.n) AS \"column\", a.t AS old, b.t AS new, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' WHEN a.t = b.t THEN 'same' ELSE 'changed' END AS state FROM (VALUES ('id', 'INTEGER'), ('v', 'VARCHAR'), ('w', 'DATE')) a(n, t) FULL JOIN (VALUES ('id', 'BIGINT'), ('v', 'VARCHAR'), ('x', 'DOUBLE')) b(n, t) ON a.n = b.n",
    "graph_star": "SELECT c_mktsegment, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
}
