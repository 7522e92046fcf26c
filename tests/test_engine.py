import pytest
from pyspark.sql import functions as F

from sparkloom import cli, decide, inspect, maintain, sandbox, types, validate
from sparkloom.config import expand, find_project
from sparkloom.functions import macros
from sparkloom.functions.dialect import to_spark
from sparkloom.functions.masking import apply_masks
from sparkloom.model import ModelError, parse_model, target_of
from sparkloom.operators import checks, evolve, kinds
from sparkloom.plans import lineage, refs
from sparkloom.plans.bind import bind
from sparkloom.runner import Runner, RunError, run_id
from sparkloom.sources import fetch, push
from sparkloom.sources.state import EVENT_TTL, State
from sparkloom.streaming import events
from sparkloom.variables import substitute


def test_types():
    assert types.parse("DECIMAL").simpleString() == "decimal(18,3)" and types.parse("DECIMAL(9)").simpleString() == "decimal(9,0)"
    assert types.parse("STRUCT(a INT, b VARCHAR[])").simpleString() == "struct<a:int,b:array<string>>"
    assert types.parse("MAP(VARCHAR, DOUBLE)").simpleString() == "map<string,double>" and types.parse("nonsense").simpleString() == "string"
    assert types.promotable("INT", "BIGINT") and not types.promotable("BIGINT", "INT") and types.normalize("numeric") == "DOUBLE"
    for name in ("TINYINT", "BIGINT", "HUGEINT", "DOUBLE", "DATE", "TIMESTAMP", "BLOB", "DECIMAL(9,2)", "BIGINT[]"):
        assert types.canonical(types.parse(name)) == name


def test_check_arguments():
    assert checks.parse_directive("matches(c, '[0-9]{1,3}, x')") == ("matches", ["c", "[0-9]{1,3}, x"])
    assert checks.parse_directive("check(l, f(a, b) > 1)") == ("check", ["l", "f(a, b) > 1"])


def test_checks_on_empty_and_null_tables(spark):
    none = spark.createDataFrame([], "v double, s string")
    found = {r["check"]: r.passed for r in checks.report(none, "constraint", ["not_null(v)", "at_least_one(v)", "null_percent(v, 5)", "unique(v)", "sequential(v)", "primary_key(v)"]).collect()}
    assert found == {"not_null(v)": True, "at_least_one(v)": False, "null_percent(v, 5)": True, "unique(v)": True, "sequential(v)": True, "primary_key(v)": True}
    audits = {r["check"]: r.passed for r in checks.report(none, "audit", ["mean(v, >=, 0)", "percentile(v, 0.5, >=, 0)", "zscore(v, 2)", "sum(v, >, 0)", "stddev(v, 3)"]).collect()}
    assert audits == {"mean(v, >=, 0)": False, "percentile(v, 0.5, >=, 0)": True, "zscore(v, 2)": False, "sum(v, >, 0)": False, "stddev(v, 3)": False}
    twice = spark.createDataFrame([(None,), (None,), (1.0,)], "v double")
    assert [r.violations for r in checks.report(twice, "constraint", ["primary_key(v)", "unique(v)"]).collect()] == [3, 1]
    with pytest.raises(checks.CheckError):
        checks.report(none, "audit", ["nothing(v)"])


def test_golden_file_and_own_checks(spark, tmp_path):
    (tmp_path / "want.csv").write_text("a,b\n1,x\n2,y\n")
    df = spark.createDataFrame([(1, "x"), (3, "z")], "a int, b string")
    assert checks.report(df, "audit", [f"golden('{tmp_path}/want.csv')"]).first().violations == 2

    @checks.check("even", "constraint")
    def even(df, ctx, col):
        return checks.Aggregate(F.count_if(F.col(col) % 2 != 0))

    assert checks.report(df, "constraint", ["even(a)"]).first().violations == 2


def test_kinds_refuse_bad_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, v string")
    with pytest.raises(kinds.KeyError_, match="nulls"):
        kinds.check_keys(df, ["k"], unique=False)
    with pytest.raises(kinds.KeyError_, match="more than once"):
        kinds.check_keys(df.where("k is not null"), ["K"], unique=True)


def test_hash_counts_repeats_and_nulls(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "a", None), (3, "a", None), (3, "a", None)], "k int, x string, y string")
    got = [r[1] for r in kinds.group_hashes(df, ["k"], ["x", "y"]).orderBy("k").collect()]
    assert len(set(got)) == 3


def test_models():
    m = parse_model("-- @kind: tracked\n-- @group_key: a, b\n-- @audit: row_count(>, 1), min(v, >=, 0)\n-- @column: e = mail | pii | mask_email\nSELECT 1 -- ; not the end\n;", "x.y")
    assert m.group_key == ["a", "b"] and m.audits == ["row_count(>, 1)", "min(v, >=, 0)"] and m.tags["e"] == ["pii", "mask_email"]
    assert target_of("models/raw/a/b.sql") == "raw.a__b" and target_of("models/a.sql") == "main.a" and target_of("else/a.sql") == "tmp.a"
    for text, rule in [("-- @kind: view\nSELECT 1", "invalid_kind"), ("-- @nope: 1\nSELECT 1", "invalid_directive"), ("SELECT 1; SELECT 2", "multi_statement"), ("-- @sink: x\nSELECT 1", "deprecated_sink"), ("SELECT 1 /* open", "unterminated_block_comment"), ("-- @unique_key: id\nSELECT 1", "invalid_unique_key"), ("SELECT 1\n-- @kind: table", "invalid_directive")]:
        with pytest.raises(ModelError) as e:
            parse_model(text, "a.b")
        assert e.value.rule == rule


def test_references_and_binding(spark):
    sql = "WITH clean AS (SELECT * FROM stg.a WHERE id IN (SELECT id FROM raw.b)) SELECT clean.id, '{x}' AS c FROM clean JOIN raw.c d ON d.id = clean.id -- raw.z"
    assert refs.dependencies(spark, sql) == ["raw.b", "raw.c", "stg.a"] and refs.primary_table(spark, sql) == "stg.a"
    assert refs.row_limits(spark, "SELECT * FROM (SELECT * FROM a.b LIMIT 3) t") == ["LIMIT"]
    assert bind(spark, sql, lambda n: spark.range(3)).count() == 3
    assert refs.is_read_only(spark, "SELECT 1") and not refs.is_read_only(spark, "DROP TABLE x") and not refs.is_read_only(spark, "SELECT 1; SELECT 2")


def test_lineage_and_impact(spark):
    out = {o.column: o.sources for o in lineage.column_lineage(spark, "SELECT a.x AS x, sum(b.y) AS s, CASE WHEN a.z > 1 THEN b.w END AS c FROM r.a a JOIN r.b b ON a.i = b.i GROUP BY 1, 3")}
    assert [vars(s) for s in out["x"]] == [{"table": "r.a", "column": "x", "transformation": "IDENTITY"}]
    assert out["s"][0].transformation == "AGGREGATION" and {s.transformation for s in out["c"]} == {"CONDITIONAL"} and lineage.aggregated_tables(lineage.column_lineage(spark, "SELECT sum(b.y) AS s FROM r.b b")) == {"r.b"}
    old, new = (lineage.column_lineage(spark, f"SELECT a.x AS {n}, a.y FROM r.a a") for n in ("p", "q"))
    assert lineage.renames(old, new) == [("p", "q")]
    assert lineage.impact({"b": ["a"], "c": ["b"], "d": ["A"]}, "a") == {"direct": ["b", "d"], "transitive": ["c"], "tree": ["b", "c", "d"]}


def test_evolution(spark):
    assert evolve.classify([("a", "INTEGER")], [("a", "BIGINT"), ("b", "DATE")]).kind == "type_change"
    assert evolve.classify([("a", "INTEGER")], [("a", "VARCHAR")]).kind == evolve.classify([("a", "INTEGER"), ("b", "DATE")], [("a", "INTEGER")]).kind == "destructive"
    df = spark.createDataFrame([(1, "x", 2.5)], "a int, b string, c double")
    got = evolve.adapt(df, spark.createDataFrame([], "a long, B2 string, c int, d date").schema, [("b", "B2")]).first()
    assert tuple(got) == (1, "x", None, None)


def test_dialect_and_variables(spark):
    assert to_spark(spark, "SELECT a::VARCHAR, '->>' AS t FROM x -- //") == "SELECT a::string, '->>' AS t FROM x -- //"
    assert "div" in to_spark(spark, "SELECT a // 2 FROM x")
    assert substitute("SELECT getvariable('a'), 'getvariable(''a'')'", {"a": "it's"}) == "SELECT 'it\\'s', 'getvariable(''a'')'"
    assert macros.sql_hash("SELECT  1 -- x\n") == macros.sql_hash("select 1") != macros.sql_hash("select '1 '")


def test_masks(spark):
    df = spark.createDataFrame([("ann@x.org", "123-45-6789", "k", None)], "e string, s string, k string, r string")
    got = apply_masks(df, {"e": ["x", "mask_email"], "s": ["mask_ssn"], "k": ["redact"], "r": ["redact"]}, keys=["k"]).first()
    assert tuple(got) == ("a***@x.org", "***-**-6789", "k", "[REDACTED]")


def test_fetch_pages_jobs_and_buffer(spark):
    pages = {None: {"rows": [{"id": 1, "x": [1]}], "next": "b"}, "b": {"rows": [{"id": 2, "x": None}], "next": ""}}
    state = State()
    lib = fetch.Library("pages", fetch=lambda what, page: pages[page])
    got = fetch.fetch_rows(lib, ["w"], state, "raw.t", cursor="ignored")
    assert [r["id"] for r in got.rows] == [1, 2] and state.buffered("raw.t") == got.rows
    assert [tuple(r) for r in fetch.to_frame(spark, got.rows).collect()] == [(1, "[1]"), (2, None)]
    ready = iter([False, True])
    job = fetch.Library("job", submit=lambda: "j1", check=lambda ref: next(ready), result=lambda ref: [{"id": 3}])
    assert fetch.fetch_rows(job, [], State(), "raw.u", sleep=lambda s: None).rows == [{"id": 3}]
    with pytest.raises(fetch.FetchError):
        fetch.infer_schema([{"a": 1}, {"a": 1.5}])
    assert fetch.to_frame(spark, [], {"a": "BIGINT"}).columns == ["a"]


def test_fetch_model_and_push(spark, lake):
    sent = []

    def receive(rows):
        sent.extend(rows)
        return {f"{r['__rowid']}:{r['__change_type']}": "reject: no" if r["id"] == 3 else "error: later" if r["id"] == 2 and len(sent) < 4 else "ok" for r in rows}

    fetch.library(fetch.Library("src", fetch=lambda n, page: {"rows": [{"id": i} for i in range(1, n + 1)]}, columns={"id": "BIGINT"}))
    fetch.library(fetch.Library("out", push=receive))
    runner = Runner(spark, lake)
    runner.run(parse_model("-- @fetch\n-- @push: out\nSELECT id::BIGINT AS id FROM src(3)", "raw.f"))
    assert len(sent) == 3 and runner.state.backlog("raw.f") == 1 and len(runner.state.dead("raw.f")) == 1
    assert push.push(lake, runner.state, fetch.REGISTRY["out"], "raw.f").ok == 1 and runner.state.backlog("raw.f") == 0


def test_queue_expires_and_claims():
    state = State()
    state.enqueue("t", [(1, "insert", 5), (2, "insert", 5)])
    assert len(state.claim("t", 1, "a")) == 1 and len(state.claim("t", 9, "b")) == 1 and state.claim("t", 9, "c") == []
    import time

    assert state.claim("t", 9, "d", now=time.time() + EVENT_TTL + 1) == [] and state.backlog("t") == 0


def test_sandbox_leaves_production(spark, lake, tmp_path):
    runner = Runner(spark, lake)
    runner.run(parse_model("SELECT 1 AS id, 'a' AS v", "raw.a"))
    before = lake.log.last()
    fork, results = sandbox.preview(spark, lake, f"file://{tmp_path}/fork", [parse_model("SELECT 2 AS id, 'a' AS v, 3 AS w", "raw.a")])
    assert results[0].error is None and lake.log.last() == before and sandbox.changed_tables(lake, fork) == ["raw.a"]
    d = sandbox.diff(lake, fork, "raw.a")
    assert (d.added, d.removed) == (1, 1) and ("w", None, "INTEGER", "added") in d.schema


def test_inspection_and_maintenance(spark, lake):
    runner = Runner(spark, lake)
    seed = lambda v: parse_model(f"-- @kind: append\nSELECT {v} AS id", "raw.a")
    for v in (1, 2, 3):
        entry = seed(v)
        runner.run(entry, decide.Decision(decide.INCREMENTAL, "test"))
    assert lake.read("raw.a").count() == 3 and inspect.history(lake).count() == 3 and inspect.describe(lake, "raw.a")["rows"] == 3
    ids = {r["__rowid"] for r in lake.read("raw.a", rowid=True).collect()}
    assert maintain.merge_files(lake, "raw.a") >= 1 and {r["__rowid"] for r in lake.read("raw.a", rowid=True).collect()} == ids and len(ids) == 3
    orphan = lake.stage(spark.range(2), "raw.a", 99)
    assert maintain.expire(lake, days=-1) and sorted(maintain.cleanup(lake, days=-1)) == sorted(orphan) and lake.read("raw.a").count() == 3


def test_validation(spark):
    found = validate.validate(spark, [parse_model("SELECT id FROM b.b LIMIT 1", "a.a"), parse_model("SELECT id FROM a.a", "b.b"), parse_model("-- @push: out\n-- @kind: scd2\n-- @unique_key: id\nSELECT id, 1 AS x, CAST(2 AS INT) AS y FROM e.e", "c.c"), parse_model("SELEC 1", "d.d")])
    rules = {f.rule for f in found}
    assert {"read_only.limit_disallowed", "dag.cycle_detected", "push.kind_not_supported", "strict_push.alias_required", "strict_push.cast_required", "parser.other", "dag.external_reference"} <= rules


def test_push_settings(spark, tmp_path):
    from sparkloom.sources import api

    def sink(name, **push):
        (tmp_path / "lib").mkdir(exist_ok=True)
        (tmp_path / "models" / "m").mkdir(parents=True, exist_ok=True)
        (tmp_path / "lib" / f"{name}.py").write_text(f"API = {{'base_url': 'http://127.0.0.1', 'push': {push!r}}}\ndef push(rows, http):\n    return 'ok'\n")
        (tmp_path / "models" / "m" / f"{name}.sql").write_text(f"-- @push: {name}\nSELECT CAST(1 AS BIGINT) AS id\n")

    sink("good", batch_mode="async", poll_interval="5s", poll_timeout="1h", rate_limit={"requests": 5, "per": "1s"})
    assert not [f for f in validate.validate_folder(spark, str(tmp_path)) if f.rule.startswith("push.")]
    assert api.load_libraries(str(tmp_path)) == ["good"]
    sink("sync", poll_interval="5s")
    sink("late", batch_mode="async", poll_timeout="soon")
    sink("dots", batch_mode="async", poll_interval="..")
    sink("many", batch_mode="atomic", max_concurrent=2)
    sink("pace", rate_limit={"requests": 5, "per": "often"})
    sink("mode", batch_mode="other")
    found = {(f.target, f.rule) for f in validate.validate_folder(spark, str(tmp_path)) if f.rule.startswith("push.")}
    assert found == {
        ("m.sync", "push.invalid_poll_interval"), ("m.late", "push.invalid_poll_timeout"), ("m.dots", "push.invalid_poll_interval"),
        ("m.many", "push.invalid_max_concurrent"), ("m.pace", "push.invalid_rate_limit"), ("m.mode", "push.invalid_batch_mode"),
    }
    with pytest.raises(api.ApiError):
        api.load_libraries(str(tmp_path))

    (tmp_path / "lib" / "read.py").write_text("API = {'base_url': 'http://127.0.0.1', 'fetch': {}}\n")
    (tmp_path / "models" / "m" / "read.sql").write_text("-- @fetch\nSELECT id::BIGINT AS id FROM read('x')\n")
    (tmp_path / "models" / "m" / "none.sql").write_text("-- @fetch\nSELECT id::BIGINT AS id FROM no_such_library('x')\n")
    unknown = lambda: {f.target for f in validate.validate_folder(spark, str(tmp_path)) if f.rule == "cross_ast.unknown_lib"}
    assert unknown() == {"m.none"}
    (tmp_path / "lib" / "torn.py").write_text("API = {")
    assert "parser.library" in {f.rule for f in validate.validate_folder(spark, str(tmp_path))}


def test_command_line(spark, tmp_path, capsys):
    models = tmp_path / "models" / "raw"
    models.mkdir(parents=True)
    (models / "a.sql").write_text("SELECT 1 AS id, getvariable('who') AS who")
    (tmp_path / "config" / "variables").mkdir(parents=True)
    (tmp_path / "config" / "variables" / "constants.sql").write_text("SET VARIABLE who = 'me';")
    at = ["--project", str(tmp_path)]
    assert cli.main([*at, "run"], spark) == 0 and cli.main([*at, "validate"], spark) == 0
    capsys.readouterr()
    assert cli.main([*at, "sql", "SELECT who, id FROM raw.a", "--format", "csv"], spark) == 0
    assert capsys.readouterr().out.strip() == "who,id\nme,1"
    assert cli.main([*at, "sql", "DROP TABLE raw.a"], spark) == 1 and cli.main([*at, "describe", "no.no"], spark) == 1 and cli.main([*at, "nonsense"], spark) == 2
    assert find_project(str(models)).variables == {"who": "me"} and expand("${A}-$B", {"A": "1"}) == "1-" and len(run_id()) == 22


def test_streams(spark, lake, tmp_path):
    source = tmp_path / "in"
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    table.repartition(3).write.parquet(str(source))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    for _ in range(2):
        events.ingest(stream, lake, "raw.events", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert lake.read("raw.events").count() == table.count()
    counted = events.tumbling(stream, "ts", "1 hour", ["event_type"], late="1 hour")
    counted.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("counted").collect()} == {tuple(r) for r in events.tumbling(table, "ts", "1 hour", ["event_type"]).collect()}


def test_limits_retries_and_lookup(spark, lake):
    from sparkloom.sources import net

    now, slept = [0.0], []
    limit = net.RateLimit(2, 1.0, clock=lambda: now[0], sleep=slept.append)
    for _ in range(4):
        limit.take()
    assert slept == [0.5, 1.0]
    calls = iter([net.Retry("busy", 3), net.Retry("busy"), None])

    def call():
        if (e := next(calls)) is not None:
            raise e
        return "done"

    waits = []
    assert net.with_retries(call, sleep=waits.append) == "done" and waits[0] == 3 and net.retryable(503) and not net.retryable(404)
    Runner(spark, lake).run(parse_model("SELECT * FROM (VALUES ('a', 1), ('b', 2)) AS t(k, v)", "raw.l"))
    assert net.lookup(lake, "raw.l", "k", "v", ["b"]) == {"b": 2} and net.lookup(lake, "no.no", "k", "v") == {}


def test_history_and_groups_rewrite_touched_files_only(spark, lake):
    runner = Runner(spark, lake)
    src = lambda v: parse_model(f"SELECT id, id % 4 AS g, CASE WHEN id = 3 THEN {v} ELSE 0 END AS v FROM range(40) AS t(id)", "raw.s")
    models = [parse_model("-- @kind: scd2\n-- @unique_key: id\n-- @partitioned_by: g\nSELECT id, g, v FROM raw.s", "mart.h"), parse_model("-- @kind: tracked\n-- @group_key: g\n-- @partitioned_by: g\nSELECT id, g, v FROM raw.s", "mart.t")]
    runner.run_all([src(1), *models])
    before = {m.target: set(lake.log.state(m.target)["files"]) for m in models}
    found = {r.model: r for r in runner.run_all([src(2), *models])}
    assert found["mart.h"].rows == 1 and found["mart.t"].rows == 10
    assert lake.read("mart.h").count() == 41 and lake.read("mart.t").count() == 40
    for m in models:
        kept = before[m.target] & set(lake.log.state(m.target)["files"])
        assert len(before[m.target]) == 1 or kept
    changed = {r.change_type for r in lake.changes("mart.h", lake.log.last() - 1, lake.log.last()).collect()}
    assert changed == {"insert", "update_preimage", "update_postimage"}


def test_a_crash_loads_no_page_twice(spark, lake):
    """Page 2 fails once: the next run goes on behind page 1.  After a commit a kept buffer is not loaded again."""
    asked, broken = [], [True]

    def pages(page):
        asked.append(page)
        if page == 2 and broken:
            broken.clear()
            raise RuntimeError("the network is down")
        return {"rows": [{"id": page or 1}], "next": None if page == 2 else 2}

    fetch.library(fetch.Library("shaky", fetch=lambda page: pages(page), columns={"id": "BIGINT"}))
    runner = Runner(spark, lake)
    model = lambda n: parse_model(f"-- @kind: append\n-- @fetch\nSELECT id, {n} AS run FROM shaky()", "raw.c")
    with pytest.raises(RuntimeError):
        runner.run(model(1))
    runner.run(model(1))
    assert asked == [None, 2, 2] and sorted(r.id for r in lake.read("raw.c").collect()) == [1, 2]
    clear, runner.state.clear_buffer = runner.state.clear_buffer, lambda target: None
    runner.run(model(2))
    runner.state.clear_buffer = clear
    assert runner.state.buffered("raw.c") and runner.state.fetch_of("raw.c")[0] in lake.log.acked()
    runner.run(model(3))
    assert sorted((r.id, r.run) for r in lake.read("raw.c").collect() if r.run == 3) == [(1, 3), (2, 3)]
    assert not runner.state.buffered("raw.c")


def test_push_reads_a_chunk_at_once(spark, lake, monkeypatch):
    sizes, scans = [], []
    plain = push.hydrate
    monkeypatch.setattr(push, "hydrate", lambda *a: scans.append(len(a[2])) or plain(*a))
    lib = fetch.Library("many", push=lambda rows: sizes.append(len(rows)) or {f"{r['__rowid']}:{r['__change_type']}": "error: no" if r["id"] % 50 == 0 else "ok" for r in rows})
    fetch.library(lib)
    runner = Runner(spark, lake)
    found = runner.run(parse_model("-- @push: many\nSELECT id FROM range(250) t(id)", "raw.n"))
    assert scans == [250] and sizes == [100, 100, 50] and len(found.warnings) == 5 and runner.state.backlog("raw.n") == 5


def test_macros():
    from sparkloom.functions.sqlmacros import MacroError, Macros

    own = Macros(["CREATE MACRO a(x) AS b(x) + 1; -- comment\nCREATE MACRO s.b(x, k := 2) AS x * k;", "CREATE MACRO loop(x) AS loop(x);"], "p_")
    assert own.expand("SELECT a(v - 1), 'a(1)' FROM t -- a(2)") == "SELECT (((v - 1) * 2) + 1), 'a(1)' FROM t -- a(2)"
    assert own.expand("SELECT b(x := 3, k := y)") == "SELECT (3 * y)" and own.expand("p_row_count('a.b')") == "((SELECT count(*) FROM a.b))"
    assert own.expand("SELECT now(), strftime(d, '%H h')") == "SELECT now(), date_format(d, 'HH \\'h\\'')"
    for bad in ("loop(1)", "a()", "b(1, 2, 3)", "column_type(a + b, 'c')"):
        with pytest.raises(MacroError):
            own.expand(bad)


def test_own_checks_in_sql(spark, lake):
    runner = Runner(spark, lake, macros=["CREATE MACRO constraint_under(t, col, lim) AS TABLE SELECT 1 FROM query_table(t) WHERE query_columns(col) >= lim;"])
    runner.run(parse_model("-- @constraint: under(id, 10)\nSELECT id FROM range(10) t(id)", "raw.u"))
    with pytest.raises(RunError, match="constraint failed"):
        runner.run(parse_model("-- @constraint: under(id, 9)\nSELECT id FROM range(10) t(id)", "raw.v"))


def test_cli_knows_the_project_s_macros(spark, tmp_path, capsys):
    from sparkloom import cli

    (tmp_path / "models" / "raw").mkdir(parents=True)
    (tmp_path / "config" / "macros").mkdir(parents=True)
    (tmp_path / "config" / "macros" / "m.sql").write_text("CREATE MACRO plus(a) AS a + 1;")
    (tmp_path / "models" / "raw" / "t.sql").write_text("SELECT plus(id) AS id FROM range(3) t(id)")
    assert cli.main(["--project", str(tmp_path), "run"], spark) == 0
    assert cli.main(["--project", str(tmp_path), "sql", "SELECT plus(max(id)) AS m FROM raw.t", "--format", "csv"], spark) == 0
    assert capsys.readouterr().out.rstrip().endswith("4")
    assert cli.main(["--project", str(tmp_path), "sql", "SUMMARIZE raw.t", "--format", "json"], spark) == 0
    assert '"rows": 3' in capsys.readouterr().out


def test_http_libraries(spark, lake, tmp_path):
    """Pages, authentication, a refusal that is tried again, and batches, against a server of this process."""
    import json as js
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from sparkloom.sources import api

    seen, refused, taken = [], [1], []

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status, body, **headers):
            self.send_response(status)
            for k, v in headers.items():
                self.send_header(k.replace("_", "-"), v)
            self.end_headers()
            self.wfile.write(js.dumps(body).encode())

        def do_GET(self):
            seen.append((self.path, self.headers.get("X-Api-Key"), self.headers.get("Accept")))
            if refused:
                refused.pop()
                return self.answer(429, {}, Retry_After="0")
            second = "page=2" in self.path
            self.answer(200, {"items": [{"id": 2 if second else 1}], "next": None if second else 2})

        def do_POST(self):
            taken.append(js.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.answer(201, {"ok": True})

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "shop.py").write_text(
        f"""
API = {{"base_url": "http://127.0.0.1:{server.server_port}/v1", "auth": {{"env": "KEY", "header": "X-Api-Key"}}, "headers": {{"Accept": "text/json"}}, "retry": 2, "backoff": 0, "rate_limit": {{"requests": 1000, "per": "1s"}},
    "fetch": {{"args": ["what"], "page_size": 1, "supported_kinds": ["table", "append"]}}, "push": {{"batch_size": 2}}}}
def fetch(what, page, http, save):
    got = http.get(what, params={{"page": page or 1}}).json()
    for x in got["items"]:
        save.row(x)
    return {{"rows": [], "next": got["next"]}}
def push(rows, http):
    return "ok" if http.post("/take", json=[r["id"] for r in rows]).ok else "error"
"""
    )
    assert api.load_libraries(str(tmp_path), {"KEY": "k1"}) == ["shop"]
    runner = Runner(spark, lake)
    runner.run(parse_model("-- @fetch\n-- @push: shop\nSELECT id::BIGINT AS id FROM shop('items')", "raw.shop"))
    server.shutdown()
    assert sorted(r.id for r in lake.read("raw.shop").collect()) == [1, 2] and sorted(taken[0]) == [1, 2]
    assert seen[0] == seen[1] == ("/v1/items?page=1", "k1", "text/json") and len(seen) == 3
    with pytest.raises(RunError, match="does not give kind"):
        runner.run(parse_model("-- @kind: merge\n-- @unique_key: id\n-- @fetch\nSELECT id FROM shop('items')", "raw.other"))
    basic = api.authorize({"user": {"env": "U"}, "pass": {"env": "P"}}, {"U": "a", "P": "b"})
    assert basic == ({"Authorization": "Basic YTpi"}, {}) and api.authorize({"env": "K", "param": "key"}, {"K": "1"}) == ({}, {"key": "1"})
    assert api.authorize({"provider": "some-one"}, {"OAUTH_TOKEN_SOME_ONE": "t"})[0] == {"Authorization": "Bearer t"}
    with pytest.raises(api.ApiError):
        api.authorize({"env": "K"}, {})
    assert [api.seconds(x) for x in ("5s", "2m", "1h", 3, "250ms")] == [5, 120, 3600, 3, 0.25]
