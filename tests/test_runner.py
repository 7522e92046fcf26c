import pytest

from sparkloom.lake import Conflict
from sparkloom.model import parse_model
from sparkloom.runner import Runner, RunError

KINDS = {
    "staging.app": "-- @kind: append\nSELECT id, customer, region, amount FROM raw.orders",
    "staging.mrg": "-- @kind: merge\n-- @unique_key: id\nSELECT id, customer, region, amount FROM raw.orders",
    "staging.trk": "-- @kind: tracked\n-- @group_key: region\nSELECT id, customer, region, amount FROM raw.orders",
    "staging.trk_id": "-- @kind: tracked\n-- @group_key: id\nSELECT id, customer, region, amount FROM raw.orders",
    "staging.scd": "-- @kind: scd2\n-- @unique_key: id\nSELECT id, customer, region, amount FROM raw.orders",
}
ONE = "(1, 'Alice', 'SE', 100), (2, 'Bob', 'US', 200), (3, 'Charlie', 'SE', 150), (4, 'Diana', 'US', 300)"
THREE = "(1, 'Alice', 'SE', 150), (2, 'Bob', 'US', 200), (5, 'Eve', 'NO', 500)"
WITH = "(1, 'Alice', 'SE', 150, 'web'), (2, 'Bob', 'US', 200, 'app'), (5, 'Eve', 'NO', 500, 'web')"


def raw(values, columns="id, customer, region, amount"):
    return parse_model(f"SELECT * FROM (VALUES {values}) AS t({columns})", "raw.orders")


def models(values, extra=""):
    names = "id, customer, region, amount" + extra
    return [raw(values, names), *[parse_model(t.replace("id, customer, region, amount", names), n) for n, t in KINDS.items()]]


def counts(lake):
    out = [lake.read(n).count() for n in ("raw.orders", "staging.app", "staging.mrg", "staging.trk", "staging.trk_id", "staging.scd")]
    return [*out, lake.read("staging.scd").where("is_current").count()]


def test_all_kinds_over_six_runs(spark, lake):
    runner = Runner(spark, lake)
    expected = [[4, 4, 4, 4, 4, 4, 4]] * 2 + [[3, 6, 5, 3, 3, 6, 3], [3, 9, 5, 3, 3, 9, 3], [3, 12, 5, 3, 3, 9, 3], [3, 12, 5, 3, 3, 9, 3]]
    runs = [models(ONE), models(ONE), models(THREE), models(WITH, ", channel"), models(THREE), models(THREE)]
    for want, batch in zip(expected, runs):
        results = runner.run_all(batch)
        assert [r.error for r in results] == [None] * 6
        assert counts(lake) == want


def test_failure_skips_what_is_below(spark, lake):
    bad = parse_model("-- @constraint: not_null(id)\nSELECT CAST(NULL AS INT) AS id", "raw.a")
    below = [parse_model("SELECT id FROM raw.a", "staging.b"), parse_model("SELECT id FROM staging.b", "mart.c")]
    found = {r.model: r for r in Runner(spark, lake).run_all([*below, bad])}
    assert "constraint failed" in found["raw.a"].error
    assert found["mart.c"].reason == found["staging.b"].reason == "skipped: upstream model failed"
    assert lake.log.last() == -1


def test_failed_audit_leaves_the_old_version(spark, lake):
    runner = Runner(spark, lake)
    runner.run(parse_model("SELECT 1 AS id", "raw.a"))
    with pytest.raises(RunError, match="audit failed"):
        runner.run(parse_model("-- @audit: row_count(>=, 5)\nSELECT 2 AS id", "raw.a"))
    assert [r.id for r in lake.read("raw.a").collect()] == [1]


def test_time_travel_and_changes(spark, lake):
    runner = Runner(spark, lake)
    text = "-- @kind: merge\n-- @unique_key: id\nSELECT * FROM (VALUES {}) AS t(id, v)"
    src = lambda v: parse_model(f"SELECT * FROM (VALUES {v}) AS t(id, v)", "raw.s")
    target = parse_model("-- @kind: merge\n-- @unique_key: id\nSELECT id, v FROM raw.s", "mart.t")
    runner.run_all([src("(1, 10), (2, 20)"), target])
    first = lake.log.last()
    runner.run_all([src("(2, 25), (3, 30)"), target])
    assert {(r.id, r.v) for r in lake.read("mart.t").collect()} == {(1, 10), (2, 25), (3, 30)}
    assert {(r.id, r.v) for r in lake.read("mart.t", first).collect()} == {(1, 10), (2, 20)}
    found = {(r.change_type, r.id, r.v) for r in lake.changes("mart.t", first + 1, lake.log.last()).collect()}
    assert found == {("update_preimage", 2, 20), ("update_postimage", 2, 25), ("insert", 3, 30)}
    assert text


def test_row_limits_are_refused_and_conflicts_are_seen(spark, lake):
    with pytest.raises(RunError, match="LIMIT"):
        Runner(spark, lake).run(parse_model("SELECT 1 AS a LIMIT 1", "raw.a"))
    lake.commit({}, base=-1)
    with pytest.raises(Conflict):
        lake.commit({}, base=-1)


def test_decisions(spark, lake):
    runner = Runner(spark, lake)
    batch = [parse_model("SELECT 1 AS id", "raw.a"), parse_model("SELECT id FROM raw.a", "mart.b")]
    assert [(r.run_type, r.reason) for r in runner.run_all(batch)] == [("backfill", "first run")] * 2
    assert [(r.run_type, r.reason) for r in runner.run_all(batch)] == [("skip", "no dependencies"), ("skip", "deps unchanged")]
    batch[0] = parse_model("SELECT 2 AS id", "raw.a")
    assert [(r.run_type, r.reason) for r in runner.run_all(batch)] == [("backfill", "sql changed"), ("full", "dep changed: raw.a")]


def test_cursor_variables_and_masks(spark, lake):
    runner = Runner(spark, lake)
    seed = parse_model("SELECT * FROM (VALUES (1, 'ann@x.org'), (2, 'bob@x.org')) AS t(id, email)", "raw.p")
    model = parse_model("-- @kind: append\n-- @incremental: id\n-- @incremental_initial: 0\n-- @column: email = address | mask_email\nSELECT id, email FROM raw.p WHERE id > CAST(getvariable('incr_last_value') AS INT)", "mart.p")
    runner.run_all([seed, model])
    assert {r.email for r in lake.read("mart.p").collect()} == {"a***@x.org", "b***@x.org"}


def test_rename_keeps_values(spark, lake):
    runner = Runner(spark, lake)
    seed = parse_model("SELECT 1 AS id, 'x' AS v", "raw.p")
    runner.run_all([seed, parse_model("-- @kind: append\nSELECT id, v FROM raw.p", "mart.p")])
    found = runner.run_all([seed, parse_model("-- @kind: append\nSELECT id, v AS w FROM raw.p", "mart.p")])
    assert "v → w" in found[1].warnings[0]
    assert [r.w for r in lake.read("mart.p").collect()] == ["x", "x"]


@pytest.mark.parametrize("folder", ["plain", "with space", "per%20cent %41"])
def test_merge_rewrites_files_under_any_path(spark, tmp_path, folder):
    from sparkloom.lake import Lake

    lake = Lake(spark, f"file://{tmp_path}/{folder}")
    text = "-- @kind: merge\n-- @unique_key: id\nSELECT id, v FROM raw.s"
    for values, want in (("(1, 1), (2, 2)", [(1, 1), (2, 2)]), ("(1, 9)", [(1, 9), (2, 2)]), ("(2, 8), (3, 3)", [(1, 9), (2, 8), (3, 3)])):
        found = Runner(spark, lake).run_all([parse_model(f"SELECT * FROM (VALUES {values}) AS t(id, v)", "raw.s"), parse_model(text, "mart.t")])
        assert [r.error for r in found] == [None, None]
        assert sorted((r.id, r.v) for r in lake.read("mart.t").collect()) == want


def test_a_source_of_several_columns_tells_no_rename():
    from sparkloom.plans.lineage import IDENTITY, Output, Source, renames

    x, y = Source("t", "x", IDENTITY), Source("t", "y", IDENTITY)
    assert renames([Output("a", [x]), Output("k", [x])], [Output("b", [x]), Output("k", [x])]) == []
    assert renames([Output("a", [x]), Output("k", [y])], [Output("b", [x]), Output("k", [y])]) == [("a", "b")]
    assert renames([Output("a", [x])], [Output("b", [x]), Output("c", [x])]) == []


def test_failing_changed_rows_run_in_full(spark, lake):
    """A delta on which the query fails while it runs is answered by a full run."""
    runner = Runner(spark, lake)
    model = parse_model("-- @kind: append\nSELECT id, assert_true((SELECT count(*) FROM raw.s) >= 2) AS ok FROM raw.s", "mart.t")
    seed = lambda v: parse_model(f"SELECT * FROM (VALUES {v}) AS t(id)", "raw.s")
    assert [r.error for r in runner.run_all([seed("1, 2"), model])] == [None, None]
    found = runner.run_all([seed("1, 2, 3"), model])[1]
    assert found.error is None and found.run_type == "backfill" and "full run" in found.warnings[0]
    assert sorted(r.id for r in lake.read("mart.t").collect()) == [1, 2, 3]
