"""Edge cases: empty sides, nulls, tombstones, fallbacks, verdicts, gates."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from replicakit.constants import SIDE_A, SIDE_B
from replicakit.functions.text import (
    UnknownSideError,
    canon_side,
    checked_table_name,
    first_token,
    is_true,
    map_namespace,
)
from replicakit.operators.counts import (
    GuardRefused,
    compare_counts,
    count_with_fallback,
    count_with_guard,
)
from replicakit.operators.diff import apply_diff, resync_diff
from replicakit.operators.fold import apply_changes, control_state
from replicakit.operators.integrity import check_not_null, check_unique
from replicakit.operators.inventory import is_in_mode, namespaces_in_mode, state_of
from replicakit.operators.upsert import fill_defaults, now_default, upsert, uuid_default
from replicakit.plans.replica import ChangeSpec, readonly_view
from replicakit.plans.status import health_sources, ready_gate
from replicakit.session import scratch_path
from replicakit.sources.registry import (
    Registry,
    create_if_absent,
    read_side,
    resolve_default,
    swap_default,
)

T = dt.datetime


def test_sides_and_namespaces():
    for s in ("ca", "A", "1", "Primary", "p"):
        assert canon_side(s) == SIDE_A
    for s in ("CB", "b", "2", "standby", "S"):
        assert canon_side(s) == SIDE_B
    with pytest.raises(UnknownSideError):
        canon_side("c")
    assert map_namespace("CRLA") == "va"
    assert map_namespace("crlb-readonly") == "vb-readonly"
    assert map_namespace("SYSTEM") == "system"
    assert map_namespace("Tenant9") == "Tenant9"


def test_reference_inventory_predicates(spark):
    # The inventory shape the reference tool reads (four namespaces).
    inv = spark.createDataFrame(
        [(1, "system", "ready", "shared"), (2, "va", "ready", "shared"),
         (3, "vb", "replicating", "none"), (4, "vb-readonly", "ready", "shared")],
        "id bigint, name string, data_state string, service_mode string")
    assert sorted(r[0] for r in namespaces_in_mode(inv, "shared").collect()) == [
        "system", "va", "vb-readonly"]
    names = spark.createDataFrame([("va",), ("vb",), ("v",), ("va ",), ("CRLA",), ("crlb",)],
                                  "name string")
    got = {r["name"]: r["in_mode"] for r in is_in_mode(names, inv, "shared").collect()}
    assert got == {"va": True, "vb": False, "v": False, "va ": False, "CRLA": True,
                   "crlb": False}
    assert state_of(inv, "vb-readonly").first()["data_state"] == "ready"


def test_first_token_and_checks(spark):
    df = spark.createDataFrame(
        [("x\tREADY\t",), ("Replicating since", ), ("nothing",), (None,), ("added",)], "t string")
    got = [r[0] for r in df.select(first_token("t", ["add", "ready", "replicating"])).collect()]
    assert got == ["ready", "replicating", None, None, "add"]
    names = spark.createDataFrame([("movr.users",), ("a b",), ("x\n",), ("",), (None,)], "n string")
    got = [r[0] for r in names.select(checked_table_name("n", "movr.users")).collect()]
    assert got == ["movr.users", "movr.users", "movr.users", "movr.users", "movr.users"]
    ok = spark.createDataFrame([("db_1.t_2",)], "n string")
    assert ok.select(checked_table_name("n", "fb")).first()[0] == "db_1.t_2"
    flags = spark.createDataFrame([("1",), ("TRUE",), ("Yes",), ("on",), (" 1",), ("0",), (None,)],
                                  "f string")
    assert [r[0] for r in flags.select(is_true("f")).collect()] == [
        True, True, True, True, False, False, False]


def test_control_state_keeps_equals_and_deletes(spark):
    log = spark.createDataFrame(
        [(1, "K", "set", "a=b"), (2, "K", "set", "=x=y"), (3, "D", "set", "1"), (4, "D", "del", None),
         (5, "R", "del", None), (6, "R", "set", " 1")],
        "version bigint, key string, op string, value string")
    got = {r["key"]: r["value"] for r in control_state(log).collect()}
    assert got == {"K": "=x=y", "R": " 1"}


def test_fold_tombstone_blocks_late_upsert(spark):
    log = spark.createDataFrame(
        [(1, T(2024, 1, 1), 1, "upsert", "a"), (1, T(2024, 1, 3), 2, "delete", None)],
        "k bigint, ts timestamp_ntz, seq bigint, op string, v string")
    spec = ChangeSpec(keys=("k",), order=("ts", "seq"), op_col="op")
    base = apply_changes(log, ["k"], ["ts", "seq"], keep_deletes=True)
    assert base.count() == 1  # tombstone kept
    late = spark.createDataFrame([(1, T(2024, 1, 2), 3, "upsert", "late")], log.schema)
    assert readonly_view(base, late, spec).count() == 0
    # Deleted, then inserted again later: the key is back.
    again = spark.createDataFrame([(1, T(2024, 1, 4), 4, "upsert", "again")], log.schema)
    assert readonly_view(base, again, spec).first()["v"] == "again"


def test_diff_with_nulls_and_empty_sides(spark):
    schema = "k bigint, v string"
    src = spark.createDataFrame([(1, None), (2, "b"), (None, "n")], schema)
    rep = spark.createDataFrame([(1, None), (2, None), (None, "n"), (4, "d")], schema)
    got = {(r["k"], r["action"]) for r in resync_diff(src, rep, ["k"]).collect()}
    assert got == {(2, "update"), (4, "delete")}
    fixed = apply_diff(rep, resync_diff(src, rep, ["k"]), ["k"])
    assert sorted(map(tuple, fixed.collect()), key=str) == sorted(map(tuple, src.collect()), key=str)
    empty = spark.createDataFrame([], schema)
    assert resync_diff(src, empty, ["k"]).count() == 3
    assert resync_diff(empty, src, ["k"]).filter("action = 'delete'").count() == 3
    assert resync_diff(src, empty, ["k"], exact=False, buckets=8).count() == 3


def test_upsert_keeps_given_nulls_and_fills_defaults(spark):
    base = spark.createDataFrame([(1, "a", "x")], "k bigint, v string, w string")
    rows = spark.createDataFrame([(1, None), (2, "b")], "k bigint, v string")
    got = {r["k"]: (r["v"], r["w"]) for r in upsert(base, rows, ["k"], {"w": "dflt"}).collect()}
    assert got == {1: (None, "x"), 2: ("b", "dflt")}
    filled = fill_defaults(rows, {"id": uuid_default(), "at": now_default()}).collect()
    assert all(r["id"] and r["at"] for r in filled)
    assert check_not_null(rows, ["k", "v"]).collect()[1]["n_nulls"] == 1


def test_check_unique_and_empty(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k bigint")
    assert [tuple(r) for r in check_unique(df, ["k"]).collect()] == [(1, 2)]
    assert check_unique(df.limit(0), ["k"]).count() == 0


def test_compare_counts_verdicts(spark):
    a = spark.createDataFrame([("t1", 5), ("t2", 5), ("t3", 1), ("t4", None)],
                              "table_name string, n_rows bigint")
    b = spark.createDataFrame([("t1", 5), ("t2", 4), ("t4", 3), ("t5", 1)],
                              "table_name string, n_rows bigint")
    got = {r["table_name"]: r["verdict"] for r in compare_counts(a, b).collect()}
    assert got == {"t1": "match", "t2": "mismatch", "t3": "waiting", "t4": "waiting",
                   "t5": "waiting"}


def test_registry_pointers_fallback_and_guard(spark):
    reg = Registry(spark, scratch_path(spark, "reg"))
    df = spark.createDataFrame([(1, "a")], "id bigint, name string")
    assert create_if_absent(spark, reg, "A", "va", "accounts", df.schema)
    assert not create_if_absent(spark, reg, "A", "va", "accounts", df.schema)
    assert reg.read("A", "va", "accounts").count() == 0
    reg.write_version("A", "va", "accounts", df)
    assert resolve_default(reg, "B") == "vb"
    swap_default(reg, "standby", "crlb-readonly")
    assert resolve_default(reg, "b") == "vb-readonly"
    with pytest.raises(AnalysisException):
        read_side(spark, reg, "B", None, "accounts")
    got = count_with_fallback(spark, reg, "A", ["accounts", "nope"], "va-readonly", "va").collect()
    assert [tuple(r) for r in got] == [("accounts", "va", 1), ("nope", None, None)]
    # Guard: fallback only when the alternative is shared.
    with pytest.raises(GuardRefused):
        count_with_guard(spark, reg, "A", ["accounts"], "va-readonly", "va")
    reg.set_mode("A", "va", "shared")
    got = count_with_guard(spark, reg, "A", ["accounts"], "va-readonly", "va").first()
    assert (got["served_by"], got["n_rows"]) == ("va", 1)
    # A fresh registry on the same root sees the same state.
    again = Registry(spark, reg.root)
    assert resolve_default(again, "B") == "vb-readonly"
    assert again.read("A", "va", "accounts").count() == 1


def test_ready_gate_both_verdicts_and_failover_form(spark):
    polls = spark.createDataFrame(
        [(0, 1, "status initializing", "add"), (0, 2, "x REPLICATING y", "Ready"),
         (1, 1, "replicating", "add"), (1, 2, "replicating", "add"), (1, 3, "replicating", "ready")],
        "replica bigint, try_no bigint, status_text string, data_state_text string")
    got = {r["replica"]: (r["verdict"], r["tries"]) for r in ready_gate(polls, 2).collect()}
    assert got == {0: ("ready", 2), 1: ("timeout", 2)}
    ready_only = ready_gate(polls, 3, status_word=None)
    got = {r["replica"]: r["verdict"] for r in ready_only.collect()}
    assert got == {0: "ready", 1: "ready"}
    # The same polls given by order instead of try numbers.
    by_order = polls.withColumnRenamed("try_no", "at")
    for n in (1, 2, 3):
        want = {r["replica"]: (r["verdict"], r["tries"]) for r in ready_gate(polls, n).collect()}
        got = {r["replica"]: (r["verdict"], r["tries"])
               for r in ready_gate(by_order, n, order=["at"]).collect()}
        assert got == want, n


def test_health_sources_directions():
    assert health_sources({"REPL_ATOB_ACTIVE": "1"})[1]["CB"] == ("vb-readonly", "vb")
    assert health_sources({"REPL_ATOB_ACTIVE": "0", "REPL_BTOA_ACTIVE": "yes"})[0] == "B->A"
    assert health_sources({"REPL_ATOB_ACTIVE": " 1"})[0] == "none"


def test_scenario_dry_run_writes_nothing(spark):
    from conftest import SF_SMALL
    from replicakit import fixtures as fx
    from replicakit.operators.diff import diff_summary
    from replicakit.plans.scenario import STEPS, run_scenario

    reg = Registry(spark, scratch_path(spark, "dry"))
    reg.mount("A", "va", "orders", fx.orders_a(spark, SF_SMALL))
    reg.mount("B", "vb", "orders", fx.orders_b(spark, SF_SMALL))
    out = run_scenario(spark, reg, "orders", ["o_orderkey"], [], dry_run=True).collect()
    assert [r["step"] for r in out] == list(STEPS)
    want = {r["action"]: r["n_rows"] for r in diff_summary(
        resync_diff(fx.orders_a(spark, SF_SMALL), fx.orders_b(spark, SF_SMALL),
                    ["o_orderkey"])).collect()}
    assert out[8]["detail"] == (f"insert={want['insert']}, update={want['update']}, "
                                f"delete={want['delete']}")
    assert reg.state() == {}  # nothing was written


def test_watch_counts_live_trigger_stops_at_match(spark):
    from conftest import SF_SMALL
    from replicakit import fixtures as fx
    from replicakit.streaming.watch import watch_counts

    reg = Registry(spark, scratch_path(spark, "watch"))
    log = fx.change_log(spark, SF_SMALL)
    reg.mount("A", "va", "log", log)
    reg.mount("B", "vb", "log", log)
    n_a = log.count()
    ticks = watch_counts(reg, "log", out=scratch_path(spark, "ticks"), ckpt=scratch_path(spark, "ckpt"),
                         every="1 second").collect()
    assert [(r["tick"], r["n_b"], r["verdict"]) for r in ticks] == [(1, n_a, "match")]


def test_guard_raises_on_other_failures(spark):
    reg = Registry(spark, scratch_path(spark, "guard"))
    bad = scratch_path(spark, "not-parquet")
    spark.createDataFrame([("x",)], "value string").write.text(bad)
    reg.mount("B", "vb-readonly", "t", bad)
    reg.mount("B", "vb", "t", spark.createDataFrame([(1,)], "k int"))
    reg.set_mode("B", "vb", "shared")
    with pytest.raises(Exception) as err:
        count_with_guard(spark, reg, "B", ["t"], "vb-readonly", "vb")
    assert not isinstance(err.value, GuardRefused)
    # The plain fallback takes any failure.
    got = count_with_fallback(spark, reg, "B", ["t"], "vb-readonly", "vb").first()
    assert (got["served_by"], got["n_rows"]) == ("vb", 1)


def test_diff_repairs_duplicated_replica_keys(spark):
    schema = "k bigint, v string"
    src = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], schema)
    rep = spark.createDataFrame([(1, "a"), (1, "a"), (2, "x"), (2, "b"), (4, "d"), (4, "d")],
                                schema)
    diff = resync_diff(src, rep, ["k"])
    got = sorted((r["k"], r["action"]) for r in diff.collect())
    assert got == [(1, "update"), (2, "update"), (3, "insert"), (4, "delete")]
    fixed = apply_diff(rep, diff, ["k"])
    assert sorted(map(tuple, fixed.collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert resync_diff(src, fixed, ["k"]).count() == 0


def test_cutover_timeout_both_ways(spark):
    from pyspark.sql import functions as F

    from conftest import SF_SMALL
    from replicakit import fixtures as fx
    from replicakit.plans.replication import Replication, ReplicationTimeout, load
    from replicakit.plans.scenario import create_sides

    reg = Registry(spark, scratch_path(spark, "cut"))
    create_sides(reg)
    orders = fx.orders_a(spark, SF_SMALL)
    load(reg, "A", "orders", orders.filter(F.col("o_orderstatus") != "P"), ["o_orderkey"])
    rep = Replication(reg, "A", "B", "orders", ["o_orderkey"])
    rep.start()
    load(reg, "A", "orders", orders, ["o_orderkey"])
    with pytest.raises(ReplicationTimeout):
        rep.cutover(timeout_s=0.001)
    assert resolve_default(reg, "B") == "vb-readonly"  # nothing switched
    rep.cutover(timeout_s=0.001, on_timeout="continue")  # the reference tool's way
    assert resolve_default(reg, "B") == "vb"
    assert reg.read("B", "vb", "orders").count() <= orders.count()


def test_scenario_stops_at_failing_step(spark):
    from conftest import SF_SMALL
    from replicakit import fixtures as fx
    from replicakit.plans.scenario import run_scenario

    orders = fx.orders_a(spark, SF_SMALL)
    bad = orders.withColumnRenamed("o_custkey", "no_such_column")
    reg = Registry(spark, scratch_path(spark, "fail"))
    out = run_scenario(spark, reg, "orders", ["o_orderkey"], [orders, bad, orders]).collect()
    assert [r["ok"] for r in out] == [True, True, True, False]
    assert out[-1]["step"] == "load B" and out[-1]["detail"].startswith("failed at step: load B")


def test_watch_counts_live_ends_without_new_data(spark):
    """Two sides that nothing changes: the watch ends after its ticks."""
    from conftest import SF_SMALL
    from replicakit import fixtures as fx
    from replicakit.streaming.watch import watch_counts

    reg = Registry(spark, scratch_path(spark, "watch"))
    log = fx.change_log(spark, SF_SMALL)
    reg.mount("A", "va", "log", log)
    reg.mount("B", "vb", "log", log.limit(10))
    ticks = watch_counts(reg, "log", out=scratch_path(spark, "ticks"), ckpt=scratch_path(spark, "ckpt"),
                         max_ticks=3, every="1 second").collect()
    assert sorted((r["tick"], r["n_b"], r["verdict"]) for r in ticks) == [(i, 10, "mismatch") for i in (1, 2, 3)]


def test_broadcast_check_bounds_rows_and_bytes(spark):
    from replicakit.operators.sizing import has_at_most

    df = spark.createDataFrame([(i, "x" * 100) for i in range(50)], "k bigint, s string")
    assert has_at_most(df, 50) and not has_at_most(df, 49)
    assert has_at_most(df, 50, max_bytes=50 * 108)
    assert not has_at_most(df, 50, max_bytes=50 * 108 - 1)


def test_cutover_to_a_point_in_time(spark):
    import datetime

    from conftest import SF_SMALL
    from replicakit import fixtures as fx
    from replicakit.plans.replication import Replication, load
    from replicakit.plans.scenario import create_sides

    reg = Registry(spark, scratch_path(spark, "pit"))
    create_sides(reg)
    orders = fx.orders_a(spark, SF_SMALL)
    first = orders.filter("o_orderstatus = 'F'")
    load(reg, "A", "orders", first, ["o_orderkey"])
    rep = Replication(reg, "A", "B", "orders", ["o_orderkey"])
    rep.start()
    with pytest.raises(ValueError):
        rep.cutover(to=datetime.datetime(2000, 1, 1))
    mid = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    load(reg, "A", "orders", orders, ["o_orderkey"])
    rep.cutover(to=mid)  # changes after ``mid`` are not part of the cutover
    assert reg.read("B", "vb", "orders").count() == first.count()


def test_load_refuses_other_keys(spark):
    from conftest import SF_SMALL
    from replicakit import fixtures as fx
    from replicakit.plans.replication import load

    reg = Registry(spark, scratch_path(spark, "keys"))
    orders = fx.orders_a(spark, SF_SMALL)
    load(reg, "A", "orders", orders, ["o_orderkey"])
    with pytest.raises(ValueError):
        load(reg, "A", "orders", orders, ["o_custkey"])


def test_run_sql_defaults_and_smoke_verdict(spark):
    from replicakit.plans.scenario import smoke_passed
    from replicakit.sources.registry import run_sql

    reg = Registry(spark, scratch_path(spark, "sql"))
    reg.mount("A", "va", "t", spark.createDataFrame([(1,), (2,)], "k int"))
    reg.mount("A", "va-readonly", "t", spark.createDataFrame([(1,)], "k int"))
    swap_default(reg, "A", "va-readonly")
    assert run_sql(spark, reg, "SELECT count(*) AS n FROM t").first()["n"] == 2  # main ns
    assert run_sql(spark, reg, "SELECT count(*) AS n FROM t", "p", "crla-readonly").first()["n"] == 1
    assert smoke_passed(spark, reg) is False  # B has no namespace
    reg.set_mode("B", "vb", "shared")
    assert smoke_passed(spark, reg) is True  # B has one without tables: nothing fails
    reg.mount("B", "vb", "broken", "/nonexistent/path")
    assert smoke_passed(spark, reg) is False


def test_status_report_shows_ingesting_side(spark):
    from conftest import SF_SMALL
    from replicakit import fixtures as fx
    from replicakit.plans.replication import Replication, load
    from replicakit.plans.scenario import create_sides
    from replicakit.plans.status import status_report

    reg = Registry(spark, scratch_path(spark, "status"))
    create_sides(reg)
    load(reg, "A", "orders", fx.orders_a(spark, SF_SMALL), ["o_orderkey"])
    Replication(reg, "A", "B", "orders", ["o_orderkey"]).start()
    report, extra = status_report(spark, reg, ["orders"])
    got = {(r["section"], r["side"], r["name"]): r["value"] for r in extra.collect()}
    assert got[("ingesting", "CB", "vb")] == "True" and got[("ingesting", "CA", "va")] == "False"
    assert got[("pointer", "CB", "default")] == "vb-readonly"
    assert report.first()["verdict"] == "match"


def test_another_driver_reads_the_replica(spark):
    from conftest import SF_SMALL
    from replicakit import fixtures as fx
    from replicakit.plans.replication import Replication, load
    from replicakit.plans.scenario import create_sides

    reg = Registry(spark, scratch_path(spark, "durable"))
    create_sides(reg)
    orders = fx.orders_a(spark, SF_SMALL)
    load(reg, "A", "orders", orders, ["o_orderkey"])
    Replication(reg, "A", "B", "orders", ["o_orderkey"]).start()
    other = Registry(spark, reg.root)  # a fresh driver: no mounts, state from the log
    assert other.tables("B", "vb-readonly") == ["orders"]
    assert read_side(spark, other, "B", None, "orders").count() == orders.count()
    Replication(other, "A", "B", "orders", ["o_orderkey"]).cutover()
    assert other.read("B", "vb", "orders").count() == orders.count()


def test_another_driver_reads_a_restarted_replica(spark):
    from conftest import SF_SMALL
    from replicakit import fixtures as fx
    from replicakit.plans.replication import restart_replication

    reg = Registry(spark, scratch_path(spark, "durable2"))
    reg.mount("A", "va", "orders", fx.orders_a(spark, SF_SMALL))  # mounted: keys not recorded
    reg.mount("B", "vb", "orders", fx.orders_b(spark, SF_SMALL))
    restart_replication(reg, "A", "B", "orders", ["o_orderkey"])
    other = Registry(spark, reg.root)
    other.mount("A", "va", "orders", fx.orders_a(spark, SF_SMALL))
    assert other.read("B", "vb-readonly", "orders").count() == fx.orders_a(spark, SF_SMALL).count()


def test_reference_seed_flow_on_its_own_schema(spark):
    # accounts: id UUID primary key default random, name not null, created_at
    # not null default now; seeded by an upsert of (id, name), twice.
    from replicakit.operators.integrity import check_not_null, check_unique
    from replicakit.operators.upsert import now_default, upsert

    schema = "id string, name string, created_at timestamp"
    reg = Registry(spark, scratch_path(spark, "seed"))
    assert create_if_absent(spark, reg, "A", "va", "va_db.accounts", spark.createDataFrame(
        [], schema).schema)
    seed = spark.createDataFrame([("00000000-0000-0000-0000-000000000001", "seed-va-1")],
                                 "id string, name string")
    for _ in range(2):  # idempotent
        table = upsert(reg.read("A", "va", "va_db.accounts"), seed, ["id"],
                       {"created_at": now_default()})
        reg.write_version("A", "va", "va_db.accounts", table)
    rows = reg.read("A", "va", "va_db.accounts").collect()
    assert len(rows) == 1 and rows[0]["name"] == "seed-va-1" and rows[0]["created_at"]
    first = rows[0]["created_at"]
    again = upsert(reg.read("A", "va", "va_db.accounts"),
                   seed.withColumn("name", F.lit("renamed")), ["id"],
                   {"created_at": now_default()}).first()
    assert again["created_at"] == first  # kept on update
    table = reg.read("A", "va", "va_db.accounts")
    assert {r["n_nulls"] for r in check_not_null(table, ["id", "name", "created_at"]).collect()} == {0}
    assert check_unique(table, ["id"]).count() == 0
