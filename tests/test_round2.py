"""Faults found in round 1, each with the case that showed it."""

import datetime as dt
import time

import pytest
from pyspark.errors import AnalysisException

from replicakit.plans.replica import last_batch
from replicakit.plans.replication import Replication, ReplicationTimeout, load, remove
from replicakit.plans.scenario import create_sides, smoke
from replicakit.plans.status import health_report
from replicakit.session import scratch_path
from replicakit.sources.registry import Registry, run_sql
from replicakit.streaming.watch import watch_counts


@pytest.fixture
def reg(spark):
    r = Registry(spark, scratch_path(spark, "round2"))
    create_sides(r)
    return r


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "k bigint, v string, w string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_run_sql_sees_one_side_only(spark, reg):
    load(reg, "A", "onlya", frame(spark, (1, "a", "a")), ["k"], ns="va")
    assert run_sql(spark, reg, "SELECT v FROM onlya", "A").first()[0] == "a"
    with pytest.raises(AnalysisException):
        run_sql(spark, reg, "SELECT * FROM onlya", "B")
    load(reg, "A", "x.t", frame(spark, (1, "x", "")), ["k"], ns="va")
    load(reg, "A", "y.t", frame(spark, (1, "y", "")), ["k"], ns="va")
    got = run_sql(spark, reg, "SELECT a.v, b.v AS u, 'x.t' AS s FROM x.t a JOIN y.t b USING (k)", "A")
    assert tuple(got.first()) == ("x", "y", "x.t")


def test_null_keys_and_repeated_keys(spark, reg):
    load(reg, "A", "t", frame(spark, (1, "a", "b"), (None, "n", "m")), ["k"], ns="va")
    load(reg, "A", "t", frame(spark, (None, "n2", None)).select("k", "v"), ["k"], ns="va")
    assert rows(reg.read("A", "va", "t")) == rows(frame(spark, (1, "a", "b"), (None, "n2", "m")))
    remove(reg, "A", "t", frame(spark, (None, "", "")).select("k"), ["k"], ns="va")
    assert rows(reg.read("A", "va", "t")) == [(1, "a", "b")]
    with pytest.raises(ValueError):
        load(reg, "A", "t", frame(spark, (2, "a", "b"), (2, "c", "d")), ["k"], ns="va")


def test_slow_clock_loses_no_load(spark, reg, monkeypatch):
    load(reg, "A", "t", frame(spark, (1, "a", "")), ["k"], ns="va")
    import replicakit.sources.registry as module

    real = module.time.time_ns
    monkeypatch.setattr(module.time, "time_ns", lambda: real() - 60_000_000_000)
    other = Registry(spark, reg.root)
    load(other, "A", "t", frame(spark, (2, "late", "")), ["k"], ns="va")
    assert (2, "late", "") in rows(other.read("A", "va", "t"))


def test_change_during_compaction_stays(spark, reg, monkeypatch):
    for i in range(3):
        load(reg, "A", "t", frame(spark, (i, "a", "")), ["k"], ns="va")
    merged, done = Registry._merged, []

    def meanwhile(self, *args):
        out = merged(self, *args)
        if not done:
            done.append(1)
            load(self, "A", "t", frame(spark, (99, "meanwhile", "")), ["k"], ns="va")
        return out

    monkeypatch.setattr(Registry, "_merged", meanwhile)
    reg.compact_table("A", "va", "t")
    assert done and len(rows(reg.read("A", "va", "t"))) == 4


def test_cutover_at_keeps_the_state_before(spark, reg):
    load(reg, "A", "t", frame(spark, (1, "base", ""), (2, "base", "")), ["k"], ns="va")
    rep = Replication(reg, "A", "B", "t", ["k"])
    info = rep.start()
    load(reg, "A", "t", frame(spark, (1, "mid", "")), ["k"], ns="va")
    at = reg.stamp()
    load(reg, "A", "t", frame(spark, (1, "late", "")), ["k"], ns="va")
    with pytest.raises(ValueError):
        rep.view(dt.datetime.fromisoformat(info.as_of) - dt.timedelta(seconds=1))
    rep.cutover(to=at)
    assert rows(reg.read("B", "vb", "t")) == [(1, "mid", ""), (2, "base", "")]


def test_smoke_fails_without_namespace(spark):
    empty = Registry(spark, scratch_path(spark, "round2"))
    assert not any(r.ok for r in smoke(spark, empty).collect())


def test_drains_leave_no_empty_files(spark, reg):
    load(reg, "A", "t", frame(spark, (1, "a", "")), ["k"], ns="va")
    rep = Replication(reg, "A", "B", "t", ["k"])
    info = rep.start()
    count = lambda: len(spark.read.parquet(reg.changes_path("CA", "va", "t")).inputFiles())
    before = count()
    for _ in range(2):
        rep.run_stream(info)
    assert count() == before


def test_continuous_stream_feeds_the_view(spark, reg):
    load(reg, "A", "t", frame(spark, (1, "a", "")), ["k"], ns="va")
    rep = Replication(reg, "A", "B", "t", ["k"])
    rep.start(every="200 milliseconds", interval_s=0.5)
    load(reg, "A", "t", frame(spark, (2, "b", "")), ["k"], ns="va")
    deadline = time.monotonic() + 60
    while time.monotonic() < deadline and rep.view().count() < 2:
        time.sleep(0.5)
    assert rows(reg.read("B", "vb-readonly", "t")) == [(1, "a", ""), (2, "b", "")]
    load(reg, "A", "t", frame(spark, (3, "c", "")), ["k"], ns="va")
    rep.cutover()
    assert not rep.query.isActive and reg.read("B", "vb", "t").count() == 3


def test_stalled_stream_times_the_gate_out(spark, reg, monkeypatch):
    load(reg, "A", "t", frame(spark, (1, "a", "")), ["k"], ns="va")
    rep = Replication(reg, "A", "B", "t", ["k"])
    monkeypatch.setattr(Replication, "run_stream", lambda self, info: None)  # applies nothing
    stamp = Registry.stamp

    def busy(self):  # a change comes in between the copy and the gate
        monkeypatch.setattr(Registry, "stamp", stamp)
        at = stamp(self)
        load(self, "A", "t", frame(spark, (2, "b", "")), ["k"], ns="va")
        return at

    monkeypatch.setattr(Registry, "stamp", busy)
    with pytest.raises(ReplicationTimeout):
        rep.start(max_tries=2, interval_s=0.1)
    assert reg.state()["data_state/CB/vb-readonly"] == "add"


def test_backlog_is_many_batches(spark, reg):
    load(reg, "A", "t", frame(spark, (0, "a", "")), ["k"], ns="va")
    rep = Replication(reg, "A", "B", "t", ["k"])
    info = rep.start()
    for i in range(1, 4):
        load(reg, "A", "t", frame(spark, (i, "a", "")), ["k"], ns="va")
    before = last_batch(spark, rep.applied_dir(info)) or 0
    assert rep.run_stream(info, files=1)
    assert last_batch(spark, rep.applied_dir(info)) - before >= 3
    assert rep.view().count() == 4


def test_restart_writes_the_difference_only(spark, reg):
    data = frame(spark, *[(i, "v", "") for i in range(20)])
    load(reg, "A", "t", data, ["k"], ns="va")
    load(reg, "B", "t", data, ["k"], ns="vb")
    load(reg, "B", "t", frame(spark, (50, "extra", "")), ["k"], ns="vb")  # pending on B
    load(reg, "A", "t", frame(spark, (50, "extra", ""), (3, "new", "")), ["k"], ns="va")
    remove(reg, "A", "t", frame(spark, (4, "", "")).select("k"), ["k"], ns="va")
    rep = Replication(reg, "A", "B", "t", ["k"])
    planned = {r["action"]: r["n_rows"] for r in rep.restart(dry_run=True).collect()}
    info = rep.restart()
    assert planned == {"update": 1, "delete": 1}
    written = spark.read.parquet(rep.applied_dir(info))
    assert written.filter("batch = -1").count() == 2
    with pytest.raises(AnalysisException):  # no base of its own
        spark.read.parquet(f"{rep.root}/base")
    assert rows(reg.read("B", "vb-readonly", "t")) == rows(reg.read("A", "va", "t"))
    load(reg, "A", "t", frame(spark, (7, "later", "")), ["k"], ns="va")
    rep.run_stream(info)
    rep.compact()
    assert rows(rep.view()) == rows(reg.read("A", "va", "t"))
    rep.cutover()
    assert rows(reg.read("B", "vb", "t")) == rows(reg.read("A", "va", "t"))


def test_watch_recounts_and_waits(spark, reg):
    out, ckpt = scratch_path(spark, "ticks"), scratch_path(spark, "ckpt")
    reg.set_state("default/CB", "vb")
    data, sizes = frame(spark, (1, "a", ""), (2, "b", "")), [None, 5, 6]
    many = lambda n: spark.createDataFrame([(100 + i, "", "") for i in range(n)], data.schema)
    for i, n in enumerate(sizes):
        load(reg, "B", "t", frame(spark, (2 * i, "a", ""), (2 * i + 1, "b", "")), ["k"], ns="vb")
        if n is not None:
            reg.mount("A", "va", "t", many(n))
        ticks = watch_counts(reg, "t", out, ckpt, available_now=True)
    assert [tuple(r) for r in ticks.orderBy("tick").collect()] == [
        (1, None, 2, "waiting"), (2, 5, 4, "mismatch"), (3, 6, 6, "match")]


def test_full_report_shows_the_replica(spark, reg):
    load(reg, "A", "t", frame(spark, (1, "a", "")), ["k"], ns="va")
    Replication(reg, "A", "B", "t", ["k"]).start()
    got = {tuple(r)[:3]: r["value"] for r in health_report(spark, reg, ["t"], detail="full").collect()}
    assert got["status", "CB", "t"].startswith("replicating ready applied_rows=0")
    assert got["count", "CB", "t"] == "1 vb-readonly" and got["verdict", "A->B", "t"] == "match"
    with pytest.raises(ValueError):
        health_report(spark, reg, ["t"], detail="all")


def test_restart_mends_repeated_keys(spark, reg):
    load(reg, "A", "t", frame(spark, (1, "a", ""), (2, "b", "")), ["k"], ns="va")
    reg.write_version("B", "vb", "t", frame(spark, (1, "a", ""), (1, "a", ""), (2, "b", ""), (3, "c", "")))
    rep = Replication(reg, "A", "B", "t", ["k"])
    rep.restart()
    assert rows(rep.view()) == [(1, "a", ""), (2, "b", "")]


def test_fallback_counts_all_tables_in_one_job(spark, reg, monkeypatch):
    import replicakit.operators.counts as module

    for n, t in enumerate(("p", "q", "r"), 1):
        load(reg, "A", t, frame(spark, *[(i, "", "") for i in range(n)]), ["k"], ns="va")
    asked, real = [], module._counts_at

    def seen(reg, side, ns, tables):
        asked.append((ns, list(tables)))
        return real(reg, side, ns, tables)

    monkeypatch.setattr(module, "_counts_at", seen)
    got = module.count_with_fallback(spark, reg, "A", ["p", "q", "r", "p"], "va", "vb")
    assert [tuple(r) for r in got.collect()] == [("p", "va", 1), ("q", "va", 2), ("r", "va", 3), ("p", "va", 1)]
    assert [a for a in asked if a[1]] == [("va", ["p", "q", "r"])]
    # One table that fails sends the others table by table, and only itself to the alternative.
    asked.clear()
    got = module.count_with_fallback(spark, reg, "A", ["p", "none", "r"], "va", "system")
    assert [tuple(r) for r in got.collect()] == [("p", "va", 1), ("none", None, None), ("r", "va", 3)]
    assert asked == [("va", ["p", "none", "r"]), ("va", ["p"]), ("va", ["none"]), ("va", ["r"]), ("system", ["none"])]
