"""Cutover (O30): the table is copied ahead, only what comes meanwhile is written at the end."""

import datetime

import pytest
from pyspark.sql import functions as F

from replicakit.constants import SIDE_A, SIDE_B
from replicakit.plans.replication import Replication, load, remove
from replicakit.plans.scenario import create_sides
from replicakit.session import scratch_path
from replicakit.sources.changes import with_meta
from replicakit.sources.registry import Registry, resolve_default

KEY = ["k"]


def frame(spark, *rows):
    return spark.createDataFrame([*rows], "k bigint, v string")


def rows(df):
    return sorted((r.k is None, r.k or 0, r.v) for r in df.collect())


@pytest.fixture
def reg(spark):
    r = Registry(spark, scratch_path(spark, "cutover"))
    create_sides(r)
    load(r, "A", "t", frame(spark, *[(i, "first") for i in range(40)]), KEY)
    return r


@pytest.fixture
def meanwhile(monkeypatch):
    """Run a function once, right after the first copy of a cutover; counts the copies."""
    todo, copies = [], []
    real = Registry.stage_version

    def stage(self, *args, **kwargs):
        out = real(self, *args, **kwargs)
        copies.append(args[0])
        if todo and args[0] == SIDE_B:
            todo.pop()()
        return out

    monkeypatch.setattr(Registry, "stage_version", stage)
    return todo, copies


def stored(spark, reg, v):
    return spark.read.parquet(f"{reg.table_dir(SIDE_B, 'vb', 't')}/v={v}")


def test_changes_during_the_copy_stay_pending(spark, reg, meanwhile):
    todo, copies = meanwhile
    rep = Replication(reg, "A", "B", "t", KEY)
    rep.start()
    load(reg, "A", "t", frame(spark, (1, "before"), (100, "before")), KEY)

    def writes():
        load(reg, "A", "t", frame(spark, (1, "meanwhile"), (2, "once"), (None, "null key")), KEY)
        load(reg, "A", "t", frame(spark, (2, "twice"), (101, "new")), KEY)
        remove(reg, "A", "t", frame(spark, (3, ""), (100, "")).select("k"), KEY)

    todo.append(writes)
    copies.clear()
    v = rep.cutover()
    want = rows(reg.read("A", "va", "t"))
    assert copies.count(SIDE_B) == 1 and not todo
    assert rows(reg.read("B", "vb", "t")) == want
    assert stored(spark, reg, v).count() == 41  # as it was before the writes
    assert reg.pending("B", "vb", "t") == 1 and resolve_default(reg, "B") == "vb"
    tail = spark.read.parquet(f"{reg.changes_path(SIDE_B, 'vb', 't')}/epoch={v - 1}")
    assert {r.k for r in tail.collect()} == {1, 2, 3, 100, 101, None} and tail.count() == 6
    other = Registry(spark, reg.root)
    assert rows(other.read("B", "vb", "t")) == want
    # The new source goes on: loads, compaction, and a restart of the old side.
    load(reg, "B", "t", frame(spark, (2, "on B"), (200, "on B")), KEY)
    both = rows(reg.read("B", "vb", "t"))
    back = Replication(reg, "B", "A", "t", KEY)
    back.restart()
    assert rows(reg.read("A", "va-readonly", "t")) == both
    reg.compact_table("B", "vb", "t")
    assert rows(reg.read("B", "vb", "t")) == both and reg.pending("B", "vb", "t") == 0
    load(reg, "B", "t", frame(spark, (4, "late on B")), KEY)
    back.cutover()
    assert rows(reg.read("A", "va", "t")) == rows(reg.read("B", "vb", "t"))


def test_nothing_meanwhile_leaves_nothing_pending(spark, reg, meanwhile):
    rep = Replication(reg, "A", "B", "t", KEY)
    rep.start()
    rep.compact()  # no batch yet
    v = rep.cutover()
    assert reg.pending("B", "vb", "t") == 0
    assert rows(stored(spark, reg, v)) == rows(reg.read("B", "vb", "t")) == rows(reg.read("A", "va", "t"))


def test_an_old_change_that_comes_late_loses(spark, reg, meanwhile):
    """A change older than what the copy holds is merged by its time."""
    todo, copies = meanwhile
    rep = Replication(reg, "A", "B", "t", KEY)
    rep.start()
    old = reg.stamp()
    load(reg, "A", "t", frame(spark, (1, "newer")), KEY)

    def late():
        with_meta(frame(spark, (1, "older"), (300, "older")), old, reg.next_version()).write.mode("append").parquet(
            reg.epoch_path(SIDE_A, "va", "t"))

    todo.append(late)
    copies.clear()
    rep.cutover()
    got = {r.k: r.v for r in reg.read("B", "vb", "t").collect()}
    assert copies.count(SIDE_B) == 2 and got[1] == "newer" and got[300] == "older" and len(got) == 41
    assert reg.pending("B", "vb", "t") == 0


def test_compacted_batches_are_not_applied_again(spark, reg, meanwhile):
    todo, _ = meanwhile
    rep = Replication(reg, "A", "B", "t", KEY)
    rep.start()
    load(reg, "A", "t", frame(spark, (1, "in the base")), KEY)
    rep.run_stream(rep.info())
    rep.compact()
    todo.append(lambda: remove(reg, "A", "t", frame(spark, (1, "")).select("k"), KEY))
    rep.cutover()
    assert reg.read("B", "vb", "t").filter("k = 1").isEmpty() and reg.read("B", "vb", "t").count() == 39


def test_a_point_in_time_leaves_later_changes_out(spark, reg, meanwhile):
    todo, copies = meanwhile
    rep = Replication(reg, "A", "B", "t", KEY)
    rep.start()
    load(reg, "A", "t", frame(spark, (1, "in time")), KEY)
    at = reg.stamp() + datetime.timedelta(microseconds=1)
    reg.stamp()
    todo.append(lambda: load(reg, "A", "t", frame(spark, (2, "too late")), KEY))
    rep.cutover(to=at)
    got = {r.k: r.v for r in reg.read("B", "vb", "t").collect()}
    assert got[1] == "in time" and got[2] == "first" and reg.pending("B", "vb", "t") == 0
    assert reg.read("B", "vb", "t").filter(F.col("v") == "too late").isEmpty()
