"""The clock-driven watch and the status that another driver sees."""

import threading
import time

import pytest

from replicakit.plans.replication import Replication, load, remove, replica_info
from replicakit.plans.scenario import create_sides
from replicakit.session import scratch_path
from replicakit.sources.registry import Registry
from replicakit.streaming.heartbeat import Heartbeat, recorded_word
from replicakit.streaming.watch import watch_counts


@pytest.fixture
def reg(spark):
    r = Registry(spark, scratch_path(spark, "watch"))
    create_sides(r)
    r.set_state("default/CB", "vb")
    return r


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "k bigint, v string")


def ticks_of(df):
    return [tuple(r) for r in df.orderBy("tick").collect()]


def test_update_and_delete_reach_match(spark, reg):
    out, ckpt = scratch_path(spark, "ticks"), scratch_path(spark, "ckpt")
    load(reg, "A", "t", frame(spark, (1, "a")), ["k"], ns="va")
    load(reg, "B", "t", frame(spark, (1, "old"), (2, "gone")), ["k"], ns="vb")
    assert ticks_of(watch_counts(reg, "t", out, ckpt, available_now=True)) == [(1, 1, 2, "mismatch")]
    load(reg, "B", "t", frame(spark, (1, "a")), ["k"], ns="vb")  # an update adds no row
    assert ticks_of(watch_counts(reg, "t", out, ckpt, available_now=True))[-1] == (2, 1, 2, "mismatch")
    remove(reg, "B", "t", frame(spark, (2, "")).select("k"), ["k"], ns="vb")
    assert ticks_of(watch_counts(reg, "t", out, ckpt, available_now=True))[-1] == (3, 1, 1, "match")
    # The watch is over: nothing is counted any more.
    load(reg, "B", "t", frame(spark, (9, "z")), ["k"], ns="vb")
    assert len(ticks_of(watch_counts(reg, "t", out, ckpt, available_now=True))) == 3


def test_ticks_come_without_arrivals(spark, reg):
    load(reg, "A", "t", frame(spark, (1, "a")), ["k"], ns="va")
    load(reg, "B", "t", frame(spark, (1, "a"), (2, "b")), ["k"], ns="vb")
    got = watch_counts(reg, "t", scratch_path(spark, "ticks"), scratch_path(spark, "ckpt"),
                       max_ticks=3, every="300 milliseconds")
    assert ticks_of(got) == [(i, 1, 2, "mismatch") for i in (1, 2, 3)]


def test_watch_ends_when_another_driver_makes_them_equal(spark, reg):
    load(reg, "A", "t", frame(spark, (1, "a")), ["k"], ns="va")
    load(reg, "B", "t", frame(spark, (1, "a"), (2, "b")), ["k"], ns="vb")

    def later():
        time.sleep(1.5)
        remove(Registry(spark, reg.root), "B", "t", frame(spark, (2, "")).select("k"), ["k"], ns="vb")

    other = threading.Thread(target=later)
    other.start()
    got = ticks_of(watch_counts(reg, "t", scratch_path(spark, "ticks"), scratch_path(spark, "ckpt"),
                                max_ticks=200, every="500 milliseconds"))
    other.join()
    assert got[-1][1:] == (1, 1, "match") and got[0][3] == "mismatch" and len(got) < 200


def test_watch_waits_for_a_missing_side(spark, reg):
    load(reg, "A", "t", frame(spark, (1, "a")), ["k"], ns="va")
    got = watch_counts(reg, "t", scratch_path(spark, "ticks"), scratch_path(spark, "ckpt"), available_now=True)
    assert ticks_of(got) == [(1, 1, None, "waiting")]


def status_of(spark, reg):
    """What another driver sees."""
    other = Registry(spark, reg.root)
    return Replication(other, "A", "B", "t", ["k"]).status(replica_info(other, "CB", "vb", "t")).first()["status"]


def wait_for(word, ask, seconds=30):
    deadline = time.monotonic() + seconds
    while time.monotonic() < deadline and ask() != word:
        time.sleep(0.3)
    return ask()


def test_another_driver_sees_the_feeder(spark, reg, monkeypatch):
    import replicakit.streaming.heartbeat as module

    reg.set_state("default/CB", "vb-readonly")
    load(reg, "A", "t", frame(spark, (1, "a")), ["k"], ns="va")
    rep = Replication(reg, "A", "B", "t", ["k"])
    rep.start(every="200 milliseconds", interval_s=0.5)
    assert wait_for("replicating", lambda: status_of(spark, reg)) == "replicating"
    # A feeder that died without a word is not alive for long.
    real = time.time
    monkeypatch.setattr(module.time, "time", lambda: real() + module.STALE_S + module.EVERY_S + 5)
    assert recorded_word(Registry(spark, reg.root), rep.stream_key) == "stopped"
    monkeypatch.undo()
    rep.stop()
    assert status_of(spark, reg) == "stopped"
    rep.run_stream(rep.info())  # a drain feeds it for a while
    assert status_of(spark, reg) == "replicating"
    rep.cutover()
    assert recorded_word(Registry(spark, reg.root), rep.stream_key) == "stopped"


def test_a_failing_stream_is_recorded(spark, reg):
    path = scratch_path(spark, "arrivals")
    frame(spark, (1, "a")).write.parquet(path)
    beat = Heartbeat(reg, "stream/CB/vb/t", "failing")

    def fail(_batch, _id):
        raise ValueError("no")

    query = (spark.readStream.schema("k bigint, v string").parquet(path).writeStream.foreachBatch(fail)
             .queryName("failing").option("checkpointLocation", scratch_path(spark, "ckpt")).start())
    with pytest.raises(Exception):  # noqa: B017 - Spark wraps it
        query.awaitTermination(60)
    beat.close(query, "stopped")
    assert recorded_word(reg, "stream/CB/vb/t") == "error"
    assert recorded_word(reg, "stream/CB/vb/none") == "stopped"
