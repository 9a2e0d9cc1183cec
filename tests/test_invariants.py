"""Invariants that must hold whatever the data."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from replicakit import fixtures as fx
from replicakit.operators.diff import apply_diff, resync_diff
from replicakit.operators.fold import apply_changes
from replicakit.operators.upsert import upsert
from replicakit.plans.replica import read_batches
from replicakit.session import scratch_path
from replicakit.streaming.replicate import batch_path, drain, replicate_stream

KEYS = ["o_orderkey"]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_apply_then_diff_is_empty(spark):
    src, rep = fx.orders_a(spark, SF_SMALL), fx.orders_b(spark, SF_SMALL)
    fixed = apply_diff(rep, resync_diff(src, rep, KEYS), KEYS)
    assert resync_diff(src, fixed, KEYS).count() == 0
    assert rows(fixed) == rows(src.select(*fixed.columns))


def test_pruned_diff_equals_exact_diff(spark):
    src, rep = fx.orders_a(spark, SF_SMALL), fx.orders_b(spark, SF_SMALL)
    exact = resync_diff(src, rep, KEYS)
    for buckets in (1, 7, 4096):
        assert rows(resync_diff(src, rep, KEYS, exact=False, buckets=buckets)) == rows(exact)


def test_pruned_diff_skips_equal_sides(spark):
    src = fx.orders_a(spark, SF_SMALL)
    assert resync_diff(src, src, KEYS, exact=False, buckets=64).count() == 0


def test_fold_is_order_independent(spark):
    log = fx.change_log(spark, SF_SMALL)
    shuffled = log.orderBy(F.rand(7)).repartition(5)
    a = apply_changes(log, fx.CHANGE_KEYS, fx.CHANGE_ORDER)
    b = apply_changes(shuffled, fx.CHANGE_KEYS, fx.CHANGE_ORDER)
    assert rows(a) == rows(b)


def test_upsert_twice_is_once(spark):
    base, seed = fx.orders_a(spark, SF_SMALL), fx.seed_rows(spark, SF_SMALL)
    once = upsert(base, seed, KEYS, {"o_orderpriority": "3-MEDIUM"})
    twice = upsert(once, seed, KEYS, {"o_orderpriority": "3-MEDIUM"})
    assert rows(once) == rows(twice)


def test_upsert_large_path_equals_broadcast_path(spark):
    base, seed = fx.orders_a(spark, SF_SMALL), fx.seed_rows(spark, SF_SMALL)
    small = upsert(base, seed, KEYS, {"o_orderpriority": "3-MEDIUM"})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = upsert(base, seed, KEYS, {"o_orderpriority": "3-MEDIUM"})
        assert rows(small) == rows(large.select(*small.columns))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def staged_stream(spark, out, ckpt, **kw):
    stage = scratch_path(spark, "stage")
    schema = fx.change_log(spark, SF_SMALL).schema
    for part in fx.change_parts(spark, SF_SMALL):
        fx.stage(part, stage)
        drain(replicate_stream(spark, stage, schema, out, ckpt, **kw))
    return stage, schema


def test_stream_drained_equals_batch(spark):
    out, ckpt = scratch_path(spark, "out"), scratch_path(spark, "ckpt")
    stage, schema = staged_stream(spark, out, ckpt)
    applied = read_batches(spark, out, schema)
    assert applied.count() == fx.change_log(spark, SF_SMALL).count()
    got = apply_changes(applied, fx.CHANGE_KEYS, fx.CHANGE_ORDER)
    want = apply_changes(fx.change_log(spark, SF_SMALL), fx.CHANGE_KEYS, fx.CHANGE_ORDER)
    assert rows(got) == rows(want.select(*got.columns))


def test_replayed_batch_changes_nothing(spark):
    out, ckpt = scratch_path(spark, "out"), scratch_path(spark, "ckpt")
    stage, schema = staged_stream(spark, out, ckpt)
    before = rows(read_batches(spark, out, schema))
    # Replay: batch 2 written again under the same id (as after a lost executor).
    tmp = scratch_path(spark, "replay")
    spark.read.parquet(batch_path(out, 2)).write.parquet(tmp)
    spark.read.parquet(tmp).write.mode("overwrite").parquet(batch_path(out, 2))
    # A restart from the same checkpoint finds nothing new.
    drain(replicate_stream(spark, stage, schema, out, ckpt))
    after = rows(read_batches(spark, out, schema))
    assert before == after


def test_merge_broadcast_path_equals_full_fold(spark):
    from replicakit.plans.replica import ChangeSpec, merge_changes

    spec = ChangeSpec(keys=tuple(fx.CHANGE_KEYS), order=tuple(fx.CHANGE_ORDER), op_col="op")
    base, log = fx.base_0(spark, SF_SMALL), fx.change_log(spark, SF_SMALL)
    for keep in (False, True):
        fast = merge_changes(base, log, spec, keep_deletes=keep)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        full = merge_changes(base, log, spec, keep_deletes=keep)
        full_rows = rows(full)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        plain = apply_changes(base.unionByName(log), fx.CHANGE_KEYS, fx.CHANGE_ORDER,
                              keep_deletes=keep)
        assert rows(fast) == full_rows == rows(plain)


def test_compaction_keeps_the_view(spark):
    from replicakit.plans.replication import Replication, load
    from replicakit.plans.scenario import create_sides
    from replicakit.sources.registry import Registry

    reg = Registry(spark, scratch_path(spark, "reg"))
    create_sides(reg)
    orders = fx.orders_a(spark, SF_SMALL)
    early = orders.filter(F.col("o_orderdate") < fx.ts_ntz("1998-01-01 00:00:00"))
    load(reg, "A", "orders", early, KEYS)
    rep = Replication(reg, "A", "B", "orders", KEYS)
    rep.start()
    load(reg, "A", "orders", orders.filter(F.col("o_orderdate") >= fx.ts_ntz("1998-01-01 00:00:00")),
         KEYS)
    load(reg, "A", "orders", early.select("o_orderkey", F.lit("Z").alias("o_orderstatus")), KEYS)
    rep.run_stream(rep.info())
    before = rows(rep.view())
    info = rep.compact()
    assert info.through_batch >= 0
    assert rep.applied(info).count() == 0
    assert rows(rep.view()) == before == rows(reg.read("A", "va", "orders").select(
        *rep.view().columns))


def test_deletes_replicate_through_the_stream(spark):
    from replicakit.plans.replication import Replication, load, remove
    from replicakit.plans.scenario import create_sides
    from replicakit.sources.registry import Registry

    reg = Registry(spark, scratch_path(spark, "reg"))
    create_sides(reg)
    orders = fx.orders_a(spark, SF_SMALL)
    load(reg, "A", "orders", orders, KEYS)
    rep = Replication(reg, "A", "B", "orders", KEYS)
    rep.start()
    gone = orders.filter(F.col("o_orderstatus") == "P").select("o_orderkey")
    remove(reg, "A", "orders", gone, KEYS)
    # Deleted, then one of them inserted again later.
    back = orders.join(gone.limit(1), "o_orderkey", "left_semi")
    load(reg, "A", "orders", back, KEYS)
    rep.run_stream(rep.info())
    want = rows(reg.read("A", "va", "orders"))
    assert rows(rep.view().select(*orders.columns)) == want
    rep.cutover()
    assert rows(reg.read("B", "vb", "orders").select(*orders.columns)) == want


def test_stream_status_from_progress(spark):
    from replicakit.plans.status import stream_status

    stage, out, ckpt = (scratch_path(spark, "stage"), scratch_path(spark, "out"),
                        scratch_path(spark, "ckpt"))
    schema = fx.change_log(spark, SF_SMALL).schema
    fx.stage(fx.change_parts(spark, SF_SMALL)[0], stage)
    q = replicate_stream(spark, stage, schema, out, ckpt, trigger={"processingTime": "200 milliseconds"})
    try:
        q.processAllAvailable()
        row = stream_status(spark, q, "vb", "CA->CB").first()
        assert row["status"] == "replicating" and row["batch_id"] >= 0
    finally:
        q.stop()
    assert stream_status(spark, q, "vb", "CA->CB").first()["status"] == "stopped"


def test_replication_status_tracks_frontier_and_lag(spark):
    from replicakit.plans.replication import Replication, load
    from replicakit.plans.scenario import create_sides
    from replicakit.sources.registry import Registry

    reg = Registry(spark, scratch_path(spark, "reg"))
    create_sides(reg)
    orders = fx.orders_a(spark, SF_SMALL)
    load(reg, "A", "orders", orders.filter("o_orderstatus = 'F'"), KEYS)
    rep = Replication(reg, "A", "B", "orders", KEYS)
    info = rep.start()
    st = rep.status(info).first()
    assert (st["status"], st["applied_rows"]) == ("replicating", 0)
    assert st["frontier_ts"].strftime("%Y-%m-%d %H:%M:%S.%f") == info.as_of
    late = orders.filter("o_orderstatus <> 'F'")
    load(reg, "A", "orders", late, KEYS)
    st = rep.status(info).first()
    assert st["lag_s"] > 0  # the source moved, the replica not yet
    rep.run_stream(info)
    st = rep.status(info).first()
    assert st["applied_rows"] == late.count() and st["lag_s"] == 0


def test_loads_merge_on_read_and_compact(spark):
    from replicakit.plans.replication import load, remove
    from replicakit.sources.registry import Registry

    reg = Registry(spark, scratch_path(spark, "reg"))
    orders = fx.orders_a(spark, SF_SMALL)
    f = orders.filter("o_orderstatus = 'F'")
    o = orders.filter("o_orderstatus = 'O'")
    p = orders.filter("o_orderstatus = 'P'")
    assert load(reg, "A", "orders", f, KEYS, compact_every=3) == 1  # first version
    assert load(reg, "A", "orders", o, KEYS, compact_every=3) == 1  # appended, not rewritten
    assert reg.pending("A", "va", "orders") == 1
    status = o.select("o_orderkey", F.lit("Z").alias("o_orderstatus"))
    load(reg, "A", "orders", status, KEYS, compact_every=3)  # partial columns
    want = rows(f.unionByName(o.withColumn("o_orderstatus", F.lit("Z"))))
    assert rows(reg.read("A", "va", "orders")) == want
    assert reg.pending("A", "va", "orders") == 2 and reg.current_version("A", "va", "orders") == 1
    remove(reg, "A", "orders", f.select("o_orderkey"), KEYS, compact_every=3)  # third: compacts
    assert reg.current_version("A", "va", "orders") == 2 and reg.pending("A", "va", "orders") == 0
    assert rows(reg.read("A", "va", "orders")) == rows(o.withColumn("o_orderstatus", F.lit("Z")))
    load(reg, "A", "orders", p, KEYS, compact_every=3)
    assert reg.read("A", "va", "orders").count() == o.count() + p.count()
    # The change log holds every change, for replicas.
    assert spark.read.parquet(reg.changes_path("CA", "va", "orders")).count() == (
        f.count() + o.count() + o.count() + f.count() + p.count())


def test_counts_at_one_point_in_time(spark):
    import datetime

    from replicakit.operators.counts import compare_counts, row_counts
    from replicakit.plans.replication import Replication, load
    from replicakit.plans.scenario import create_sides
    from replicakit.sources.registry import Registry

    reg = Registry(spark, scratch_path(spark, "asof"))
    create_sides(reg)
    orders = fx.orders_a(spark, SF_SMALL)
    f = orders.filter("o_orderstatus = 'F'")
    load(reg, "A", "orders", f, KEYS)
    load(reg, "A", "orders", orders.filter("o_orderstatus = 'O'"), KEYS)
    rep = Replication(reg, "A", "B", "orders", KEYS)
    rep.start()
    t = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    load(reg, "A", "orders", orders.filter("o_orderstatus = 'P'"), KEYS)  # after t, on A only
    now = compare_counts(row_counts(spark, reg, "A", ["orders"]),
                         row_counts(spark, reg, "B", ["orders"])).first()
    at_t = compare_counts(row_counts(spark, reg, "A", ["orders"], as_of=t),
                          row_counts(spark, reg, "B", ["orders"], as_of=t)).first()
    assert now["verdict"] == "mismatch" and at_t["verdict"] == "match"
    assert at_t["n_a"] == orders.filter("o_orderstatus <> 'P'").count()
    with pytest.raises(ValueError):
        reg.read("A", "va", "orders", as_of=datetime.datetime(2000, 1, 1))
