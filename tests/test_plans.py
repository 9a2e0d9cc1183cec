"""Physical plans: pushdown, pruning, broadcast, partial aggregation, no Python."""

import contextlib
import io

import __spark_entry__ as entry
from conftest import SF_SMALL
from replicakit import fixtures as fx
from replicakit.operators.fold import apply_changes
from replicakit.operators.inventory import is_in_mode
from replicakit.plans.replica import ChangeSpec, readonly_view, upto
from replicakit.session import scratch_path
from pyspark.sql import functions as F


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_view_pushes_frontier_to_scan(spark):
    spec = ChangeSpec(keys=("user_id",), order=("ts", "event_id"), op_col="op")
    log = fx.change_log(spark, SF_SMALL)
    # The view folds this into the scratch folder before it merges.
    assert "PushedFilters: [IsNotNull(ts), LessThanOrEqual(ts," in plan(upto(log, spec, "2024-01-22 00:00:00"))


def test_view_does_not_shuffle_base_when_changes_are_small(spark):
    spec = ChangeSpec(keys=("user_id",), order=("ts", "event_id"), op_col="op")
    base = spark.read.parquet(f"{SF_SMALL}/events.parquet").select(
        "user_id", "ts", "event_id", F.lit("upsert").alias("op"), "event_type", "value")
    base = apply_changes(base, ["user_id"], ["ts", "event_id"], keep_deletes=True)
    path = scratch_path(spark, "base")
    base.write.parquet(path)
    view = readonly_view(spark.read.parquet(path), fx.change_log(spark, SF_SMALL), spec)
    p = plan(view)
    assert "BroadcastHashJoin" in p and "Exchange hashpartitioning" not in p


def test_count_reads_no_columns(spark):
    p = plan(entry.queries()["row_count"](spark, SF_SMALL))
    assert "ReadSchema: struct<>" in p


def test_inventory_membership_broadcasts(spark):
    df = is_in_mode(fx.requested_names(spark, SF_SMALL), fx.inventory_rows(spark, SF_SMALL),
                    "shared")
    assert "BroadcastHashJoin" in plan(df)


def test_fold_aggregates_partially(spark):
    p = plan(apply_changes(fx.change_log(spark, SF_SMALL), fx.CHANGE_KEYS, fx.CHANGE_ORDER))
    assert p.count("Aggregate") >= 2 and "partial_max_by" in p


def test_no_python_in_any_query(spark):
    for name in ("apply_changes", "resync_diff", "resync_diff_pruned", "upsert", "first_token",
                 "is_true", "ready_gate", "check_not_null", "readonly_view"):
        p = plan(entry.queries()[name](spark, SF_SMALL))
        assert "Python" not in p and "ArrowEval" not in p, name


def test_pending_read_lists_only_the_current_epoch(spark):
    from replicakit.plans.replication import load
    from replicakit.sources.registry import Registry

    reg = Registry(spark, scratch_path(spark, "epochs"))
    orders = fx.orders_a(spark, SF_SMALL)
    load(reg, "A", "orders", orders.filter("o_orderstatus = 'F'"), ["o_orderkey"])
    load(reg, "A", "orders", orders.filter("o_orderstatus = 'O'"), ["o_orderkey"])
    reg.compact_table("A", "va", "orders")  # version 2
    load(reg, "A", "orders", orders.filter("o_orderstatus = 'P'"), ["o_orderkey"])
    pending = reg.pending_changes("CA", "va", "orders", orders.schema)
    p = plan(pending)
    # Those of the epoch before may have come while version 2 was written.
    assert "epoch=2" in p and "epoch=0" not in p
    assert pending.count() == orders.filter("o_orderstatus = 'P'").count()
