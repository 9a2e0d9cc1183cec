"""Faults found in round 2, each with the case that shows it."""

import contextlib
import io
import time

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from replicakit.operators.diff import resync_diff
from replicakit.operators.keyed import KeyedTable, changed_nodes, keyed_diff, rows_in, rows_of, store_keyed
from replicakit.operators.upsert import upsert
from replicakit.plans.replica import last_batch
from replicakit.plans.replication import Replication, archive_changes, load, remove
from replicakit.plans.scenario import create_sides
from replicakit.session import scratch_path, scratch_scope, shared_dir, staged
from replicakit.sources.registry import Registry, run_sql
from replicakit.sources.tables import read_table


@pytest.fixture
def reg(spark):
    r = Registry(spark, scratch_path(spark, "round3"))
    create_sides(r)
    return r


@contextlib.contextmanager
def conf(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in names:
            spark.conf.unset(k)


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, *data):
    return spark.createDataFrame(list(data), "k bigint, v string, w string")


def scratch_folders(spark):
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return {s.getPath().getName() for s in fs.listStatus(path)}


# ------------------------------------------------------------ upsert, loads
def test_upsert_evaluates_rows_once(spark):
    path = scratch_path(spark, "rows")
    frame(spark, (1, "new", ""), (5, "new", "")).write.parquet(path)
    base = frame(spark, *[(i, "old", "") for i in range(4)])
    out = upsert(base, spark.read.parquet(path).filter("k > 0"), ["k"])
    assert path not in plan(out) and "FullOuter" not in plan(out)
    assert rows(out) == [(0, "old", ""), (1, "new", ""), (2, "old", ""), (3, "old", ""), (5, "new", "")]


def test_upsert_splits_a_hot_key(spark):
    """Above the broadcast threshold a key with most of the base's rows is split."""
    base = spark.range(60_000).select(F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id")).alias("k"),
                                      F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit("").alias("w"))
    with conf(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
              spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="100k",
              spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
              spark__sql__adaptive__advisoryPartitionSizeInBytes="100k",
              spark__sql__adaptive__coalescePartitions__enabled="false"):
        out = upsert(base.repartition(8), frame(spark, (7, "new", "x"), (-1, "in", "")), ["k"])
        assert sum(r.v == "new" and r.w == "x" for r in out.collect()) == 40_000
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()


def test_loads_leave_no_scratch(spark, reg):
    load(reg, "A", "t", frame(spark, (1, "a", "")), ["k"], ns="va")
    before = scratch_folders(spark)
    load(reg, "A", "t", frame(spark, (1, "b", ""), (2, "c", "")), ["k"], ns="va")
    remove(reg, "A", "t", frame(spark, (2, "", "")).select("k"), ["k"], ns="va")
    assert scratch_folders(spark) == before
    assert rows(reg.read("A", "va", "t")) == [(1, "b", "")]


def test_scratch_scope_keeps_what_an_outer_one_reads(spark):
    with scratch_scope(spark):
        with scratch_scope(spark):
            kept = staged(spark.range(3), "inner")
        assert kept.count() == 3
        assert any(f.startswith("inner-") for f in scratch_folders(spark))
    assert not any(f.startswith("inner-") for f in scratch_folders(spark))


# ------------------------------------------------------------ differences
def files_read(df):
    """Files that the scan of a plan without exchanges opened."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


def test_exact_diff_sorts_each_side_once(spark):
    a, b = (frame(spark, *[(i, v, "") for i in range(50)]) for v in "ab")
    with conf(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        p = plan(resync_diff(a, b, ["k"]))
    tree = p[:p.index("\n\n\n")] if "\n\n\n" in p else p
    assert tree.count("- Sort (") == 2 and "Aggregate" not in tree and "SortMergeJoin" in tree


def test_exact_diff_with_repeats_on_both_sides(spark):
    a = frame(spark, (1, "a", ""), (2, "b", ""), (2, "b", ""), (3, "c", ""), (None, "n", ""), (6, "s", ""))
    b = frame(spark, (1, "x", ""), (2, "b", ""), (3, "c", ""), (3, "c", ""), (4, "d", ""), (4, "e", ""), (None, "m", ""), (6, "s", ""))
    got = sorted(((r.k, r.action, r.v) for r in resync_diff(a, b, ["k"]).collect()), key=str)
    assert got == sorted([(1, "update", "a"), (3, "update", "c"), (4, "delete", None), (None, "update", "n")], key=str)


def test_a_hot_repeated_key_makes_no_pairs(spark):
    n = 3000
    a = spark.range(n).select(F.lit(7).cast("bigint").alias("k"), F.lit("v").alias("v"))
    d = resync_diff(a, a, ["k"])
    assert [(r.k, r.action) for r in d.collect()] == [(7, "update")]


@pytest.mark.parametrize("depths", [(0, 0), (3, 3), (5, 2), (9, 10), (10, 3)])
def test_keyed_diff_equals_exact(spark, depths):
    base = spark.range(2000).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"),
                                    F.when(F.col("id") % 5 > 0, F.lit("w")).alias("w"))
    other = base.filter("k % 97 <> 3").withColumn("v", F.when(F.col("k") == 11, None).otherwise(F.col("v"))).unionByName(
        frame(spark, (-4, "extra", None), (None, "null key", "")))
    path = scratch_path(spark, "keyed")
    a, b = (KeyedTable(f"{path}/{n}", f"{path}/{n}-digests", d) for n, d in zip("ab", depths, strict=True))
    store_keyed(base, ["k"], a)
    store_keyed(other, ["k"], b)
    assert rows(keyed_diff(spark, a, b, ["k"])) == rows(resync_diff(base, other, ["k"]))
    assert rows(rows_of(spark, b.path)) == rows(other)
    assert changed_nodes(spark, a, a) == [] and keyed_diff(spark, a, a, ["k"]).isEmpty()


def test_only_changed_buckets_are_read(spark):
    base = spark.range(4000).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    path = scratch_path(spark, "keyed")
    a, b = (KeyedTable(f"{path}/{n}", f"{path}/{n}-digests", 6) for n in "ab")
    store_keyed(base, ["k"], a)
    store_keyed(base.withColumn("v", F.when(F.col("k") == 5, "x").otherwise(F.col("v"))), ["k"], b)
    nodes = changed_nodes(spark, a, b)
    assert len(nodes) == 1
    with conf(spark, spark__sql__adaptive__enabled="false"):
        assert files_read(rows_of(spark, a.path)) == 64
        assert files_read(rows_in(spark, a, 6, nodes)) == 1
    assert "PartitionFilters" in plan(rows_in(spark, a, 6, nodes))
    assert [tuple(r) for r in keyed_diff(spark, a, b, ["k"]).collect()] == [(5, "update", "v")]


def test_restart_reads_changed_buckets_only(spark, reg, monkeypatch):
    import replicakit.plans.replication as module

    reg.bucket_rows = 20
    data = frame(spark, *[(i, "v", "") for i in range(300)])
    load(reg, "A", "t", data, ["k"], ns="va")
    load(reg, "B", "t", data.filter("k <> 40"), ["k"], ns="vb")
    load(reg, "B", "t", frame(spark, (50, "extra", ""), (900, "own", "")), ["k"], ns="vb")  # pending on B
    remove(reg, "A", "t", frame(spark, (4, "", "")).select("k"), ["k"], ns="va")  # pending on A
    assert reg.keyed("A", "va", "t").depth == reg.keyed("B", "vb", "t").depth == 4
    asked = []
    real = Registry.read_nodes
    monkeypatch.setattr(Registry, "read_nodes", lambda self, s, n, t, d, nodes: asked.append(nodes) or real(self, s, n, t, d, nodes))
    rep = module.Replication(reg, "A", "B", "t", ["k"])
    planned = {r["action"]: r["n_rows"] for r in rep.restart(dry_run=True).collect()}
    assert planned == {"insert": 1, "update": 1, "delete": 2}
    assert len(asked) == 2 and 1 <= len(asked[0]) <= 4
    rep.restart()
    assert rows(reg.read("B", "vb-readonly", "t")) == rows(reg.read("A", "va", "t"))
    load(reg, "A", "t", frame(spark, (7, "later", "")), ["k"], ns="va")
    rep.cutover()
    assert rows(reg.read("B", "vb", "t")) == rows(reg.read("A", "va", "t"))
    assert reg.keyed("B", "vb", "t").depth == 4  # the cutover stores by key bucket again
    reg.compact_table("A", "va", "t")
    assert changed_nodes(spark, reg.keyed("A", "va", "t"), reg.keyed("B", "vb", "t")) == []


# ------------------------------------------------------------ run_sql
def test_run_sql_leaves_the_callers_views_alone(spark, reg):
    load(reg, "A", "orders", frame(spark, (1, "side", "")), ["k"], ns="va")
    frame(spark, (9, "caller", "")).createOrReplaceTempView("orders")
    frame(spark, (9, "caller", "")).createOrReplaceTempView("elsewhere")
    before = {t.name for t in spark.catalog.listTables()}
    try:
        assert run_sql(spark, reg, "SELECT v FROM ORDERS o WHERE o.k IN (SELECT orders.k FROM orders);").first()[0] == "side"
        assert spark.table("orders").first()["v"] == "caller"
        assert {t.name for t in spark.catalog.listTables()} == before
        for sql in ("SELECT * FROM elsewhere", "SELECT (SELECT max(k) FROM elsewhere)", "SELECT * FROM orders, global_temp.x",
                    "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM identifier('elsewhere')", "TABLE elsewhere",
                    "WITH c AS (SELECT * FROM elsewhere) SELECT * FROM c", "SELECT 1) x, (SELECT * FROM elsewhere",
                    "DROP VIEW elsewhere", "INSERT INTO orders SELECT * FROM orders", "SHOW TABLES",
                    "CREATE TEMP VIEW y AS SELECT * FROM orders"):
            with pytest.raises(AnalysisException):
                run_sql(spark, reg, sql)
        # Defined in one place, used in another.
        with pytest.raises(Exception):  # noqa: B017
            run_sql(spark, reg, "SELECT a.* FROM (WITH elsewhere AS (SELECT 1 AS x) SELECT * FROM elsewhere) b, elsewhere a").collect()
        assert spark.table("elsewhere").count() == 1
    finally:
        for v in ("orders", "elsewhere"):
            spark.catalog.dropTempView(v)


def test_run_sql_forms(spark, reg):
    load(reg, "A", "t", frame(spark, (1, "a", ""), (2, "b", ""), (3, None, "")), ["k"], ns="va")
    load(reg, "A", "d.u", frame(spark, (2, "x", "")), ["k"], ns="va")
    ask = lambda sql: [tuple(r) for r in run_sql(spark, reg, sql).collect()]
    assert ask("WITH t2 AS (SELECT k FROM t), t AS (SELECT k + 1 AS k FROM t2) SELECT max(k) FROM t -- the inner one") == [(4,)]
    assert ask("SELECT k FROM t ORDER BY k DESC LIMIT 2") == [(3,), (2,)]
    assert [r[0] for r in ask("SELECT k FROM t ORDER BY k DESC")] == [3, 2, 1]
    assert ask("SELECT t.k, x.v FROM t JOIN d.u x ON t.k = x.k") == [(2, "x")]
    assert ask("SELECT `d.u`.v, 'd.u' FROM `d.u`") == [("x", "d.u")] and ask("SELECT v FROM u") == [("x",)]
    assert ask("SELECT 1 AS one, id FROM range(1)") == [(1, 0)] and ask("VALUES (1)") == [(1,)]


# ------------------------------------------------------------ streams, counts
def test_a_batch_is_bounded_by_bytes(spark, reg, monkeypatch):
    import replicakit.plans.replication as module

    load(reg, "A", "t", frame(spark, (0, "a", "")), ["k"], ns="va")
    rep = Replication(reg, "A", "B", "t", ["k"])
    info = rep.start()
    for i in range(1, 4):
        load(reg, "A", "t", frame(spark, (i, "a", "")), ["k"], ns="va")
    monkeypatch.setattr(module, "BYTES_PER_BATCH", 1)
    before = last_batch(spark, rep.applied_dir(info)) or 0
    assert rep.run_stream(info)
    assert last_batch(spark, rep.applied_dir(info)) - before >= 3
    assert rep.view().count() == 4


def test_changes_consumed_by_every_replica_are_archived(spark, reg):
    load(reg, "A", "t", frame(spark, (0, "a", "")), ["k"], ns="va")
    rep = Replication(reg, "A", "B", "t", ["k"])
    info = rep.start()
    for i in range(1, 5):
        load(reg, "A", "t", frame(spark, (i, "a", "")), ["k"], ns="va")
        reg.compact_table("A", "va", "t")  # a new epoch each
    epochs = lambda: {r[0] for r in spark.read.parquet(reg.changes_path("CA", "va", "t")).select("epoch").distinct().collect()}
    before = epochs()
    assert all(e < 1 for e in archive_changes(reg, "A", "t", "va"))  # the replica has not read them yet
    rep.run_stream(info)
    moved = archive_changes(reg, "A", "t", "va")
    version = reg.current_version("A", "va", "t")
    assert moved and max(moved) == version - 2 and epochs() == {e for e in before if e >= version - 1}
    assert archive_changes(reg, "A", "t", "va") == []
    load(reg, "A", "t", frame(spark, (9, "later", "")), ["k"], ns="va")
    rep.run_stream(info)  # the stream goes on without the moved files
    assert rows(rep.view()) == rows(reg.read("A", "va", "t")) and rep.status(info).first()["data_state"] == "ready"


def test_guard_counts_all_tables_in_one_job(spark, reg, monkeypatch):
    import replicakit.operators.counts as module

    for n, t in enumerate(("p", "q"), 1):
        load(reg, "B", t, frame(spark, *[(i, "", "") for i in range(n)]), ["k"], ns="vb")
    load(reg, "B", "q", frame(spark, (1, "", ""), (2, "", ""), (3, "", "")), ["k"], ns="vb-readonly")
    reg.set_mode("B", "vb", "shared")
    asked, real = [], module._served
    monkeypatch.setattr(module, "_served", lambda reg, side, ns, tables: asked.append((ns, list(tables))) or real(reg, side, ns, tables))
    got = module.count_with_guard(spark, reg, "B", ["p", "q"], "vb-readonly", "vb")
    assert [tuple(r) for r in got.collect()] == [("p", "vb", 1), ("q", "vb-readonly", 3)]
    assert asked == [("vb-readonly", ["p", "q"]), ("vb", ["p"])]
    reg.set_mode("B", "vb", "none")
    with pytest.raises(module.GuardRefused):
        module.count_with_guard(spark, reg, "B", ["p"], "vb-readonly", "vb")


# ------------------------------------------------------------ sources
def test_a_rewritten_table_is_read_anew(spark):
    path = scratch_path(spark, "mounted")
    frame(spark, (1, "a", "")).select("k", "v").write.parquet(path)
    assert read_table(spark, path).columns == ["k", "v"] == read_table(spark, path).columns
    time.sleep(1.1)  # file systems that count whole seconds
    frame(spark, (1, "a", "b")).write.mode("overwrite").parquet(path)
    assert read_table(spark, path).columns == ["k", "v", "w"]
    with pytest.raises(AnalysisException):
        read_table(spark, path + "-none")
