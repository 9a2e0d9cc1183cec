"""Counts and schemas of tables with pending changes do not merge whole rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from replicakit.operators import counts
from replicakit.plans import replica
from replicakit.plans.replication import Replication, load, remove
from replicakit.sources.registry import Registry, table_inventory

ROW = "k bigint, j string, v string, _ts timestamp_ntz, _seq bigint, _op string"


@pytest.mark.parametrize("seed", range(4))
def test_count_is_that_of_the_merge(spark, seed):
    """Repeated and null keys, tombstones on both sides, late changes, equal times."""
    rnd = random.Random(seed)

    def rows(n):
        made = [(rnd.choice([None, *range(12)]), rnd.choice([None, "a"]), rnd.choice("xyz"), rnd.randint(0, 5), rnd.randint(0, 2),
                 rnd.choice(["upsert", "upsert", "delete", None])) for _ in range(n)]
        df = spark.createDataFrame(made, ROW.replace("timestamp_ntz", "int"))
        return df.withColumn("_ts", F.expr("timestampadd(SECOND, _ts, TIMESTAMP_NTZ '2024-01-01 00:00:00')"))

    spec = replica.registry_spec(["k", "j"])
    for n_base, n_log in ((30, 40), (30, 0), (0, 30), (0, 0), (5, 60)):
        base, log = rows(n_base), rows(n_log).dropDuplicates(["k", "j", "_ts", "_seq"]).cache()
        base = base.cache()
        want = replica.merge_changes(base, log, spec).count()
        assert [tuple(r) for r in replica.count_merged(base, log, spec).collect()] == [(want,)]


def test_only_keys_are_folded_to_count(spark, tmp_path, monkeypatch):
    reg = Registry(spark, str(tmp_path / "reg"))
    rows = lambda a, b, v: spark.range(a, b).select(F.col("id").alias("k"), F.lit(v).alias("v"))
    load(reg, "A", "t", rows(0, 20, "x"), ["k"], ns="va")
    load(reg, "A", "t", rows(10, 30, "y"), ["k"], ns="va")
    before = reg.stamp()
    remove(reg, "A", "t", rows(0, 3, "x"), ["k"], ns="va")
    rep = Replication(reg, "A", "B", "t", ["k"])
    rep.start()
    load(reg, "A", "t", rows(28, 35, "z"), ["k"], ns="va")
    rep.run_stream(rep.info())
    staged, real = [], replica.staged
    monkeypatch.setattr(replica, "staged", lambda df, label: staged.append(df.columns) or real(df, label))
    schema = rep._schema()
    assert staged == []
    got = counts.counts_at_once(reg, {"A": ("va", "t"), "B": ("vb-readonly", "t")})
    assert got == {"A": 32, "B": 32}
    assert table_inventory(spark, reg, "A", "va").first()["n_rows"] == 32
    assert counts.row_count(spark, reg, "A", "t", before).first()["n_rows"] == 30
    assert counts.count_with_fallback(spark, reg, "B", ["t"], "vb-readonly").first()["n_rows"] == 32
    assert len(staged) == 5 and all("v" not in columns for columns in staged)
    assert schema == reg.read("A", "va", "t").schema
    other = Registry(spark, reg.root)  # another driver rebuilds the view from the control log
    assert other.count("B", "vb-readonly", "t").first()["n_rows"] == 32 == other.read("B", "vb-readonly", "t").count()
    with pytest.raises(ValueError):
        counts.row_count(spark, reg, "A", "t", "2000-01-01 00:00:00").collect()
