"""A replica as a base snapshot plus applied change batches.

``initial_copy`` writes the first full copy at a start time; changes arrive
as batches (see :mod:`replicakit.streaming.replicate`); ``readonly_view`` is
the consistent replica at a frontier ``T``: base ∪ changes with ``ts <= T``,
merged by :func:`merge_changes` (the base is not shuffled when the folded
changes are small enough for Spark to broadcast).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replicakit.constants import DELETE
from replicakit.operators.fold import apply_changes
from replicakit.session import staged
from replicakit.sources.changes import TABLE_META as CHANGE_META


@dataclass(frozen=True)
class ChangeSpec:
    """How change rows are keyed and ordered."""

    keys: Sequence[str]
    order: Sequence[str] = ("_ts", "_seq")
    op_col: str = "_op"
    delete_value: str = DELETE
    meta: Sequence[str] = field(default=())

    @property
    def ts_col(self) -> str:
        return self.order[0]

    def data_columns(self, df: DataFrame) -> list[str]:
        """Columns of the replicated table (change metadata removed)."""
        return [c for c in df.columns if c not in self.meta]


#: The change metadata the registry's own tables carry.
TABLE_META = CHANGE_META


def registry_spec(keys: Sequence[str]) -> ChangeSpec:
    return ChangeSpec(keys=tuple(keys), order=("_ts", "_seq"), op_col="_op", meta=TABLE_META)


def _ts_lit(as_of: dt.datetime | str | Column) -> Column:
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, dt.datetime):
        as_of = as_of.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.expr(f"TIMESTAMP_NTZ '{as_of}'")


def initial_copy(source: DataFrame, ts_col: str | None, as_of, path: str) -> DataFrame:
    """First full copy of ``source`` as of ``as_of`` written to ``path``.

    The ``ts <= as_of`` filter reaches the Parquet scan (row groups outside it
    are skipped); the copy is written once and read back, which also cuts the
    lineage. ``ts_col=None`` copies everything.
    """
    rows = source if ts_col is None else source.filter(F.col(ts_col) <= _ts_lit(as_of))
    rows.write.mode("overwrite").parquet(path)
    return source.sparkSession.read.parquet(path)


def merge_changes(base: DataFrame, log: DataFrame, spec: ChangeSpec,
                  keep_deletes: bool = False) -> DataFrame:
    """Newest row per key of ``base`` and ``log``; one plan at every size.

    The log is folded first (one shuffle of the log only) and written to the
    shared scratch folder, so its true size is known to the planner: a small one
    is broadcast by Spark's own threshold and ``base`` is scanned, not shuffled;
    a large one is joined by key. ``base`` left join the newest changes takes the
    newer row per key (a late, older change loses), and changed keys absent from
    ``base`` are added. Should ``base`` repeat a key, each of its rows is compared
    by itself.
    """
    keys, cols = list(spec.keys), base.columns
    folded = apply_changes(log.select(*cols), keys, spec.order, spec.op_col, spec.delete_value,
                           keep_deletes=True)
    newest = staged(folded, "folded")
    n = newest.select(*[F.col(c).alias(f"_n_{c}") for c in cols], F.lit(True).alias("_hit"))
    on = reduce(lambda a, b: a & b, [base[k].eqNullSafe(F.col(f"_n_{k}")) for k in keys])
    joined = base.join(n, on, "left")
    take_new = F.col("_hit").isNotNull() & (
        F.struct(*[F.col(f"_n_{c}") for c in spec.order])
        > F.struct(*[base[c] for c in spec.order]))
    updated = joined.select(*[F.when(take_new, F.col(f"_n_{c}")).otherwise(base[c]).alias(c)
                              for c in cols])
    matched = base.select(*keys).join(n, on, "left_semi").select(
        *[F.col(k).alias(f"_m_{k}") for k in keys])
    on_m = reduce(lambda a, b: a & b, [newest[k].eqNullSafe(F.col(f"_m_{k}")) for k in keys])
    out = updated.unionByName(newest.join(matched, on_m, "left_anti"))
    if not keep_deletes:
        out = out.filter(~F.col(spec.op_col).eqNullSafe(F.lit(spec.delete_value)))
    return out


def count_merged(base: DataFrame, log: DataFrame, spec: ChangeSpec) -> DataFrame:
    """``(n_rows)``: how many rows :func:`merge_changes` leaves, without merging them.

    Only keys, order and op are read, folded and joined, once: the live rows of ``base``, and
    the folded log's live rows, less what each key that both have adds twice or takes away. A
    small folded log is broadcast, so the keys of ``base`` are scanned, not shuffled.
    """
    keys, cols = list(spec.keys), [*spec.keys, *spec.order, spec.op_col]
    newest = staged(apply_changes(log.select(*cols), keys, spec.order, spec.op_col, spec.delete_value,
                                  keep_deletes=True), "folded-keys")
    base, n = base.select(*cols), newest.select(*[F.col(c).alias(f"_n_{c}") for c in cols])

    def live(c: str) -> Column:
        return (~F.col(c).eqNullSafe(F.lit(spec.delete_value))).cast("bigint")

    on = reduce(lambda a, b: a & b, [base[k].eqNullSafe(F.col(f"_n_{k}")) for k in keys])
    take_new = (F.struct(*[F.col(f"_n_{c}") for c in spec.order]) > F.struct(*[base[c] for c in spec.order]))
    change = F.when(take_new, live(f"_n_{spec.op_col}") - live(spec.op_col)).otherwise(0)
    # A key that base repeats is one of the folded log.
    met = base.join(n, on).groupBy(*[f"_n_{k}" for k in keys]).agg(
        (F.sum(change) - F.max(live(f"_n_{spec.op_col}"))).alias("n"))
    parts = [base.agg(F.sum(live(spec.op_col)).alias("n")), newest.agg(F.sum(live(spec.op_col)).alias("n")),
             met.agg(F.sum("n").alias("n"))]
    return reduce(DataFrame.unionByName, parts).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


def upto(log: DataFrame, spec: ChangeSpec, as_of=None) -> DataFrame:
    """Changes no later than ``as_of`` (``None``: all); the filter reaches the scan."""
    return log if as_of is None else log.filter(F.col(spec.ts_col) <= _ts_lit(as_of))


def readonly_view(base: DataFrame, log: DataFrame, spec: ChangeSpec, as_of=None) -> DataFrame:
    """Consistent replica at frontier ``as_of`` (``None`` = everything).

    ``base`` must carry the order and op columns (tombstones kept). The
    frontier filter is applied to the log first, so it reaches the Parquet scan
    of the change batches; the merge is :func:`merge_changes`.
    """
    view = merge_changes(base, upto(log, spec, as_of), spec, keep_deletes=False)
    return view.select(*spec.data_columns(view)) if spec.meta else view


def read_batches(spark: SparkSession, path: str, schema,
                 after_batch: int | None = None) -> DataFrame:
    """All applied change batches under ``path`` (``batch=<id>`` folders).

    ``after_batch`` keeps only later batches (partition pruning: earlier
    folders are not listed into the scan). An absent folder reads as no rows.
    """
    try:
        df = spark.read.parquet(path)
    except AnalysisException as err:
        if err.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return spark.createDataFrame([], schema)
        raise
    if "batch" not in df.columns:
        return df
    if after_batch is not None:
        df = df.filter(F.col("batch") > F.lit(after_batch))
    return df.drop("batch")


def last_batch(spark: SparkSession, path: str) -> int | None:
    """Highest ``batch=<id>`` under ``path`` (a partition-column aggregate)."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as err:
        if err.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    if "batch" not in df.columns:
        return None
    return df.agg(F.max("batch").alias("b")).first()["b"]
