"""Key-level difference between a source and a replica, and applying it
(O22, O23).

``resync_diff`` joins both sides by key (one shuffle and one sort of each side);
keys that repeat on a side are found first and grouped instead, so a key
duplicated many times is combined map-side and never paired with itself. With
``exact=False`` it first compares
a digest per key bucket on both sides — one scan each, aggregated partially so
only ``buckets`` rows per side are shuffled — and runs the key join only on
the rows of buckets whose digests differ. A digest collision could hide a
difference, so ``exact=True`` (no pruning) is the default.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replicakit.constants import DELETE, INSERT, UPDATE
from replicakit.session import shared_dir, staged

# The changed-bucket list is broadcast; this bound keeps it under ~1 MB.
MAX_BUCKETS = 1 << 16


def _value_cols(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in keys]


def _all_equal(pairs: list[tuple[Column, Column]]) -> Column:
    if not pairs:
        return F.lit(True)
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in pairs])


def key_bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets))


def row_hash(cols: Sequence[str]) -> Column:
    """64-bit hash of a whole row; a null mask keeps ``(null, 1)`` and
    ``(1, null)`` apart (the hash itself skips nulls)."""
    mask = F.array(*[F.col(c).isNull() for c in cols])
    return F.xxhash64(*[F.col(c) for c in cols], mask)


def bucket_digest(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """``(_bucket, n_rows, x_hash, s_hash)`` per key bucket.

    ``count`` + ``bit_xor`` + ``sum`` (as ``decimal(38,0)``, which cannot
    overflow under ANSI mode) of the row hashes. Aggregated map-side first.
    """
    cols = list(keys) + _value_cols(df, keys)
    h = df.select(key_bucket(keys, buckets).alias("_bucket"), row_hash(cols).alias("_h"))
    return h.groupBy("_bucket").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.bit_xor("_h").alias("x_hash"),
        F.sum(F.col("_h").cast("decimal(38,0)")).alias("s_hash"),
    )


def changed_buckets(source: DataFrame, replica: DataFrame, keys: Sequence[str],
                    buckets: int) -> DataFrame:
    """Buckets whose digests differ (at most ``buckets`` rows)."""
    a = bucket_digest(source, keys, buckets).alias("a")
    b = bucket_digest(replica, keys, buckets).alias("b")
    same = _all_equal([(F.col(f"a.{c}"), F.col(f"b.{c}")) for c in ("n_rows", "x_hash", "s_hash")])
    return (
        a.join(b, F.col("a._bucket") == F.col("b._bucket"), "full_outer")
        .filter(~same)
        .select(F.coalesce(F.col("a._bucket"), F.col("b._bucket")).alias("_bucket"))
    )


def _prune(df: DataFrame, keys: Sequence[str], buckets: int, changed: DataFrame) -> DataFrame:
    # The changed list has at most ``buckets`` <= MAX_BUCKETS rows: a proven bound.
    tagged = df.withColumn("_bucket", key_bucket(keys, buckets))
    return tagged.join(F.broadcast(changed), "_bucket", "left_semi").drop("_bucket")


def resync_diff(
    source: DataFrame,
    replica: DataFrame,
    keys: Sequence[str],
    exact: bool = True,
    buckets: int = 4096,
    max_changed_fraction: float = 0.5,
    unique: bool = False,
) -> DataFrame:
    """Per key the action that makes ``replica`` equal to ``source``.

    Keys are counted first (a pass over the key columns only). Unique keys go through one
    full outer join, which sorts each side once; keys repeated on a side are grouped
    instead, so they form no pairs. ``unique=True`` says that no key repeats (as in a
    registry table written by loads) and spares the count.
    With ``exact=False`` the join only sees buckets whose digests
    differ, unless more than ``max_changed_fraction`` of them do.

    Output: the key columns, ``action`` (``insert``/``update``/``delete``) and
    the source's value columns (null for deletes). Values compare null-safely;
    null keys form one key. A key duplicated in the replica is an ``update``,
    so :func:`apply_diff` rewrites it as one row. The source is the authority
    and should be unique by key (``check_unique``); of duplicated source rows
    one is taken.
    """
    keys = list(keys)
    vals = _value_cols(source, keys)
    missing = set(source.columns) ^ set(replica.columns)
    if missing:
        raise ValueError(f"source and replica differ in columns: {sorted(missing)}")
    if not exact:
        if not 1 <= buckets <= MAX_BUCKETS:
            raise ValueError(f"buckets must be in 1..{MAX_BUCKETS}")
        # Materialised once (at most ``buckets`` rows) in the shared checkpoint
        # folder, so both sides prune against one small, lineage-free table.
        shared_dir(source.sparkSession)
        changed = changed_buckets(source, replica, keys, buckets).checkpoint(eager=True)
        # When most buckets differ, pruning would filter almost nothing.
        if changed.count() <= max_changed_fraction * buckets:
            source = _prune(source, keys, buckets, changed)
            replica = _prune(replica, keys, buckets, changed)

    repeated = _repeated_keys(source, replica, keys)
    if unique or repeated.isEmpty():
        return _diff_unique(source, replica, keys, vals)
    repeated = staged(repeated, "repeated-keys")
    alone = _diff_unique(_by_keys(source, repeated, keys, "left_anti"),
                         _by_keys(replica, repeated, keys, "left_anti"), keys, vals)
    return alone.unionByName(_diff_grouped(_by_keys(source, repeated, keys, "left_semi"),
                                           _by_keys(replica, repeated, keys, "left_semi"), keys, vals))


def _repeated_keys(source: DataFrame, replica: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once on a side; only key columns are read and shuffled."""
    k = [F.col(c) for c in keys]
    both = source.select(*k, F.lit(True).alias("_side")).unionByName(
        replica.select(*k, F.lit(False).alias("_side")))
    return both.groupBy(*keys, "_side").count().filter("count > 1").select(*keys).distinct()


def _by_keys(df: DataFrame, wanted: DataFrame, keys: list[str], how: str) -> DataFrame:
    w = wanted.select(*[F.col(k).alias(f"_w_{k}") for k in keys])
    return df.join(w, reduce(lambda a, b: a & b, [df[k].eqNullSafe(F.col(f"_w_{k}")) for k in keys]), how)


def _diff_unique(source: DataFrame, replica: DataFrame, keys: list[str], vals: list[str]) -> DataFrame:
    """Keys that are unique on both sides: one full outer join, so each side is shuffled and
    sorted once, and no key makes pairs or fills a task."""
    s = source.select(*[F.col(k).alias(f"_a_{k}") for k in keys], F.struct(*vals).alias("_s"))
    r = replica.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.struct(*vals).alias("_r"))
    on = reduce(lambda a, b: a & b, [F.col(f"_a_{k}").eqNullSafe(F.col(f"_b_{k}")) for k in keys])
    same = _all_equal([(F.col("_s")[c], F.col("_r")[c]) for c in vals])
    action = (F.when(F.col("_r").isNull(), F.lit(INSERT)).when(F.col("_s").isNull(), F.lit(DELETE))
              .when(~same, F.lit(UPDATE)))
    key = [F.when(F.col("_s").isNull(), F.col(f"_b_{k}")).otherwise(F.col(f"_a_{k}")).alias(k) for k in keys]
    return (s.join(r, on, "full_outer")
            .select(*key, action.alias("action"), *[F.col("_s")[c].alias(c) for c in vals])
            .filter(F.col("action").isNotNull()))


def _diff_grouped(source: DataFrame, replica: DataFrame, keys: list[str], vals: list[str]) -> DataFrame:
    """Repeated keys: both sides grouped by key, so that a key makes one row whatever its
    repeats, no pairs are formed, and a hot key combines map-side."""
    side = F.col("_side")
    tagged = (source.select(*keys, F.struct(*vals).alias("_v"), F.lit(1).alias("_side"))
              .unionByName(replica.select(*keys, F.struct(*vals).alias("_v"),
                                          F.lit(0).alias("_side"))))
    g = tagged.groupBy(*keys).agg(
        F.max_by("_v", F.when(side == 1, F.lit(1))).alias("_s"),
        F.max_by("_v", F.when(side == 0, F.lit(1))).alias("_r"),
        F.count_if(side == 1).alias("_n_s"),
        F.count_if(side == 0).alias("_n_r"),
    )
    same = _all_equal([(F.col("_s")[c], F.col("_r")[c]) for c in vals])
    action = (
        F.when(F.col("_n_r") == 0, F.lit(INSERT))
        .when(F.col("_n_s") == 0, F.lit(DELETE))
        # Duplicated replica keys are rewritten whole.
        .when((F.col("_n_r") > 1) | ~same, F.lit(UPDATE))
    )
    return (
        g.select(*keys, action.alias("action"),
                 *[F.when(F.col("_n_s") > 0, F.col("_s")[c]).alias(c) for c in vals])
        .filter(F.col("action").isNotNull())
    )


def diff_summary(diff: DataFrame) -> DataFrame:
    """``(action, n_rows)`` of a diff: what a dry run reports."""
    return diff.groupBy("action").agg(F.count(F.lit(1)).alias("n_rows"))


def apply_diff(replica: DataFrame, diff: DataFrame, keys: Sequence[str],
               materialize: bool = True) -> DataFrame:
    """Replica with every touched key removed, plus inserted and updated rows.

    Afterwards ``resync_diff(source, result)`` is empty. The diff is read
    twice (touched keys, new rows), so unless it is already materialised it is
    checkpointed once in the shared folder. The anti join is planned by AQE:
    a small diff is broadcast at run time, a large one shuffles.
    """
    keys = list(keys)
    if materialize:
        shared_dir(diff.sparkSession)
        diff = diff.checkpoint(eager=True)
    touched = diff.select(*[F.col(k).alias(f"_t_{k}") for k in keys])
    on = [replica[k].eqNullSafe(F.col(f"_t_{k}")) for k in keys]
    kept = replica.join(touched, on, "left_anti")
    new_rows = diff.filter(F.col("action").isin(INSERT, UPDATE)).select(*replica.columns)
    return kept.unionByName(new_rows)
