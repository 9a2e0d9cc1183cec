"""Tables stored by key bucket with a digest tree, and their difference (O22, pruned).

``store_keyed`` writes a table into ``2 ** depth`` folders by a hash of its keys, each row with
its own hash, and from those hashes (8 bytes a row, read back once) a tree of digests: a node of
level L stands for all buckets that agree in their lowest L bits, and its digest follows from its
children's. Two stored tables are compared level by level, reading only children of nodes that
differ. What is left is a list of leaf buckets, and only their files are read for the exact
difference. Depths need not agree: the shallower one's leaves are inner nodes of the deeper.

A collision of digests (row count, exclusive or and sum of 64-bit hashes) could hide a difference,
as with any digest; ``resync_diff`` without it is exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replicakit.operators.diff import key_bucket, resync_diff, row_hash
from replicakit.sources.tables import read_table

#: Columns that a stored table carries besides its own.
BUCKET, HASH = "_bucket", "_hash"

#: Rows of a bucket, about; buckets at most (their list passes through the driver).
BUCKET_ROWS, MAX_DEPTH = 250_000, 16

#: Bits between two levels of the digest tree below the root.
LEVEL_BITS = 8

NODE_SCHEMA = "node bigint, n_rows bigint, x_hash bigint, s_hash decimal(38,0), level int"


@dataclass(frozen=True)
class KeyedTable:
    """Where a table is stored, the folder of its digests, and its depth."""

    path: str
    digests: str
    depth: int


def depth_for(n_rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """The least depth whose buckets hold ``bucket_rows`` on average."""
    return min(MAX_DEPTH, max(0, -(-n_rows // bucket_rows) - 1).bit_length())


def levels(depth: int) -> list[int]:
    return [*range(LEVEL_BITS, depth, LEVEL_BITS), depth]


def store_keyed(df: DataFrame, keys: Sequence[str], table: KeyedTable) -> None:
    """Write ``df`` (unique by ``keys``) by key bucket: one shuffle, a file or two per bucket."""
    spark, buckets = df.sparkSession, 1 << table.depth
    (df.withColumn(HASH, row_hash(df.columns)).withColumn(BUCKET, key_bucket(keys, buckets))
     .repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(table.path))
    leaves = spark.read.parquet(table.path).select(F.col(BUCKET).cast("bigint").alias("leaf"), HASH).groupBy("leaf").agg(
        F.count(F.lit(1)).alias("n_rows"), F.bit_xor(HASH).alias("x_hash"),
        F.sum(F.col(HASH).cast("decimal(38,0)")).alias("s_hash"))
    steps = F.explode(F.array(*[F.lit(x) for x in levels(table.depth)])).alias("level")
    node = F.col("leaf").bitwiseAND(F.expr("shiftleft(1L, level) - 1")).alias("node")
    tree = (leaves.select("*", steps).select(node, "level", "n_rows", "x_hash", "s_hash").groupBy("level", "node")
            .agg(F.sum("n_rows").alias("n_rows"), F.bit_xor("x_hash").alias("x_hash"),
                 F.sum("s_hash").cast("decimal(38,0)").alias("s_hash")))
    # At most twice as many rows as buckets.
    tree.coalesce(1).write.mode("overwrite").partitionBy("level").parquet(table.digests)


def rows_of(spark: SparkSession, path: str) -> DataFrame:
    """A stored table's rows, whether by key bucket or not."""
    return read_table(spark, path).drop(BUCKET, HASH)


def rows_in(spark: SparkSession, table: KeyedTable, depth: int, nodes: Sequence[int]) -> DataFrame:
    """Rows whose bucket lies below one of ``nodes`` of level ``depth``; other files are not read."""
    node = F.col(BUCKET).cast("bigint").bitwiseAND(F.lit((1 << depth) - 1).cast("bigint"))
    return read_table(spark, table.path).filter(node.isin([int(n) for n in nodes])).drop(BUCKET, HASH)


def changed_nodes(spark: SparkSession, a: KeyedTable, b: KeyedTable) -> list[int]:
    """Nodes at the lesser of both depths whose digests differ, found level by level; each
    reads only its own folder. At most ``2 ** MAX_DEPTH`` numbers reach the driver."""
    depth = min(a.depth, b.depth)
    # Where the depths differ, a level of one need not be one of the other.
    shared = [x for x in levels(a.depth) if x in levels(b.depth) and x < depth]
    above, changed = 0, [0]
    for level in [*shared, depth]:
        inside = F.col("node").bitwiseAND(F.lit((1 << above) - 1).cast("bigint")).isin(changed)
        sides = []
        for t in (a, b):
            own = next(x for x in levels(t.depth) if x >= level)
            nodes = spark.read.schema(NODE_SCHEMA).parquet(t.digests).filter(F.col("level") == own)
            up = F.col("node").bitwiseAND(F.lit((1 << level) - 1).cast("bigint")).alias("node")
            sides.append(nodes.select(up, "n_rows", "x_hash", "s_hash").groupBy("node").agg(
                F.sum("n_rows").alias("n_rows"), F.bit_xor("x_hash").alias("x_hash"),
                F.sum("s_hash").cast("decimal(38,0)").alias("s_hash")).filter(inside))
        digest = ["n_rows", "x_hash", "s_hash"]
        x = sides[0].select("node", F.struct(*digest).alias("x"))
        y = sides[1].select("node", F.struct(*digest).alias("y"))
        changed = [r["node"] for r in x.join(y, "node", "full_outer").filter(
            ~F.col("x").eqNullSafe(F.col("y"))).select("node").collect()]
        if not changed:
            return []
        above = level
    return changed


def buckets_of(changes: DataFrame, keys: Sequence[str], depth: int) -> set[int]:
    """Nodes of level ``depth`` that hold a key of ``changes``."""
    return {r["b"] for r in changes.select(key_bucket(keys, 1 << depth).alias("b")).distinct().collect()}


def keyed_diff(spark: SparkSession, source: KeyedTable, replica: KeyedTable, keys: Sequence[str],
               nodes: Iterable[int] | None = None) -> DataFrame:
    """:func:`resync_diff` of two stored tables that are unique by ``keys``, over the files of the
    buckets that differ (or of ``nodes``) only."""
    depth = min(source.depth, replica.depth)
    nodes = changed_nodes(spark, source, replica) if nodes is None else list(nodes)
    return resync_diff(rows_in(spark, source, depth, nodes), rows_in(spark, replica, depth, nodes), keys, unique=True)
