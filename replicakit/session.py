"""SparkSession set-up and the shared scratch folder.

Every job that has to write (initial copies, change batches, new table
versions, stream checkpoints) writes below the folder the cluster names in
``spark.checkpoint.dir``. That folder is read from the session; a private
one is created only when the session has none (local tests).
"""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Session defaults. AQE re-plans joins at runtime (broadcast when the real
# shuffle output is small, split skewed partitions, coalesce tiny ones).
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Checkpoints (folded change sets, bucket lists, diffs) are removed once
    # their DataFrames are garbage collected.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(
    master: str | None = None,
    app: str = "replicakit",
    shuffle_partitions: int | None = None,
    driver_memory: str | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if driver_memory:
        conf["spark.driver.memory"] = driver_memory
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a private one only if unset."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a remote (Connect) session has no context
        sc = None
    base = sc.getCheckpointDir() if sc is not None else None
    if not base:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base and sc is not None:
            sc.setCheckpointDir(base)
            base = sc.getCheckpointDir()
    if not base:
        # No shared folder configured: allowed only for a local run (tests,
        # bench); on a cluster a machine-local folder would lose data.
        master = (spark.conf.get("spark.master", None) or
                  (sc.master if sc is not None else "")) or ""
        if not re.fullmatch(r"local(\[.*\])?", master):  # local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        base = tempfile.mkdtemp(prefix="replicakit-ckpt-")
        if sc is not None:
            sc.setCheckpointDir(base)
            base = sc.getCheckpointDir()
        else:
            spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused folder below the shared checkpoint folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


_scope = threading.local()


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark's file systems keep it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def move_path(spark: SparkSession, path: str, target: str) -> None:
    """Rename a folder, making the target's parent."""
    jvm = spark._jvm.org.apache.hadoop.fs
    source, goal = jvm.Path(path), jvm.Path(target)
    fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(goal.getParent())
    if not fs.rename(source, goal):
        raise OSError(f"cannot move {path} to {target}")


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """What is staged inside is deleted at the end: for flows that write their result, so
    that nothing reads it any more. An inner scope leaves it to the outer one."""
    if getattr(_scope, "paths", None) is not None:
        yield
        return
    _scope.paths = []
    try:
        yield
    finally:
        paths, _scope.paths = _scope.paths, None
        for path in paths:
            delete_path(spark, path)


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back: evaluated once, its
    true size known to the planner, nothing recomputed after a lost executor."""
    path = scratch_path(df.sparkSession, label)
    if getattr(_scope, "paths", None) is not None:
        _scope.paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
