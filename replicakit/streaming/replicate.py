"""Continuous replication of change files.

A file stream over the source's change folder; every micro-batch is written
under its own ``batch=<id>`` folder in overwrite mode, so a batch replayed
after a failure (same id, same files, from the checkpoint's offset log)
replaces itself instead of adding rows twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from replicakit.operators.fold import apply_changes


def batch_path(out: str, batch_id: int) -> str:
    return f"{out.rstrip('/')}/batch={batch_id}"


def replicate_stream(
    spark: SparkSession,
    src_dir: str,
    schema: StructType,
    out: str,
    ckpt: str,
    trigger: dict | None = None,
    max_files_per_trigger: int | None = None,
    max_bytes_per_trigger: int | None = None,
    after=None,
    ts_col: str | None = None,
    query_name: str | None = None,
    fold_spec=None,
) -> StreamingQuery:
    """Start replicating change files from ``src_dir`` into ``out``.

    ``trigger`` is passed to ``DataStreamWriter.trigger`` (default
    ``availableNow``: drain what is there, then stop). A batch is bounded by files or, without
    that, by bytes (one file at least). ``after`` skips changes
    at or before a time already covered by the initial copy. With
    ``fold_spec`` (a :class:`replicakit.plans.replica.ChangeSpec`) each batch
    is folded to its newest row per key, tombstones kept, before it is written:
    a key changed many times in one batch is stored once. Folding is
    deterministic, so a replayed batch still overwrites itself identically.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    elif max_bytes_per_trigger:  # the source takes one bound or the other
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    # Only the declared columns: folders like ``epoch=<v>`` add partition columns.
    changes: DataFrame = reader.parquet(src_dir).select(*schema.fieldNames())
    if after is not None:
        changes = changes.filter(F.col(ts_col) > F.lit(after).cast("timestamp_ntz"))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        if fold_spec is not None:
            batch = apply_changes(batch, fold_spec.keys, fold_spec.order, fold_spec.op_col,
                                  fold_spec.delete_value, keep_deletes=True)
        batch.write.mode("overwrite").parquet(batch_path(out, batch_id))

    writer = (changes.writeStream.foreachBatch(write_batch)
              .option("checkpointLocation", ckpt)
              .trigger(**(trigger or {"availableNow": True})))
    if query_name:
        writer = writer.queryName(query_name)
    return writer.start()


def drain(query: StreamingQuery, timeout_s: float | None = None) -> bool:
    """Wait for an ``availableNow`` query to finish; ``False`` on timeout.

    On timeout the query is stopped; a failed query raises here.
    """
    if timeout_s is None:
        query.awaitTermination()
        return True
    done = bool(query.awaitTermination(timeout_s))
    if not done:
        query.stop()
    return done
