"""Watch two sides' counts of a table.

A timer stream (one row a trigger, no input files) makes the ticks. Every tick counts
the table on both sides anew, at one point in time, and compares the counts (O21); so
updates and deletes count as what they leave, and a tick comes whether or not anything
arrived. The tick's row is written under ``tick=<n>`` in overwrite mode, so a tick replayed
after a failure replaces itself. The watch ends at the first match or after ``max_ticks``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replicakit.constants import MATCH, SIDE_A, SIDE_B, WATCH_EVERY, WATCH_TICKS
from replicakit.functions.text import canon_side
from replicakit.operators.counts import COUNT_SCHEMA, compare_counts, counts_at_once
from replicakit.plans.replica import read_batches
from replicakit.session import scratch_scope
from replicakit.sources.registry import Registry

TICK_SCHEMA = "tick bigint, n_a bigint, n_b bigint, verdict string"


def tick_row(reg: Registry, table: str, side_a: str = SIDE_A, side_b: str = SIDE_B) -> DataFrame:
    """``(n_a, n_b, verdict)``: both sides' default namespaces counted as of one moment; a
    side that cannot be counted now is ``waiting``."""
    side_a, side_b = canon_side(side_a), canon_side(side_b)
    counts = counts_at_once(reg, {s: (None, table) for s in (side_a, side_b)}, reg.stamp())
    frames = [reg.spark.createDataFrame([(s, table, counts.get(s))], COUNT_SCHEMA) for s in (side_a, side_b)]
    return compare_counts(*frames).select("n_a", "n_b", "verdict")


def watch_counts(
    reg: Registry,
    table: str,
    out: str,
    ckpt: str,
    side_a: str = SIDE_A,
    side_b: str = SIDE_B,
    max_ticks: int = WATCH_TICKS,
    every: str = WATCH_EVERY,
    available_now: bool = False,
) -> DataFrame:
    """Run the watch; ``(tick, n_a, n_b, verdict)`` up to the first match or ``max_ticks``.

    A tick comes ``every`` interval of the clock. ``available_now=True`` makes one tick and
    returns; the timer's offsets live in ``ckpt`` and the ticks in ``out``, so a further call
    goes on with the next tick, also from another driver.
    """
    spark = reg.spark
    ended: list[int] = []

    def matched_before() -> bool:
        return not read_batches(spark, out, TICK_SCHEMA).filter(F.col("verdict") == MATCH).isEmpty()

    def on_tick(_timer: DataFrame, batch_id: int) -> None:
        tick = batch_id + 1
        if ended or tick > max_ticks or matched_before():
            ended.append(tick)
            return
        reg.refresh()  # what other drivers have written since
        path = f"{out.rstrip('/')}/tick={tick}"
        with scratch_scope(spark):
            tick_row(reg, table, side_a, side_b).coalesce(1).write.mode("overwrite").parquet(path)
        if tick == max_ticks or spark.read.parquet(path).first()["verdict"] == MATCH:
            ended.append(tick)

    timer = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    query = (timer.writeStream.foreachBatch(on_tick).option("checkpointLocation", ckpt)
             .trigger(**trigger).start())
    try:
        while not query.awaitTermination(0.2) and not ended:  # a failed tick raises here
            pass
    finally:
        if query.isActive:
            query.stop()
    ticks = read_batches(spark, out, TICK_SCHEMA)
    if "tick" not in ticks.columns:
        return spark.createDataFrame([], TICK_SCHEMA)
    # At most ``max_ticks`` rows exist.
    first_match = ticks.filter(F.col("verdict") == MATCH).agg(F.min("tick")).first()[0]
    last = min(first_match or max_ticks, max_ticks)
    return (ticks.filter(F.col("tick") <= F.lit(last))
            .select(F.col("tick").cast("bigint").alias("tick"), "n_a", "n_b", "verdict"))
