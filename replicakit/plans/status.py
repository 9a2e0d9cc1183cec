"""Replication status, the ready gate and the health report."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replicakit.constants import (
    MAIN_NAMESPACE,
    MAX_ITERS,
    READONLY_SUFFIX,
    REPL_ATOB_ACTIVE,
    REPL_BTOA_ACTIVE,
    SIDE_A,
    SIDE_B,
    START_STATE_VOCAB,
    START_STATUS_VOCAB,
)
from replicakit.functions.text import first_token, is_true_value
from replicakit.operators.counts import compare_counts, count_with_fallback
from replicakit.operators.sizing import DEFAULT_BROADCAST_ROWS, broadcast_if_small
from replicakit.sources.registry import Registry, resolve_default

STATUS_INITIALIZING, STATUS_REPLICATING, STATUS_READY = "initializing", "replicating", "ready"


def replication_status(
    applied: DataFrame,
    source: DataFrame,
    ts_col: str,
    replica: str,
    direction: str,
    running: bool = True,
    cut_over: bool = False,
    data_state: str | None = None,
    base_frontier=None,
    stream_state: str | None = None,
    by_lag: bool = False,
) -> DataFrame:
    """One row ``(replica, direction, status, data_state, frontier_ts,
    applied_rows, lag_s)`` (O28).

    ``frontier_ts`` is the newest applied change, ``lag_s`` how far it is
    behind the newest source change. Both sides are tagged and aggregated in
    one pass (partial per task, one row shuffled per task); no join.
    ``status`` is ``initializing`` before the first applied change,
    ``replicating`` while running, ``ready`` after cutover. ``base_frontier``
    (a timestamp) is the frontier already held by a replica's base (its initial
    copy or last compaction), known without reading the base. ``stream_state``
    is the word of a live stream (:func:`stream_word`), where there is one. With ``by_lag``
    the data state is ``ready`` once no source change is newer than the frontier.
    """
    tagged = (applied.select(F.col(ts_col).alias("_ts"), F.lit(True).alias("_applied"))
              .unionByName(source.select(F.col(ts_col).alias("_ts"),
                                         F.lit(False).alias("_applied"))))
    newest = F.max(F.when(F.col("_applied"), F.col("_ts")))
    if base_frontier is not None:
        newest = F.greatest(newest, F.lit(base_frontier).cast("timestamp_ntz"))
    agg = tagged.agg(
        newest.alias("frontier_ts"),
        F.count_if(F.col("_applied")).alias("applied_rows"),
        F.max(F.when(~F.col("_applied"), F.col("_ts"))).alias("_src_max"),
    )
    # Zone-free difference of two timestamp_ntz values.
    micros = F.timestamp_diff("MICROSECOND", F.col("frontier_ts"), F.col("_src_max"))
    if cut_over:
        status = F.lit(STATUS_READY)
    elif stream_state is not None:
        status = F.lit(stream_state)
    else:
        status = F.when(F.col("frontier_ts").isNull(), F.lit(STATUS_INITIALIZING)).otherwise(
            F.lit(STATUS_REPLICATING if running else "paused"))
    behind = F.col("frontier_ts").isNull()
    if by_lag:
        behind = F.coalesce(F.col("_src_max") > F.col("frontier_ts"), behind & F.col("_src_max").isNotNull())
    state = F.lit(data_state) if data_state is not None else F.when(behind, F.lit("add")).otherwise(F.lit("ready"))
    return agg.select(
        F.lit(replica).alias("replica"),
        F.lit(direction).alias("direction"),
        status.alias("status"),
        state.alias("data_state"),
        "frontier_ts",
        "applied_rows",
        (micros / F.lit(1_000_000.0)).alias("lag_s"),
    )


STREAM_STATUS_SCHEMA = ("replica string, direction string, status string, batch_id bigint, "
                        "input_rows bigint, progress_ts string")


def stream_word(query) -> str:
    """A stream's state in the gate's words: ``initializing`` before its first finished
    batch, ``replicating`` while it runs, ``error`` if it failed, else ``stopped``."""
    if query.isActive:
        return STATUS_REPLICATING if query.lastProgress else STATUS_INITIALIZING
    return "error" if query.exception() is not None else "stopped"


def stream_status(spark: SparkSession, query, replica: str, direction: str) -> DataFrame:
    """O28's live form, from a running query's last progress (driver metrics,
    one row): ``initializing`` before its first batch, ``replicating`` while it
    runs, ``stopped`` after it ends, ``error`` if it failed."""
    p = query.lastProgress or {}
    row = (replica, direction, stream_word(query), p.get("batchId"), p.get("numInputRows"), p.get("timestamp"))
    return spark.createDataFrame([row], STREAM_STATUS_SCHEMA)


def ready_gate(
    polls: DataFrame,
    max_tries: int = MAX_ITERS,
    status_vocab: Sequence[str] = START_STATUS_VOCAB,
    state_vocab: Sequence[str] = START_STATE_VOCAB,
    status_word: str | None = "replicating",
    state_word: str | None = "ready",
    order: Sequence[str] | None = None,
    max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
) -> DataFrame:
    """``(replica, verdict, tries)`` over poll rows.

    Polls are ``(replica, try_no, status_text, data_state_text)``, or, with
    ``order``, poll rows ordered by those columns within each replica (the try
    number is the position in that order). A try passes when the first status
    word is ``status_word`` AND the first data-state word is ``state_word``
    (either may be ``None`` to ignore it: the failover gate waits for
    ``ready`` alone). ``verdict`` is ``ready`` at the first passing try within
    ``max_tries``, else ``timeout``; ``tries`` is that try, or the tries made.

    Only grouped aggregates, each combined map-side: a replica with a third of
    all polls never lands in one task.
    """
    ok = F.lit(True)
    if status_word is not None:
        ok = ok & (first_token("status_text", status_vocab) == F.lit(status_word))
    if state_word is not None:
        ok = ok & (first_token("data_state_text", state_vocab) == F.lit(state_word))
    if order is None:
        within = F.col("try_no") <= F.lit(max_tries)
        g = polls.groupBy("replica").agg(
            F.min(F.when(ok & within, F.col("try_no"))).alias("_first"),
            F.max(F.when(within, F.col("try_no"))).alias("_seen"),
        )
        return _gate_verdict(g)

    # Position of the first passing poll = 1 + polls before it (two aggregates).
    pos = F.struct(*[F.col(c) for c in order])
    firsts = polls.groupBy("replica").agg(
        F.min(F.when(ok, pos)).alias("_first_pos"),
        F.count(F.lit(1)).alias("_n"),
    )
    firsts = broadcast_if_small(firsts, max_broadcast_rows)
    before = polls.join(firsts, "replica").groupBy("replica").agg(
        F.count_if(pos < F.col("_first_pos")).alias("_before"),
        F.max(F.col("_first_pos").isNotNull()).alias("_any"),
        F.max("_n").alias("_n"),
    )
    first_try = F.col("_before") + 1
    g = before.select(
        "replica",
        F.when(F.col("_any") & (first_try <= max_tries), first_try).alias("_first"),
        F.least(F.col("_n"), F.lit(max_tries)).alias("_seen"),
    )
    return _gate_verdict(g)


def _gate_verdict(g: DataFrame) -> DataFrame:
    return g.select(
        "replica",
        F.when(F.col("_first").isNotNull(), F.lit("ready")).otherwise(F.lit("timeout"))
        .alias("verdict"),
        F.coalesce(F.col("_first"), F.col("_seen")).cast("bigint").alias("tries"),
    )


# ---------------------------------------------------------------- O35
def health_sources(state: dict[str, str]) -> tuple[str, dict[str, tuple[str, str | None]]]:
    """Which namespaces each side is counted at, from the control state.

    Returns the direction and ``{side: (preferred, fallback)}``; A→B is tested
    first, then B→A, then neither.
    """
    va, vb = MAIN_NAMESPACE[SIDE_A], MAIN_NAMESPACE[SIDE_B]
    if is_true_value(state.get(REPL_ATOB_ACTIVE)):
        return "A->B", {SIDE_A: (va, None), SIDE_B: (vb + READONLY_SUFFIX, vb)}
    if is_true_value(state.get(REPL_BTOA_ACTIVE)):
        return "B->A", {SIDE_A: (va + READONLY_SUFFIX, va), SIDE_B: (vb, None)}
    return "none", {SIDE_A: (va, va + READONLY_SUFFIX), SIDE_B: (vb, vb + READONLY_SUFFIX)}


def health_report(spark: SparkSession, reg: Registry, tables: Sequence[str],
                  detail: str = "counts") -> DataFrame:
    """Direction-aware counts of both sides, compared per table.

    ``(table_name, direction, served_by_a, n_a, served_by_b, n_b, verdict)``.
    A->B active: A from ``va`` alone, B from ``vb-readonly`` then ``vb``.
    B->A active: A from ``va-readonly`` then ``va``, B from ``vb`` alone.
    Neither: ``va`` then ``va-readonly``, ``vb`` then ``vb-readonly``.

    ``detail='full'`` gives the status report as one frame of ``(section, side,
    name, value)``: :func:`status_rows`, the live status of each replica (O28),
    the counts and the verdicts. A side of a verdict is the direction.
    """
    if detail not in ("counts", "full"):
        raise ValueError(f"detail is 'counts' or 'full', not {detail!r}")
    direction, src = health_sources(reg.state())
    ca = count_with_fallback(spark, reg, SIDE_A, tables, *src[SIDE_A])
    cb = count_with_fallback(spark, reg, SIDE_B, tables, *src[SIDE_B])
    cmp = compare_counts(ca, cb)
    report = (cmp.join(ca.select(F.col("table_name").alias("_t1"),
                                 F.col("served_by").alias("served_by_a")),
                       F.col("table_name") == F.col("_t1"), "left")
              .join(cb.select(F.col("table_name").alias("_t2"),
                              F.col("served_by").alias("served_by_b")),
                    F.col("table_name") == F.col("_t2"), "left")
              .select("table_name", F.lit(direction).alias("direction"), "served_by_a", "n_a",
                      "served_by_b", "n_b", "verdict"))
    if detail == "counts":
        return report
    out = status_rows(spark, reg)
    for status in _replica_statuses(reg):
        out = out.unionByName(status)
    n = [F.concat_ws(" ", F.coalesce(F.col(c).cast("string"), F.lit("N/A")), F.col(by))
         for c, by in (("n_a", "served_by_a"), ("n_b", "served_by_b"))]
    parts = [("count", F.lit(SIDE_A), n[0]), ("count", F.lit(SIDE_B), n[1]),
             ("verdict", F.col("direction"), F.col("verdict"))]
    rows = F.explode(F.array(*[F.struct(F.lit(section).alias("section"), side.alias("side"),
                                        F.col("table_name").alias("name"), value.alias("value"))
                               for section, side, value in parts]))
    return out.unionByName(report.select(rows.alias("r")).select("r.*"))


def _replica_statuses(reg: Registry) -> list[DataFrame]:
    """One ``status`` row per replica being fed, from its live status."""
    from replicakit.plans.replication import Replication, ReplicaInfo

    out = []
    for key, value in sorted(reg.state().items()):
        if not key.startswith("replica/"):
            continue
        _, side, _, table = key.split("/", 3)
        info = ReplicaInfo.decode(value)
        rep = Replication(reg, info.source_side, side, table, json.loads(info.keys or "[]"))
        text = F.concat_ws(" ", "status", "data_state", F.concat(F.lit("applied_rows="), "applied_rows"),
                           F.concat(F.lit("lag_s="), F.coalesce("lag_s", F.lit(0.0))))
        out.append(rep.status(info).select(F.lit("status").alias("section"), F.lit(side).alias("side"),
                                           F.lit(table).alias("name"), text.alias("value")))
    return out


def status_report(spark: SparkSession, reg: Registry,
                  tables: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The full status report: :func:`health_report` plus :func:`status_rows`."""
    return health_report(spark, reg, tables), status_rows(spark, reg)


def status_rows(spark: SparkSession, reg: Registry) -> DataFrame:
    """The status report's other parts as ``(section, side, name, value)`` rows:
    default pointers, namespaces with state and mode, tables per default
    namespace, replications in progress, whether each side is ingesting, and
    the direction flags."""
    rows = []
    st = reg.state()
    for side in (SIDE_A, SIDE_B):
        rows.append(("pointer", side, "default", resolve_default(reg, side)))
        for r in reg.inventory(side).collect():
            rows.append(("namespace", side, r["name"],
                         f"data_state={r['data_state']} service_mode={r['service_mode']}"))
        ns = resolve_default(reg, side)
        for t in reg.tables(side, ns):
            rows.append(("table", side, t, ns))
    # Replications in progress, and whether each side is ingesting (a replica
    # of its main namespace is being fed), as the status report shows them.
    for side in (SIDE_A, SIDE_B):
        main = MAIN_NAMESPACE[side]
        running = sorted(k for k in st if k.startswith(f"replica/{side}/{main}/"))
        for k in running:
            info = json.loads(st[k])
            rows.append(("replication", side, k.split("/", 3)[3],
                         f"from {info['source_side']}/{info['source_ns']} since {info['as_of']}"))
        rows.append(("ingesting", side, main, str(bool(running))))
    rows.append(("flag", SIDE_A, REPL_BTOA_ACTIVE, str(is_true_value(st.get(REPL_BTOA_ACTIVE)))))
    rows.append(("flag", SIDE_B, REPL_ATOB_ACTIVE, str(is_true_value(st.get(REPL_ATOB_ACTIVE)))))
    return spark.createDataFrame(rows, "section string, side string, name string, value string")
