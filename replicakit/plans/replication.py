"""Replicate a table from one side to the other, cut over, and restart
(O27 wiring, O29, O30).

Layout below the registry root, per ``(side, namespace, table)``:

``changes/{side}/{ns}/{table}/epoch={v}/``          change rows written by loads
``replica/{side}/{ns}/{table}/base/v={n}/``         replica base (with tombstones)
``replica/{side}/{ns}/{table}/applied/run={r}/``    applied batches (``batch=<id>``)
``replica/{side}/{ns}/{table}/ckpt/run={r}/``       stream checkpoint

A restart's base is the version the side already stores; its difference to the
source is written as batch -1 (the version's own pending changes as batch -2).

Replica bookkeeping (source, base version, run, start time, compaction
watermark, keys) is kept in the control log, so a new driver can pick a
replication up where it was and any driver can read the read-only replica.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from replicakit.constants import (
    DELETE,
    FAILOVER_ATOB_DONE,
    FAILOVER_BTOA_DONE,
    MAIN_NAMESPACE,
    MAX_ITERS,
    POLL_INTERVAL_S,
    READONLY_SUFFIX,
    READY_MAX_ITERS,
    READY_POLL_INTERVAL_S,
    REPL_ATOB_ACTIVE,
    REPL_BTOA_ACTIVE,
    RESTART_STATE_VOCAB,
    RESTART_STATUS_VOCAB,
    SIDE_A,
    SIDE_B,
    START_STATE_VOCAB,
    START_STATUS_VOCAB,
    UPSERT,
)
from replicakit.functions.text import canon_side
from replicakit.operators.diff import diff_summary, resync_diff
from replicakit.operators.fold import apply_changes
from replicakit.operators.integrity import check_unique
from replicakit.operators.keyed import buckets_of, changed_nodes, rows_of
from replicakit.operators.upsert import upsert
from replicakit.plans.replica import (
    ChangeSpec,
    count_merged,
    last_batch,
    merge_changes,
    read_batches,
    readonly_view,
    registry_spec,
    upto,
)
from replicakit.plans.status import ready_gate, replication_status, stream_word
from replicakit.session import move_path, scratch_scope, staged
from replicakit.sources.changes import (
    TS_FORMAT,
    change_schema,
    parse_ts,
    ts_lit,
    with_meta,
)
from replicakit.sources.registry import (
    CONTROL_SET,
    Registry,
    is_path_not_found,
    keys_key,
    pending_key,
    resolve_default,
    swap_default,
    watermark_key,
)
from replicakit.sources.tables import read_table
from replicakit.streaming.heartbeat import Heartbeat, recorded_word, stream_key, write_record
from replicakit.streaming.replicate import batch_path, drain, replicate_stream

#: Loads between two compactions of a table (merge on read in between).
COMPACT_EVERY = 16

#: Bytes of change files in a micro-batch, about: a backlog is many batches, each kept once done.
BYTES_PER_BATCH = 1 << 30

#: Ids of the batches that a restart writes, and the watermark below them.
PENDING_BATCH, DIFF_BATCH, BEFORE_RESTART = -2, -1, -3


class ReplicationTimeout(RuntimeError):
    """A gate or a drain did not finish in its budget."""


def changes_dir(reg: Registry, side: str, ns: str, table: str) -> str:
    return reg.changes_path(side, ns, table)


def replica_dir(reg: Registry, side: str, ns: str, table: str) -> str:
    return f"{reg.root}/replica/{side}/{ns}/{table}"


# ------------------------------------------------------------------ writes
def _checked_keys(reg: Registry, side: str, ns: str, table: str, keys: Sequence[str]) -> list[str]:
    recorded = reg.table_keys(side, ns, table)
    if recorded is not None and recorded != list(keys):
        raise ValueError(f"{side}/{ns}/{table} is keyed by {recorded}, not {list(keys)}")
    return list(keys)


def _touched(df: DataFrame, keys_df: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Rows of ``df`` whose key is (``left_semi``) or is not (``left_anti``) in ``keys_df``;
    null keys are keys like any other."""
    k = keys_df.select(*[F.col(c).alias(f"_k_{c}") for c in keys])
    return df.join(k, reduce(lambda a, b: a & b, [df[c].eqNullSafe(F.col(f"_k_{c}")) for c in keys]), how)


def _append_changes(reg: Registry, side: str, ns: str, table: str, rows: DataFrame,
                    op: str = UPSERT) -> None:
    stamp = reg.stamp()
    with_meta(rows, stamp, reg.next_version(), op).write.mode("append").parquet(
        reg.epoch_path(side, ns, table))


def _record_pending(reg: Registry, side: str, ns: str, table: str, keys: Sequence[str],
                    compact_every: int) -> int | None:
    entries = [(pending_key(side, ns, table), CONTROL_SET, str(reg.pending(side, ns, table) + 1))]
    if reg.table_keys(side, ns, table) is None:
        entries.append((keys_key(side, ns, table), CONTROL_SET, json.dumps(list(keys))))
    reg.append_control(entries)
    if reg.pending(side, ns, table) >= compact_every:
        return reg.compact_table(side, ns, table)
    return reg.current_version(side, ns, table)


def load(reg: Registry, side: str, table: str, rows: DataFrame, keys: Sequence[str],
         ns: str | None = None, compact_every: int = COMPACT_EVERY) -> int | None:
    """Upsert ``rows`` into the side's default-routed namespace (or ``ns``).

    Merge on read: the touched rows as they now are (whole columns; a load may
    give only some) are appended to the table's change log, and nothing is
    rewritten. ``rows`` are evaluated once, into a staged file that every later step
    reads; one semi join against its keys finds the touched rows. Every ``compact_every`` loads the
    pending changes are folded into a new version. A table without a version
    yet (new, or mounted) gets its first version written instead.

    Write-ahead: the change rows are written before the control state counts
    them, so a crash leaves at most a change the table does not show yet, and
    retrying the (idempotent) load makes both agree. Returns the version.
    """
    side = canon_side(side)
    ns = ns or resolve_default(reg, side)
    keys = _checked_keys(reg, side, ns, table, keys)
    with scratch_scope(reg.spark):
        rows = staged(rows, "load")
        if not rows.groupBy(*keys).count().filter("count > 1").isEmpty():
            raise ValueError(f"rows for {side}/{ns}/{table} repeat a key")
        if reg.current_version(side, ns, table) is None:
            new = rows
            if reg.exists(side, ns, table):
                new = upsert(reg.read(side, ns, table), rows, keys, stage=False)
            # The touched rows, then the version that they come from, are read from one plan.
            _append_changes(reg, side, ns, table, _touched(new, rows, keys, "left_semi") if new is not rows else rows)
            return reg.write_version(side, ns, table, new, n_rows=rows.count(), keys=keys if new is rows else None,
                                     extra=[(keys_key(side, ns, table), CONTROL_SET, json.dumps(list(keys)))])
        current = staged(_touched(reg.read(side, ns, table), rows, keys, "left_semi"), "touched")
        _append_changes(reg, side, ns, table, upsert(current, rows, keys, stage=False))
        return _record_pending(reg, side, ns, table, keys, compact_every)


def remove(reg: Registry, side: str, table: str, key_rows: DataFrame, keys: Sequence[str],
           ns: str | None = None, compact_every: int = COMPACT_EVERY) -> int | None:
    """Delete the keys in ``key_rows`` from the side's default-routed namespace
    (or ``ns``): delete change rows (the old rows, marked) are appended ahead,
    as in :func:`load`; nothing is rewritten. Returns the version."""
    side = canon_side(side)
    ns = ns or resolve_default(reg, side)
    keys = _checked_keys(reg, side, ns, table, keys)
    with scratch_scope(reg.spark):
        gone = staged(key_rows.select(*keys).distinct(), "remove")
        current = reg.read(side, ns, table)
        _append_changes(reg, side, ns, table, _touched(current, gone, keys, "left_semi"), DELETE)
        if reg.current_version(side, ns, table) is None:
            return reg.write_version(side, ns, table, _touched(current, gone, keys, "left_anti"),
                                     extra=[(keys_key(side, ns, table), CONTROL_SET, json.dumps(list(keys)))])
        return _record_pending(reg, side, ns, table, keys, compact_every)


@dataclass
class ReplicaInfo:
    source_side: str
    source_ns: str
    base_version: int
    run: int
    as_of: str
    through_batch: int = -1  # applied batches up to this id are in the base
    base_frontier: str = ""  # newest change in the base ("" = as_of)
    keys: str = ""  # the table's key columns, a JSON list
    base_path: str = ""  # a stored table version as the base (restart)
    base_ts: str = ""  # the change time that version holds

    def encode(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def decode(cls, s: str) -> ReplicaInfo:
        return cls(**json.loads(s))


def _info_key(side: str, ns: str, table: str) -> str:
    return f"replica/{side}/{ns}/{table}"


def replica_info(reg: Registry, side: str, ns: str, table: str) -> ReplicaInfo | None:
    v = reg.state().get(_info_key(side, ns, table))
    return None if v is None else ReplicaInfo.decode(v)


def _flags(source: str, target: str, event: str) -> list[tuple[str, str, str]]:
    atob = source == SIDE_A and target == SIDE_B
    if event == "start":
        vals = {REPL_ATOB_ACTIVE: "1" if atob else "0", REPL_BTOA_ACTIVE: "0" if atob else "1",
                FAILOVER_ATOB_DONE: "0", FAILOVER_BTOA_DONE: "0"}
    elif event == "failover":
        vals = ({FAILOVER_ATOB_DONE: "1", REPL_ATOB_ACTIVE: "0"} if atob
                else {FAILOVER_BTOA_DONE: "1", REPL_BTOA_ACTIVE: "0"})
    else:  # restart
        vals = ({REPL_ATOB_ACTIVE: "1", REPL_BTOA_ACTIVE: "0"} if atob
                else {REPL_BTOA_ACTIVE: "1", REPL_ATOB_ACTIVE: "0"})
    return [(k, "set", v) for k, v in vals.items()]


class Replication:
    """Replication of one table from ``source_side`` into ``target_side``."""

    def __init__(self, reg: Registry, source_side: str, target_side: str, table: str,
                 keys: Sequence[str]):
        self.reg = reg
        self.spark = reg.spark
        self.source = canon_side(source_side)
        self.target = canon_side(target_side)
        self.table = table
        self.keys = list(keys)
        self.source_ns = MAIN_NAMESPACE[self.source]
        self.target_ns = MAIN_NAMESPACE[self.target]
        self.readonly_ns = self.target_ns + READONLY_SUFFIX
        self.spec: ChangeSpec = registry_spec(self.keys)
        #: The stream last started here, and whether a drain was cut short.
        self.query: StreamingQuery | None = None
        self.heartbeat: Heartbeat | None = None
        self._cut_short = False

    # -------------------------------------------------------------- paths
    @property
    def root(self) -> str:
        return replica_dir(self.reg, self.target, self.target_ns, self.table)

    def info(self) -> ReplicaInfo | None:
        return replica_info(self.reg, self.target, self.target_ns, self.table)

    def _schema(self) -> StructType:
        return self.reg.schema(self.source, self.source_ns, self.table)

    def base(self, info: ReplicaInfo) -> DataFrame:
        if info.base_path:
            return with_meta(rows_of(self.spark, info.base_path), info.base_ts, -1)
        return read_table(self.spark, f"{self.root}/base/v={info.base_version}")

    def applied_dir(self, info: ReplicaInfo) -> str:
        return f"{self.root}/applied/run={info.run}"

    def applied(self, info: ReplicaInfo) -> DataFrame:
        """Applied batches not yet compacted into the base."""
        return read_batches(self.spark, self.applied_dir(info), change_schema(self._schema()),
                            after_batch=info.through_batch)

    def compact(self) -> ReplicaInfo:
        """Fold the applied batches into the next base (tombstones kept) and
        move the batch watermark, so reads of the view stay bounded.

        Safe while the stream runs: it only adds batches above the watermark.
        """
        info = self.info()
        last = last_batch(self.spark, self.applied_dir(info))
        if last is None or last <= info.through_batch:
            return info
        nv = self.reg.next_version()
        batches = self._batches_upto(info, last)
        newest = batches.agg(F.max("_ts").alias("m")).first()["m"]
        merged = merge_changes(self.base(info), batches, self.spec, keep_deletes=True)
        merged.write.mode("overwrite").parquet(f"{self.root}/base/v={nv}")
        frontier = max(filter(None, [newest, parse_ts(info.base_frontier or info.as_of)]))
        new = ReplicaInfo(info.source_side, info.source_ns, nv, info.run, info.as_of, last,
                          frontier.strftime(TS_FORMAT), info.keys)
        self.reg.set_state(_info_key(self.target, self.target_ns, self.table), new.encode())
        return new

    def _batches_upto(self, info: ReplicaInfo, last: int) -> DataFrame:
        df = self.spark.read.parquet(self.applied_dir(info))
        return df.filter((F.col("batch") > info.through_batch) & (F.col("batch") <= last)).drop(
            "batch")

    def view(self, as_of=None) -> DataFrame:
        """The read-only replica (O26) as of now or ``as_of``; a time before the base's
        newest change (the initial copy, and any compaction) cannot be served."""
        base, applied = self._parts(as_of)
        return readonly_view(base, applied, self.spec)

    def count(self, as_of=None) -> DataFrame:
        """``(n_rows)`` of :meth:`view`."""
        base, applied = self._parts(as_of)
        return count_merged(base, applied, self.spec)

    def _parts(self, as_of) -> tuple[DataFrame, DataFrame]:
        """The replica's base and the changes applied to it up to ``as_of``."""
        info = self.info()
        if as_of is not None:
            frontier = parse_ts(info.base_frontier or info.as_of)
            wanted = as_of if isinstance(as_of, dt.datetime) else dt.datetime.fromisoformat(str(as_of))
            if wanted < frontier:
                raise ValueError(f"the replica base is at {frontier}, later than {wanted}")
        return self.base(info), upto(self.applied(info), self.spec, as_of)

    def _mount_view(self) -> None:
        self.reg.mount(self.target, self.readonly_ns, self.table, ReplicaView(self))

    # ---------------------------------------------------------- streaming
    def _ensure_changes(self) -> str:
        """The source's change log, made to exist once (a file stream needs a folder)."""
        path = changes_dir(self.reg, self.source, self.source_ns, self.table)
        schema = change_schema(self._schema())
        try:
            self.spark.read.schema(schema).parquet(path)
        except AnalysisException as err:
            if not is_path_not_found(err):
                raise
            self.spark.createDataFrame([], schema).write.mode("append").parquet(
                self.reg.epoch_path(self.source, self.source_ns, self.table))
        return path

    def _stream(self, info: ReplicaInfo, trigger: dict, files: int | None = None) -> StreamingQuery:
        # One stream a checkpoint: a running one ends before the next starts.
        self.stop()
        src = self._ensure_changes()
        self._cut_short = False
        name = f"replicate-{uuid.uuid4().hex[:12]}"
        self.heartbeat = Heartbeat(self.reg, self.stream_key, name, ends="availableNow" not in trigger)
        self.query = replicate_stream(
            self.spark, src, change_schema(self._schema()),
            out=f"{self.root}/applied/run={info.run}",
            ckpt=f"{self.root}/ckpt/run={info.run}",
            trigger=trigger, max_files_per_trigger=files, max_bytes_per_trigger=BYTES_PER_BATCH, after=info.as_of, ts_col="_ts", query_name=name)
        return self.query

    @property
    def stream_key(self) -> str:
        return stream_key(self.target, self.target_ns, self.table)

    def _record_end(self, word: str) -> None:
        if self.heartbeat is not None:
            self.heartbeat.close(self.query, word)
            self.heartbeat = None

    def run_stream(self, info: ReplicaInfo, timeout_s: float | None = None,
                   files: int | None = None) -> bool:
        """Apply every change file present now (``availableNow``) (O27), ``BYTES_PER_BATCH`` (or
        ``files`` files) a batch; a running stream of this replication ends first. Batches are stored as they
        came: a later view at a point in time needs the rows before it. ``False`` if time
        ran out; finished batches stay, and the next call goes on after them."""
        try:
            done = drain(self._stream(info, {"availableNow": True}, files), timeout_s)
        except Exception:
            self._record_end("error")
            raise
        self._cut_short = not done
        self._record_end(self._stream_state())
        return done

    def run_continuously(self, info: ReplicaInfo, every: str,
                         files: int | None = None) -> StreamingQuery:
        """Keep applying change files as they arrive, until :meth:`stop`, a drain or the
        cutover (O27)."""
        return self._stream(info, {"processingTime": every}, files)

    def stop(self) -> None:
        """End the running stream, if any; what it had not finished is applied by the next."""
        if self.query is not None and self.query.isActive:
            self.query.stop()
        self._record_end("stopped")

    def _stream_state(self) -> str:
        """The word for this object's stream. A drain that ended well has applied all it saw, so the
        replica counts as being fed, for others while the drain's record is fresh; without a
        stream here, what its feeder last recorded."""
        if self.query is None:
            return recorded_word(self.reg, self.stream_key)
        word = stream_word(self.query)
        return word if word != "stopped" else "paused" if self._cut_short else "replicating"

    # --------------------------------------------------------------- gate
    def status(self, info: ReplicaInfo, cut_over: bool = False, upto=None) -> DataFrame:
        """Live replication status (O28). The base's frontier is known from the
        bookkeeping (start time or last compaction), so the base is not read;
        ``applied_rows`` counts change rows applied since the base. Lag is
        measured against the source's changes after the start (pushed-down
        filter), up to ``upto`` where given. The status word follows the stream's
        progress; ``data_state`` is ``ready`` once no such change is newer than
        the frontier, else ``add``."""
        after = ts_lit(info.as_of)
        applied = self.applied(info).select("_ts")
        source = (self.spark.read.schema(change_schema(self._schema()))
                  .parquet(changes_dir(self.reg, self.source, self.source_ns, self.table))
                  .filter(F.col("_ts") > after).select("_ts"))
        if upto is not None:
            source = source.filter(F.col("_ts") <= ts_lit(upto))
        return replication_status(applied, source, "_ts", self.target_ns,
                                 f"{self.source}->{self.target}", cut_over=cut_over,
                                 base_frontier=info.base_frontier or info.as_of,
                                 stream_state=self._stream_state(), by_lag=True)

    def poll(self, info: ReplicaInfo, try_no: int, upto=None) -> DataFrame:
        """One poll row from the live status in the gate's shape."""
        return self.status(info, upto=upto).select(
            F.col("replica"),
            F.lit(try_no).cast("bigint").alias("try_no"),
            F.concat(F.lit("status "), F.col("status")).alias("status_text"),
            F.coalesce(F.col("data_state"), F.lit("")).alias("data_state_text"))

    def _gate(self, info: ReplicaInfo, max_tries: int, restart: bool = False,
              interval_s: float = POLL_INTERVAL_S) -> None:
        """Poll until ``replicating`` AND ``ready`` (O33), at most ``max_tries``
        times, ``interval_s`` apart; a timeout is an error. Changes that come
        after the gate's start do not hold it up."""
        upto = self.reg.stamp()
        vocab = ({"status_vocab": RESTART_STATUS_VOCAB, "state_vocab": RESTART_STATE_VOCAB}
                 if restart else {"status_vocab": START_STATUS_VOCAB,
                                  "state_vocab": START_STATE_VOCAB})
        seen: list[tuple] = []
        for i in range(1, max_tries + 1):
            row = self.poll(info, i, upto)
            seen.append(tuple(row.first()))  # one row a try; earlier ones are not asked again
            polls = self.spark.createDataFrame(seen, row.schema)
            verdict = ready_gate(polls, max_tries=max_tries, **vocab).first()
            if verdict["verdict"] == "ready":
                return
            if i < max_tries:
                time.sleep(interval_s)
        raise ReplicationTimeout(
            f"{self.target_ns} did not reach 'replicating' and 'ready' in {max_tries} tries")

    # ------------------------------------------------------------- flows
    def start(self, max_tries: int = MAX_ITERS, set_pointers: bool = False,
              every: str | None = None, interval_s: float = POLL_INTERVAL_S) -> ReplicaInfo:
        """Initial copy (O24) into the replica base, stream changes after it,
        mount the read-only view, wait for the gate, set the flags.

        With ``every`` (as ``'5 seconds'``) a stream goes on applying changes until
        the cutover or :meth:`stop`; else the changes present are drained."""
        as_of = self.reg.stamp()
        src = self.reg.read(self.source, self.source_ns, self.table)
        # Base and run ids are never reused, so an old checkpoint never resumes.
        info = ReplicaInfo(self.source, self.source_ns, self.reg.next_version(),
                           self.reg.next_version(), as_of.strftime(TS_FORMAT),
                           keys=json.dumps(self.keys))
        with_meta(src, as_of, 0).write.mode("overwrite").parquet(
            f"{self.root}/base/v={info.base_version}")
        return self._activate(info, max_tries, "start", set_pointers, every, interval_s)

    def _activate(self, info: ReplicaInfo, max_tries: int, event: str,
                  set_pointers: bool, every: str | None, interval_s: float) -> ReplicaInfo:
        self.reg.append_control([
            (_info_key(self.target, self.target_ns, self.table), "set", info.encode()),
            (f"mode/{self.target}/{self.readonly_ns}", "set", "shared"),
            (f"data_state/{self.target}/{self.readonly_ns}", "set", "add"),
            (f"data_state/{self.target}/{self.target_ns}", "set", "replicating"),
            (f"mode/{self.target}/{self.target_ns}", "set", "none"),
        ])
        self._mount_view()
        if every is None:
            self.run_stream(info)
        else:
            self.run_continuously(info, every)
        try:
            self._gate(info, max_tries, restart=event == "restart", interval_s=interval_s)
        except ReplicationTimeout:
            self.stop()
            raise
        entries = [(f"data_state/{self.target}/{self.readonly_ns}", "set", "ready"),
                   *_flags(self.source, self.target, event)]
        if set_pointers:
            entries += [(f"default/{self.source}", "set", self.source_ns),
                        (f"default/{self.target}", "set", self.readonly_ns)]
        self.reg.append_control(entries)
        return info

    def cutover(self, to: str | dt.datetime = "latest", on_timeout: str = "fail",
                timeout_s: float | None = READY_MAX_ITERS * READY_POLL_INTERVAL_S) -> int:
        """Complete replication, stop, open the replica for service and point
        the target side at it (O30).

        Drains every change present (``availableNow``) within ``timeout_s``;
        on timeout ``on_timeout='fail'`` raises, ``'continue'`` goes on as the
        reference tool does. ``to`` is ``'latest'`` or a point in time no
        earlier than the replica base (its start, or its last compaction). The
        view at that point is written as the target namespace's new version.

        The whole table is written while the source may still be written to. With
        ``'latest'`` a second drain (again ``timeout_s`` at most) then applies what has come since, and
        only that is written before the pointers move: as pending changes of the new version, so
        the time without writes does not grow with the table.
        """
        info = self.info()
        if info is None:
            raise RuntimeError(f"no replication into {self.target}/{self.target_ns}")
        at = (self.target, self.target_ns, self.table)
        with scratch_scope(self.spark):
            self._drain(info, timeout_s, on_timeout)
            folded, n_rows = self.reg.pending(*at), self.base(info).count()
            if to != "latest":
                version = self.reg.stage_version(*at, self.view(to), n_rows, self.keys)
                return self._open_target(version, folded, [], None)
            last = last_batch(self.spark, self.applied_dir(info))
            if last is not None and self._cut_short:  # that batch may be unfinished; the next drain writes it again
                last = max(last - 1, info.through_batch)
            seen = self.spark.createDataFrame([], change_schema(self._schema())) if last is None \
                else self._batches_upto(info, last)
            version = self.reg.stage_version(*at, readonly_view(self.base(info), seen, self.spec), n_rows, self.keys)
            self._drain(info, timeout_s, on_timeout)
            through = info.through_batch if last is None else last
            tail = read_batches(self.spark, self.applied_dir(info), change_schema(self._schema()), through)
            if tail.isEmpty():
                return self._open_target(version, folded, [], None)
            newest = seen.agg(F.max("_ts").alias("m")).first()["m"]
            frontier = max(filter(None, [newest, parse_ts(info.base_frontier or info.as_of)]))
            if not tail.filter(F.col("_ts") <= ts_lit(frontier)).isEmpty():
                # A change older than what the version holds came late: only a merge by time is right.
                version = self.reg.stage_version(*at, self.view(), n_rows, self.keys)
                return self._open_target(version, folded, [], None)
            tail = apply_changes(tail, self.keys, self.spec.order, self.spec.op_col, keep_deletes=True)
            watermark, stamp = self.reg.stamp(), self.reg.stamp()
            tail.withColumn("_ts", ts_lit(stamp)).write.mode("append").parquet(self.reg.epoch_path(*at))
            return self._open_target(version, folded, [(pending_key(*at), CONTROL_SET, "1")],
                                     watermark.strftime(TS_FORMAT))

    def _drain(self, info: ReplicaInfo, timeout_s: float | None, on_timeout: str) -> None:
        if not self.run_stream(info, timeout_s) and on_timeout == "fail":
            raise ReplicationTimeout("replication did not complete in time")

    def _open_target(self, version: tuple[int, int], folded: int, extra: list[tuple[str, str, str | None]],
                     watermark: str | None) -> int:
        """One control append: new version, service open, replica retired, flags and default
        pointers (O3) switch together."""
        pointers = [(f"default/{self.target}", CONTROL_SET, self.target_ns)]
        if self.target == SIDE_A:
            pointers.append((f"default/{SIDE_B}", CONTROL_SET, MAIN_NAMESPACE[SIDE_B]))
        v = self.reg.publish_version(self.target, self.target_ns, self.table, version, folded, watermark, [
            *extra,
            (f"mode/{self.target}/{self.target_ns}", "set", "shared"),
            (f"data_state/{self.target}/{self.target_ns}", "set", "ready"),
            (f"data_state/{self.target}/{self.readonly_ns}", "set", "offline"),
            (_info_key(self.target, self.target_ns, self.table), "del", None),
            (keys_key(self.target, self.target_ns, self.table), CONTROL_SET, json.dumps(self.keys)),
            *_flags(self.source, self.target, "failover"),
            *pointers,
        ])
        self.reg.unmount(self.target, self.readonly_ns, self.table)
        write_record(self.reg, self.stream_key, "stopped", time.time())
        return v

    def restart(self, dry_run: bool = False, max_tries: int = MAX_ITERS, every: str | None = None,
                interval_s: float = POLL_INTERVAL_S) -> DataFrame | ReplicaInfo:
        """The failed-back side becomes a replica again, keeping its data.

        Stop its service, diff it against the new source (O22), write the
        difference as change rows over the version it stores (nothing else is
        written; a mounted table, or one that repeats a key, is copied once), resume
        the stream after that point (``every`` as in :meth:`start`), reset the
        pointers. ``dry_run`` writes nothing and returns the planned
        ``(action, n_rows)``.
        """
        as_of = self.reg.stamp()
        with scratch_scope(self.spark):
            return self._restart(self._difference(), as_of, dry_run, max_tries, every, interval_s)

    def _difference(self) -> DataFrame:
        """What the target side lacks (O22). Where both sides store their versions by key bucket,
        only buckets whose digests differ, or that a pending change touches, are read."""
        a, b = (self.source, self.source_ns, self.table), (self.target, self.target_ns, self.table)
        loaded = all(self.reg.table_keys(*x) == self.keys for x in (a, b))  # loads refuse repeated keys
        stored = [self.reg.keyed(*x) for x in (a, b)]
        if not loaded or None in stored:
            return resync_diff(self.reg.read(*a), self.reg.read(*b), self.keys, unique=loaded)
        depth = min(t.depth for t in stored)
        nodes = set(changed_nodes(self.spark, *stored))
        for x in (a, b):
            if self.reg.pending(*x):
                schema = rows_of(self.spark, self.reg.keyed(*x).path).schema
                nodes |= buckets_of(self.reg.pending_changes(*x, schema), self.keys, depth)
        return resync_diff(*[self.reg.read_nodes(*x, depth, sorted(nodes)) for x in (a, b)], self.keys, unique=True)

    def _restart(self, diff: DataFrame, as_of: dt.datetime, dry_run: bool, max_tries: int, every: str | None,
                 interval_s: float) -> DataFrame | ReplicaInfo:
        if dry_run:
            counts = diff_summary(diff).collect()
            return self.spark.createDataFrame([tuple(r) for r in counts], "action string, n_rows bigint")
        at = (self.target, self.target_ns, self.table)
        schema = self.reg.schema(*at)
        self.reg.set_mode(self.target, self.target_ns, "none")
        nv = self.reg.next_version()
        info = ReplicaInfo(self.source, self.source_ns, nv, self.reg.next_version(),
                           as_of.strftime(TS_FORMAT), through_batch=BEFORE_RESTART,
                           keys=json.dumps(self.keys))
        op = F.when(F.col("action") == DELETE, DELETE).otherwise(UPSERT)
        batch = batch_path(self.applied_dir(info), DIFF_BATCH)
        with_meta(diff.select(*schema.fieldNames(), "action"), as_of, 1).withColumn("_op", op).drop(
            "action").write.mode("overwrite").parquet(batch)
        version = self.reg.current_version(*at)
        if version is None or not (self.reg.table_keys(*at) == self.keys
                                   or check_unique(self.reg.read(*at), self.keys).isEmpty()):
            # No version to stand on: one copy, without the keys that the difference rewrites.
            kept = _touched(self.reg.read(*at), self.spark.read.parquet(batch), self.keys, "left_anti")
            with_meta(kept, as_of, 0).write.mode("overwrite").parquet(f"{self.root}/base/v={nv}")
        else:
            info.base_path = f"{self.reg.table_dir(*at)}/v={version}"
            info.base_ts = self.reg.state()[watermark_key(*at)]
            if self.reg.pending(*at):
                self.reg.pending_changes(*at, schema).write.mode("overwrite").parquet(
                    batch_path(self.applied_dir(info), PENDING_BATCH))
        return self._activate(info, max_tries, "restart", True, every, interval_s)


@dataclass(frozen=True)
class ReplicaView:
    """A replica's view, built on every read, and its count."""

    replication: Replication

    def __call__(self, as_of=None) -> DataFrame:
        return self.replication.view(as_of)

    def count(self, as_of=None) -> DataFrame:
        return self.replication.count(as_of)


def archive_changes(reg: Registry, side: str, table: str, ns: str | None = None) -> list[int]:
    """Move a table's old change folders out of what its replicas' streams list (O27); the epochs
    moved. An epoch goes once the table's version holds it and every replica fed from the table has
    a frontier past its newest change; without replicas the version alone decides."""
    side = canon_side(side)
    ns = ns or resolve_default(reg, side)
    version, path = reg.current_version(side, ns, table), reg.changes_path(side, ns, table)
    frontier = None
    for key, value in reg.state().items():
        info = ReplicaInfo.decode(value) if key.startswith("replica/") and key.endswith(f"/{table}") else None
        if info and (info.source_side, info.source_ns) == (side, ns):
            rep = Replication(reg, side, key.split("/")[1], table, json.loads(info.keys or "[]"))
            newest = rep.applied(info).agg(F.max("_ts").alias("m")).first()["m"]
            reached = max(filter(None, [newest, parse_ts(info.base_frontier or info.as_of)]))
            frontier = reached if frontier is None else min(frontier, reached)
    epochs = reg.spark.read.parquet(path)
    if version is None or "epoch" not in epochs.columns:
        return []
    # Reads of the table still list the epoch before the current one.
    old = epochs.filter(F.col("epoch") < version - 1).groupBy("epoch").agg(F.max("_ts").alias("m")).collect()
    done = sorted(r["epoch"] for r in old if frontier is None or r["m"] is None or r["m"] <= frontier)
    for epoch in done:
        move_path(reg.spark, f"{path}/epoch={epoch}", f"{reg.root}/archive/{side}/{ns}/{table}/epoch={epoch}")
    return done


def start_replication(reg: Registry, source_side: str, target_side: str, table: str,
                      keys: Sequence[str]) -> Replication:
    """Start replicating and set the pointers the reference tool sets."""
    rep = Replication(reg, source_side, target_side, table, keys)
    rep.start()
    if rep.target == SIDE_A:
        # Start B->A: B serves vb, A serves the read-only mirror.
        swap_default(reg, SIDE_B, MAIN_NAMESPACE[SIDE_B])
        swap_default(reg, SIDE_A, MAIN_NAMESPACE[SIDE_A] + READONLY_SUFFIX)
    return rep


def restart_replication(reg: Registry, source_side: str, replica_side: str, table: str,
                        keys: Sequence[str], dry_run: bool = False):
    """O29 as a function: see :meth:`Replication.restart`."""
    return Replication(reg, source_side, replica_side, table, keys).restart(dry_run=dry_run)


def cutover(reg: Registry, source_side: str, replica_side: str, table: str, keys: Sequence[str],
            to="latest", on_timeout: str = "fail",
            timeout_s: float | None = READY_MAX_ITERS * READY_POLL_INTERVAL_S) -> int:
    """O30 as a function: see :meth:`Replication.cutover`."""
    return Replication(reg, source_side, replica_side, table, keys).cutover(
        to=to, on_timeout=on_timeout, timeout_s=timeout_s)
