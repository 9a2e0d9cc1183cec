"""Sides, namespaces, tables and the control log.

A :class:`Registry` is a small driver-side map from ``(side, namespace,
table)`` to data plus one append-only control log on the shared file system:

``{root}/data/{side}/{namespace}/{table}/v={n}/``  table versions (Parquet; large ones by key bucket)
``{root}/digests/{side}/{namespace}/{table}/v={n}/`` digests of a version's key buckets
``{root}/changes/{side}/{namespace}/{table}/``      change rows (merge on read)
``{root}/control/``                                 control log (Parquet)

Writers never overwrite a version that may be read: they write ``v=n+1`` and
then append a pointer row to the control log. The control log is folded by
:func:`replicakit.operators.fold.control_state` (a Spark aggregation); only the
folded state — a few rows per table and namespace — reaches the driver.

Tables can also be *mounted*: a path or a DataFrame (for example a given
Parquet table) bound to a name, read-only until a version is written over it.

One driver writes a registry at a time (the tool being replaced is also run
from one place); other drivers may read it and call :meth:`Registry.refresh`.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from replicakit.constants import MAIN_NAMESPACE, READONLY_SUFFIX
from replicakit.functions.text import canon_side, map_namespace
from replicakit.operators.diff import key_bucket
from replicakit.operators.fold import CONTROL_DEL, CONTROL_SET, control_state
from replicakit.operators.keyed import BUCKET_ROWS, KeyedTable, depth_for, rows_in, rows_of, store_keyed
from replicakit.sources.tables import read_table

CONTROL_SCHEMA = StructType([
    StructField("version", LongType(), False),
    StructField("key", StringType(), False),
    StructField("op", StringType(), False),
    StructField("value", StringType(), True),
])

POINTER_SCHEMA = StructType([
    StructField("side", StringType(), False),
    StructField("target_namespace", StringType(), True),
    StructField("version", LongType(), False),
])


def default_key(side: str) -> str:
    return f"default/{side}"


def table_key(side: str, ns: str, table: str) -> str:
    return f"table/{side}/{ns}/{table}"


def mode_key(side: str, ns: str) -> str:
    return f"mode/{side}/{ns}"


def data_state_key(side: str, ns: str) -> str:
    return f"data_state/{side}/{ns}"


def keys_key(side: str, ns: str, table: str) -> str:
    return f"keys/{side}/{ns}/{table}"


def watermark_key(side: str, ns: str, table: str) -> str:
    return f"watermark/{side}/{ns}/{table}"


def pending_key(side: str, ns: str, table: str) -> str:
    return f"pending/{side}/{ns}/{table}"


def depth_key(side: str, ns: str, table: str) -> str:
    return f"depth/{side}/{ns}/{table}"


def _as_datetime(t):
    return t if isinstance(t, dt.datetime) else dt.datetime.fromisoformat(str(t))


def is_path_not_found(err: BaseException) -> bool:
    return isinstance(err, AnalysisException) and err.getCondition() == "PATH_NOT_FOUND"


class Registry:
    """Where each side's namespaces and tables live, and their control state."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._mounts: dict[tuple[str, str, str], DataFrame | str | Callable[[], DataFrame]] = {}
        self._state: dict[str, str] | None = None
        self._last_version = 0
        self._last_stamp = 0
        #: Rows of a key bucket, about: a version with more is stored by key bucket.
        self.bucket_rows = BUCKET_ROWS
        self.state()

    # ------------------------------------------------------------ control log
    @property
    def control_path(self) -> str:
        return f"{self.root}/control"

    def next_version(self) -> int:
        self._last_version = max(time.time_ns(), self._last_version + 1)
        return self._last_version

    def stamp(self) -> dt.datetime:
        """A change time after every version, change and watermark that this registry's
        control state knows of, also where the driver's clock lags behind theirs."""
        micros = max(self.next_version() // 1000, self._last_stamp) + 1
        self._last_stamp = micros
        self._last_version = max(self._last_version, micros * 1000)
        return dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=micros)

    def append_control(self, entries: Iterable[tuple[str, str, str | None]]) -> None:
        """Append ``(key, op, value)`` rows, newest version last, in one file."""
        rows = [(self.next_version(), k, op, v) for k, op, v in entries]
        if not rows:
            return
        self.spark.createDataFrame(rows, CONTROL_SCHEMA).coalesce(1).write.mode(
            "append").parquet(self.control_path)
        state = self.state()
        for _, k, op, v in rows:
            if op == CONTROL_DEL:
                state.pop(k, None)
            else:
                state[k] = v

    def import_control(self, log: DataFrame) -> None:
        """Append a whole ``(version, key, op, value)`` history (a Spark write)."""
        log.select(*CONTROL_SCHEMA.fieldNames()).write.mode("append").parquet(self.control_path)
        self._state = None

    def set_state(self, key: str, value: str) -> None:
        self.append_control([(key, CONTROL_SET, value)])

    def del_state(self, key: str) -> None:
        self.append_control([(key, CONTROL_DEL, None)])

    def control_log(self) -> DataFrame:
        try:
            return self.spark.read.schema(CONTROL_SCHEMA).parquet(self.control_path)
        except AnalysisException as err:
            if is_path_not_found(err):
                return self.spark.createDataFrame([], CONTROL_SCHEMA)
            raise

    def refresh(self) -> None:
        """Forget the cached state; the next lookup folds the control log again."""
        self._state = None

    def state(self) -> dict[str, str]:
        """Folded control state (small: one row per key)."""
        if self._state is None:
            try:
                log = self.spark.read.schema(CONTROL_SCHEMA).parquet(self.control_path)
            except AnalysisException as err:
                if not is_path_not_found(err):
                    raise
                self._state = {}  # nothing written yet: no job to run
                return self._state
            rows = control_state(log).collect()
            self._state = {r["key"]: r["value"] for r in rows}
            if rows:
                self._last_version = max(self._last_version, max(r["version"] for r in rows))
        return self._state

    # ------------------------------------------------------------------ tables
    def mount(self, side: str, ns: str, table: str,
              source: DataFrame | str | Callable[[], DataFrame]) -> None:
        """Bind a path, a DataFrame or a view builder (called on every read)."""
        self._mounts[(canon_side(side), map_namespace(ns), table)] = source

    def unmount(self, side: str, ns: str, table: str) -> None:
        self._mounts.pop((canon_side(side), map_namespace(ns), table), None)

    def table_dir(self, side: str, ns: str, table: str) -> str:
        return f"{self.root}/data/{side}/{ns}/{table}"

    def current_version(self, side: str, ns: str, table: str) -> int | None:
        v = self.state().get(table_key(canon_side(side), map_namespace(ns), table))
        return None if v is None else int(v)

    def changes_path(self, side: str, ns: str, table: str) -> str:
        """The table's change log (written ahead by loads; read by replication).

        Rows are filed under ``epoch=<v>``, the table version they follow, so a
        read lists only the current epoch's folder however long the history.
        """
        return f"{self.root}/changes/{side}/{ns}/{table}"

    def epoch_path(self, side: str, ns: str, table: str) -> str:
        """Folder for change rows written now (they follow the current version)."""
        side, ns = canon_side(side), map_namespace(ns)
        v = self.current_version(side, ns, table) or 0
        return f"{self.changes_path(side, ns, table)}/epoch={v}"

    def table_keys(self, side: str, ns: str, table: str) -> list[str] | None:
        v = self.state().get(keys_key(canon_side(side), map_namespace(ns), table))
        return json.loads(v) if v else None

    def pending(self, side: str, ns: str, table: str) -> int:
        """Loads appended since the table's current version."""
        return int(self.state().get(pending_key(canon_side(side), map_namespace(ns), table), "0"))

    def pending_changes(self, side: str, ns: str, table: str, schema: StructType) -> DataFrame:
        """Change rows newer than the current version's watermark (the filter
        reaches the Parquet scan)."""
        from replicakit.sources.changes import change_schema, ts_lit

        wm = self.state()[watermark_key(side, ns, table)]
        cs = change_schema(schema)
        v = self.current_version(side, ns, table) or 0
        parts = []
        # A change appended while this version was being written has the epoch before it.
        for epoch in (v - 1, v):
            try:
                part = (self.spark.read.schema(cs)
                        .option("basePath", self.changes_path(side, ns, table))
                        .parquet(f"{self.changes_path(side, ns, table)}/epoch={epoch}"))
            except AnalysisException as err:
                if not is_path_not_found(err):
                    raise
                continue
            parts.append(part.select(*cs.fieldNames()))
        if not parts:
            return self.spark.createDataFrame([], cs)
        return reduce(DataFrame.unionByName, parts).filter(F.col("_ts") > ts_lit(wm))

    def schema(self, side: str, ns: str, table: str) -> StructType:
        """Columns of a table; those of a written version, whatever changes are pending."""
        side, ns = canon_side(side), map_namespace(ns)
        v = self.current_version(side, ns, table)
        if v is not None:
            return rows_of(self.spark, f"{self.table_dir(side, ns, table)}/v={v}").schema
        return self.read(side, ns, table).schema

    def read(self, side: str, ns: str, table: str, as_of=None) -> DataFrame:
        """Data of a table now, or as of a time; ``PATH_NOT_FOUND`` if it does
        not exist.

        A table is its current version plus the changes appended after it
        (merge on read). With no pending change it is the version itself;
        otherwise the changes (up to ``as_of``) are folded and merged by a
        size-checked broadcast, so the version is scanned, not shuffled.
        ``as_of`` earlier than the version's watermark cannot be served.
        Read-only replicas honour ``as_of`` too; mounted tables are static.
        """
        side, ns = canon_side(side), map_namespace(ns)
        if self.current_version(side, ns, table) is not None:
            base, changes = self._version_and_changes(side, ns, table, as_of)
            return base if changes is None else self._merged(side, ns, table, base, changes)
        src = self._bound(side, ns, table)
        if isinstance(src, DataFrame):
            return src
        if callable(src):
            return src() if as_of is None else src(as_of)
        if src:
            return read_table(self.spark, src)
        return self.spark.read.parquet(self.table_dir(side, ns, table))

    def count(self, side: str, ns: str, table: str, as_of=None) -> DataFrame:
        """``(n_rows)``: how many rows :meth:`read` gives. Where changes are merged, only keys
        and times of change are read, folded and joined."""
        from replicakit.plans.replica import count_merged, registry_spec
        from replicakit.plans.replication import ReplicaView
        from replicakit.sources.changes import with_meta

        side, ns = canon_side(side), map_namespace(ns)
        if self.current_version(side, ns, table) is not None:
            base, changes = self._version_and_changes(side, ns, table, as_of)
            if changes is not None:
                wm = self.state()[watermark_key(side, ns, table)]
                return count_merged(with_meta(base, wm, -1), changes, registry_spec(self.table_keys(side, ns, table)))
        else:
            view = self._bound(side, ns, table)
            if isinstance(view, ReplicaView):
                return view.count(as_of)
        return self.read(side, ns, table, as_of).agg(F.count(F.lit(1)).alias("n_rows"))

    def _version_and_changes(self, side: str, ns: str, table: str, as_of) -> tuple[DataFrame, DataFrame | None]:
        """The current version, which never changes, and the changes pending at ``as_of``."""
        from replicakit.sources.changes import parse_ts, ts_lit

        base = rows_of(self.spark, f"{self.table_dir(side, ns, table)}/v={self.current_version(side, ns, table)}")
        if as_of is not None:
            wm = parse_ts(self.state()[watermark_key(side, ns, table)])
            if _as_datetime(as_of) < wm:
                raise ValueError(f"{side}/{ns}/{table} is kept from {wm} on, not {as_of}")
        if self.pending(side, ns, table) == 0:
            return base, None
        changes = self.pending_changes(side, ns, table, base.schema)
        if as_of is not None:
            changes = changes.filter(F.col("_ts") <= ts_lit(_as_datetime(as_of)))
        return base, changes

    def _bound(self, side: str, ns: str, table: str):
        """What is mounted, or the read-only replica."""
        src = self._mounts.get((side, ns, table))
        if src is None and self._replica_of(side, ns, table) is not None:
            src = self._replica_view(side, ns, table)
        return src

    def _replica_of(self, side: str, ns: str, table: str) -> str | None:
        """Bookkeeping of a replication into ``ns`` (a ``-readonly`` namespace)."""
        if not ns.endswith(READONLY_SUFFIX):
            return None
        return self.state().get(f"replica/{side}/{ns[:-len(READONLY_SUFFIX)]}/{table}")

    def _replica_view(self, side: str, ns: str, table: str):
        """A read-only replica, rebuilt from the control state (so any driver
        reading this registry sees it, not only the one that started it)."""
        from replicakit.plans.replication import ReplicaInfo, ReplicaView, Replication

        info = ReplicaInfo.decode(self._replica_of(side, ns, table))
        keys = json.loads(info.keys) if info.keys else self.table_keys(info.source_side, info.source_ns, table)
        rep = Replication(self, info.source_side, side, table, keys)
        return ReplicaView(rep)

    def version_table(self, side: str, ns: str, table: str, v: int, depth: int) -> KeyedTable:
        return KeyedTable(f"{self.table_dir(side, ns, table)}/v={v}",
                          f"{self.root}/digests/{side}/{ns}/{table}/v={v}", depth)

    def keyed(self, side: str, ns: str, table: str) -> KeyedTable | None:
        """The current version, if it is stored by key bucket."""
        side, ns = canon_side(side), map_namespace(ns)
        v, depth = self.current_version(side, ns, table), self.state().get(depth_key(side, ns, table))
        return None if v is None or not depth else self.version_table(side, ns, table, v, int(depth))

    def read_nodes(self, side: str, ns: str, table: str, depth: int, nodes: list[int]) -> DataFrame:
        """:meth:`read`, of the rows below some digest nodes of a version stored by key bucket:
        of the version only those files are read, of the pending changes only those rows."""
        side, ns = canon_side(side), map_namespace(ns)
        base = rows_in(self.spark, self.keyed(side, ns, table), depth, nodes)
        if self.pending(side, ns, table) == 0:
            return base
        bucket = key_bucket(self.table_keys(side, ns, table), 1 << depth)
        changes = self.pending_changes(side, ns, table, base.schema).filter(bucket.isin(nodes))
        return self._merged(side, ns, table, base, changes)

    def exists(self, side: str, ns: str, table: str) -> bool:
        side, ns = canon_side(side), map_namespace(ns)
        return (self.current_version(side, ns, table) is not None
                or (side, ns, table) in self._mounts
                or self._replica_of(side, ns, table) is not None)

    def _merged(self, side: str, ns: str, table: str, base: DataFrame,
                changes: DataFrame | None = None) -> DataFrame:
        from replicakit.plans.replica import merge_changes, registry_spec
        from replicakit.sources.changes import TABLE_META, with_meta

        keys = self.table_keys(side, ns, table)
        if changes is None:
            changes = self.pending_changes(side, ns, table, base.schema)
        # Every pending change is newer than the version (it is past the watermark).
        wm = self.state()[watermark_key(side, ns, table)]
        merged = merge_changes(with_meta(base, wm, -1), changes, registry_spec(keys))
        return merged.select(*[c for c in merged.columns if c not in TABLE_META])

    def write_version(self, side: str, ns: str, table: str, df: DataFrame,
                      extra: Iterable[tuple[str, str, str | None]] = (),
                      watermark: str | None = None, held: int | None = None,
                      n_rows: int = 0, keys: Sequence[str] | None = None) -> int:
        """Write ``df`` as the next version, then swap the pointer to it.

        With ``n_rows`` (about how many rows come) and ``keys`` that are unique in ``df``, a version
        of more than ``bucket_rows`` is stored by key bucket with its digests.

        The new version goes to a folder nobody reads yet; a failed or retried
        write never touches the current one. The version holds every change up
        to ``watermark`` (default: now), so the pending count restarts at zero.
        ``extra`` control rows are appended together with the pointer; changes
        counted while the version was written stay pending.
        """
        folded = self.pending(side, ns, table) if held is None else held
        staged_version = self.stage_version(side, ns, table, df, n_rows, keys)
        return self.publish_version(side, ns, table, staged_version, folded, watermark, extra)

    def stage_version(self, side: str, ns: str, table: str, df: DataFrame, n_rows: int = 0,
                      keys: Sequence[str] | None = None) -> tuple[int, int]:
        """Write ``df`` as the next version, as :meth:`write_version` does, without the pointer; its
        number and depth of key buckets. Until it is published nobody reads it."""
        side, ns = canon_side(side), map_namespace(ns)
        v = (self.current_version(side, ns, table) or 0) + 1
        depth = depth_for(n_rows, self.bucket_rows) if keys else 0
        target = self.version_table(side, ns, table, v, depth)
        if depth:
            store_keyed(df, keys, target)
        else:
            df.write.mode("overwrite").parquet(target.path)
        return v, depth

    def publish_version(self, side: str, ns: str, table: str, version: tuple[int, int], folded: int,
                        watermark: str | None = None,
                        extra: Iterable[tuple[str, str, str | None]] = ()) -> int:
        """Swap the pointer to a staged version; ``folded`` pending loads are in it."""
        from replicakit.sources.changes import TS_FORMAT

        side, ns = canon_side(side), map_namespace(ns)
        v, depth = version
        was = self.state().get(depth_key(side, ns, table))
        self.append_control([
            (table_key(side, ns, table), CONTROL_SET, str(v)),
            *([(depth_key(side, ns, table), CONTROL_SET, str(depth))] if depth or was else []),
            (watermark_key(side, ns, table), CONTROL_SET, watermark or self.stamp().strftime(TS_FORMAT)),
            (pending_key(side, ns, table), CONTROL_SET, str(self.pending(side, ns, table) - folded)),
            *extra,
        ])
        return v

    def compact_table(self, side: str, ns: str, table: str) -> int | None:
        """Fold the pending changes into the next version (merge on read →
        copy once). The new watermark is the newest change actually folded, so
        a change appended meanwhile stays pending. Returns the version, or
        ``None`` when nothing was pending."""
        from replicakit.sources.changes import TS_FORMAT

        side, ns = canon_side(side), map_namespace(ns)
        v = self.current_version(side, ns, table)
        if v is None or self.pending(side, ns, table) == 0:
            return None
        base = rows_of(self.spark, f"{self.table_dir(side, ns, table)}/v={v}")
        held = self.pending(side, ns, table)
        changes = self.pending_changes(side, ns, table, base.schema)
        newest = changes.agg(F.max("_ts").alias("m")).first()["m"]
        if newest is None:
            return None
        merged = self._merged(side, ns, table, base, changes.filter(
            F.col("_ts") <= F.lit(newest.strftime(TS_FORMAT)).cast("timestamp_ntz")))
        return self.write_version(side, ns, table, merged, watermark=newest.strftime(TS_FORMAT), held=held,
                                  n_rows=base.count(), keys=self.table_keys(side, ns, table))

    def tables(self, side: str, ns: str) -> list[str]:
        side, ns = canon_side(side), map_namespace(ns)
        prefix = f"table/{side}/{ns}/"
        names = {k[len(prefix):] for k in self.state() if k.startswith(prefix)}
        names |= {t for (s, n, t) in self._mounts if s == side and n == ns}
        if ns.endswith(READONLY_SUFFIX):
            rprefix = f"replica/{side}/{ns[:-len(READONLY_SUFFIX)]}/"
            names |= {k[len(rprefix):] for k in self.state() if k.startswith(rprefix)}
        return sorted(names)

    def namespaces(self, side: str) -> list[str]:
        side = canon_side(side)
        found = {n for (s, n, _) in self._mounts if s == side}
        for k in self.state():
            parts = k.split("/")
            if parts[0] in ("table", "mode", "data_state") and parts[1] == side:
                found.add(parts[2])
        return sorted(found)

    # ------------------------------------------------------- namespace status
    def set_mode(self, side: str, ns: str, mode: str) -> None:
        self.set_state(mode_key(canon_side(side), map_namespace(ns)), mode)

    def set_data_state(self, side: str, ns: str, data_state: str) -> None:
        self.set_state(data_state_key(canon_side(side), map_namespace(ns)), data_state)

    def mode_of(self, side: str, ns: str) -> str | None:
        return self.state().get(mode_key(canon_side(side), map_namespace(ns)))

    def inventory(self, side: str) -> DataFrame:
        """``(id, name, data_state, service_mode)`` of a side's namespaces."""
        side = canon_side(side)
        st = self.state()
        rows = [(i + 1, ns, st.get(data_state_key(side, ns)), st.get(mode_key(side, ns)))
                for i, ns in enumerate(self.namespaces(side))]
        return self.spark.createDataFrame(
            rows, "id bigint, name string, data_state string, service_mode string")


# ------------------------------------------------------------------- O1 - O6
def read_side(spark: SparkSession, reg: Registry, side: str, ns: str | None,
              table: str, as_of=None) -> DataFrame:
    """Read a table from (side, namespace) (O1), now or as of a time.

    The side spelling is canonicalised (unknown sides raise); namespace aliases
    map to current names; ``ns=None`` follows the side's default pointer.
    """
    side = canon_side(side)
    ns = resolve_default(reg, side) if ns is None else map_namespace(ns)
    return reg.read(side, ns, table, as_of)


def resolve_default(reg: Registry, side: str) -> str:
    """Namespace that unqualified reads of a side reach (O2)."""
    side = canon_side(side)
    return reg.state().get(default_key(side), MAIN_NAMESPACE[side])


def pointer_table(log: DataFrame) -> DataFrame:
    """Latest target per side of a ``(side, target_namespace, version)`` log (O2).

    Side spellings and namespace aliases are canonicalised as Columns, then
    ``max_by`` picks the newest target (partial aggregation, tiny output).
    """
    from replicakit.functions.text import canon_side_col, map_namespace_col

    clean = log.select(
        canon_side_col("side").alias("side"),
        map_namespace_col("target_namespace").alias("target_namespace"),
        F.col("version"),
    ).filter(F.col("side").isNotNull())
    return clean.groupBy("side").agg(
        F.max_by("target_namespace", "version").alias("target_namespace"),
        F.max("version").alias("version"),
    )


def swap_default(reg: Registry, side: str, ns: str) -> None:
    """Point a side's unqualified reads at another namespace (O3)."""
    reg.set_state(default_key(canon_side(side)), map_namespace(ns))


def pointers(reg: Registry) -> DataFrame:
    """``(side, target_namespace)`` as folded from the control log."""
    folded = control_state(reg.control_log())
    return folded.filter(F.col("key").startswith("default/")).select(
        F.substring_index("key", "/", -1).alias("side"),
        F.col("value").alias("target_namespace"),
    )


#: A relation, and the names that WITH clauses define, in a printed plan.
_RELATION = re.compile(r"^[\s:+|-]*'?(?:InsertIntoStatement '?)?UnresolvedRelation \[(.*?)\], \[", re.MULTILINE)
_WITH_NAMES = re.compile(r"^[\s:+|-]*CTE \[(.*?)\]$", re.MULTILINE)


def relation_names(spark: SparkSession, sql: str) -> tuple[list[str], set[str]]:
    """The relations that a statement names (parts joined by dots), and the names that its WITH
    clauses define, as Spark's parser reads it; nothing is resolved."""
    text = spark.sql(f"EXPLAIN EXTENDED {sql}").first()[0].split("== Analyzed Logical Plan ==")[0]
    if "PlanWithUnresolvedIdentifier" in text:
        raise AnalysisException("relations are named directly, not by IDENTIFIER()")
    return ([".".join(x.split(", ")) for x in _RELATION.findall(text)],
            {n.strip().lower() for x in _WITH_NAMES.findall(text) for n in x.split(",")})


def run_sql(spark: SparkSession, reg: Registry, sql: str, side: str = "A",
            ns: str | None = None) -> DataFrame:
    """Ad-hoc SQL query over one side's namespace (O4); by default side A and the
    side's main namespace (``va`` / ``vb``), aliases accepted.

    Spark's parser says which relations the statement names. Each has to be a table of the
    namespace (or defined by the statement's own WITH); any other name fails, also where the caller
    has a view of that name. Only the tables named are read. They are bound by a WITH clause around
    the statement, so the caller's own views are neither seen nor touched. A dotted table ``x.t``
    goes by its full name, and by ``t`` where no other table ends in that. Statements other
    than queries fail.
    """
    side = canon_side(side)
    ns = MAIN_NAMESPACE[side] if ns is None else map_namespace(ns)
    known: dict[str, str] = {}
    tables = reg.tables(side, ns)
    last = [t.split(".")[-1].lower() for t in tables]
    for t in tables:
        known |= {t.lower(): t} | ({t.split(".")[-1].lower(): t} if last.count(t.split(".")[-1].lower()) == 1 else {})
    sql = sql.strip().rstrip(";")
    for t in tables:
        if "." in t:  # outside string literals
            parts = re.split(r"('(?:[^']|'')*')", sql)
            parts[::2] = [re.sub(rf"(?<![\w`.]){re.escape(t)}(?![\w`])", f"`{t}`", p) for p in parts[::2]]
            sql = "".join(parts)
    named, defined = relation_names(spark, sql)
    wanted = {n.lower() for n in named}
    unknown = sorted(wanted - known.keys() - defined)
    if unknown:
        raise AnalysisException(f"{side}/{ns} has no table {', '.join(unknown)}")
    views: list[str] = []
    binding = []
    try:
        for name in sorted(wanted & known.keys()):
            view = f"_side_{uuid.uuid4().hex}"
            reg.read(side, ns, known[name]).createOrReplaceTempView(view)
            views.append(view)
            binding.append(f"`{name}` AS (SELECT * FROM {view})")
        # A name that the statement defines in one place means nothing in another.
        binding += [f"`{name}` AS (SELECT raise_error('{name} is not a table of {side}/{ns}'))"
                    for name in sorted((wanted & defined) - known.keys())]
        return spark.sql(f"{'WITH ' + ', '.join(binding) if binding else ''} SELECT * FROM (\n{sql}\n)")
    finally:
        for view in views:
            spark.catalog.dropTempView(view)


def table_inventory(spark: SparkSession, reg: Registry, side: str,
                    ns: str | None = None) -> DataFrame:
    """``(namespace, table_name, n_rows)`` for every table of a namespace.

    One union of count aggregates: a single job, no columns read.
    """
    side = canon_side(side)
    ns = resolve_default(reg, side) if ns is None else map_namespace(ns)
    frames = [
        reg.count(side, ns, t).select(
            F.lit(ns).alias("namespace"), F.lit(t).alias("table_name"), "n_rows")
        for t in reg.tables(side, ns)
    ]
    if not frames:
        return spark.createDataFrame([], "namespace string, table_name string, n_rows bigint")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def create_if_absent(spark: SparkSession, reg: Registry, side: str, ns: str, table: str,
                     schema: StructType) -> bool:
    """Create an empty table with ``schema`` unless it exists.

    Returns whether it was created; a second call changes nothing.
    """
    if reg.exists(side, ns, table):
        return False
    reg.write_version(side, ns, table, spark.createDataFrame([], schema))
    return True
