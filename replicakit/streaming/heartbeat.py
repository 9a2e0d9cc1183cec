"""What other drivers can know of a replication stream (O28): a listener that records the
stream's start, progress, idling and end beside the control log, each with the time.

A reader takes the newest record of the replica. ``replicating`` and ``initializing`` count only
while the record is fresh: a feeder that died without a word reads as ``stopped`` after ``STALE_S``
seconds. Records of a running stream are at least ``EVERY_S`` seconds apart. They take turns in two
slots, so there are never more than two, and one is whole while the other is replaced.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import Row
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from replicakit.sources.registry import Registry

#: Seconds between two records of a running stream, and after which one is no sign of life. Spark
#: reports an idle stream every 10 seconds.
EVERY_S, STALE_S = 10.0, 45.0

ALIVE = ("initializing", "replicating")


BEAT_SCHEMA = "at double, word string, batch bigint, n_rows bigint"


def stream_key(side: str, ns: str, table: str) -> str:
    return f"stream/{side}/{ns}/{table}"


def _slot_path(reg: Registry, key: str, slot: int) -> str:
    return f"{reg.root}/beats/{key}/slot-{slot}"


def newest_record(reg: Registry, key: str) -> tuple[int, Row | None]:
    """Slot and record of the newest word about a stream."""
    found: list[tuple[int, Row]] = []
    for slot in (0, 1):
        try:
            row = reg.spark.read.schema(BEAT_SCHEMA).parquet(_slot_path(reg, key, slot)).first()
        except Exception as err:  # noqa: BLE001 - absent, or just being replaced
            if "PATH_NOT_FOUND" not in str(err) and "FileNotFound" not in str(err) and "FILE_NOT_EXIST" not in str(err):
                raise
            continue
        if row is not None:
            found.append((slot, row))
    return max(found, key=lambda x: x[1]["at"]) if found else (1, None)


def write_record(reg: Registry, key: str, word: str, at: float, batch: int | None = None, n_rows: int | None = None) -> None:
    slot = 1 - newest_record(reg, key)[0]
    reg.spark.createDataFrame([(at, word, batch, n_rows)], BEAT_SCHEMA).coalesce(1).write.mode("overwrite").parquet(
        _slot_path(reg, key, slot))


class Heartbeat(StreamingQueryListener):
    """Records the streams named ``name`` under ``key``. Events come on another thread."""

    def __init__(self, reg: Registry, key: str, name: str, ends: bool = True, clock: Callable[[], float] = time.time):
        self.reg, self.key, self.name, self.ends, self.clock = reg, key, name, ends, clock
        self._lock = threading.Lock()
        self._run: str | None = None
        self._word, self._at = "", 0.0
        self.reg.spark.streams.addListener(self)

    def record(self, word: str, batch: int | None = None, n_rows: int | None = None) -> None:
        with self._lock:
            self._word, self._at = word, self.clock()
            write_record(self.reg, self.key, word, self._at, batch, n_rows)

    def _beat(self, batch: int | None = None, n_rows: int | None = None) -> None:
        if self._word in ("", "initializing") or (self._word == "replicating" and self.clock() - self._at >= EVERY_S):
            self.record("replicating", batch, n_rows)

    def onQueryStarted(self, event) -> None:  # noqa: N802 - the listener's interface
        if event.name == self.name:
            self._run = str(event.runId)
            if self.ends:
                self.record("initializing")

    def onQueryProgress(self, event) -> None:  # noqa: N802
        if event.progress.name == self.name:
            self._beat(event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        if str(event.runId) == self._run:
            self._beat()

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if str(event.runId) == self._run:
            if event.exception:
                self.record("error")
            elif self.ends:
                self.record("stopped")

    def close(self, query: StreamingQuery | None = None, word: str | None = None) -> None:
        """Record how it ended, if it did not fail, and listen no more."""
        self.reg.spark.streams.removeListener(self)
        failed = query is not None and not query.isActive and query.exception() is not None
        if failed or word:
            self.record("error" if failed else word)


def recorded_word(reg: Registry, key: str) -> str:
    """The replica's stream as its newest record tells. ``stopped`` where there is none, or where
    a sign of life is older than ``STALE_S``."""
    row = newest_record(reg, key)[1]
    if row is None:
        return "stopped"
    return row["word"] if time.time() - row["at"] <= STALE_S or row["word"] not in ALIVE else "stopped"
