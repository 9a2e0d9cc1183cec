"""Fold a change log to the newest row per key (O25) and the control log.

The fold is one aggregation: ``max_by(struct(values), struct(order))`` per key.
It is computed partially on every map task before the shuffle, so a key that
holds a third of all changes still moves only one row per map task.
Out-of-order input gives the same result, so late changes are applied, never
dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replicakit.constants import DELETE


def apply_changes(
    log: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    op_col: str = "op",
    delete_value: str = DELETE,
    keep_deletes: bool = False,
) -> DataFrame:
    """Newest change per key by ``order``; a newest delete removes the key.

    ``order`` must be unique per key (add a sequence column to break ties).
    With ``keep_deletes=True`` delete rows stay as tombstones, which a base
    snapshot needs so that an older, late upsert cannot bring a key back.
    """
    keys = list(keys)
    rest = [c for c in log.columns if c not in keys]
    newest = F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order]))
    folded = log.groupBy(*keys).agg(newest.alias("_newest"))
    out = folded.select(
        *[F.col(c) if c in keys else F.col("_newest")[c].alias(c) for c in log.columns]
    )
    if not keep_deletes:
        out = out.filter(~F.col(op_col).eqNullSafe(F.lit(delete_value)))
    return out


# ------------------------------------------------------------ control state
CONTROL_SET, CONTROL_DEL = "set", "del"


def control_state(log: DataFrame) -> DataFrame:
    """Current value per key of a ``(version, key, op, value)`` control log.

    ``op`` is ``set`` or ``del``; the newest version wins and a newest ``del``
    removes the key. Values are kept exactly as written, ``=`` included.
    """
    folded = apply_changes(
        log.select("key", "version", "op", "value"),
        keys=["key"],
        order=["version"],
        op_col="op",
        delete_value=CONTROL_DEL,
    )
    return folded.select("key", "value", "version")
