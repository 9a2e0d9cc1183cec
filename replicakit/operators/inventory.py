"""Predicates over a namespace inventory ``(id, name, data_state, service_mode)``
(O10-O12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replicakit.functions.text import map_namespace_col
from replicakit.operators.sizing import DEFAULT_BROADCAST_ROWS, broadcast_if_small

INVENTORY_COLUMNS = ("id", "name", "data_state", "service_mode")


def namespaces_in_mode(inv: DataFrame, mode: str) -> DataFrame:
    """Names whose service mode equals ``mode`` exactly."""
    return inv.filter(F.col("service_mode") == F.lit(mode)).select("name")


def is_in_mode(
    names: DataFrame,
    inv: DataFrame,
    mode: str,
    name_col: str = "name",
    max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
) -> DataFrame:
    """Every row of ``names`` with ``in_mode``: exact, whole-string membership
    of ``name_col`` (old aliases mapped first, e.g. ``crla`` is ``va``) in
    :func:`namespaces_in_mode` (O11).

    The member set is deduplicated (a partial aggregate) so the left join keeps
    the row count of ``names``; it is broadcast only after a size check.
    """
    members = (
        namespaces_in_mode(inv, mode)
        .distinct()
        .select(F.col("name").alias("_member"), F.lit(True).alias("_hit"))
    )
    members = broadcast_if_small(members, max_broadcast_rows)
    joined = names.join(members, map_namespace_col(names[name_col]) == members["_member"],
                        "left")
    return joined.select(*[names[c] for c in names.columns],
                         F.coalesce(F.col("_hit"), F.lit(False)).alias("in_mode"))


def state_of(inv: DataFrame, name: str) -> DataFrame:
    """``data_state`` of one named namespace (O12): ``(name, data_state)``."""
    return inv.filter(F.col("name") == F.lit(name)).select("name", "data_state")
