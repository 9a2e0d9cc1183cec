"""Row counts per side and their comparison.

A count reads no columns (Parquet row-group metadata and empty batches), is
aggregated partially per task and shuffles one row per task. Of a table with pending
changes, and of a replica, it reads and merges the key columns only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replicakit.constants import MATCH, MISMATCH, WAITING
from replicakit.functions.text import canon_side, map_namespace
from replicakit.operators.inventory import is_in_mode
from replicakit.sources.registry import Registry, is_path_not_found, resolve_default

COUNT_SCHEMA = "side string, table_name string, n_rows bigint"
SERVED_SCHEMA = "table_name string, served_by string, n_rows bigint"


def count_rows(df: DataFrame) -> DataFrame:
    """``count(*)`` as a one-row frame ``(n_rows)``."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def _side_count(reg: Registry, side: str, ns: str | None, table: str, as_of=None) -> DataFrame:
    """``(n_rows)`` of a table as :func:`replicakit.sources.registry.read_side` reads it."""
    side = canon_side(side)
    return reg.count(side, resolve_default(reg, side) if ns is None else map_namespace(ns), table, as_of)


def row_count(spark: SparkSession, reg: Registry, side: str, table: str,
              as_of=None) -> DataFrame:
    """``(side, table_name, n_rows)`` of one table at the side's default.

    Give both sides the same ``as_of`` to compare them at one point in time.
    """
    side = canon_side(side)
    return _side_count(reg, side, None, table, as_of).select(F.lit(side).alias("side"), F.lit(table).alias("table_name"),
                                 "n_rows")


def row_counts(spark: SparkSession, reg: Registry, side: str,
               tables: Sequence[str], as_of=None) -> DataFrame:
    """One row per table, all counted in one job."""
    frames = [row_count(spark, reg, side, t, as_of) for t in tables]
    if not frames:
        return spark.createDataFrame([], COUNT_SCHEMA)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def compare_counts(counts_a: DataFrame, counts_b: DataFrame) -> DataFrame:
    """``(table_name, n_a, n_b, verdict)`` per table.

    ``match`` if both counts are equal, ``mismatch`` if both are numbers and
    differ, ``waiting`` if either is missing (absent row or null count).
    """
    a = counts_a.select(F.col("table_name").alias("_ta"), F.col("n_rows").alias("n_a"))
    b = counts_b.select(F.col("table_name").alias("_tb"), F.col("n_rows").alias("n_b"))
    j = a.join(b, F.col("_ta") == F.col("_tb"), "full_outer")
    verdict = (
        F.when(F.col("n_a").isNull() | F.col("n_b").isNull(), F.lit(WAITING))
        .when(F.col("n_a") == F.col("n_b"), F.lit(MATCH))
        .otherwise(F.lit(MISMATCH))
    )
    return j.select(F.coalesce("_ta", "_tb").alias("table_name"), "n_a", "n_b",
                    verdict.alias("verdict"))


def _count_at(spark: SparkSession, reg: Registry, side: str, ns: str, table: str) -> int:
    """Count one table now. Raises on a missing path (at resolution) or an
    unreadable file (at the action)."""
    return reg.count(side, ns, table).first()["n_rows"]


def _counts_at(reg: Registry, side: str, ns: str, tables: Sequence[str]) -> dict[str, int]:
    """Counts of the tables that can be counted at ``ns``: all in one job, and table by table
    only if that fails."""
    try:
        frames = [reg.count(side, ns, t).withColumn("t", F.lit(t)) for t in tables]
        return {r["t"]: r["n_rows"] for r in reduce(DataFrame.unionByName, frames).collect()} if frames else {}
    except Exception:  # noqa: BLE001 - any failure falls back, as specified
        if len(tables) == 1:
            return {}
    return {t: n for x in tables for t, n in _counts_at(reg, side, ns, [x]).items()}


def counts_at_once(reg: Registry, wanted: Mapping[str, tuple[str | None, str]], as_of=None) -> dict[str, int]:
    """Counts per side of ``{side: (namespace or None, table)}``, all as of one moment and in one
    job; side by side only if that fails. A side that cannot be counted is left out."""
    frames = {}
    for side, (ns, table) in wanted.items():
        try:
            frames[side] = _side_count(reg, side, ns, table, as_of).select(
                F.lit(side).alias("side"), "n_rows")
        except Exception:  # noqa: BLE001 - missing on that side
            continue
    try:
        return {r["side"]: r["n_rows"] for r in reduce(DataFrame.unionByName, frames.values()).collect()} if frames else {}
    except Exception:  # noqa: BLE001 - a file went missing: which side's?
        if len(wanted) == 1:
            return {}
    return {s: n for side in frames for s, n in counts_at_once(reg, {side: wanted[side]}, as_of).items()}


def count_with_fallback(spark: SparkSession, reg: Registry, side: str, tables: Sequence[str],
                        pref: str | None, alt: str | None = None) -> DataFrame:
    """Count at the preferred namespace; on any failure at ``alt``.

    ``(table_name, served_by, n_rows)``; when both fail, ``served_by`` and
    ``n_rows`` are null. ``pref=None`` follows the default pointer. Tables that can all be
    counted take one job.
    """
    side = canon_side(side)
    pref = resolve_default(reg, side) if pref is None else map_namespace(pref)
    alt = map_namespace(alt) if alt else None
    found: dict[str, tuple[str, int]] = {}
    for ns in [pref] + ([alt] if alt else []):
        left = [t for t in dict.fromkeys(tables) if t not in found]
        found |= {t: (ns, n) for t, n in _counts_at(reg, side, ns, left).items()}
    return spark.createDataFrame([(t, *found.get(t, (None, None))) for t in tables], SERVED_SCHEMA)


class GuardRefused(RuntimeError):
    """Count failed and the guard did not allow a fallback."""


def _served(reg: Registry, side: str, ns: str, tables: Sequence[str]) -> dict[str, int]:
    """Counts of the tables found at ``ns``, in one job; a table whose path is not there is left
    out, any other failure raises."""
    frames = {}
    for t in dict.fromkeys(tables):
        try:
            frames[t] = reg.count(side, ns, t).withColumn("t", F.lit(t))
        except Exception as err:  # noqa: BLE001
            if not is_path_not_found(err):
                raise
    try:
        return {r["t"]: r["n_rows"] for r in reduce(DataFrame.unionByName, frames.values()).collect()} if frames else {}
    except Exception as err:  # noqa: BLE001 - gone since it was resolved: which one?
        if len(frames) == 1:
            if is_path_not_found(err):
                return {}
            raise
    return {t: n for x in frames for t, n in _served(reg, side, ns, [x]).items()}


def count_with_guard(spark: SparkSession, reg: Registry, side: str, tables: Sequence[str],
                     pref: str, alt: str, inv: DataFrame | None = None) -> DataFrame:
    """Like :func:`count_with_fallback`, but fall back only when ``pref`` is
    unavailable (its service is not ``shared``, or its path is not found) and
    ``alt`` is in shared mode in the inventory; any other failure raises (O18).
    All tables of a namespace are counted in one job.
    """
    side = canon_side(side)
    pref, alt = map_namespace(pref), map_namespace(alt)
    mode = reg.mode_of(side, pref)
    served = {t: (pref, n) for t, n in _served(reg, side, pref, tables).items()} if mode in (None, "shared") else {}
    left = [t for t in dict.fromkeys(tables) if t not in served]
    if left:
        inv = reg.inventory(side) if inv is None else inv
        names = spark.createDataFrame([(alt,)], "name string")
        if not is_in_mode(names, inv, "shared").first()["in_mode"]:
            raise GuardRefused(f"{side}/{pref} is unavailable for {', '.join(left)} (mode {mode}) "
                               f"and {alt} is not in shared mode")
        served |= {t: (alt, n) for t, n in _served(reg, side, alt, left).items()}
        for t in left:
            if t not in served:
                _count_at(spark, reg, side, alt, t)  # raises what is wrong with it
    return spark.createDataFrame([(t, *served[t]) for t in tables], SERVED_SCHEMA)
