"""Insert-or-replace by primary key and column defaults."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from replicakit.session import staged


def _as_col(v: Any) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def uuid_default() -> Column:
    """``gen_random_uuid()`` as a column default."""
    return F.expr("uuid()")


def now_default() -> Column:
    """``now()`` as a column default."""
    return F.current_timestamp()


def fill_defaults(
    df: DataFrame,
    defaults: Mapping[str, Any] | None = None,
    schema: StructType | None = None,
) -> DataFrame:
    """Add every absent column: its default, else null.

    Columns that are present keep their values, an explicit null included
    (O19 reports it). With ``schema``, the result has its column order and types.
    """
    defaults = dict(defaults or {})
    names = schema.fieldNames() if schema is not None else list(df.columns) + [
        c for c in defaults if c not in df.columns]
    types = {f.name: f.dataType for f in schema.fields} if schema is not None else {}
    out = []
    for c in names:
        if c in df.columns:
            col = F.col(c)
        elif c in defaults:
            col = _as_col(defaults[c])
        else:
            col = F.lit(None)
        if c in types:
            col = col.cast(types[c])
        out.append(col.alias(c))
    return df.select(*out)


def _key_match(left: DataFrame, right_prefix: str, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b,
                  [left[k].eqNullSafe(F.col(f"{right_prefix}{k}")) for k in keys])


def upsert(
    base: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    defaults: Mapping[str, Any] | None = None,
    stage: bool = True,
) -> DataFrame:
    """Insert or replace ``rows`` into ``base`` by ``keys`` (keys unique in rows).

    Given columns replace the old values (a given null stays null); columns not
    given keep their value on update and take the default on insert. Applying
    the same rows twice gives the same table.

    ``rows`` are evaluated once: they are staged first (``stage=False`` if they already are),
    so the planner knows their size. One plan at every size: ``base`` left join ``rows`` with
    a match flag, plus ``rows`` without the keys that ``base`` has. Spark broadcasts ``rows``
    below its own threshold and then only scans ``base``; above it both are left-side joins,
    whose skew adaptive execution splits.
    """
    keys = list(keys)
    given = [c for c in rows.columns if c not in keys]
    unknown = [c for c in rows.columns if c not in base.columns]
    if unknown:
        raise ValueError(f"columns not in base: {unknown}")
    if stage:
        rows = staged(rows, "upsert")
    new = rows.select(*[F.col(c).alias(f"_n_{c}") for c in rows.columns],
                      F.lit(True).alias("_m"))
    on = _key_match(base, "_n_", keys)
    updated = base.join(new, on, "left").select(*[
        (F.when(F.col("_m").isNotNull(), F.col(f"_n_{c}")).otherwise(base[c]) if c in given
         else base[c]).alias(c)
        for c in base.columns
    ])
    matched = base.select(*keys).join(new.select(*[f"_n_{k}" for k in keys]), on, "left_semi").select(
        *[F.col(k).alias(f"_x_{k}") for k in keys])
    inserts = rows.join(matched, _key_match(rows, "_x_", keys), "left_anti")
    return updated.unionByName(fill_defaults(inserts, defaults, base.schema))
