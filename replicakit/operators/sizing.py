"""Size checks that gate explicit broadcasts.

A broadcast hint is given only after the frame was measured: at most
``max_rows`` rows AND at most ``max_bytes`` of data. The probe reads at most
``max_rows + 1`` rows (``limit``), whatever the size of the frame.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    DataType,
    MapType,
    StringType,
    StructType,
    ArrayType,
)

# Largest frame we hint for broadcast after checking it.
DEFAULT_BROADCAST_ROWS = 200_000
DEFAULT_BROADCAST_BYTES = 64 << 20

# Bytes per value of fixed-width types (their in-memory width).
FIXED_WIDTH = {
    "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8,
    "boolean": 1, "date": 4, "timestamp": 8, "timestamp_ntz": 8,
}


def _value_bytes(col: Column, dt: DataType) -> Column:
    if isinstance(dt, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0))
    if isinstance(dt, (StructType, ArrayType, MapType)):
        return F.coalesce(F.octet_length(F.to_json(col)), F.lit(0))
    return F.lit(FIXED_WIDTH.get(dt.simpleString(), 16))


def row_bytes(df: DataFrame) -> Column:
    """Approximate bytes of one row: fixed widths plus variable lengths."""
    parts = [_value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    return reduce(lambda a, b: a + b, parts, F.lit(0)).cast("bigint")


def has_at_most(df: DataFrame, max_rows: int, max_bytes: int | None = None) -> bool:
    """True when ``df`` has at most ``max_rows`` rows (and, if given, at most
    ``max_bytes`` of data). One job over at most ``max_rows + 1`` rows, of which only
    the sizes meet in one task."""
    probe = df.select(row_bytes(df).alias("b")).limit(max_rows + 1)
    if max_bytes is None:
        return probe.count() <= max_rows
    r = probe.agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b")).first()
    return r["n"] <= max_rows and (r["b"] or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
                       max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only after rows and bytes have been checked.

    Above the bound the frame is returned as is; the planner (and AQE at run
    time) then picks a shuffle join.
    """
    return F.broadcast(df) if has_at_most(df, max_rows, max_bytes) else df
