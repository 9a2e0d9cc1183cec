"""Change rows: a table's columns plus ``_ts``, ``_seq`` and ``_op``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampNTZType

from replicakit.constants import UPSERT

#: The change metadata columns, in order.
TABLE_META = ("_ts", "_seq", "_op")
META_FIELDS = [
    StructField("_ts", TimestampNTZType(), True),
    StructField("_seq", LongType(), True),
    StructField("_op", StringType(), True),
]
TS_FORMAT = "%Y-%m-%d %H:%M:%S.%f"


def now() -> dt.datetime:
    """Driver time in UTC, as a naive timestamp (the tables use timestamp_ntz)."""
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def ts_lit(t: dt.datetime | str) -> Column:
    if isinstance(t, dt.datetime):
        t = t.strftime(TS_FORMAT)
    return F.lit(t).cast("timestamp_ntz")


def parse_ts(s: str) -> dt.datetime:
    return dt.datetime.strptime(s, TS_FORMAT)


def with_meta(df: DataFrame, ts: dt.datetime | str, seq: int, op: str = UPSERT) -> DataFrame:
    """``df`` as change rows written at ``ts`` with sequence ``seq``."""
    return df.select(*df.columns, ts_lit(ts).alias("_ts"), F.lit(seq).cast("bigint").alias("_seq"),
                     F.lit(op).alias("_op"))


def change_schema(table_schema: StructType) -> StructType:
    """Schema of a table's change rows."""
    return StructType([f for f in table_schema.fields if f.name not in TABLE_META] + META_FIELDS)
