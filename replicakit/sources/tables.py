"""Reading Parquet tables with a declared schema.

``spark.read.parquet(path)`` without a schema runs a job to read Parquet
footers every time it is called. A table's schema is read once and then declared on each
later read, as long as its file or folder has the same size and time of change: no
inference job, the same plan, and a table that was rewritten is read anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_SCHEMAS: dict[str, tuple[tuple[int, int], StructType]] = {}


def _stamp(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """Size and time of change of a file or folder (one call to its file system)."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return None
    status = fs.getFileStatus(target)
    return status.getLen(), status.getModificationTime()


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Read a Parquet table; its schema is inferred once for each state of the path."""
    if schema is not None:
        return spark.read.schema(schema).parquet(path)
    stamp, known = _stamp(spark, path), _SCHEMAS.get(path)
    if stamp is not None and known is not None and known[0] == stamp:
        return spark.read.schema(known[1]).parquet(path)
    df = spark.read.parquet(path)
    if stamp is not None:
        _SCHEMAS[path] = (stamp, df.schema)
    return df
