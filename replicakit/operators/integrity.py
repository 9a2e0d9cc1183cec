"""Integrity checks a declared schema implies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_not_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null count per declared not-null column: ``(column_name, n_nulls)``.

    One scan, one global aggregate (partial per task), then unpivoted.
    """
    cols = list(cols or df.columns)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(cols)])
    pairs = ", ".join(f"'{c.replace(chr(39), chr(39) * 2)}', _n{i}" for i, c in enumerate(cols))
    return counts.selectExpr(f"stack({len(cols)}, {pairs}) AS (column_name, n_nulls)")


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows.

    Serves PRIMARY KEY and UNIQUE. The count is aggregated partially before
    the shuffle, so hot keys do not concentrate rows in one task.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .filter(F.col("n_rows") > 1)
    )
