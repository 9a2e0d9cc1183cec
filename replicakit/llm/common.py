"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replicakit.session import staged

#: What separates words: space and the five ASCII control characters from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a fresh folder of the cluster's shared scratch space and read it back: the
    lineage is cut and a lost executor costs no recomputation. Inside a ``scratch_scope`` the
    folder goes at its end."""
    return staged(df, label)


def text_of(df: DataFrame, text_col: str = "text") -> Column:
    """The text column; null counts as the empty text."""
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words, without building an array of them."""
    marks = F.regexp_replace(text, WORD, "x")
    return F.length(F.translate(marks, SPACES, "")).cast("bigint")


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the identifier written as text, modulo ``n``; a null id counts as ''."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n


def slices(sizes, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes sum to at most ``limit`` (one item at least)."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)
