"""Exact dedup by content sort, in DataFrame operations only.

Sampled splitters range-partition the rows by the first bytes of the normalised
text and its digest, an external sort places equal texts next to each other, and
neighbouring rows are compared in full (the window's partition key holds the whole
text). Splitter keys are bounded (``prefix_bytes`` + a digest), so sampling sends
little to the driver however long the texts are.

A text whose copies make up more than ``task_bytes``, or more than ``1 / hot_groups`` of
all rows, is hot. Its rows are dealt over as many pieces as keep each below both, every
piece is sorted and compared by itself, and the heads of the pieces are then compared in
full. By arithmetic there are at most ``hot_groups`` + all bytes / ``task_bytes`` hot texts;
``task_bytes`` grows where that would exceed ``MAX_HOT``, so their list (digest and number
of pieces) can be broadcast at any size. Results do not depend on which texts are hot.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from replicakit.llm.common import stored, text_of


#: Bytes of equal texts that one task sorts, those of a row besides its text, and hot texts at most.
TASK_BYTES, ROW_BYTES, MAX_HOT = 64 << 20, 128, 1_000_000


def _dealt(rows: DataFrame, prefix_bytes: int, task_bytes: int, hot_groups: int) -> DataFrame:
    """``rows`` with the sort key ``prefix`` and the piece (``salt``) of a hot text, else -1."""
    copies = stored(rows.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.octet_length("body") + ROW_BYTES).alias("size")), "exact-copies")
    all_rows, all_bytes = copies.agg(F.sum("n"), F.sum(F.col("n") * F.col("size"))).first()
    limit = max(task_bytes, (all_bytes or 0) // MAX_HOT)
    pieces = F.ceil(F.greatest(F.col("n") * F.col("size") / limit, F.col("n") * hot_groups / (all_rows or 1)))
    hot = copies.filter("n > 1").select("digest", F.least(F.col("n"), pieces).cast("int").alias("salts")).filter("salts > 1")
    return rows.join(F.broadcast(hot), "digest", "left").select(
        *rows.columns,
        F.substring(F.col("body").cast("binary"), 1, prefix_bytes).alias("prefix"),
        F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("salts"))).otherwise(-1)
        .cast("int").alias("salt"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                normalise: Callable[[Column], Column] | None = None, keep: str = "largest",
                carry: Sequence[str] = (), prefix_bytes: int = 64, task_bytes: int = TASK_BYTES,
                hot_groups: int = 1000) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256`` (of the normalised text) and, with ``carry``, ``row`` (a struct of
    these columns, null on dropped rows).

    Equal texts (after ``normalise``) form a group; the row with the largest (or, with
    ``keep='smallest'``, smallest) identifier stays. A null text counts as empty. A null
    identifier loses to any other. Of repeated rows with the same text and identifier
    exactly one stays. An empty table gives no rows. Extra columns are ignored.
    """
    body = text_of(docs, text_col)
    if normalise is not None:
        body = normalise(body)
    rows = docs.select(docs[id_col].alias("doc_id"), body.alias("body"),
                       *([F.struct(*[docs[c] for c in carry]).alias("row")] if carry else []))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("body"), 256)))

    keyed = _dealt(rows, prefix_bytes, task_bytes, hot_groups)

    by_id = F.col("doc_id").desc_nulls_last() if keep == "largest" else F.col("doc_id").asc_nulls_last()
    order = W.partitionBy("prefix", "digest", "salt", "body").orderBy(by_id)
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first = F.col("pos") == 1
    pieces = keyed.repartitionByRange("prefix", "digest", "salt").select(
        *keyed.columns, F.row_number().over(order).alias("pos"),
        F.first("doc_id").over(whole).alias("piece_keep"),
        F.count(F.lit(1)).over(whole).alias("piece_size"))
    pieces = stored(pieces.select(
        "doc_id", "digest", "salt", "pos", "piece_keep", "piece_size",
        F.when(first & (F.col("salt") >= 0), F.col("body")).alias("head"),
        *([F.when(first, F.col("row")).alias("row")] if carry else [])), "exact-dedup")

    # Heads of the pieces of hot texts, compared in full; combined map-side, so that a text of
    # very many pieces moves one head per task.
    best = F.max if keep == "largest" else F.min
    heads = stored(pieces.filter(first & (F.col("salt") >= 0)).select(
        "digest", "salt", "piece_keep", "piece_size", "head"), "exact-heads")
    groups = stored(heads.groupBy("digest", "head").agg(
        best("piece_keep").alias("keep_id"), F.sum("piece_size").alias("group_size")), "exact-groups")
    merged = heads.join(groups, ["digest", "head"]).select(
        F.col("digest").alias("m_digest"), F.col("salt").alias("m_salt"), F.col("piece_keep").alias("m_keep"),
        "keep_id", "group_size")
    # Only rows of hot texts look for their group, spread over its pieces.
    cool = pieces.filter("salt < 0").withColumn("keep_id", F.col("piece_keep")).withColumn("group_size", F.col("piece_size"))
    hot_rows = pieces.filter("salt >= 0")
    hot_rows = hot_rows.join(merged, (hot_rows.digest == merged.m_digest) & (hot_rows.salt == merged.m_salt)
                             & hot_rows.piece_keep.eqNullSafe(merged.m_keep)).drop("m_digest", "m_salt", "m_keep")
    out = cool.unionByName(hot_rows)
    kept = first & F.col("piece_keep").eqNullSafe(F.col("keep_id"))
    return out.select(
        "doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
        *([F.when(kept, F.col("row")).alias("row")] if carry else []))
