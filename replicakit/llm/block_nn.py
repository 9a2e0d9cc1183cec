"""Nearest neighbours by a block matrix join with int8 product tiles.

Unit vectors are quantised to int8. A product of int8 tiles gives every cosine of a query
block with a candidate block up to an error bound that follows from the vectors' own
quantisation errors. Only pairs whose upper bound reaches the query's k-th best lower
bound survive; their cosines are computed again from the original vectors in double
precision and merged by heaps, per cell and then over cells. The result is exact.

Queries and candidates meet on a grid of cells (query block, candidate block). Both block
sizes are fixed, so a cell's memory is bounded however many rows there are, and nothing is
broadcast.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replicakit.llm.common import stored

QUERY_ROWS, CANDIDATE_ROWS = 4096, 8192

#: Rows of a product tile.
TILE = 1024

QUANT = "vec_id bigint, is_query boolean, dim int, vector binary, int8 binary, scale double, error double"


def _quantise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Vectors that take part: as doubles, and the unit vector as int8 with its scale and the
    length of what quantisation leaves."""
    for batch in batches:
        out = []
        for vec_id, asked, v in zip(batch["vec_id"].tolist(), batch["is_query"].tolist(), batch["vector"], strict=True):
            x = np.asarray(v, np.float64)
            top = np.abs(x).max(initial=0.0)
            if not np.isfinite(top) or top == 0:
                continue
            unit = x / top
            unit /= np.sqrt((unit * unit).sum())
            scale = np.abs(unit).max() / 127
            q = np.rint(unit / scale).astype(np.int8)
            rest = unit - q * scale
            out.append((vec_id, asked, len(x), x.tobytes(), q.tobytes(), scale, np.sqrt((rest * rest).sum())))
        yield pd.DataFrame(out, columns=["vec_id", "is_query", "dim", "vector", "int8", "scale", "error"])


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, summed in the order of the components."""
    dot, xx, yy = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for d in range(x.shape[1]):
        a, b = x[:, d], y[:, d]
        dot += a * b
        xx += a * a
        yy += b * b
    norm = np.sqrt(xx * yy)
    odd = ~(np.isfinite(norm) & (norm > 1e-290))  # out of range: scale first
    if odd.any():
        a, b = x[odd] / np.abs(x[odd]).max(1, keepdims=True), y[odd] / np.abs(y[odd]).max(1, keepdims=True)
        dot[odd], norm[odd] = (a * b).sum(1), np.sqrt((a * a).sum(1) * (b * b).sum(1))
    return np.clip(dot / norm, -1.0, 1.0)


def _side(frame: pd.DataFrame):
    frame = frame.rename(columns=lambda c: c.removeprefix("c_"))
    stack = lambda name, kind: np.frombuffer(b"".join(frame[name]), kind).reshape(len(frame), -1)
    return (frame["vec_id"].to_numpy(), stack("vector", np.float64), stack("int8", np.int8),
            frame["scale"].to_numpy(), frame["error"].to_numpy())


def _cell(k: int):
    def run(_key: tuple, queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(queries) and len(candidates):
            qid, qv, q8, qs, qe = _side(queries)
            cid, cv, c8, cs, ce = _side(candidates)
            # |a.b - (a8.b8)| <= ea |b8| + eb |a8| + ea eb with |a8| <= 1 + ea; a little for rounding
            c32 = c8.astype(np.float32)
            heaps: dict[int, list[tuple[float, int]]] = {}
            for a in range(0, len(qid), TILE):
                q = slice(a, a + TILE)
                product = q8[q].astype(np.float32) @ c32.T  # exact: sums of int8 products below 2^24 up to 1040 dims
                if qv.shape[1] > 1000:
                    product = q8[q].astype(np.float64) @ c8.astype(np.float64).T
                near = product * (qs[q, None] * cs[None, :])
                bound = qe[q, None] * (1 + ce[None, :]) + ce[None, :] * (1 + qe[q, None]) + qe[q, None] * ce[None, :] + 1e-6
                own = qid[q, None] == cid[None, :]
                low = np.where(own, -np.inf, near - bound)
                at = min(k, low.shape[1]) - 1
                least = -np.partition(-low, at, axis=1)[:, at]
                alive = (near + bound >= least[:, None]) & ~own
                r, c = np.nonzero(alive)
                score = cosine(qv[q][r], cv[c])
                for i, s, v in zip(qid[q][r].tolist(), score.tolist(), cid[c].tolist(), strict=True):
                    h = heaps.setdefault(i, [])
                    if len(h) < k:
                        heapq.heappush(h, (s, -v))
                    elif (s, -v) > h[0]:
                        heapq.heapreplace(h, (s, -v))
            out = [(i, -v, s) for i, h in heaps.items() for s, v in h]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])
    return run


def _best(k: int):
    def run(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        best = heapq.nsmallest(k, zip((-found["score"]).tolist(), found["vec_id"].tolist(), strict=True))
        return pd.DataFrame([(key[0], i + 1, v, -s) for i, (s, v) in enumerate(best)],
                            columns=["query_id", "rank", "vec_id", "score"])
    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
            query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS) -> DataFrame:
    """For each row that ``queries`` selects, its ``k`` nearest of all other rows by cosine:
    ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; ties go to the smaller identifier,
    and fewer rows come where there are fewer candidates.

    Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor
    do null identifiers. Only vectors of one length are compared. Every row of a repeated
    identifier counts: each is a candidate of other identifiers, and the nearest of any of a
    query identifier's rows are ranked together; rows of its own identifier are not its
    candidates. An empty table gives no rows; extra columns are ignored.
    """
    v = vectors[vector_col].cast("array<double>")
    valid = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) \
        & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(vectors[id_col].isNotNull()).select(
        vectors[id_col].cast("bigint").alias("vec_id"), F.when(v.isNotNull() & valid, v).alias("vector"),
        F.coalesce(queries, F.lit(False)).alias("is_query")).filter("vector is not null")
    # A key for each row, so that rows of one identifier are dealt out, too.
    quant = stored(rows.mapInPandas(_quantise, QUANT).withColumn("row", F.monotonically_increasing_id()), "vectors")
    sizes = quant.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_query").cast("bigint")).alias("q")).first()
    n_q, n_c = max(1, -(-(sizes["q"] or 0) // query_rows)), max(1, -(-sizes["n"] // candidate_rows))
    block = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n))
    grid = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    q = quant.filter("is_query").drop("is_query").withColumn("qb", block(n_q, 1)).withColumn("cb", grid(n_c)).drop("row")
    c = quant.drop("is_query").withColumn("cb", block(n_c, 2)).withColumn("qb", grid(n_q)).drop("row")
    c = c.select(*[F.col(x).alias(f"c_{x}") for x in c.columns])  # both sides come from one table
    found = (q.groupBy("dim", "qb", "cb").cogroup(c.groupBy("c_dim", "c_qb", "c_cb"))
             .applyInPandas(_cell(k), "query_id bigint, vec_id bigint, score double"))
    return found.groupBy("query_id").applyInPandas(_best(k), "query_id bigint, rank int, vec_id bigint, score double")
