"""Exact top-k by inner product with block-at-a-time pruning.

Every component of a vector is a term with a whole weight. Vectors are put in an order that
brings similar ones together (sign code of fixed pseudo-random planes) and cut into slices of
``slice_rows``, slices into blocks of ``BLOCK`` neighbours. A block's greatest and least weight
of each term bound every score in it: positive query weights meet the maxima, negative ones the
minima. Each query takes a slice's blocks in falling order of that bound and scores them through
the block's forward index (its rows of weights) until the next bound is below its k-th score.

A query first searches the slice that it lies in, where its neighbours are. The k-th score
found there goes with it to the other slices, so most of their blocks fail on the bound alone.
Queries and slices meet on a grid of cells of fixed size; nothing is broadcast and the result
is exact: a block is passed over only if it cannot hold a row that belongs in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from replicakit.llm.common import stored

#: Rows of a block, and planes of the code that orders rows.
BLOCK, PLANES = 64, 24
SLICE_ROWS, QUERY_ROWS = 8192, 8192

#: Queries whose block bounds are held at a time.
TILE = 2048

ROWS = "vec_id bigint, is_query boolean, dim int, weights binary, code int"
HITS = "row bigint, query_id bigint, vec_id bigint, score bigint"


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Weights as 16-bit numbers where they fit, else as 64-bit ones, with the row's code."""
    planes: dict[int, np.ndarray] = {}
    powers = 1 << np.arange(PLANES)
    for batch in batches:
        out = []
        for vec_id, asked, weights in zip(batch["vec_id"].tolist(), batch["is_query"].tolist(), batch["weights"], strict=True):
            w = np.asarray(weights, np.int64)
            p = planes.setdefault(len(w), np.random.default_rng(len(w)).standard_normal((PLANES, len(w))))
            code = int(((p @ w.astype(np.float64)) > 0) @ powers)
            narrow = len(w) == 0 or (w.min() >= -(1 << 15) and w.max() < 1 << 15)
            out.append((vec_id, asked, len(w), w.astype("<i2" if narrow else "<i8").tobytes(), code))
        yield pd.DataFrame(out, columns=["vec_id", "is_query", "dim", "weights", "code"])


def _matrix(packed: pd.Series, dim: int) -> np.ndarray:
    if dim == 0:
        return np.zeros((len(packed), 0), np.int64)
    if all(len(x) == 2 * dim for x in packed):
        return np.frombuffer(b"".join(packed), "<i2").reshape(-1, dim).astype(np.int64)
    return np.stack([np.frombuffer(x, "<i2" if len(x) == 2 * dim else "<i8").astype(np.int64) for x in packed])


def _exact_type(a: np.ndarray, b: np.ndarray):
    """A type in which no sum of products of the two is rounded."""
    top = max(1, a.shape[1]) * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    return np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64 if top < 1 << 62 else object


class Slice:
    """Candidates in blocks of neighbours, each sorted by identifier, with term maxima and minima."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, weights: np.ndarray, code: np.ndarray):
        order = np.lexsort((rows, code))
        order = order[np.lexsort((ids[order], np.arange(len(order)) // BLOCK))]
        self.ids, self.rows, self.weights = ids[order], rows[order], weights[order]
        starts = np.arange(0, len(order), BLOCK)
        self.top, self.low = np.maximum.reduceat(self.weights, starts), np.minimum.reduceat(self.weights, starts)
        self.least_id = self.ids[starts]

    def search(self, rows: np.ndarray, weights: np.ndarray, floor: np.ndarray, floor_id: np.ndarray,
               k: int) -> tuple[np.ndarray, ...]:
        """(query, identifier, score) of at most ``k`` candidates a query, best first, those after
        (floor, floor_id) and the query's own row left out."""
        kind = _exact_type(weights, self.weights)
        q, c = weights.astype(kind), self.weights.astype(kind)
        none = -(1 << 200) if kind is object else -np.inf if kind != np.int64 else np.iinfo(np.int64).min
        bound = np.maximum(q, 0) @ self.top.astype(kind).T + np.minimum(q, 0) @ self.low.astype(kind).T
        order = np.argsort(-bound, axis=1, kind="stable")
        ranked = np.take_along_axis(bound, order, 1)
        kth = np.where(floor == np.iinfo(np.int64).min, none, floor.astype(kind))
        kth_id, at, step = floor_id.copy(), np.zeros(len(q), np.int64), 1
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind))
        live = np.arange(len(q))
        while len(live):
            # The next blocks of every query in its own order, then block by block.
            take = np.minimum(at[live, None] + np.arange(step), bound.shape[1] - 1)
            block, best = order[live[:, None], take], ranked[live[:, None], take]
            wanted = (at[live, None] + np.arange(step) < bound.shape[1]) & (
                (best > kth[live, None]) | ((best == kth[live, None]) & (self.least_id[block] <= kth_id[live, None])))
            who, block = np.broadcast_to(live[:, None], block.shape)[wanted], block[wanted]
            by_block = np.argsort(block, kind="stable")
            who, block = who[by_block], block[by_block]
            blocks, first = np.unique(block, return_index=True)
            hits = [found]
            for b, asked in zip(blocks.tolist(), np.split(who, first[1:]), strict=True) if len(blocks) else ():
                part = slice(b * BLOCK, (b + 1) * BLOCK)
                scores = q[asked] @ c[part].T
                scores[rows[asked, None] == self.rows[part][None, :]] = none
                some = scores.max(axis=1) >= kth[asked]
                scores, asked = scores[some], asked[some]
                pick = np.argsort(-scores, axis=1, kind="stable")[:, :k]  # ties: the smaller identifier
                value = np.take_along_axis(scores, pick, 1)
                r, s = np.nonzero((value >= kth[asked, None]) & (value > none))
                hits.append((asked[r], self.ids[part][pick[r, s]], value[r, s]))
            query, vec, score = (np.concatenate(x) for x in zip(*hits, strict=True))
            best_first = np.lexsort((vec, -score, query))
            query, vec, score = query[best_first], vec[best_first], score[best_first]
            start = np.searchsorted(query, query)
            keep = np.arange(len(query)) - start < k
            found = query, vec, score = query[keep], vec[keep], score[keep]
            last = np.flatnonzero(np.arange(len(query)) - np.searchsorted(query, query) == k - 1)
            full, value, vec_at = query[last], score[last], vec[last]
            better = (value > kth[full]) | ((value == kth[full]) & (vec_at < kth_id[full]))
            kth[full[better]], kth_id[full[better]] = value[better], vec_at[better]
            at[live] += step
            live = live[at[live] < bound.shape[1]]
            live = live[ranked[live, at[live]] >= kth[live]]
            step *= 2
        return found


def _search(key_dim: int, queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    out = []
    if len(queries) and len(candidates):
        dim, far = int(key_dim), np.iinfo(np.int64)
        held = Slice(candidates["vec_id"].to_numpy(), candidates["row"].to_numpy(),
                     _matrix(candidates["weights"], dim), candidates["code"].to_numpy())
        for a in range(0, len(queries), TILE):
            q = queries.iloc[a:a + TILE]
            at, vec, score = held.search(q["row"].to_numpy(), _matrix(q["weights"], dim), q["floor"].to_numpy(),
                                         q["floor_id"].to_numpy(), k)
            score = np.array([min(max(int(s), far.min), far.max) for s in score.tolist()], np.int64)
            out.append(pd.DataFrame({"row": q["row"].to_numpy()[at], "query_id": q["vec_id"].to_numpy()[at],
                                     "vec_id": vec, "score": score}))
    return pd.concat(out) if out else pd.DataFrame(columns=["row", "query_id", "vec_id", "score"])


def _home(k: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        asked = rows[rows["is_query"]].assign(floor=np.iinfo(np.int64).min, floor_id=np.iinfo(np.int64).max)
        return _search(key[0], asked, rows, k)
    return run


def _cell(k: int):
    def run(key: tuple, queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        # Nullable longs would pass through doubles, so a flag says where there is no floor.
        queries = queries.assign(floor=queries["floor"].where(queries["has_floor"], np.iinfo(np.int64).min),
                                 floor_id=queries["floor_id"].where(queries["has_floor"], np.iinfo(np.int64).max))
        return _search(key[0], queries, candidates.rename(columns=lambda c: c.removeprefix("c_")), k)
    return run


def top_products(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id",
                 vector_col: str = "embedding", slice_rows: int = SLICE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """For each row that ``queries`` selects, the ``k`` highest inner products of its weights,
    ``floor(scale * x)`` of each component x, with those of every other row: ``query_id``,
    ``rank`` (from 1), ``vec_id``, ``score`` (whole). Ties go to the smaller identifier; fewer
    rows come where there are fewer candidates.

    Vectors that are null or hold a null, a non-finite component or a weight of 2 ** 62 or more
    take no part, nor do null identifiers. Only vectors of one length are compared; empty ones
    score 0. Every row counts, also where identifiers repeat: each is a query and a candidate by
    itself, and only a query's own row is left out. Scores beyond 64 bits are held at that
    bound. An empty table gives no rows; extra columns are ignored.
    """
    v = vectors[vector_col].cast("array<double>")
    weight = lambda x: F.floor(x * float(scale))
    fits = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * float(scale)) < float(1 << 62)))
    rows = vectors.filter(vectors[id_col].isNotNull()).select(
        vectors[id_col].cast("bigint").alias("vec_id"), F.when(v.isNotNull() & fits, F.transform(v, weight)).alias("weights"),
        F.coalesce(queries, F.lit(False)).alias("is_query")).filter("weights is not null")
    packed = stored(rows.mapInPandas(_packed, ROWS).withColumn("row", F.monotonically_increasing_id()), "weights")
    sizes = packed.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_query").cast("bigint")).alias("q")).first()
    n_s, n_q = max(1, -(-sizes["n"] // slice_rows)), max(1, -(-(sizes["q"] or 0) // query_rows))
    sliced = stored(packed.repartitionByRange(n_s, "dim", "code", "row")
                    .withColumn("slice", F.spark_partition_id()), "slices")
    home = stored(sliced.groupBy("dim", "slice").applyInPandas(_home(k), HITS), "home")

    # The k-th result at home is what another slice has to reach.
    floors = home.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("score", (-F.col("vec_id")).alias("v"))).alias("m"))
    asked = sliced.filter("is_query").join(floors.withColumnRenamed("row", "f_row"), F.col("row") == F.col("f_row"), "left").select(
        "dim", "vec_id", "row", "weights", F.col("slice").alias("home"), (F.coalesce("n", F.lit(0)) == k).alias("has_floor"),
        F.coalesce("m.score", F.lit(0)).alias("floor"), F.coalesce(-F.col("m.v"), F.lit(0)).alias("floor_id"))
    grid = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = (asked.withColumn("qb", F.pmod(F.xxhash64("row"), F.lit(n_q)).cast("int"))
         .withColumn("slice", grid(n_s)).filter("slice <> home").drop("home"))
    c = sliced.select(*[F.col(x).alias(f"c_{x}") for x in ("dim", "vec_id", "row", "weights", "code", "slice")])
    c = c.withColumn("c_qb", grid(n_q))
    away = (q.groupBy("dim", "qb", "slice").cogroup(c.groupBy("c_dim", "c_qb", "c_slice"))
            .applyInPandas(_cell(k), HITS)) if n_s > 1 else home.limit(0)
    rank = F.row_number().over(W.partitionBy("row").orderBy(F.col("score").desc(), "vec_id"))
    return home.union(away).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
