"""Quality classifier: logistic regression over hashed word n-grams, trained with
follow-the-regularised-leader (FTRL-proximal) updates and scored as sparse dot products.

Features of a text are the words, adjacent word pairs, punctuation runs and the shapes of
adjacent tokens, hashed to ``2 ** bits`` dimensions; their values are root-scaled counts
of unit length, so long and short texts weigh alike.

Training takes a bounded sample of the labelled rows (``sample`` rows with the smallest
digests of their identifiers). FTRL is sequential, so the sample is one task's work by
default; with more ``shards`` each runs over its rows and the weight vectors are averaged,
which takes a larger sample for the same accuracy. What reaches the driver and is broadcast
is the averaged vector: at most ``2 ** bits`` weights, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replicakit.llm.common import slices, stored, text_of
from replicakit.llm.tokens import Tokens, ngram, tokens

BITS = 18
SAMPLE = 10_000
SHARDS = 1

#: Bytes of text that are tokenised at a time.
CHUNK = 1 << 20


def _shape(t: Tokens) -> np.ndarray:
    """What a token looks like: its class, case and length class."""
    case = np.where(t.upper == 0, 0, np.where(t.upper >= np.maximum(2, t.size // 2), 2, 1))
    return (t.word * 12 + case * 4 + np.minimum(t.size, 15) // 4).astype(np.uint64) + np.uint64(1)


def features(texts: list[bytes], bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(dimensions, values) of each text; empty for texts without tokens. Words count in
    every text in full: nothing is cut off."""
    t = tokens(texts)
    shape = _shape(t)
    same = t.doc[1:] == t.doc[:-1]
    twice = t.hash[1:] == t.hash[:-1]
    pair = np.where(twice, np.uint64(7), ngram(t.hash[1:], t.hash[:-1], 2))
    parts = [(ngram(t.hash, shape * np.uint64(0), 1), t.doc),
             (ngram(pair, pair * np.uint64(0), 3)[same], t.doc[1:][same]),
             (ngram(shape[1:], shape[:-1], 4)[same], t.doc[1:][same])]
    key = np.concatenate([(h >> np.uint64(64 - bits)).astype(np.int64) | d << bits for h, d in parts])
    keys, counts = np.unique(key, return_counts=True)
    values = np.sqrt(counts)
    bounds = np.searchsorted(keys, np.arange(len(texts) + 1) << bits)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        v = values[a:b]
        unit = v / np.sqrt((v * v).sum()) if b > a else v
        out.append(((keys[a:b] & (1 << bits) - 1).astype(np.int32), unit.astype(np.float32)))
    return out


def in_chunks(texts: list[bytes], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for a, b in slices([len(t) for t in texts], CHUNK):
        yield from features(texts[a:b], bits)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dims: int, epochs: int = 3,
         alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> np.ndarray:
    """Weights after ``epochs`` passes of FTRL-proximal over the rows; dimension ``dims`` is
    the intercept."""
    z, n = np.zeros(dims + 1), np.zeros(dims + 1)

    def weights(at):
        big = np.abs(z[at]) > l1
        return np.where(big, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    rng = np.random.default_rng(10)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)).tolist():
            at, x = np.append(rows[r][0], dims), np.append(rows[r][1], 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - labels[r]) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(dims + 1))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
          text_col: str = "text", bits: int = BITS, sample: int = SAMPLE, shards: int = SHARDS) -> np.ndarray:
    """The averaged weights. ``labels`` holds the rows to learn from; rows with a null label
    or identifier are passed over, of repeated labels of an identifier the largest counts, and
    of different texts the smallest. Without any labelled text the weights are zero."""
    chosen = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
              .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("y"))
              .orderBy(F.xxhash64("id"), "id").limit(sample))  # at most `sample` small rows
    texts = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).cast("binary").alias("body"))
    # One row per identifier, combined map-side: repeats of one cannot swell the fitting task.
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("body").alias("body"), F.max("y").alias("y")) \
        .withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        w = ftrl(list(in_chunks([bytes(b) for b in group["body"]], bits)), group["y"].to_numpy(), 1 << bits)
        at = np.flatnonzero(w)
        return pd.DataFrame({"at": at, "w": w[at], "rows": len(group)})

    fitted = rows.groupBy("shard").applyInPandas(fit, "at bigint, w double, rows bigint")
    found = stored(fitted, "quality-model").groupBy("at").agg(F.sum("w").alias("w")).toPandas()
    weights = np.zeros((1 << bits) + 1)
    weights[found["at"].to_numpy()] = found["w"].to_numpy() / shards
    return weights


def score_column(docs: DataFrame, weights: np.ndarray, text: Column, bits: int = BITS) -> Column:
    """The score (0 to 1) as a column: only the text travels to Python. It depends on the text
    only; null, empty and blank texts get the intercept's score."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    @F.pandas_udf("double")
    def run(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shared.value.astype(np.float64)
        for batch in bodies:
            logit = np.array([w[at] @ x for at, x in in_chunks([bytes(b) for b in batch], bits)]) + w[-1]
            yield pd.Series(1 / (1 + np.exp(-np.clip(logit, -30, 30))))

    return run(text.cast("binary"))


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``score``. An empty table gives no rows;
    repeated rows score alike; extra columns are ignored. There is no shuffle."""
    return docs.select(docs[id_col].alias("doc_id"),
                       score_column(docs, weights, text_of(docs, text_col), bits).alias("score"))
