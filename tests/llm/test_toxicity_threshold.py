"""The threshold of the toxicity model is the best of all rows held out, in parts or not."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from replicakit.llm import toxicity


def best_f1(pairs):
    """The threshold by trying every figure."""
    f = sorted({x for x, _ in pairs}, reverse=True)
    toxic = sum(y for _, y in pairs)
    score = [2 * sum(y for x, y in pairs if x >= t) / (sum(x >= t for x, _ in pairs) + max(1, toxic)) for t in f]
    i = int(np.argmax(score))
    return (f[i] + f[min(i + 1, len(f) - 1)]) / 2


@pytest.mark.parametrize("part", [1, 7, 10**6])
@pytest.mark.parametrize("kind", ["mixed", "ties", "one", "all toxic"])
def test_threshold_against_every_figure(spark, part, kind):
    rnd = np.random.default_rng(9)
    y = rnd.integers(0, 2, 60).tolist()
    x = [float(a + b) for a, b in zip(rnd.normal(size=60), y, strict=True)]
    if kind == "ties":
        x = [float(round(a)) for a in x]
    x, y = ([1.5], [1]) if kind == "one" else (x, [1] * 60) if kind == "all toxic" else (x, y)
    pairs = list(zip(x, y, strict=True))
    each = spark.createDataFrame(pairs, "figure double, toxic int").groupBy("figure").agg(
        F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic"))
    assert toxicity.threshold(each, part) == best_f1(pairs)


def test_every_labelled_row_is_counted_or_sets_the_threshold(spark, monkeypatch):
    n, seen = 20_000, {}
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id") % 50).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("toxic"))
    for name in ("class_counts", "measured"):
        def counting(rows, *a, _name=name, _real=getattr(toxicity, name)):
            seen[_name] = rows.count()
            return _real(rows, *a)
        monkeypatch.setattr(toxicity, name, counting)
    toxicity.train(docs, labels)
    held_out = labels.filter(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(5)) == 0).count()
    assert seen == {"class_counts": n - held_out, "measured": held_out} and held_out > 3500
