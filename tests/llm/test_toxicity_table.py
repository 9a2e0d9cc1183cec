"""A toxicity model that stays a table gives what the broadcast one gives."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from replicakit.llm import toxicity

MILD, VILE = "alpha beta gamma delta omega".split(), "zorgvile foulest brutish".split()


def sentence(rnd, toxic):
    words = [rnd.choice(MILD) + str(rnd.randint(0, 99)) for _ in range(15)]
    return " ".join(words + [rnd.choice(VILE)] * toxic)


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(3)
    return [(i, sentence(rnd, int(i % 4 == 0)), int(i % 4 == 0)) for i in range(400)]


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data, "doc_id bigint, text string, toxic int").repartition(3)


def tables(frame):
    body = frame.select(F.col("text").cast("binary").alias("body"), "toxic")
    seen = toxicity.evidence(toxicity.class_counts(body))
    return body, seen, seen.toPandas()


def test_contexts_as_rows(spark, frame):
    _, seen, held = tables(frame)
    got = {(r.n, r.context) for r in toxicity.context_rows(seen).collect()}
    listed = toxicity.contexts(held["gram"].to_numpy(np.int64).view(np.uint64))
    assert got == {(n, int(c)) for n, found in listed.items() for c in found}


def test_counts_and_parts_equal_the_broadcast_model(spark, frame):
    body, seen, held = tables(frame)
    listed = toxicity.contexts(held["gram"].to_numpy(np.int64).view(np.uint64))
    plain = toxicity.continuation_counts(body.select("body"), listed)
    joined = toxicity.continuation_counts(body.select("body"), toxicity.context_rows(seen))
    as_set = lambda df: {(r.n, r.gram, r["count"]) for r in df.collect()}
    assert as_set(plain) == as_set(joined) and plain.count() == joined.count()
    want = toxicity.build(held, plain.toPandas())
    for parts in (1, 7):
        rows = toxicity.build_table(seen, joined, parts).rows.toPandas().sort_values("key")
        for is_context, keys, values in ((False, want.grams, want.ratios), (True, want.contexts, want.weights)):
            part = rows[rows["context"] == is_context]
            assert np.array_equal(part["key"].to_numpy(np.int64).view(np.uint64), keys)
            assert np.array_equal(part["value"].to_numpy(), values)


def test_scores_are_the_same(spark, frame, data):
    labels = frame.select("doc_id", "toxic")
    small = toxicity.train(frame, labels, sample=200)
    large = toxicity.train(frame, labels, sample=200, model_rows=10)
    assert isinstance(small.model, toxicity.Model) and isinstance(large.model, toxicity.TableModel)
    assert large.middle == pytest.approx(small.middle, abs=1e-9) and large.scale == pytest.approx(small.scale, abs=1e-9)
    big = (1 << 60) + 1  # would not survive as a float
    rows = [*[(i, t) for i, t, _ in data], (big, "zorgvile zorgvile"), (None, "alpha7 foulest"), (5, None), (6, ""), (7, "  \n"),
            (8, "x" * 300_000 + " brutish"), *[(9, "delta3 foulest brutish")] * 50]
    asked = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "doc_id bigint, text string, score double, figure int").repartition(4)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.score)
    want, got = (sorted(toxicity.score(asked, s).collect(), key=key) for s in (small, large))
    assert [r.doc_id for r in got] == [r.doc_id for r in want] and len(got) == len(rows)
    assert np.allclose([r.score for r in got], [r.score for r in want], rtol=0, atol=1e-9)
    assert next(r.score for r in got if r.doc_id == big) > 0.7
    # Many shards: every one has the entries of its own n-grams.
    texts = asked.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    one, many = (sorted((r.doc_id is None, r.doc_id or 0, round(r.figure, 9) + 0.0) for r in toxicity.measured(texts, m, 2000).collect())
                 for m in (small.model, large.model))
    assert one == many
    assert toxicity.score(asked.limit(0), large).count() == 0


def test_table_model_of_nothing(spark, frame):
    """No labelled row: the table has no entry, and no score is high."""
    none = frame.select("doc_id", "toxic").limit(0)
    scorer = toxicity.train(frame, none, model_rows=-1)
    assert isinstance(scorer.model, toxicity.TableModel) and scorer.model.rows.count() == 0
    got = toxicity.score(frame, scorer).collect()
    assert len(got) == 400 and all(r.score < 0.7 for r in got)
