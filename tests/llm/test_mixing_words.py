"""Mixes of more words than an int times a weight holds: each word counts as ten million."""

import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import pytest

import corpus_pipeline
from replicakit.llm import mixing, queries

SCALE = 10_000_000


@pytest.fixture
def many_words(monkeypatch):
    real = mixing.word_count
    monkeypatch.setattr(mixing, "word_count", lambda text: real(text) * SCALE)


def documents(words):
    """(doc_id, text, source): plain words, about ``words`` in all, sources of unequal size."""
    rnd, out = random.Random(words), []
    while (left := words - sum(len(t.split()) for _, t, _ in out)) > 0:
        source = rnd.choice(["a", "a", "a", "a", "b", "c", "d", None])
        out.append((len(out), " ".join(rnd.choices(["one", "two", "three"], k=min(left, rnd.randint(1, 5)))), source))
    return out


def taken(docs):
    """Words taken of each document, in whole numbers and fractions; all qualities are 1."""
    size = {i: len(t.split()) * SCALE for i, t, _ in docs}
    order = sorted({s for *_, s in docs}, key=lambda s: (s is None, s or ""))
    own = {s: sum(size[i] for i, _, x in docs if x == s) for s in order}
    weight, capped = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}, set()
    while True:
        words = sum(own.values()) - sum(3 * own[s] for s in capped)
        parts = sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and Fraction(words * weight[s], parts) > 3 * own[s]}
        if not over:
            break
        capped |= over
    out = {}
    key = lambda i: -math.log((int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52)
    for s in order:
        budget = 3 * own[s] if s in capped else math.floor(Fraction(words * weight[s], parts) + Fraction(1, 2))
        epochs, rest = divmod(budget, own[s])
        for i in sorted((i for i, _, x in docs if x == s), key=key):
            part = min(size[i], rest)
            out[i], rest = epochs * size[i] + part, rest - part
    return out, size


def test_the_pipelines_mix_of_many_words(spark, many_words):
    """1.6 billion words: every whole copy and every part is there."""
    docs = documents(160)
    expect, size = taken(docs)
    assert 2 ** 31 / 3 < sum(size.values()) < 2 ** 31
    given = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in docs],
                                  "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.mix_sources(spark, given, "").collect()
    assert Counter(r.doc_id for r in got) == Counter({i: -(-n // size[i]) for i, n in expect.items()})
    assert {(r.doc_id, r.text, r.source) for r in got} == {d for d in docs if expect[d[0]]}


@pytest.mark.parametrize("words", [70, 72, 160, 214, 216])
def test_op4_around_the_bounds_of_an_int(spark, tmp_path, many_words, words):
    """Totals below and above 2^31 / 3 and 2^31: targets and words taken are exact."""
    docs = documents(words)
    expect, size = taken(docs)
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op4_mixing(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r["size"], r.taken) for r in got} == {i: (size[i], n) for i, n in expect.items()}
    assert len(got) == len(docs) and sum(r.taken for r in got) == pytest.approx(words * SCALE, abs=3)
