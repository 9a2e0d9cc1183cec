"""Prefix trie, block top-k and filter audit against brute-force versions, with odd inputs."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from replicakit.llm import block_topk, filter_audit, prefix_trie

CONVERSATION = "conv_id bigint, turn bigint, role string, text string, key string, slice string, words string, node string, own int"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def conversations():
    rnd = random.Random(11)
    out = []
    for c in [*range(0, 140), -3, -20, -41, 1005, 10**15]:
        if c in (40, 60):  # groups without a first conversation
            continue
        n = rnd.choice([1, 1, 2, 3, 5, 9])
        for t in range(n):
            out.append((c, t, rnd.choice(["user", "assistant"]), rnd.choice(["hi there", "", "a b  c", None, f"only {c}"])))
    out += [(200 + i, t, "user", f"same {t}") for i in range(60) for t in range(4)]  # one conversation many times
    out += [(300, None, None, None), (300, 2, "user", "x"), (300, 2, "user", "x"), (300, 2, "bot", "y")]  # ties
    out += [(400, t, "user", f"long {t} " * 3) for t in range(300)]
    out += [(None, 1, "user", "no conversation")]
    rnd.shuffle(out)
    return [r + ("k", "s", "w", "n", 1) for r in out]


def brute_trie(rows, group=20, heads=4):
    turns = {}
    for c, turn, role, text, *_ in rows:
        role, text = role or "", text or ""
        tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
        if c is not None:
            turns.setdefault(c, []).append(((turn is not None, turn or 0, tie), (role, text)))
    own = {c: [x[1] for x in sorted(t)] for c, t in turns.items()}
    nodes = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - int(np.fmod(c, group)) if abs(c) < 10**9 else c - c % group
        full = tuple(own.get(base, [])[:h] + seq[h:])
        for d in range(len(full) + 1):
            nodes.setdefault(full[:d], []).append((c, len(full) == d))
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    below = {p: [0, 0] for p in nodes}
    for p, members in nodes.items():
        saved = (len(members) - 1) * (len(split(p[-1][1])) if p else 0)
        for d in range(len(p) + 1):
            below[p[:d]][0] += p not in children
            below[p[:d]][1] += saved
    least = {p: min(c for c, _ in m) for p, m in nodes.items()}
    return sorted(((least[p], len(p), least[p[:-1]] if p else None, len(m), len(children.get(p, [])), *below[p],
                    hashlib.sha256(",".join(str(c) for c, end in sorted(m) if end).encode()).hexdigest())
                   for p, m in nodes.items()), key=str)


@pytest.mark.parametrize("slice_bytes", [1 << 22, 1500])
def test_prefix_trie(spark, slice_bytes):
    df = spark.createDataFrame(conversations(), CONVERSATION).repartition(5)
    got = prefix_trie.prefix_trie(df, slice_bytes=slice_bytes)
    assert got.columns == prefix_trie.NODE
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(conversations())
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0


@pytest.mark.parametrize("segment_turns, slice_bytes", [(1, 1 << 22), (2, 1500), (3, 600), (7, 1 << 22), (64, 3000)])
def test_long_conversations_in_segments(spark, segment_turns, slice_bytes):
    """Conversations cut into segments, some ending where a segment does, shared beyond it or parting there."""
    rows = conversations()
    rows += [(500 + i, t, "user", f"deep {t} " + "z " * (i * (t >= 200 + i % 3))) + ("k", "s", "w", "n", 1)
             for i in range(6) for t in range(204)]
    df = spark.createDataFrame(rows, CONVERSATION).repartition(5)
    got = prefix_trie.prefix_trie(df, slice_bytes=slice_bytes, segment_turns=segment_turns)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(rows)


def test_one_conversation_spreads(spark):
    """One conversation with most turns, and one turn repeated: no row holds more than a segment of it."""
    rows = [(7, t % 90, "user", f"t {t % 50}") for t in range(400)] + [(9, 1, "user", "same")] * 150 + [(9, 0, "bot", "a b")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(6)
    segments = prefix_trie.rebuilt(df, segment_turns=16)
    shape = segments.selectExpr("conv_id", "segment", "last", "size(words) as n").collect()
    assert all(r.n == 16 if not r["last"] else r.n < 16 for r in shape) and sum(r.n for r in shape) == 551 - sum(
        zlib.crc32(str(c).encode()) % 4 for c in (7, 9))
    placed, _ = prefix_trie._numbered(df.selectExpr("conv_id", "turn", "md5(concat(role, text)) as symbol", "1L as words"))
    assert sorted(r.place for r in placed.filter("conv_id = 7").collect()) == list(range(400))
    assert placed.groupBy("conv_id").agg(F.countDistinct("place").alias("d")).filter("conv_id = 9").first().d == 151
    got = prefix_trie.prefix_trie(df, segment_turns=16, slice_bytes=1000)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(rows)


def test_slices_join():
    """Every way to cut sorted conversations into slices gives the same sums."""
    rnd = random.Random(4)
    keys = sorted(b"".join(bytes([rnd.randint(0, 1)]) * 16 for _ in range(rnd.randint(0, 4))) for _ in range(40))
    words = [[k[16 * d] + 1 for d in range(len(k) // 16)] for k in keys]
    ids = list(range(40))
    whole = prefix_trie.slice_nodes(ids, keys, words, None, None, 0)
    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    expect = whole.groupby("node")[sums].sum().sort_index()
    for cuts in ([7], [1, 2, 3], [20, 39], sorted(rnd.sample(range(1, 40), 12))):
        edges = [0, *cuts, 40]
        parts = []
        for a, b in zip(edges, edges[1:], strict=False):
            parts.append(prefix_trie.slice_nodes(ids[a:b], keys[a:b], words[a:b], keys[a - 1] if a else None,
                                                 keys[b] if b < 40 else None, a))
        joined = pd.concat(parts)
        assert joined.groupby("node")[sums].sum().sort_index().equals(expect)
        # Only what crosses a cut comes in more than one slice.
        assert joined[~joined["is_open"]]["node"].is_unique


def test_range_minimum():
    rnd = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64):
        values = np.append(-1, rnd.integers(0, 5, n - 1))
        table = prefix_trie.RangeMinimum(values)
        at, depth = np.repeat(np.arange(n), 5), np.tile(np.arange(5), n)
        left, right = table.extents(at, depth)
        for i, d, lo, hi in zip(at.tolist(), depth.tolist(), left.tolist(), right.tolist(), strict=True):
            assert all(values[j] >= d for j in range(lo + 1, hi + 1)) and lo <= i <= hi
            assert (lo == 0 or values[lo] < d) and (hi == n - 1 or values[hi + 1] < d)
        assert (table.least(left, right) == [values[a:b + 1].min() for a, b in zip(left, right, strict=True)]).all()


VECTOR = "vec_id bigint, embedding array<double>, row string, slice string, code int, weights string"


def vectors():
    rnd = random.Random(6)
    out = [(i, [rnd.gauss(0, 0.3) for _ in range(7)]) for i in range(300)]
    out += [(i, [0.5, -0.25, 0.1, 0.0, 0.3, 0.2, -0.1]) for i in range(300, 420)]  # ties
    out += [(50, [1.0] * 7), (50, [1.0] * 7), (50, [-1.0] * 7), (500, [3e9, -2e9, 1.0, 0.0, 0.0, 0.0, 0.0])]
    out += [(600, [0.0] * 7), (601, None), (602, [None] * 7), (603, [float("nan")] * 7), (604, [float("inf")] * 7),
            (None, [1.0] * 7), (650, [1.0, 2.0]), (651, [-1.0, 2.0]), (700, []), (701, [])]
    return [r + ("r", "s", 1, "w") for r in out]


def brute_topk(rows, k):
    ok = [(i, r[0], [int(np.floor(x * 256)) for x in r[1]]) for i, r in enumerate(rows)
          if r[0] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    out = []
    for i, q, v in ok:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for j, c, w in ok if j != i and len(w) == len(v))
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize(("slice_rows", "query_rows", "k"), [(8192, 8192, 5), (100, 3, 5), (130, 8192, 1), (90, 4, 200)])
def test_block_topk(spark, slice_rows, query_rows, k):
    df = spark.createDataFrame(vectors(), VECTOR).repartition(4)
    got = block_topk.top_products(df, F.col("vec_id") % 50 == 0, k=k, slice_rows=slice_rows, query_rows=query_rows)
    assert sorted(tuple(r) for r in got.collect()) == brute_topk(vectors(), k)
    assert block_topk.top_products(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_blocks_are_passed_over():
    """Clustered rows: after the own cluster's blocks, bounds fall below the k-th score."""
    rnd = np.random.default_rng(2)
    centres = rnd.integers(-100, 100, (32, 16))
    weights = np.repeat(centres, 64, axis=0) + rnd.integers(-3, 4, (2048, 16))
    code = np.repeat(np.arange(32), 64)
    held = block_topk.Slice(np.arange(2048), np.arange(2048), weights, code)
    q = weights[::64]
    far = np.iinfo(np.int64)
    at, vec, score = held.search(np.arange(0, 2048, 64), q, np.full(32, far.min), np.full(32, far.max), 5)
    expect = q @ weights.T
    expect[np.arange(32), np.arange(0, 2048, 64)] = far.min
    best = np.sort(expect, axis=1)[:, ::-1][:, :5]
    assert (score.reshape(32, 5) == best).all()
    bound = np.maximum(q, 0) @ held.top.T + np.minimum(q, 0) @ held.low.T
    # What the bounds leave to score is a small part of all (query, block) pairs.
    assert (bound >= best[:, -1:]).sum() < 0.25 * bound.size


DOCUMENT = "doc_id bigint, text string, source string, digest string, part string, mask int, n int, good int"


def documents():
    rnd = random.Random(8)
    out = []
    for i in range(150):
        words = [rnd.choice(["alpha", "beta", "Gamma", "DELTA", f"w{rnd.randint(0, 99)}"]) for _ in range(rnd.choice([10, 49, 50, 80]))]
        out.append((i, " ".join(words) + rnd.choice(["", "", " #", " A|B"]), rnd.choice(["s1", "s2", None, ""])))
    out += [(200 + i, "copied text", rnd.choice(["s1", "s2"])) for i in range(40)]
    out += [(200, "copied text", "s1"), (199, "copied text", "s2"), (199, "copied text", "s1"), (None, "copied text", "s1"),
            (None, None, None), (7, None, "s3"), (8, "", "s3"), (9, "  \n", "s3"), (10, "x" * 70_000 + " y" * 30_000, "s3")]
    return [r + ("d", "p", 1, 2, 3) for r in out]


def brute_audit(rows, labels):
    fails, least = [], {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, text, source, *_ in rows:
        t, w = text or "", split(text or "")
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
             "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        own = [x for x in labels if x[0] == i and i is not None]
        fails.append((source or "", f, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = []
    for part in {f[0] for f in fails}:
        docs = [f for f in fails if f[0] == part]
        rows_of, total = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = docs
            for step, name in enumerate(order, 1):
                gone = [d for d in left if d[1][name]]
                left = [d for d in left if not d[1][name]]
                total[name] += len(gone)
                rows_of.append((part, "".join(order), step, len(left), len(gone), sum(d[1][name] for d in docs) - len(gone),
                                sum(d[1][name] and sum(d[1].values()) == 1 for d in docs), sum(d[2] for d in gone),
                                sum(d[3] for d in gone), name))
        out += [(*r[:-1], total[r[-1]]) for r in rows_of]
    return sorted(out)


def test_filter_audit(spark):
    labels = [(i, i % 3, i % 2) for i in range(0, 240, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (200, None, 1)]
    df = spark.createDataFrame(documents(), DOCUMENT).repartition(4)
    rated = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("good", F.lit("x"))
    got = filter_audit.audit_filters(df, rated)
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(documents(), labels)
    assert filter_audit.audit_filters(df.limit(0), rated).count() == 0
    assert filter_audit.audit_filters(df, rated.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_potentials():
    """Shapley by potentials equals the mean over orders, for any game."""
    rnd = random.Random(9)
    worth = [0] + [rnd.randint(0, 100) for _ in range(31)]
    expect = [0] * 5
    for order in permutations(range(5)):
        s = 0
        for i in order:
            expect[i] += worth[s | 1 << i] - worth[s]
            s |= 1 << i
    assert filter_audit.shapley_totals(worth, 5) == expect
