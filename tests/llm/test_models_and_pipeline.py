"""The models against versions written out in plain Python, and the whole pipeline against one."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from replicakit.llm import byte_bpe, mixing, quality, toxicity
from replicakit.llm.queries import TOKENIZER
from replicakit.session import shared_dir

TEXTS = ["You are a Vile vile fool, vile and foul", "a kind and gentle word", "vile foul vile foul vile foul", "", "  ",
         "kind words are kind to all", "Der Hund ist böse, böse böse!", "fool fool fool", "gentle gentle kind gentle", "x"]
TOXIC = [1, 0, 1, 0, 0, 0, 1, 1, 0, 0]


def plain_words(text):
    return [w.lower() for w in re.findall(rb"[A-Za-z0-9\x80-\xff]+", text.encode())]


def histories(word):
    """(the five symbols before, the symbol) at each place of a word and at its end."""
    symbols = [2] * 5 + list(word) + [1]
    return [(tuple(symbols[i - 5:i]), symbols[i]) for i in range(5, len(symbols))]


def plain_kneser_ney(texts, toxic):
    """Log ratio of a word, from counts in dictionaries."""
    before = defaultdict(set)
    for t in texts:
        for w in plain_words(t):
            for h, s in histories(w):
                for n in range(1, 6):
                    before[(*h[6 - n:], s)].add(h[5 - n])
    shared = defaultdict(dict)
    for gram, left in before.items():
        shared[gram[:-1]][gram[-1]] = len(left)

    def low(h, s, n):
        if n == 0:
            return 1 / 256
        known = shared.get(h[6 - n:], {})
        total = sum(known.values())
        if not total:
            return low(h, s, n - 1)
        return max(known.get(s, 0) - 0.75, 0) / total + 0.75 * len(known) / total * low(h, s, n - 1)

    logs = []
    for y in (1, 0):
        counts = defaultdict(Counter)
        for t, label in zip(texts, toxic, strict=True):
            if label == y:
                for w in plain_words(t):
                    for h, s in histories(w):
                        counts[h][s] += 1

        def log(h, s, counts=counts):
            c = counts.get(h, Counter())
            total = sum(c.values())
            held = sum(min(x, 4.0) for x in c.values()) / total if total else 1.0
            return math.log((max(c.get(s, 0) - 4.0, 0) / total if total else 0) + held * low(h, s, 5))
        logs.append(log)
    return lambda word: sum(logs[0](h, s) - logs[1](h, s) for h, s in histories(word))


def test_kneser_ney_against_dictionaries(spark):
    texts, toxic = TEXTS * 3, TOXIC * 3
    rows = spark.createDataFrame(list(zip(texts, toxic, strict=True)), "text string, toxic int").repartition(3)
    body = rows.select(F.col("text").cast("binary").alias("body"), "toxic")
    seen = toxicity.evidence(toxicity.class_counts(body)).toPandas()
    grams = seen["gram"].to_numpy(np.int64).view(np.uint64)
    model = toxicity.build(seen, toxicity.continuation_counts(body.select("body"), toxicity.contexts(grams)).toPandas())
    ratio = plain_kneser_ney(texts, toxic)
    asked = [*TEXTS, "vilely unseen foulness", "böse kind", "zzz"]
    for text, got in zip(asked, toxicity.figures([t.encode() for t in asked], model), strict=True):
        r = [ratio(w) for w in plain_words(text)]
        mean = sum(r) / len(r) if r else 0.0
        worst = max((sum(r[max(0, i - 1):i + 1]) / 2 for i in range(len(r))), default=0.0)
        assert got == pytest.approx([mean, worst], abs=1e-9), text


def plain_features(text):
    """Counts of words, word pairs and pairs of shapes, by what they are."""
    tokens = re.findall(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\x00-\x20\x7f]+", text.encode())
    low = [t.lower() for t in tokens]

    def shape(t):
        upper = sum(65 <= b <= 90 for b in t)
        case = 0 if upper == 0 else 2 if upper >= max(2, len(t) // 2) else 1
        return bool(re.match(rb"[A-Za-z0-9\x80-\xff]", t)), case, min(len(t), 15) // 4
    found = Counter(("word", t) for t in low)
    for i in range(1, len(tokens)):
        found["again" if low[i] == low[i - 1] else ("pair", low[i], low[i - 1])] += 1
        found["shape", shape(tokens[i]), shape(tokens[i - 1])] += 1
    return found


def test_features_and_ftrl_against_plain_loops():
    texts = [*TEXTS, "Visit NOW!!! FREE free Free $$$ at 10:30", "été ÉTÉ a-b_c"]
    got = quality.features([t.encode() for t in texts])
    for text, (at, value) in zip(texts, got, strict=True):
        counts = plain_features(text)
        norm = math.sqrt(sum(counts.values()))
        assert len(set(at.tolist())) == len(counts)
        assert sorted(value.tolist()) == pytest.approx(sorted(math.sqrt(c) / norm for c in counts.values()), abs=1e-6)
    # The same word has the same dimension in any text.
    assert set(quality.features([b"kind"])[0][0]) <= set(got[1][0].tolist())
    labels, dims = np.array([*TOXIC, 1, 0], float), 1 << quality.BITS
    z, n = defaultdict(float), defaultdict(float)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.01

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    rng = np.random.default_rng(10)
    for _ in range(3):
        for r in rng.permutation(len(got)).tolist():
            x = {**dict(zip(got[r][0].tolist(), got[r][1].tolist(), strict=True)), dims: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - labels[r]) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    learned = quality.ftrl(got, labels, dims)
    assert {i for i in np.flatnonzero(learned).tolist()} == {i for i in list(z) if weight(i)}
    for i in np.flatnonzero(learned).tolist():
        assert learned[i] == pytest.approx(weight(i), abs=1e-6)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def plain_simhash(text):
    w = ["".join(c.lower() if c.isascii() else c for c in x) for x in words(text)]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_mix(docs):
    """(doc_id, text) of the mix: targets, whole epochs, then keys."""
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len(words(text))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        parts = sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and left * weight[s] / parts > 3 * sizes[s]} if parts else set()
        if not over:
            break
        capped |= over
    out = []
    for s in order:
        target = 3.0 * sizes[s] if s in capped else left * weight[s] / parts
        budget = math.floor(target + 0.5)
        epochs = budget // sizes[s] if sizes[s] else 0
        rest = budget - epochs * sizes[s]
        keyed = []
        for i, text, source in docs:
            if source == s:
                u = (int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
                solid = [c for c in text if c not in " \t\n\x0b\x0c\r"]
                q = max(0.05, sum(c not in mixing.JUNK for c in solid) / len(solid)) if solid else 0.05
                keyed.append((-math.log(u) / q, i, text))
        for _, i, text in sorted(keyed):
            n = len(words(text))
            part = max(0, min(n, rest))
            rest -= part
            out += [(i, text)] * (epochs + (part == n and n > 0)) + ([(i, " ".join(words(text)[:part]))] if 0 < part < n else [])
    return out


def test_the_whole_pipeline(spark, tmp_path):
    """run() over tables on disk, against every stage written out."""
    rnd = random.Random(21)
    vocabulary = [f"word{i}" for i in range(300)]
    docs = []
    for i in range(150):
        good = i % 4 > 0
        text = " ".join(rnd.choice(vocabulary) if good else "$$$!!! BUY " + str(rnd.randint(0, 9)) for _ in range(rnd.randint(5, 80)))
        docs.append((i, text, "en", ["s1", "s2", None, "s3"][rnd.randint(0, 3)], len(text)))
    docs += [(200 + i, docs[9][1], "en", "s2", 0) for i in range(20)]  # copies
    docs += [(300 + i, docs[i][1] + " end", "en", "s1", 0) for i in (1, 2, 3, 5, 6, 7)]  # near copies
    docs += [(400, None, "en", "s1", None), (401, "", None, None, 0), (402, "été " * 60, "fr", "s2", 240)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i % 4 > 0), 0) for i in range(150)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    taught = spark.createDataFrame([x for x in labels if zlib.crc32(str(x[0]).encode()) % 5], "doc_id bigint, quality int, toxic int")
    w = quality.train(given, taught)
    keep = []
    for i, text, _, source, _ in docs:
        at, value = quality.features([(text or "").encode()])[0]
        w32 = w.astype(np.float32).astype(float)
        if 1 / (1 + math.exp(-(w32[at] @ value + w32[-1]))) >= 0.3:
            keep.append((i, text or "", source))
    assert len(docs) > len(keep) > 100
    largest = {}
    for d in keep:
        largest[d[1]] = max(largest.get(d[1], d), d, key=lambda x: x[0])
    keep = sorted(largest.values(), key=lambda d: d[0])
    fps = [plain_simhash(d[1]) for d in keep]
    parent = list(range(len(keep)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(keep)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    near = [d for i, d in enumerate(keep) if root(i) == i]
    assert len(near) < len(keep)
    ranks = byte_bpe.load_ranks(public_tokenizers.path(TOKENIZER))
    tok = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expect = []
    for i, text in plain_mix(near):
        ids = tok.encode_ordinary(text)
        expect.append((i, len(ids), np.array(ids, "<u4").tobytes(), hashlib.sha256(text.encode()).hexdigest()))
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    held = lambda: {s.getPath().getName() for s in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)}
    before = held()
    got = [(r.doc_id, r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(expect)
    assert [x.rsplit("-", 1)[0] for x in held() - before] == ["stage-mixing"]  # what the last stage reads
