"""Substring dedup by repeated-phrase automata.

1. Census: every window of ``window`` words is stood for by the least hash of its short
   phrases (a minimiser), so equal windows are stood for by the same hash. Hashes that stand
   for something more than once, or in one shard more than once, mark windows worth a look.
2. Confirm: shards of documents send a 128-bit digest of each such window and how often it
   starts there; windows whose digest starts at two places or more are recurring phrases.
3. Locate: each shard compiles one Aho-Corasick automaton of the recurring phrases that lie in
   its documents (end to end along a passage, as sequences of the shard's word numbers) and
   streams all its documents through it. Words that an occurrence covers are removed.

A shard is a bounded slice of the documents (``shard_bytes`` on average, by a hash of the
identifier and text), so automata stay small and every document passes through just one, however
large the corpus. Rows that repeat both are one document with a number of copies. Hashes and
digests are summed by each task before they are shuffled, so a passage that all documents share
sends a row per task, not per document; the hashes' join back to the shards is of two written tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress, repeat
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from replicakit.llm.common import slices, stored

#: Words of the short phrases that windows are stood for by.
PHRASE = 16
SHARD_BYTES = 8 << 20

#: Bytes of text that are hashed at a time; longer texts are cut into overlapping stretches.
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    return tuple(np.cumprod(np.append(np.uint64(1), np.full(n, b, np.uint64))) for b in (BASE, pow(BASE, -1, 1 << 64)))


POWERS, INVERSES = _powers(CHUNK * 2)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


@dataclass
class Stretch:
    """Parts of texts, their words joined by single spaces; parts are joined by newlines."""

    joined: bytes
    start: np.ndarray  # first byte of each word
    end: np.ndarray    # byte after it
    part: np.ndarray   # its part
    text: np.ndarray   # the text of its part

    def windows(self, window: int) -> np.ndarray:
        """First words of the windows that lie in one part."""
        return np.flatnonzero(self.part[:len(self.part) - window + 1] == self.part[window - 1:])


def stretches(texts: list[bytes], window: int) -> Iterator[Stretch]:
    """The texts in order; parts of one text overlap by ``window - 1`` words, so every window is
    in just one. Texts with fewer words than a window are left out."""
    held: list[tuple[int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        words, at = text.split(), 0
        while len(words) - at >= window:
            part = words[at:at + CHUNK // 8]
            joined = b" ".join(part)
            if len(joined) > CHUNK:  # long words: fewer of them
                part = part[:max(window, len(part) * CHUNK // len(joined) // 2)]
                joined = b" ".join(part)
            if held and size + len(joined) > CHUNK:
                yield _laid(held)
                held, size = [], 0
            held.append((i, joined))
            size += len(joined) + 1
            if at + len(part) >= len(words):
                break
            at += len(part) - window + 1
    if held:
        yield _laid(held)


def _laid(held: list[tuple[int, bytes]]) -> Stretch:
    joined = b"\n".join(t for _, t in held) + b"\n"
    buf = np.frombuffer(joined, np.uint8)
    end = np.flatnonzero((buf == 32) | (buf == 10))
    start = np.append(0, end[:-1] + 1)
    part = np.cumsum(np.append(False, buf[end[:-1]] == 10))
    return Stretch(joined, start, end, part, np.array([i for i, _ in held])[part])


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each ``width`` neighbours, by doubling."""
    covered = 1
    while covered * 2 <= width:
        x = pick(x[:-covered], x[covered:])
        covered *= 2
    rest = width - covered
    return pick(x[:len(x) - rest], x[rest:]) if rest else x


def minimisers(s: Stretch, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each phrase, the least in each window); windows over the end of a part, too."""
    code = np.frombuffer(s.joined, np.uint8).astype(np.uint64) + np.uint64(1)
    powers, inverses = (POWERS, INVERSES) if len(code) < len(POWERS) else _powers(len(code))
    run = np.append(np.uint64(0), np.cumsum(code * powers[:len(code)]))
    begin = s.start[:len(s.start) - PHRASE + 1]
    phrase = _mix((run[s.end[PHRASE - 1:]] - run[begin]) * inverses[begin])
    return phrase, _sliding(phrase, window - PHRASE + 1, np.minimum)


def chosen(s: Stretch, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of phrases that stand for a window, and their hashes: a phrase does if it is
    as small as the least hash of one of the windows that hold it."""
    phrase, low = minimisers(s, window)
    valid = np.zeros(len(low), bool)
    valid[s.windows(window)] = True
    edge = np.zeros(window - PHRASE, np.uint64)
    best = _sliding(np.concatenate([edge, np.where(valid, low, np.uint64(0)), edge]), window - PHRASE + 1, np.maximum)
    place = np.flatnonzero(best == phrase)
    return place, phrase[place]


def _census(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shards, copies = batch["shard"].to_numpy(), batch["copies"].to_numpy()
            texts = [bytes(b) for b in batch["body"]]
            for a, b in slices([len(t) for t in texts], 8 * CHUNK):
                text, found = [], []
                for s in stretches(texts[a:b], window):
                    place, hashes = chosen(s, window)
                    text.append(s.text[place])
                    found.append(hashes)
                if found:
                    text = np.concatenate(text)
                    pairs = pd.DataFrame({"shard": shards[a:b][text], "hash": np.concatenate(found).view(np.int64),
                                          "times": copies[a:b][text]})
                    yield pairs.groupby(["shard", "hash"], sort=False)["times"].sum().reset_index()
    return run


def _packed(rows: DataFrame) -> DataFrame:
    """``rows`` with compressed bodies: texts are shuffled twice."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdCompressor

        compress = ZstdCompressor(level=3).compress
        at = rows_names.index("body")
        for batch in batches:
            bodies = pa.array([compress(b) for b in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([bodies if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    rows_names = rows.columns
    return rows.mapInArrow(run, fields)


def _texts(docs: pd.DataFrame) -> list[bytes]:
    from zstandard import ZstdDecompressor

    unpack = ZstdDecompressor().decompress
    return [unpack(bytes(b)) for b in docs["body"]]


def marked_windows(texts: list[bytes], marks: np.ndarray, window: int) -> Iterator[tuple[Stretch, np.ndarray, list[bytes]]]:
    """Windows whose minimiser is among the marks (sorted): (stretch, first words, digests)."""
    from xxhash import xxh3_128_digest

    if not len(marks):
        return
    for s in stretches(texts, window):
        first, low = s.windows(window), minimisers(s, window)[1]
        at = np.minimum(np.searchsorted(marks, low[first]), len(marks) - 1)
        first = first[marks[at] == low[first]]
        if len(first):
            joined = s.joined
            yield s, first, [xxh3_128_digest(joined[a:b]) for a, b in
                             zip(s.start[first].tolist(), s.end[first + window - 1].tolist(), strict=True)]


def _digests(window: int):
    def run(_key: tuple, docs: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        counts: dict[bytes, int] = {}
        if len(docs) and len(marks):
            copies = docs["copies"].to_numpy()
            for s, first, digests in marked_windows(_texts(docs), _sorted(marks["hash"]), window):
                for d, n in zip(digests, copies[s.text[first]].tolist(), strict=True):
                    counts[d] = counts.get(d, 0) + n
        lanes = np.frombuffer(b"".join(counts), np.int64).reshape(-1, 2)
        shard = docs["shard"].iloc[0] if len(docs) else 0
        return pd.DataFrame({"shard": np.full(len(lanes), shard, np.int64), "d0": lanes[:, 0], "d1": lanes[:, 1],
                             "times": np.fromiter(counts.values(), np.int64, len(counts))})
    return run


def _sorted(hashes: pd.Series) -> np.ndarray:
    return np.unique(hashes.to_numpy(np.int64).view(np.uint64))


def _phrases(texts: list[bytes], marks: np.ndarray, single: set[bytes], window: int) -> Iterator[list[bytes]]:
    """Phrases to look for: along each passage of recurring windows, the windows end to end and
    the last one, which together cover it."""
    seen: set[bytes] = set()
    for s, first, digests in marked_windows(texts, marks, window):
        hit = np.flatnonzero(np.fromiter((d not in single for d in digests), bool, len(digests)))
        if not len(hit):
            continue
        for run in np.split(hit, np.flatnonzero(np.diff(first[hit]) != 1) + 1):
            for w in [*run[::window].tolist(), int(run[-1])]:
                if digests[w] not in seen:
                    seen.add(digests[w])
                    yield s.joined[s.start[first[w]]:s.end[first[w] + window - 1]].split()


class PhraseAutomaton:
    """Finds phrases of words. A word is two characters (its number in a square), so that no node
    of the automaton has more than about the root of the vocabulary's size of branches. The
    characters start at ``FIRST``, past those that no string may hold."""

    FIRST = 0xE000

    def __init__(self, phrases: list[list[bytes]]) -> None:
        import ahocorasick

        self.numbers = {w: i for i, w in enumerate(dict.fromkeys(w for p in phrases for w in p))}
        self.side = isqrt(len(self.numbers)) + 1
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p in phrases:
            self.automaton.add_word(self.symbols(p), 1)
        if phrases:
            self.automaton.make_automaton()

    def symbols(self, words: list[bytes]) -> str:
        number = np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int64, len(words))
        pairs = np.empty(2 * len(words), "<u4")
        pairs[0::2] = np.where(number < 0, 0, number // self.side + 1) + self.FIRST
        pairs[1::2] = self.side + 2 + number % self.side + self.FIRST
        return pairs.tobytes().decode("utf-32-le")

    def ends(self, words: list[bytes]) -> np.ndarray:
        """Number of the last word of every occurrence."""
        return np.fromiter((at for at, _ in self.automaton.iter(self.symbols(words))), np.int64) >> 1


def _locate(window: int, fields: list[str]):
    def run(_key: tuple, docs: pd.DataFrame, hints: pd.DataFrame) -> pd.DataFrame:
        texts = _texts(docs)
        phrases = []
        if len(hints):
            once = hints["single"].to_numpy(bool)
            lanes = np.ascontiguousarray(hints.loc[once, ["d0", "d1"]].to_numpy(np.int64)).tobytes()
            single = {lanes[i:i + 16] for i in range(0, len(lanes), 16)}
            phrases = list(_phrases(texts, _sorted(hints.loc[~once, "d0"]), single, window))
            del single
        automaton = PhraseAutomaton(phrases) if phrases else None
        del phrases
        kept, total, removed = [], [], []
        for text in texts:
            words = text.split()
            n = len(words)
            total.append(n)
            ends = automaton.ends(words) if automaton and n >= window else ()
            if len(ends):
                change = np.bincount(ends - window + 1, minlength=n + 1) - np.bincount(ends + 1, minlength=n + 1)
                words = list(compress(words, (np.cumsum(change[:n]) == 0).tolist()))
            removed.append(n - len(words))
            kept.append(b" ".join(words))
        return pd.DataFrame({**{c: docs[c] for c in fields}, "n_words": total, "n_removed": removed, "kept": kept})
    return run


def _distinct(rows: DataFrame) -> DataFrame:
    """``rows`` with ``copies``: rows of one identifier and text become one. Only digests are
    shuffled to find them, and only texts that are repeated so are moved."""
    key = [F.coalesce("doc_id", F.lit("")).alias("k_id"), F.isnull("doc_id").alias("k_null"), F.unhex(F.sha2("body", 256)).alias("k")]
    repeated = stored(rows.select(*key).groupBy("k_id", "k_null", "k").count().filter("count > 1"), "repeated-rows")
    if repeated.isEmpty():
        return rows.withColumn("copies", F.lit(1).cast("bigint"))
    keyed = rows.select("*", *key).join(repeated, ["k_id", "k_null", "k"], "left")
    alone = keyed.filter("count is null").select("doc_id", "body", F.lit(1).cast("bigint").alias("copies"))
    return alone.union(keyed.filter("count is not null").groupBy("k_id", "k_null", "k").agg(
        F.first("doc_id").alias("doc_id"), F.first("body").alias("body"), F.max("count").alias("copies"))
        .select("doc_id", "body", "copies"))


def substring_dedup(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text",
                    shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``n_removed`` and ``kept`` (binary:
    the words that stay, joined by single spaces, UTF-8).

    A word goes if a window of ``window`` consecutive words covers it whose sequence of words
    also starts elsewhere in the table, in the same text or another; all windows are judged on
    the input. Words are what space and the control characters from tab to carriage return
    separate. Null and empty texts have no words; texts of fewer words than a window are kept
    whole; repeated rows count as different texts, so both lose what they share. An empty table
    gives no rows; extra columns are ignored. ``window`` must be at least ``PHRASE`` words.
    """
    if window < PHRASE:
        raise ValueError(f"a window has at least {PHRASE} words")
    body = F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")
    # The identifier travels as text: pandas has no whole numbers with nulls.
    rows = docs.select(docs[id_col].cast("string").alias("doc_id"), body.alias("body"))
    size = rows.agg(F.sum(F.length("body"))).first()[0] or 0
    # Repeated identifiers are dealt out by their texts, too.
    shard = F.pmod(F.xxhash64("doc_id", "body"), F.lit(max(1, -(-size // shard_bytes)))).alias("shard")
    rows = _distinct(rows).select("doc_id", "body", "copies", shard)

    census = stored(rows.select("shard", "body", "copies").mapInPandas(
        _census(window), "shard bigint, hash bigint, times bigint"), "census")
    # Summed map-side and written, so the join back is one of two plain tables, and a hash that
    # all shards hold splits in it.
    often = stored(census.groupBy("hash").agg(F.sum("times").alias("times")).filter("times > 1").select("hash"), "often")
    marks = stored(census.select("shard", "hash").join(often, "hash", "left_semi").distinct(), "marks")

    texts = _packed(rows)
    counted = (texts.select("shard", "body", "copies").groupBy("shard").cogroup(marks.groupBy("shard"))
               .applyInPandas(_digests(window), "shard bigint, d0 bigint, d1 bigint, times bigint"))
    # Most marked windows recur: it is the few that do not that go back to their shards. What
    # occurs once has one row, so the sums, combined map-side, know its shard.
    single = stored(counted.groupBy("d0", "d1").agg(F.sum("times").alias("times"), F.min("shard").alias("shard"))
                    .filter("times = 1").select("shard", "d0", "d1", F.lit(True).alias("single")), "single")
    hints = single.unionByName(marks.select("shard", F.col("hash").alias("d0"), F.lit(0).cast("bigint").alias("d1"),
                                            F.lit(False).alias("single")))

    out = (texts.groupBy("shard").cogroup(hints.groupBy("shard"))
           .applyInPandas(_locate(window, ["doc_id", "copies"]),
                          "doc_id string, copies bigint, n_words bigint, n_removed bigint, kept binary"))
    out = out.select("doc_id", "n_words", "n_removed", "kept", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).drop("col")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
