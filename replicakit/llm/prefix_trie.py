"""The trie of conversation prefixes, from sorted conversations and their longest common prefixes.

A conversation is the sequence of its turns' digests. Sorted conversations that share a prefix
are neighbours, so a trie node is an interval: the rows around any of its members between which
no neighbouring pair has a shorter common prefix. Range partitions cut the sorted conversations
into slices; each slice builds a sparse table of range minima over its common prefixes, and every
candidate prefix finds the left and right end of its interval by itself, by binary search on
that table. What a node reports is a sum or minimum over its interval: prefix sums of the rows
give leaves and words, for a turn's words saved are its members' words less the words of the
distinct nodes below it.

Only prefixes that a slice shares with a neighbouring slice are completed elsewhere: one partial
row per slice, aggregated by the digest of the prefix. So the root or a first turn that all
conversations share costs a row per slice. Texts are digested where they are read and are not
shuffled; a turn is 16 bytes and a word count.

No task holds a long conversation whole. Turns are numbered over range partitions, and a
conversation is cut into segments of ``SEGMENT_TURNS``. A segment's key begins with a header, the
digest of all turns before it, so that segments after equal prefixes are neighbours and the
header's node is the trie node where one segment passes into the next. What a segment's nodes need
of the segments below them (words, words of nodes that no row before has, leaves) are sums
over the later segments of the same conversations, so one pass gathers them and no level waits for
another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from replicakit.llm.common import stored, text_of, word_count

#: Bytes of a turn's digest.
SYMBOL = 16

#: Bytes of turns and rows that a slice holds, about.
SLICE_BYTES = 4 << 20

#: Turns that one row holds at most.
SEGMENT_TURNS = 16_384

#: Header of a conversation's first segment.
FIRST = bytes(SYMBOL)

NO_ENDS = hashlib.sha256(b"").hexdigest()

PARTIAL = ("node binary, parent binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, "
           "n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, ends string, slice int, "
           "is_open boolean, parent_open boolean")
LATER = "conv_id bigint, segment bigint, said bigint, fresh bigint, leaves bigint"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


class RangeMinimum:
    """Sparse table: minima of all stretches whose lengths are powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << len(self.levels) - 1 <= len(values):
            last, half = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minimum of each stretch, both ends included."""
        level = np.frexp(last - first + 1)[1] - 1
        out = np.empty(len(first), self.levels[0].dtype)
        for j in np.unique(level).tolist():
            at = level == j
            table = self.levels[j]
            out[at] = np.minimum(table[first[at]], table[last[at] - (1 << j) + 1])
        return out

    def extents(self, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The widest stretch of rows around each ``at`` whose neighbours share ``depth`` symbols;
        value i is what rows i - 1 and i share."""
        n = len(self.levels[0])
        left, right = at.copy(), at.copy()
        for j in reversed(range(len(self.levels))):
            table, size = self.levels[j], 1 << j
            first = left - size + 1  # values first..left
            ok = first >= 1
            ok[ok] = table[first[ok]] >= depth[ok]
            left[ok] -= size
            ok = right + size < n  # values right + 1..right + size
            ok[ok] = table[right[ok] + 1] >= depth[ok]
            right[ok] += size
        return left, right


def shared(a: bytes | None, b: bytes | None) -> int:
    """Symbols that two conversations share at the start; -1 if there is no other one."""
    if a is None or b is None:
        return -1
    if a == b:
        return len(a) // SYMBOL
    n = min(len(a), len(b)) // SYMBOL
    x, y = (np.frombuffer(s, "<u8", 2 * n).reshape(-1, 2) for s in (a, b))
    other = np.flatnonzero((x != y).any(axis=1))
    return int(other[0]) if len(other) else n


def _shared_with_next(keys: list[bytes], before: bytes | None, after: bytes | None) -> np.ndarray:
    """Value i is what rows i - 1 and i share; the last one is what the last row and ``after`` do."""
    return np.array([shared(a, b) for a, b in zip([before, *keys], [*keys, after], strict=True)], np.int64)


@dataclass
class Segments:
    """What is known of rows that are segments; their keys and words begin with a header."""

    turns: int               # of a segment that is not its conversation's last one
    above: np.ndarray        # turns of the conversation before the segment
    header: list             # of the conversation's next segment; None for its last one
    said: np.ndarray         # of its later segments: words,
    fresh: np.ndarray        # words of turns that no row before has,
    leaves: np.ndarray       # and leaves of which this is the last row


def slice_nodes(ids: list[int], keys: list[bytes], words: list, before: bytes | None, after: bytes | None,
                part: int, segments: Segments | None = None) -> pd.DataFrame:
    """Nodes of a slice, ``keys`` (with ``ids`` as ties) in order, between its neighbours' keys.
    Without ``segments`` the rows are whole conversations and have no header."""
    n, head = len(keys), int(segments is not None)
    lens = np.array([len(k) // SYMBOL for k in keys], np.int64)
    lcp = _shared_with_next(keys, before, after)
    conv = np.array(ids, np.int64)
    zero = np.zeros(n, np.int64)
    said, fresh, later_leaves = (segments.said, segments.fresh, segments.leaves) if segments else (zero, zero, zero)
    full = head + segments.turns if segments else -1  # symbols of a row that goes on

    # Candidate prefixes: those that a row does not share with the row before it in the slice.
    at, depth, parent, digest = [], [], [], []
    path: list[int] = []
    for i, key in enumerate(keys):
        del path[(max(lcp[i] + 1 - head, 0) if i else 0):]
        for d in range(len(path) + head, len(key) // SYMBOL + 1):
            up = path[-1] if path else -1
            if up < 0:
                digest.append(key[:SYMBOL] if head else hashlib.md5(b"").digest())
            elif d == full:
                digest.append(segments.header[i])
            else:
                digest.append(hashlib.md5(digest[up] + key[(d - 1) * SYMBOL:d * SYMBOL]).digest())
            path.append(len(at))
            at.append(i)
            depth.append(d)
            parent.append(up)
    at, depth, parent = (np.array(x, np.int64) for x in (at, depth, parent))
    table = RangeMinimum(np.append(-1, lcp[1:n]))
    left, right = table.extents(at, depth)

    # Words of a row's first d symbols lie at start[row] + d.
    start = np.append(0, np.cumsum(lens + 1))[:-1]
    spoken = np.concatenate([np.append(0, np.cumsum(np.asarray(w, np.int64))) for w in words])
    upto = lambda row, d: spoken[start[row] + np.maximum(d, 0)]
    sums = lambda x: np.append(0, np.cumsum(x))
    rows = np.arange(n)
    total = upto(rows, lens)
    all_words, new_words = sums(total + said), sums(total + fresh - upto(rows, lcp[:n]))
    leaves = sums(np.where(lens == full, later_leaves, lcp[1:] < lens))
    n_convs = right - left + 1
    members = all_words[right + 1] - all_words[left] - n_convs * upto(left, depth - 1)
    distinct = (new_words[right + 1] - new_words[left + 1] + total[left] + fresh[left]
                - upto(left, np.maximum(lcp[left], depth - 1)))
    created = (depth > lcp[at]) & (parent >= 0)
    least = RangeMinimum(conv).least(left, right)
    is_open = ((left == 0) & (lcp[0] >= depth)) | ((right == n - 1) & (lcp[n] >= depth))
    above = segments.above[at] if segments else 0
    passes = depth == full  # told by the next segment's header; here only its parent is known
    if segments:
        is_open |= passes | ((depth == head) & (above > 0))

    # Members that end at a node come first in its interval: a run of equal rows.
    same = np.append(False, (lcp[1:n] == lens[1:]) & (lens[1:] == lens[:-1]))
    run_end = np.append(np.flatnonzero(~same)[1:], n) if n else np.zeros(0, np.int64)
    stop = dict(zip(np.flatnonzero(~same).tolist(), run_end.tolist(), strict=True))
    ends_sha, ends = [None] * len(at), [None] * len(at)
    for c in np.flatnonzero((lens[left] == depth) & ~passes).tolist():
        first = int(left[c])
        last = stop[first]
        text = ",".join(map(str, ids[first:last]))
        if (first == 0 and before == keys[0]) or (last == n and after == keys[-1]):
            ends[c] = text  # goes on in another slice
        else:
            ends_sha[c] = hashlib.sha256(text.encode()).hexdigest()
    up = np.maximum(parent, 0)
    top = parent < 0
    parent_open = is_open[up] & ~top
    parent_conv = pd.array(least[up], dtype="Int64")
    parent_conv[top | parent_open] = pd.NA
    here = lambda x: np.where(passes, 0, x)
    return pd.DataFrame({
        "node": digest, "parent": [digest[p] if p >= 0 else None for p in parent.tolist()], "depth": above + depth - head,
        "conv_id": least, "parent_conv_id": parent_conv, "n_convs": here(n_convs),
        "n_children": np.bincount(parent[created], minlength=len(at)), "n_leaves": here(leaves[right + 1] - leaves[left]),
        "saved_tokens": here(members - distinct), "ends_sha256": ends_sha, "ends": ends, "slice": part,
        "is_open": is_open, "parent_open": parent_open})


def _sorted(rows: pd.DataFrame) -> pd.DataFrame:
    ids, keys = rows["conv_id"].tolist(), rows["key"].tolist()
    return rows.iloc[sorted(range(len(ids)), key=lambda i: (keys[i], ids[i]))]


def _slice(turns: int):
    def run(key: tuple, rows: pd.DataFrame, sides: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=[c.split()[0] for c in PARTIAL.split(", ")])
        rows = _sorted(rows)
        segments = Segments(turns, rows["segment"].to_numpy(np.int64) * turns, rows["header"].tolist(),
                            *(rows[c].to_numpy(np.int64) for c in ("said", "fresh", "leaves")))
        return slice_nodes(rows["conv_id"].tolist(), rows["key"].tolist(), rows["words"].tolist(),
                           sides["before"].iloc[0], sides["after"].iloc[0], int(key[0]), segments)
    return run


def _later(turns: int):
    """Of each segment but the first ones: its words, those of turns that no row before has, and
    whether it is the last row of a leaf."""
    def run(_key: tuple, rows: pd.DataFrame, sides: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=[c.split()[0] for c in LATER.split(", ")])
        rows = _sorted(rows)
        keys = rows["key"].tolist()
        lcp = _shared_with_next(keys, sides["before"].iloc[0], sides["after"].iloc[0])
        lens = np.array([len(k) // SYMBOL for k in keys], np.int64)
        leaf = (lens <= turns) & (lcp[1:] < lens)
        words = [np.asarray(w, np.int64) for w in rows["words"]]
        return pd.DataFrame({"conv_id": rows["conv_id"].to_numpy(), "segment": rows["segment"].to_numpy(),
                             "said": [int(w[1:].sum()) for w in words],
                             "fresh": [int(w[max(1, k):].sum()) for w, k in zip(words, lcp[:-1].tolist(), strict=True)],
                             "leaves": leaf.astype(np.int64)})
    return run


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digest of each node's pieces, which come sorted by node and slice, without joining them."""
    node = state = None
    for batch in batches:
        done = []
        for key, text in zip(batch["node"].tolist(), batch["ends"].tolist(), strict=True):
            if key != node:
                if state:
                    done.append((node, state.hexdigest()))
                node, state = key, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield pd.DataFrame(done, columns=["e_node", "e_sha"])
    if state:
        yield pd.DataFrame([(node, state.hexdigest())], columns=["e_node", "e_sha"])


def _places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each row's place, from 0, in its conversation's run of a sorted partition."""
    last, seen = None, 0
    for batch in batches:
        conv = batch["conv_id"].to_numpy()
        if not len(conv):
            continue
        first = np.maximum.accumulate(np.where(np.append(True, conv[1:] != conv[:-1]), np.arange(len(conv)), 0))
        place = np.arange(len(conv)) - first
        if conv[0] == last:
            place[first == 0] += seen
        last, seen = conv[-1], int(place[-1]) + 1
        yield batch.assign(place=place)


def _numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``turns`` (conv_id, turn, symbol, words) with each one's ``place`` in its conversation, and
    the conversations with their number of turns ``n``. Range partitions are sorted and counted by
    themselves, so a conversation of any length, or one turn repeated, spreads over them."""
    # Written first: the sampling of ranges would read and digest every text once more.
    slim = stored(turns.withColumn("row", F.monotonically_increasing_id()), "digests")
    ranged = slim.repartitionByRange("conv_id", "turn", "symbol", "row").sortWithinPartitions("conv_id", "turn", "symbol")
    parts = stored(ranged.select("conv_id", "symbol", "words", F.spark_partition_id().alias("part")).mapInPandas(
        _places, "conv_id bigint, symbol string, words bigint, part int, place bigint"), "turns")
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    runs = stored(parts.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
                  .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))), "runs")
    # Only a partition's first conversation can have begun before it: a row per partition at most.
    begun = runs.filter("offset > 0").select(F.col("conv_id").alias("r_id"), F.col("part").alias("r_part"), "offset")
    placed = parts.join(F.broadcast(begun), (F.col("conv_id") == F.col("r_id")) & (F.col("part") == F.col("r_part")), "left")
    return (placed.select("conv_id", "symbol", "words", (F.col("place") + F.coalesce("offset", F.lit(0))).alias("place")),
            runs.groupBy("conv_id").agg(F.sum("n").alias("n")))


def rebuilt(conversations: DataFrame, group: int = 20, heads: int = 4, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """Every conversation in segments: ``conv_id``, ``segment`` (from 0), ``last``, ``key`` (its
    turns' digests end to end) and ``words`` (of each turn). A conversation's first h turns, h = crc32
    of the identifier modulo ``heads``, are those of the conversation that starts its group of
    ``group``. All segments but the last have ``segment_turns`` turns, the last one has fewer, none
    possibly."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), text_of(conversations)
    symbol = F.md5(F.concat_ws("", F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", symbol.alias("symbol"), word_count(text).alias("words"))
    placed, sizes = _numbered(turns)
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("bigint")
    base = F.col("conv_id") - F.col("conv_id") % group
    given = sizes.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("b_id"), F.col("n").alias("b_n"))
    shape = sizes.join(given, base == F.col("b_id"), "left").withColumn("head", F.least(h, F.coalesce("b_n", F.lit(0))))
    shape = stored(shape.select("conv_id", "head", (F.col("head") + F.greatest(F.col("n") - h, F.lit(0))).alias("turns")), "shapes")
    own = placed.filter(F.col("place") >= h).join(
        shape.select(F.col("conv_id").alias("s_id"), "head"), F.col("conv_id") == F.col("s_id")).select(
        "conv_id", (F.col("place") - h + F.col("head")).alias("place"), "symbol", "words")
    first = placed.filter((F.col("conv_id") % group == 0) & (F.col("place") < heads - 1)).withColumnRenamed("conv_id", "f_id")
    lent = shape.filter("head > 0").join(first, base == F.col("f_id")).filter("place < head").select(
        "conv_id", "place", "symbol", "words")
    segment = lambda x: F.floor(x / segment_turns)
    # Dealt out by segment at once: the join above may split a long conversation.
    held = (own.union(lent).withColumn("segment", segment(F.col("place"))).repartition("conv_id", "segment")
            .groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(F.struct("place", "symbol", "words"))).alias("t")))
    last = segment(F.col("turns"))
    every = shape.select("conv_id", last.alias("final"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("segment"))
    return every.join(held, ["conv_id", "segment"], "left").select(
        "conv_id", "segment", (F.col("segment") == F.col("final")).alias("last"),
        F.coalesce(F.unhex(F.array_join("t.symbol", "")), F.lit(b"")).alias("key"),
        F.coalesce(F.col("t.words"), F.array().cast("array<bigint>")).alias("words"))


def _headed(segments: DataFrame) -> DataFrame:
    """``segments`` with headers before their keys, the words of the turn before them before their
    words, and the next segment's ``header``. Only conversations of several segments are looked at."""
    marks = (F.xxhash64("segment", "key"), F.xxhash64(F.md5("key"), "segment"))
    long = segments.filter("segment > 0 or not last").select(
        "conv_id", "segment", "last", F.try_element_at("words", F.lit(-1)).alias("word"),
        *[m.alias(f"m{i}") for i, m in enumerate(marks)])
    order = W.partitionBy("conv_id").orderBy("segment")
    until = order.rowsBetween(W.unboundedPreceding, 0)
    header = F.unhex(F.md5(F.concat_ws(":", F.col("segment") + 1, F.bit_xor("m0").over(until), F.bit_xor("m1").over(until)).cast("binary")))
    long = long.withColumn("next", header).select(
        "conv_id", "segment", F.lag("next").over(order).alias("own"), F.lag("word").over(order).alias("word"),
        F.when(~F.col("last"), F.col("next")).alias("header"))
    return segments.join(long, ["conv_id", "segment"], "left").select(
        "conv_id", "segment", F.concat(F.coalesce("own", F.lit(FIRST)), "key").alias("key"),
        F.concat(F.array(F.coalesce("word", F.lit(0).cast("bigint"))), "words").alias("words"), "header")


def prefix_trie(conversations: DataFrame, group: int = 20, heads: int = 4, slice_bytes: int = SLICE_BYTES,
                segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations (see ``rebuilt``), the empty one
    included: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves`` (childless nodes of its subtree), ``saved_tokens`` (words that
    storing each turn of the subtree once would save) and ``ends_sha256`` (of the members that
    end there, ascending, joined by commas).

    Turns go by ``turn`` (null first), ties by the MD5 of role and text; repeated rows are turns
    of their own. A null role or text counts as empty. Rows without a conversation identifier take
    no part. Equality of turns is that of their MD5, and that of turns before a segment (of
    ``segment_turns`` turns) that of two 64-bit hashes. An empty table gives no rows; extra columns
    are ignored.
    """
    spark = conversations.sparkSession
    keyed = stored(rebuilt(conversations, group, heads, segment_turns), "rebuilt")
    size = keyed.agg(F.sum(F.length("key") + 64).alias("bytes")).first()["bytes"] or 0
    # Slices of a bounded size, and enough of them to occupy the cluster.
    n = max(-(-size // slice_bytes), spark.sparkContext.defaultParallelism)
    rows = stored(_headed(keyed).repartitionByRange(n, "key", "conv_id").withColumn("slice", F.spark_partition_id()), "slices")
    ordered = W.orderBy("slice")  # one row per slice
    sides = rows.groupBy("slice").agg(F.min("key").alias("low"), F.max("key").alias("high")).select(
        F.col("slice").alias("s_slice"), F.lag("high").over(ordered).alias("before"), F.lead("low").over(ordered).alias("after"))
    later = rows.filter("segment > 0").groupBy("slice").cogroup(sides.groupBy("s_slice")).applyInPandas(
        _later(segment_turns), LATER)
    from_here = W.partitionBy("conv_id").orderBy("segment").rowsBetween(0, W.unboundedFollowing)
    later = stored(later.select("conv_id", (F.col("segment") - 1).alias("segment"),
                                *[F.sum(c).over(from_here).alias(c) for c in ("said", "fresh", "leaves")]), "later")
    rows = rows.join(later, ["conv_id", "segment"], "left").fillna(0, ["said", "fresh", "leaves"])
    found = stored(rows.groupBy("slice").cogroup(sides.groupBy("s_slice")).applyInPandas(_slice(segment_turns), PARTIAL), "trie")

    # Prefixes that go on in another slice or segment: partial rows to one row.
    cut = found.filter("ends is not null").select("node", "slice", "ends")
    ends = cut.repartition("node").sortWithinPartitions("node", "slice").select("node", "ends").mapInPandas(
        _ends, "e_node binary, e_sha string")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = found.filter("is_open").groupBy("node").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.max("parent_conv_id").alias("parent_conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256"))
    merged = stored(merged.join(ends, F.col("node") == F.col("e_node"), "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", "e_sha")), "trie-open")
    up = merged.select(F.col("node").alias("u_node"), F.col("conv_id").alias("u_conv"))
    shape = ["parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rest = merged.select(*shape).union(found.filter("parent_open and not is_open").select(*shape)).join(
        up, F.col("parent") == F.col("u_node"), "left").withColumn("parent_conv_id", F.coalesce("u_conv", "parent_conv_id"))
    done = found.filter("not parent_open and not is_open")
    return done.select(*NODE).union(rest.select(*NODE)).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
