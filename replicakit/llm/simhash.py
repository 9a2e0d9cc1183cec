"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at most ``radius`` bits apart share a point at most half the radius from
each. Every distinct fingerprint stands for its ball, all variants within half the radius,
and equal variants from different fingerprints meet in one task.

What is shuffled is not each variant by itself. Bits are first put in the order of their
balance over all fingerprints; a variant's shuffle bucket is its first ``width`` bits, so a
ball of two flipped bits meets 1 + w + w(w-1)/2 buckets at most. Only fingerprints travel, once
per bucket, and the task writes out that bucket's variants itself. A bucket with too many
variants (a group of near copies shares most bits) is split by the next bits, and again, until
each holds a bounded number. Every fingerprint that holds a shared variant is
linked to the group's smallest one after its bit distance has been verified; no pairs
within a group are formed, and no link is lost, for two points of a ball around one
variant are within the radius of each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replicakit.llm.common import stored, text_of
from replicakit.llm.components import connected_components

BITS = 64

#: Variants of a shuffle bucket on average; one with four times as many is split.
BUCKET_VARIANTS = 4_000_000

#: Further bits by which a bucket with too many variants is split.
SPLIT_BITS = 6


def fingerprint(text: bytes, shingle: int, xxh64) -> int:
    """SimHash of the word shingles, repeats included; 0 if there are no words. A bit is set
    if it is in over half the hashes."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxh64(joined, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-shingle].tolist()]
        hashes = [xxh64(joined[s:e], 42) for s, e in zip(starts, (ends[shingle - 1:] - 1).tolist(), strict=True)]
    count = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 100_000):
        block = np.array(hashes[i:i + 100_000], "<u8")
        count += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(count * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``fp``, the 64-bit fingerprint (signed). Only
    the text travels to Python."""

    @F.pandas_udf("bigint")
    def run(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from xxhash import xxh64_intdigest

        for batch in bodies:
            fps = np.array([fingerprint(bytes(t), shingle, xxh64_intdigest) for t in batch], np.uint64)
            yield pd.Series(fps.view(np.int64))

    return docs.select(docs[id_col].alias("doc_id"), run(text_of(docs, text_col).cast("binary")).alias("fp"))


def balanced_bits(distinct: DataFrame) -> list[int]:
    """All bits, those first that are set in nearest to half of the fingerprints; one row of sums."""
    ones = [F.sum(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(BITS)]
    row = distinct.agg(F.count(F.lit(1)).alias("n"), *ones).first()
    return sorted(range(BITS), key=lambda b: (abs(2 * (row[f"b{b}"] or 0) - row["n"]), b))


def reorder(values: np.ndarray, order: list[int], back: bool = False) -> np.ndarray:
    """Bits of ``values`` with ``order[0]`` as the highest one; or, with ``back``, as they were."""
    out = np.zeros(values.shape, np.uint64)
    for i, b in enumerate(order):
        source, target = (BITS - 1 - i, b) if back else (b, BITS - 1 - i)
        out |= (values >> np.uint64(source) & np.uint64(1)) << np.uint64(target)
    return out


def _low(values: np.ndarray, bits: int) -> np.ndarray:
    return values & np.uint64((1 << bits) - 1)


def _high(values: np.ndarray, width: int) -> np.ndarray:
    return values >> np.uint64(BITS - width)


def flips(bits: int, most: int) -> np.ndarray:
    """Masks of at most ``most`` of the lowest ``bits`` bits."""
    return np.array([sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(bits), n)], np.uint64)


def ball_size(bits: int, left: int) -> int:
    return sum(comb(bits, n) for n in range(left + 1))


def reach(fps: np.ndarray, half: int, width: int, crowded: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, ...]]:
    """The buckets that the balls of ``fps`` meet, per depth: (depth, bucket, index of the
    fingerprint, flips left for the other bits). Buckets in ``crowded`` give way to theirs."""
    masks = flips(width, half)
    bucket = (_high(fps, width)[:, None] ^ masks).ravel()
    who = np.repeat(np.arange(len(fps)), len(masks))
    left = np.tile(half - np.bitwise_count(masks).astype(np.int64), len(fps))
    while len(bucket):
        split = np.isin(bucket, crowded[width]) if width in crowded else np.zeros(len(bucket), bool)
        yield width, bucket[~split], who[~split], left[~split]
        bucket, who, left = bucket[split], who[split], left[split]
        if len(bucket):
            more = min(SPLIT_BITS, BITS - width)
            own = _low(_high(fps, width + more), more)[who]
            parts = []
            for n in np.unique(left).tolist():
                at, masks = np.flatnonzero(left == n), flips(more, n)
                deeper = ((bucket[at] << np.uint64(more)) | own[at])[:, None] ^ masks
                parts.append((deeper.ravel(), np.repeat(who[at], len(masks)),
                              np.tile(n - np.bitwise_count(masks).astype(np.int64), len(at))))
            bucket, who, left = (np.concatenate(x) for x in zip(*parts, strict=True))
            width += more


def _reached(batches: Iterator[pd.DataFrame], order: list[int], half: int, width: int, crowded: dict):
    """``reach`` over batches, as many fingerprints at a time as meet a bounded number of buckets."""
    step = max(1, 2_000_000 // ball_size(width, half))
    for batch in batches:
        fps = reorder(batch["fp"].to_numpy().view(np.uint64), order)
        for i in range(0, len(fps), step):
            part = fps[i:i + step]
            for depth, bucket, who, left in reach(part, half, width, crowded):
                by = np.argsort(bucket, kind="stable")
                buckets, first = np.unique(bucket[by], return_index=True)
                if len(buckets):
                    yield depth, buckets, first, part[who[by]], left[by]


def _weigh(order: list[int], half: int, width: int, crowded: dict):
    """Fingerprints to (depth, bucket, variants in it)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for depth, buckets, first, _, left in _reached(batches, order, half, width, crowded):
            sizes = np.array([ball_size(BITS - depth, n) for n in range(half + 1)])[left]
            yield pd.DataFrame({"depth": np.full(len(buckets), depth, np.int32), "bucket": buckets.view(np.int64),
                                "variants": np.add.reduceat(sizes, first)})
    return run


def crowded_buckets(distinct: DataFrame, order: list[int], half: int, width: int, limit: int) -> dict[int, np.ndarray]:
    """Buckets of more than ``limit`` variants, per depth, found one depth after the other. The
    driver sees only those: at most all variants divided by ``limit`` at each depth."""
    crowded: dict[int, np.ndarray] = {}
    while True:
        sizes = distinct.mapInPandas(_weigh(order, half, width, crowded), "depth int, bucket bigint, variants bigint")
        over = (sizes.groupBy("depth", "bucket").agg(F.sum("variants").alias("n"))
                .filter((F.col("n") > limit) & (F.col("depth") < BITS)).collect())
        if not over:
            return crowded
        for r in over:
            at = np.array([r["bucket"]], np.int64).view(np.uint64)
            crowded[r["depth"]] = np.union1d(crowded.get(r["depth"], at), at)


def _deal(order: list[int], half: int, width: int, crowded: dict):
    """Fingerprints to (depth, bucket, packed fingerprints): a row for each bucket that some of
    a batch's variants fall into."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for depth, buckets, first, fps, _ in _reached(batches, order, half, width, crowded):
            yield pd.DataFrame({"depth": np.full(len(buckets), depth, np.int32), "bucket": buckets.view(np.int64),
                                "packed": [x.tobytes() for x in np.split(fps, first[1:])]})
    return run


def shared_variants(fps: np.ndarray, half: int, depth: int, bucket: int) -> tuple[np.ndarray, np.ndarray]:
    """Variants of ``fps`` in the bucket that two fingerprints or more have: (variant, its
    fingerprint), sorted by both."""
    rest = BITS - depth
    at = np.uint64(bucket)
    left = half - np.bitwise_count(_high(fps, depth) ^ at).astype(np.int64)
    pieces = []
    for n in np.unique(left[left >= 0]).tolist():
        own, masks = fps[left == n], flips(rest, n)
        start = _low(own, rest) | (at << np.uint64(rest) if rest < BITS else np.uint64(0))
        pieces.append((own, len(masks), (start[:, None] ^ masks).ravel()))
    variants = np.concatenate([v for _, _, v in pieces] or [fps[:0]])
    ordered = np.sort(variants)
    repeated = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    if not len(repeated):
        return repeated, repeated
    # A table of 2^22 flags passes over nearly all variants that occur once.
    low = np.uint64((1 << 22) - 1)
    mixed = lambda v: ((v ^ v >> np.uint64(29) ^ v >> np.uint64(47)) & low).astype(np.int64)
    flags = np.zeros(1 << 22, bool)
    flags[mixed(repeated)] = True
    at = np.flatnonzero(flags[mixed(variants)])
    found = np.searchsorted(repeated, variants[at])
    at = at[repeated[np.minimum(found, len(repeated) - 1)] == variants[at]]
    values = variants[at]
    owners = np.concatenate([np.repeat(own, n) for own, n, _ in pieces])[at]
    by = np.lexsort((owners, values))
    return values[by], owners[by]


def _meet(order: list[int], half: int, radius: int):
    """One bucket's packed fingerprints to links (a, b), a spanning forest of the bucket's."""
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        fps = np.unique(np.frombuffer(b"".join(frame["packed"]), np.uint64))
        bucket = int(np.array([key[1]], np.int64).view(np.uint64)[0])
        values, owners = shared_variants(fps, half, int(key[0]), bucket)
        pairs = np.zeros((0, 2), np.uint64)
        if len(values):
            new = np.append(True, values[1:] != values[:-1])
            at, group = np.flatnonzero(new), np.cumsum(new) - 1
            # An odd radius is met by a shorter and a longer half: two longer ones make no link.
            near = np.bitwise_count(values ^ owners) <= radius // 2
            centre = np.minimum.reduceat(np.where(near, owners, np.uint64((1 << 64) - 1)), at)[group]
            linked = np.logical_or.reduceat(near, at)[group] & (np.bitwise_count(centre ^ owners) <= radius)
            pairs = np.unique(np.stack([centre[linked], owners[linked]], 1), axis=0)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = parent[x]
            return x

        links = []
        for a, b in pairs.tolist():
            if a != b and (x := root(a)) != (y := root(b)):
                parent[max(x, y)] = min(x, y)
                links.append((a, b))
        ends = reorder(np.array(links, np.uint64).reshape(-1, 2), order, back=True)
        return pd.DataFrame(ends.view(np.int64), columns=["a", "b"])
    return run


def near_links(distinct: DataFrame, radius: int, bucket_variants: int = BUCKET_VARIANTS) -> DataFrame:
    """Distinct fingerprints ``fp`` to links (a, b) that connect just those within ``radius``
    bits of each other, directly or over others."""
    half = (radius + 1) // 2
    variants = distinct.count() * ball_size(BITS, half)
    width = max(4, int(np.ceil(np.log2(max(1, variants) / bucket_variants))))
    order = balanced_bits(distinct)
    crowded = crowded_buckets(distinct, order, half, width, 4 * bucket_variants)
    return (distinct.mapInPandas(_deal(order, half, width, crowded), "depth int, bucket bigint, packed binary")
            .groupBy("depth", "bucket").applyInPandas(_meet(order, half, radius), "a bigint, b bigint"))


def simhash_near_dedup(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (16 lowercase hex digits) and
    ``component_id``, the smallest identifier reachable over links of at most ``radius`` bits,
    itself included.

    Words are what space and the control characters from tab to carriage return separate, with
    A-Z lower-cased. Fewer words than ``shingle`` make one shingle; null, empty and blank texts
    have fingerprint zero, linked like any other. Repeated rows share a fingerprint and so a
    component. A null identifier is passed over as smallest unless all are null. An empty table
    gives no rows; extra columns are ignored. Equal fingerprints are aggregated before anything
    else, so groups of copies cost no more than one document.
    """
    fps = stored(fingerprints(docs, shingle, id_col, text_col), "simhash")
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    links = connected_components(near_links(nodes.select("fp"), radius))
    member = nodes.join(links, nodes.fp == links.node, "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    # Written first: a component of very many fingerprints then splits in the join.
    member = stored(member, "simhash-members")
    least = stored(member.groupBy("component").agg(F.min("least").alias("component_id")), "simhash-least")
    labels = member.join(least, "component").select("fp", "component_id")
    return fps.join(labels, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
