"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The merges of a pre-token wait in buckets, one per merge rank, that hold positions of a
linked list of parts. A bitmap of two levels marks the buckets in use, and find-first-set
gives the next rank in a constant number of steps whatever the length. An entry is stale
when its position is no longer a part or its pair has another rank by now; it is skipped
when it comes up. Within a rank the leftmost position goes first.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import sha256
from heapq import heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from replicakit.llm.common import text_of

#: Pre-tokens of up to so many characters are cached, so many of them in a generation.
CACHE_CHARS, CACHE_ITEMS = 32, 350_000

#: Rows of a record batch that are worked on at a time.
BATCH_ROWS = 1000


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file, read on the driver and broadcast by the functions below:
    a vocabulary has a fixed size, whatever the corpus."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    get = ranks.get
    after = list(range(1, n + 2))  # start of the next part; a part is piece[i:after[i]]
    before = list(range(-1, n))
    pair = [get(piece[i:i + 2]) for i in range(n - 1)] + [None, None]  # rank of a part with the next
    # The queue: positions by rank; 256 ranks to a word of ``low``, a bit of ``top`` for each word.
    buckets: dict[int, list[int]] = {}
    low: dict[int, int] = {}
    top = 0
    for i, rank in enumerate(pair):
        if rank is not None:
            if rank in buckets:
                buckets[rank].append(i)  # ascending, so a heap
            else:
                buckets[rank] = [i]
                word = rank >> 8
                low[word] = low.get(word, 0) | 1 << (rank & 255)
                top |= 1 << word
    while top:
        word = (top & -top).bit_length() - 1
        bits = low[word]
        rank = word << 8 | (bits & -bits).bit_length() - 1
        bucket = buckets[rank]
        if len(bucket) > 1:
            i = heappop(bucket)
        else:
            i = bucket[0]
            del buckets[rank]
            bits &= bits - 1
            low[word] = bits
            if not bits:
                top &= top - 1
        if pair[i] != rank:
            continue  # stale: the part is gone or has another neighbour by now
        j = after[i]
        k = after[i] = after[j]
        pair[j] = None
        before[k] = i
        pair[i] = rank = get(piece[i:after[k]]) if k < n else None
        if rank is not None:
            if rank in buckets:
                heappush(buckets[rank], i)
            else:
                buckets[rank] = [i]
                word = rank >> 8
                low[word] = low.get(word, 0) | 1 << (rank & 255)
                top |= 1 << word
        h = before[i]
        if h >= 0:
            pair[h] = rank = get(piece[h:k])
            if rank is not None:
                if rank in buckets:
                    heappush(buckets[rank], h)
                else:
                    buckets[rank] = [h]
                    word = rank >> 8
                    low[word] = low.get(word, 0) | 1 << (rank & 255)
                    top |= 1 << word
    out, i = [], 0
    while i < n:
        j = after[i]
        out.append(ranks[piece[i:j]])
        i = j
    return out


class Cache(dict):
    """Ids (little-endian uint32) by pre-token, in two generations of bounded size: when the
    young one is full it becomes the old one, and what is used again comes back from there."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.old = ranks, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = merge(piece.encode(), self.ranks)
            ids = pack(f"<{len(ids)}I", *ids)
            if len(piece) > CACHE_CHARS:
                return ids
        if len(self) >= CACHE_ITEMS:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """Encodes texts; ids as little-endian uint32."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.find, self.cache = regex.compile(pattern).findall, Cache(ranks)

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, self.find(text)))


#: The encoder of this worker process, by vocabulary and pattern: its cache outlives a task.
_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(ranks: dict[bytes, int], digest: str, pattern: str) -> Encoder:
    key = (digest, pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks, pattern)
    return _ENCODERS[key]


def _digest(ranks: dict[bytes, int]) -> str:
    return sha256(repr(sorted(ranks.items())).encode()).hexdigest()


def _map(df: DataFrame, ranks: dict[bytes, int], make, fields: str) -> DataFrame:
    """``make(ranks)`` gives a function from a record batch to lists of the new columns; the
    input columns that ``fields`` names stay in front."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    schema = StructType.fromDDL(fields)
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                new = work(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(new[f.name], f.type) if f.name in new else part.column(f.name).cast(f.type)
                     for f in target], schema=target)

    return df.mapInArrow(run, schema)


def _decoder(ranks: dict[bytes, int]):
    token = {i: b for b, i in ranks.items()}.__getitem__
    return lambda ids: b"".join(map(token, np.frombuffer(ids, "<u4").tolist()))


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("doc_id"), text_of(docs, text_col).alias("body"))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_tokens`` and ``ids`` (binary, little-endian
    unsigned 32-bit integers). Each match of ``pattern`` is encoded separately; special tokens
    are ordinary text.

    Null and empty texts have no tokens; an empty table gives no rows; repeated rows are
    encoded alike; extra columns are ignored. There is no shuffle.
    """
    digest = _digest(ranks)

    def make(ranks):
        encoder = _encoder(ranks, digest, pattern)

        def work(batch):
            ids = [encoder(t) for t in batch.column("body").to_pylist()]
            return {"n_tokens": [len(x) // 4 for x in ids], "ids": ids}
        return work

    rows = _input(docs, id_col, text_col)
    return _map(rows, ranks, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id") -> DataFrame:
    """``doc_id`` and ``decoded``, the bytes of the tokens in ``ids``, joined; null ids give
    empty bytes. An id outside the vocabulary is an error."""
    def make(ranks):
        decoder = _decoder(ranks)
        return lambda batch: {"decoded": [decoder(x or b"") for x in batch.column("ids").to_pylist()]}

    rows = encoded.select(encoded[id_col].alias("doc_id"), "ids")
    return _map(rows, ranks, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, decoded binary")


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass over the texts: ``doc_id``, ``n_tokens``, ``ids``
    and ``decoded`` (the bytes that the ids stand for). Edge cases as in ``encode``."""
    digest = _digest(ranks)

    def make(ranks):
        encoder, decoder = _encoder(ranks, digest, pattern), _decoder(ranks)

        def work(batch):
            ids = [encoder(t) for t in batch.column("body").to_pylist()]
            return {"n_tokens": [len(x) // 4 for x in ids], "ids": ids, "decoded": [decoder(x) for x in ids]}
        return work

    rows = _input(docs, id_col, text_col)
    return _map(rows, ranks, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, "
                                   "n_tokens bigint, ids binary, decoded binary")
