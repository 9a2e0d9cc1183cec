"""Hashed tokens of many texts at once, in numpy.

A token is a maximal run of word bytes (ASCII letters and digits, and all bytes of
characters beyond ASCII) or of punctuation; spaces and control characters separate. A
token's hash covers all its lower-cased bytes; its shape says what it looks like.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPACE, WORD, PUNCT = 0, 1, 2
CLASS = np.full(256, WORD, np.uint8)
CLASS[:33] = SPACE
CLASS[127] = SPACE
CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = PUNCT
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_UPPER = np.zeros(256, np.int64)
IS_UPPER[65:91] = 1

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a token that are hashed at a time; longer tokens are hashed block by block.
TOKEN_BYTES = 64
POWERS = np.cumprod(np.full(TOKEN_BYTES, BASE, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


@dataclass
class Tokens:
    """Tokens of a list of texts, in order; ``doc`` is each one's index in the list."""

    hash: np.ndarray   # uint64
    doc: np.ndarray    # int64
    word: np.ndarray   # bool: of word bytes
    upper: np.ndarray  # int64: upper-case ASCII letters
    size: np.ndarray   # int64: bytes
    start: np.ndarray  # int64: first byte in the texts joined by single spaces


def _later_blocks(low: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the runs of ``low`` that start at ``start``: each block's polynomial is mixed
    with the block's number, and a run's blocks are summed. Linear in the runs' bytes."""
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], size)
    first = np.flatnonzero(place % TOKEN_BYTES == 0)
    parts = np.add.reduceat(low[np.repeat(start, size) + place] * POWERS[place % TOKEN_BYTES], first)
    parts = mix(parts + mix((place[first] // TOKEN_BYTES + 1).astype(np.uint64)))
    return np.add.reduceat(parts, np.searchsorted(first, bounds[:-1]))


def tokens(texts: list[bytes]) -> Tokens:
    raw = b" ".join(texts) + b" "
    buf = np.frombuffer(raw, np.uint8)
    ends_at = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    kind = CLASS[buf]
    cut = np.flatnonzero(np.diff(kind)) + 1
    start = np.concatenate([np.zeros(1, np.int64), cut])
    end = np.concatenate([cut, np.array([len(buf)])])
    real = kind[start] != SPACE
    start, end = start[real], end[real]
    size = end - start
    low = LOWER[buf].astype(np.uint64) + np.uint64(1)
    value = mix(size.astype(np.uint64))
    for i in range(min(TOKEN_BYTES, int(size.max(initial=0)))):
        has = np.flatnonzero(size > i)
        value[has] += low[start[has] + i] * POWERS[i]
    long = np.flatnonzero(size > TOKEN_BYTES)
    if len(long):
        value[long] += _later_blocks(low, start[long] + TOKEN_BYTES, size[long] - TOKEN_BYTES)
    uppers = np.concatenate([np.zeros(1, np.int64), np.cumsum(IS_UPPER[buf])])
    return Tokens(mix(value), np.searchsorted(ends_at, start, side="right"), kind[start] == WORD,
                  uppers[end] - uppers[start], size, start)


def ngram(first: np.ndarray, second: np.ndarray, salt: int) -> np.ndarray:
    """Hash of two adjacent tokens."""
    return mix(first * BASE + second + np.uint64(salt))
