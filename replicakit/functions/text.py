"""Name, token and flag handling, as plain Python (driver) and as Columns.

The Column forms are built from Catalyst expressions only, so they run inside
whole-stage codegen over any number of rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from replicakit.constants import (
    DEFAULT_TABLE,
    KNOWN_NAMESPACES,
    NAMESPACE_ALIASES,
    SIDE_A,
    SIDE_A_SPELLINGS,
    SIDE_B,
    SIDE_B_SPELLINGS,
    TABLE_NAME_PATTERN,
    TRUE_WORDS,
)


class UnknownSideError(ValueError):
    """A side spelling that names neither A nor B."""


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- sides (O1)
def canon_side(side: str) -> str:
    """Map a side spelling to ``CA`` or ``CB``; anything else is an error."""
    s = (side or "").lower()
    if s in SIDE_A_SPELLINGS:
        return SIDE_A
    if s in SIDE_B_SPELLINGS:
        return SIDE_B
    raise UnknownSideError(f"unknown side {side!r}")


def canon_side_col(c: Column | str) -> Column:
    """Column form of :func:`canon_side`; unknown spellings give null."""
    low = F.lower(_col(c))
    return (
        F.when(low.isin(*SIDE_A_SPELLINGS), F.lit(SIDE_A))
        .when(low.isin(*SIDE_B_SPELLINGS), F.lit(SIDE_B))
    )


# ----------------------------------------------------------- namespaces (O1)
def map_namespace(ns: str) -> str:
    """Old aliases map to current names, known names to lower case, others pass."""
    low = ns.lower()
    if low in NAMESPACE_ALIASES:
        return NAMESPACE_ALIASES[low]
    if low in KNOWN_NAMESPACES:
        return low
    return ns


def map_namespace_col(c: Column | str) -> Column:
    """Column form of :func:`map_namespace`."""
    col = _col(c)
    low = F.lower(col)
    expr = None
    for old, new in NAMESPACE_ALIASES.items():
        expr = (F.when(low == old, F.lit(new)) if expr is None
                else expr.when(low == old, F.lit(new)))
    return expr.when(low.isin(*KNOWN_NAMESPACES), low).otherwise(col)


# ---------------------------------------------------------- first_token
def token_pattern(vocab: Iterable[str]) -> str:
    """Alternation of the vocabulary, longest word first.

    Longest-first makes the regex engine's leftmost-first choice agree with a
    leftmost-longest search when one word is a prefix of another.
    """
    words = sorted({w.lower() for w in vocab}, key=lambda w: (-len(w), w))
    if not words:
        raise ValueError("empty vocabulary")
    return "(" + "|".join(re.escape(w) for w in words) + ")"


def first_token(c: Column | str, vocab: Iterable[str]) -> Column:
    """First vocabulary word found in the text, ignoring case; null if none.

    The result is in lower case.
    """
    found = F.regexp_extract(F.lower(_col(c)), token_pattern(vocab), 1)
    return F.nullif(found, F.lit(""))


# --------------------------------------------------- checked_table_name
def checked_table_name(c: Column | str, fallback: str = DEFAULT_TABLE) -> Column:
    """Keep names that match the table-name pattern; else the fallback.

    The pattern's ``^``/``$`` become ``\\A``/``\\z`` so it anchors the whole
    string as the shell test does (in Java regex ``$`` also matches before a
    trailing newline).
    """
    col = _col(c)
    whole = r"\A" + TABLE_NAME_PATTERN.removeprefix("^").removesuffix("$") + r"\z"
    return F.when(col.rlike(whole), col).otherwise(F.lit(fallback))


# --------------------------------------------------------------- is_true
def is_true(c: Column | str) -> Column:
    """``1/true/yes/on`` in any case is true; anything else or null is false."""
    return F.coalesce(F.lower(_col(c)).isin(*TRUE_WORDS), F.lit(False))


def is_true_value(v: str | None) -> bool:
    """Driver-side form of :func:`is_true` for a single stored value."""
    return v is not None and v.lower() in TRUE_WORDS
