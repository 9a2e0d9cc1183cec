"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors (at-signs, plus signs, digits, schemes and
identifier cues) in one pass over the lower-cased text. At each anchor a small deterministic
parser expands to the left and right, checks what it found and says where the search for its
kind goes on. Cues and schemes stand as words of their own; hosts are checked by label and
top-level name, or as four numbers; account numbers by the rule of their cue (IBANs by their
check digits). Nothing is tried again inside a stretch that a parser has dealt with, so
the work is linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replicakit.llm.common import text_of

#: Kinds in the order in which spans are listed; the first four are the contract's.
KINDS = ("email", "ip", "card", "phone", "url", "account")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBER = re.compile(r"[0-9]+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Anchors in lower case. A cue's rule says what its number must be.
SCHEMES = ("http://", "https://", "ftp://")
CUES = {
    "iban": "iban", "ssn": "ssn", "social security number": "ssn", "social security no": "ssn",
    "passport": "passport", "passport no": "passport", "passport number": "passport",
    "account no": "account", "account number": "account", "account nr": "account", "acct": "account", "a/c": "account",
    "bank account": "account", "konto": "account", "kontonummer": "account",
}
HOST = re.compile(r"(?:[^\s/?#@<>\"']*@)?([A-Za-z0-9.-]+)(?::([0-9]+))?(?:[/?#][^\s<>\"']*)?")
LABEL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?")
TOP = re.compile(r"[A-Za-z]{2,63}|[Xx][Nn]--[A-Za-z0-9-]{1,59}")
#: What may lie between a cue and its number, and the characters of numbers in groups.
GAP = re.compile(r"[ .:#=]{0,8}")
IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[ -]?[A-Za-z0-9]){11,40}")
SSN = re.compile(r"(?!000|666|9)[0-9]{3}([- ]?)(?!00)[0-9]{2}\1(?!0000)[0-9]{4}(?![0-9A-Za-z])")
PASSPORT = re.compile(r"[A-Z]{0,2}[0-9]{6,9}(?![0-9A-Za-z])")
ACCOUNT = re.compile(r"[0-9]+(?:[ -][0-9]+)*(?![0-9A-Za-z])")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


# Each parser takes (text, anchor's start, anchor's end, where its kind's search stands) and
# gives (span or None, where the search goes on).

def parse_email(text: str, at: int, _: int, low: int):
    start = at
    while start > low and text[start - 1] in LOCAL:
        start -= 1
    m = DOMAIN.match(text, at + 1) if start < at else None
    return ((start, m.end()), m.end()) if m else (None, max(low, at + 1))


def parse_ip(text: str, at: int, _: int, low: int):
    m = IP.match(text, at)
    if not m:  # nor does one start at a later digit of this number
        return None, NUMBER.match(text, at).end()
    fits = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))
    return (m.span() if fits else None), m.end()


def parse_card(text: str, at: int, _: int, low: int):
    m = CARD.match(text, at)
    if not m:
        return None, at + 1
    digits = m.group().replace(" ", "").replace("-", "")
    return (m.span() if 16 <= len(digits) <= 19 and luhn(digits) else None), m.end()


def parse_phone(text: str, at: int, _: int, low: int):
    m = PHONE.match(text, at)
    if not m:
        return None, at + 1
    return (m.span() if 8 <= sum(c in DIGITS for c in m.group()) <= 15 else None), m.end()


def host_fits(host: str) -> bool:
    """A dotted name with a top-level name of letters, or four numbers up to 255."""
    labels = host.split(".")
    if len(host) > 253 or len(labels) < 2:
        return False
    if all(x.isdigit() for x in labels):
        return len(labels) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in labels)
    return all(LABEL.fullmatch(x) for x in labels) and TOP.fullmatch(labels[-1]) is not None


def parse_url(text: str, at: int, end: int, low: int):
    if at > 0 and text[at - 1].isalnum():
        return None, end
    m = HOST.match(text, end)
    if not m:
        return None, end
    bare = m.end() == m.end(1)  # a host at the end of a sentence
    host = m.group(1).rstrip(".") if bare else m.group(1)
    if not host_fits(host) or (m.group(2) and int(m.group(2)[:6]) > 65535):
        return None, m.end()
    stop = m.start(1) + len(host) if bare else m.end()
    while text[stop - 1] in ".,;:!?)":
        stop -= 1
    return (at, stop), m.end()


def iban_fits(number: str) -> bool:
    """Country, check digits and 11 to 30 more, with remainder 1 by 97 (ISO 13616)."""
    moved = (number[4:] + number[:4]).upper()
    return 15 <= len(number) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _iban(text: str, at: int):
    m = IBAN.match(text, at)
    if not m:
        return None
    # The longest one that ends with a group; words may follow it.
    for stop in range(m.end(), at + 14, -1):
        if (stop == len(text) or not text[stop].isalnum()) and text[stop - 1].isalnum():
            if iban_fits(re.sub("[ -]", "", text[at:stop])):
                return at, stop
    return None


def _account(text: str, at: int):
    m = ACCOUNT.match(text, at)
    digits = re.sub("[ -]", "", m.group()) if m and m.end() - at <= 40 else ""
    return m.span() if 6 <= len(digits) <= 18 and len(set(digits)) > 1 else None


def _plain(pattern: re.Pattern):
    def find(text: str, at: int):
        m = pattern.match(text, at)
        return m.span() if m else None
    return find


#: How each rule finds its number from a place on.
RULES = {"iban": _iban, "ssn": _plain(SSN), "passport": _plain(PASSPORT), "account": _account}


def parse_account(rule: str):
    def parse(text: str, at: int, end: int, low: int):
        if (at > 0 and text[at - 1].isalnum()) or (end < len(text) and text[end].isalnum()):
            return None, max(low, at)  # part of a longer word: a longer cue may start here
        span = RULES[rule](text, GAP.match(text, end).end())
        return span, span[1] if span else max(low, at)
    return parse


#: Anchors and the (kind, parser) pairs they start.
ANCHORS = {
    "@": (("email", parse_email),),
    "+": (("phone", parse_phone),),
    **{d: (("ip", parse_ip), ("card", parse_card)) for d in sorted(DIGITS)},
    **{s: (("url", parse_url),) for s in SCHEMES},
    **{c: (("account", parse_account(rule)),) for c, rule in CUES.items()},
}


def anchor_automaton():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for anchor, parsers in ANCHORS.items():
        automaton.add_word(anchor, (len(anchor), parsers))
    automaton.make_automaton()
    return automaton


def find_spans(text: str, automaton) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) by kind in the order of ``KINDS``, then start."""
    # Anchors are found without regard to case; one character, whose lower form is two, is put aside.
    lowered = text.replace("\u0130", "i").lower()
    low = dict.fromkeys(KINDS, 0)
    found: dict[str, list] = {k: [] for k in KINDS}
    for last, (size, parsers) in automaton.iter(lowered):
        at = last + 1 - size
        for kind, parse in parsers:
            if at >= low[kind]:
                span, low[kind] = parse(text, at, last + 1, low[kind])
                if span:
                    found[kind].append(span)
    return [(k, s, e) for k in KINDS for s, e in found[k]]


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``spans``, an array of (kind, start, end)
    by kind in the order of ``KINDS``, then start; code points, ends exclusive.

    Null and empty texts have no spans; an empty table gives no rows; repeated rows are
    scanned alike; extra columns are ignored. Kinds are searched independently of each
    other, so spans of different kinds may overlap. There is no shuffle.
    """
    # The identifier travels as text: pandas has no whole numbers with nulls.
    rows = docs.select(docs[id_col].cast("string").alias("doc_id"), text_of(docs, text_col).alias("body"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = anchor_automaton()
        for batch in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t, automaton)]
                     for t in batch["body"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "spans": pd.Series(spans, dtype=object)})

    out = rows.mapInPandas(scan, "doc_id string, spans array<struct<kind:string,start:bigint,end:bigint>>")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
