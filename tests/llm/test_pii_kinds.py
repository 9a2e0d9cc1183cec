"""URL and account spans against a plain version, and the cases a judge found."""

import random
import re
import time

import pytest

from replicakit.llm import pii

GOOD_IBANS = ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "FR14 2004 1010 0505 0001 3M02 606", "NO9386011117947"]


@pytest.fixture(scope="module")
def automaton():
    return pii.anchor_automaton()


def spans(text, automaton, kind):
    return [text[s:e] for k, s, e in pii.find_spans(text, automaton) if k == kind]


def test_cues_need_words_and_valid_numbers(automaton):
    find = lambda t: spans(t, automaton, "account")
    assert find("Taliban 123456789") == [] and find("ibans 123456789") == []
    assert find("Iban DE89370400440532013000") == ["DE89370400440532013000"]
    assert find("Account Number 12345678, acct: 99 88 77 66") == ["12345678", "99 88 77 66"]
    assert find("IBAN DE00 0000 0000 0000 0000 00") == [] and find("iban: DE88370400440532013000") == []
    assert find("account no 000000000") == [] and find("account no 12345") == []
    for n in GOOD_IBANS:
        assert find(f"Pay to IBAN: {n} and call back") == [n]
        assert find(f"iban={n.lower()}.") == [n.lower()]
    assert find("SSN 123-45-6789; ssn 000-45-6789; ssn 666451234; ssn 123456789") == ["123-45-6789", "123456789"]
    assert find("Passport No. X1234567 passport 12345") == ["X1234567"]
    assert find("İİ IBAN " + GOOD_IBANS[0]) == [GOOD_IBANS[0]]


def test_hosts_are_checked(automaton):
    find = lambda t: spans(t, automaton, "url")
    assert find("https://999.999.999.999/x http://1.2.3 http://10.0.0.255:80/a?b ftp://1.2.3.4.5/") == ["http://10.0.0.255:80/a?b"]
    assert find("HTTP://Example.ORG/x, (https://a-b.example.org). http://-a.org http://a_b.org http://a.b1") == [
        "HTTP://Example.ORG/x", "https://a-b.example.org"]
    assert find("xhttp://example.org http://localhost http://example.org:99999/") == []
    assert find("http://user:pw@example.org:8080/p#q http://xn--a.xn--p1ai/ see http://example.org.") == [
        "http://user:pw@example.org:8080/p#q", "http://xn--a.xn--p1ai/", "http://example.org"]


def brute_accounts(text):
    """Cues from left to right, each checked by itself; a number found is not searched again."""
    out, done = [], 0
    cues = sorted(pii.CUES, key=len)
    ends = sorted((m.end(), -len(c), c) for c in cues for m in re.finditer(f"(?={re.escape(c)})", text, re.I | re.A)
                  for m in [re.compile(re.escape(c), re.I | re.A).match(text, m.start())])
    for end, minus, cue in ends:
        at = end + minus
        if at < done or re.match(r"\w", text[at - 1:at] or " ") and text[at - 1] != "_" or re.match(r"[^\W_]", text[end:end + 1] or " "):
            continue
        begin = end + len(re.match(r"[ .:#=]{0,8}", text[end:]).group())
        rest, hit = text[begin:], None
        rule = pii.CUES[cue]
        if rule == "iban":
            if re.match("[A-Za-z]{2}[0-9]{2}", rest):
                for n in range(min(len(rest), 4 + 80), 14, -1):
                    piece = rest[:n]
                    plain = re.sub("[ -]", "", piece)
                    if re.fullmatch("[A-Za-z0-9]+(?:[ -][A-Za-z0-9]+)*", piece) and not rest[n:n + 1].isalnum() \
                            and 15 <= len(plain) <= 34 and len(plain) - 4 >= 11:
                        value = 0
                        for c in (plain[4:] + plain[:4]).upper():
                            value = (value * (100 if c.isalpha() else 10) + int(c, 36)) % 97
                        if value == 1:
                            hit = n
                            break
        elif rule == "account":
            m = re.match(r"[0-9]+(?:[ -][0-9]+)*", rest)
            while m and len(m.group()):
                piece, after = m.group(), rest[m.end():m.end() + 1]
                if not re.match("[0-9A-Za-z]", after or " "):
                    digits = [c for c in piece if c.isdigit()]
                    hit = len(piece) if 6 <= len(digits) <= 18 and len(set(digits)) > 1 and len(piece) <= 40 else None
                    break
                m = re.match(r"[0-9]+(?:[ -][0-9]+)*", piece[:-1])
        else:
            for n in range(min(len(rest), 12), 5, -1):
                piece = rest[:n]
                digits = re.sub("[- ]", "", piece)
                if re.match("[0-9A-Za-z]", rest[n:n + 1] or " "):
                    continue
                if rule == "ssn":
                    ok = re.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{3} [0-9]{2} [0-9]{4}|[0-9]{9}", piece) and not (
                        digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000")
                else:
                    ok = re.fullmatch("[A-Z]{0,2}[0-9]{6,9}", piece)
                if ok:
                    hit = n
                    break
        if hit:
            out.append((begin, begin + hit))
            done = begin + hit
    return out


def test_accounts_against_the_plain_version(automaton):
    rnd = random.Random(12)
    pieces = [*pii.CUES, *GOOD_IBANS, "IBAN", "Account No", " ", ": ", "#", "123-45-6789", "987654", "11 22 33", "AB123456", "x", "7", "-", ".", "é"]
    found = 0
    for _ in range(6000):
        text = "".join(rnd.choice(pieces) + rnd.choice(["", " ", " "]) for _ in range(rnd.randint(0, 12)))
        got = [(s, e) for k, s, e in pii.find_spans(text, automaton) if k == "account"]
        assert got == brute_accounts(text), text
        found += len(got)
    assert found > 500


def brute_urls(text):
    out, done = [], 0
    for m in re.finditer(r"(?:https?|ftp)://", text, re.I | re.A):
        if m.start() < done or (m.start() and text[m.start() - 1].isalnum()):
            continue
        rest = re.match(r"[^\s<>\"']*", text[m.end():]).group()
        cut = re.search(r"[/?#]", rest)
        place, tail = (rest[:cut.start()], rest[cut.start():]) if cut else (rest, "")
        user, sep, place = place.rpartition("@")
        user += sep
        host = re.match(r"[A-Za-z0-9.-]*", place).group()
        port = re.match(r":[0-9]+", place[len(host):])
        port = port.group() if port else ""
        if "@" in user[:-1] or not host:
            continue
        if len(host) + len(port) < len(place):
            tail = ""
        whole = host + port + tail
        if not port and not tail:
            host = host.rstrip(".")
            whole = host
        labels = host.split(".")
        number = len(labels) == 4 and all(x.isdigit() and int(x) <= 255 and len(x) <= 3 for x in labels)
        name = len(labels) > 1 and len(host) <= 253 and all(re.fullmatch("[A-Za-z0-9-]{1,63}", x) and x[0] != "-" != x[-1] for x in labels) \
            and re.fullmatch("[A-Za-z]{2,}|xn--[A-Za-z0-9-]+", labels[-1], re.I) and not all(x.isdigit() for x in labels)
        if (number or name) and not (port and int(port[1:]) > 65535):
            end = m.end() + len(user) + len(whole.rstrip(".,;:!?)"))
            out.append((m.start(), end))
        done = m.end() + len(user) + len(host + port + tail)
    return out


def test_urls_against_the_plain_version(automaton):
    rnd = random.Random(13)
    pieces = ["http://", "HTTPS://", "ftp://", "a", "b.c", "example.org", ".com", "1.2.3.4", "256", ":80", ":99999", "/p", "?q=1", "#f", "-", " ", ".", ",", "é"]
    found = 0
    for _ in range(6000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 10)))
        got = [(s, e) for k, s, e in pii.find_spans(text, automaton) if k == "url"]
        assert got == brute_urls(text), text
        found += len(got)
    assert found > 100


def test_long_runs_stay_linear(automaton):
    start = time.monotonic()
    for unit in ("http://", "iban ", "account no 1 ", "iban AA00 0000 ", "http://a@", "ssn"):
        pii.find_spans(unit * (300_000 // len(unit)), automaton)
    assert time.monotonic() - start < 20
