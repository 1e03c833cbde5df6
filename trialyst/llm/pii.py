"""Personal data by anchor expansion.

One Aho-Corasick pass over a whole text finds the anchors: at-signs, plus-signs, digits, URL schemes
and identifier cues. Small deterministic parsers grow each anchor to its boundaries and validate the
result. The base kinds (email, ip, card, phone) are the leftmost non-overlapping matches of fixed
shapes: a parser never starts before the end of its kind's last match, failing matches included.
Added kinds need a cue or scheme: iban (check digits), account and ssn numbers, login (a URL that
holds user and password).

Null text counts as empty; empty texts have no spans. Repeated rows have a result each; other columns
are left out. Spans are ordered by kind as listed in KINDS, then by start.
"""

from __future__ import annotations

import functools
import re
import string

import ahocorasick
from pyspark.sql import DataFrame

from trialyst.llm.spans import spans_of, summary

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "account", "ssn", "login")
DIGITS = frozenset(string.digits)
LETTERS = frozenset(string.ascii_letters)
LOCAL = LETTERS | DIGITS | frozenset("._%+-")
LABEL = LETTERS | DIGITS | frozenset("-")
DIAL = DIGITS | frozenset(" ().-")
CUES = {"iban": "iban", "account": "account", "acct": "account", "ssn": "ssn", "social security": "ssn"}
SCHEMES = ("http://", "https://", "ftp://", "ssh://")
#: What may stand between a cue and its number.
BETWEEN = re.compile(r"[ \t]*(?:(?:number|no|nr|num)\b\.?)?[ \t]*[:#=]?[ \t]*(?:is )?", re.A | re.I)
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9]){5,16}(?![0-9])")
SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9])")
LOGIN = re.compile(r"[A-Za-z0-9._%+-]+:[^\s@/:]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")


@functools.cache
def anchors() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "@+" + string.digits:
        a.add_word(c, ("digit" if c in DIGITS else c, 1))
    for cue, kind in CUES.items():
        for form in (cue, cue.upper(), cue.capitalize(), cue.title()):
            a.add_word(form, (kind, len(form)))
    for scheme in SCHEMES:
        a.add_word(scheme, ("scheme", len(scheme)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    n, end = len(text), at + 1
    while end < n and text[end] in LABEL:
        end += 1
    if start == at or end == at + 1:
        return None
    dotted = False
    while end + 1 < n and text[end] == "." and text[end + 1] in LABEL:
        dotted = True
        end += 2
        while end < n and text[end] in LABEL:
            end += 1
    return (start, end) if dotted else None


def digits_end(text: str, at: int) -> int:
    n = len(text)
    while at < n and text[at] in DIGITS:
        at += 1
    return at


def ip_at(text: str, at: int) -> tuple[int, list[str]]:
    """Where a run of up to four dotted numbers from a digit ends, and the numbers."""
    end = digits_end(text, at)
    parts = [text[at:end]]
    while len(parts) < 4 and end + 1 < len(text) and text[end] == "." and text[end + 1] in DIGITS:
        begin = end + 1
        end = digits_end(text, begin)
        parts.append(text[begin:end])
    return end, parts


def card_at(text: str, at: int) -> int:
    n, end = len(text), at + 1
    while end < n:
        if text[end] in DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    return end


def phone_at(text: str, at: int) -> int | None:
    n, end = len(text), at + 2
    if end > n - 1 or text[at + 1] not in DIGITS:
        return None
    while end < n and text[end] in DIAL:
        end += 1
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    return end if end > at + 3 and text[end - 1] in DIGITS else None


def iban_valid(said: str) -> bool:
    s = said.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def cued(text: str, kind: str, start: int, end: int) -> tuple[int, int] | None:
    """The number that a cue or scheme names."""
    if kind == "scheme":
        m = LOGIN.match(text, end)
        return (start, m.end()) if m else None
    if start and text[start - 1] in LETTERS or end < len(text) and text[end] in LETTERS:
        return None
    at = BETWEEN.match(text, end).end()
    m = {"iban": IBAN, "account": ACCOUNT, "ssn": SSN}[kind].match(text, at)
    return m.span() if m and (kind != "iban" or iban_valid(m[0])) else None


def find(text: str) -> list[tuple[str, int, int]]:
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email = ip = card = 0  # where the next match of the kind may start
    for last, (tag, length) in anchors().iter(text):
        at = last + 1 - length
        if tag == "digit":
            if at >= ip:
                end, parts = ip_at(text, at)
                if len(parts) == 4:
                    ip = end
                    if all(int(p.lstrip("0")[:4] or 0) < 256 for p in parts):
                        out["ip"].append((at, end))
                else:
                    ip = at + len(parts[0])
            if at >= card:
                card = card_at(text, at)
                digits = text[at:card].replace(" ", "").replace("-", "") if 13 <= card - at <= 37 else ""
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append((at, card))
        elif tag == "@":
            if got := email_at(text, at, email):
                email = got[1]
                out["email"].append(got)
        elif tag == "+":
            end = phone_at(text, at)
            if end and 9 <= sum(c in DIGITS for c in text[at:end]) <= 15:
                out["phone"].append((at, end))
        elif got := cued(text, tag, at, last + 1):
            out["login" if tag == "scheme" else tag].append(got)
    return [(k, a, b) for k in KINDS for a, b in sorted(set(out[k]))]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans of every whole text, without a shuffle."""
    return spans_of(docs, find, id_col, text_col)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    return summary(find_pii(docs), "doc_id", BASE)
