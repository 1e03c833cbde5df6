"""Secrets: fixed shapes, and random strings by token efficiency.

A byte-level vocabulary spends few tokens on words and many on random characters. Each long run of
key characters is encoded; fewer than `LEAST_RATIO` characters per token expose it as random. So do its
neighbouring parts that aren't words or numbers, and each such part, where words beside them hide it.
Known digests (hexadecimal of a digest's length), UUIDs, and identifiers, whose parts are all words or
numbers by themselves, are left alone. Of a run that a base span touches, the rest is tested.

Base spans are leftmost non-overlapping matches of fixed shapes; the shapes below give the same spans
as the open-ended ones with a filter, as a run that is too short can't hold a longer one.
Null text counts as empty; empty texts have no spans. Repeated rows have a result each; other columns
are left out. Spans are ordered by start, then by kind as listed in KINDS.
"""

from __future__ import annotations

import base64
import functools
import re

import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame

from trialyst.llm.spans import spans_of, summary

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")
LEAST_RATIO = 2.2
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.I)
UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)
PART = re.compile(r"[A-Za-z0-9]+")
#: A number, or a word with a short number.
NAME = re.compile(r"[0-9]+|([A-Za-z]+)[0-9]{0,4}")
LEAST = 16
#: Letters from which on a part must read like a word.
LONG_WORD = 8
#: Words in plain case may be of languages that the vocabulary knows less.
FOREIGN = 0.8


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ratio(said: str, path: str = RANKS) -> float:
    return len(said) / max(1, len(vocabulary(path).encode_ordinary(said)))


def is_name(part: str, path: str, least: float) -> bool:
    m = NAME.fullmatch(part)
    word = m[1] or "" if m else ""
    if word.islower() or word.istitle() or word.isupper():
        word, least = word.lower(), least * FOREIGN
    return bool(m) and (len(word) < LONG_WORD or ratio(word, path) >= least)


def random_spans(said: str, path: str, least: float) -> list[tuple[int, int]]:
    """Where a run is random: all of it, or else its parts that aren't words or numbers, together or each."""
    if DIGEST.fullmatch(said) or UUID.fullmatch(said):
        return []
    groups: list[list[tuple[int, int]]] = [[]]
    for m in PART.finditer(said):
        if DIGEST.fullmatch(m[0]) or is_name(m[0], path, least):
            groups.append([])
        else:
            groups[-1].append(m.span())
    groups = [g for g in groups if g]
    if not groups:
        return []
    if ratio(said, path) < least:
        return [(0, len(said))]
    out = []
    for g in groups:
        for tried in ([(g[0][0], g[-1][1])], g):
            found = [(a, b) for a, b in tried if b - a >= LEAST and ratio(said[a:b], path) < least]
            if found:
                out += found
                break
    return out


def find(text: str, path: str = RANKS, least: float = LEAST_RATIO) -> list[tuple[str, int, int]]:
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    base = sorted((a, b) for _, a, b in out)
    at, covered = 0, 0  # base spans that begin before the run's end, and where they end
    for m in RUN.finditer(text):
        a, b = m.span()
        rest = []
        a = max(a, min(covered, b))
        while at < len(base) and base[at][0] < b:
            rest.append((a, base[at][0]))
            covered = max(covered, base[at][1])
            a = max(a, min(covered, b))
            at += 1
        for x, y in [*rest, (a, b)]:
            if y - x >= LEAST:
                out += [("random", x + i, x + j) for i, j in random_spans(text[x:y], path, least)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def find_secrets(docs: DataFrame, path: str = RANKS, least: float = LEAST_RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans of every whole text, without a shuffle."""
    return spans_of(docs, lambda t: find(t, path, least), id_col, text_col)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    return summary(find_secrets(docs), "doc_id", BASE)
