"""Token counts by trie-shared dynamic programming over a unigram model.

The distinct pre-tokens of each batch of texts form a trie. A node's forward score, the best score of any
segmentation of its prefix, depends on the prefix alone: it is computed once and shared by all
pre-tokens that go through the node. A pre-token's count is stored where it ends. Each Python worker
remembers terminal counts over its tasks, so the work grows with distinct prefixes; no rows are shuffled.
Forgetting them changes no count.

The vocabulary is a public piece file. Its pieces stand in order of frequency, so the unigram score
of a piece is taken from Zipf's law over its rank: -ln(rank + 2), in millionths as whole numbers, so
that sums are exact in any order. Of segmentations with equal scores the one with fewer tokens counts.
A character outside the vocabulary costs its UTF-8 bytes, each a byte token.

Pre-tokens are runs of other characters than white space, with a space mark for one space before them
(and at the start of a text), and every further white-space character by itself: counts cover whole
texts. Null text counts as empty with no tokens. Repeated rows have a result each; other columns are
left out.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter

import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame

from trialyst.llm.common import map_texts, texts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Terminal counts that a Python worker remembers; beyond this it starts anew.
TERMINALS = 400_000
MARK = "▁"
PRETOKEN = re.compile(r" ?\S+|\s")
UNIT = 1_000_000


@functools.lru_cache(maxsize=2)
def scores(path: str) -> tuple[dict[str, int], dict[str, list[int]], int]:
    """Score of each piece, the lengths of pieces by their last character, and the score of a byte token."""
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    table = {p: -round(math.log(rank + 2) * UNIT) for rank, p in enumerate(plain)}
    lengths: dict[str, set[int]] = {}
    for p in table:
        lengths.setdefault(p[-1], set()).add(len(p))
    return table, {c: sorted(x) for c, x in lengths.items()}, -round(math.log(len(plain) + 2) * UNIT)


class Trie:
    """Counts of distinct pre-tokens.

    New pre-tokens of a batch are put in order, which walks their trie from left to right: the stack
    holds the forward scores of the current path, and a pre-token goes on from what it shares with
    the one before. Terminal counts are remembered.
    """

    def __init__(self, path: str):
        self.table, self.lengths, self.byte = scores(path)
        self.ends: dict[str, int] = {}

    def insert(self, words: set[str]) -> None:
        if len(self.ends) > TERMINALS:
            self.ends.clear()
        table, lengths, ends = self.table, self.lengths, self.ends
        last, path = "", [(0, 0)]
        for word in sorted([w for w in words if w not in ends]):
            shared = 0
            for a, b in zip(last, word):  # noqa: B905  the shorter one ends it
                if a != b:
                    break
                shared += 1
            del path[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                c = word[end - 1]
                n_bytes = 1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))
                s, n = path[end - 1]
                top = (s + n_bytes * self.byte, n - n_bytes)
                for size in lengths.get(c, ()):
                    if size > end:
                        break
                    piece = table.get(word[end - size : end])
                    if piece is not None:
                        s, n = path[end - size]
                        if (made := (s + piece, n - 1)) > top:
                            top = made
                path.append(top)
            ends[word] = -path[-1][1]
            last = word

    def count(self, word: str) -> int:
        if word not in self.ends:
            self.insert({word})
        return self.ends[word]


@functools.lru_cache(maxsize=2)
def trie(path: str) -> Trie:
    return Trie(path)


def pretokens(text: str) -> list[str]:
    return [x.replace(" ", MARK, 1) if x[0] == " " else x for x in PRETOKEN.findall(" " + text if text else "")]


def count_tokens(docs: DataFrame, path: str = PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens and n_pretokens of every whole text."""

    def run(batch: list[str]) -> tuple:
        t = trie(path)
        own = [Counter(pretokens(x)) for x in batch]
        t.insert(set().union(*own))
        return [sum(t.ends[w] * n for w, n in c.items()) for c in own], [c.total() for c in own]

    return map_texts(texts(docs, id_col, text_col), run, "n_tokens bigint, n_pretokens bigint", rows=1024)
