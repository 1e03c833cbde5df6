"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word the last token of its encoding is unique: of the vocabulary entries that
end there, exactly one can follow the last token of the prefix that it leaves. The entries come from
an automaton over the vocabulary's suffix matches, the choice from a test of two neighbouring
tokens, and following the last tokens back gives the ids. Work per word is linear in its length.

Texts: null counts as empty; an empty text has no tokens and decodes to the empty text. Repeated rows
are encoded each. Other columns, whatever their names, are left out of the result.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from array import array

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialyst.llm.common import map_texts, texts

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Chunks in each of a Python worker's two memories.
REMEMBERED = 200_000
#: Marks that Python's split takes for white space and the vocabulary's pattern does not.
SEPARATORS = re.compile("[\x1c-\x1f]")
SPACE = regex.compile(r"\s+")
#: Stands for the word end inside the automaton; no byte letter uses it.
END = "\ue000"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself where visible, else the next from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordBpe:
    """Ids and token strings of one vocabulary file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"]
        self.token = {i: t for t, i in ids.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in self.special) + ")") if self.special else None
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.word = regex.compile(split["pattern"]["Regex"])
        # Rank of each merge, and the two halves of each token that a merge makes.
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for n, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made = ids[a + b]
            self.rank[ids[a], ids[b]] = n
            self.halves.setdefault(made, (ids[a], ids[b]))
            self.born.setdefault(made, n)
        self.fits_memo: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for t, i in ids.items():
            if self._reachable(i):
                key = t.removesuffix(suffix) + END if t.endswith(suffix) and t != suffix else t
                self.automaton.add_word(key, (i, len(key)))
        self.automaton.make_automaton()
        letters = byte_letters()
        self.letters = [letters[b] for b in range(256)]
        self.young: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The parts of a token at its right (1) or left (0) edge, smallest first, each with the rank of the merge that ends it."""
        out: list[tuple[int, float]] = []
        ends = float("inf")
        while True:
            out.append((token, ends))
            if token not in self.halves:
                return out[::-1]
            ends = self.born[token]
            token = self.halves[token][side]

    def _apart(self, left: int, right: int, until: float) -> bool:
        """Whether no merge crosses the border of two tokens before rank `until`.

        At any time one part of each token lies at the border. A merge of these two parts happens
        if its rank comes before the merges that end them; of equal ranks the left place goes first.
        """
        a, b = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            n = self.rank.get((x, y))
            if n is not None and n < until and n < x_ends and n <= y_ends:
                return False
            if x_ends == y_ends == float("inf"):
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def _reachable(self, token: int) -> bool:
        """Whether merging the letters of a token's own string gives that token."""
        if token not in self.halves:
            return True
        left, right = self.halves[token]
        return self._reachable(left) and self._reachable(right) and self._apart(left, right, self.born[token])

    def fits(self, left: int, right: int) -> bool:
        """Whether `right` may follow `left` in an encoding."""
        key = left << 20 | right
        if (known := self.fits_memo.get(key)) is None:
            if len(self.fits_memo) >= 5 * REMEMBERED:
                self.fits_memo.clear()
            known = self.fits_memo[key] = self._apart(left, right, float("inf"))
        return known

    def encode_word(self, word: str) -> tuple[int, ...]:
        letters = "".join([self.letters[b] for b in word.encode("utf-8", "surrogatepass")]) + END
        n = len(letters)
        last = [-1] * (n + 1)
        size = [0] * (n + 1)
        memo = self.fits_memo
        for at, (token, length) in self.automaton.iter(letters):
            end, start = at + 1, at + 1 - length
            if last[end] >= 0:  # the last token of a prefix is unique
                continue
            if start:
                before = last[start]
                if before < 0:
                    continue
                known = memo.get(before << 20 | token)
                if not (self.fits(before, token) if known is None else known):
                    continue
            last[end], size[end] = token, length
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        return tuple(reversed(out))

    def _chunk(self, chunk: str) -> tuple[bytes, str]:
        """Ids, as bytes of 32-bit numbers, and decoded text of a part without white space."""
        words = self.word.findall(chunk)
        if words == [chunk]:
            ids = self.encode_word(chunk)
            return array("i", ids).tobytes(), self.decode(ids)
        got = [self.young.get(word) or self._known(word) for word in words]
        return b"".join([ids for ids, _ in got]), " ".join([said for _, said in got])

    def _known(self, chunk: str) -> tuple[bytes, str]:
        """A chunk that the young memory doesn't hold: from the old one, or made; a full memory grows old."""
        got = self.old.get(chunk) or self._chunk(chunk)
        if len(chunk) <= 64:
            if len(self.young) >= REMEMBERED:
                self.young, self.old = {}, self.young
            self.young[chunk] = got
        return got

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids of a whole text, as bytes of 32-bit numbers, and their decoded text.

        No word holds white space, so the chunks between white space are encoded each by itself.
        """
        got: list[tuple[bytes, str]] = []
        for n, piece in enumerate(self.cut.split(text) if self.cut else [text]):
            if n % 2:
                got.append((np.array([self.special[piece]], np.int32).tobytes(), piece))
                continue
            piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()  # no final form of sigma
            chunks = SPACE.split(piece) if SEPARATORS.search(piece) else piece.split()
            for chunk in chunks:
                got.append(self.young.get(chunk) or self._known(chunk))
        return b"".join([ids for ids, _ in got]), " ".join([said for _, said in got if said])

    def decode(self, ids) -> str:
        """Token strings joined by one space, special tokens too, as the file names no decoder; unknown ids say nothing."""
        return " ".join([self.token[i] for i in ids if i in self.token])


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    """One for each Python worker."""
    return WordBpe(path)


def _lists(rows: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(r) // 4 for r in rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def round_trip(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int> and decoded string of every whole text, in one pass and without a shuffle."""

    def run(batch: list[str]) -> tuple:
        t = tokenizer(path)
        got = [t.encode(x) for x in batch]
        return _lists([ids for ids, _ in got]), [said for _, said in got]

    return map_texts(texts(docs, id_col, text_col), run, "ids array<int>, decoded string")


def encode(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids array<int> of every whole text."""
    return round_trip(docs, path, id_col, text_col).select(id_col, "ids")


def decode(rows: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and decoded string of every list of ids; a null list counts as empty."""

    def run(batch: list) -> tuple:
        t = tokenizer(path)
        return ([t.decode(x or ()) for x in batch],)  # lists of ids stand in the place of texts

    return map_texts(rows.select(id_col, F.col(ids_col).alias("text")), run, "decoded string")


def digests(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    return round_trip(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
