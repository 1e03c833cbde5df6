"""Phrase collocations by prefix-free parsing.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and pieces into words. A window of `OVERLAP` words whose
hash is divisible by `SPREAD` starts a new chunk, so equal passages are cut alike wherever they stand. A chunk goes on
for OVERLAP words behind the next start, hence every phrase of up to OVERLAP + 1 words lies whole in the chunk in which it
starts, and it is counted there only. The distinct chunks of a language with their frequencies are the
dictionary; everything after it reads the dictionary instead of the texts and weighs each chunk by its frequency.

Phrases are counted by length. One of k words can reach `LEAST` only if both its parts of k - 1 words have; these are marked
in a bitmap of fixed size (2^BITMAP_BITS bits, however many phrases there are), and only phrases whose parts are marked
are sent on. A wrong mark costs a row and nothing else, as counts are taken and compared exactly afterwards.
Counts are added up inside batches, then before the shuffle, then by (lang, phrase), so that frequent chunks and phrases are no hot keys.

Defined cases: a null text counts as empty, a null lang as `und`; repeated rows count each; very long texts without punctuation are one piece
and are cut by their content alone. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialyst.llm.common import column, stored

LONGEST, LEAST, TOP = 5, 100, 2000
OVERLAP, SPREAD = LONGEST - 1, 16
BITMAP_BITS = 26
#: Shares of a language, so that a language of many phrases is no hot key.
SHARES = 64
#: Bytes of text that a task handles together. A piece goes whole, however long.
BYTES = 1 << 22

_MIX = np.uint64(0x9E3779B97F4A7C15)
# of eight bytes the first n
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Words of more bytes are hashed and compared one by one.
LONG_WORD = 64
# piece ends become line ends and tabs blanks
_CUT = bytes.maketrans(b".,;:!?\x0b\x0c\x0d\t", b"\n" * 9 + b" ")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


class _Words:
    """Where the words of a text begin and end, their hashes, and numbers that are equal for equal words."""

    def __init__(self, text: bytes):
        self.text, self.bytes = text, np.frombuffer(text, np.uint8)
        gap = (self.bytes == 32) | (self.bytes == 10)
        edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.sizes = self.ends - self.starts
        self._eights = np.ndarray((len(text) + 1,), "<u8", text + bytes(8), strides=(1,))  # from every place on

    def _eight(self, words: np.ndarray, skip: int) -> np.ndarray:
        """The next eight bytes of the words, zeros behind their end."""
        return self._eights[self.starts[words] + skip] & _FIRST[np.minimum(self.sizes[words] - skip, 8)]

    def _rounds(self) -> Iterator[tuple[int, np.ndarray]]:
        """(bytes before, words that go on) of the words up to LONG_WORD, eight bytes at a time."""
        words, skip = np.flatnonzero(self.sizes <= LONG_WORD), 0
        while len(words):
            yield skip, words
            skip += 8
            words = words[self.sizes[words] > skip]

    def _long(self) -> list[int]:
        return np.flatnonzero(self.sizes > LONG_WORD).tolist()

    def word(self, i: int) -> bytes:
        return self.text[self.starts[i] : self.ends[i]]

    def hashes(self) -> np.ndarray:
        """A value of the bytes of a word alone."""
        h = self.sizes.astype(np.uint64)
        for skip, words in self._rounds():
            h[words] = _mixed(h[words]) + self._eight(words, skip)
        for i in self._long():
            h[i] = xxhash.xxh3_64_intdigest(self.word(i))
        return _mixed(h)

    def numbers(self) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word, and a word of each number. Words are compared, so equal hashes don't matter."""
        number, found = pd.factorize(self.hashes())
        n = np.arange(len(number))
        like = np.empty(len(found), np.int64)
        like[number[::-1]] = n[::-1]
        same = self.sizes == self.sizes[like[number]]
        for skip, words in self._rounds():
            words = words[same[words]]
            same[words] = self._eight(words, skip) == self._eight(like[number[words]], skip)
        if not same.all() or any(self.word(i) != self.word(like[number[i]]) for i in self._long()):
            each: dict[bytes, int] = {}
            number = np.array([each.setdefault(self.word(i), len(each)) for i in n.tolist()], np.int64)
            like = np.empty(len(each), np.int64)
            like[number[::-1]] = n[::-1]
        return number, like

    def lines(self) -> np.ndarray:
        """The line of each word."""
        return np.cumsum(self.bytes == 10)[self.starts] if len(self.starts) else self.starts


def _windows(h: np.ndarray, words: int) -> np.ndarray:
    """Hash of the `words` words from each place on; only as long as they don't pass the end."""
    n = max(0, len(h) - words + 1)
    out = h[:n].copy()
    for k in range(1, words):
        out = _mixed(out) + h[k : k + n]
    return _mixed(out)


def _parts(text: bytes) -> Iterator[bytes]:
    """The text in parts of about `BYTES`, cut where pieces end."""
    at = 0
    while len(text) - at > BYTES:
        end = text.rfind(b"\n", at, at + BYTES)
        end = text.find(b"\n", at + BYTES) if end < at else end
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:]


def _chunks(texts_: list[bytes], spread: int = SPREAD) -> tuple[Counter, Counter]:
    """The chunks that end their piece and the others, with their numbers."""
    found = Counter(), Counter()
    for text in _parts(b"\n".join(texts_).lower().translate(_CUT)):
        words = _Words(text)
        n = len(words.starts)
        if not n:
            continue
        line = words.lines()
        trigger = np.flatnonzero(_windows(words.hashes(), OVERLAP) % np.uint64(spread) == 0)
        begins = np.ones(n, bool)
        begins[1:] = line[1:] != line[:-1]
        stops = np.append(np.flatnonzero(begins)[1:], n)[np.cumsum(begins) - 1]  # of each word's piece
        begins[trigger[trigger + OVERLAP <= stops[trigger]]] = True
        starts = np.flatnonzero(begins)
        following = np.append(starts[1:], n)
        last = following >= stops[starts]
        until = np.where(last, stops[starts], following + OVERLAP)
        spans = zip(words.starts[starts].tolist(), words.ends[until - 1].tolist(), strict=True)
        slices = [text[a:b] for a, b in spans]
        if b"  " in text:
            slices = [b" ".join(c.split()) if b"  " in c else c for c in slices]
        for ends, counter in zip((True, False), found, strict=True):
            counter.update([slices[i] for i in np.flatnonzero(last == ends).tolist()])
    return found


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    """The rows of each language, which is the first column."""
    sorted_ = batch.take(pc.sort_indices(batch.column(0)))
    lang = sorted_.column(0)
    runs = pc.run_end_encode(lang)
    start = 0
    for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
        yield name, sorted_.slice(start, end - start)
        start = end


def dictionary(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", spread: int = SPREAD) -> DataFrame:
    """lang, chunk, last, n: the distinct chunks of every language and how often they occur in the parse."""
    lang = F.coalesce(column(docs, lang_col).cast("string"), F.lit("und"))
    rows = docs.select(lang.alias("lang"), F.encode(F.coalesce(column(docs, text_col).cast("string"), F.lit("")), "UTF-8").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of, mine in _by_lang(batch):
                for last, found in zip((True, False), _chunks(mine.column(1).to_pylist(), spread), strict=True):
                    n = len(found)
                    made = [pa.array([of] * n, pa.string()), pa.array(found, pa.binary()).cast(pa.string()), pa.array([last] * n, pa.bool_()), pa.array(found.values(), pa.int64())]
                    yield pa.RecordBatch.from_arrays(made, names=["lang", "chunk", "last", "n"])

    return rows.mapInArrow(run, "lang string, chunk string, last boolean, n bigint").groupBy("lang", "chunk", "last").agg(F.sum("n").alias("n"))


def _seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))


def _places(h: np.ndarray, lang: str, bits: int) -> np.ndarray:
    """Of phrases in a bitmap of 2^bits."""
    return (_mixed(h ^ _seed(lang)) >> np.uint64(64 - bits)).astype(np.int64)


class _Batch:
    """Chunks of one language as one row of word numbers."""

    def __init__(self, chunks: list[bytes], last: np.ndarray, n: np.ndarray):
        all_words = _Words(b"\n".join(chunks))
        self.ids, like = all_words.numbers()
        self.words = [all_words.word(i) for i in like.tolist()]
        self.vocabulary = _Words(b"\n".join(self.words)).hashes()
        sizes = np.bincount(all_words.lines(), minlength=len(chunks))
        self.left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(self.ids))  # words from here to the end of the chunk
        self.own = self.left > np.repeat(np.where(last, 0, OVERLAP), sizes)  # phrases that start here are counted here
        self.n = np.repeat(n, sizes)

    def counts(self, k: int, marks: np.ndarray | None, lang: str) -> tuple[list[bytes], np.ndarray]:
        """Phrases of k words whose parts are marked, and their weighted number."""
        at = np.flatnonzero(self.own & (self.left >= k))
        if marks is not None and len(at):
            place = _places(_mixed(self.vocabulary) if k == 2 else _windows(self.vocabulary[self.ids], k - 1), lang, len(marks).bit_length() + 5)
            hit = (marks[place >> 6] >> (place & 63)) & 1 == 1
            hit = hit[self.ids] if k == 2 else hit
            at = at[hit[at] & hit[at + 1]]
        if not len(at):
            return [], at
        # numbers of the phrases so far, and the words of each number
        group, columns, size = self.ids[at], [np.arange(len(self.words))], len(self.words)
        for j in range(1, k):
            found, group = np.unique(group * size + self.ids[at + j], return_inverse=True)
            columns = [c[found // size] for c in columns] + [found % size]
        totals = np.zeros(len(columns[0]), np.int64)
        np.add.at(totals, group, self.n[at])
        there = np.flatnonzero(totals)
        texts_ = [map(self.words.__getitem__, c[there].tolist()) for c in columns]
        return list(map(b" ".join, zip(*texts_, strict=True))), totals[there]


def count_phrases(chunks: DataFrame, k: int, marks: np.ndarray | None = None) -> DataFrame:
    """lang, phrase, f of the phrases of k words in all chunks; with marks, of those that may reach the least number."""
    sent = None if marks is None else chunks.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[pa.RecordBatch]] = {}
        held: Counter = Counter()

        def counted(lang: str) -> pa.RecordBatch:
            del held[lang]
            rows = pa.Table.from_batches(waiting.pop(lang))
            chunks_, last, n = rows.column(1).to_pylist(), rows.column(2).to_numpy(), rows.column(3).to_numpy()
            phrases, totals = _Batch(chunks_, last, n).counts(k, None if sent is None else sent.value, lang)
            made = [pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(totals, pa.int64())]
            return pa.RecordBatch.from_arrays(made, names=["lang", "phrase", "f"])

        for batch in batches:
            for lang, mine in _by_lang(batch):
                for at in range(0, mine.num_rows, 2048):
                    part = mine.slice(at, 2048)
                    waiting.setdefault(lang, []).append(part)
                    held[lang] += part.nbytes
                    if held[lang] > BYTES:
                        yield counted(lang)
            while held.total() > 4 * BYTES:
                yield counted(max(held, key=held.__getitem__))
        while waiting:
            yield counted(next(iter(waiting)))

    rows = chunks.select("lang", F.encode("chunk", "UTF-8").alias("chunk"), "last", "n")
    return rows.mapInArrow(run, "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def marks(phrases: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """The bitmap of all given phrases. At most 2^bits / 64 words come to the driver, however many phrases there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, mine in _by_lang(batch):
                found = mine.column(1).to_pylist()
                h = _Words(b"\n".join(found)).hashes().reshape(len(found), -1)
                out = h[:, 0]
                for j in range(1, h.shape[1]):
                    out = _mixed(out) + h[:, j]
                place = _places(_mixed(out), lang, bits)
                yield pa.RecordBatch.from_arrays([pa.array(place >> 6), pa.array(np.int64(1) << (place & 63))], names=["at", "bits"])

    rows = phrases.select("lang", F.encode("phrase", "UTF-8")).mapInArrow(run, "at bigint, bits bigint")
    got = rows.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros((1 << bits) // 64, np.int64)
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return out


def frequent(chunks: DataFrame, least: int = LEAST, bits: int = BITMAP_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f, k) of all phrases of at least `least` occurrences, and (lang, n) of all words."""
    words = stored(count_phrases(chunks, 1), "words")
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    level = words.where(F.col("f") >= least)
    levels = [level.withColumn("k", F.lit(1))]
    for k in range(2, LONGEST + 1):
        level = stored(count_phrases(chunks, k, marks(level, bits)).where(F.col("f") >= least), f"phrases-{k}")
        levels.append(level.withColumn("k", F.lit(k)))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out, total


def _share(phrase: str) -> Column:
    return F.pmod(F.xxhash64(phrase), F.lit(SHARES)).cast("int")


def scored(found: DataFrame, total: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every phrase of two words or more that no longer one makes redundant."""
    words = F.split("phrase", " ")
    many = found.where(F.col("k") > 1).select("lang", "phrase", F.col("f").alias("a"), "k", words.alias("w"))
    # a longer phrase of equal number holds one with a word more, and as many occurrences
    inner = many.where(F.col("k") > 2).select(
        "lang", F.explode(F.array(F.array_join(F.slice("w", 1, F.col("k") - 1), " "), F.array_join(F.slice("w", 2, F.col("k") - 1), " "))).alias("phrase"), F.col("a").alias("longer")
    )
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = many.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).drop("longer")
    cuts = kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"), "w", "k").select(
        "lang", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("first"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("rest")
    )
    parts = found.select("lang", "phrase", "f")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    # few rows; several of each language, so that the phrases of one language are not one key
    spread = total.select("lang", "n", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
    cuts = cuts.withColumn("share", _share("phrase")).join(spread, ["lang", "share"])
    exact = {c: f"cast({c} as decimal({18 if c == 'n' else 15}, 0))" for c in "alrn"}
    cuts = cuts.withColumn("score", F.expr(f"(1000BD * {exact['a']} * {exact['n']}) div ({exact['l']} * {exact['r']})"))
    least = F.min(F.struct("score", "cut", "l", "r")).alias("c")
    return cuts.groupBy("lang", "phrase", "a", "n").agg(least).select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, spread: int = SPREAD, bits: int = BITMAP_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of every language."""
    chunks = stored(dictionary(docs, text_col, lang_col, spread), "chunks")
    found, total = frequent(chunks, least, bits)
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]

    def first(rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= top)

    # the first of each share, then of these: no language has more than SHARES * top rows in one task
    shared = scored(found, total).withColumn("share", _share("phrase"))
    ranked = first(first(shared, ["lang", "share"]), ["lang"])
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    grams = " union all ".join(f"select lang, {k} as k, array_to_string(w[i : i + {k - 1}], ' ') as phrase from places where i + {k - 1} <= len(w)" for k in range(1, LONGEST + 1))
    return rf"""
with pieces as (
    select coalesce(lang, 'und') as lang,
        unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
words as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
places as (select lang, w, unnest(range(1, len(w) + 1)) as i from words),
f as materialized (select lang, phrase, k, count(*) as f from ({grams}) group by all having count(*) >= {LEAST}),
total as (select lang, sum(len(w))::bigint as n from words group by 1),
many as (select lang, phrase, f as a, k, string_split(phrase, ' ') as w from f where k > 1),
kept as (select m.* from many m where not exists (
    select 1 from many x where x.lang = m.lang and x.k > m.k and 100 * x.a >= 100 * m.a and contains(' ' || x.phrase || ' ', ' ' || m.phrase || ' '))),
cuts as (select *, unnest(range(1, k)) as cut from kept),
scores as (
    select c.lang, c.phrase, c.a, c.cut, l.f as l, r.f as r, t.n, (1000::hugeint * c.a * t.n // (l.f::hugeint * r.f))::bigint as score
    from cuts c join f l on l.lang = c.lang and l.phrase = array_to_string(c.w[1 : c.cut], ' ')
    join f r on r.lang = c.lang and r.phrase = array_to_string(c.w[c.cut + 1 :], ' ') join total t on t.lang = c.lang),
best as (select * from scores qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best)
select lang, rank, phrase, a, l, r, n, score from ranked where rank <= {TOP}
"""


COLLOCATIONS_SQL = _sql()
