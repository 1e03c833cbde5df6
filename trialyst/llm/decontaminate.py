"""Benchmark decontamination by template windows.

A text becomes lower-case words in three readings: as they are, so that a copy in any case and at any
place of a sentence is met; with numbers and the units that follow them replaced by typed placeholders;
and with title-cased words, wherever they stand, replaced as well, since they may be names. What stood
there is kept as the slot's value. Windows of `WINDOW` words are hashed in each reading that differs. A
document window that equals an item window in one of them is joined with it by hash; at one offset the
slots of both must be consistent: each value of the item has one value in the document, the most frequent
one there, so a re-parameterised question with other numbers or names is found and a chance mix is not.
Windows that contradict it aren't counted, unless they equal the item's as they are. A document holds
an item if the windows counted cover at least `COVERAGE` of the item's windows.

Documents are scanned once. A bitmap of the items' window hashes, of a fixed size and made by an
aggregate, lets only windows that may match out of the scan; the join that follows is exact, so the
bitmap changes no result, whatever the number of items.

Null and empty texts have no windows. Windows need `LITERAL` words that aren't placeholders to be met with
other values; as they are, all windows are met. Coverage is taken of all windows of an item, or of those
with so many words if these are covered better; `n_windows` and `n_matched` are those of that share. An item
shorter than a window is one window of its own length; items of fewer than `SHORTEST` words are passed
over, as any text holds them. Repeated rows of an id count once, as do repeated items. Rows without an
id are matched too (as one document without id) and never removed by `drop_leaks`. Other columns are
left out of `leaks` and kept by `drop_leaks`.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialyst.llm.common import column, fresh, texts

WINDOW = 8
LITERAL = 5
SHORTEST = 5
COVERAGE = 0.4
#: Bits of the bitmap: 2 MB, whatever the benchmark.
BITMAP_BITS = 24
TOKEN = re.compile(r"[0-9]+(?:[.,:/][0-9]+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?\n]|[%$€£°]")
NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"
#: Units that a number may have.
UNITS = frozenset(
    "% $ € £ ° mm cm m km g kg mg t l ml s sec second seconds min minute minutes h hour hours day days week weeks month months year years inch inches foot feet yard yards mile miles "
    "ounce ounces pound pounds lb lbs gallon gallons liter liters litre litres meter meters metre metres gram grams kilogram kilograms kilometer kilometers kilometre kilometres dollar dollars "
    "cent cents euro euros percent degree degrees watt watts volt volts newton newtons joule joules".split()
)


WORD_KIND, NUMBER_KIND, STOP_KIND, SIGN_KIND = range(4)
#: Tokens that a Python worker remembers.
REMEMBERED = 200_000


class Tokens:
    """Hash and kind of each token seen, in arrays."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.hash = np.zeros(1024, np.uint64)
        self.kind = np.zeros(1024, np.int8)
        self.unit = np.zeros(1024, bool)
        self.title = np.zeros(1024, bool)

    def _add(self, token: str) -> int:
        i = self.known[token] = len(self.known)
        if i >= len(self.hash):
            self.hash, self.kind, self.unit, self.title = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hash, self.kind, self.unit, self.title))
        low = token.lower()
        self.hash[i] = word_hash(low)
        self.kind[i] = STOP_KIND if token in ".!?\n" else SIGN_KIND if token in "%$€£°" else NUMBER_KIND if token[0] in "0123456789" else WORD_KIND
        self.unit[i] = low in UNITS
        self.title[i] = len(token) > 1 and token[0].isupper() and token[1:].islower()
        return i

    def places(self, tokens: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.clear()
        known, add = self.known, self._add
        return np.fromiter((i if (i := known.get(t)) is not None else add(t) for t in tokens), np.int64, len(tokens))


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


TOKENS = Tokens()  # one for each Python worker
SLOTS = {"n": np.uint64(word_hash(NUMBER)), "u": np.uint64(word_hash(UNIT)), "p": np.uint64(word_hash(NAME))}


#: Readings of a window: words as they are, without numbers and units, without names too.
PLAIN, COUNTED, NAMED = range(3)


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of neighbours, in their order."""
    mixed = left * np.uint64(0x9E3779B97F4A7C15)
    mixed += right
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    return mixed


def _rolled(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash for each window, from windows of 1, 2, 4 .. words."""
    n = len(hashes) - length + 1
    made, done, size = None, 0, 1 << (length.bit_length() - 1)
    powers = {1: hashes}
    k = 1
    while k < size:
        powers[2 * k] = _joined(powers[k][:-k], powers[k][k:])
        k *= 2
    while size:
        if length & size:
            part = powers[size][done : done + n]
            made = part if made is None else _joined(made, part)
            done += size
        size >>= 1
    return made


class Template:
    """The readings of one text: a hash for each word, and which words are slots."""

    def __init__(self, text: str):
        tokens = TOKEN.findall(text)
        at = TOKENS.places(tokens)
        kind = TOKENS.kind[at]
        before = np.concatenate([[STOP_KIND], kind[:-1]]) if len(at) else kind
        number = kind == NUMBER_KIND
        unit = TOKENS.unit[at] & (before == NUMBER_KIND)
        keep = np.flatnonzero((kind == WORD_KIND) | number | unit)
        self.tokens, self.keep = tokens, keep
        number, unit = number[keep], unit[keep]
        name = TOKENS.title[at[keep]] & ~unit
        plain = TOKENS.hash[at[keep]]
        counted = plain.copy()
        counted[number] = SLOTS["n"]
        counted[unit] = SLOTS["u"]
        named = counted.copy()
        named[name] = SLOTS["p"]
        self.hashes = (plain, counted, named)
        self.slot = np.zeros(len(keep), np.int8)
        self.slot[number], self.slot[unit], self.slot[name] = 1, 2, 3

    def __len__(self) -> int:
        return len(self.keep)

    @staticmethod
    def held(mark: np.ndarray, length: int) -> np.ndarray:
        """Marked words of each window."""
        ends = np.concatenate([[0], np.cumsum(mark)])
        return ends[length:] - ends[:-length]

    def firm(self, length: int) -> np.ndarray:
        """Whether each window has enough literal words to be met with all its slots changed."""
        return self.held(self.slot == 0, length) >= min(LITERAL, length)

    def windows(self, length: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(reading, positions, hashes) of all windows as they are, and of those with slots and enough literal words."""
        n = len(self) - length + 1
        if n <= 0:
            return []

        names, counts = self.held(self.slot == 3, length), self.held((self.slot == 1) | (self.slot == 2), length)
        least = min(LITERAL, length)
        fits = {PLAIN: np.ones(n, bool), COUNTED: (counts > 0) & (length - counts >= least), NAMED: (names > 0) & (length - counts - names >= least)}
        out = []
        for reading, fit in fits.items():
            at = np.flatnonzero(fit)
            if len(at):
                with np.errstate(over="ignore"):
                    out.append((reading, at, _rolled(self.hashes[reading], length)[at].view(np.int64)))
        return out

    def values(self, at: int, length: int, reading: int) -> list[str]:
        """What stands in each slot of a window; empty for a word that the reading keeps."""
        last = (0, 2, 3)[reading]
        return ["nup"[k - 1] + ":" + self.tokens[i].lower() if 0 < k <= last else "" for i, k in zip(self.keep[at : at + length].tolist(), self.slot[at : at + length].tolist(), strict=True)]


SHAPE = "length int, position int, hash bigint, slots array<string>, total int, firm boolean, firm_total int"


def _item_rows(batches):
    for batch in batches:
        out: list[list] = [[], [], [], [], [], [], [], []]
        for i, text in zip(batch.column(0), batch.column(1), strict=True):
            t = Template(text.as_py())
            length = min(WINDOW, len(t))
            if length < SHORTEST:
                continue
            firm = t.firm(length).tolist()
            for reading, at, hashes in t.windows(length):
                for a, h in zip(at.tolist(), hashes.tolist(), strict=True):
                    for col, x in zip(out, (i.as_py(), length, a, h, t.values(a, length, reading), len(firm), firm[a], sum(firm)), strict=True):
                        col.append(x)
        kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.int32(), pa.bool_(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["item_id", "length", "position", "hash", "slots", "total", "firm", "firm_total"])


def _mark(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, length, position, hash, slots, total, firm, firm_total: the windows of every item in their readings."""
    items = texts(benchmark, id_col, text_col).distinct()
    return items.mapInArrow(_item_rows, f"{id_col} {items.schema[id_col].dataType.simpleString()}, {SHAPE}")


def bitmap(found: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Which hash beginnings the items have, and the lengths of their windows (at most WINDOW of them).

    An aggregate of at most 2^24 / 64 words comes to the driver, however many items there are.
    """
    word = F.shiftrightunsigned("hash", 64 - BITMAP_BITS)
    rows = found.groupBy((F.shiftright(word, 6)).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - BITMAP_BITS}) & 63 as int))")).alias("bits"), F.collect_set("length").alias("lengths"))
    got = rows.toArrow()
    bits = np.zeros((1 << BITMAP_BITS) // 64, np.int64)
    bits[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return bits, sorted({n for x in got.column("lengths").to_pylist() for n in x})


def document_windows(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, length, position, hash, slots of the windows of whole texts whose hash an item may have."""
    bits, lengths = bitmap(found)
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                t = Template(text.as_py())
                for length in lengths:
                    for reading, at, hashes in t.windows(length):
                        mark = _mark(hashes)
                        hit = (sent.value[mark >> 6] >> (mark & 63)) & 1 == 1
                        for a, h in zip(at[hit].tolist(), hashes[hit].tolist(), strict=True):
                            for col, x in zip(out, (i.as_py(), length, a, h, t.values(a, length, reading)), strict=True):
                                col.append(x)
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=[id_col, "length", "position", "hash", "slots"])

    whole = texts(docs, id_col, text_col)
    return whole.mapInArrow(run, f"{id_col} {whole.schema[id_col].dataType.simpleString()}, length int, position int, hash bigint, slots array<string>")


def _consistent(wins: list[dict]) -> tuple[int, set[tuple[int, bool]]]:
    """How many slots changed in the windows that agree, and their places and whether they are firm."""
    slots = [[(w["place"] + k, i, d) for k, (i, d) in enumerate(zip(w["i"], w["d"], strict=True)) if i] for w in wins]
    met: dict[str, Counter] = {}
    for _, i, d in {s for w in slots for s in w}:
        met.setdefault(i, Counter())[d] += 1
    usual = {i: min(c, key=lambda d: (-c[d], d)) for i, c in met.items()}
    kept, changed = set(), set()
    for w, own in zip(wins, slots, strict=True):
        if all(i == d for _, i, d in own) or all(usual[i] == d for _, i, d in own):
            kept.add((w["place"], w["firm"]))
            changed.update((i, d) for _, i, d in own if i != d)
    return len(changed), kept


def _kept_windows(batches):
    """Rows (id, item_id, total, firm_total, wins) into a row for each window that agrees: an item value has its most frequent document value."""
    for batch in batches:
        at: list[int] = []
        changes: list[int] = []
        places: list[tuple[int, bool]] = []
        for row, wins in enumerate(batch.column(4)):
            changed, kept = _consistent(wins.as_py())
            at += [row] * len(kept)
            changes += [changed] * len(kept)
            places += sorted(kept)
        same = batch.select([0, 1, 2, 3]).take(pa.array(at, pa.int64()))
        made = [pa.array(changes, pa.int32()), pa.array([p for p, _ in places], pa.int32()), pa.array([f for _, f in places], pa.bool_())]
        yield pa.RecordBatch.from_arrays([*same.columns, *made], names=[*same.schema.names, "changed", "place", "firm"])


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, item_id, n_windows, n_matched, coverage, changed_slots of every document that holds an item."""
    items = item_windows(benchmark)
    mine = document_windows(docs, items, id_col, text_col)
    both = mine.join(items.select("item_id", "total", "firm", "firm_total", "length", "hash", F.col("position").alias("item_at"), F.col("slots").alias("item_slots")), ["length", "hash"])
    wins = F.collect_set(F.struct(F.col("item_at").alias("place"), "firm", F.col("item_slots").alias("i"), F.col("slots").alias("d")))
    # At one offset an item place meets one document place: the lists are as long as the item.
    placed = both.groupBy(id_col, "item_id", "total", "firm_total", (F.col("position") - F.col("item_at")).alias("offset")).agg(wins.alias("wins")).drop("offset")
    kind = {c: placed.schema[c].dataType.simpleString() for c in (id_col, "item_id")}
    spread = placed.mapInArrow(_kept_windows, f"`{id_col}` {kind[id_col]}, item_id {kind['item_id']}, total int, firm_total int, changed int, place int, firm boolean")
    once = spread.groupBy(id_col, "item_id", "total", "firm_total", "place", "firm").agg(F.min("changed").alias("changed"))
    held = once.groupBy(id_col, "item_id", "total", "firm_total").agg(F.count(F.lit(1)).alias("n_all"), F.count_if("firm").alias("n_firm"), F.max("changed").cast("long").alias("changed_slots"))
    # Of all windows, or of those that can be met with other values, whichever is covered better.
    of_all, of_firm = F.col("n_all") / F.col("total"), F.coalesce(F.try_divide(F.col("n_firm"), F.col("firm_total")), F.lit(0.0))
    n_windows, n_matched = (F.when(of_firm > of_all, F.col(a)).otherwise(F.col(b)) for a, b in (("firm_total", "total"), ("n_firm", "n_all")))
    share = F.greatest(of_all, of_firm)
    return held.where(share >= coverage).select(id_col, "item_id", n_windows.cast("long").alias("n_windows"), n_matched.alias("n_matched"), share.alias("coverage"), "changed_slots")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the documents that hold an item, all columns kept."""
    key = fresh(docs, "_leaked_id")
    leaked = leaks(docs, benchmark, coverage, id_col, text_col).select(F.col(id_col).alias(key)).distinct()
    return docs.join(leaked, column(docs, id_col) == F.col(key), "left_anti")
