"""SimHash near duplicates by covering locality-sensitive hashing.

Each bit place has a non-zero vector of four bits. A mask keeps the places whose vector has an odd
product with the mask's own vector. For any three places there is a non-zero vector with an even
product with all of them, so two fingerprints that differ in at most three places agree on all bits
of at least one of the 15 masks: every such pair meets in some table, and none is lost.

Tables hold different fingerprints only, so copies never meet each other. A bucket emits at most one
link per member (its linked members form trees), never its pairs. A bucket of more than `LARGEST`
fingerprints isn't compared: its members go on to the next level, where 15 masks over the bits that
the bucket leaves open split it again. Each level halves the open bits, so the last ones hold few
fingerprints by themselves and the result is exact for any input.

Texts: null counts as empty; a text without words has fingerprint zero and is linked like any other.
Rows without an id take part, but a component is named by its smallest id; without any it is null.
Repeated rows have a result each. Other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialyst.llm.common import column, fresh, map_texts, stored, texts

RADIUS = 3
WORDS = 3
SEED = 42
BITS = 64
#: Fingerprints that a bucket compares at once; larger ones are split by further masks.
LARGEST = 2048
#: Open bits down to which masks split a bucket.
FEW = 11


def simhash(text: str) -> int:
    """The majority of each bit over the hashes of all word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < WORDS:
        return xxhash.xxh64_intdigest(line, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_intdigest
    n = len(words) - WORDS + 1
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[WORDS - 1 :].tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the fingerprint as a signed bigint."""
    return map_texts(texts(docs, id_col, text_col), lambda batch: ([signed(simhash(t)) for t in batch],), "fp bigint")


def masks(places: list[int], radius: int = RADIUS) -> list[int]:
    """2^(radius + 1) - 1 masks over the bit places, covering the radius."""
    vectors = (1 << radius + 1) - 1
    return [sum(1 << p for i, p in enumerate(places) if (1 + i % vectors & v).bit_count() & 1) for v in range(1, vectors + 1)]


def _linked(values: np.ndarray, radius: int) -> np.ndarray:
    """For each of the different values the place of the first one of its tree."""
    n = len(values)
    root = np.arange(n)
    for i in range(n - 1):
        near = np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= radius) + i + 1
        if len(near):
            meet = np.unique(root[np.append(near, i)])
            if len(meet) > 1:
                root[np.isin(root, meet)] = meet[0]
    return root


def _bucket_links(radius: int, largest: int):
    """Streams rows (open bits, bucket, fp), sorted by bucket, into links; buckets above `largest` come out as they are."""

    def run(batches):
        held = np.zeros((0, 3), np.int64)
        passing = None

        def links(rows: np.ndarray, out: list):
            """Compares whole buckets."""
            if not len(rows):
                return
            new = np.flatnonzero(np.any(rows[1:, :2] != rows[:-1, :2], axis=1)) + 1
            for a, b in zip([0, *new.tolist()], [*new.tolist(), len(rows)], strict=True):
                if b - a > 1:
                    values = np.unique(rows[a:b, 2]).view(np.uint64)
                    root = _linked(values, radius)
                    for i in np.flatnonzero(root != np.arange(len(values))):
                        out.append((0, 0, int(values[i].view(np.int64)), int(values[root[i]].view(np.int64))))

        def divisible(row: np.ndarray) -> bool:
            """Buckets of few open bits hold at most 2^FEW fingerprints and are always compared."""
            return (int(row[0]) & ((1 << BITS) - 1)).bit_count() > FEW

        def batch_of(out: list) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["large", "open", "fp", "root"])

        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            out: list = []
            if passing is not None:
                same = np.all(rows[:, :2] == passing, axis=1)
                out += [(1, int(o), int(f), 0) for o, _, f in rows[same].tolist()]
                rows = rows[~same]
                if len(rows):
                    passing = None
            held = np.concatenate([held, rows])
            if len(held):
                tail = held.shape[0] - int(np.all(held[::-1, :2] == held[-1, :2], axis=1).argmin() or len(held))
                whole, held = held[:tail], held[tail:]
                if len(whole):
                    cut = np.flatnonzero(np.any(whole[1:, :2] != whole[:-1, :2], axis=1)) + 1
                    edges = [0, *cut.tolist(), len(whole)]
                    large = [(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b - a > largest and divisible(whole[a])]
                    keep = np.ones(len(whole), bool)
                    for a, b in large:
                        keep[a:b] = False
                        out += [(1, int(o), int(f), 0) for o, _, f in whole[a:b].tolist()]
                    links(whole[keep], out)
                if len(held) > largest and divisible(held[-1]):
                    passing = held[-1, :2].copy()
                    out += [(1, int(o), int(f), 0) for o, _, f in held.tolist()]
                    held = held[:0]
            yield batch_of(out)
        if len(held):
            out = []
            links(held, out)
            yield batch_of(out)

    return run


def _tables(rows: DataFrame, open_col: str | None, radius: int) -> DataFrame:
    """Each fingerprint under every mask over its open bits: (open bits left, bucket, fp)."""
    if open_col is None:
        level = [(((1 << BITS) - 1) & ~m, m) for m in masks(list(range(BITS)), radius)]
        made = F.explode(F.array(*[F.struct(F.lit(signed(rest)).alias("open"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bucket")) for rest, m in level]))
        return rows.select(made.alias("t"), "fp").select("t.open", "t.bucket", "fp")

    def split(batches):
        known: dict[int, list[tuple[int, int]]] = {}
        for batch in batches:
            opened = batch.column(0).to_numpy(zero_copy_only=False)
            fps = batch.column(1).to_numpy(zero_copy_only=False)
            for bits in np.unique(opened).tolist():
                word = bits & ((1 << BITS) - 1)
                if word not in known:
                    known[word] = [(word & ~m, ((1 << BITS) - 1) & ~word | m) for m in masks([p for p in range(BITS) if word >> p & 1], radius)]
                own = fps[opened == bits]
                for rest, fixed in known[word]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), signed(rest))), pa.array(own & signed(fixed)), pa.array(own)], names=["open", "bucket", "fp"])

    return rows.select(open_col, "fp").distinct().mapInArrow(split, "open bigint, bucket bigint, fp bigint")


def links(distinct: DataFrame, radius: int = RADIUS, largest: int = LARGEST) -> DataFrame:
    """(fp, root): enough links within the radius to connect every pair within it."""
    found = None
    rows, open_col = distinct, None
    while True:
        level = _tables(rows, open_col, radius).repartition("open", "bucket").sortWithinPartitions("open", "bucket")
        level = stored(level.mapInArrow(_bucket_links(radius, largest), "large bigint, open bigint, fp bigint, root bigint"), "bucket-links")
        new = level.where("large = 0").select("fp", "root").distinct()
        found = new if found is None else found.union(new)
        rows, open_col = level.where("large = 1"), "open"
        if rows.isEmpty():
            return found.distinct()


def components(edges: DataFrame, left: str = "fp", right: str = "root") -> DataFrame:
    """(fp, root): each linked node and the least node it can reach.

    Every round takes the least label among a node's neighbours and then jumps to that label's own
    label; labels are stored after each round, and the driver sees only the number of changes.
    """
    both = stored(edges.select(F.col(left).alias("a"), F.col(right).alias("b")).union(edges.select(F.col(right).alias("a"), F.col(left).alias("b"))).distinct(), "edges")
    label = stored(both.groupBy(F.col("a").alias("fp")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(label.select(F.col("fp").alias("b"), "root"), "b").groupBy(F.col("a").alias("fp")).agg(F.min("root").alias("near"))
        step = label.join(near, "fp").select("fp", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = step.select(F.col("fp").alias("root"), F.col("root").alias("jump"))
        moved = stored(step.join(jump, "root").select("fp", "was", F.least("root", "jump").alias("root")), "labels")
        label = moved.select("fp", "root")
        if moved.where("was <> root").isEmpty():
            return label


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, largest: int = LARGEST) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id of every document."""
    marks = stored(fingerprints(docs, id_col, text_col), "simhash")
    distinct = stored(marks.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    label = components(links(distinct.select("fp"), radius, largest))
    named = distinct.join(label, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marks.join(of, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the row of the smallest id of each component; rows without an id stay."""
    key = fresh(docs, "_dropped_id")
    dropped = near_groups(docs, id_col, text_col).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(key)).distinct()
    return docs.join(dropped, column(docs, id_col) == F.col(key), "left_anti")
