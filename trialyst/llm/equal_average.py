"""Product codes of vectors by equal-average search.

Every vector is cut into `PARTS` consecutive parts and each part is given the number of the nearest of `ENTRIES`
codebook entries. The search sorts the entries by the sum of their components and goes outward from the sum of the part;
by Cauchy's inequality an entry whose sum differs by g is at least g * g / dimension away, so a side ends once
that strictly exceeds the best distance. Equal distances go to the lower index.

Arithmetic is in whole numbers: a component x is floor(1024 * x). A round reads the vectors, finds the entries in
Arrow batches and adds up counts and component sums per entry inside each task, so the exchange carries at most PARTS * ENTRIES
rows a task; the driver holds one codebook (PARTS * ENTRIES rows), which goes to the tasks with the function.

Defined cases: rows whose vector is null or holds a null, NaN or infinite component are dropped. Fewer than `ENTRIES` kept
rows give a smaller codebook. Equal ids are ordered by their vectors, a null id comes last. Vectors whose length isn't the most
frequent one (of equals the longest) or isn't a multiple of PARTS, and those with components too large for exact distances in 64
bits (beyond some 2^16 at 64 components), stay in the result without code and error and have no part in the codebook. A label
sum without any error is null. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trialyst.llm.common import column, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows that go outward together, and entries they meet at a time on each side.
TOGETHER, STEP = 256, 32
#: Shares of one label, so that a label of many rows is summed and met by several tasks.
SHARES = 64


def kept(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Rows whose vector is there and holds finite numbers only."""
    v = column(vectors, vec_col)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(v.isNotNull() & ~odd)


def whole(batch: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as whole numbers, and which rows can be coded exactly; the others are zero."""
    lengths = batch.value_lengths().to_numpy(zero_copy_only=False)
    fits = lengths == length
    flat = batch.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        scaled = np.floor(flat * SCALE).reshape(-1, length)
    small = (np.abs(scaled) < largest(length)).all(axis=1)
    fits[fits] = small
    out = np.zeros((len(lengths), length), np.int64)
    out[fits] = scaled[small].astype(np.int64)
    return out, fits


def largest(length: int) -> int:
    """Components below this keep distances, squared gaps of sums and errors within 62 bits."""
    return min(2**26, 2**30 // max(1, length // PARTS))


class Codebook:
    """Entries of one part position, sorted by the sum of their components."""

    def __init__(self, entries: np.ndarray):
        sums = entries.sum(axis=1)
        self.index = np.lexsort((np.arange(len(entries)), sums))
        self.sums, self.entries = sums[self.index], entries[self.index]
        self.most = int(np.abs(entries).max(initial=0))
        # one product of (part, 1) and this gives n * (squared distance - square of the part) + index
        n, y = len(entries), self.entries.astype(np.float64)
        self.keys = np.vstack([-2 * n * y.T, n * (y * y).sum(axis=1) + self.index])

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of every part."""
        best, index = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        sums = parts.sum(axis=1)
        order = np.argsort(sums, kind="stable")
        for at in range(0, len(order), TOGETHER):
            rows = order[at : at + TOGETHER]
            best[rows], index[rows] = self._outward(parts[rows], sums[rows])
        return index, best

    def _meeting(self, parts: np.ndarray):
        """A function (rows, lo, hi) that gives least distances to the sorted entries lo to hi - 1 and the lowest index of each."""
        n, dim = len(self.sums), parts.shape[1]
        if n * dim * (int(np.abs(parts).max(initial=0)) + self.most) ** 2 < 2**52:  # floating point is exact up to here
            x = np.hstack([parts, np.ones((len(parts), 1), np.int64)]).astype(np.float64)
            squares = (parts * parts).sum(axis=1)

            def meet(rows: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
                key = (x[rows] @ self.keys[:, lo:hi]).min(axis=1).astype(np.int64)
                return key // n + squares[rows], key % n
        else:

            def meet(rows: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
                d = ((parts[rows][:, None, :] - self.entries[None, lo:hi, :]) ** 2).sum(axis=2)
                low = d.min(axis=1)
                return low, np.where(d == low[:, None], self.index[lo:hi], n).min(axis=1)

        return meet

    def _outward(self, parts: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of parts with rising sums."""
        n, dim, meet = len(self.sums), parts.shape[1], self._meeting(parts)
        left = max(0, int(np.searchsorted(self.sums, sums[0])) - STEP // 2)
        right = min(n, max(left + STEP, int(np.searchsorted(self.sums, sums[-1], side="right"))))
        best, index = meet(np.arange(len(parts)), left, right)

        def better(rows: np.ndarray, lo: int, hi: int) -> None:
            low, which = meet(rows, lo, hi)
            won = (low < best[rows]) | ((low == best[rows]) & (which < index[rows]))
            best[rows[won]], index[rows[won]] = low[won], which[won]

        # a row leaves a side when the next sum's gap allows no distance as small; entries before its own sum are always met
        rows = np.arange(len(parts))
        while left > 0 and len(rows):
            gap = sums[rows] - self.sums[left - 1]
            rows = rows[(gap < 0) | (gap * gap <= dim * best[rows])]
            if len(rows):
                better(rows, max(0, left - STEP), left)
            left = max(0, left - STEP)
        rows = np.arange(len(parts))
        while right < n and len(rows):
            gap = self.sums[right] - sums[rows]
            rows = rows[(gap < 0) | (gap * gap <= dim * best[rows])]
            if len(rows):
                better(rows, right, min(n, right + STEP))
            right = min(n, right + STEP)
        return best, index


def _books(entries: np.ndarray) -> list[Codebook]:
    return [Codebook(entries[p]) for p in range(PARTS)]


def first_codebook(vectors: DataFrame, length: int, id_col: str, vec_col: str) -> np.ndarray:
    """PARTS x up to ENTRIES x part length, from the smallest ids: a bounded number of rows comes to the driver."""
    v = column(vectors, vec_col)
    small = ~F.exists(v, lambda x: F.abs(F.floor(x.cast("double") * SCALE).cast("double")) >= largest(length))
    rows = vectors.where((F.size(v) == length) & small).select(column(vectors, id_col).alias("id"), v.cast("array<double>").alias("v"))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    scaled = np.array([[int(x * SCALE // 1) for x in r["v"]] for r in first], np.int64).reshape(len(first), length)
    return scaled.reshape(len(first), PARTS, length // PARTS).transpose(1, 0, 2)


def usual_length(vectors: DataFrame, vec_col: str) -> int:
    """The most frequent length among those that can be cut, of equals the longest; 0 without such rows."""
    n = F.size(column(vectors, vec_col))
    found = vectors.where((n % PARTS == 0) & (n > 0)).groupBy(n.alias("n")).count().orderBy(F.col("count").desc(), F.col("n").desc()).limit(1).collect()
    return found[0]["n"] if found else 0


def _moved(vectors: DataFrame, entries: np.ndarray, length: int, vec_col: str) -> np.ndarray:
    """The codebook after one round: every entry becomes the floored mean of its parts, unused ones stay."""
    size, n = length // PARTS, entries.shape[1]
    names = [f"s{i}" for i in range(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = _books(entries)
        counts, sums = np.zeros((PARTS, n), np.int64), np.zeros((PARTS, n, size), np.int64)
        for batch in batches:
            x, fits = whole(batch.column(0), length)
            x = x[fits]
            for p, book in enumerate(books):
                part = x[:, p * size : (p + 1) * size]
                index, _ = book.nearest(part)
                counts[p] += np.bincount(index, minlength=n)
                np.add.at(sums[p], index, part)
        part, entry = np.nonzero(counts)
        got = sums[part, entry]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(counts[part, entry]), *(pa.array(np.ascontiguousarray(got[:, i])) for i in range(size))], names=["part", "entry", "n", *names])

    shape = ", ".join(f"{c} bigint" for c in ["part", "entry", "n", *names])
    found = vectors.select(column(vectors, vec_col)).mapInArrow(run, shape).groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names))
    new = entries.copy()
    for r in found.collect():
        new[r["part"], r["entry"]] = [r[c] // r["n"] for c in names]
    return new


def _coded(vectors: DataFrame, entries: np.ndarray, length: int, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    size = length // PARTS
    rows = vectors.select(column(vectors, id_col).alias(id_col), column(vectors, label_col).alias("label"), column(vectors, vec_col).alias("v"))
    shape = T.StructType([T.StructField(id_col, rows.schema[id_col].dataType), T.StructField("label", rows.schema["label"].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = _books(entries)
        for batch in batches:
            n = batch.num_rows
            codes, error, fits = np.zeros((n, PARTS), np.uint8), np.zeros(n, np.int64), np.zeros(n, bool)
            if length:
                x, fits = whole(batch.column(2), length)
                for p, book in enumerate(books):
                    index, best = book.nearest(x[fits][:, p * size : (p + 1) * size])
                    codes[fits, p] = index
                    error[fits] += best
            code = [bytes(c).hex() for c in codes]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string(), mask=~fits), pa.array(error, mask=~fits)], schema=arrow)

    return rows.mapInArrow(run, shape)


def with_label_error(coded: DataFrame, share: Column) -> DataFrame:
    """`label_error`, the error summed over equal labels. A label is summed in SHARES shares, so at most that many rows meet per label."""
    shared = coded.withColumn("_share", share)
    sums = shared.groupBy("label", "_share").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum"))
    total = F.sum("_sum").over(Window.partitionBy("label")).try_cast("long")
    sums = sums.select(F.col("label").alias("_label"), F.col("_share").alias("_of"), total.alias("label_error"))
    return shared.join(sums, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_share") == F.col("_of"))).drop("_label", "_of", "_share")


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """id, code, error, label_error, codebooks_sha256 of every kept vector."""
    rows = kept(vectors, vec_col)
    length = usual_length(rows, vec_col)
    entries = first_codebook(rows, length, id_col, vec_col) if length else np.zeros((PARTS, 0, 0), np.int64)
    for _ in range(rounds if entries.shape[1] else 0):
        entries = _moved(rows, entries, length, vec_col)
    digest = hashlib.sha256(",".join(str(x) for x in entries.ravel().tolist()).encode()).hexdigest()
    coded = stored(_coded(rows, entries, length if entries.shape[1] else 0, id_col, vec_col, label_col), "codes")
    share = F.pmod(F.xxhash64(F.col(id_col)), F.lit(SHARES))
    return with_label_error(coded, share).select(id_col, "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    steps = [
        """with kept as materialized (
    select vec_id, label, list_transform(embedding, lambda x: floor(x::double * 1024)::bigint) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (
    select vec_id, label, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] as x from kept, range(4) as r(p)),
b0 as materialized (
    select p, row_number() over (partition by p order by vec_id) - 1 as i, x as c from parts
    where vec_id in (select vec_id from kept order by vec_id limit 256))"""
    ]
    near = "select vec_id, label, p, x, min({{d: d, i: i}}) as best from (select q.vec_id, q.label, q.p, q.x, b.i, list_sum(list_transform(list_zip(q.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from parts q join b{0} b using (p)) group by all"
    for k in range(ROUNDS):
        steps.append(f"a{k} as materialized ({near.format(k)})")
        steps.append(
            f"""m{k} as (select p, i, list(c order by z) as c from (select p, best.i as i, z, floor(sum(x[z]) / count(*))::bigint as c
        from a{k}, range(1, (select len(x) + 1 from parts limit 1)) as r(z) group by 1, 2, 3) group by 1, 2),
b{k + 1} as materialized (select b.p, b.i, coalesce(m.c, b.c) as c from b{k} b left join m{k} m using (p, i))"""
        )
    steps.append(f"last as materialized ({near.format(ROUNDS)})")
    steps.append("codes as (select vec_id, label, string_agg(printf('%02x', best.i), '' order by p) as code, sum(best.d)::bigint as error from last group by 1, 2)")
    return (
        ",\n".join(steps)
        + """
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error,
    (select sha256(string_agg(array_to_string(c, ','), ',' order by p, i)) from b4) as codebooks_sha256 from codes"""
    )


COMPRESS_SQL = _sql()
