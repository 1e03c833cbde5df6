"""Exact duplicates by composable polynomial fingerprints.

A text's bytes are the digits of a number in several bases modulo primes. Chunk values combine like
digits do: the value of two joined parts is the left one shifted by the right one's length, plus the
right one. So pieces of one document may be hashed in any place and order, and a document that is
stored in pieces gives the same fingerprint. Texts with equal fingerprints are then compared chunk by
chunk; the comparison keeps only the least and the greatest chunk of each place, so a group of any
size is a map-side aggregate and never meets in one task.

Texts: null counts as empty, and empty texts are equal. `keep_id` is the largest id of a group; a
missing id is smaller than any other. Rows with the same id and the same text are one document
repeated: each has a row in the result, and at most one of them is kept. Other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from trialyst.llm.common import column, fresh, stored, texts

#: Pieces that JVM rows hold; documents of more bytes are hashed as several rows.
PIECE_BYTES = 1 << 20
#: Bytes of one chunk of the comparison.
CHUNK_BYTES = 1 << 16
#: Digits of one product; byte + 1 times a residue, summed so often, stays an exact double.
BLOCK = 4096
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1664525017, 1013904223, 1597334677)


def _powers() -> np.ndarray:
    out = np.ones((BLOCK, len(PRIMES)))
    for lane, (p, b) in enumerate(zip(PRIMES, BASES, strict=True)):
        x = 1
        for i in range(BLOCK - 1, -1, -1):
            out[i, lane] = x
            x = x * b % p
    return out


POWERS = _powers()
BLOCK_SHIFT = [pow(b, BLOCK, p) for p, b in zip(PRIMES, BASES, strict=True)]


def fingerprint(data: bytes) -> list[int]:
    """The value of `data` in each base: blocks are hashed together as one product, then combined by shifts."""
    blocks = max(1, -(-len(data) // BLOCK))
    digits = np.zeros(blocks * BLOCK)
    digits[blocks * BLOCK - len(data) :] = np.frombuffer(data, np.uint8)
    digits[blocks * BLOCK - len(data) :] += 1
    parts = (digits.reshape(blocks, BLOCK) @ POWERS).astype(np.int64)
    if blocks == 1:
        return [int(h) % p for h, p in zip(parts[0], PRIMES, strict=True)]
    out = [0] * len(PRIMES)
    for row in parts.tolist():
        out = [(h * s + x) % p for h, s, x, p in zip(out, BLOCK_SHIFT, row, PRIMES, strict=True)]
    return out


def shift(n_bytes: int) -> list[int]:
    """What a fingerprint is multiplied by when `n_bytes` follow."""
    return [pow(b, n_bytes, p) for p, b in zip(PRIMES, BASES, strict=True)]


def combine(left: list[int], right: list[int], right_bytes: int) -> list[int]:
    """The fingerprint of two texts joined."""
    return [(h * s + x) % p for h, s, x, p in zip(left, shift(right_bytes), right, PRIMES, strict=True)]


def _pieces(data: Column, size: int) -> Column:
    last = F.greatest(F.floor((F.octet_length(data) - 1) / size), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def piece_values(pieces: DataFrame, data: str) -> DataFrame:
    """`pieces` with the binary column `data`, which comes last, replaced by n_bytes, hashes and shifts."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in pieces.schema.fields[:-1]), *T.StructType.fromDDL("n_bytes bigint, hashes array<bigint>, shifts array<bigint>").fields])
    arrow = to_arrow_schema(shape)
    assert pieces.columns[-1] == data

    def run(batches):
        known: dict[int, list[int]] = {}
        for batch in batches:
            sizes, hashes, shifts = [], [], []
            for x in batch.column(batch.num_columns - 1):
                b = x.as_py() or b""
                sizes.append(len(b))
                hashes.append(fingerprint(b))
                if len(b) not in known and len(known) > 100_000:
                    known.clear()
                shifts.append(known.setdefault(len(b), shift(len(b))))
            made = [pa.array(c, arrow.field(n).type) for n, c in (("n_bytes", sizes), ("hashes", hashes), ("shifts", shifts))]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(batch.num_columns - 1)] + made, schema=arrow)

    return pieces.mapInArrow(run, shape)


def combined(pieces: Column) -> Column:
    """The fingerprint of an array of (piece_no, n_bytes, hashes, shifts) in order."""
    lanes = range(len(PRIMES))
    zero = F.array(*[F.lit(0).cast("bigint") for _ in lanes])
    step = lambda acc, x: F.array(*[F.pmod(acc[i] * x["shifts"][i] + x["hashes"][i], F.lit(PRIMES[i])) for i in lanes])
    return F.aggregate(pieces, zero, step)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_sha256, fp string, n_bytes, n_rows: one row for each different (id, text)."""
    base = texts(docs, id_col, text_col).select(id_col, F.sha2("text", 256).alias("text_sha256"), F.encode("text", "UTF-8").alias("data"))
    rows = base.select(id_col, "text_sha256", F.posexplode(_pieces(F.col("data"), PIECE_BYTES)).alias("piece_no", "piece"))
    # A set: pieces of repeated rows are equal and meet once, already before the shuffle.
    parts = piece_values(rows, "piece").groupBy(id_col, "text_sha256").agg(
        F.array_sort(F.collect_set(F.struct("piece_no", "n_bytes", "hashes", "shifts"))).alias("parts"),
        F.count_if(F.col("piece_no") == 0).alias("n_rows"),
    )
    return parts.select(
        id_col,
        "text_sha256",
        F.array_join(F.transform(combined(F.col("parts")), lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "").alias("fp"),
        F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, x: n + x["n_bytes"]).alias("n_bytes"),
        "n_rows",
    )


def unequal(docs: DataFrame, shared: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The (fp, n_bytes) under which a chunkwise comparison of the texts finds different ones."""
    full = texts(docs, id_col, text_col).select(F.col(id_col).alias("_id"), "text", F.sha2("text", 256).alias("_sha"))
    same = full.join(shared.select(F.col(id_col).alias("_of"), F.col("text_sha256").alias("_sha_of"), "fp", "n_bytes"), F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_sha") == F.col("_sha_of")))
    chunks = same.select("fp", "n_bytes", F.posexplode(_pieces(F.encode("text", "UTF-8"), CHUNK_BYTES)).alias("chunk_no", "chunk"))
    ends = chunks.groupBy("fp", "n_bytes", "chunk_no").agg(F.min("chunk").alias("least"), F.max("chunk").alias("greatest"))
    return ends.where(F.col("least") != F.col("greatest")).select("fp", "n_bytes").distinct()


def group_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    The fingerprints are stored once. Groups are counted under a key of their own, so that the join
    back has an exchange on both sides and adaptive execution may split a hot group.
    """
    marks = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    key = F.concat_ws(":", "fp", "n_bytes")
    shared = marks.groupBy(F.concat(F.lit("k"), key).alias("_group")).agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = marks.withColumn("key", key).join(shared.select(F.expr("substring(_group, 2)").alias("key")), "key", "left_semi")
    differ = unequal(docs, members, id_col, text_col).select(F.concat_ws(":", "fp", "n_bytes").alias("_key"), F.lit(True).alias("_differ"))
    # A fingerprint shared by different texts is told apart by the text's digest.
    keyed = marks.withColumn("_key", key).join(differ, "_key", "left")
    keyed = stored(keyed.select(id_col, "text_sha256", "n_rows", F.when(F.col("_differ"), F.concat_ws(":", "_key", "text_sha256")).otherwise(F.col("_key")).alias("key")), "keys")
    groups = keyed.groupBy(F.concat(F.lit("k"), "key").alias("_group")).agg(F.max(id_col).alias("keep_id"), F.sum("n_rows").alias("group_size"))
    groups = groups.select(F.expr("substring(_group, 2)").alias("_group"), "keep_id", "group_size")
    joined = keyed.join(groups, F.col("key") == F.col("_group"))
    return joined.select(
        F.col(id_col),
        "keep_id",
        "group_size",
        F.explode(F.sequence(F.lit(1).cast("bigint"), "n_rows")).alias("_row"),
        "text_sha256",
    ).select(id_col, "keep_id", "group_size", (F.col(id_col).eqNullSafe(F.col("keep_id")) & (F.col("_row") == 1)).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group of equal texts, all columns kept.

    Rows that repeat an id and its text count once: they lie together after the join on the id, so
    numbering them needs no further exchange.
    """
    key, digest, row = fresh(docs, "_kept_id"), fresh(docs, "_kept_sha"), fresh(docs, "_row")
    kept = group_texts(docs, id_col, text_col).where("kept").select(F.col(id_col).alias(key), F.col("text_sha256").alias(digest))
    own = F.sha2(F.coalesce(column(docs, text_col).cast("string"), F.lit("")), 256)
    same = docs.join(kept, column(docs, id_col).eqNullSafe(F.col(key)) & (own == F.col(digest)))
    first = F.row_number().over(Window.partitionBy(key, digest).orderBy(F.lit(0)))
    return same.withColumn(row, first).where(F.col(row) == 1).select(*[column(docs, c) for c in docs.columns])


GROUPS_SQL = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))
"""
