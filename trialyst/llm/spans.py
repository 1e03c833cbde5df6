"""Spans found in texts: an array of (kind, start, end) in code points, end exclusive, and its digests."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialyst.llm.common import map_texts, texts

SPANS = "spans array<struct<kind: string, start: int, end: int>>"
ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def spans_of(docs: DataFrame, find, id_col: str, text_col: str) -> DataFrame:
    """id and spans; `find` turns one whole text into a sorted list of (kind, start, end)."""

    def run(batch: list[str]) -> tuple:
        return (pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in find(t)] for t in batch], ARROW),)

    return map_texts(texts(docs, id_col, text_col), run, SPANS)


def said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def summary(found: DataFrame, id_col: str, counted: tuple[str, ...]) -> DataFrame:
    """id, n_<kind> for each base kind, base_sha256 of the base spans, spans of all as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*counted))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in counted]
    return found.select(id_col, *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
