"""A bounded sample of labelled rows to fit classifiers on, and the frame of their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialyst.llm.common import column, fold, texts

THRESHOLD = 0.7


def training_rows(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, y and text of at most `bound` labelled documents outside the held-out part.

    Documents are taken in the order of a hash of their id. Of several labels of an id the larger
    one counts, of several texts the greatest; rows without id or label are passed over.
    """
    known = labels.select(column(labels, "doc_id").alias(id_col), column(labels, label).cast("int").alias("y")).dropna()
    known = known.where(fold(id_col, parts) != held).groupBy(id_col).agg(F.max("y").alias("y"))
    taken = known.orderBy(F.xxhash64(F.col(id_col), F.lit(17)), id_col).limit(bound)
    # The sample is bounded, so it may go to every executor.
    return texts(docs, id_col, text_col).join(F.broadcast(taken), id_col).groupBy(id_col, "y").agg(F.max("text").alias("text"))


def verdicts(scored: DataFrame, parts: int, held: int, id_col: str = "doc_id") -> DataFrame:
    """id, held_out, score, predicted."""
    return scored.select(id_col, (fold(id_col, parts) == held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
