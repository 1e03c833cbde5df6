"""Shared helpers: safe columns, Arrow maps over whole texts, stored intermediate tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trialyst.session import scratch_path


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, also where it holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (as `id_col`) and the whole text (as `text`); a null text counts as empty."""
    return df.select(column(df, id_col).alias(id_col), F.coalesce(column(df, text_col).cast("string"), F.lit("")).alias("text"))


def map_texts(df: DataFrame, fn: Callable[[list[str]], tuple], ddl: str, rows: int = 256) -> DataFrame:
    """The first columns of `df` as they are, and instead of the last one, `text`, what `fn` makes of a list of texts.

    Whole texts go to Python in Arrow batches and are handled `rows` at a time, so that a task
    holds few of them. No row is left out.
    """
    kept = [T.StructField(f.name, f.dataType, True) for f in df.schema.fields[:-1]]
    shape = T.StructType(kept + T.StructType.fromDDL(ddl).fields)
    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = fn(part.column(part.num_columns - 1).to_pylist())
                cols = [part.column(i) for i in range(part.num_columns - 1)]
                cols += [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(made, list(arrow)[len(cols) :], strict=True)]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return df.mapInArrow(run, shape)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written once to the shared folder and read from there: later steps start from files that outlive executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a missing id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(parts))
