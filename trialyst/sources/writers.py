"""Sinks: metric stores, corpora, summaries, case documents and the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_metrics(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Samples as Parquet, one folder per baseline. Rows go where they are;
    a large baseline is written by many tasks."""
    df.write.mode(mode).partitionBy("baseline").parquet(path)


def write_corpus(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One example per line."""
    df.write.mode(mode).json(path)


def read_corpus(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_summary(df: DataFrame, path: str, fmt: str = "csv", order: list[str] | None = None) -> None:
    """A small aggregated table as CSV with a header, or as a markdown table.
    Markdown needs its header first, so its few lines go through one sort."""
    if fmt == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
        return
    if fmt != "markdown":
        raise ValueError(f"unknown format {fmt!r}")
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    bar = F.lit(" | ")
    line = F.concat(F.lit("| "), *[x for c in cells for x in (c, bar)][:-1], F.lit(" |"))
    keys = [F.col(c) for c in (order or df.columns[:1])]
    body = df.select(F.lit(1).alias("o"), F.struct(*keys).cast("string").alias("k"), line.alias("value"))
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    top = df.sparkSession.range(1).select(F.lit(0).alias("o"), F.lit("").alias("k"), F.lit(head).alias("value"))
    top.unionByName(body).orderBy("o", "k").select("value").coalesce(1).write.mode("overwrite").text(path)


def write_cases(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One document per case, laid out by modality."""
    df.write.mode(mode).partitionBy("modality").json(path)


def catalog(suites: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """Task suites with their blurb and size. Suites map a label to (blurb,
    tasks)."""
    out = None
    for label, (blurb, tasks) in suites.items():
        part = tasks.select(F.lit(label).alias("suite"), F.lit(blurb).alias("blurb"), "task_id")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("suite", "blurb").agg(F.count(F.lit(1)).alias("n"))


def case_detail(df: DataFrame, max_chars: int | None = None) -> DataFrame:
    """The published fields of a case; with a limit, longer outputs are trimmed and say by how much."""
    from trialyst.functions.text import trim_note

    def whole(s):
        return F.coalesce(s["full_output"], F.lit(""))

    steps = F.transform(
        "trace",
        lambda s: F.struct(
            s["step"].alias("step"), s["feedback"].alias("feedback"),
            (whole(s) if max_chars is None else trim_note(whole(s), max_chars)).alias("output"),
        ),
    )
    return df.select(
        "task_id", "modality", "name", F.struct("description", "requirements", "difficulty").alias("task"), steps.alias("steps")
    )
