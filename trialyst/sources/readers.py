"""Readers of result bundles, run lists, grids, tasks, votes and metric stores.

Files are parsed with explicit schemas. A file of one JSON document is read
whole by one task, as its format demands; many files spread over tasks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialyst import schemas
from trialyst.operators.corpus import code_traces, research_traces, video_traces, visual_traces
from trialyst.operators.normalize import normalize_pairs

# fixed values: files that are not result bundles
NOT_BUNDLES = ["summary.json", "scaling_data.json"]
# fixed values: family -> (task file, primary result files in order, prefix of further runs)
FAMILIES = {
    "code": ("code/code_tasks.json", ["code_results.json", "code_swe_results.json"], "code"),
    "slide": ("slides/slide_tasks.json", ["slides_results.json", "slide_results.json"], "slides"),
    "webpage": (
        "webpages/webpage_tasks.json",
        ["webpages_results.json", "webpage_results.json", "webpage_results_partial.json"],
        "webpages",
    ),
    "animation": ("animations/animation_tasks.json", ["animations_results.json", "animation_results.json"], "animations"),
    "video": ("video/video_tasks.json", ["video_results.json"], "video"),
    "research": ("research/research_tasks.json", ["research_results.json"], "research"),
}


def existing(spark: SparkSession, patterns: list[str]) -> list[str]:
    """The paths that exist, glob patterns expanded, in the given order."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = []
    for p in patterns:
        path = jvm.org.apache.hadoop.fs.Path(p)
        hits = path.getFileSystem(conf).globStatus(path)
        found += sorted(str(h.getPath().toString()) for h in (hits or []))
    return found


def _whole_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    return (
        spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(paths)
        .select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file"))
    )


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_bundles(spark: SparkSession, path: str, name_glob: str = "*.json") -> DataFrame:
    """Trials of all result bundles below a folder, with ``source_file``
    relative to it. Other files and malformed ones are skipped;
    ``read_rejects`` lists them."""
    schema = f"results array<struct<{_nested(schemas.TRIAL)}>>, _corrupt_record string"
    raw = (
        spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE")
        .option("recursiveFileLookup", True).option("pathGlobFilter", name_glob).json(path)
        .select("results", F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_name").alias("f"))
    )
    relative = F.regexp_replace("p", f"^.*{re.escape(path.rstrip('/'))}/", "")
    return (
        raw.filter(~F.col("f").isin(NOT_BUNDLES) & F.col("results").isNotNull())
        .select(relative.alias("source_file"), F.explode("results").alias("r"))
        .select("source_file", "r.*")
        .withColumn("total_tokens", F.coalesce("total_tokens", "tokens"))
        .withColumn("problem_id", F.coalesce("problem_id", "task_id"))
        .withColumn("passed", F.coalesce("passed", F.lit(False)))
        .drop("tokens", "task_id")
    )


def read_rejects(spark: SparkSession, paths: list[str], shape: str = "list") -> DataFrame:
    """Files that the readers pass over: ``file``, ``reason`` and ``n_chars``.

    ``shape`` is what they should hold: a ``list`` of records, or a ``bundle``,
    an object with a list ``results``. The globs go to Spark as they are. Files
    of no bytes hold no records and aren't listed; Spark passes over them."""
    if not existing(spark, paths):
        return _empty(spark, "file string, reason string, n_chars bigint")
    v = F.try_parse_json("value")
    start = F.left(F.ltrim(F.coalesce("value", F.lit(""))), F.lit(1))
    found = F.try_variant_get(v, "$.results", "array<variant>") if shape == "bundle" else F.try_variant_get(v, "$", "array<variant>")
    reason = (
        F.when(start == "", "empty").when(v.isNull(), "not JSON")
        .when(found.isNull(), "no list of results" if shape == "bundle" else "not a list")
    )
    files = _whole_files(spark, paths).select("file", reason.alias("reason"), F.length("value").cast("bigint").alias("n_chars"))
    return files.filter(F.col("reason").isNotNull() & ~F.col("file").isin(NOT_BUNDLES))


def _nested(ddl: str) -> str:
    """Top-level DDL as struct fields: name:type."""
    return re.sub(r"(^|, )(\w+) ", r"\1\2:", ddl)


def _listed(text: Column, schema: str) -> Column:
    """A JSON array of records, null for anything but an array."""
    return F.when(F.ltrim(text).startswith("["), F.from_json(text, f"array<struct<{_nested(schema)}>>"))


def read_runs(spark: SparkSession, paths: list[str], schema: str = schemas.PAIR) -> DataFrame:
    """Records of run lists with ``file`` and ``pos``. Absent files, broken
    files and files that are not lists are skipped; ``read_rejects`` lists the
    latter two. ``run`` comes from the
    record or else from the file name."""
    found = existing(spark, paths)
    if not found:
        return _empty(spark, f"{schema}, file string, pos int")
    r = _whole_files(spark, found).select(
        "file", F.posexplode(_listed(F.col("value"), schema)).alias("pos", "r")
    ).select("r.*", "file", "pos")
    from_name = F.nullif(F.regexp_extract("file", r"run(\d+)", 1), F.lit("")).cast("bigint")
    return r.withColumn("run", F.coalesce("run", from_name)) if "run" in r.columns else r


def read_grid(spark: SparkSession, seeds: dict[int, str]) -> DataFrame:
    """Cells of strategy x budget x task grids, one file or folder per seed.
    A seed without files contributes nothing."""
    kind = f"map<string,map<string,map<string,struct<{_nested(schemas.CELL)}>>>>"
    out = None
    for seed, path in seeds.items():
        found = existing(spark, [path])
        if not found:
            continue
        g = _whole_files(spark, found).select(F.explode(F.from_json("value", kind)).alias("strategy", "b"))
        g = g.select("strategy", F.explode("b").alias("budget", "t")).select(
            "strategy", F.col("budget").cast("bigint").alias("budget"), F.explode("t").alias("task_id", "c")
        )
        g = g.select(
            F.lit(seed).cast("bigint").alias("seed"), "strategy", "budget", "task_id",
            F.coalesce("c.passed", F.lit(False)).alias("passed"), F.coalesce("c.tokens_used", F.lit(0)).alias("tokens_used"), "c.num_turns", "c.error_message",
        )
        out = g if out is None else out.unionByName(g)
    if out is None:
        return _empty(spark, "seed bigint, strategy string, budget bigint, task_id string, passed boolean, tokens_used bigint, num_turns bigint, error_message string")
    return out


def read_tasks(spark: SparkSession, paths: list[str], schema: str = schemas.TASK) -> DataFrame:
    """Tasks from a list, from the field ``tasks`` or from the first field."""
    found = existing(spark, paths)
    if not found:
        return _empty(spark, f"{schema}, file string, pos int")
    fields = F.from_json("value", "map<string,string>")
    boxed = F.coalesce(F.element_at(fields, "tasks"), F.get(F.map_values(fields), F.lit(0)))
    tasks = F.coalesce(_listed(F.col("value"), schema), _listed(boxed, schema))
    return _whole_files(spark, found).select("file", F.posexplode(tasks).alias("pos", "t")).select("t.*", "file", "pos")


def read_votes(spark: SparkSession, paths: list[str]) -> DataFrame:
    found = existing(spark, paths)
    if not found:
        return _empty(spark, schemas.VOTE)
    return spark.read.option("header", True).schema(schemas.VOTE).csv(found)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def import_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a nested metrics file. Stored counters are ignored; the
    summaries count the samples again."""
    sample = f"struct<{_nested(schemas.TRIAL)}>"
    kind = f"map<string,map<string,struct<results:array<{sample}>>>>"
    m = _whole_files(spark, [path]).select(F.explode(F.from_json("value", kind)).alias("b", "ps"))
    m = m.select("b", F.explode("ps").alias("p", "s")).select("b", "p", F.explode("s.results").alias("r"))
    return m.select(
        F.col("b").alias("baseline"), F.col("p").alias("problem_id"), F.coalesce("r.passed", F.lit(False)).alias("passed"),
        F.coalesce("r.total_tokens", "r.tokens", F.lit(0)).alias("total_tokens"), F.coalesce("r.cost", F.lit(0.0)).alias("cost"),
    )


def read_with_fallback(spark: SparkSession, folder: str, names: list[str], globs: list[str], schema: str = schemas.PAIR) -> DataFrame:
    """The first existing file of an ordered list, plus all files that match
    the patterns."""
    primary = existing(spark, [f"{folder}/{n}" for n in names])[:1]
    more = existing(spark, [f"{folder}/{g}" for g in globs])
    return read_runs(spark, primary + more, schema)


def collect_all(spark: SparkSession, results_dir: str, tasks_dir: str) -> DataFrame:
    """Interaction traces of all six families: primary or fallback results,
    further runs and on-policy runs. Families without a task file are left out."""
    build = {"code": code_traces, "video": video_traces, "research": research_traces}
    out = None
    for family, (task_file, names, prefix) in FAMILIES.items():
        tasks_path = f"{tasks_dir}/{task_file}"
        if not existing(spark, [tasks_path]):
            continue
        globs = [f"{prefix}_results_run*.json", f"{prefix}_onpolicy_run*.json"]
        results = normalize_pairs(read_with_fallback(spark, results_dir, names, globs))
        # compressed files look small to Spark, which would broadcast large tables
        tasks = read_tasks(spark, [tasks_path]).hint("merge")
        if family == "code":
            # without pass flags a quality of exactly 1 counts as passed
            results = results.withColumn("ss_passed", F.coalesce("ss_passed", F.col("ss_quality") == 1.0)).withColumn(
                "rv_passed", F.coalesce("rv_passed", F.col("rv_quality") == 1.0)
            )
        traces = build[family](results, tasks) if family in build else visual_traces(results, tasks, family)
        out = traces if out is None else out.unionByName(traces)
    if out is None:
        raise FileNotFoundError(f"no task files below {tasks_dir}")
    return out
