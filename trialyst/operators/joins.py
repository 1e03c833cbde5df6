"""Pairing results with tasks, keys, verdicts and each other.

No join here carries a broadcast hint: Spark broadcasts a side when its size
statistics allow and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialyst.functions.text import desc_signature
from trialyst.operators.scan import first_by
from trialyst.operators.summary import rows


def with_task(df: DataFrame, tasks: DataFrame, key: str = "task_id") -> DataFrame:
    """Results of known tasks with the task's columns."""
    return df.join(tasks, key)


def with_bug_class(df: DataFrame, tasks: DataFrame, column: str = "bug_class", default: str = "?") -> DataFrame:
    """Adds one task attribute, a default where the task is unknown."""
    return df.join(tasks.select("task_id", column), "task_id", "left").withColumn(
        column, F.coalesce(column, F.lit(default))
    )


def match_strategies(cells: DataFrame, a: str, b: str, first_budget: int) -> DataFrame:
    """Outcomes of two strategies on the same (budget, seed, task). A seed
    counts when both strategies have cells at the first budget."""
    s = F.col("strategy")
    mine = cells.filter(s.isin(a, b))
    ready = (
        mine.filter(F.col("budget") == first_budget).groupBy("seed")
        .agg(F.count_if(s == a).alias("na"), F.count_if(s == b).alias("nb"))
        .filter((F.col("na") > 0) & (F.col("nb") > 0))
    )
    sides = mine.groupBy("budget", "seed", "task_id").agg(
        F.max(F.when(s == a, F.coalesce("passed", F.lit(False)))).alias("a_passed"),
        F.max(F.when(s == b, F.coalesce("passed", F.lit(False)))).alias("b_passed"),
    )
    both = sides.filter(F.col("a_passed").isNotNull() & F.col("b_passed").isNotNull())
    return both.join(ready.select("seed"), "seed", "left_semi")


def vs_reference(trials: DataFrame, ref: str, order: list[str]) -> DataFrame:
    """Each baseline against one reference baseline on their common problems.
    The first sample per (baseline, problem) counts."""
    one = trials.groupBy("baseline", "problem_id").agg(
        F.min_by(F.coalesce("passed", F.lit(False)), F.struct(*order)).alias("passed")
    )
    base = one.filter(F.col("baseline") == ref).select("problem_id", F.col("passed").alias("ref"))
    other = one.filter(F.col("baseline") != ref).join(base, "problem_id")
    p, r = F.col("passed"), F.col("ref")
    out = other.groupBy("baseline").agg(
        rows().alias("n_common"), F.count_if(r).alias("ref_pass"), F.count_if(p).alias("pass"),
        F.count_if(~r & p).alias("fixed"), F.count_if(r & ~p).alias("broken"),
    )
    return out.withColumn("ref_rate", F.col("ref_pass").cast("double") / F.col("n_common")).withColumn(
        "pass_rate", F.col("pass").cast("double") / F.col("n_common")
    )


def with_rubric(items: DataFrame, rubric: DataFrame, run: int) -> DataFrame:
    """Gallery items with the rounded rubric scores of one run."""
    scores = rubric.filter(F.col("run") == run).select(
        "task_id", F.round("ss_rubric", 2).alias("ss_rubric"), F.round("rv_rubric", 2).alias("rv_rubric")
    )
    return items.join(scores, "task_id", "left")


def case_index(results: DataFrame, images: DataFrame, traces: DataFrame, tasks: DataFrame) -> DataFrame:
    """Cases seen in results or images that have both images, with per-task
    means to one decimal; results, trace and task text may be missing."""
    ids = results.select("task_id").union(images.select("task_id")).distinct()
    both = images.groupBy("task_id").agg(
        F.max(F.col("side") == "ss").alias("s"), F.max(F.col("side") == "rv").alias("r")
    ).filter(F.col("s") & F.col("r"))
    means = results.groupBy("task_id").agg(
        F.round(F.avg("ss_n_defects"), 1).alias("ss_defects"),
        F.round(F.avg("rv_n_defects"), 1).alias("rv_defects"),
        F.round(F.avg("rv_iters"), 1).alias("iters"),
        rows().alias("n_runs"),
    )
    traced = traces.select("task_id").distinct().withColumn("t", F.lit(True))
    return (
        ids.join(both.select("task_id"), "task_id", "left_semi")
        .join(means, "task_id", "left")
        .join(traced, "task_id", "left")
        .join(tasks, "task_id", "left")
        .withColumn("has_trace", F.coalesce("t", F.lit(False)))
        .withColumn("n_runs", F.coalesce("n_runs", F.lit(0)))
        .drop("t")
    )


def candidates(tasks: DataFrame, traces: DataFrame, strata: list[str]) -> DataFrame:
    """Tasks whose existing trace falls in one of the strata."""
    wanted = traces.filter(F.col("stratum").isin(*strata)).select("task_id").distinct()
    return tasks.join(wanted, "task_id", "left_semi")


def drop_known(new: DataFrame, existing: DataFrame, order: list[str], signature: Column | None = None) -> DataFrame:
    """New tasks whose description signature is neither among the existing
    tasks nor among earlier new ones."""
    sig = desc_signature(F.col("description")) if signature is None else signature
    # a digest keeps the shuffled key short; 128 bits leave no real collisions
    fresh = new.withColumn("__sig", F.md5(sig))
    known = existing.select(F.md5(sig).alias("__sig")).distinct()
    # copies collapse before the join, so one text copied very often costs little
    one = first_by(fresh, ["__sig"], [F.col(c) for c in order])
    return one.join(known, "__sig", "left_anti").drop("__sig")


def resolve_tasks(sources: DataFrame) -> DataFrame:
    """Each task from the first source that has it; rows carry ``priority`` and ``pos``."""
    return first_by(sources, ["task_id"], [F.col("priority"), F.col("pos")])


def align_verdicts(requirements: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Every requirement with its verdict by 1-based number. Missing verdicts
    count as not satisfied; among duplicates the last wins; numbers outside the
    list or not whole are ignored."""
    wanted = requirements.select(
        "artifact_id", F.posexplode("requirements").alias("p", "requirement")
    ).select("artifact_id", (F.col("p") + 1).cast("bigint").alias("index"), "requirement")
    last = (
        verdicts.filter(F.col("index").isNotNull())
        .groupBy("artifact_id", F.col("index").cast("bigint").alias("index"))
        .agg(F.max_by(F.struct("satisfied", "evidence"), "pos").alias("v"))
    )
    return wanted.join(last, ["artifact_id", "index"], "left").select(
        "artifact_id", "index", "requirement",
        F.coalesce("v.satisfied", F.lit(False)).alias("satisfied"),
        F.coalesce("v.evidence", F.lit("")).alias("evidence"),
    )


def task_dossier(cells: DataFrame, models: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per task its outcome under every (strategy, budget) and model. The maps
    are keyed by these labels, so their size does not grow with the data."""
    by_cell = cells.groupBy("task_id", "strategy", "budget").agg(
        F.max("passed").alias("passed"), F.max("tokens_used").alias("tokens"), F.max("num_turns").alias("turns")
    )
    label = F.concat_ws("@", "strategy", F.col("budget").cast("string"))
    grid = by_cell.groupBy("task_id").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct(label.alias("k"), F.struct("passed", "tokens", "turns").alias("v"))))
        ).alias("strategies")
    )
    by_model = models.groupBy("task_id", "model").agg(
        F.max("ss_passed").alias("ss_passed"), F.max("rv_passed").alias("rv_passed")
    )
    cross = by_model.groupBy("task_id").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct(F.col("model").alias("k"), F.struct("ss_passed", "rv_passed").alias("v"))))
        ).alias("cross_model")
    )
    return tasks.join(grid, "task_id", "left").join(cross, "task_id", "left")


# --- sets --------------------------------------------------------------------


def union_all(*frames: DataFrame) -> DataFrame:
    """Bag union by name; absent columns become null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def union_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


def common_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def missing_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def pending(work: DataFrame, done: DataFrame, keys: list[str], usable: Column | None = None) -> DataFrame:
    """Work items without a usable result yet. Results reduce to their keys
    before the shuffle, and the join reuses that shuffle."""
    finished = done if usable is None else done.filter(usable)
    return work.join(finished.select(*keys).distinct(), keys, "left_anti")
