"""Name drift, categories, boolean coercion and row gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: task-id prefix -> category ("code_" splits on the file name)
CATEGORY_PREFIXES = {
    "slide_": "slides",
    "web_": "webpages",
    "anim_": "animations",
    "video_": "video",
    "research_": "research",
}
METRIC_COLUMNS = ["ss_quality", "ss_passed", "rv_passed", "ss_accuracy"]


def _col(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def normalize_pairs(df: DataFrame) -> DataFrame:
    """One spelling per fact. Old quality names fill in only where the new
    ``ss_quality`` is absent; then missing meets are false and a missing
    reviewed quality is 0."""
    old = _col(df, "single_shot_quality", "double")
    new_q = _col(df, "ss_quality", "double")
    use_old = new_q.isNull() & old.isNotNull()
    no = F.lit(False)

    def either(new: str, alt: str, kind: str, default: Column) -> Column:
        return F.when(use_old, F.coalesce(_col(df, alt, kind), default)).otherwise(_col(df, new, kind))

    fixed = {
        "ss_quality": F.coalesce(new_q, old),
        "ss_meets": either("ss_meets", "single_shot_meets", "boolean", no),
        "rv_quality": either("rv_quality", "reviewed_quality", "double", F.lit(0.0)),
        "rv_meets": either("rv_meets", "reviewed_meets", "boolean", no),
        "ss_passed": F.coalesce(_col(df, "ss_passed", "boolean"), _col(df, "single_shot_passed", "boolean")),
        "rv_passed": F.coalesce(_col(df, "rv_passed", "boolean"), _col(df, "reviewed_passed", "boolean")),
        "ss_tokens": F.coalesce(_col(df, "ss_tokens", "bigint"), _col(df, "single_shot_tokens", "bigint")),
        "rv_tokens": F.coalesce(_col(df, "rv_tokens", "bigint"), _col(df, "reviewed_tokens", "bigint")),
        "rv_iters": F.coalesce(_col(df, "rv_iters", "bigint"), _col(df, "reviewed_iters", "bigint")),
    }
    retired = {
        "single_shot_quality", "single_shot_meets", "single_shot_passed", "single_shot_tokens",
        "reviewed_quality", "reviewed_meets", "reviewed_passed", "reviewed_tokens", "reviewed_iters",
    }
    keep = [c for c in df.columns if c not in fixed and c not in retired]
    return df.select(*keep, *[e.alias(n) for n, e in fixed.items()])


def with_category(df: DataFrame, task: str = "task_id", file: str = "file") -> DataFrame:
    """Category from the task-id prefix; unknown prefixes drop out."""
    tid = F.col(task)
    cat = F.when(
        tid.startswith("code_"), F.when(F.col(file).contains("swe"), "code_swe").otherwise("code_old")
    )
    for prefix, name in CATEGORY_PREFIXES.items():
        cat = cat.when(tid.startswith(prefix), name)
    return df.withColumn("category", cat).filter(F.col("category").isNotNull())


def with_metric_flag(df: DataFrame) -> DataFrame:
    """Whether an entry carries any usable metric."""
    present = F.lit(False)
    for c in METRIC_COLUMNS:
        if c in df.columns:
            present = present | F.col(c).isNotNull()
    return df.withColumn("has_metric", present)


def scored_pairs(df: DataFrame, metric: str) -> DataFrame:
    """Pairs scored on both sides; a failed side is excluded, never 0."""
    return df.filter(F.col(f"ss_{metric}").isNotNull() & F.col(f"rv_{metric}").isNotNull())


def as_bool(df: DataFrame, column: str) -> Column:
    """A boolean column as it is; of texts only "True" is true. Null is false."""
    c = F.col(column)
    return F.coalesce(c if df.schema[column].dataType.simpleString() == "boolean" else c.cast("string") == "True", F.lit(False))


def sft_eligible(df: DataFrame, min_reward: float = 0.5) -> DataFrame:
    """Rewarded traces, or traces that show a review or a revision."""
    reviewed = F.exists("steps", lambda s: s["step_type"].isin("revise", "review"))
    return df.filter((F.col("final_reward") >= min_reward) | reviewed)


def unpivot_conditions(df: DataFrame, min_quality: float) -> DataFrame:
    """The reviewed and the single-shot side of a row as labelled rows; both
    may pass the quality bar."""
    sides = F.array(
        F.struct(F.lit("reviewed").alias("baseline"), F.col("rv_quality").cast("double").alias("quality"),
                 F.col("rv_interaction_trace").alias("trace")),
        F.struct(F.lit("single_shot").alias("baseline"), F.col("ss_quality").cast("double").alias("quality"),
                 F.col("ss_interaction_trace").alias("trace")),
    )
    gone = {"rv_quality", "ss_quality", "rv_interaction_trace", "ss_interaction_trace"}
    rest = [c for c in df.columns if c not in gone]
    return (
        df.select(*rest, F.explode(sides).alias("s"))
        .select(*rest, "s.baseline", "s.quality", "s.trace")
        .filter((F.col("quality") >= min_quality) & (F.size("trace") > 0))
    )


def _blank(name: str) -> Column:
    return F.col(name).rlike(r"^\s*$")


def gate_tasks(df: DataFrame) -> DataFrame:
    """Adds ``reject_reason``: the first rule a generated code task breaks, or
    null. Outcomes of running both codes are input columns."""
    required = ["task_id", "bug_class", "description", "buggy_code", "fixed_code", "test_code", "common_bugs"]
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull()
    reason = F.when(missing, "missing fields")
    for c in ("buggy_code", "fixed_code", "test_code"):
        reason = reason.when(_blank(c), f"empty or non-string {c}")
    no = F.lit(False)
    reason = reason.when(~F.coalesce("fixed_passed", no), "fixed_code failed tests").when(
        F.coalesce("buggy_passed", no), "buggy_code passed tests"
    )
    return df.withColumn("reject_reason", reason)


def gate_visual_tasks(df: DataFrame) -> DataFrame:
    """Adds ``reject_reason`` for a visual task; web tasks also need viewports."""
    missing = F.lit(False)
    for c in ("task_id", "description", "requirements", "expected_issues", "difficulty"):
        missing = missing | F.col(c).isNull()
    missing = missing | ((F.col("category") == "webpages") & F.col("viewport_sizes").isNull())
    return df.withColumn(
        "reject_reason",
        F.when(missing, "missing fields")
        .when(F.length("description") < 200, "description too short")
        .when(F.size("requirements") < 5, "requirements must be a list of >=5 items")
        .when(F.size("expected_issues") < 3, "expected_issues must be a list of >=3 items"),
    )


def reject_counts(gated: DataFrame) -> DataFrame:
    return gated.groupBy(F.coalesce("reject_reason", F.lit("ok")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    )


def select_traces(df: DataFrame, ids=None, category=None, status=None, limit: int | None = None, order=None) -> DataFrame:
    """Trace browser: filters first, then the limit."""
    if ids:
        df = df.filter(F.col("task_id").isin(*ids))
    if category:
        df = df.filter(F.col("category") == category)
    if status:
        df = df.filter(F.col("status") == status)
    if limit:
        df = df.orderBy(*order).limit(limit) if order else df.limit(limit)
    return df


def corpus_issues(df: DataFrame, min_chars: int = 200) -> DataFrame:
    """Assistant messages that announce output but hold none."""
    m = df.select("task_id", F.posexplode("messages").alias("pos", "m"))
    text = F.col("m.content")
    return m.filter(
        (F.col("m.role") == "assistant") & text.contains("[GENERATE]") & ~text.contains("```") & (F.length(text) < min_chars)
    ).select("task_id", "pos", F.length(text).alias("n_chars"))


def assert_scrub(df: DataFrame) -> DataFrame:
    """Passes rows through and fails the job when any scrubbed task is broken,
    that is when its buggy code passes or its fixed code fails."""
    no = F.lit(False)
    broken = F.coalesce("buggy_passed", no) | ~F.coalesce("fixed_passed", no)
    stop = F.raise_error(F.concat(F.lit("scrub broke task "), F.col("task_id").cast("string"))).cast("boolean")
    return df.filter(F.when(broken, stop).otherwise(F.lit(True)))


def scrub_violations(df: DataFrame) -> DataFrame:
    no = F.lit(False)
    return df.filter(F.coalesce("buggy_passed", no) | ~F.coalesce("fixed_passed", no))
