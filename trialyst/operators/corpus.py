"""Conversation corpora from nested traces: stitching, collapsing, gates,
quotas and formats. A trace is one row, so nearly everything here is a
projection; rows meet only in joins on task keys and in small counts."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialyst.functions import phrases as P
from trialyst.functions.prng import draw, pick
from trialyst.functions.text import (
    convert_markers,
    extract_artifact,
    flatten_content,
    percent,
    scrub,
    strip,
    with_reasoning,
)
from trialyst.operators.normalize import assert_scrub, sft_eligible, unpivot_conditions
from trialyst.operators.scan import histogram, last_by_rank, take_by_rank
from trialyst.operators.summary import rows

MESSAGE = (
    "struct<role:string,content_text:string,content_parts:array<struct<type:string,text:string,image:string>>,"
    "tool_calls:array<struct<name:string,arguments:string>>>"
)
STEP = "struct<step_type:string,input_text:string,output_text:string,feedback:string,reward:double>"
# fixed values: quota shares of the stratified corpus
QUOTA = {"one_revise": 0.30, "two_revise": 0.40, "three_revise": 0.30}


def fill(template: str, **slots) -> Column:
    """A format string with its named slots replaced by columns or literals."""
    out = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            out.append(F.lit(text))
        if name:
            value = slots[name]
            out.append((value if isinstance(value, Column) else F.lit(value)).cast("string"))
    return F.concat(*out)


def _message(role: str, text=None, parts=None, calls=None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(role).alias("role"),
        (none if text is None else text).cast("string").alias("content_text"),
        (none if parts is None else parts).cast("array<struct<type:string,text:string,image:string>>").alias("content_parts"),
        (none if calls is None else calls).cast("array<struct<name:string,arguments:string>>").alias("tool_calls"),
    )


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _or_blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit(""))


# --- stitched repair conversations -------------------------------------------


def tool_result(execution: Column) -> Column:
    """Execution outcome as JSON text, with whole outputs."""
    blank = F.lit("")
    return F.to_json(
        F.struct(
            execution["passed"].alias("passed"),
            execution["error"].alias("error"),
            F.coalesce(execution["stdout"], blank).alias("stdout"),
            F.coalesce(execution["stderr"], blank).alias("stderr"),
        ),
        {"ignoreNullFields": "false"},
    )


def _code_block(code: Column) -> Column:
    return F.concat(F.lit("```python\n"), strip(code), F.lit("\n```"))


def _call(code: Column, tests: Column) -> Column:
    args = F.to_json(F.struct(code.alias("code"), tests.alias("test_code")))
    return F.array(F.struct(F.lit("execute_code").alias("name"), args.alias("arguments")))


def _draft_turns(verify: list[str], seed) -> list[Column]:
    before = _or_blank(F.col("voice.before_exec"))
    lead = F.when((before == "") | (F.length(before) > 300), pick(verify, seed, "task_id", F.lit("verify"))).otherwise(before)
    text = F.concat_ws("\n\n", strip(F.col("voice.preamble")), _code_block(F.col("draft_code")), lead)
    return [
        _message("user", F.col("description")),
        _message("assistant", text, calls=_call(F.col("draft_code"), F.col("test_code"))),
        _message("tool", tool_result(F.col("draft_exec"))),
    ]


def _confirm(options: list[str], seed) -> Column:
    said = _or_blank(F.col("voice.confirm"))
    return _message("assistant", F.when(said == "", pick(options, seed, "task_id", F.lit("confirm"))).otherwise(said))


def _lead_in(text: Column) -> Column:
    said = _or_blank(text)
    return F.when(said == "", P.FIX_LEAD).otherwise(said)


def _wrap(traces: DataFrame, messages: Column) -> DataFrame:
    return traces.select(
        "task_id", "stratum", F.coalesce("bug_class", F.lit("?")).alias("bug_class"), messages.alias("messages")
    )


def stitch_v1(traces: DataFrame, seed) -> DataFrame:
    """Draft, its test run and a confirmation; with a diagnosis-and-fix turn in
    between unless nothing was revised. Traces carry ``fixed_code``,
    ``fixed_exec`` and the diagnosis in ``voice``."""
    text = F.concat_ws(
        "\n\n", _or_blank(F.col("voice.diagnosis")), pick(P.FAIL_TO_FIX, seed, "task_id", F.lit("fix")),
        _lead_in(F.col("voice.revision_preamble")), _code_block(F.col("fixed_code")),
        pick(P.VERIFY_FIX_V1, seed, "task_id", F.lit("verify_fix")),
    )
    revised = F.array(
        _message("assistant", text, calls=_call(F.col("fixed_code"), F.col("test_code"))),
        _message("tool", tool_result(F.col("fixed_exec"))),
    )
    middle = F.when(F.col("stratum") == "no_revise", _empty(MESSAGE)).otherwise(revised)
    return _wrap(
        traces, F.concat(F.array(*_draft_turns(P.VERIFY_V1, seed)), middle, F.array(_confirm(P.CONFIRM_V1, seed)))
    )


def stitch_v3(traces: DataFrame, seed) -> DataFrame:
    """As before, with one fix turn and test run per attempt; from the second
    attempt on the turn opens with a retry phrase."""

    def turn(a: Column, i: Column) -> Column:
        no = i.cast("string")
        retry = F.concat(pick(P.RETRY, seed, "task_id", F.lit("retry"), no), F.lit("\n\n"))
        text = F.concat(
            F.when(i > 0, retry).otherwise(""), _or_blank(a["diagnosis"]), F.lit("\n\n"), _lead_in(a["revision_preamble"]),
            F.lit("\n\n"), _code_block(a["code"]), F.lit("\n\n"), pick(P.VERIFY_FIX_V3, seed, "task_id", F.lit("verify_fix"), no),
        )
        return F.array(
            _message("assistant", text, calls=_call(a["code"], F.col("test_code"))), _message("tool", tool_result(a["exec"]))
        )

    middle = F.when(F.col("stratum") == "no_revise", _empty(MESSAGE)).otherwise(F.flatten(F.transform("attempts", turn)))
    usable = traces.filter((F.col("stratum") == "no_revise") | (F.size("attempts") > 0))
    return _wrap(
        usable, F.concat(F.array(*_draft_turns(P.VERIFY_V3, seed)), middle, F.array(_confirm(P.CONFIRM_V3, seed)))
    )


# --- agentic traces ----------------------------------------------------------


def _image_count(m: Column) -> Column:
    n = F.size(F.filter(m["content_parts"], lambda p: p["type"] == "image_url"))
    return F.when((m["role"] == "user") & m["content_parts"].isNotNull(), n).otherwise(0)


def collapse_messages(traces: DataFrame, system: str = P.STUDENT_PROMPT) -> DataFrame:
    """Training messages of a recorded run. The system text is replaced. A tool
    message that announces an image absorbs the image message after it; image
    messages are dropped otherwise. Saved images are handed out in order, and
    a message whose images run out keeps its plain text."""
    counted = traces.withColumn("__n", F.transform("messages", _image_count))

    def rewrite(m: Column, i: Column) -> Column:
        upcoming = F.coalesce(F.get(F.col("__n"), i + 1), F.lit(0))
        used = F.aggregate(F.slice("__n", F.lit(1), i + 1), F.lit(0), lambda a, n: a + n)
        hint = m["content_text"].contains('"kind": "image"') & m["content_text"].contains('"see"')
        stocked = (upcoming > 0) & (used + upcoming <= F.size("saved_images"))
        shots = F.concat(
            F.array(F.struct(F.lit("text").alias("type"), F.lit(P.SCREENSHOT).alias("text"), F.lit(None).cast("string").alias("image"))),
            F.transform(
                F.slice("saved_images", used + 1, upcoming),
                lambda p: F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), p.alias("image")),
            ),
        )
        said = F.struct(
            m["role"].alias("role"), F.coalesce(m["content_text"], F.lit("")).alias("content_text"),
            m["content_parts"].alias("content_parts"), m["tool_calls"].alias("tool_calls"),
        ).cast(MESSAGE)
        return (
            F.when(m["role"] == "system", _message("system", F.lit(system)))
            .when((m["role"] == "tool") & F.coalesce(hint, F.lit(False)) & stocked, _message("tool", parts=shots))
            .when(m["role"] == "assistant", said)
            .otherwise(m.cast(MESSAGE))
        )

    kept = F.filter(F.transform("messages", rewrite), lambda m, i: F.get(F.col("__n"), i) == 0)
    return counted.filter(F.size("messages") > 0).withColumn("messages", kept).drop("__n")


def _json_length(c: Column) -> Column:
    """Length of a JSON string literal with everything beyond ASCII escaped."""
    plain = F.length(F.to_json(F.struct(c.alias("t")))) - 6
    wide = F.length(F.regexp_replace(c, r"[\x00-\x7F]", ""))
    astral = F.length(F.regexp_replace(c, r"[\x{0}-\x{FFFF}]", ""))
    return F.coalesce(plain + wide * 5 + astral * 6, F.lit(4))


def messages_length(messages: Column) -> Column:
    """Serialized length of a message list: JSON with a blank after each comma
    and colon and with non-ASCII characters escaped."""

    def listed(items: Column, size) -> Column:
        total = F.aggregate(F.transform(items, size), F.lit(0), lambda a, n: a + n)
        return total + 2 + 2 * F.greatest(F.size(items) - 1, F.lit(0))

    def part(p: Column) -> Column:
        # {"type": "text", "text": ...} or {"type": "image", "image": ...}
        return F.when(p["type"] == "text", _json_length(p["text"]) + 26).otherwise(_json_length(p["image"]) + 28)

    def call(c: Column) -> Column:
        # {"type": "function", "function": {"name": ..., "arguments": ...}}
        return _json_length(c["name"]) + _json_length(c["arguments"]) + 59

    def message(m: Column) -> Column:
        # {"role": ..., "content": ...} and , "tool_calls": [...]
        body = F.when(m["content_parts"].isNotNull(), listed(m["content_parts"], part)).otherwise(_json_length(m["content_text"]))
        calls = F.when(F.size(m["tool_calls"]) > 0, listed(m["tool_calls"], call) + 16).otherwise(0)
        return _json_length(m["role"]) + body + calls + 23

    return listed(messages, message)


def _images(messages: Column) -> Column:
    parts = F.flatten(F.transform(messages, lambda m: F.coalesce(m["content_parts"], _empty("struct<type:string,text:string,image:string>"))))
    return F.transform(F.filter(parts, lambda p: p["type"] == "image"), lambda p: p["image"])


def build_examples(traces: DataFrame, files: DataFrame, key: list[str]) -> DataFrame:
    """Adds ``buildable``: there are messages, one of them from the assistant,
    and every image is in the table of known files (column ``path``)."""
    wanted = traces.select(*key, F.explode(_images(F.col("messages"))).alias("path"))
    broken = wanted.join(files.select("path"), "path", "left_anti").select(*key).distinct().withColumn("__lost", F.lit(True))
    spoken = F.exists("messages", lambda m: m["role"] == "assistant")
    return traces.join(broken, key, "left").withColumn(
        "buildable", F.coalesce(spoken, F.lit(False)) & F.col("__lost").isNull()
    ).drop("__lost")


def gate_traces(
    examples: DataFrame, max_steps: int | None = None, max_chars: int | None = None, judge_keep: bool = False, final_passed: bool = False
) -> DataFrame:
    """Adds ``reject_reason``, the first rule a trace breaks, or null: too many
    steps, judge, final outcome, not buildable, too long. Lengths are limited only where a limit is given."""
    no = F.lit(False)
    reason = F.when(no if max_steps is None else F.coalesce("n_steps", F.lit(0)) > max_steps, "steps")
    if judge_keep:
        reason = reason.when(~F.coalesce(F.col("judge.keep"), no), "judge")
    if final_passed:
        code = F.col("category") == "code"
        reason = reason.when(code & ~F.coalesce("final_passed", no), "final_passed").when(
            ~code & ~F.coalesce(F.col("status") == "final", no), "final_passed"
        )
    reason = reason.when(~F.col("buildable"), "missing_image").when(
        no if max_chars is None else messages_length(F.col("messages")) > max_chars, "too_long"
    )
    return examples.withColumn("reject_reason", reason)


def gate_visual(traces: DataFrame, tasks: DataFrame, require_keep: bool = True) -> DataFrame:
    """Kept by the judge (optional), specific in its review (always), task known."""
    no = F.lit(False)
    good = F.coalesce(F.col("judge.review_specific"), no)
    if require_keep:
        good = good & F.coalesce(F.col("judge.keep"), no)
    return traces.filter(good).join(tasks.select("category", "task_id"), ["category", "task_id"], "left_semi")


def build_visual_examples(traces: DataFrame, systems: dict[str, str], reasoning_cap: int | None = None) -> DataFrame:
    """Conversation with one assistant turn per trace turn and feedback between
    turns. A trace is void if it has no turns, a blank assistant turn, or a
    turn before the last without an artifact. Image paths follow from
    (category, task, turn); rendering them is someone else's job."""
    cat = F.col("category")
    table = F.create_map(*[F.lit(x) for kv in systems.items() for x in kv])
    n = F.size("turns")
    spoken = F.forall("turns", lambda t: F.length(_or_blank(t["assistant"])) > 0)
    whole = F.forall(F.slice("turns", F.lit(1), F.greatest(n - 1, F.lit(0))), lambda t: extract_artifact(t["assistant"], cat).isNotNull())

    def text_part(c: Column) -> Column:
        return F.struct(F.lit("text").alias("type"), c.alias("text"), F.lit(None).cast("string").alias("image"))

    def feedback(i: Column) -> Column:
        path = F.concat_ws("_", cat, F.col("task_id").cast("string"), F.concat(F.lit("turn"), i.cast("string")), F.lit("1920x1080"), F.lit("resized.png"))
        said = F.coalesce(F.get(F.col("turns"), i + 1)["feedback"]["text_payload"], F.lit(""))
        shot = F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), path.alias("image"))
        return F.when(cat == "code", F.array(text_part(said))).otherwise(F.array(text_part(F.lit(P.RENDERED)), shot))

    def turn(t: Column, i: Column) -> Column:
        said = _message("assistant", parts=F.array(text_part(with_reasoning(t["assistant"], F.coalesce(t["reasoning"], F.lit("")), reasoning_cap))))
        return F.when(i < n - 1, F.array(said, _message("user", parts=feedback(i)))).otherwise(F.array(said))

    opening = F.array(
        _message("system", F.element_at(table, cat)), _message("user", parts=F.array(text_part(F.col("user_turn"))))
    )
    return traces.filter((n > 0) & spoken & whole).select(
        "task_id", "category", F.concat(opening, F.flatten(F.transform("turns", turn))).alias("messages")
    )


def rejection_set(judged: DataFrame, tasks: DataFrame, systems: dict[str, str]) -> DataFrame:
    """Judge-kept trajectories of known tasks as examples, one per (category,
    task, seed)."""
    kept = judged.filter(F.coalesce(F.col("judge.keep"), F.lit(False)))
    known = kept.join(tasks.select("category", "task_id"), ["category", "task_id"], "left_semi")
    w = Window.partitionBy("category", "task_id", "seed").orderBy("pos")
    one = known.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")
    return build_visual_examples(one, systems)


def apply_judge(traces: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Keep decision per trace with a reason where there is none. For code the
    test outcome overrides the judge."""
    v = verdicts.withColumn("__v", F.lit(True))
    no = F.lit(False)
    error = F.when(F.col("n_messages") == 0, "no_messages").when(~F.col("task_known"), "task_not_found").when(
        F.col("__v").isNull(), "judge_failed"
    )
    code = (F.col("category") == "code") & (F.coalesce(error, F.lit("")).isin("", "judge_failed"))
    passed = F.coalesce("final_passed", no)
    return traces.join(v, ["category", "task_id"], "left").select(
        *traces.columns,
        F.when(code, passed).when(error.isNotNull(), no).otherwise(F.coalesce("keep", no)).alias("keep"),
        F.when(code, passed).when(error.isNotNull(), F.lit(None)).otherwise(F.col("final_meets_spec")).alias("final_meets_spec"),
        error.alias("error"),
    )


def train_flags(examples: DataFrame, mode: str = "prefix") -> DataFrame:
    """Which messages are trained on: all but the first three, or the
    assistant's only."""
    flag = (lambda m, i: i > 2) if mode == "prefix" else (lambda m, i: m["role"] == "assistant")
    return examples.withColumn("trainable", F.transform("messages", flag))


def scrub_tasks(tasks: DataFrame, execution: DataFrame) -> DataFrame:
    """Scrubbed codes, with the outcome of running them; one broken task stops
    the job."""
    clean = tasks.withColumn("buggy_code", scrub("buggy_code")).withColumn("fixed_code", scrub("fixed_code"))
    return assert_scrub(clean.join(execution, "task_id", "left"))


def prompt_rows(tasks: DataFrame) -> DataFrame:
    return tasks.select(
        "task_id", "test_code", fill(P.REPAIR_PROMPT, description=F.col("description"), test_code=F.col("test_code")).alias("prompt")
    )


# --- quotas ------------------------------------------------------------------


def quota_sample(df: DataFrame, ratios: dict[str, float] = QUOTA, total: int = 0, seed=7, key: str = "task_id") -> DataFrame:
    """A seeded sample with fixed stratum shares. Without a total the scarcest
    stratum sets it; a shortfall elsewhere is not made up for."""
    named = df.filter(F.col("stratum").isin(*ratios))
    rank = draw(seed, key)
    hist = histogram(named, ["stratum"], rank)
    share = F.element_at(F.create_map(*[F.lit(x) for kv in ratios.items() for x in kv]), F.col("stratum"))
    # one row per named stratum
    counts = hist.groupBy("stratum").agg(F.sum("__n").alias("n")).withColumn("share", share)
    limit = (
        F.lit(total)
        if total
        else F.min(F.when(F.col("share") > 0, F.floor(F.col("n") / F.col("share")).cast("bigint"))).over(Window.partitionBy(F.lit(1)))
    )
    quota = counts.withColumn("n_take", F.bround(F.col("share") * limit, 0).cast("bigint"))
    return take_by_rank(named, ["stratum"], rank, [key], quota.select("stratum", "n_take"), hist=hist)


def assign_strata(tasks: DataFrame, fraction: float, seed, key: str = "task_id") -> DataFrame:
    """Exactly round(n * fraction) tasks, chosen by hash, become no_revise. Two passes find the
    last of them, one row; the third marks the tasks, each by itself."""
    rank = draw(seed, key)
    # one group of everything; a computed key keeps its joins hash joins
    whole = tasks.select(key, (rank % 1).alias("__all"))
    hist = histogram(whole, ["__all"], rank)
    quota = hist.groupBy("__all").agg(F.bround(F.sum("__n") * F.lit(fraction), 0).cast("bigint").alias("n_take"))
    last = last_by_rank(whole, ["__all"], rank, [key], quota, hist=hist).collect()
    chosen = F.lit(bool(last))
    if last and last[0]["__last"] is not None:
        at, name = last[0]["__last"], F.col(key)
        chosen = (rank < at[0]) | ((rank == at[0]) & F.coalesce(name <= F.lit(at[1]), name.isNull()))
    return tasks.withColumn("target", F.when(chosen, "no_revise").otherwise("revise"))


def draw_candidates(pool: DataFrame, n: int, seed, key: str = "task_id") -> DataFrame:
    """The first n tasks in hash order."""
    return pool.orderBy(draw(seed, key), key).limit(n)


# --- interaction traces ------------------------------------------------------


def to_sft(traces: DataFrame, prompts: dict[str, str], default: str, min_reward: float = 0.5) -> DataFrame:
    """Eligible traces as conversations. Prompts by task type may use {budget}
    and {task_type}."""
    system = None
    slots = {"budget": F.col("budget_steps"), "task_type": F.col("task_type")}
    for kind, text in prompts.items():
        filled = fill(text, **slots)
        cond = F.col("task_type") == kind
        system = F.when(cond, filled) if system is None else system.when(cond, filled)
    system = fill(default, **slots) if system is None else system.otherwise(fill(default, **slots))

    def say(role: str, c: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), c.alias("content"))

    def step(s: Column) -> Column:
        told = F.array(say("user", s["input_text"]), say("assistant", s["output_text"]))
        heard = F.array(say("user", F.concat(F.lit("[FEEDBACK]:\n"), s["feedback"])))
        return F.when(F.length(s["feedback"]) > 0, F.concat(told, heard)).otherwise(told)

    messages = F.concat(F.array(say("system", system)), F.flatten(F.transform("steps", step)))
    return sft_eligible(traces, min_reward).select(
        "task_id", "task_type", messages.alias("messages"), F.col("final_reward").alias("reward")
    )


def to_reward_rows(traces: DataFrame) -> DataFrame:
    """Prompt, whole trajectory as completion, reward; failures included."""

    def step(s: Column) -> Column:
        heard = F.concat(F.lit("[FEEDBACK]:\n"), s["feedback"])
        return F.when(F.length(s["feedback"]) > 0, F.array(s["output_text"], heard)).otherwise(F.array(s["output_text"]))

    prompt = fill(P.REWARD_PROMPT, budget=F.col("budget_steps"), task_type=F.col("task_type"), task=F.col("task_description"))
    return traces.select(
        "task_id", "task_type", prompt.alias("prompt"),
        F.array_join(F.flatten(F.transform("steps", step)), "\n\n").alias("completion"), F.col("final_reward").alias("reward"),
    )


def onpolicy_sft(pairs: DataFrame, min_quality: float = 0.5, target: str = "tags") -> DataFrame:
    """Recorded model traces as conversations, either condition that scores
    well enough. The system text comes once, before the first turn."""
    rows_ = unpivot_conditions(pairs, min_quality)
    turns = rows_.withColumn("__t", F.filter("trace", lambda s: s["step"].isin("generate", "revise")))

    def say(role: Column, c: Column) -> Column:
        return F.struct(role.alias("role"), c.alias("content"))

    def plain(m: Column) -> Column:
        return say(m["role"], flatten_content(m["content_text"], m["content_parts"]))

    none = _empty("struct<role:string,content:string>")

    def step(s: Column, i: Column) -> Column:
        answer = F.array(say(F.lit("assistant"), convert_markers(F.coalesce(s["full_output"], F.lit("")), target)))
        system = F.when((i == 0) & (F.length(s["system"]) > 0), F.array(say(F.lit("system"), s["system"]))).otherwise(none)
        asked = F.coalesce(F.transform(s["messages"], plain), none)
        last = F.element_at(s["messages_text"], -1)
        again = F.when(
            F.size(s["messages_text"]) > 0,
            F.array(say(F.lit("user"), flatten_content(last["content_text"], last["content_parts"]))),
        ).otherwise(none)
        return F.when(s["step"] == "generate", F.concat(system, asked, answer)).otherwise(F.concat(again, answer))

    return turns.select(
        "task_id", F.col("category").alias("task_type"), F.flatten(F.transform("__t", step)).alias("messages"),
        F.col("quality").alias("reward"), F.lit("onpolicy").alias("source"), F.coalesce("model", F.lit("unknown")).alias("model"), "baseline",
    )


def _step(kind: str, asked, answered, feedback=None, reward=None) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        F.lit(kind).alias("step_type"), as_col(asked).cast("string").alias("input_text"), as_col(answered).cast("string").alias("output_text"),
        as_col(feedback).cast("string").alias("feedback"), as_col(reward).cast("double").alias("reward"),
    )


def _given(c: Column, other: Column) -> Column:
    """The text, unless it is missing or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), other)


def _trace(df: DataFrame, kind: Column, budget: int, reward: Column, success: Column, steps: Column) -> DataFrame:
    return df.select(
        "task_id", kind.alias("task_type"), F.col("description").alias("task_description"), F.lit(budget).alias("budget_steps"),
        steps.alias("steps"), reward.cast("double").alias("final_reward"), success.alias("success"),
    )


def _bullets() -> Column:
    return F.array_join(F.transform("requirements", lambda r: F.concat(F.lit("- "), r)), "\n")


def _optional(cond: Column, *steps: Column) -> Column:
    return F.when(cond, F.array(*steps)).otherwise(_empty(STEP))


def code_traces(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """Interaction traces of code tasks: budget 5, success is passing. Inputs
    are normalized results (ss_passed, rv_passed, rv_iters, final codes)."""
    T = P.CODE
    df = results.join(tasks.select("task_id", "description", "test_code", "common_bugs"), "task_id")
    no = F.lit(False)
    first, later = F.coalesce("ss_passed", no), F.coalesce("rv_passed", no)
    hint = F.coalesce(F.get(F.col("common_bugs"), F.lit(0)), F.lit(T["hint"]))
    shown = F.regexp_extract("description", r"(?s)(?:^|\n)[ \t]*```python[^\n]*\n(.*?)(?:\n[ \t]*```[ \t]*(?:\n|\z)|\z)", 1)

    def attempt(fixed: Column) -> Column:
        return F.when(shown == "", fill(T["no_code"], hint=hint)).when(fixed, fill(T["fixed_code"], hint=hint, code=shown)).otherwise(shown)

    draft = _given(F.col("ss_final_code"), attempt(first))
    fixed = _given(F.col("rv_final_code"), attempt(F.lit(True)))
    tests = F.coalesce("test_code", F.lit(""))
    opening = F.array(
        _step("generate", fill(T["generate_in"], desc=F.col("description"), tests=tests), fill(T["generate_out"], code=draft)),
        _step("execute", T["execute_in"], "[EXECUTE]", F.when(first, T["passed"]).otherwise(fill(T["stderr"], hint=hint))),
    )
    repaired = _optional(
        ~first & later,
        _step("review", fill(T["review_in"], hint=hint), fill(T["review_out"], hint=hint)),
        _step("revise", fill(T["revise_in"], hint=hint), fill(T["generate_out"], code=fixed)),
        _step("execute", T["rerun_in"], "[EXECUTE]", T["passed"]),
    )
    tries = F.least(F.coalesce("rv_iters", F.lit(1)).cast("int") - 1, F.lit(2))
    again = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.greatest(tries, F.lit(1)) - 1),
            lambda k: F.array(
                _step("review", fill(T["again_in"], left=F.lit(4) - k * 2), fill(T["again_out"], attempt=k + 2, hint=hint)),
                _step("execute", T["again_run"], "[EXECUTE]", T["failed"]),
            ),
        )
    )
    failed = F.when(~first & ~later & (tries > 0), again).otherwise(_empty(STEP))
    end = F.when(first | later, F.array(_step("submit", T["submit_in"], T["submit_out"], reward=1.0))).otherwise(
        F.array(_step("submit", T["spent_in"], T["spent_out"], reward=0.0))
    )
    return _trace(df, F.lit("code"), 5, later.cast("double"), later, F.concat(opening, repaired, failed, end))


def visual_traces(results: DataFrame, tasks: DataFrame, kind: str = "slide") -> DataFrame:
    """Traces of slides, pages or animations: budget 3, success from quality
    0.7; results without a score on either side drop out."""
    T = P.VISUAL
    scored = results.filter(F.col("ss_quality").isNotNull() & F.col("rv_quality").isNotNull())
    df = scored.join(tasks.select("task_id", "description", "requirements", "expected_issues"), "task_id")
    ss, rv = F.col("ss_quality"), F.col("rv_quality")
    items = F.array_join(
        F.transform("requirements", lambda r: F.concat(F.lit("    <!-- Requirement: "), r, F.lit(" -->"))), "\n"
    )
    stub = fill(T["stub"], title=kind.title(), kind=kind, items=items, desc=F.col("description"))
    html = _given(F.col("ss_final_code"), stub)
    listed = F.get(F.col("expected_issues"), F.lit(0))
    issue = F.coalesce(listed, F.lit(T["none"]))
    level = F.when(ss < 0.5, "critical").otherwise("major")
    judged = F.when(ss < 0.9, fill(T["issues"], q=percent(ss), level=level, issue=issue)).otherwise(fill(T["fine"], q=percent(ss)))
    known = F.coalesce(listed, F.lit(T["issue"]))
    opening = F.array(
        _step("generate", fill(T["generate_in"], kind=kind, desc=F.col("description"), reqs=_bullets()), fill(T["generate_out"], code=html)),
        _step("execute", T["execute_in"], T["execute_out"], judged),
    )
    revised = _optional(
        (F.coalesce("rv_iters", F.lit(1)) > 1) & (rv != ss),
        _step("review", fill(T["review_in"], q=percent(ss), issue=known), fill(T["review_out"], issue=known)),
        _step("revise", T["revise_in"], fill(T["generate_out"], code=_given(F.col("rv_final_code"), html))),
        _step("execute", T["rerun_in"], "[EXECUTE]", fill(T["score"], q=percent(rv))),
    )
    said = F.when(rv >= 0.7, fill(T["submit_good"], q=percent(rv))).otherwise(fill(T["submit_best"], q=percent(rv)))
    end = F.array(_step("submit", T["submit_in"], said, reward=rv))
    return _trace(df, F.lit(kind), 3, rv, rv >= 0.7, F.concat(opening, revised, end))


def video_traces(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """Traces of video scripts: budget 3, success from quality 0.7; quality 0
    means that the script failed."""
    T = P.VIDEO
    df = results.join(tasks.select("task_id", "description", "requirements", "expected_issues", "source_video"), "task_id")
    ss, rv = F.coalesce("ss_quality", F.lit(0.0)), F.coalesce("rv_quality", F.lit(0.0))
    stub = fill(T["stub"], desc=F.col("description"), source=F.coalesce("source_video", F.lit(T["source"])))
    script = _given(F.col("ss_final_code"), stub)
    listed = F.get(F.col("expected_issues"), F.lit(0))
    bad = ss == 0
    ran = F.when(bad, fill(T["failed"], issue=F.coalesce(listed, F.lit(T["fail_issue"])))).otherwise(fill(T["ran"], q=percent(ss)))
    known = F.coalesce(listed, F.lit(T["issue"]))
    source = F.coalesce("source_video", F.lit(""))
    opening = F.array(
        _step("generate", fill(T["generate_in"], desc=F.col("description"), source=source, reqs=_bullets()), fill(T["generate_out"], code=script)),
        _step("execute", T["execute_in"], "[EXECUTE]", ran),
    )
    revised = _optional(
        F.coalesce("rv_iters", F.lit(1)) > 1,
        _step(
            "review", F.when(bad, fill(T["review_failed"], issue=known)).otherwise(fill(T["review_in"], issue=known)),
            F.when(bad, fill(T["review_out_failed"], issue=known)).otherwise(fill(T["review_out"], issue=known)),
        ),
        _step("revise", T["revise_in"], fill(T["generate_out"], code=_given(F.col("rv_final_code"), script))),
        _step("execute", T["rerun_in"], "[EXECUTE]", fill(T["rerun"], q=percent(rv))),
    )
    end = F.array(_step("submit", T["submit_in"], fill(T["submit_out"], q=percent(rv)), reward=rv))
    return _trace(df, F.lit("video"), 3, rv, rv >= 0.7, F.concat(opening, revised, end))


def research_traces(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """Traces of research reports: budget 2, success from accuracy 0.8."""
    T = P.RESEARCH
    df = results.join(tasks.select("task_id", "description", "requirements"), "task_id")
    ss = F.coalesce("ss_accuracy", "ss_quality", F.lit(0.0))
    rv = F.coalesce("rv_accuracy", "rv_quality", F.lit(0.0))
    sections = F.array_join(F.transform("requirements", lambda r: fill(T["section"], name=r)), "\n\n")
    report = _given(F.col("ss_final_code"), fill(T["stub"], desc=F.col("description"), sections=sections))
    checked = F.when(ss >= 0.9, fill(T["verified"], q=percent(ss))).otherwise(fill(T["errors"], q=percent(ss)))
    opening = F.array(
        _step("generate", fill(T["generate_in"], desc=F.col("description"), reqs=_bullets()), fill(T["generate_out"], code=report)),
        _step("execute", T["execute_in"], T["execute_out"], checked),
    )
    revised = _optional(
        (F.coalesce("rv_iters", F.lit(1)) > 1) & (rv > ss),
        _step("review", fill(T["review_in"], q=percent(ss)), T["review_out"]),
        _step("revise", T["revise_in"], fill(T["generate_out"], code=_given(F.col("rv_final_code"), report))),
        _step("execute", T["rerun_in"], "[EXECUTE]", fill(T["rerun"], q=percent(rv))),
    )
    end = F.array(_step("submit", T["submit_in"], fill(T["submit_out"], q=percent(rv)), reward=rv))
    return _trace(df, F.lit("research"), 2, rv, rv >= 0.8, F.concat(opening, revised, end))
