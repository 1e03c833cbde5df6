"""Text reports and summaries assembled from rows, and code checks."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialyst.functions.text import head, percent, scrub
from trialyst.operators.summary import rate, rows

# fixed values: the kinds in report order
KINDS = ["overlap", "overflow", "clipped", "misalignment", "scrollbar"]
# fixed values: report lines; {0} and {1} are the example texts, {tag} a width or frame
LINES = {
    "page": {
        "overlap": '- OVERLAP: the text "{0}" overlaps the text "{1}" -- move them apart so their bounding boxes do not intersect.',
        "overflow": '- OVERFLOW: the text "{0}" extends outside its container box -- enlarge the box or shrink/wrap the text.',
        "clipped": '- CLIPPED: "{0}" extends beyond the 1920x1080 viewport edge -- move it fully inside with >=10px margin.',
        "misalignment": "- MISALIGNMENT: {0} -- make the boxes in that group equal size, share top/bottom (or left/right) edges, and use uniform gutters.",
        "scrollbar": "- SCROLLBAR: the page is {0}px too wide and {1}px too tall; the whole figure must fit in 1920x1080 with NO scrollbar (set body margin:0 and size the canvas to fit).",
    },
    "web": {
        "overlap": '- OVERLAP (at {tag}px width): "{0}" overlaps "{1}" -- separate them.',
        "overflow": '- OVERFLOW (at {tag}px width): "{0}" spills outside its container -- contain or wrap it.',
        "clipped": '- HORIZONTAL CLIP (at {tag}px width): "{0}" extends past the right edge -- keep all content within {tag}px.',
        "misalignment": "- MISALIGNMENT (at {tag}px width): {0} -- equalize sizes, share edges, use uniform gutters.",
        "scrollbar": "- HORIZONTAL SCROLLBAR (at {tag}px width): the page is {0}px too wide -- nothing may exceed {tag}px width (vertical scrolling is fine).",
    },
    "animation": {
        "overlap": '- OVERLAP (at t={tag}ms): "{0}" overlaps "{1}" -- they must not collide during the animation.',
        "overflow": '- OVERFLOW (at t={tag}ms): "{0}" spills outside its container -- contain it.',
        "clipped": '- OFF-SCREEN (at t={tag}ms): "{0}" leaves the 1920x1080 viewport -- keep every element fully on-screen throughout the motion.',
        "misalignment": "- MISALIGNMENT (at t={tag}ms): {0} -- keep the group equal-size and edge-aligned during the animation.",
    },
}
# The animation report lists off-screen elements before overflow.
KIND_RANK = {"animation": ["overlap", "clipped", "overflow", "misalignment"]}


def _fill(template: str, **cols: Column) -> Column:
    """A template with its slots replaced by columns."""
    out, rest = [], template
    while "{" in rest:
        text, _, rest = rest.partition("{")
        slot, _, rest = rest.partition("}")
        out += [F.lit(text), F.coalesce(cols[slot].cast("string"), F.lit(""))]
    return F.concat(*out, F.lit(rest))


def defect_text(defects: DataFrame, mode: str = "page", limits: dict[str, int] | None = None) -> DataFrame:
    """Feedback text per page: one line per defect. ``defects`` has page_id,
    tag, kind, pos, first, second. ``limits`` may bound the lines of a kind and
    tag; then ``n_left_out`` counts the defects without a line."""
    order = KIND_RANK.get(mode, KINDS)
    kind_rank = F.array_position(F.array(*[F.lit(k) for k in order]), F.col("kind"))
    w = Window.partitionBy("page_id", "tag", "kind").orderBy("pos")
    top = defects.filter(F.col("kind").isin(order)).withColumn("rn", F.row_number().over(w))
    shown = F.lit(True)
    for kind, n in (limits or {}).items():
        shown = shown & ((F.col("kind") != kind) | (F.col("rn") <= n))
    line = None
    for kind in order:
        text = _fill(LINES[mode][kind], **{"0": F.col("first"), "1": F.col("second"), "tag": F.col("tag")})
        line = F.when(F.col("kind") == kind, text) if line is None else line.when(F.col("kind") == kind, text)
    lines = F.collect_list(F.when(shown, F.struct("tag", kind_rank.alias("k"), "rn", line.alias("line"))))
    text = F.array_join(F.transform(F.array_sort(lines), lambda s: s["line"]), "\n").alias("feedback")
    return top.groupBy("page_id").agg(text, *([F.count_if(~shown).alias("n_left_out")] if limits else []))


def review_text(issues: Column, suggestions: Column, confidence: Column) -> Column:
    """A review as text: numbered issues, numbered suggestions, confidence."""

    def issue(x: Column, i: Column) -> Column:
        hint = F.coalesce(x["line_hint"], F.lit(""))
        return F.concat(
            F.lit("  "), (i + 1).cast("string"), F.lit(". ["), F.upper(F.coalesce(x["severity"], F.lit("unknown"))),
            F.lit("] "), F.coalesce(x["description"], F.lit("")),
            F.when(hint != "", F.concat(F.lit("  (near: "), hint, F.lit(")"))).otherwise(F.lit("")),
        )

    none = F.array().cast("array<string>")
    first = F.when(F.size(issues) > 0, F.concat(F.array(F.lit("Issues found:")), F.transform(issues, issue))).otherwise(none)
    second = F.when(
        F.size(suggestions) > 0,
        F.concat(
            F.array(F.lit("\nSuggestions:")),
            F.transform(suggestions, lambda s, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), s)),
        ),
    ).otherwise(none)
    last = F.array(F.concat(F.lit("\nReviewer confidence: "), percent(confidence)))
    return F.array_join(F.concat(first, second, last), "\n")


def claim_text(claims: DataFrame, first: int | None = None, evidence_chars: int | None = None) -> DataFrame:
    """Fact-check report per document over all its claims, with whole evidence;
    with ``first`` over so many, and ``n_left_out`` counts the others."""
    listed = claims.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("pos", "claim", "verdict", "evidence"))).alias("cs"))
    if first is not None:
        listed = listed.withColumn("n_left_out", F.greatest(F.size("cs") - first, F.lit(0))).withColumn("cs", F.slice("cs", 1, first))

    def of(kind: str) -> Column:
        return F.filter("cs", lambda c: c["verdict"] == kind)

    n_ok = F.size(of("supported"))
    start = F.concat(
        F.lit("Factual Accuracy: "), percent(n_ok / F.size("cs")), F.lit(" ("), n_ok.cast("string"), F.lit("/"),
        F.size("cs").cast("string"), F.lit(" claims supported)\n"),
    )
    none = F.array().cast("array<string>")
    wrong = F.when(
        F.size(of("contradicted")) > 0,
        F.concat(
            F.array(F.lit("CONTRADICTED CLAIMS:")),
            F.transform(
                of("contradicted"),
                lambda c: F.concat(F.lit('  ✗ "'), c["claim"], F.lit('"\n    Evidence: '), head(c["evidence"], evidence_chars)),
            ),
        ),
    ).otherwise(none)
    unknown = F.when(
        F.size(of("unverifiable")) > 0,
        F.concat(
            F.array(F.lit("\nUNVERIFIABLE CLAIMS:")),
            F.transform(of("unverifiable"), lambda c: F.concat(F.lit('  ? "'), c["claim"], F.lit('"'))),
        ),
    ).otherwise(none)
    good = F.when(
        n_ok > 0, F.array(F.concat(F.lit("\nSUPPORTED: "), n_ok.cast("string"), F.lit(" claims verified")))
    ).otherwise(none)
    return listed.select(
        "report_id", F.array_join(F.concat(F.array(start), wrong, unknown, good), "\n").alias("report")
    )


# --- traces ------------------------------------------------------------------


def _argument(call: Column, name: str) -> Column:
    return F.try_variant_get(F.try_parse_json(call["arguments"]), f"$.{name}", "string")


def step_summary(traces: DataFrame, content_chars: int = 400, arg_chars: int = 200) -> DataFrame:
    """Compact steps: heads of texts and per-tool arguments with sizes."""

    def call(c: Column) -> Column:
        content = F.coalesce(_argument(c, "content"), F.lit(""))
        write, bash = c["name"] == "write_file", c["name"] == "bash"
        known = write | bash | (c["name"] == "read_file")
        return F.struct(
            c["name"].alias("name"),
            F.when(write | (c["name"] == "read_file"), _argument(c, "path")).alias("path"),
            F.when(write, F.length(content)).alias("content_bytes"),
            F.when(write, head(content, arg_chars)).alias("content_head"),
            F.when(bash, head(F.coalesce(_argument(c, "command"), F.lit("")), arg_chars)).alias("command"),
            F.when(~known, head(c["arguments"], arg_chars)).alias("arguments_head"),
        )

    steps = F.transform(
        "steps",
        lambda s: F.struct(
            s["step"].alias("step"),
            s["gen_s"].alias("gen_s"),
            head(F.coalesce(s["assistant_content"], F.lit("")), content_chars).alias("assistant_content_head"),
            F.transform(s["tool_calls"], call).alias("tool_calls"),
            s["tool_results"].alias("tool_results"),
        ),
    )
    return traces.select(
        "task_id", "category", "status", "final_passed", "n_steps",
        F.coalesce(F.size("saved_images"), F.lit(0)).alias("saved_images_count"), steps.alias("steps"),
    )


def _yes_no(c: Column) -> Column:
    return F.when(c, "True").when(~c, "False").otherwise("None")


def _quoted(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("'"), c, F.lit("'")), F.lit("None"))


def judge_input(traces: DataFrame, tasks: DataFrame) -> DataFrame:
    """The text a judge reads: task, requirements, then each step with
    what was said, tools called and results, all whole."""
    t = traces.join(tasks.select("task_id", "description", "requirements"), "task_id")
    nl = "\n"

    def call(c: Column) -> Column:
        write = F.concat(
            F.lit("  write_file path="), _quoted(_argument(c, "path")), F.lit(" bytes="),
            F.coalesce(F.length(_argument(c, "content")), F.lit(0)).cast("string"),
        )
        bash = F.concat(F.lit("  bash "), _quoted(F.coalesce(_argument(c, "command"), F.lit(""))))
        read = F.concat(F.lit("  read_file path="), _quoted(_argument(c, "path")))
        other = F.concat(F.lit("  "), c["name"], F.lit(" "), c["arguments"])
        return (
            F.when(c["name"] == "write_file", write).when(c["name"] == "bash", bash)
            .when(c["name"] == "read_file", read).otherwise(other)
        )

    def result(r: Column) -> Column:
        return F.concat(
            F.lit("TOOL_RESULT: ok="), _yes_no(r["ok"]), F.lit(" kind="), F.coalesce(r["kind"], F.lit("None")),
            F.lit(" -> "), F.coalesce(r["summary"], F.lit("")),
        )

    none = F.array().cast("array<string>")

    def step(s: Column) -> Column:
        said = F.array(
            F.concat(F.lit("--- STEP "), s["step"].cast("string"), F.lit(" ---")),
            F.concat(F.lit("AGENT_SAID:\n"), F.coalesce(s["assistant_content"], F.lit(""))),
        )
        calls = F.when(
            F.size(s["tool_calls"]) > 0,
            F.array(F.concat(F.lit("TOOL_CALLS:\n"), F.array_join(F.transform(s["tool_calls"], call), nl))),
        ).otherwise(none)
        results = F.coalesce(F.transform(s["tool_results"], result), none)
        return F.concat(said, calls, results, F.array(F.lit("")))

    reqs = F.when(
        F.size("requirements") > 0,
        F.array(
            F.concat(
                F.lit("REQUIREMENTS:\n"),
                F.array_join(F.transform("requirements", lambda r: F.concat(F.lit("- "), r)), nl),
            )
        ),
    ).otherwise(none)
    top = F.array(
        F.concat(F.lit("CATEGORY: "), F.col("category")),
        F.concat(F.lit("TASK_ID: "), F.col("task_id").cast("string")),
        F.concat(F.lit("SPEC:\n"), F.col("description")),
    )
    end = F.array(
        F.concat(
            F.lit("FINAL_STATUS: "), F.coalesce("status", F.lit("None")), F.lit(" final_passed="),
            _yes_no(F.col("final_passed")), F.lit(" n_steps="), F.col("n_steps").cast("string"),
        )
    )
    text = F.array_join(F.concat(top, reqs, F.array(F.lit("")), F.flatten(F.transform("steps", step)), end), nl)
    return t.select("task_id", "category", text.alias("judge_input"))


def recovery_report(before: DataFrame, after: DataFrame, blocks: DataFrame) -> DataFrame:
    """Sample rates before and after lenient recovery, the recovered blocks and
    how many samples flipped. Inputs have model, task_id, sample, passed and
    tool_called; ``blocks`` has one row per recovered block."""
    b = before.select("model", "task_id", "sample", F.col("passed").alias("p0"), F.col("tool_called").alias("t0"))
    both = b.join(after, ["model", "task_id", "sample"])
    per_task = both.groupBy("model", "task_id").agg(
        rows().alias("s"),
        F.count_if("p0").alias("p0"), F.count_if("passed").alias("p1"),
        F.count_if("t0").alias("t0"), F.count_if("tool_called").alias("t1"),
        F.count_if(~F.col("p0") & F.col("passed")).alias("flips"),
    )
    total = F.sum("s").cast("double")
    out = per_task.groupBy("model").agg(
        *[(F.sum(c).cast("double") / total).alias(n) for c, n in
          (("p0", "mean_pass_before"), ("p1", "mean_pass_after"), ("t0", "mean_tool_before"), ("t1", "mean_tool_after"))],
        *[rate(F.col(c) > 0).alias(n) for c, n in
          (("p0", "any_pass_before"), ("p1", "any_pass_after"), ("t0", "any_tool_before"), ("t1", "any_tool_after"))],
        F.sum("flips").alias("flipped_samples"),
    )
    found = blocks.groupBy("model").agg(rows().alias("recovered_blocks"), F.count_if("block_passed").alias("recovered_passed"))
    return out.join(found, "model", "left").na.fill(0, ["recovered_blocks", "recovered_passed"])


def leak_rate(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Share of examples the comment scrubber would change."""
    return df.groupBy(*by).agg(rows().alias("n"), rate(scrub(F.col(column)) != F.col(column)).alias("leak_rate"))
