"""Dedup, best-of, running state and per-run decisions.

Most "first / last / best" rules are ``min_by`` / ``max_by`` aggregates, so a
hot key is reduced inside each task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialyst.functions.prng import draw
from trialyst.operators.scan import first_by, running
from trialyst.operators.summary import rate, rows

# fixed values: source order of the corpus merge
SOURCE_ORDER = ["natural", "forced", "forced2", "three"]
# fixed values: stratum by number of attempts
STRATA = {1: "one_revise", 2: "two_revise", 3: "three_revise"}
BEYOND = "more_revise"


def _listing(values: list[str], column: str) -> Column:
    """Position in a fixed list, after the end for unknown values."""
    table = F.array(*[F.lit(v) for v in values])
    at = F.array_position(table, F.col(column))
    return F.when(at > 0, at).otherwise(len(values) + 1)


# --- dedup -------------------------------------------------------------------


def dedupe_runs(df: DataFrame) -> DataFrame:
    """One entry per (category, task): the first by (file, position), but an
    entry with a metric beats every entry without one."""
    return first_by(df, ["category", "task_id"], [F.col("has_metric").desc(), F.col("file"), F.col("pos")])


def dedupe_sources(df: DataFrame, order: list[str] = SOURCE_ORDER) -> DataFrame:
    """One trace per (task, stratum) by source priority; no_revise drops out."""
    usable = df.filter(F.col("stratum").isNotNull() & (F.col("stratum") != "no_revise"))
    return first_by(usable, ["task_id", "stratum"], [_listing(order, "source"), F.col("pos")])


def first_per_task(df: DataFrame, order: list[str], key: str = "task_id") -> DataFrame:
    return first_by(df, [key], [F.col(c).asc() for c in order])


def last_per_task(df: DataFrame, order: list[str], key: str = "task_id") -> DataFrame:
    return first_by(df, [key], [F.col(c).desc() for c in order])


# --- best of -----------------------------------------------------------------


def _candidate_key() -> list[Column]:
    return [
        F.coalesce("all_pass", F.lit(False)).alias("a"),
        F.col("n_pass").alias("p"),
        (-F.col("n_error")).alias("e"),
        (-F.col("n_fail")).alias("f"),
    ]


def rank_candidates(df: DataFrame) -> DataFrame:
    """Best candidate of each iteration, the first on ties."""
    best = F.max_by(
        F.struct("k", "code", "all_pass", "n_pass", "n_fail", "n_error"),
        F.struct(*_candidate_key(), (-F.col("k")).alias("k")),
    )
    return df.groupBy("task_id", "iter").agg(best.alias("b")).select("task_id", "iter", "b.*")


def carry_best(best: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Best so far after each iteration; a later one must be strictly better."""
    key = F.struct(*_candidate_key(), (-F.col("iter")).alias("i"), F.col("code").alias("code"))
    return running(best, ["task_id"], ["iter"], {"b": ("max", key)}, chunk).select(
        "task_id", "iter", (-F.col("b.i")).alias("best_iter"), F.col("b.code").alias("best_code"),
        F.col("b.a").alias("best_all_pass"), F.col("b.p").alias("best_n_pass"),
    )


def keep_best(df: DataFrame, key: str, metric: str, order: str, higher: bool = True) -> DataFrame:
    """The iteration with the best metric, the earliest on ties."""
    m = F.col(metric) if higher else -F.col(metric)
    scored = F.when(F.col(metric).isNotNull(), F.struct(m, -F.col(order)))
    return df.groupBy(key).agg(
        F.max_by(order, scored).alias("best_" + order), F.max_by(metric, scored).alias("best_" + metric)
    )


def best_of_n(df: DataFrame, fallback: str = "first") -> DataFrame:
    """First passing sample's code; without one, the first sample's code, or
    with ``fallback='last'`` the last sample's code if it has any, else blank."""
    ok = F.coalesce("passed", F.lit(False))
    chosen = F.min_by("code", F.when(ok, F.col("idx")))
    if fallback == "first":
        other = F.min_by(F.struct("code"), "idx")["code"]
    else:
        other = F.coalesce(F.max_by(F.struct("code"), "idx")["code"], F.lit(""))
    return df.groupBy("task_id").agg(
        F.max(ok).alias("passed"), rows().alias("n"),
        F.when(F.max(ok), chosen).otherwise(other).alias("code"),
    )


# --- strategy choices on the small cell table --------------------------------


def pareto_best(cells: DataFrame, order: list[str]) -> DataFrame:
    """Per budget the highest rate, then the fewest tokens, then listing order."""
    key = F.struct(F.col("pass_rate"), -F.col("mean_tokens"), -_listing(order, "strategy"))
    return cells.groupBy("budget").agg(
        F.max_by("strategy", key).alias("strategy"), F.max("pass_rate").alias("pass_rate"),
        F.max_by("mean_tokens", key).alias("mean_tokens"),
    )


def saturation(cells: DataFrame, tol: float = 0.05) -> DataFrame:
    """Lowest budget within ``tol`` of the strategy's best rate."""
    w = Window.partitionBy("strategy")
    near = cells.withColumn("top", F.max("pass_rate").over(w)).filter(F.col("pass_rate") >= F.col("top") - tol)
    return near.groupBy("strategy").agg(
        F.min("budget").alias("saturation_budget"), F.first("top").alias("max_rate"),
        F.min_by("pass_rate", "budget").alias("rate_there"),
    )


def strategy_delta(cells: DataFrame, a: str, b: str) -> DataFrame:
    """Strategy b minus strategy a, for budgets where both ran."""
    s = F.col("strategy")
    cols = ["pass_rate", "mean_tokens", "mean_turns"]
    aggs = [F.max(F.when(s == x, F.col(c))).alias(f"{tag}_{c}") for x, tag in ((a, "a"), (b, "b")) for c in cols]
    out = cells.groupBy("budget").agg(*aggs)
    return out.filter(F.col("a_pass_rate").isNotNull() & F.col("b_pass_rate").isNotNull()).withColumn(
        "delta_pp", (F.col("b_pass_rate") - F.col("a_pass_rate")) * 100
    )


def scaling_report(summary: DataFrame, order: list[str], tests: DataFrame) -> DataFrame:
    """Seed summary with the best strategy of each budget flagged and the
    paired test of two strategies alongside. The inputs are small tables of
    strategies x budgets."""
    cells = summary.select("strategy", "budget", F.col("mean_rate").alias("pass_rate"), "mean_tokens")
    best = pareto_best(cells, order).select("budget", "strategy", F.lit(True).alias("is_best"))
    return (
        summary.join(best, ["budget", "strategy"], "left")
        .withColumn("is_best", F.coalesce("is_best", F.lit(False)))
        .join(tests, "budget", "left")
    )


# --- running state -----------------------------------------------------------


def budget_ledger(calls: DataFrame, budgets: DataFrame, chunk: Column, order: list[str]) -> DataFrame:
    """Consumption after each call. ``chunk`` cuts long runs along the order
    (an hour of the timestamp, say), so one huge run spreads over many tasks."""
    spent = running(calls, ["run_id"], order, {"consumed": ("sum", F.col("tokens"))}, chunk)
    used, total = F.col("consumed"), F.col("budget")
    return (
        spent.join(budgets, "run_id")
        .withColumn("remaining", F.greatest(total - used, F.lit(0)))
        .withColumn("exhausted", used >= total)
        .withColumn("overshoot", used > total)
        .withColumn("fraction_used", used.cast("double") / F.nullif(total.cast("double"), F.lit(0.0)))
    )


def stop_reason(
    iters: DataFrame, budgets: DataFrame, max_iterations: int, high_confidence: float = 0.9, chunk: Column | None = None
) -> DataFrame:
    """Why each run stopped. Within an iteration the checks come in this order:
    budget before it starts, after propose, tests passed, budget after execute,
    confident review; otherwise the iteration limit."""
    spent = F.col("tokens_propose") + F.col("tokens_execute") + F.col("tokens_review")
    total_after = running(iters, ["run_id"], ["iteration"], {"after": ("sum", spent)}, chunk)
    x = total_after.withColumn("before", F.col("after") - spent).join(budgets, "run_id")
    proposed = F.col("before") + F.col("tokens_propose")
    executed = proposed + F.col("tokens_execute")
    total = F.col("budget")
    event = (
        F.when(F.col("before") >= total, "budget_exhausted")
        .when(proposed >= total, "budget_exhausted_after_propose")
        .when(F.coalesce("passed", F.lit(False)), "tests_passed")
        .when(executed >= total, "budget_exhausted_after_execute")
        .when(F.col("confidence") >= high_confidence, "high_confidence_pass")
    )
    hit = F.when(F.col("event").isNotNull() & (F.col("iteration") <= max_iterations), F.col("iteration"))
    return x.withColumn("event", event).groupBy("run_id").agg(
        F.coalesce(F.min_by("event", hit), F.lit("max_iterations")).alias("stopped_reason"),
        F.coalesce(F.min(hit), F.least(F.max("iteration"), F.lit(max_iterations))).alias("stopped_at"),
    )


def turns_to_pass(turns: DataFrame, key: str = "run_id", turn: str = "iteration") -> DataFrame:
    """First passing turn, unless a turn without code ended the run before."""
    ok = F.min(F.when(F.coalesce("passed", F.lit(False)) & F.col("has_code"), F.col(turn)))
    dead = F.min(F.when(~F.col("has_code"), F.col(turn)))
    solved = ok.isNotNull() & (dead.isNull() | (ok < dead))
    return turns.groupBy(key).agg(
        solved.alias("solved"), F.when(solved, ok).alias("turns_to_pass")
    )


def with_stratum(traces: DataFrame) -> DataFrame:
    """Stratum from the number of attempts; more attempts than named strata
    are ``more_revise``. Traces whose last attempt failed drop out."""
    n = F.size("attempts")
    named = F.when(n == 0, "no_revise")
    for count, name in STRATA.items():
        named = named.when(n == count, name)
    good_end = (n == 0) | F.element_at("attempts", -1)["exec"]["passed"]
    return traces.filter(good_end).withColumn("stratum", named.otherwise(BEYOND))


def last_artifact(turns: DataFrame, key: str = "run_id", turn: str = "iteration") -> DataFrame:
    """The latest turn that holds an artifact; ``walked_back`` tells that it is
    not the final turn."""
    at = F.when(F.col("artifact").isNotNull() & (F.col("artifact") != ""), F.col(turn))
    return turns.groupBy(key).agg(
        F.max_by("artifact", at).alias("artifact"), F.max(at).alias("artifact_turn"),
        F.coalesce(F.max(turn) > F.max(at), F.lit(True)).alias("walked_back"),
    )


def error_history(iters: DataFrame) -> DataFrame:
    """What each iteration can see of earlier failures: all their whole texts in order (``history``), their
    number, the latest of them (``previous``), and where its own whole error first came up.
    A long run is cut into chunks whose texts are listed apart; the result itself grows with the square of a run's
    failures. ``errors_before`` spells out the texts of chosen iterations only."""
    failed = F.col("error").isNotNull()
    seen = running(
        iters.select("run_id", "iteration", "error"), ["run_id"], ["iteration"],
        {
            "__n": ("sum", failed.cast("bigint")), "previous": ("before", F.when(failed, F.col("iteration"))),
            "history": ("earlier", F.col("error")),
        },
    ).withColumn("__error", F.md5("error"))
    first = iters.filter(failed).groupBy("run_id", F.md5("error").alias("__error")).agg(F.min("iteration").alias("first_seen"))
    return seen.join(first, ["run_id", "__error"], "left").select(
        "run_id", "iteration", "error", "history", (F.col("__n") - failed.cast("bigint")).alias("n_prior"), "previous", "first_seen",
        F.coalesce(F.col("first_seen") < F.col("iteration"), F.lit(False)).alias("recurs"),
    )


def errors_before(iters: DataFrame, asked: DataFrame, chars: int | None = None) -> DataFrame:
    """The errors before each asked (run_id, iteration) in their order, whole
    unless ``chars`` cuts each. One array per asked iteration."""
    shown = F.col("error") if chars is None else F.left("error", F.lit(chars))
    failed = iters.filter(F.col("error").isNotNull()).select("run_id", F.col("iteration").alias("at"), shown.alias("shown"))
    met = asked.select("run_id", "iteration").join(failed, "run_id", "left")
    earlier = F.when(F.col("at") < F.col("iteration"), F.struct("at", "shown"))
    return met.groupBy("run_id", "iteration").agg(F.transform(F.sort_array(F.collect_list(earlier)), lambda x: x["shown"]).alias("history"))


def with_seq_id(df: DataFrame, prefix: str, order: list[str], width: int = 4) -> DataFrame:
    """Display ids p0001, p0002, ... along a total order. Rows are numbered
    inside range partitions; what meets in one place is the count of each
    partition, whose number does not depend on the rows."""
    numbered = running(df, [], order, {"seq": ("count", F.lit(1))})
    digits = F.greatest(F.length(F.col("seq").cast("string")), F.lit(width))
    return numbered.withColumn(
        "pair_id", F.concat(F.lit(prefix), F.lpad(F.col("seq").cast("string"), digits, F.lit("0")))
    )


def union_at_k(judged: DataFrame, by: list[str], seeds: list[int]) -> DataFrame:
    """Share of tasks kept in any of the first k seeds, for each k. Only the
    first kept seed of a task matters, so no running window is needed."""
    place = F.array_position(F.array(*[F.lit(s).cast("bigint") for s in seeds]), F.col("seed").cast("bigint"))
    per_task = judged.groupBy(*by, "task_id").agg(F.min(F.when(F.col("keep"), place)).alias("first_k"))
    ks = F.explode(F.sequence(F.lit(1), F.lit(len(seeds)))).alias("k")
    return (
        per_task.groupBy(*by, "first_k").agg(rows().alias("n")).select(*by, "first_k", "n", ks)
        .groupBy(*by, F.col("k").cast("bigint").alias("k"))
        .agg(
            F.sum("n").alias("n_tasks"),
            F.coalesce(F.sum(F.when(F.col("first_k") <= F.col("k"), F.col("n"))), F.lit(0)).alias("kept"),
        )
        .withColumn("union_rate", F.col("kept").cast("double") / F.col("n_tasks"))
    )


def identical_retry(
    turns: DataFrame, by: list[str], key: str = "run_id", turn: str = "iteration", chunk: Column | None = None
) -> DataFrame:
    """Share of retries that repeat the previous turn's artifact. Hashes, not
    texts, go through the window."""
    digest = turns.withColumn("__h", F.md5(F.trim("artifact")))
    linked = running(digest, [*by, key], [turn], {"__prev": ("prev", F.col("__h"))}, chunk)
    retried = linked.filter(F.col("__h").isNotNull() & F.col("__prev").isNotNull())
    return retried.groupBy(*by).agg(
        rows().alias("n_retries"), rate(F.col("__h") == F.col("__prev")).alias("identical_rate")
    )


def regressed_after_peak(iters: DataFrame, key: str = "run_id", order: str = "iteration", metric: str = "quality") -> DataFrame:
    """Runs whose last iteration scores below their best one."""
    out = iters.groupBy(key).agg(F.max(metric).alias("peak"), F.max_by(metric, order).alias("last"))
    return out.filter(F.col("last") < F.col("peak"))


# --- order, labels, limits ---------------------------------------------------


def order_by_labels(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Rows in a fixed label order, unknown labels last."""
    return df.withColumn("__o", _listing(order, column)).orderBy("__o", column).drop("__o")


def with_label(df: DataFrame, column: str, labels: dict[str, str], out: str = "label") -> DataFrame:
    """Display label of a condition, the id itself when none is known."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return df.withColumn(out, F.coalesce(F.element_at(table, F.col(column)), F.col(column)))


def top_examples(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group; the limit also applies before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def head_tasks(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def rater_order(assignments: DataFrame, seed: str = "order") -> DataFrame:
    """Each rater's own fixed presentation order of the assigned pairs. Hash
    prefixes cut a rater's list into chunks."""
    h = assignments.withColumn("__h", draw(seed, "rater_id", "pair_id"))
    return running(
        h, ["rater_id"], ["__h", "pair_id"], {"position": ("count", F.lit(1))}, F.shiftright("__h", 24)
    ).drop("__h")
