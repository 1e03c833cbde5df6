"""Aggregations over trials, cells, pairs, calls and verdicts.

All of them reduce to built-in aggregates with partial aggregation before the
shuffle. Rates and means stay unrounded. Lists that would grow with the data
(failed ids) are returned as rows, not as one array per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialyst.functions.stats import pass_at_k as pass_at_k_col
from trialyst.functions.stats import safe_ratio, sign_test
from trialyst.operators.scan import order_statistic

STRATEGIES = ["R", "S", "L", "H"]
PHASES = ["propose", "execute", "review"]


def rows() -> Column:
    return F.count(F.lit(1))


def rate(flag) -> Column:
    """Share of rows where the flag is true; null flags count as false."""
    c = F.col(flag) if isinstance(flag, str) else flag
    return F.count_if(c).cast("double") / rows()


# --- trials ------------------------------------------------------------------


def baseline_summary(trials: DataFrame) -> DataFrame:
    return trials.groupBy("baseline").agg(
        rows().alias("n"),
        rate("passed").alias("pass_rate"),
        F.avg("total_tokens").alias("mean_tokens"),
        F.sum("total_tokens").alias("sum_tokens"),
        F.avg("iterations").alias("mean_iterations"),
        F.avg("wall_time_seconds").alias("mean_time"),
        F.sum("wall_time_seconds").alias("sum_time"),
    )


def condition_summary(trials: DataFrame) -> DataFrame:
    """Missing iterations count as 1. Failed ids: see :func:`failed_problems`."""
    return trials.groupBy("baseline").agg(
        rows().alias("n"),
        F.count_if("passed").alias("n_passed"),
        rate("passed").alias("pass_rate"),
        F.avg("total_tokens").alias("mean_tokens"),
        F.avg(F.coalesce("iterations", F.lit(1))).alias("mean_iterations"),
        F.count_if(~F.coalesce("passed", F.lit(False))).alias("n_failed"),
    )


def failed_problems(trials: DataFrame) -> DataFrame:
    """The failed problem ids of each baseline, one per row."""
    return trials.filter(~F.coalesce("passed", F.lit(False))).select("baseline", "problem_id").distinct()


def metrics_summary(trials: DataFrame) -> DataFrame:
    per_problem = trials.groupBy("baseline", "problem_id").agg(
        rows().alias("s"),
        F.sum("total_tokens").alias("t"),
        F.sum("cost").alias("c"),
        F.max(F.coalesce("passed", F.lit(False))).alias("any_pass"),
    )
    return per_problem.groupBy("baseline").agg(
        rows().alias("num_problems"),
        F.sum("s").alias("total_samples"),
        F.sum("t").alias("total_tokens"),
        safe_ratio(F.sum("t"), F.sum("s")).alias("tokens_per_sample"),
        F.sum("c").alias("total_cost"),
        rate("any_pass").alias("any_pass_rate"),
    )


def any_pass_rate(trials: DataFrame) -> DataFrame:
    """A problem counts once, as passed if any of its samples passed."""
    per_problem = trials.groupBy("baseline", "problem_id").agg(
        F.max(F.coalesce("passed", F.lit(False))).alias("any_pass")
    )
    return per_problem.groupBy("baseline").agg(
        rows().alias("num_problems"), rate("any_pass").alias("any_pass_rate")
    )


def pass_at_k(trials: DataFrame, ks: list[int]) -> DataFrame:
    """Unbiased pass@k, averaged over problems with at least k samples; 0 when
    no problem has that many."""
    per_problem = trials.groupBy("baseline", "problem_id").agg(
        rows().alias("n"), F.count_if("passed").alias("c")
    )
    aggs = []
    for k in ks:
        value = pass_at_k_col("n", "c", k)
        aggs.append(F.coalesce(F.avg(value), F.lit(0.0)).alias(f"pass_at_{k}"))
        aggs.append(F.count(value).alias(f"eligible_{k}"))
    return per_problem.groupBy("baseline").agg(*aggs)


def sample_rates(samples: DataFrame, by: list[str]) -> DataFrame:
    """Sample-level means next to task-level any-of rates."""
    tasks = samples.groupBy(*by, "task_id").agg(
        rows().alias("s"),
        F.count_if("passed").alias("p"),
        F.count_if("tool_called").alias("t"),
    )
    return tasks.groupBy(*by).agg(
        rows().alias("n_tasks"),
        safe_ratio(F.sum("p"), F.sum("s")).alias("mean_pass"),
        rate(F.col("p") > 0).alias("any_pass"),
        safe_ratio(F.sum("t"), F.sum("s")).alias("mean_tool"),
        rate(F.col("t") > 0).alias("any_tool"),
    )


def sample_outcome(samples: DataFrame, tool_calls: DataFrame, key: str = "sample_id") -> DataFrame:
    """A sample passes if any tool call passed or its final code passed."""
    called = tool_calls.groupBy(key).agg(
        rows().alias("n_calls"), F.max(F.coalesce("call_passed", F.lit(False))).alias("any_call_passed")
    )
    no = F.lit(False)
    return samples.join(called, key, "left").select(
        *samples.columns,
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        (F.coalesce("n_calls", F.lit(0)) > 0).alias("tool_called"),
        (F.coalesce("any_call_passed", no) | F.coalesce("final_passed", no)).alias("passed"),
    )


def scaling_points(trials: DataFrame) -> DataFrame:
    return trials.groupBy("baseline").agg(
        rate("passed").alias("pass_rate"), F.avg("total_tokens").alias("tokens"), rows().alias("n")
    )


def grouped_pass_rate(df: DataFrame, by: list[str]) -> DataFrame:
    """Model x mode (or checkpoint) pass rate."""
    return df.groupBy(*by).agg(rows().alias("n"), F.count_if("passed").alias("n_passed"), rate("passed").alias("pass_rate"))


def probe_summary(df: DataFrame, score: str) -> DataFrame:
    return df.agg(
        rows().alias("n"), F.avg(score).alias("mean_rubric"), F.count_if(F.col(score) >= 1).alias("n_perfect")
    )


def sampler_summary(records: DataFrame) -> DataFrame:
    return records.agg(
        rows().alias("n"),
        F.count_if("passed").alias("n_passed"),
        rate("passed").alias("pass_rate"),
        F.avg("tokens").alias("mean_tokens"),
        F.avg("iterations").alias("mean_iterations"),
        F.avg("n_candidates").alias("mean_candidates"),
    )


def sampler_failures(records: DataFrame) -> DataFrame:
    """The failed tasks of the sampler summary, one per row, with what they cost."""
    return records.filter(~F.coalesce("passed", F.lit(False))).select("task_id", "tokens", "iterations", "n_candidates")


def pass_matrix(trials: DataFrame, baselines: list[str], order: list[str]) -> DataFrame:
    """Problem x baseline 0/1; the first sample by ``order`` wins, missing is 0."""
    first = F.min_by(F.col("passed").cast("int"), F.struct(*order))
    return (
        trials.groupBy("problem_id")
        .pivot("baseline", baselines)
        .agg(first)
        .select("problem_id", *[F.coalesce(F.col(b), F.lit(0)).cast("bigint").alias(b) for b in baselines])
    )


def token_efficiency(trials: DataFrame, ref: str) -> DataFrame:
    """Pass gain over one baseline and what it costs in tokens. The reference
    values spread over the table of baselines, which has a row for each."""
    per = trials.groupBy("baseline").agg(rate("passed").alias("pass_rate"), F.avg("total_tokens").alias("mean_tokens"))
    everyone = Window.partitionBy(F.lit(0))
    of_ref = lambda c: F.max(F.when(F.col("baseline") == ref, F.col(c))).over(everyone)
    joined = (
        per.withColumn("ref_rate", of_ref("pass_rate")).withColumn("ref_tokens", of_ref("mean_tokens"))
        .filter((F.col("baseline") != ref) & F.col("ref_rate").isNotNull())
    )
    gain = F.col("pass_rate") - F.col("ref_rate")
    extra = F.col("mean_tokens") - F.col("ref_tokens")
    return joined.select(
        "baseline",
        gain.alias("pass_gain"),
        (F.col("mean_tokens") / F.greatest("ref_tokens", F.lit(1.0))).alias("token_ratio"),
        F.when(gain > 0, extra / (gain * 100)).alias("extra_tokens_per_pp"),
    )


# --- cells -------------------------------------------------------------------


def cell_summary(cells: DataFrame) -> DataFrame:
    """Strategy x budget with the upper median of tokens (sorted[n // 2])."""
    by = ["strategy", "budget"]
    main = cells.groupBy(*by).agg(
        F.count_if("passed").alias("passes"),
        rows().alias("total"),
        rate("passed").alias("pass_rate"),
        F.avg("tokens_used").alias("mean_tokens"),
        F.avg(F.coalesce("num_turns", F.lit(1))).alias("mean_turns"),
    )
    median = order_statistic(
        cells, by, "tokens_used", F.floor(F.col("__n") / 2).cast("bigint"), "median_tokens"
    )
    return main.join(median, by, "left")


def seed_cells(cells: DataFrame) -> DataFrame:
    return cells.groupBy("strategy", "budget", "seed").agg(
        rows().alias("n"),
        F.count_if("passed").alias("passes"),
        rate("passed").alias("pass_rate"),
        F.avg("tokens_used").alias("mean_tokens"),
    )


def seed_summary(cells: DataFrame) -> DataFrame:
    """Per-seed rates, then their mean, population SD, range and listing."""
    return seed_cells(cells).groupBy("strategy", "budget").agg(
        rows().alias("n_seeds"),
        F.avg("pass_rate").alias("mean_rate"),
        F.stddev_pop("pass_rate").alias("sd_rate"),
        F.min("pass_rate").alias("min_rate"),
        F.max("pass_rate").alias("max_rate"),
        F.avg("mean_tokens").alias("mean_tokens"),
        F.stddev_pop("mean_tokens").alias("sd_tokens"),
        F.sort_array(F.collect_list(F.struct("seed", "pass_rate", "mean_tokens", "n"))).alias("per_seed"),
    )


def curve_table(cells: DataFrame, strategies: list[str] = STRATEGIES) -> DataFrame:
    """Budget rows, one rate and one token column per strategy."""
    s = F.col("strategy")
    aggs = []
    for name in strategies:
        hit = s == name
        aggs.append(
            safe_ratio(F.count_if(hit & F.col("passed")), F.count_if(hit)).alias(f"{name}_rate")
        )
        aggs.append(F.avg(F.when(hit, F.col("tokens_used"))).alias(f"{name}_tokens"))
    return cells.groupBy("budget").agg(*aggs)


def seed_table(cells: DataFrame, strategy: str, seeds: list[int]) -> DataFrame:
    """Budget rows, one pass-rate column per seed, for one strategy."""
    mine = cells.filter(F.col("strategy") == strategy)
    return mine.groupBy("budget").agg(
        *[
            safe_ratio(
                F.count_if((F.col("seed") == s) & F.col("passed")), F.count_if(F.col("seed") == s)
            ).alias(f"seed_{s}")
            for s in seeds
        ]
    )


def failures(cells: DataFrame, strategy: str) -> DataFrame:
    """The failing tasks of one strategy, one row per (budget, seed, task)."""
    return cells.filter((F.col("strategy") == strategy) & ~F.coalesce("passed", F.lit(False))).select(
        "budget", "seed", "task_id"
    )


# --- pairs -------------------------------------------------------------------


def run_rates(pairs: DataFrame) -> DataFrame:
    """Per run (default run 1): both rates and token means."""
    return pairs.groupBy(F.coalesce("run", F.lit(1)).alias("run")).agg(
        rows().alias("n"),
        rate("ss_meets").alias("ss_rate"),
        rate("rv_meets").alias("rv_rate"),
        F.avg("ss_tokens").alias("ss_tokens"),
        F.avg("rv_tokens").alias("rv_tokens"),
    )


def run_summary(pairs: DataFrame) -> DataFrame:
    """Mean and sample SD of the run-level figures."""
    aggs = [rows().alias("n_runs")]
    for c in ("ss_rate", "rv_rate", "ss_tokens", "rv_tokens"):
        aggs += [F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"sd_{c}")]
    return run_rates(pairs).agg(*aggs)


def defect_reduction(pairs: DataFrame) -> DataFrame:
    """Percentage change of mean defects by modality, 0 when there were none."""
    a, b = F.col("ss_n_defects"), F.col("rv_n_defects")
    both = pairs.filter(a.isNotNull() & b.isNotNull())
    change = (F.avg(b) - F.avg(a)) * 100 / F.nullif(F.avg(a), F.lit(0.0))
    return both.groupBy("modality").agg(
        F.avg(a).alias("ss_mean"),
        F.avg(b).alias("rv_mean"),
        F.coalesce(change, F.lit(0.0)).alias("change_pct"),
        F.count_if(b < a).alias("improved"),
        F.count_if(b > a).alias("regressed"),
        rows().alias("n_pairs"),
    )


def reduction(pairs: DataFrame) -> DataFrame:
    """Reduction from totals: 100 * (1 - sum rv / max(sum ss, 1))."""
    a, b = F.col("ss_n_defects"), F.col("rv_n_defects")
    both = pairs.filter(a.isNotNull() & b.isNotNull())
    total = F.greatest(F.sum(a), F.lit(1)).cast("double")
    return both.groupBy("modality").agg(
        rows().alias("n"),
        ((1 - F.sum(b).cast("double") / total) * 100).alias("reduction_pct"),
        (F.sum(b - a).cast("double") / rows()).alias("mean_delta"),
    )


def lift_report(pairs: DataFrame, ss: str, rv: str, by: list[str], lower_is_better: bool = False) -> DataFrame:
    a, b = F.col(ss), F.col(rv)
    better, worse = (b < a, b > a) if lower_is_better else (b > a, b < a)
    both = pairs.filter(a.isNotNull() & b.isNotNull())
    out = both.groupBy(*by).agg(
        rows().alias("n"),
        F.avg(a).alias("ss_mean"),
        F.avg(b).alias("rv_mean"),
        F.count_if(better).alias("improved"),
        F.count_if(worse).alias("regressed"),
        F.count_if(a == b).alias("tied"),
        F.count_if(a >= 0.999).alias("ss_perfect"),
        F.count_if(a == 0).alias("ss_clean"),
        F.count_if(b == 0).alias("rv_clean"),
    )
    return (
        out.withColumn("lift", F.col("rv_mean") - F.col("ss_mean"))
        .withColumn(
            "headroom",
            F.when(F.col("ss_perfect").cast("double") / F.col("n") > 0.6, "SATURATED").otherwise("has headroom"),
        )
        .withColumn("sign_p", sign_test("improved", "regressed"))
    )


def category_summary(pairs: DataFrame) -> DataFrame:
    """One metric per category, detected over all its rows: pass flags if any
    row has them, else quality, else accuracy. Only rows with that metric
    count. All three variants are computed in the same pass."""
    no = F.lit(False)
    has_pass = F.col("ss_passed").isNotNull() | F.col("rv_passed").isNotNull()
    has_q, has_a = F.col("ss_quality").isNotNull(), F.col("ss_accuracy").isNotNull()
    ss_ok, rv_ok = F.coalesce("ss_passed", no), F.coalesce("rv_passed", no)
    g = pairs.groupBy("category").agg(
        F.count_if(has_pass).alias("np"),
        F.count_if(has_q).alias("nq"),
        F.count_if(has_a).alias("na"),
        F.count_if(has_pass & ss_ok).alias("ssp"),
        F.count_if(has_pass & rv_ok).alias("rvp"),
        F.count_if(has_pass & ~ss_ok & rv_ok).alias("fixed_n"),
        F.avg(F.when(has_q, F.col("ss_quality"))).alias("ssq"),
        F.coalesce(F.avg(F.when(has_q, F.col("rv_quality"))), F.lit(0.0)).alias("rvq"),
        F.avg(F.when(has_a, F.col("ss_accuracy"))).alias("ssa"),
        F.avg(F.when(has_a, F.coalesce("rv_accuracy", "ss_accuracy"))).alias("rva"),
        F.count_if(has_q & F.coalesce("ss_meets", no)).alias("ssm"),
        F.count_if(has_q & F.coalesce("rv_meets", no)).alias("rvm"),
    )

    def pick(p, q, a):
        return F.when(F.col("np") > 0, p).when(F.col("nq") > 0, q).when(F.col("na") > 0, a)

    ratio = lambda c: safe_ratio(F.col(c), F.col("np"))
    return g.select(
        "category",
        pick(F.lit("pass_rate"), F.lit("quality"), F.lit("accuracy")).alias("metric"),
        pick(F.col("np"), F.col("nq"), F.col("na")).alias("n"),
        pick(ratio("ssp"), F.col("ssq"), F.col("ssa")).alias("ss_value"),
        pick(ratio("rvp"), F.col("rvq"), F.col("rva")).alias("rv_value"),
        pick(F.col("fixed_n"), F.lit(None).cast("bigint"), F.lit(None).cast("bigint")).alias("fixed"),
        F.when((F.col("np") == 0) & (F.col("nq") > 0), F.col("ssm")).alias("ss_meets"),
        F.when((F.col("np") == 0) & (F.col("nq") > 0), F.col("rvm")).alias("rv_meets"),
    ).filter(F.col("metric").isNotNull()).withColumn("delta", F.col("rv_value") - F.col("ss_value"))


def category_lift(pairs: DataFrame, by: str = "modality") -> DataFrame:
    """Averages over pairs scored on both sides; null when there are none."""
    both = F.col("ss_quality").isNotNull() & F.col("rv_quality").isNotNull()
    return pairs.groupBy(by).agg(
        F.count_if(both).alias("n"),
        rows().alias("total_tasks"),
        F.avg(F.when(both, F.col("ss_quality"))).alias("avg_ss"),
        F.avg(F.when(both, F.col("rv_quality"))).alias("avg_rv"),
    ).withColumn("delta", F.col("avg_rv") - F.col("avg_ss"))


def type_baseline_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("task_type", "baseline").agg(
        rows().alias("n"),
        F.avg("quality").alias("avg_quality"),
        rate("meets").alias("meets_rate"),
        F.avg("tokens").alias("avg_tokens"),
    )


def regime_summary(df: DataFrame) -> DataFrame:
    per = df.groupBy("feedback_type").agg(
        rows().alias("n"),
        F.count_if("ss_passed").alias("ss_pass"),
        F.count_if("rv_passed").alias("rv_pass"),
        F.avg("rv_iterations").alias("avg_iterations"),
        F.avg("rv_propose_tokens").alias("avg_propose_tokens"),
        F.avg("rv_review_tokens").alias("avg_review_tokens"),
    )
    return (
        per.withColumn("ss_pass_rate", F.col("ss_pass").cast("double") / F.col("n"))
        .withColumn("rv_pass_rate", F.col("rv_pass").cast("double") / F.col("n"))
        .withColumn("delta_pp", (F.col("rv_pass") - F.col("ss_pass")).cast("double") / F.col("n") * 100)
        .withColumn("avg_total_tokens", F.col("avg_propose_tokens") + F.col("avg_review_tokens"))
    )


def transitions(pairs: DataFrame, ss: str, rv: str, by: list[str]) -> DataFrame:
    return with_transition(pairs, ss, rv).groupBy(*by, "transition").agg(rows().alias("n"))


def with_transition(pairs: DataFrame, ss: str, rv: str) -> DataFrame:
    a, b = F.coalesce(ss, F.lit(False)), F.coalesce(rv, F.lit(False))
    return pairs.withColumn(
        "transition",
        F.when(a & b, "both_pass").when(~a & b, "fix").when(a & ~b, "regress").otherwise("both_fail"),
    )


def token_roi(pairs: DataFrame) -> DataFrame:
    """Extra tokens spent per 0.01 of quality gained, by modality."""
    both = pairs.filter(F.col("ss_quality").isNotNull() & F.col("rv_quality").isNotNull())
    per = both.groupBy("modality").agg(
        F.avg("ss_tokens").alias("ss_tokens"),
        F.avg("rv_tokens").alias("rv_tokens"),
        (F.avg("rv_quality") - F.avg("ss_quality")).alias("lift"),
    )
    extra = F.col("rv_tokens") - F.col("ss_tokens")
    return per.withColumn("extra_tokens", extra).withColumn(
        "tokens_per_point", F.when(F.col("lift") > 0, extra / (F.col("lift") * 100))
    )


# --- allocation --------------------------------------------------------------


def allocation_cells(alloc: DataFrame) -> DataFrame:
    """Per allocation: passes, rate, tokens, iterations and the first task's caps."""
    return alloc.groupBy("allocation_label").agg(
        F.count_if("passed").alias("passes"),
        rows().alias("n"),
        rate("passed").alias("pass_rate"),
        F.avg("tokens").alias("mean_tokens"),
        F.avg("iterations").alias("mean_iterations"),
        F.min_by("propose_cap", "pos").alias("propose_cap"),
        F.min_by("review_cap", "pos").alias("review_cap"),
    )


def allocation_spread(cells: DataFrame) -> DataFrame:
    """Best and worst allocation (ties: the smaller label), spread in points."""
    label, r = F.col("allocation_label"), F.col("pass_rate")
    return cells.agg(
        F.min_by(label, F.struct(-r, label)).alias("best"),
        F.min_by(label, F.struct(r, label)).alias("worst"),
        ((F.max(r) - F.min(r)) * 100).alias("spread_pp"),
        (F.avg(r) * 100).alias("mean_pct"),
        (F.stddev_pop(r) * 100).alias("sd_pp"),
    )


# --- candidates, verdicts, claims, tests -------------------------------------


def verification_gap(candidates: DataFrame, by: str = "selector") -> DataFrame:
    """Any-correct rate minus the rate of each selector's choice (best score,
    lowest index on ties). One row per selector; ``candidates`` has a row per
    (selector, task, index). The rows are dealt by task before they are sorted for the choice, so the sort
    does not share a task's memory with whatever made the candidates, and they are sorted once."""
    per = candidates.repartition(by, "task_id").groupBy(by, "task_id").agg(
        F.max(F.coalesce("passed", F.lit(False))).alias("any_ok"),
        F.max_by("passed", F.struct(F.col("score"), -F.col("idx"))).alias("chosen_ok"),
    )
    return per.groupBy(by).agg(
        rows().alias("n_tasks"), rate("any_ok").alias("pass_any"), rate("chosen_ok").alias("choose_rate")
    ).withColumn("gap", F.col("pass_any") - F.col("choose_rate"))


def model_summary(df: DataFrame) -> DataFrame:
    """Mean over seeds of the seed pass rate in percent, with the seed count."""
    per = df.groupBy("model", "seed").agg(rate("passed").alias("r"))
    return per.groupBy("model").agg(
        rows().alias("n_seeds"),
        (F.avg("r") * 100).alias("mean_pct"),
        F.array_join(F.array_sort(F.collect_list(F.col("seed").cast("string"))), ",").alias("seeds"),
    )


def budget_breakdown(calls: DataFrame, budgets: DataFrame) -> DataFrame:
    """Consumption per run and phase; a phase without calls shows 0."""
    tok, ph = F.col("tokens"), F.col("phase")
    per = calls.groupBy("run_id").agg(
        F.sum("tokens").alias("used"),
        *[F.sum(F.when(ph == p, tok).otherwise(0)).alias(f"{p}_tokens") for p in PHASES],
        *[F.count_if(ph == p).alias(f"{p}_calls") for p in PHASES],
    )
    zero = F.lit(0)
    used = F.coalesce("used", zero)
    return budgets.join(per, "run_id", "left").select(
        "run_id",
        F.col("budget").alias("total_budget"),
        used.alias("total_consumed"),
        F.greatest(F.col("budget") - used, zero).alias("remaining"),
        F.coalesce(safe_ratio(used, "budget"), F.lit(0.0)).alias("fraction_used"),
        *[F.coalesce(f"{p}_{k}", zero).alias(f"{p}_{k}") for p in PHASES for k in ("tokens", "calls")],
    )


def claim_accuracy(claims: DataFrame, first: int | None = None) -> DataFrame:
    """Verdict counts of all claims of a report, in one pass; with ``first``
    only of so many, and ``n_left_out`` counts the others."""
    if first is not None:
        w = Window.partitionBy("report_id").orderBy("pos")
        numbered = claims.withColumn("__rn", F.row_number().over(w))
        left_out = numbered.groupBy("report_id").agg(F.count_if(F.col("__rn") > first).alias("n_left_out"))
        return claim_accuracy(numbered.filter(F.col("__rn") <= first)).join(left_out, "report_id")
    v = F.col("verdict")
    acc = F.count_if(v == "supported").cast("double") / rows()
    return claims.groupBy("report_id").agg(
        rows().alias("total_claims"),
        F.count_if(v == "supported").alias("supported"),
        F.count_if(v == "contradicted").alias("contradicted"),
        F.count_if(v == "unverifiable").alias("unverifiable"),
        acc.alias("accuracy"),
        (acc >= 0.8).alias("passed"),
        F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"),
    )


def rubric_score(aligned: DataFrame) -> DataFrame:
    """Share of requirements met and the 1-based numbers of those violated."""
    return aligned.groupBy("artifact_id").agg(
        F.count_if("satisfied").alias("n_met"),
        rows().alias("n_total"),
        rate("satisfied").alias("score"),
        F.array_sort(F.collect_list(F.when(~F.col("satisfied"), F.col("index")))).alias("violated"),
    )


def partial_score(events: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Assert outcomes per candidate. A failed setup statement is an error but
    not part of the total."""
    is_assert, ok = F.col("kind") == "assert", F.coalesce("ok", F.lit(False))
    failed = is_assert & ~ok & F.coalesce(F.col("err").startswith("AssertionError"), F.lit(False))
    broken = is_assert & ~ok & ~F.coalesce(F.col("err").startswith("AssertionError"), F.lit(False))
    setup = (F.col("kind") == "setup") & ~ok
    out = events.groupBy(key).agg(
        F.count_if(is_assert & ok).alias("n_pass"),
        F.count_if(failed).alias("n_fail"),
        F.count_if(broken | setup).alias("n_error"),
        F.count_if(is_assert).alias("n_total"),
        F.min_by("err", F.when(~ok, F.col("pos"))).alias("first_error"),
    )
    return out.withColumn("all_pass", (F.col("n_pass") == F.col("n_total")) & (F.col("n_total") > 0))


# --- corpora and judges ------------------------------------------------------


def corpus_counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(rows().alias("n"))


def keep_rates(traces: DataFrame) -> DataFrame:
    """Judge keeps overall, by category and by status in one pass."""
    g = traces.groupingSets([[], [F.col("category")], [F.col("status")]], "category", "status")
    level = (
        F.when(F.grouping_id() == 3, "overall")
        .when(F.grouping_id() == 1, "category")
        .otherwise("status")
    )
    return g.agg(
        level.alias("level"),
        rows().alias("n"),
        F.count_if("keep").alias("kept"),
        rate("keep").alias("keep_rate"),
    )


def capability_ratio(judged: DataFrame, ref_policy: str) -> DataFrame:
    """Kept-count ratio to a reference policy on the tasks both attempted:
    ``mean_ratio`` by sample share, ``union_ratio`` by tasks kept at least once."""
    per_task = judged.groupBy("policy", "task_id").agg(rows().alias("s"), F.count_if("keep").alias("k"))
    ref = per_task.filter(F.col("policy") == ref_policy).select(
        "task_id", F.col("s").alias("ref_s"), F.col("k").alias("ref_k")
    )
    same = per_task.filter(F.col("policy") != ref_policy).join(ref, "task_id")
    out = same.groupBy("policy").agg(
        rows().alias("n_tasks"),
        safe_ratio(F.sum("k"), F.sum("s")).alias("mean_rate"),
        safe_ratio(F.sum("ref_k"), F.sum("ref_s")).alias("ref_mean_rate"),
        F.count_if(F.col("k") > 0).alias("union_kept"),
        F.count_if(F.col("ref_k") > 0).alias("ref_union_kept"),
    )
    return out.withColumn("mean_ratio", safe_ratio("mean_rate", "ref_mean_rate")).withColumn(
        "union_ratio", safe_ratio("union_kept", "ref_union_kept")
    )


def status_breakdown(traces: DataFrame, step_cap: int) -> DataFrame:
    """How traces ended, by category: in their first step, mid-way or at the cap."""
    n = F.col("n_steps")
    bucket = F.when(n <= 1, "single_step").when(n >= step_cap, "step_cap").otherwise("midway")
    return (
        traces.withColumn("bucket", bucket)
        .groupBy("category", "status")
        .agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in ("single_step", "midway", "step_cap")])
    )


def dialect_share(corpus: DataFrame, pattern: str = r"\[(GENERATE|EXECUTE|REVIEW|SUBMIT)\]") -> DataFrame:
    """Share of examples per task type whose messages use protocol markers."""
    used = F.exists("messages", lambda m: F.coalesce(m["content"].rlike(pattern), F.lit(False)))
    return corpus.groupBy("task_type").agg(rows().alias("n"), rate(used).alias("share"))
