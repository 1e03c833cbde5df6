"""Registered aggregation queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialyst.operators import summary as S
from trialyst.plans import fixtures as fx
from trialyst.plans.registry import query

BASELINES = ["A", "N", "R"]


@query(
    "baseline_summary",
    f"""WITH {fx.TRIALS} SELECT baseline, count(*) AS n,
    CAST(count(*) FILTER (WHERE passed) AS DOUBLE) / count(*) AS pass_rate,
    avg(total_tokens) AS mean_tokens, CAST(sum(total_tokens) AS BIGINT) AS sum_tokens,
    avg(iterations) AS mean_iterations, avg(wall_time_seconds) AS mean_time,
    sum(wall_time_seconds) AS sum_time FROM trials GROUP BY baseline""",
)
def _(spark, sf):
    return S.baseline_summary(fx.trials(spark, sf))


@query(
    "condition_summary",
    f"""WITH {fx.TRIALS}, t AS (SELECT *, CASE WHEN problem_id % 5 = 0 THEN NULL ELSE iterations END AS it FROM trials)
    SELECT baseline, count(*) AS n, count(*) FILTER (WHERE passed) AS n_passed,
    CAST(count(*) FILTER (WHERE passed) AS DOUBLE) / count(*) AS pass_rate,
    avg(total_tokens) AS mean_tokens, avg(coalesce(it, 1)) AS mean_iterations,
    count(*) FILTER (WHERE NOT passed) AS n_failed FROM t GROUP BY baseline""",
)
def _(spark, sf):
    t = fx.trials(spark, sf)
    missing = F.when(F.col("problem_id") % 5 != 0, F.col("iterations"))
    return S.condition_summary(t.withColumn("iterations", missing))


@query(
    "failed_problems",
    f"WITH {fx.TRIALS} SELECT DISTINCT baseline, problem_id FROM trials WHERE NOT passed",
)
def _(spark, sf):
    return S.failed_problems(fx.trials(spark, sf))


@query(
    "metrics_summary",
    f"""WITH {fx.TRIALS}, p AS (SELECT baseline, problem_id, count(*) AS s, sum(total_tokens) AS t,
      sum(cost) AS c, bool_or(passed) AS ok FROM trials GROUP BY 1, 2)
    SELECT baseline, count(*) AS num_problems, CAST(sum(s) AS BIGINT) AS total_samples,
    CAST(sum(t) AS BIGINT) AS total_tokens, CAST(sum(t) AS DOUBLE) / CAST(sum(s) AS DOUBLE) AS tokens_per_sample,
    sum(c) AS total_cost, CAST(count(*) FILTER (WHERE ok) AS DOUBLE) / count(*) AS any_pass_rate
    FROM p GROUP BY baseline""",
)
def _(spark, sf):
    return S.metrics_summary(fx.trials(spark, sf))


@query(
    "any_pass_rate",
    f"""WITH {fx.TRIALS}, p AS (SELECT baseline, problem_id, bool_or(passed) AS ok FROM trials GROUP BY 1, 2)
    SELECT baseline, count(*) AS num_problems,
    CAST(count(*) FILTER (WHERE ok) AS DOUBLE) / count(*) AS any_pass_rate FROM p GROUP BY baseline""",
)
def _(spark, sf):
    return S.any_pass_rate(fx.trials(spark, sf))


def _pass_at(k: int) -> str:
    # 1 - C(n-c,k)/C(n,k) through log-gamma
    return (
        f"CASE WHEN n >= {k} THEN CASE WHEN n - c < {k} THEN 1.0 ELSE "
        f"1 - exp(lgamma(n - c + 1) - lgamma(n - c - {k} + 1) - lgamma(n + 1) + lgamma(n - {k} + 1)) END END"
    )


PASS_KS = [1, 2, 5, 10]
_PASS_SQL = ", ".join(
    f"round(coalesce(avg({_pass_at(k)}), 0.0), 9) AS pass_at_{k}, count({_pass_at(k)}) AS eligible_{k}"
    for k in PASS_KS
)


@query(
    "pass_at_k",
    f"""WITH {fx.TRIALS}, p AS (SELECT baseline, problem_id, count(*) AS n,
      count(*) FILTER (WHERE passed) AS c FROM trials GROUP BY 1, 2)
    SELECT baseline, {_PASS_SQL} FROM p GROUP BY baseline""",
)
def _(spark, sf):
    out = S.pass_at_k(fx.trials(spark, sf), PASS_KS)
    return out.select(
        "baseline",
        *[F.round(f"pass_at_{k}", 9).alias(f"pass_at_{k}") for k in PASS_KS],
        *[f"eligible_{k}" for k in PASS_KS],
    )


SAMPLES = f"""{fx.TRIALS}, samples AS (SELECT baseline AS model, problem_id AS task_id,
      passed, iterations > 3 AS tool_called FROM trials)"""
_RATES = """count(*) AS n_tasks, CAST(sum(p) AS DOUBLE) / CAST(sum(s) AS DOUBLE) AS mean_pass,
      CAST(count(*) FILTER (WHERE p > 0) AS DOUBLE) / count(*) AS any_pass,
      CAST(sum(t) AS DOUBLE) / CAST(sum(s) AS DOUBLE) AS mean_tool,
      CAST(count(*) FILTER (WHERE t > 0) AS DOUBLE) / count(*) AS any_tool"""


def _samples(spark, sf):
    return fx.trials(spark, sf).select(
        F.col("baseline").alias("model"),
        F.col("problem_id").alias("task_id"),
        "passed",
        (F.col("iterations") > 3).alias("tool_called"),
        "iterations",
    )


@query(
    "sample_rates",
    f"""WITH {SAMPLES}, g AS (SELECT model, task_id, count(*) AS s, count(*) FILTER (WHERE passed) AS p,
      count(*) FILTER (WHERE tool_called) AS t FROM samples GROUP BY 1, 2)
    SELECT model, {_RATES} FROM g GROUP BY model""",
)
def _(spark, sf):
    return S.sample_rates(_samples(spark, sf), ["model"])


@query(
    "sample_rates_by_budget",
    f"""WITH {fx.CELLS}, g AS (SELECT strategy, budget, task_id, count(*) AS s, count(*) FILTER (WHERE passed) AS p,
      count(*) FILTER (WHERE num_turns > 1) AS t FROM cells GROUP BY 1, 2, 3)
    SELECT strategy, budget, {_RATES} FROM g GROUP BY 1, 2""",
)
def _(spark, sf):
    c = fx.cells(spark, sf).withColumn("tool_called", F.col("num_turns") > 1)
    return S.sample_rates(c, ["strategy", "budget"])


@query(
    "sample_outcome",
    """WITH calls AS (SELECT l_orderkey AS sample_id, count(*) AS n_calls, bool_or(l_quantity > 45) AS ok
      FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
    SELECT o_orderkey AS sample_id, o_orderstatus = 'F' AS final_passed, coalesce(n_calls, 0) AS n_calls,
    coalesce(n_calls, 0) > 0 AS tool_called, coalesce(ok, false) OR o_orderstatus = 'F' AS passed
    FROM orders LEFT JOIN calls ON o_orderkey = sample_id""",
)
def _(spark, sf):
    samples = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("sample_id"), (F.col("o_orderstatus") == "F").alias("final_passed")
    )
    calls = (
        fx.table(spark, sf, "lineitem")
        .filter(F.col("l_returnflag") == "A")
        .select(F.col("l_orderkey").alias("sample_id"), (F.col("l_quantity") > 45).alias("call_passed"))
    )
    return S.sample_outcome(samples, calls)


@query(
    "cell_summary",
    f"""WITH {fx.CELLS} SELECT strategy, budget, count(*) FILTER (WHERE passed) AS passes, count(*) AS total,
    CAST(count(*) FILTER (WHERE passed) AS DOUBLE) / count(*) AS pass_rate, avg(tokens_used) AS mean_tokens,
    avg(num_turns) AS mean_turns,
    (list_sort(list(tokens_used)))[CAST(count(*) // 2 + 1 AS INT)] AS median_tokens FROM cells GROUP BY 1, 2""",
)
def _(spark, sf):
    return S.cell_summary(fx.cells(spark, sf))


SEED_CELLS = f"""{fx.CELLS}, per AS (SELECT strategy, budget, seed, count(*) AS n,
      CAST(count(*) FILTER (WHERE passed) AS DOUBLE) / count(*) AS pass_rate, avg(tokens_used) AS mean_tokens
      FROM cells GROUP BY 1, 2, 3)"""


@query(
    "seed_summary",
    f"""WITH {SEED_CELLS} SELECT strategy, budget, count(*) AS n_seeds, round(avg(pass_rate), 9) AS mean_rate,
    round(stddev_pop(pass_rate), 9) AS sd_rate, min(pass_rate) AS min_rate, max(pass_rate) AS max_rate,
    round(avg(mean_tokens), 6) AS mean_tokens, round(stddev_pop(mean_tokens), 6) AS sd_tokens,
    string_agg(CAST(seed AS VARCHAR), ',' ORDER BY seed) AS seeds FROM per GROUP BY 1, 2""",
)
def _(spark, sf):
    return S.seed_summary(fx.cells(spark, sf)).select(
        "strategy", "budget", "n_seeds", "min_rate", "max_rate",
        F.round("mean_rate", 9).alias("mean_rate"),
        F.round("sd_rate", 9).alias("sd_rate"),
        F.round("mean_tokens", 6).alias("mean_tokens"),
        F.round("sd_tokens", 6).alias("sd_tokens"),
        F.array_join(F.transform("per_seed", lambda s: s["seed"].cast("string")), ",").alias("seeds"),
    )


def _curve(name: str) -> str:
    hit = f"strategy = '{name}'"
    return (
        f"CAST(count(*) FILTER (WHERE {hit} AND passed) AS DOUBLE) / count(*) FILTER (WHERE {hit}) AS {name}_rate, "
        f"avg(tokens_used) FILTER (WHERE {hit}) AS {name}_tokens"
    )


@query(
    "curve_table",
    f"WITH {fx.CELLS} SELECT budget, {', '.join(_curve(s) for s in fx.STRATEGIES)} FROM cells GROUP BY 1",
)
def _(spark, sf):
    return S.curve_table(fx.cells(spark, sf))


@query(
    "seed_table",
    f"""WITH {fx.CELLS} SELECT budget, {', '.join(
        f"CAST(count(*) FILTER (WHERE seed = {s} AND passed) AS DOUBLE) / count(*) FILTER (WHERE seed = {s}) AS seed_{s}"
        for s in (1, 2, 3))}
    FROM cells WHERE strategy = 'H' GROUP BY 1""",
)
def _(spark, sf):
    return S.seed_table(fx.cells(spark, sf), "H", [1, 2, 3])


@query(
    "failures",
    f"WITH {fx.CELLS} SELECT budget, seed, task_id FROM cells WHERE strategy = 'H' AND NOT passed",
)
def _(spark, sf):
    return S.failures(fx.cells(spark, sf), "H")


RUN_RATES = f"""{fx.PAIRS}, per AS (SELECT coalesce(run, 1) AS run, count(*) AS n,
      CAST(count(*) FILTER (WHERE ss_meets) AS DOUBLE) / count(*) AS ss_rate,
      CAST(count(*) FILTER (WHERE rv_meets) AS DOUBLE) / count(*) AS rv_rate,
      avg(ss_tokens) AS ss_tokens, avg(rv_tokens) AS rv_tokens FROM pairs GROUP BY 1)"""


@query("run_rates", f"WITH {RUN_RATES} SELECT * FROM per")
def _(spark, sf):
    return S.run_rates(fx.pairs(spark, sf))


@query(
    "run_summary",
    f"""WITH {RUN_RATES} SELECT count(*) AS n_runs, {', '.join(
        f"round(avg({c}), 6) AS mean_{c}, round(stddev_samp({c}), 6) AS sd_{c}"
        for c in ("ss_rate", "rv_rate", "ss_tokens", "rv_tokens"))} FROM per""",
)
def _(spark, sf):
    out = S.run_summary(fx.pairs(spark, sf))
    return out.select("n_runs", *[F.round(c, 6).alias(c) for c in out.columns if c != "n_runs"])


@query(
    "defect_reduction",
    f"""WITH {fx.PAIRS} SELECT modality, avg(ss_n_defects) AS ss_mean, avg(rv_n_defects) AS rv_mean,
    coalesce((avg(rv_n_defects) - avg(ss_n_defects)) * 100 / nullif(avg(ss_n_defects), 0), 0) AS change_pct,
    count(*) FILTER (WHERE rv_n_defects < ss_n_defects) AS improved,
    count(*) FILTER (WHERE rv_n_defects > ss_n_defects) AS regressed, count(*) AS n_pairs
    FROM pairs GROUP BY 1""",
)
def _(spark, sf):
    return S.defect_reduction(fx.pairs(spark, sf))


@query(
    "total_reduction",
    f"""WITH {fx.PAIRS} SELECT modality, count(*) AS n,
    (1 - CAST(sum(rv_n_defects) AS DOUBLE) / CAST(greatest(sum(ss_n_defects), 1) AS DOUBLE)) * 100 AS reduction_pct,
    CAST(sum(rv_n_defects - ss_n_defects) AS DOUBLE) / count(*) AS mean_delta FROM pairs GROUP BY 1""",
)
def _(spark, sf):
    return S.reduction(fx.pairs(spark, sf))


def sign_sql(w: str, l: str) -> str:
    """Sign test by summing the binomial tail term by term."""
    n = f"({w} + {l})"
    term = f"exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2))"
    return (
        f"CASE WHEN {n} = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform("
        f"generate_series(0, least({w}, {l})), lambda i: {term}))) END"
    )


@query(
    "lift_report_quality",
    f"""WITH {fx.PAIRS}, g AS (SELECT modality, count(*) AS n, avg(ss_quality) AS ss_mean, avg(rv_quality) AS rv_mean,
      count(*) FILTER (WHERE rv_quality > ss_quality) AS improved,
      count(*) FILTER (WHERE rv_quality < ss_quality) AS regressed,
      count(*) FILTER (WHERE rv_quality = ss_quality) AS tied,
      count(*) FILTER (WHERE ss_quality >= 0.999) AS ss_perfect,
      count(*) FILTER (WHERE ss_quality = 0) AS ss_clean, count(*) FILTER (WHERE rv_quality = 0) AS rv_clean
      FROM pairs WHERE ss_quality IS NOT NULL AND rv_quality IS NOT NULL GROUP BY 1)
    SELECT modality, n, round(ss_mean, 9) AS ss_mean, round(rv_mean, 9) AS rv_mean, improved, regressed, tied,
    ss_perfect, ss_clean, rv_clean, round(rv_mean - ss_mean, 9) AS lift,
    CASE WHEN CAST(ss_perfect AS DOUBLE) / n > 0.6 THEN 'SATURATED' ELSE 'has headroom' END AS headroom,
    round({sign_sql('improved', 'regressed')}, 9) AS sign_p FROM g""",
)
def _(spark, sf):
    out = S.lift_report(fx.pairs(spark, sf), "ss_quality", "rv_quality", ["modality"])
    for c in ("ss_mean", "rv_mean", "lift", "sign_p"):
        out = out.withColumn(c, F.round(c, 9))
    return out


@query(
    "lift_report_defects",
    f"""WITH {fx.PAIRS}, g AS (SELECT modality, run, count(*) AS n, avg(ss_n_defects) AS ss_mean,
      avg(rv_n_defects) AS rv_mean, count(*) FILTER (WHERE rv_n_defects < ss_n_defects) AS improved,
      count(*) FILTER (WHERE rv_n_defects > ss_n_defects) AS regressed,
      count(*) FILTER (WHERE rv_n_defects = ss_n_defects) AS tied,
      count(*) FILTER (WHERE ss_n_defects = 0) AS ss_clean, count(*) FILTER (WHERE rv_n_defects = 0) AS rv_clean
      FROM pairs GROUP BY 1, 2)
    SELECT modality, run, n, ss_mean, rv_mean, improved, regressed, tied, ss_clean, rv_clean,
    rv_mean - ss_mean AS lift, round({sign_sql('improved', 'regressed')}, 9) AS sign_p FROM g""",
)
def _(spark, sf):
    out = S.lift_report(fx.pairs(spark, sf), "ss_n_defects", "rv_n_defects", ["modality", "run"], lower_is_better=True)
    return out.drop("ss_perfect", "headroom").withColumn("sign_p", F.round("sign_p", 9))


@query(
    "category_summary",
    f"""WITH {fx.PAIRS}, m AS (SELECT modality AS category,
      CASE WHEN modality = '1-URGENT' AND task_id % 2 = 0 THEN ss_meets END AS ss_passed,
      CASE WHEN modality = '1-URGENT' AND task_id % 2 = 0 THEN rv_meets END AS rv_passed,
      CASE WHEN modality <> '5-LOW' THEN ss_n_defects END AS ss_quality,
      CASE WHEN task_id % 7 <> 0 THEN rv_n_defects END AS rv_quality, ss_meets, rv_meets,
      ss_n_defects AS ss_accuracy, CASE WHEN task_id % 5 <> 0 THEN rv_n_defects END AS rv_accuracy FROM pairs),
    g AS (SELECT category, count(*) FILTER (WHERE ss_passed IS NOT NULL OR rv_passed IS NOT NULL) AS np,
      count(ss_quality) AS nq, count(ss_accuracy) AS na, count(*) FILTER (WHERE ss_passed) AS ssp,
      count(*) FILTER (WHERE rv_passed) AS rvp,
      count(*) FILTER (WHERE NOT coalesce(ss_passed, false) AND rv_passed) AS fx,
      avg(ss_quality) AS ssq, avg(rv_quality) FILTER (WHERE ss_quality IS NOT NULL) AS rvq,
      avg(ss_accuracy) AS ssa, avg(coalesce(rv_accuracy, ss_accuracy)) AS rva,
      count(*) FILTER (WHERE ss_quality IS NOT NULL AND ss_meets) AS ssm,
      count(*) FILTER (WHERE ss_quality IS NOT NULL AND rv_meets) AS rvm FROM m GROUP BY 1),
    v AS (SELECT category, CASE WHEN np > 0 THEN 'pass_rate' WHEN nq > 0 THEN 'quality' ELSE 'accuracy' END AS metric,
      CASE WHEN np > 0 THEN np WHEN nq > 0 THEN nq ELSE na END AS n,
      CASE WHEN np > 0 THEN CAST(ssp AS DOUBLE) / np WHEN nq > 0 THEN ssq ELSE ssa END AS ss_value,
      CASE WHEN np > 0 THEN CAST(rvp AS DOUBLE) / np WHEN nq > 0 THEN coalesce(rvq, 0) ELSE rva END AS rv_value,
      CASE WHEN np > 0 THEN fx END AS fixed, CASE WHEN np = 0 AND nq > 0 THEN ssm END AS ss_meets,
      CASE WHEN np = 0 AND nq > 0 THEN rvm END AS rv_meets FROM g)
    SELECT *, rv_value - ss_value AS delta FROM v""",
)
def _(spark, sf):
    p, m, t = fx.pairs(spark, sf), F.col("modality"), F.col("task_id")
    flagged = (m == "1-URGENT") & (t % 2 == 0)
    return S.category_summary(
        p.select(
            m.alias("category"),
            F.when(flagged, F.col("ss_meets")).alias("ss_passed"),
            F.when(flagged, F.col("rv_meets")).alias("rv_passed"),
            F.when(m != "5-LOW", F.col("ss_n_defects")).cast("double").alias("ss_quality"),
            F.when(t % 7 != 0, F.col("rv_n_defects")).cast("double").alias("rv_quality"),
            "ss_meets",
            "rv_meets",
            F.col("ss_n_defects").cast("double").alias("ss_accuracy"),
            F.when(t % 5 != 0, F.col("rv_n_defects")).cast("double").alias("rv_accuracy"),
        )
    )


@query(
    "category_lift",
    f"""WITH {fx.PAIRS}, g AS (SELECT modality, count(*) AS total_tasks,
      count(*) FILTER (WHERE ss_quality IS NOT NULL AND rv_quality IS NOT NULL) AS n,
      avg(ss_quality) FILTER (WHERE rv_quality IS NOT NULL) AS a,
      avg(rv_quality) FILTER (WHERE ss_quality IS NOT NULL) AS b FROM pairs GROUP BY 1)
    SELECT modality, n, total_tasks, round(a, 9) AS avg_ss, round(b, 9) AS avg_rv, round(b - a, 9) AS delta FROM g""",
)
def _(spark, sf):
    out = S.category_lift(fx.pairs(spark, sf))
    return out.select("modality", "n", "total_tasks", *[F.round(c, 9).alias(c) for c in ("avg_ss", "avg_rv", "delta")])


@query(
    "type_baseline_summary",
    f"""WITH {fx.PAIRS} SELECT modality AS task_type, run AS baseline, count(*) AS n,
    avg(rv_n_defects) AS avg_quality, CAST(count(*) FILTER (WHERE rv_meets) AS DOUBLE) / count(*) AS meets_rate,
    avg(rv_tokens) AS avg_tokens FROM pairs GROUP BY 1, 2""",
)
def _(spark, sf):
    return S.type_baseline_summary(
        fx.pairs(spark, sf).select(
            F.col("modality").alias("task_type"), F.col("run").alias("baseline"),
            F.col("rv_n_defects").alias("quality"), F.col("rv_meets").alias("meets"),
            F.col("rv_tokens").alias("tokens"),
        )
    )


@query(
    "regime_summary",
    f"""WITH {fx.PAIRS}, g AS (SELECT modality AS feedback_type, count(*) AS n, count(*) FILTER (WHERE ss_meets) AS ss_pass,
      count(*) FILTER (WHERE rv_meets) AS rv_pass, avg(rv_iters) AS avg_iterations,
      avg(ss_tokens) AS avg_propose_tokens, avg(rv_tokens) AS avg_review_tokens FROM pairs GROUP BY 1)
    SELECT *, CAST(ss_pass AS DOUBLE) / n AS ss_pass_rate, CAST(rv_pass AS DOUBLE) / n AS rv_pass_rate,
    CAST(rv_pass - ss_pass AS DOUBLE) / n * 100 AS delta_pp,
    avg_propose_tokens + avg_review_tokens AS avg_total_tokens FROM g""",
)
def _(spark, sf):
    return S.regime_summary(
        fx.pairs(spark, sf).select(
            F.col("modality").alias("feedback_type"), F.col("ss_meets").alias("ss_passed"),
            F.col("rv_meets").alias("rv_passed"), F.col("rv_iters").alias("rv_iterations"),
            F.col("ss_tokens").alias("rv_propose_tokens"), F.col("rv_tokens").alias("rv_review_tokens"),
        )
    )


@query(
    "transitions",
    f"""WITH {fx.PAIRS} SELECT modality, CASE WHEN ss_meets AND rv_meets THEN 'both_pass' WHEN rv_meets THEN 'fix'
      WHEN ss_meets THEN 'regress' ELSE 'both_fail' END AS transition, count(*) AS n FROM pairs GROUP BY 1, 2""",
)
def _(spark, sf):
    return S.transitions(fx.pairs(spark, sf), "ss_meets", "rv_meets", ["modality"])


@query(
    "token_roi",
    f"""WITH {fx.PAIRS}, g AS (SELECT modality, avg(ss_tokens) AS ss_tokens, avg(rv_tokens) AS rv_tokens,
      avg(rv_quality) - avg(ss_quality) AS lift FROM pairs
      WHERE ss_quality IS NOT NULL AND rv_quality IS NOT NULL GROUP BY 1)
    SELECT modality, ss_tokens, rv_tokens, round(lift, 9) AS lift, rv_tokens - ss_tokens AS extra_tokens,
    CASE WHEN lift > 0 THEN round((rv_tokens - ss_tokens) / (lift * 100), 4) END AS tokens_per_point FROM g""",
)
def _(spark, sf):
    out = S.token_roi(fx.pairs(spark, sf))
    return out.withColumn("lift", F.round("lift", 9)).withColumn("tokens_per_point", F.round("tokens_per_point", 4))


ALLOC = """alloc AS (SELECT concat('b', CAST(l_suppkey % 9 AS VARCHAR)) AS allocation_label, l_quantity > 25 + l_suppkey % 9 AS passed,
      CAST(floor(l_extendedprice) AS BIGINT) AS tokens, CAST(l_linenumber AS BIGINT) AS iterations,
      l_orderkey * 10 + l_linenumber AS pos FROM lineitem),
    acells AS (SELECT allocation_label, count(*) FILTER (WHERE passed) AS passes, count(*) AS n,
      CAST(count(*) FILTER (WHERE passed) AS DOUBLE) / count(*) AS pass_rate, avg(tokens) AS mean_tokens,
      avg(iterations) AS mean_iterations, min(pos) AS p0 FROM alloc GROUP BY 1)"""


def _alloc(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    return li.select(
        F.concat(F.lit("b"), (F.col("l_suppkey") % 9).cast("string")).alias("allocation_label"),
        (F.col("l_quantity") > 25 + F.col("l_suppkey") % 9).alias("passed"),
        F.floor("l_extendedprice").cast("bigint").alias("tokens"),
        F.col("l_linenumber").cast("bigint").alias("iterations"),
        (F.lit(256) + F.col("l_orderkey")).alias("review_cap"),
        (F.lit(256) + F.col("l_orderkey")).alias("propose_cap"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
    )


@query(
    "allocation_cells",
    f"""WITH {ALLOC} SELECT allocation_label, passes, n, pass_rate, mean_tokens, mean_iterations,
    256 + p0 // 10 AS propose_cap, 256 + p0 // 10 AS review_cap FROM acells""",
)
def _(spark, sf):
    return S.allocation_cells(_alloc(spark, sf))


@query(
    "allocation_spread",
    f"""WITH {ALLOC} SELECT
    (SELECT allocation_label FROM acells ORDER BY pass_rate DESC, allocation_label LIMIT 1) AS best,
    (SELECT allocation_label FROM acells ORDER BY pass_rate, allocation_label LIMIT 1) AS worst,
    round((max(pass_rate) - min(pass_rate)) * 100, 9) AS spread_pp, round(avg(pass_rate) * 100, 9) AS mean_pct,
    round(stddev_pop(pass_rate) * 100, 9) AS sd_pp FROM acells""",
)
def _(spark, sf):
    out = S.allocation_spread(S.allocation_cells(_alloc(spark, sf)))
    return out.select("best", "worst", *[F.round(c, 9).alias(c) for c in ("spread_pp", "mean_pct", "sd_pp")])


@query(
    "verification_gap",
    f"""WITH {fx.CANDIDATES}, c AS (SELECT task_id, iter * 4 + k AS idx, all_pass AS passed, score AS s1, n_pass AS s2 FROM candidates),
    long AS (SELECT 'score' AS selector, task_id, idx, passed, s1 AS score FROM c
      UNION ALL SELECT 'tests' AS selector, task_id, idx, passed, s2 AS score FROM c),
    g AS (SELECT selector, task_id, bool_or(passed) AS any_ok, arg_max(passed, score * 1000 - idx) AS ok FROM long GROUP BY 1, 2),
    h AS (SELECT selector, count(*) AS n_tasks, CAST(count(*) FILTER (WHERE any_ok) AS DOUBLE) / count(*) AS pass_any,
      CAST(count(*) FILTER (WHERE ok) AS DOUBLE) / count(*) AS choose_rate FROM g GROUP BY 1)
    SELECT *, pass_any - choose_rate AS gap FROM h""",
)
def _(spark, sf):
    c = fx.candidates(spark, sf).select(
        "task_id", (F.col("iter") * 4 + F.col("k")).alias("idx"), F.col("all_pass").alias("passed"),
        F.explode(
            F.array(
                F.struct(F.lit("score").alias("selector"), F.col("score").alias("score")),
                F.struct(F.lit("tests").alias("selector"), F.col("n_pass").alias("score")),
            )
        ).alias("s"),
    )
    return S.verification_gap(c.select("task_id", "idx", "passed", "s.selector", "s.score"))


@query(
    "model_summary",
    f"""WITH {fx.CELLS}, p AS (SELECT strategy AS model, seed,
      CAST(count(*) FILTER (WHERE passed) AS DOUBLE) / count(*) AS r FROM cells GROUP BY 1, 2)
    SELECT model, count(*) AS n_seeds, round(avg(r) * 100, 9) AS mean_pct,
    string_agg(CAST(seed AS VARCHAR), ',' ORDER BY seed) AS seeds FROM p GROUP BY 1""",
)
def _(spark, sf):
    out = S.model_summary(fx.cells(spark, sf).withColumnRenamed("strategy", "model"))
    return out.withColumn("mean_pct", F.round("mean_pct", 9))


@query(
    "token_efficiency",
    f"""WITH {fx.TRIALS}, g AS (SELECT baseline, CAST(count(*) FILTER (WHERE passed) AS DOUBLE) / count(*) AS r,
      avg(total_tokens) AS t FROM trials GROUP BY 1), ref AS (SELECT r AS rr, t AS rt FROM g WHERE baseline = 'N')
    SELECT baseline, r - rr AS pass_gain, t / greatest(rt, 1) AS token_ratio,
    CASE WHEN r > rr THEN (t - rt) / ((r - rr) * 100) END AS extra_tokens_per_pp FROM g, ref WHERE baseline <> 'N'""",
)
def _(spark, sf):
    return S.token_efficiency(fx.trials(spark, sf), "N")


@query(
    "budget_breakdown",
    f"""WITH {fx.CALLS}, {fx.BUDGETS_SQL}, g AS (SELECT run_id, CAST(sum(tokens) AS BIGINT) AS used, {', '.join(
        f"CAST(coalesce(sum(tokens) FILTER (WHERE phase = '{p}'), 0) AS BIGINT) AS {p}_tokens, count(*) FILTER (WHERE phase = '{p}') AS {p}_calls"
        for p in S.PHASES)} FROM calls GROUP BY 1)
    SELECT b.run_id, budget AS total_budget, coalesce(used, 0) AS total_consumed,
    greatest(budget - coalesce(used, 0), 0) AS remaining,
    CAST(coalesce(used, 0) AS DOUBLE) / CAST(budget AS DOUBLE) AS fraction_used, {', '.join(
        f"coalesce({p}_{k}, 0) AS {p}_{k}" for p in S.PHASES for k in ("tokens", "calls"))}
    FROM budgets b LEFT JOIN g ON b.run_id = g.run_id""",
)
def _(spark, sf):
    return S.budget_breakdown(fx.calls(spark, sf), fx.budgets(spark, sf))


CLAIMS = """claims AS (SELECT user_id AS report_id, event_id AS pos,
      CASE event_type WHEN 'view' THEN 'contradicted' WHEN 'error' THEN 'unverifiable' ELSE 'supported' END AS verdict,
      CAST(floor(value) AS BIGINT) AS tokens FROM events)"""


@query(
    "claim_accuracy",
    f"""WITH {CLAIMS}
    SELECT report_id, count(*) AS total_claims, count(*) FILTER (WHERE verdict = 'supported') AS supported,
    count(*) FILTER (WHERE verdict = 'contradicted') AS contradicted,
    count(*) FILTER (WHERE verdict = 'unverifiable') AS unverifiable,
    CAST(count(*) FILTER (WHERE verdict = 'supported') AS DOUBLE) / count(*) AS accuracy,
    CAST(count(*) FILTER (WHERE verdict = 'supported') AS DOUBLE) / count(*) >= 0.8 AS passed,
    CAST(sum(tokens) AS BIGINT) AS tokens FROM claims GROUP BY 1""",
)
def _(spark, sf):
    kind = F.col("event_type")
    return S.claim_accuracy(
        fx.table(spark, sf, "events").select(
            F.col("user_id").alias("report_id"), F.col("event_id").alias("pos"),
            F.when(kind == "view", "contradicted").when(kind == "error", "unverifiable").otherwise("supported").alias("verdict"),
            F.floor("value").cast("bigint").alias("tokens"),
        )
    )


TEST_EVENTS = """tests AS (SELECT l_orderkey AS candidate_id,
      CASE WHEN l_returnflag = 'R' THEN 'setup' ELSE 'assert' END AS kind, l_quantity > 20 AS ok,
      CASE WHEN l_quantity > 20 THEN NULL WHEN l_linestatus = 'F' THEN concat('AssertionError: ', CAST(l_partkey AS VARCHAR))
        ELSE concat('NameError: ', CAST(l_partkey AS VARCHAR)) END AS err,
      CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey AS pos FROM lineitem)"""


@query(
    "partial_score",
    f"""WITH {TEST_EVENTS}, g AS (SELECT candidate_id, count(*) FILTER (WHERE kind = 'assert' AND ok) AS n_pass,
      count(*) FILTER (WHERE kind = 'assert' AND NOT ok AND err LIKE 'AssertionError%') AS n_fail,
      count(*) FILTER (WHERE NOT ok AND (kind = 'setup' OR err NOT LIKE 'AssertionError%')) AS n_error,
      count(*) FILTER (WHERE kind = 'assert') AS n_total,
      min(CASE WHEN NOT ok THEN struct_pack(p := pos, e := err) END) AS f FROM tests GROUP BY 1)
    SELECT candidate_id, n_pass, n_fail, n_error, n_total, f.e AS first_error,
    n_pass = n_total AND n_total > 0 AS all_pass FROM g""",
)
def _(spark, sf):
    q, ok = F.col("l_quantity"), F.col("l_quantity") > 20
    pk = F.col("l_partkey").cast("string")
    err = F.when(~ok, F.when(F.col("l_linestatus") == "F", F.concat(F.lit("AssertionError: "), pk)).otherwise(F.concat(F.lit("NameError: "), pk)))
    ev = fx.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("candidate_id"),
        F.when(F.col("l_returnflag") == "R", "setup").otherwise("assert").alias("kind"),
        ok.alias("ok"), err.alias("err"),
        F.struct((F.col("l_linenumber").cast("bigint") * 1000000000 + F.col("l_partkey")).alias("p"), err.alias("e")).alias("pos"),
    )
    return S.partial_score(ev)


@query(
    "scaling_points",
    f"""WITH {fx.TRIALS} SELECT baseline, CAST(count(*) FILTER (WHERE passed) AS DOUBLE) / count(*) AS pass_rate,
    avg(total_tokens) AS tokens, count(*) AS n FROM trials GROUP BY 1""",
)
def _(spark, sf):
    return S.scaling_points(fx.trials(spark, sf))


@query(
    "model_mode_rate",
    """SELECT l_returnflag AS model, l_linestatus AS mode, count(*) AS n, count(*) FILTER (WHERE l_quantity > 30) AS n_passed,
    CAST(count(*) FILTER (WHERE l_quantity > 30) AS DOUBLE) / count(*) AS pass_rate FROM lineitem GROUP BY 1, 2""",
)
def _(spark, sf):
    li = fx.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("mode"), (F.col("l_quantity") > 30).alias("passed")
    )
    return S.grouped_pass_rate(li, ["model", "mode"])


@query(
    "probe_summary",
    f"""WITH {fx.ITERS} SELECT count(*) AS n, round(avg(quality), 9) AS mean_rubric,
    count(*) FILTER (WHERE quality >= 1) AS n_perfect FROM iters""",
)
def _(spark, sf):
    return S.probe_summary(fx.iters(spark, sf), "quality").withColumn("mean_rubric", F.round("mean_rubric", 9))


@query(
    "corpus_counts",
    "SELECT lang AS task_type, source AS stratum, count(*) AS n FROM documents GROUP BY 1, 2",
)
def _(spark, sf):
    d = fx.table(spark, sf, "documents").select(F.col("lang").alias("task_type"), F.col("source").alias("stratum"))
    return S.corpus_counts(d, ["task_type", "stratum"])


@query(
    "keep_rates",
    f"""WITH {fx.JUDGED} SELECT category, status, CASE WHEN grouping(category) = 1 AND grouping(status) = 1 THEN 'overall'
      WHEN grouping(status) = 1 THEN 'category' ELSE 'status' END AS level,
    count(*) AS n, count(*) FILTER (WHERE keep) AS kept, CAST(count(*) FILTER (WHERE keep) AS DOUBLE) / count(*) AS keep_rate
    FROM judged GROUP BY GROUPING SETS ((), (category), (status))""",
)
def _(spark, sf):
    return S.keep_rates(fx.judged(spark, sf))


@query(
    "pass_matrix",
    f"""WITH {fx.TRIALS}, f AS (SELECT problem_id, baseline, min(struct_pack(t := total_tokens, i := iterations, p := passed)).p AS p
      FROM trials GROUP BY 1, 2)
    SELECT problem_id, {', '.join(f"coalesce(max(CAST(p AS BIGINT)) FILTER (WHERE baseline = '{b}'), 0) AS {b}" for b in BASELINES)}
    FROM f GROUP BY 1""",
)
def _(spark, sf):
    return S.pass_matrix(fx.trials(spark, sf), BASELINES, ["total_tokens", "iterations", "passed"])


@query(
    "sampler_summary",
    f"""WITH {fx.CANDIDATES}, t AS (SELECT task_id, bool_or(all_pass) AS passed, sum(output_tokens) AS tokens,
      max(iter) AS iterations, count(*) AS n_candidates FROM candidates GROUP BY 1)
    SELECT count(*) AS n, count(*) FILTER (WHERE passed) AS n_passed,
    CAST(count(*) FILTER (WHERE passed) AS DOUBLE) / count(*) AS pass_rate, avg(tokens) AS mean_tokens,
    avg(iterations) AS mean_iterations, avg(n_candidates) AS mean_candidates FROM t""",
)
def _(spark, sf):
    return S.sampler_summary(_sampled(spark, sf))


def _sampled(spark, sf):
    return fx.candidates(spark, sf).groupBy("task_id").agg(
        F.max("all_pass").alias("passed"), F.sum("output_tokens").alias("tokens"),
        F.max("iter").alias("iterations"), F.count(F.lit(1)).alias("n_candidates"),
    )


@query(
    "sampler_failures",
    f"""WITH {fx.CANDIDATES} SELECT task_id, CAST(sum(output_tokens) AS BIGINT) AS tokens, max(iter) AS iterations, count(*) AS n_candidates
    FROM candidates GROUP BY 1 HAVING NOT coalesce(bool_or(all_pass), false)""",
)
def _(spark, sf):
    return S.sampler_failures(_sampled(spark, sf))


@query(
    "capability_ratio",
    f"""WITH j AS (SELECT d.lang AS policy, d.source AS task_id, quality = 1 AS keep FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
    g AS (SELECT policy, task_id, count(*) AS s, count(*) FILTER (WHERE keep) AS k FROM j GROUP BY 1, 2),
    m AS (SELECT a.policy, a.s, a.k, b.s AS rs, b.k AS rk FROM g a JOIN g b ON a.task_id = b.task_id AND b.policy = 'en' WHERE a.policy <> 'en'),
    h AS (SELECT policy, count(*) AS n_tasks, CAST(sum(k) AS DOUBLE) / CAST(sum(s) AS DOUBLE) AS mean_rate,
      CAST(sum(rk) AS DOUBLE) / CAST(sum(rs) AS DOUBLE) AS ref_mean_rate, count(*) FILTER (WHERE k > 0) AS union_kept,
      count(*) FILTER (WHERE rk > 0) AS ref_union_kept FROM m GROUP BY 1)
    SELECT *, mean_rate / nullif(ref_mean_rate, 0) AS mean_ratio,
    CAST(union_kept AS DOUBLE) / nullif(CAST(ref_union_kept AS DOUBLE), 0) AS union_ratio FROM h""",
)
def _(spark, sf):
    j = fx.judged(spark, sf).select(
        F.col("status").alias("policy"), F.col("category").alias("task_id"), "keep"
    )
    return S.capability_ratio(j, "en")


@query(
    "status_breakdown",
    """WITH t AS (SELECT o_orderpriority AS category, o_orderstatus AS status, count(l_orderkey) AS n FROM orders
      LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, 1, 2)
    SELECT category, status, count(*) FILTER (WHERE n <= 1) AS single_step,
    count(*) FILTER (WHERE n > 1 AND n < 6) AS midway, count(*) FILTER (WHERE n >= 6) AS step_cap FROM t GROUP BY 1, 2""",
)
def _(spark, sf):
    steps = fx.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_steps"))
    o = fx.table(spark, sf, "orders")
    t = o.join(steps, o.o_orderkey == steps.l_orderkey, "left").select(
        F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("status"),
        F.coalesce("n_steps", F.lit(0)).alias("n_steps"),
    )
    return S.status_breakdown(t, 6)
