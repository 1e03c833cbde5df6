"""Registered dedup, best-of, running-state and ordering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialyst.operators import rank as R
from trialyst.operators import summary as S
from trialyst.operators.inference import sign_test_pairs
from trialyst.operators.joins import match_strategies
from trialyst.plans import fixtures as fx
from trialyst.plans.registry import query
from trialyst.plans.summaries import SEED_CELLS, sign_sql

RUN_FILES = """rf AS (SELECT l_orderkey % 3 AS category, l_partkey AS task_id, l_quantity > 40 AS has_metric,
      concat(l_returnflag, l_linestatus) AS file,
      l_orderkey * 10 + l_linenumber AS pos, CAST(floor(l_extendedprice) AS BIGINT) AS tokens FROM lineitem)"""


@query(
    "dedupe_runs",
    f"""WITH {RUN_FILES} SELECT category, task_id, has_metric, file, pos, tokens FROM (SELECT *, row_number() OVER (
      PARTITION BY category, task_id ORDER BY has_metric DESC, file, pos, tokens) AS rn FROM rf) WHERE rn = 1""",
)
def _(spark, sf):
    df = fx.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 3).alias("category"), F.col("l_partkey").alias("task_id"),
        (F.col("l_quantity") > 40).alias("has_metric"), F.concat("l_returnflag", "l_linestatus").alias("file"),
        F.struct(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
            F.floor("l_extendedprice").cast("bigint").alias("tokens"),
        ).alias("pos"),
    )
    return R.dedupe_runs(df).select("category", "task_id", "has_metric", "file", "pos.pos", "pos.tokens")


TRACE_SOURCES = """ts AS (SELECT doc_id // 4 AS task_id, CASE doc_id % 5 WHEN 0 THEN 'no_revise' WHEN 1 THEN NULL
      WHEN 2 THEN 'two_revise' ELSE 'one_revise' END AS stratum,
      (['three', 'forced2', 'natural', 'forced', 'other'])[CAST(n_chars % 5 + 1 AS INT)] AS source, doc_id AS pos FROM documents)"""


@query(
    "dedupe_sources",
    f"""WITH {TRACE_SOURCES} SELECT task_id, stratum, source, pos FROM (SELECT *, row_number() OVER (PARTITION BY task_id, stratum
      ORDER BY CASE source WHEN 'natural' THEN 1 WHEN 'forced' THEN 2 WHEN 'forced2' THEN 3 WHEN 'three' THEN 4 ELSE 5 END, pos) AS rn
      FROM ts WHERE stratum IS NOT NULL AND stratum <> 'no_revise') WHERE rn = 1""",
)
def _(spark, sf):
    m = F.col("doc_id") % 5
    d = fx.table(spark, sf, "documents").select(
        F.floor(F.col("doc_id") / 4).cast("bigint").alias("task_id"),
        F.when(m == 0, "no_revise").when(m == 2, "two_revise").when(m > 2, "one_revise").alias("stratum"),
        F.element_at(F.array(*[F.lit(s) for s in ("three", "forced2", "natural", "forced", "other")]), (F.col("n_chars") % 5 + 1).cast("int")).alias("source"),
        F.col("doc_id").alias("pos"),
    )
    return R.dedupe_sources(d)


@query(
    "first_per_task",
    "SELECT user_id AS task_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY 1",
)
def _(spark, sf):
    ev = fx.table(spark, sf, "events").select(F.col("user_id").alias("task_id"), "event_id", "event_type")
    return R.first_per_task(ev, ["event_id"])


@query(
    "last_per_task",
    "SELECT user_id AS task_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1",
)
def _(spark, sf):
    ev = fx.table(spark, sf, "events").select(F.col("user_id").alias("task_id"), "event_id", "event_type")
    return R.last_per_task(ev, ["event_id"])


BEST = f"""{fx.CANDIDATES}, best AS (SELECT task_id, iter, k, code, all_pass, n_pass, n_fail, n_error FROM (
      SELECT *, row_number() OVER (PARTITION BY task_id, iter ORDER BY all_pass DESC, n_pass DESC, n_error, n_fail, k) AS rn
      FROM candidates) WHERE rn = 1)"""


@query("rank_candidates", f"WITH {BEST} SELECT * FROM best")
def _(spark, sf):
    return R.rank_candidates(fx.candidates(spark, sf))


@query(
    "carry_best",
    f"""WITH {BEST} SELECT b.task_id, b.iter, x.iter AS best_iter, x.code AS best_code, x.all_pass AS best_all_pass,
    x.n_pass AS best_n_pass FROM best b, LATERAL (SELECT * FROM best p WHERE p.task_id = b.task_id AND p.iter <= b.iter
      ORDER BY all_pass DESC, n_pass DESC, n_error, n_fail, iter LIMIT 1) x""",
)
def _(spark, sf):
    return R.carry_best(R.rank_candidates(fx.candidates(spark, sf)))


def _keep(metric, direction):
    return f"""WITH {fx.ITERS} SELECT run_id, iteration AS best_iteration, {metric} AS best_{metric} FROM (SELECT *, row_number() OVER (
      PARTITION BY run_id ORDER BY {metric} {direction}, iteration) AS rn FROM iters) WHERE rn = 1"""


@query("keep_best_quality", _keep("quality", "DESC"))
def _(spark, sf):
    return R.keep_best(fx.iters(spark, sf), "run_id", "quality", "iteration")


@query("keep_best_defects", _keep("n_defects", "ASC"))
def _(spark, sf):
    return R.keep_best(fx.iters(spark, sf), "run_id", "n_defects", "iteration", higher=False)


BON = f"""{fx.CANDIDATES}, s AS (SELECT task_id, iter * 4 + k AS idx, all_pass AS passed,
      CASE WHEN n_error = 0 THEN code END AS code FROM candidates)"""


def _bon(spark, sf):
    return fx.candidates(spark, sf).select(
        "task_id", (F.col("iter") * 4 + F.col("k")).alias("idx"), F.col("all_pass").alias("passed"),
        F.when(F.col("n_error") == 0, F.col("code")).alias("code"),
    )


@query(
    "best_of_n_first",
    f"""WITH {BON} SELECT task_id, bool_or(passed) AS passed, count(*) AS n, CASE WHEN bool_or(passed)
      THEN (min(struct_pack(i := idx, c := code)) FILTER (WHERE passed)).c ELSE min(struct_pack(i := idx, c := code)).c END AS code
    FROM s GROUP BY 1""",
)
def _(spark, sf):
    return R.best_of_n(_bon(spark, sf), "first")


@query(
    "best_of_n_last",
    f"""WITH {BON} SELECT task_id, bool_or(passed) AS passed, count(*) AS n, CASE WHEN bool_or(passed)
      THEN (min(struct_pack(i := idx, c := code)) FILTER (WHERE passed)).c
      ELSE coalesce(max(struct_pack(i := idx, c := code)).c, '') END AS code FROM s GROUP BY 1""",
)
def _(spark, sf):
    return R.best_of_n(_bon(spark, sf), "last")


GRID = f"""{fx.CELLS}, g AS (SELECT strategy, budget, CAST(count(*) FILTER (WHERE passed) AS DOUBLE) / count(*) AS pass_rate,
      avg(tokens_used) AS mean_tokens, avg(num_turns) AS mean_turns FROM cells GROUP BY 1, 2)"""


def _grid(spark, sf):
    return fx.cells(spark, sf).groupBy("strategy", "budget").agg(
        S.rate("passed").alias("pass_rate"), F.avg("tokens_used").alias("mean_tokens"), F.avg("num_turns").alias("mean_turns")
    )


@query(
    "pareto_best",
    f"""WITH {GRID} SELECT budget, strategy, pass_rate, mean_tokens FROM (SELECT *, row_number() OVER (PARTITION BY budget
      ORDER BY pass_rate DESC, mean_tokens, CASE strategy WHEN 'R' THEN 1 WHEN 'S' THEN 2 WHEN 'L' THEN 3 ELSE 4 END) AS rn FROM g) WHERE rn = 1""",
)
def _(spark, sf):
    return R.pareto_best(_grid(spark, sf), fx.STRATEGIES)


REPORT = f"""{SEED_CELLS}, ss AS (SELECT strategy, budget, count(*) AS n_seeds, avg(pass_rate) AS mean_rate, stddev_pop(pass_rate) AS sd_rate,
      avg(mean_tokens) AS mean_tokens FROM per GROUP BY 1, 2),
    best AS (SELECT *, row_number() OVER (PARTITION BY budget ORDER BY round(mean_rate, 12) DESC, mean_tokens) AS rn FROM ss),
    m AS (SELECT h.budget, h.passed AS a, l.passed AS b FROM cells h JOIN cells l ON h.budget = l.budget AND h.seed = l.seed AND h.task_id = l.task_id
      AND h.strategy = 'H' AND l.strategy = 'L'),
    g AS (SELECT budget, count(*) AS n_pairs, count(*) FILTER (WHERE a AND NOT b) AS plus, count(*) FILTER (WHERE b AND NOT a) AS minus, count(*) FILTER (WHERE a = b) AS ties FROM m GROUP BY 1)"""


@query(
    "scaling_report",
    f"""WITH {REPORT} SELECT strategy, best.budget, n_seeds, round(mean_rate, 9) AS mean_rate, round(sd_rate, 9) AS sd_rate, round(mean_tokens, 6) AS mean_tokens,
    rn = 1 AS is_best, n_pairs, plus, minus, ties, round({sign_sql('plus', 'minus')}, 9) AS p_two_sided FROM best JOIN g ON best.budget = g.budget""",
)
def _(spark, sf):
    cells = fx.cells(spark, sf)
    tests = sign_test_pairs(match_strategies(cells, "H", "L", 1000), "a_passed", "b_passed", ["budget"])
    out = R.scaling_report(S.seed_summary(cells), fx.STRATEGIES, tests)
    return out.select(
        "strategy", "budget", "n_seeds", F.round("mean_rate", 9).alias("mean_rate"), F.round("sd_rate", 9).alias("sd_rate"),
        F.round("mean_tokens", 6).alias("mean_tokens"), "is_best", "n_pairs", "plus", "minus", "ties", F.round("p_two_sided", 9).alias("p_two_sided"),
    )


@query(
    "saturation",
    f"""WITH {GRID}, t AS (SELECT *, max(pass_rate) OVER (PARTITION BY strategy) AS top FROM g)
    SELECT strategy, min(budget) AS saturation_budget, max(top) AS max_rate, arg_min(pass_rate, budget) AS rate_there
    FROM t WHERE pass_rate >= top - 0.002 GROUP BY 1""",
)
def _(spark, sf):
    return R.saturation(_grid(spark, sf), 0.002)


@query(
    "strategy_delta",
    f"""WITH {GRID} SELECT a.budget, a.pass_rate AS a_pass_rate, a.mean_tokens AS a_mean_tokens, a.mean_turns AS a_mean_turns,
    b.pass_rate AS b_pass_rate, b.mean_tokens AS b_mean_tokens, b.mean_turns AS b_mean_turns,
    (b.pass_rate - a.pass_rate) * 100 AS delta_pp FROM g a JOIN g b ON a.budget = b.budget AND a.strategy = 'L' AND b.strategy = 'H'""",
)
def _(spark, sf):
    return R.strategy_delta(_grid(spark, sf), "L", "H")


@query(
    "budget_ledger",
    f"""WITH {fx.CALLS}, {fx.BUDGETS_SQL}, s AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY run_id ORDER BY ts, seq
      ROWS UNBOUNDED PRECEDING) AS BIGINT) AS consumed FROM calls)
    SELECT s.run_id, seq, tokens, consumed, budget, greatest(budget - consumed, 0) AS remaining, consumed >= budget AS exhausted,
    consumed > budget AS overshoot, CAST(consumed AS DOUBLE) / CAST(budget AS DOUBLE) AS fraction_used
    FROM s JOIN budgets b ON s.run_id = b.run_id""",
)
def _(spark, sf):
    led = R.budget_ledger(
        fx.calls(spark, sf), fx.budgets(spark, sf), F.date_trunc("hour", "ts"), ["ts", "seq"]
    )
    return led.select("run_id", "seq", "tokens", "consumed", "budget", "remaining", "exhausted", "overshoot", "fraction_used")


@query(
    "stop_reason",
    f"""WITH {fx.ITERS}, b AS (SELECT o_orderkey AS run_id, 600 + o_custkey % 3000 AS budget FROM orders),
    x AS (SELECT i.*, budget, coalesce(sum(tokens_propose + tokens_execute + tokens_review) OVER (PARTITION BY i.run_id
        ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM iters i JOIN b ON i.run_id = b.run_id),
    e AS (SELECT run_id, iteration, CASE WHEN before >= budget THEN 'budget_exhausted'
      WHEN before + tokens_propose >= budget THEN 'budget_exhausted_after_propose' WHEN passed THEN 'tests_passed'
      WHEN before + tokens_propose + tokens_execute >= budget THEN 'budget_exhausted_after_execute'
      WHEN confidence >= 0.9 THEN 'high_confidence_pass' END AS event FROM x)
    SELECT run_id, coalesce(arg_min(event, iteration) FILTER (WHERE event IS NOT NULL AND iteration <= 5), 'max_iterations') AS stopped_reason,
    coalesce(min(iteration) FILTER (WHERE event IS NOT NULL AND iteration <= 5), least(max(iteration), 5)) AS stopped_at FROM e GROUP BY 1""",
)
def _(spark, sf):
    b = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), (F.lit(600) + F.col("o_custkey") % 3000).alias("budget"))
    return R.stop_reason(fx.iters(spark, sf), b, 5)


@query(
    "turns_to_pass",
    f"""WITH {fx.ITERS}, m AS (SELECT run_id, min(iteration) FILTER (WHERE passed AND artifact IS NOT NULL) AS ok,
      min(iteration) FILTER (WHERE artifact IS NULL) AS dead FROM iters GROUP BY 1)
    SELECT run_id, ok IS NOT NULL AND (dead IS NULL OR ok < dead) AS solved,
    CASE WHEN ok IS NOT NULL AND (dead IS NULL OR ok < dead) THEN ok END AS turns_to_pass FROM m""",
)
def _(spark, sf):
    return R.turns_to_pass(fx.iters(spark, sf).withColumn("has_code", F.col("artifact").isNotNull()))


@query(
    "last_artifact",
    f"""WITH {fx.ITERS} SELECT run_id, arg_max(artifact, iteration) FILTER (WHERE artifact IS NOT NULL) AS artifact,
    max(iteration) FILTER (WHERE artifact IS NOT NULL) AS artifact_turn,
    coalesce(max(iteration) > max(iteration) FILTER (WHERE artifact IS NOT NULL), true) AS walked_back FROM iters GROUP BY 1""",
)
def _(spark, sf):
    return R.last_artifact(fx.iters(spark, sf))


@query(
    "error_history",
    f"""WITH {fx.ITERS} SELECT run_id, iteration, error, array_to_string(h, ',') AS history, n_prior, previous, first_seen, coalesce(first_seen < iteration, false) AS recurs FROM (
      SELECT run_id, iteration, error, coalesce(list(error) FILTER (WHERE error IS NOT NULL) OVER w, []) AS h, count(error) OVER w AS n_prior, max(iteration) FILTER (WHERE error IS NOT NULL) OVER w AS previous,
      CASE WHEN error IS NOT NULL THEN min(iteration) OVER (PARTITION BY run_id, error) END AS first_seen FROM iters
      WINDOW w AS (PARTITION BY run_id ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
)
def _(spark, sf):
    return R.error_history(fx.iters(spark, sf)).withColumn("history", F.array_join("history", ","))


@query(
    "errors_before",
    f"""WITH {fx.ITERS}, l AS (SELECT run_id, max(iteration) AS iteration FROM iters GROUP BY 1)
    SELECT l.run_id, l.iteration, coalesce(string_agg(left(error, 180), chr(10) ORDER BY i.iteration), '') AS history
    FROM l LEFT JOIN iters i ON i.run_id = l.run_id AND i.iteration < l.iteration GROUP BY 1, 2""",
)
def _(spark, sf):
    # what the last iteration of each run is told
    iters = fx.iters(spark, sf)
    last = iters.groupBy("run_id").agg(F.max("iteration").alias("iteration"))
    return R.errors_before(iters, last, 180).withColumn("history", F.array_join("history", "\n"))


@query(
    "sequential_ids",
    """WITH o AS (SELECT o_orderpriority AS modality, o_orderkey AS pos FROM orders WHERE o_orderstatus <> 'P')
    SELECT modality, pos, row_number() OVER (ORDER BY modality, pos) AS seq,
    concat('p', lpad(CAST(row_number() OVER (ORDER BY modality, pos) AS VARCHAR),
      greatest(4, CAST(length(CAST(row_number() OVER (ORDER BY modality, pos) AS VARCHAR)) AS INT)), '0')) AS pair_id FROM o""",
)
def _(spark, sf):
    o = fx.table(spark, sf, "orders").filter(F.col("o_orderstatus") != "P").select(
        F.col("o_orderpriority").alias("modality"), F.col("o_orderkey").alias("pos")
    )
    return R.with_seq_id(o, "p", ["modality", "pos"])


@query(
    "union_at_k",
    f"""WITH {fx.JUDGED}, t AS (SELECT category, task_id, min(seed) FILTER (WHERE keep) AS f FROM judged GROUP BY 1, 2),
    ks AS (SELECT unnest([1, 2, 3]) AS k)
    SELECT category, CAST(k AS BIGINT) AS k, count(*) AS n_tasks, count(*) FILTER (WHERE f <= k) AS kept,
    CAST(count(*) FILTER (WHERE f <= k) AS DOUBLE) / count(*) AS union_rate FROM t, ks GROUP BY 1, 2""",
)
def _(spark, sf):
    return R.union_at_k(fx.judged(spark, sf), ["category"], [1, 2, 3])


@query(
    "identical_retry",
    f"""WITH {fx.ITERS}, l AS (SELECT run_id % 4 AS cap, artifact, lag(artifact) OVER (PARTITION BY run_id ORDER BY iteration) AS prev FROM iters)
    SELECT cap, count(*) AS n_retries, CAST(count(*) FILTER (WHERE artifact = prev) AS DOUBLE) / count(*) AS identical_rate
    FROM l WHERE artifact IS NOT NULL AND prev IS NOT NULL GROUP BY 1""",
)
def _(spark, sf):
    return R.identical_retry(fx.iters(spark, sf).withColumn("cap", F.col("run_id") % 4), ["cap"])


@query(
    "regressed_after_peak",
    f"""WITH {fx.ITERS}, g AS (SELECT run_id, max(quality) AS peak, arg_max(quality, iteration) AS last FROM iters GROUP BY 1)
    SELECT * FROM g WHERE last < peak""",
)
def _(spark, sf):
    return R.regressed_after_peak(fx.iters(spark, sf))


@query(
    "ordered_labels",
    f"""WITH {fx.TRIALS} SELECT baseline, CASE baseline WHEN 'R' THEN 'Reviewed' WHEN 'A' THEN 'Single attempt' ELSE baseline END AS label,
    count(*) AS n FROM trials GROUP BY 1, 2""",
)
def _(spark, sf):
    g = fx.trials(spark, sf).groupBy("baseline").agg(F.count(F.lit(1)).alias("n"))
    return R.order_by_labels(R.with_label(g, "baseline", {"R": "Reviewed", "A": "Single attempt"}), "baseline", ["R", "A"])


@query(
    "rate_ranking",
    """SELECT l_suppkey AS baseline, CAST(count(*) FILTER (WHERE l_quantity > 30) AS DOUBLE) / count(*) AS pass_rate
    FROM lineitem GROUP BY 1""",
)
def _(spark, sf):
    t = fx.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("baseline")).agg(
        S.rate(F.col("l_quantity") > 30).alias("pass_rate")
    )
    return t.orderBy(F.col("pass_rate").desc(), "baseline")


@query(
    "top_examples",
    """SELECT category, rank, task_id FROM (SELECT o_orderpriority AS category, o_orderkey AS task_id,
      row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 10""",
)
def _(spark, sf):
    o = fx.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("category"), F.col("o_orderkey").alias("task_id"), (-F.col("o_totalprice")).alias("o")
    )
    return R.top_examples(o, ["category"], ["o", "task_id"], 10).select("category", F.col("rank").cast("bigint").alias("rank"), "task_id")


@query("head_tasks", "SELECT p_partkey AS task_id, p_name AS description FROM part ORDER BY p_partkey LIMIT 20")
def _(spark, sf):
    p = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("task_id"), F.col("p_name").alias("description"))
    return R.head_tasks(p, ["task_id"], 20)


@query(
    "rater_order",
    f"""WITH {fx.VOTES}, a AS (SELECT DISTINCT rater_id, pair_id FROM votes),
    h AS (SELECT *, CAST(concat('0x', substr(md5(concat_ws(':', 'order', rater_id, CAST(pair_id AS VARCHAR))), 1, 8)) AS BIGINT) AS h FROM a)
    SELECT rater_id, pair_id, row_number() OVER (PARTITION BY rater_id ORDER BY h, pair_id) AS position FROM h""",
)
def _(spark, sf):
    return R.rater_order(fx.votes(spark, sf).select("rater_id", "pair_id").distinct())
