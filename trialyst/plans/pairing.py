"""Registered tests, intervals, joins, normalizers, gates and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialyst.functions import stats
from trialyst.operators import inference as I
from trialyst.operators import joins as J
from trialyst.operators import normalize as N
from trialyst.plans import fixtures as fx
from trialyst.plans.registry import query
from trialyst.plans.summaries import sign_sql

# --- tests and intervals -----------------------------------------------------

WINS = f"""{fx.PAIRS}, w AS (SELECT modality, task_id % 50 AS bucket, count(*) FILTER (WHERE rv_n_defects < ss_n_defects) AS wins,
      count(*) FILTER (WHERE rv_n_defects > ss_n_defects) AS losses FROM pairs GROUP BY 1, 2)"""


def _wins(spark, sf):
    a, b = F.col("ss_n_defects"), F.col("rv_n_defects")
    return fx.pairs(spark, sf).groupBy("modality", (F.col("task_id") % 50).alias("bucket")).agg(
        F.count_if(b < a).alias("wins"), F.count_if(b > a).alias("losses")
    )


@query("sign_test", f"WITH {WINS} SELECT modality, bucket, wins, losses, round({sign_sql('wins', 'losses')}, 9) AS p FROM w")
def _(spark, sf):
    return _wins(spark, sf).withColumn("p", F.round(stats.sign_test("wins", "losses"), 9))


def _binom_sql(k: str, n: str, p: float) -> str:
    # direct sum of all outcome masses not above the observed one
    def mass(i: str) -> str:
        return (
            f"exp(lgamma({n} + 1) - lgamma({i} + 1) - lgamma({n} - {i} + 1)"
            f" + {i} * ln({p}) + ({n} - {i}) * ln({1 - p}))"
        )

    return (
        f"CASE WHEN {n} = 0 THEN 1.0 ELSE least(1.0, list_sum(list_filter(list_transform(generate_series(0, {n}), "
        f"lambda i: {mass('i')}), lambda m: m <= {mass(k)} + 1e-12))) END"
    )


@query(
    "binomial_test",
    f"""WITH {WINS} SELECT modality, bucket, wins, wins + losses AS n,
    round({_binom_sql('wins', '(wins + losses)', 0.3)}, 8) AS p_at_30, round({sign_sql('wins', 'losses')}, 8) AS p_at_50 FROM w""",
)
def _(spark, sf):
    n = F.col("wins") + F.col("losses")
    return _wins(spark, sf).select(
        "modality", "bucket", "wins", n.alias("n"),
        F.round(stats.binom_test(F.col("wins"), n, 0.3), 8).alias("p_at_30"),
        F.round(stats.binom_test(F.col("wins"), n), 8).alias("p_at_50"),
    )


@query(
    "wilson_interval",
    f"""WITH {WINS}, v AS (SELECT modality, bucket, CAST(wins AS DOUBLE) AS k, CAST(wins + losses AS DOUBLE) AS n FROM w)
    SELECT modality, bucket, CASE WHEN n = 0 THEN 0.0 ELSE round((k / n + 1.96 * 1.96 / (2 * n)
      - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 9) END AS lo,
    CASE WHEN n = 0 THEN 0.0 ELSE round((k / n + 1.96 * 1.96 / (2 * n)
      + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 9) END AS hi FROM v""",
)
def _(spark, sf):
    w = stats.wilson(F.col("wins"), F.col("wins") + F.col("losses"))
    return _wins(spark, sf).select("modality", "bucket", w.alias("w")).select(
        "modality", "bucket", F.round("w.lo", 9).alias("lo"), F.round("w.hi", 9).alias("hi")
    )


MATCHED = f"""{fx.CELLS}, ready AS (SELECT seed FROM cells WHERE budget = 1000 GROUP BY seed
      HAVING count(*) FILTER (WHERE strategy = 'H') > 0 AND count(*) FILTER (WHERE strategy = 'L') > 0),
    matched AS (SELECT h.budget, h.seed, h.task_id, h.passed AS a_passed, l.passed AS b_passed FROM cells h JOIN cells l
      ON h.budget = l.budget AND h.seed = l.seed AND h.task_id = l.task_id AND h.strategy = 'H' AND l.strategy = 'L'
      WHERE h.seed IN (SELECT seed FROM ready))"""


@query("match_strategies", f"WITH {MATCHED} SELECT * FROM matched")
def _(spark, sf):
    return J.match_strategies(fx.cells(spark, sf), "H", "L", 1000)


@query(
    "sign_test_pairs",
    f"""WITH {MATCHED}, g AS (SELECT budget, count(*) AS n_pairs, count(*) FILTER (WHERE a_passed AND NOT b_passed) AS plus,
      count(*) FILTER (WHERE b_passed AND NOT a_passed) AS minus, count(*) FILTER (WHERE a_passed = b_passed) AS ties
      FROM matched GROUP BY 1) SELECT *, round({sign_sql('plus', 'minus')}, 9) AS p_two_sided FROM g""",
)
def _(spark, sf):
    m = J.match_strategies(fx.cells(spark, sf), "H", "L", 1000)
    return I.sign_test_pairs(m, "a_passed", "b_passed", ["budget"]).withColumn("p_two_sided", F.round("p_two_sided", 9))


@query(
    "judge_kappa",
    f"""WITH {fx.JUDGED}, g AS (SELECT status, count(*) AS n, count(*) FILTER (WHERE keep AND keep_b) AS both_yes,
      count(*) FILTER (WHERE keep) AS a_yes, count(*) FILTER (WHERE keep_b) AS b_yes FROM judged GROUP BY 1),
    h AS (SELECT *, CAST(both_yes * 2 + n - a_yes - b_yes AS DOUBLE) / n AS agreement,
      CAST(a_yes * b_yes + (n - a_yes) * (n - b_yes) AS DOUBLE) / (CAST(n AS DOUBLE) * n) AS chance FROM g)
    SELECT status, n, both_yes, a_yes, b_yes, round(agreement, 9) AS agreement,
    round((agreement - chance) / nullif(1 - chance, 0), 9) AS kappa FROM h""",
)
def _(spark, sf):
    k = I.kappa(fx.judged(spark, sf), "keep", "keep_b", ["status"])
    return k.withColumn("agreement", F.round("agreement", 9)).withColumn("kappa", F.round("kappa", 9))


BOOT = 10_000


def _supplier_pairs(spark, sf):
    return fx.table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 2).alias("grp"), F.col("l_suppkey").alias("id")).agg(
        F.count_if(F.col("l_quantity") > 25).alias("a"), F.count_if(F.col("l_discount") > 0.06).alias("b")
    )


# Random draws have no SQL twin; tests hold them against all resamples of small groups and against draw-by-draw resampling.
for _stat in ("mean_delta", "reduction_pct", "delta_pp"):

    @query(f"bootstrap_{_stat}")
    def _(spark, sf, stat=_stat):
        return I.bootstrap_ci(_supplier_pairs(spark, sf), "grp", stat, resamples=BOOT, seed=7)


@query("bootstrap_by_counts")
def _(spark, sf):
    pairs = fx.pairs(spark, sf).select("modality", F.col("ss_n_defects").alias("a"), F.col("rv_n_defects").alias("b"))
    return I.bootstrap_ci(pairs, "modality", "reduction_pct", resamples=BOOT, seed=7)


# --- joins -------------------------------------------------------------------


@query(
    "with_task",
    """SELECT l_partkey AS task_id, l_orderkey, p_name AS description FROM lineitem JOIN (SELECT * FROM part WHERE p_size > 10)
    ON l_partkey = p_partkey""",
)
def _(spark, sf):
    tasks = fx.table(spark, sf, "part").filter(F.col("p_size") > 10).select(
        F.col("p_partkey").alias("task_id"), F.col("p_name").alias("description")
    )
    res = fx.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("task_id"), "l_orderkey")
    return J.with_task(res, tasks)


@query(
    "with_bug_class",
    """SELECT l_partkey AS task_id, l_orderkey, coalesce(p_type, '?') AS bug_class FROM lineitem
    LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey""",
)
def _(spark, sf):
    tasks = fx.table(spark, sf, "part").filter(F.col("p_size") > 10).select(
        F.col("p_partkey").alias("task_id"), F.col("p_type").alias("bug_class")
    )
    res = fx.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("task_id"), "l_orderkey")
    return J.with_bug_class(res, tasks)


@query(
    "vs_reference",
    f"""WITH {fx.TRIALS}, o AS (SELECT baseline, problem_id, min(struct_pack(t := total_tokens, i := iterations, p := passed)).p AS passed
      FROM trials GROUP BY 1, 2),
    g AS (SELECT a.baseline, count(*) AS n_common, count(*) FILTER (WHERE b.passed) AS ref_pass, count(*) FILTER (WHERE a.passed) AS pass,
      count(*) FILTER (WHERE NOT b.passed AND a.passed) AS fixed, count(*) FILTER (WHERE b.passed AND NOT a.passed) AS broken
      FROM o a JOIN o b ON a.problem_id = b.problem_id AND b.baseline = 'N' WHERE a.baseline <> 'N' GROUP BY 1)
    SELECT *, CAST(ref_pass AS DOUBLE) / n_common AS ref_rate, CAST(pass AS DOUBLE) / n_common AS pass_rate FROM g""",
)
def _(spark, sf):
    return J.vs_reference(fx.trials(spark, sf), "N", ["total_tokens", "iterations", "passed"])


@query(
    "with_rubric",
    f"""WITH {fx.PAIRS}, r AS (SELECT task_id, round(ss_quality, 2) AS ss_rubric, round(rv_quality, 2) AS rv_rubric FROM pairs WHERE run = 1)
    SELECT o_orderkey AS task_id, o_orderstatus AS item, ss_rubric, rv_rubric FROM orders LEFT JOIN r ON o_orderkey = task_id""",
)
def _(spark, sf):
    items = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderstatus").alias("item"))
    rub = fx.pairs(spark, sf).withColumnRenamed("ss_quality", "ss_rubric").withColumnRenamed("rv_quality", "rv_rubric")
    return J.with_rubric(items, rub, 1)


@query(
    "case_index",
    """WITH res AS (SELECT l_partkey AS task_id, l_quantity AS s, round(l_discount * 100) AS v, l_linenumber AS i FROM lineitem WHERE l_returnflag = 'R'),
    img AS (SELECT DISTINCT l_partkey AS task_id, CASE WHEN l_linestatus = 'F' THEN 'ss' ELSE 'rv' END AS side FROM lineitem WHERE l_tax > 0.02),
    both_ AS (SELECT task_id FROM img GROUP BY 1 HAVING count(DISTINCT side) = 2),
    m AS (SELECT task_id, round(avg(s), 1) AS ss_defects, round(avg(v), 1) AS rv_defects, round(avg(i), 1) AS iters, count(*) AS n FROM res GROUP BY 1),
    tr AS (SELECT DISTINCT l_partkey AS task_id FROM lineitem WHERE l_quantity > 45)
    SELECT b.task_id, ss_defects, rv_defects, iters, coalesce(n, 0) AS n_runs, p_name AS description, tr.task_id IS NOT NULL AS has_trace
    FROM both_ b LEFT JOIN m ON b.task_id = m.task_id LEFT JOIN tr ON b.task_id = tr.task_id LEFT JOIN part ON p_partkey = b.task_id""",
)
def _(spark, sf):
    li = fx.table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "task_id")
    res = li.filter(F.col("l_returnflag") == "R").select(
        "task_id", F.col("l_quantity").alias("ss_n_defects"),
        F.round(F.col("l_discount") * 100).alias("rv_n_defects"), F.col("l_linenumber").alias("rv_iters"),
    )
    img = li.filter(F.col("l_tax") > 0.02).select(
        "task_id", F.when(F.col("l_linestatus") == "F", "ss").otherwise("rv").alias("side")
    )
    traces = li.filter(F.col("l_quantity") > 45).select("task_id")
    tasks = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("task_id"), F.col("p_name").alias("description"))
    return J.case_index(res, img, traces, tasks)


@query(
    "stratum_candidates",
    """SELECT p_partkey AS task_id, p_name AS description FROM part WHERE p_partkey IN
    (SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag IN ('R', 'A'))""",
)
def _(spark, sf):
    tasks = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("task_id"), F.col("p_name").alias("description"))
    tr = fx.table(spark, sf, "lineitem").filter(F.col("l_linestatus") == "O").select(
        F.col("l_partkey").alias("task_id"), F.col("l_returnflag").alias("stratum")
    )
    return J.candidates(tasks, tr, ["R", "A"])


WS_RE2 = r"[\s\x0b\x1c-\x1f\x{85}\pZ]"


@query(
    "drop_known_tasks",
    f"""WITH d AS (SELECT doc_id AS task_id, md5(regexp_replace(lower(text), '{WS_RE2}+', ' ', 'g')) AS sig FROM documents),
    b AS (SELECT md5(regexp_replace(lower(text), '{WS_RE2}+', ' ', 'g')) AS sig FROM benchmark)
    SELECT min(task_id) AS task_id FROM d WHERE sig NOT IN (SELECT sig FROM b) GROUP BY sig""",
)
def _(spark, sf):
    new = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("task_id"), F.col("text").alias("description"))
    old = fx.table(spark, sf, "benchmark").select(F.col("text").alias("description"))
    return J.drop_known(new, old, ["task_id"]).select("task_id")


@query(
    "resolve_tasks",
    """WITH s AS (SELECT p_partkey AS task_id, 2 AS priority, p_partkey AS pos, p_name AS label FROM part
      UNION ALL SELECT l_partkey, 1, l_orderkey * 10 + l_linenumber, concat('x', l_returnflag) FROM lineitem WHERE l_quantity > 48)
    SELECT task_id, CAST(min(struct_pack(priority := priority, pos := pos, label := label)).priority AS BIGINT) AS priority,
    min(struct_pack(priority := priority, pos := pos, label := label)).label AS label FROM s GROUP BY 1""",
)
def _(spark, sf):
    main = fx.table(spark, sf, "part").select(
        F.col("p_partkey").alias("task_id"), F.lit(2).cast("bigint").alias("priority"),
        F.struct(F.col("p_partkey").alias("p"), F.col("p_name").alias("l")).alias("pos"), F.col("p_name").alias("label"),
    )
    label = F.concat(F.lit("x"), "l_returnflag")
    extra = fx.table(spark, sf, "lineitem").filter(F.col("l_quantity") > 48).select(
        F.col("l_partkey").alias("task_id"), F.lit(1).cast("bigint").alias("priority"),
        F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("p"), label.alias("l")).alias("pos"), label.alias("label"),
    )
    return J.resolve_tasks(main.unionByName(extra)).select("task_id", "priority", "label")


REQS = """reqs AS (SELECT doc_id AS artifact_id, unnest(generate_series(1, 3 + doc_id % 6)) AS i, 3 + doc_id % 6 AS n FROM documents),
    verd AS (SELECT artifact_id, i AS index, (artifact_id * 31 + i) % 3 <> 0 AS satisfied, concat('e', CAST(i AS VARCHAR)) AS evidence
      FROM reqs WHERE (artifact_id + i) % 7 <> 0),
    aligned AS (SELECT r.artifact_id, r.i AS index, concat('req ', CAST(r.i AS VARCHAR)) AS requirement,
      coalesce(satisfied, false) AS satisfied, coalesce(evidence, '') AS evidence FROM reqs r LEFT JOIN verd v
      ON r.artifact_id = v.artifact_id AND r.i = v.index)"""


def requirements(spark, sf):
    n = (F.lit(3) + F.col("doc_id") % 6).cast("int")
    return fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("artifact_id"),
        F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("req "), i.cast("string"))).alias("requirements"),
    )


def verdicts(spark, sf):
    r = requirements(spark, sf).select("artifact_id", F.posexplode("requirements").alias("p", "q"))
    i = F.col("p") + 1
    v = r.filter((F.col("artifact_id") + i) % 7 != 0).select(
        "artifact_id", i.alias("index"), ((F.col("artifact_id") * 31 + i) % 3 != 0).alias("satisfied"),
        F.concat(F.lit("e"), i.cast("string")).alias("evidence"), F.lit(1).alias("pos"),
    )
    stale = v.withColumn("pos", F.lit(0)).withColumn("satisfied", ~F.col("satisfied"))
    extra = v.filter(F.col("index") == 1).withColumn("index", F.lit(99))
    return v.unionByName(stale).unionByName(extra)


@query("align_verdicts", f"WITH {REQS} SELECT * FROM aligned")
def _(spark, sf):
    return J.align_verdicts(requirements(spark, sf), verdicts(spark, sf))


@query(
    "rubric_score",
    f"""WITH {REQS} SELECT artifact_id, count(*) FILTER (WHERE satisfied) AS n_met, count(*) AS n_total,
    CAST(count(*) FILTER (WHERE satisfied) AS DOUBLE) / count(*) AS score,
    coalesce(string_agg(CAST(index AS VARCHAR), ',' ORDER BY index) FILTER (WHERE NOT satisfied), '') AS violated FROM aligned GROUP BY 1""",
)
def _(spark, sf):
    from trialyst.operators.summary import rubric_score

    out = rubric_score(J.align_verdicts(requirements(spark, sf), verdicts(spark, sf)))
    return out.withColumn("violated", F.array_join(F.transform("violated", lambda x: x.cast("string")), ","))


@query(
    "task_dossier",
    f"""WITH {fx.CELLS}, g AS (SELECT task_id, concat_ws('@', strategy, CAST(budget AS VARCHAR)) AS k, bool_or(passed) AS p, max(tokens_used) AS t
      FROM cells GROUP BY 1, 2), s AS (SELECT task_id, string_agg(concat(k, '=', CAST(p AS VARCHAR), '/', CAST(t AS VARCHAR)), ';' ORDER BY k) AS strategies FROM g GROUP BY 1),
    m AS (SELECT l_partkey AS task_id, l_returnflag AS model, bool_or(l_quantity > 30) AS a, bool_or(l_quantity > 20) AS b FROM lineitem GROUP BY 1, 2),
    x AS (SELECT task_id, string_agg(concat(model, '=', CAST(a AS VARCHAR), '/', CAST(b AS VARCHAR)), ';' ORDER BY model) AS cross_model FROM m GROUP BY 1)
    SELECT p_partkey AS task_id, p_name AS description, strategies, cross_model FROM part LEFT JOIN s ON p_partkey = s.task_id LEFT JOIN x ON p_partkey = x.task_id""",
)
def _(spark, sf):
    tasks = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("task_id"), F.col("p_name").alias("description"))
    models = fx.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("task_id"), F.col("l_returnflag").alias("model"),
        (F.col("l_quantity") > 30).alias("ss_passed"), (F.col("l_quantity") > 20).alias("rv_passed"),
    )
    d = J.task_dossier(fx.cells(spark, sf), models, tasks)

    def line(col, a, b):
        entries = F.map_entries(col)
        return F.array_join(
            F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"][a].cast("string"), F.lit("/"), e["value"][b].cast("string"))), ";"
        )

    return d.select(
        "task_id", "description", line("strategies", "passed", "tokens").alias("strategies"),
        line("cross_model", "ss_passed", "rv_passed").alias("cross_model"),
    )


# --- sets and resume ---------------------------------------------------------


@query(
    "pending_work",
    """SELECT o_orderkey AS task_id, o_orderpriority AS category FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem
    WHERE l_orderkey = o_orderkey AND l_quantity > 30)""",
)
def _(spark, sf):
    work = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderpriority").alias("category"))
    done = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task_id"), "l_quantity")
    return J.pending(work, done, ["task_id"], F.col("l_quantity") > 30)


def _two(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    a = li.filter(F.col("l_quantity") > 45).select(F.col("l_partkey").alias("task_id"))
    b = li.filter(F.col("l_discount") > 0.08).select(F.col("l_partkey").alias("task_id"))
    return a, b


_A, _B = "SELECT l_partkey AS task_id FROM lineitem WHERE l_quantity > 45", "SELECT l_partkey AS task_id FROM lineitem WHERE l_discount > 0.08"


@query(
    "union_runs",
    """SELECT l_partkey AS task_id, l_quantity AS score, NULL AS note FROM lineitem WHERE l_quantity > 45
    UNION ALL SELECT l_partkey, NULL, l_returnflag FROM lineitem WHERE l_discount > 0.08""",
)
def _(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    a = li.filter(F.col("l_quantity") > 45).select(F.col("l_partkey").alias("task_id"), F.col("l_quantity").alias("score"))
    b = li.filter(F.col("l_discount") > 0.08).select(F.col("l_partkey").alias("task_id"), F.col("l_returnflag").alias("note"))
    return J.union_all(a, b)


@query("union_ids", f"{_A} UNION {_B}")
def _(spark, sf):
    return J.union_ids(*_two(spark, sf), "task_id")


@query("common_ids", f"{_A} INTERSECT {_B}")
def _(spark, sf):
    return J.common_ids(*_two(spark, sf), "task_id")


@query("missing_ids", f"{_A} EXCEPT {_B}")
def _(spark, sf):
    return J.missing_ids(*_two(spark, sf), "task_id")


# --- normalizers and gates ---------------------------------------------------


@query(
    "normalize_pairs",
    f"""WITH {fx.PAIRS}, d AS (SELECT task_id, CASE WHEN task_id % 3 = 0 THEN CAST(ss_n_defects AS DOUBLE) END AS q0, CASE WHEN task_id % 3 = 0 THEN ss_meets END AS m0,
      CASE WHEN task_id % 3 = 0 THEN CAST(rv_n_defects AS DOUBLE) END AS v0, CASE WHEN task_id % 3 = 0 THEN rv_meets END AS w0,
      CASE WHEN task_id % 3 <> 0 THEN CAST(ss_n_defects AS DOUBLE) END AS q1, CASE WHEN task_id % 2 = 0 THEN ss_meets END AS m1,
      CASE WHEN task_id % 5 <> 0 THEN CAST(rv_n_defects AS DOUBLE) END AS v1, CASE WHEN task_id % 2 = 0 THEN rv_meets END AS w1 FROM pairs)
    SELECT task_id, coalesce(q0, q1) AS ss_quality, CASE WHEN q0 IS NULL THEN coalesce(m1, false) ELSE m0 END AS ss_meets,
    CASE WHEN q0 IS NULL THEN coalesce(v1, 0) ELSE v0 END AS rv_quality, CASE WHEN q0 IS NULL THEN coalesce(w1, false) ELSE w0 END AS rv_meets FROM d""",
)
def _(spark, sf):
    t = F.col("task_id")
    new, old, even = t % 3 == 0, t % 3 != 0, t % 2 == 0
    ssq, rvq = F.col("ss_n_defects").cast("double"), F.col("rv_n_defects").cast("double")
    d = fx.pairs(spark, sf).select(
        "task_id",
        F.when(old, ssq).alias("single_shot_quality"), F.when(even, F.col("ss_meets")).alias("single_shot_meets"),
        F.when(t % 5 != 0, rvq).alias("reviewed_quality"), F.when(even, F.col("rv_meets")).alias("reviewed_meets"),
        F.when(new, ssq).alias("ss_quality"), F.when(new, F.col("ss_meets")).alias("ss_meets"),
        F.when(new, rvq).alias("rv_quality"), F.when(new, F.col("rv_meets")).alias("rv_meets"),
    )
    return N.normalize_pairs(d).select("task_id", "ss_quality", "ss_meets", "rv_quality", "rv_meets")


@query(
    "with_category",
    """WITH t AS (SELECT concat((['code', 'slide', 'web', 'anim', 'video', 'research', 'misc'])[CAST(o_orderkey % 7 + 1 AS INT)], '_', CAST(o_orderkey AS VARCHAR)) AS task_id,
      CASE WHEN o_orderkey % 2 = 0 THEN 'code_swe_results.json' ELSE 'code_results_quick.json' END AS file FROM orders)
    SELECT task_id, file, CASE WHEN starts_with(task_id, 'code_') THEN CASE WHEN contains(file, 'swe') THEN 'code_swe' ELSE 'code_old' END
      WHEN starts_with(task_id, 'slide_') THEN 'slides' WHEN starts_with(task_id, 'web_') THEN 'webpages' WHEN starts_with(task_id, 'anim_') THEN 'animations'
      WHEN starts_with(task_id, 'video_') THEN 'video' ELSE 'research' END AS category FROM t WHERE NOT starts_with(task_id, 'misc_')""",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    prefix = F.element_at(F.array(*[F.lit(x) for x in ("code", "slide", "web", "anim", "video", "research", "misc")]), (k % 7 + 1).cast("int"))
    t = fx.table(spark, sf, "orders").select(
        F.concat_ws("_", prefix, k.cast("string")).alias("task_id"),
        F.when(k % 2 == 0, "code_swe_results.json").otherwise("code_results_quick.json").alias("file"),
    )
    return N.with_category(t)


@query("scored_pairs", f"WITH {fx.PAIRS} SELECT task_id, ss_quality, rv_quality FROM pairs WHERE ss_quality IS NOT NULL AND rv_quality IS NOT NULL")
def _(spark, sf):
    return N.scored_pairs(fx.pairs(spark, sf), "quality").select("task_id", "ss_quality", "rv_quality")


@query(
    "stringly_booleans",
    """SELECT o_orderkey AS task_id, o_orderkey % 4 = 0 AS flag FROM orders""",
)
def _(spark, sf):
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, "True").when(k == 1, "true").when(k == 2, "False")
    t = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), text.alias("flag"))
    return t.select("task_id", N.as_bool(t, "flag").alias("flag"))


@query(
    "gate_tasks",
    """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN 'missing fields' WHEN doc_id % 10 = 2 THEN 'empty or non-string buggy_code'
      WHEN doc_id % 10 = 3 THEN 'empty or non-string test_code' WHEN n_chars % 5 = 0 THEN 'fixed_code failed tests'
      WHEN n_chars % 7 = 0 THEN 'buggy_code passed tests' ELSE 'ok' END AS reason FROM documents)
    SELECT reason, count(*) AS n FROM t GROUP BY 1""",
)
def _(spark, sf):
    d = F.col("doc_id") % 10
    code = F.lit("def f(): pass")
    t = fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("task_id"), F.when(d != 1, "c").alias("bug_class"), F.col("text").alias("description"),
        F.when(d == 2, " \n").otherwise(code).alias("buggy_code"), code.alias("fixed_code"),
        F.when(d == 3, "").otherwise(code).alias("test_code"), F.array(F.lit("x")).alias("common_bugs"),
        (F.col("n_chars") % 5 != 0).alias("fixed_passed"), (F.col("n_chars") % 7 == 0).alias("buggy_passed"),
    )
    return N.reject_counts(N.gate_tasks(t))


@query(
    "gate_visual_tasks",
    """WITH t AS (SELECT CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN 'missing fields' WHEN length(text) < 200 THEN 'description too short'
      WHEN 3 + doc_id % 6 < 5 THEN 'requirements must be a list of >=5 items' WHEN doc_id % 5 < 3 THEN 'expected_issues must be a list of >=3 items'
      ELSE 'ok' END AS reason FROM documents) SELECT reason, count(*) AS n FROM t GROUP BY 1""",
)
def _(spark, sf):
    i = F.col("doc_id")
    t = fx.table(spark, sf, "documents").select(
        i.alias("task_id"), F.when(i % 2 == 0, "webpages").otherwise("slides").alias("category"), F.col("text").alias("description"),
        F.array_repeat(F.lit("r"), (F.lit(3) + i % 6).cast("int")).alias("requirements"),
        F.array_repeat(F.lit("e"), (i % 5).cast("int")).alias("expected_issues"), F.lit("hard").alias("difficulty"),
        F.when(i % 3 != 0, F.array(F.lit(1920))).alias("viewport_sizes"),
    )
    return N.reject_counts(N.gate_visual_tasks(t))


@query(
    "select_traces",
    "SELECT doc_id AS task_id, source AS category, lang AS status FROM documents WHERE source = 'src3' AND lang = 'en' ORDER BY doc_id LIMIT 25",
)
def _(spark, sf):
    d = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("task_id"), F.col("source").alias("category"), F.col("lang").alias("status"))
    return N.select_traces(d, category="src3", status="en", limit=25, order=["task_id"])


@query(
    "scrub_violations",
    "SELECT doc_id AS task_id FROM documents WHERE n_chars % 7 = 0 OR n_chars % 5 = 0",
)
def _(spark, sf):
    t = fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("task_id"), (F.col("n_chars") % 7 == 0).alias("buggy_passed"), (F.col("n_chars") % 5 != 0).alias("fixed_passed")
    )
    return N.scrub_violations(t).select("task_id")
