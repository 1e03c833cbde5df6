"""Registered source, sink and streaming queries. Each derives its files from
the given tables, writes them to the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialyst.operators.summary import any_pass_rate, baseline_summary, metrics_summary
from trialyst.plans import fixtures as fx
from trialyst.plans.corpora import _NSTEPS, RESULTS, _results, _tasks
from trialyst.plans.registry import ORACLES, query
from trialyst.session import scratch_path, stored
from trialyst.sources import readers as I
from trialyst.sources import writers as O
from trialyst.streaming import live

# Orders per generated file; bounds what one file and one group hold.
PER_FILE = 5000


def _chunk(key: str = "l_orderkey"):
    return F.floor(F.col(key) / PER_FILE).cast("bigint")


def _one_file_each(df, path: str, *by: str) -> str:
    """Write each row's ``value`` as a file of its own, compressed: field names make up most of a list of records."""
    w = df.write.option("maxRecordsPerFile", 1).option("compression", "gzip")
    (w.partitionBy(*by) if by else w).text(path)
    return path


@query(
    "result_bundles",
    """SELECT l_returnflag AS baseline, count(*) AS n, count(*) FILTER (WHERE l_quantity > 30) AS n_passed, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS sum_tokens FROM lineitem GROUP BY 1""",
)
def _(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    rec = F.struct(
        F.col("l_partkey").cast("string").alias("problem_id"), F.col("l_returnflag").alias("baseline"), (F.col("l_quantity") > 30).alias("passed"),
        F.when(F.col("l_linenumber") > 3, F.floor("l_extendedprice").cast("bigint")).alias("total_tokens"),
        F.when(F.col("l_linenumber") <= 3, F.floor("l_extendedprice").cast("bigint")).alias("tokens"),
    )
    files = li.groupBy(_chunk().alias("c"), "l_returnflag").agg(F.to_json(F.struct(F.collect_list(rec).alias("results"), F.struct(F.lit(1).alias("x")).alias("summary"))).alias("value"))
    path = scratch_path(spark, "bundles")
    _one_file_each(files.select("value"), path)
    t = I.read_bundles(spark, path, "*.txt.gz")
    return t.groupBy("baseline").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("n_passed"), F.sum("total_tokens").alias("sum_tokens")
    )


@query(
    "run_lists",
    f"""WITH {fx.PAIRS} SELECT run, count(*) AS n, CAST(sum(ss_n_defects) AS BIGINT) AS ss, CAST(sum(rv_n_defects) AS BIGINT) AS rv FROM pairs GROUP BY 1""",
)
def _(spark, sf):
    rec = F.struct(F.col("task_id").cast("string").alias("task_id"), "run", "ss_n_defects", "rv_n_defects")
    files = fx.pairs(spark, sf).groupBy(_chunk("task_id").alias("c")).agg(F.to_json(F.collect_list(rec)).alias("value"))
    path = scratch_path(spark, "runs")
    _one_file_each(files.select("value"), path)
    r = I.read_runs(spark, [f"{path}/*.txt.gz", f"{path}/absent.json"])
    return r.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum("ss_n_defects").alias("ss"), F.sum("rv_n_defects").alias("rv"))


@query(
    "read_rejects",
    """WITH f AS (SELECT DISTINCT doc_id // 50 AS c FROM documents)
    SELECT reason, count(*) AS n FROM (SELECT CASE c % 4 WHEN 1 THEN 'not JSON' WHEN 2 THEN 'not a list' END AS reason FROM f) t WHERE reason IS NOT NULL GROUP BY 1""",
)
def _(spark, sf):
    # per file: a list of given texts, a list that breaks off, or an object around it
    texts = fx.table(spark, sf, "documents").groupBy(F.floor(F.col("doc_id") / 50).alias("c")).agg(F.to_json(F.collect_list(F.struct("doc_id", "text"))).alias("v"))
    k = F.col("c") % 4
    value = F.when(k == 1, F.substring("v", F.lit(1), F.length("v") - 1)).when(k == 2, F.concat(F.lit('{"records": '), "v", F.lit("}"))).otherwise(F.col("v"))
    path = scratch_path(spark, "lists")
    _one_file_each(texts.select(value.alias("value")), path)
    return I.read_rejects(spark, [f"{path}/*.txt.gz"]).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "scaling_grid",
    f"WITH {fx.CELLS} SELECT seed, strategy, budget, task_id, passed, tokens_used, num_turns FROM cells",
)
def _(spark, sf):
    c = fx.cells(spark, sf)
    cell = F.struct("passed", "tokens_used", "num_turns")
    part = F.floor(F.col("task_id") / 500).alias("c")
    tasks = c.groupBy("seed", part, "strategy", F.col("budget").cast("string").alias("budget")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("task_id").cast("string").alias("k"), cell.alias("v")))).alias("t")
    )
    per_budget = tasks.groupBy("seed", "c", "strategy").agg(F.map_from_entries(F.collect_list(F.struct("budget", "t"))).alias("b"))
    files = per_budget.groupBy("seed", "c").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("strategy", "b")))).alias("value"))
    path = scratch_path(spark, "grid")
    _one_file_each(files.select("seed", "value"), path, "seed")
    g = I.read_grid(spark, {s: f"{path}/seed={s}" for s in (1, 2, 3, 4)})
    return g.drop("error_message").withColumn("task_id", F.col("task_id").cast("bigint"))


@query("task_files", "SELECT p_partkey AS task_id, p_name AS description, CAST(2 AS BIGINT) AS n_requirements FROM part")
def _(spark, sf):
    rec = F.struct(
        F.col("p_partkey").cast("string").alias("task_id"), F.col("p_name").alias("description"), F.array(F.lit("a"), F.lit("b")).alias("requirements")
    )
    g = fx.table(spark, sf, "part").groupBy(F.floor(F.col("p_partkey") / 500).alias("c")).agg(F.collect_list(rec).alias("l"))
    boxed = F.to_json(F.struct(F.lit(1).alias("version"), F.col("l").alias("tasks")))
    first = F.to_json(F.struct(F.col("l").alias("suite")))
    k = F.col("c") % 3
    files = g.select(F.when(k == 0, F.to_json("l")).when(k == 1, boxed).otherwise(first).alias("value"))
    path = scratch_path(spark, "tasks")
    _one_file_each(files, path)
    t = I.read_tasks(spark, [f"{path}/*.txt.gz"])
    return t.select(F.col("task_id").cast("bigint").alias("task_id"), "description", F.size("requirements").cast("bigint").alias("n_requirements"))


@query(
    "votes_csv",
    """SELECT CAST(event_id % 7 AS VARCHAR) AS rater_id, CAST(user_id AS VARCHAR) AS pair_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS a FROM events GROUP BY 1, 2""",
)
def _(spark, sf):
    v = fx.votes(spark, sf).select(
        "rater_id", F.col("pair_id").cast("string").alias("pair_id"), F.lit("web").alias("modality"), "choice", F.lit(900).alias("rt_ms"),
        F.timestamp_seconds(F.col("pos")).cast("string").alias("ts"),
    )
    path = scratch_path(spark, "votes")
    v.write.option("header", True).csv(path)
    r = I.read_votes(spark, [f"{path}/*.csv"])
    return r.groupBy("rater_id", "pair_id").agg(F.count("ts").alias("n"), F.count_if(F.col("choice") == "A").alias("a"))


@query("metrics_store", ORACLES["metrics_summary"])
def _(spark, sf):
    path = scratch_path(spark, "metrics")
    O.write_metrics(fx.trials(spark, sf), path)
    return metrics_summary(I.read_metrics(spark, path))


@query("metrics_import", ORACLES["any_pass_rate"])
def _(spark, sf):
    # one file per baseline and range of problems, problems nested by name
    sample = F.struct("passed", F.col("total_tokens").alias("tokens"), "cost")
    per = fx.trials(spark, sf).groupBy("baseline", F.col("problem_id").cast("string").alias("p"), F.floor(F.col("problem_id") / 500).alias("c")).agg(
        F.struct(F.lit(0).alias("n_samples"), F.collect_list(sample).alias("results")).alias("s")
    )
    files = per.groupBy("baseline", "c").agg(F.map_from_entries(F.collect_list(F.struct("p", "s"))).alias("m")).select(
        F.to_json(F.create_map("baseline", "m")).alias("value")
    )
    path = scratch_path(spark, "nested")
    _one_file_each(files, path)
    return any_pass_rate(I.import_metrics(spark, path))


@query(
    "collect_all",
    f"""WITH {RESULTS}, n AS (SELECT 'code' AS task_type, {_NSTEPS} AS k, rv_meets AS ok FROM res
      UNION ALL SELECT unnest(['slide', 'webpage', 'animation']), CASE WHEN rv_iters > 1 AND q1 <> q2 THEN 6 ELSE 3 END, q2 >= 0.7 FROM res
      UNION ALL SELECT 'video', CASE WHEN rv_iters > 1 THEN 6 ELSE 3 END, q2 >= 0.7 FROM res
      UNION ALL SELECT 'research', CASE WHEN rv_iters > 1 AND q2 > q1 THEN 6 ELSE 3 END, q2 >= 0.8 FROM res)
    SELECT task_type, count(*) AS n, CAST(sum(k) AS BIGINT) AS n_steps, count(*) FILTER (WHERE ok) AS n_success FROM n GROUP BY 1""",
)
def _(spark, sf):
    base = scratch_path(spark, "families")

    def grouped(df):
        """Records by file, grouped once; every file list derives from this in place."""
        rec = F.struct(F.col("task_id").cast("string").alias("task_id"), *[c for c in df.columns if c != "task_id"])
        return stored(df.groupBy(_chunk("task_id").alias("c")).agg(F.collect_list(rec).alias("records")), "records")

    def put(groups, name, columns, rest=None):
        """The given columns of all records, or of those with task_id % 2 == rest."""
        kept = F.col("records") if rest is None else F.filter("records", lambda r: r["task_id"].cast("bigint") % 2 == rest)
        listed = F.transform(kept, lambda r: F.struct(*[r[c].alias(c) for c in ["task_id", *columns]]))
        _one_file_each(groups.filter(F.size(kept) > 0).select(F.to_json(listed).alias("value")), f"{base}/{name}")

    about = ["description", "test_code", "common_bugs", "requirements", "expected_issues"]
    tasks = grouped(_tasks(spark, sf).select("task_id", *about))
    for file, _, _ in I.FAMILIES.values():
        put(tasks, f"tasks/{file}", about)
    flags, scores = ["ss_passed", "rv_passed", "rv_iters"], ["ss_quality", "rv_quality", "rv_iters"]
    r = grouped(_results(spark, sf).select("task_id", *dict.fromkeys(flags + scores)))
    put(r, "results/code_swe_results.json", flags, 0)
    put(r, "results/code_onpolicy_run1.json", flags, 1)
    put(r, "results/slides_results.json", scores)
    put(r, "results/webpage_results_partial.json", scores, 0)  # the last fallback, and a further run
    put(r, "results/webpages_results_run2.json", scores, 1)
    put(r, "results/animation_results.json", scores, 0)
    put(r, "results/animations_onpolicy_run1.json", scores, 1)
    put(r, "results/video_results.json", scores)
    put(r, "results/research_results.json", scores)
    t = I.collect_all(spark, f"{base}/results", f"{base}/tasks")
    return t.groupBy("task_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("steps")).alias("n_steps"), F.count_if("success").alias("n_success")
    )


@query("corpus_lines", "SELECT doc_id, md5(text) AS text, lang FROM documents")
def _(spark, sf):
    path = scratch_path(spark, "corpus")
    O.write_corpus(fx.table(spark, sf, "documents").select("doc_id", "text", "lang"), path)
    return O.read_corpus(spark, path, "doc_id bigint, text string, lang string").withColumn("text", F.md5("text"))


@query(
    "summary_csv",
    f"""WITH {fx.TRIALS} SELECT baseline, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS sum_tokens FROM trials GROUP BY 1""",
)
def _(spark, sf):
    path = scratch_path(spark, "summary")
    O.write_summary(baseline_summary(fx.trials(spark, sf)).select("baseline", "n", "sum_tokens"), path)
    return spark.read.option("header", True).schema("baseline string, n bigint, sum_tokens bigint").csv(path)


@query(
    "summary_markdown",
    f"""WITH {fx.TRIALS} SELECT concat('| ', baseline, ' | ', CAST(count(*) AS VARCHAR), ' |') AS value FROM trials GROUP BY baseline UNION ALL SELECT '| baseline | n |' UNION ALL SELECT '|---|---|'""",
)
def _(spark, sf):
    path = scratch_path(spark, "markdown")
    O.write_summary(baseline_summary(fx.trials(spark, sf)).select("baseline", "n"), path, "markdown")
    return spark.read.text(path)


@query(
    "case_documents",
    """SELECT doc_id AS task_id, lang AS modality, md5(text) AS first_output,
    md5(CASE WHEN length(text) > 500 THEN concat(left(text, 500), chr(10), chr(10), '… [truncated, ', format('{:,}', length(text) - 500), ' more characters]') ELSE text END) AS trimmed FROM documents""",
)
def _(spark, sf):
    # given texts as outputs, whole in one set of documents and trimmed in another
    cases = fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("task_id"), F.col("lang").alias("modality"), F.lit("n").alias("name"), F.left("text", F.lit(40)).alias("description"),
        F.split("source", "c").alias("requirements"), F.lit("hard").alias("difficulty"),
        F.array(F.struct(F.lit("generate").alias("step"), F.col("source").alias("feedback"), F.col("text").alias("full_output"))).alias("trace"),
    )

    def told(limit):
        path = scratch_path(spark, "cases")
        O.write_cases(O.case_detail(cases, limit), path)
        d = spark.read.schema("task_id bigint, steps array<struct<output:string>>, modality string").json(path)
        return d.select("task_id", "modality", F.md5(F.get(F.col("steps"), F.lit(0))["output"]).alias("output"))

    return told(None).withColumnRenamed("output", "first_output").join(told(500).select("task_id", F.col("output").alias("trimmed")), "task_id")


@query(
    "suite_catalog",
    """SELECT 'parts' AS suite, 'all parts' AS blurb, count(*) AS n FROM part UNION ALL SELECT 'customers', 'all customers', count(*) FROM customer""",
)
def _(spark, sf):
    parts = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("task_id"))
    people = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("task_id"))
    return O.catalog({"parts": ("all parts", parts), "customers": ("all customers", people)})


@query(
    "primary_or_fallback",
    f"""WITH {fx.PAIRS} SELECT task_id % 4 AS source, count(*) AS n FROM pairs WHERE task_id % 4 IN (1, 3) GROUP BY 1""",
)
def _(spark, sf):
    names = ["webpage_results", "slide_results", "slides_old", "slides_results_run1"]
    rec = F.struct(F.col("task_id").cast("string").alias("task_id"), "ss_n_defects")
    kind = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("task_id") % 4 + 1).cast("int"))
    files = fx.pairs(spark, sf).groupBy(kind.alias("kind"), _chunk("task_id").alias("c")).agg(F.to_json(F.collect_list(rec)).alias("value"))
    path = scratch_path(spark, "fallback")
    _one_file_each(files.select("kind", "value"), path, "kind")
    # a "file" is a folder here: the first existing name is the primary, further runs match a pattern
    absent_first = ["kind=slides_results", "kind=slide_results", "kind=slides_old"]
    r = I.read_with_fallback(spark, path, absent_first, ["kind=slides_results_run*"])
    return r.groupBy((F.col("task_id").cast("bigint") % 4).alias("source")).agg(F.count(F.lit(1)).alias("n"))


# --- streams -----------------------------------------------------------------


def _events(spark, sf):
    schema = fx.table(spark, sf, "events").schema
    return live.stream_trials(spark, sf, schema, "parquet", "events.parquet")


@query(
    "stream_scoreboard",
    """SELECT event_type AS baseline, count(*) AS n, count(*) FILTER (WHERE value > 50) AS n_passed, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS sum_tokens FROM events GROUP BY 1""",
)
def _(spark, sf):
    t = _events(spark, sf).select(
        F.col("event_type").alias("baseline"), (F.col("value") > 50).alias("passed"), F.floor("value").cast("bigint").alias("total_tokens")
    )
    return live.drain(live.stream_scoreboard(t, ["baseline"]), "complete")


def _arrivals(spark, sf):
    """The events as files of a folder, dealt at random, with one row far behind them all, by which
    the watermark passes the last."""
    e = fx.table(spark, sf, "events")
    path = scratch_path(spark, "arrivals")
    e.repartition(4, F.hash("event_id")).write.parquet(path)
    end = e.orderBy(F.col("ts").desc()).limit(1).withColumn("ts", F.col("ts") + F.expr("interval 2 days"))
    end.write.mode("append").parquet(path)
    return live.stream_trials(spark, path, e.schema, "parquet")


@query(
    "stream_ledger",
    f"""WITH {fx.CALLS}, {fx.BUDGETS_SQL}, s AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY run_id ORDER BY epoch_ms(ts), seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS consumed FROM calls)
    SELECT s.run_id, seq, tokens, consumed, budget, consumed >= budget AS exhausted, consumed > budget AS overshoot, false AS late FROM s JOIN budgets b ON s.run_id = b.run_id""",
)
def _(spark, sf):
    return live.drain(live.stream_ledger(fx.calls_of(_arrivals(spark, sf)), fx.budgets(spark, sf)))


@query("stream_dedupe", "SELECT DISTINCT user_id AS run_id, event_type AS category FROM events")
def _(spark, sf):
    e = _events(spark, sf).select(F.col("user_id").alias("run_id"), F.col("event_type").alias("category"))
    return live.drain(live.stream_dedupe(e, ["run_id", "category"]))


@query(
    "stream_dedupe_event_time",
    """WITH RECURSIVE e AS (SELECT user_id AS run_id, event_type AS category, event_id, ts, epoch_ms(ts) AS ms,
      row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch_ms(ts), event_id) AS k FROM events),
    w AS (SELECT *, ms AS first_ms, true AS is_first FROM e WHERE k = 1
      UNION ALL SELECT e.*, CASE WHEN e.ms >= w.first_ms + 86400000 THEN e.ms ELSE w.first_ms END, e.ms >= w.first_ms + 86400000
      FROM w JOIN e ON e.run_id = w.run_id AND e.category = w.category AND e.k = w.k + 1)
    SELECT run_id, category, event_id, CASE WHEN is_first THEN 'first' ELSE 'duplicate' END AS status FROM w""",
)
def _(spark, sf):
    e = _arrivals(spark, sf).select(F.col("user_id").alias("run_id"), F.col("event_type").alias("category"), "event_id", "ts")
    return live.drain(live.stream_dedupe(e, ["run_id", "category"], "ts", "1 day", ["event_id"])).drop("ts")


@query(
    "stream_first_wins",
    "SELECT user_id AS run_id, event_type AS category, min(event_id) AS event_id FROM events GROUP BY 1, 2",
)
def _(spark, sf):
    e = _events(spark, sf).select(F.col("user_id").alias("run_id"), F.col("event_type").alias("category"), "event_id")
    path = scratch_path(spark, "store")
    live.ingest_first(e, ["run_id", "category"], ["event_id"], path, scratch_path(spark, "progress")).awaitTermination()
    return live.read_first(spark, path)
