"""Trial tables derived from the given tables, in Spark and in SQL.

Each name exists twice: a function returning a DataFrame and a SQL common
table expression with the same columns and rows. Measures are whole numbers,
so sums do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STRATEGIES = ["R", "S", "L", "H"]
BUDGETS = [1000, 5000, 20000]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _idx(values, position):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (position + 1).cast("int"))


# --- trials: one row per evaluated sample -----------------------------------

TRIALS = """trials AS (
  SELECT l_partkey AS problem_id, l_returnflag AS baseline, l_quantity > 30 AS passed,
         CAST(l_linenumber AS BIGINT) AS iterations,
         CAST(floor(l_extendedprice) AS BIGINT) AS total_tokens,
         round(l_tax * 100) AS wall_time_seconds, round(l_discount * 100) AS cost
  FROM lineitem)"""


def trials(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("problem_id"),
        F.col("l_returnflag").alias("baseline"),
        (F.col("l_quantity") > 30).alias("passed"),
        F.col("l_linenumber").cast("bigint").alias("iterations"),
        F.floor("l_extendedprice").cast("bigint").alias("total_tokens"),
        F.round(F.col("l_tax") * 100).alias("wall_time_seconds"),
        F.round(F.col("l_discount") * 100).alias("cost"),
    )


# --- cells: strategy x budget x seed x task ---------------------------------

CELLS = """cells AS (
  SELECT CAST(1 + l_linenumber % 3 AS BIGINT) AS seed,
         (['R','S','L','H'])[CAST(l_suppkey % 4 + 1 AS INT)] AS strategy,
         CAST(([1000,5000,20000])[CAST(l_orderkey % 3 + 1 AS INT)] AS BIGINT) AS budget,
         l_partkey AS task_id,
         sum(l_quantity) > 25 * count(*) AS passed,
         CAST(sum(CAST(floor(l_extendedprice / 100) AS BIGINT)) AS BIGINT) AS tokens_used,
         count(*) AS num_turns
  FROM lineitem GROUP BY 1, 2, 3, 4)"""


def cells(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        (F.lit(1) + F.col("l_linenumber") % 3).cast("bigint").alias("seed"),
        _idx(STRATEGIES, F.col("l_suppkey") % 4).alias("strategy"),
        _idx(BUDGETS, F.col("l_orderkey") % 3).cast("bigint").alias("budget"),
        F.col("l_partkey").alias("task_id"),
        "l_quantity",
        F.floor(F.col("l_extendedprice") / 100).cast("bigint").alias("tok"),
    )
    return li.groupBy("seed", "strategy", "budget", "task_id").agg(
        (F.sum("l_quantity") > 25 * F.count(F.lit(1))).alias("passed"),
        F.sum("tok").alias("tokens_used"),
        F.count(F.lit(1)).alias("num_turns"),
    )


# --- pairs: single-shot (ss) against reviewed (rv) --------------------------

PAIRS = """line_sums AS (
  SELECT l_orderkey, count(*) AS n,
         count(*) FILTER (WHERE l_quantity > 25) AS hits,
         count(*) FILTER (WHERE l_discount > 0.06) AS low,
         CAST(sum(CAST(floor(l_extendedprice / 100) AS BIGINT)) AS BIGINT) AS tok,
         CAST(max(l_linenumber) AS BIGINT) AS iters
  FROM lineitem GROUP BY l_orderkey),
pairs AS (
  SELECT o_orderkey AS task_id, 1 + o_orderkey % 3 AS run, o_orderpriority AS modality,
         hits AS ss_n_defects, low AS rv_n_defects,
         CASE WHEN o_orderkey % 11 <> 0 THEN CAST(hits AS DOUBLE) / n END AS ss_quality,
         CASE WHEN o_orderkey % 13 <> 0 THEN CAST(n - low AS DOUBLE) / n END AS rv_quality,
         hits * 2 >= n AS ss_meets, low * 2 <= n AS rv_meets,
         tok AS ss_tokens, tok * 2 + iters AS rv_tokens, iters AS rv_iters
  FROM line_sums JOIN orders ON l_orderkey = o_orderkey)"""


def pairs(spark, sf_dir) -> DataFrame:
    n = F.count(F.lit(1))
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        n.alias("n"),
        F.count_if(F.col("l_quantity") > 25).alias("hits"),
        F.count_if(F.col("l_discount") > 0.06).alias("low"),
        F.sum(F.floor(F.col("l_extendedprice") / 100).cast("bigint")).alias("tok"),
        F.max("l_linenumber").cast("bigint").alias("iters"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    key = F.col("o_orderkey")
    return sums.join(orders, sums.l_orderkey == orders.o_orderkey).select(
        key.alias("task_id"),
        (F.lit(1) + key % 3).alias("run"),
        F.col("o_orderpriority").alias("modality"),
        F.col("hits").alias("ss_n_defects"),
        F.col("low").alias("rv_n_defects"),
        F.when(key % 11 != 0, F.col("hits").cast("double") / F.col("n")).alias("ss_quality"),
        F.when(key % 13 != 0, (F.col("n") - F.col("low")).cast("double") / F.col("n")).alias("rv_quality"),
        (F.col("hits") * 2 >= F.col("n")).alias("ss_meets"),
        (F.col("low") * 2 <= F.col("n")).alias("rv_meets"),
        F.col("tok").alias("ss_tokens"),
        (F.col("tok") * 2 + F.col("iters")).alias("rv_tokens"),
        F.col("iters").alias("rv_iters"),
    )


# --- iters: the iterations of a run (at most 7, by l_linenumber) ------------

ITERS = """iters AS (
  SELECT l_orderkey AS run_id, CAST(l_linenumber AS BIGINT) AS iteration,
         max(l_quantity) > 44 AS passed,
         max(l_quantity) / 50 AS quality,
         CAST(min(round(l_discount * 100)) AS BIGINT) AS n_defects,
         CASE WHEN max(l_quantity) <= 44
              THEN concat('E', CAST(CAST(max(round(l_tax * 100)) AS BIGINT) % 3 AS VARCHAR)) END AS error,
         CASE WHEN max(l_suppkey) % 6 <> 0
              THEN concat('v', CAST(max(l_partkey) % 3 AS VARCHAR)) END AS artifact,
         CAST(sum(CAST(floor(l_extendedprice / 100) AS BIGINT)) AS BIGINT) AS tokens_propose,
         count(*) * 10 AS tokens_execute,
         CAST(sum(CAST(floor(l_extendedprice / 300) AS BIGINT)) AS BIGINT) AS tokens_review,
         max(l_discount) * 10 AS confidence
  FROM lineitem GROUP BY 1, 2)"""


def iters(spark, sf_dir) -> DataFrame:
    top = F.max("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("bigint").alias("iteration")
    ).agg(
        (top > 44).alias("passed"),
        (top / 50).alias("quality"),
        F.min(F.round(F.col("l_discount") * 100)).cast("bigint").alias("n_defects"),
        F.when(
            top <= 44,
            F.concat(F.lit("E"), (F.max(F.round(F.col("l_tax") * 100)).cast("bigint") % 3).cast("string")),
        ).alias("error"),
        F.when(
            F.max("l_suppkey") % 6 != 0,
            F.concat(F.lit("v"), (F.max("l_partkey") % 3).cast("string")),
        ).alias("artifact"),
        F.sum(F.floor(F.col("l_extendedprice") / 100).cast("bigint")).alias("tokens_propose"),
        (F.count(F.lit(1)) * 10).alias("tokens_execute"),
        F.sum(F.floor(F.col("l_extendedprice") / 300).cast("bigint")).alias("tokens_review"),
        (F.max("l_discount") * 10).alias("confidence"),
    )


# --- candidates: k samples per iteration ------------------------------------

CANDIDATES = """candidates AS (
  SELECT l_orderkey AS task_id, CAST(l_linenumber AS BIGINT) AS iter, l_partkey % 4 AS k,
         count(*) FILTER (WHERE l_quantity > 10) AS n_pass,
         count(*) FILTER (WHERE l_quantity <= 10 AND l_quantity > 5) AS n_fail,
         count(*) FILTER (WHERE l_quantity <= 5) AS n_error,
         min(l_quantity) > 35 AS all_pass,
         concat('c', CAST(max(l_suppkey) AS VARCHAR)) AS code,
         CAST(max(round(l_discount * 100)) AS BIGINT) AS score,
         CAST(sum(CAST(floor(l_extendedprice / 100) AS BIGINT)) AS BIGINT) AS output_tokens
  FROM lineitem GROUP BY 1, 2, 3)"""


def candidates(spark, sf_dir) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_orderkey").alias("task_id"),
        F.col("l_linenumber").cast("bigint").alias("iter"),
        (F.col("l_partkey") % 4).alias("k"),
    ).agg(
        F.count_if(q > 10).alias("n_pass"),
        F.count_if((q <= 10) & (q > 5)).alias("n_fail"),
        F.count_if(q <= 5).alias("n_error"),
        (F.min("l_quantity") > 35).alias("all_pass"),
        F.concat(F.lit("c"), F.max("l_suppkey").cast("string")).alias("code"),
        F.max(F.round(F.col("l_discount") * 100)).cast("bigint").alias("score"),
        F.sum(F.floor(F.col("l_extendedprice") / 100).cast("bigint")).alias("output_tokens"),
    )


# --- calls: model calls of a run --------------------------------------------

CALLS = """calls AS (
  SELECT user_id AS run_id, event_id AS seq, ts,
         CASE WHEN event_type IN ('view', 'click') THEN 'propose'
              WHEN event_type = 'purchase' THEN 'execute' ELSE 'review' END AS phase,
         CAST(floor(value) AS BIGINT) AS tokens
  FROM events)"""


def calls_of(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("seq"),
        "ts",
        F.when(kind.isin("view", "click"), "propose")
        .when(kind == "purchase", "execute")
        .otherwise("review")
        .alias("phase"),
        F.floor("value").cast("bigint").alias("tokens"),
    )


def calls(spark, sf_dir) -> DataFrame:
    return calls_of(table(spark, sf_dir, "events"))


BUDGETS_SQL = """budgets AS (
  SELECT c_custkey AS run_id, 500 + c_custkey % 2500 AS budget FROM customer)"""


def budgets(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("run_id"), (F.lit(500) + F.col("c_custkey") % 2500).alias("budget")
    )


# --- rater study ------------------------------------------------------------

VOTES = """votes AS (
  SELECT CAST(event_id % 7 AS VARCHAR) AS rater_id, user_id AS pair_id, event_id AS pos,
         CASE event_type WHEN 'click' THEN 'A' WHEN 'purchase' THEN 'B' ELSE 'same' END AS choice
  FROM events)"""

PAIR_KEY = """pair_key AS (
  SELECT c_custkey AS pair_id, c_mktsegment AS modality,
         CASE WHEN c_custkey % 2 = 0 THEN 'rv' ELSE 'ss' END AS A_condition,
         CASE WHEN c_custkey % 2 = 0 THEN 'ss' ELSE 'rv' END AS B_condition,
         c_custkey % 3 <> 0 AS decisive
  FROM customer WHERE c_acctbal > 0)"""


def votes(spark, sf_dir) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") % 7).cast("string").alias("rater_id"),
        F.col("user_id").alias("pair_id"),
        F.col("event_id").alias("pos"),
        F.when(kind == "click", "A").when(kind == "purchase", "B").otherwise("same").alias("choice"),
    )


def pair_key(spark, sf_dir) -> DataFrame:
    even = F.col("c_custkey") % 2 == 0
    return table(spark, sf_dir, "customer").filter(F.col("c_acctbal") > 0).select(
        F.col("c_custkey").alias("pair_id"),
        F.col("c_mktsegment").alias("modality"),
        F.when(even, "rv").otherwise("ss").alias("A_condition"),
        F.when(even, "ss").otherwise("rv").alias("B_condition"),
        (F.col("c_custkey") % 3 != 0).alias("decisive"),
    )


# --- judged traces ----------------------------------------------------------

JUDGED = """judged AS (
  SELECT d.doc_id AS trace_id, d.source AS category, d.lang AS status,
         d.doc_id // 3 AS task_id, 1 + d.doc_id % 3 AS seed,
         quality = 1 AS keep, toxic = 0 AS keep_b
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def judged(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        F.col("doc_id").alias("trace_id"),
        F.col("source").alias("category"),
        F.col("lang").alias("status"),
        F.floor(F.col("doc_id") / 3).cast("bigint").alias("task_id"),
        (F.lit(1) + F.col("doc_id") % 3).alias("seed"),
        (F.col("quality") == 1).alias("keep"),
        (F.col("toxic") == 0).alias("keep_b"),
    )
