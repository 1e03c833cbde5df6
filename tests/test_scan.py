"""Chunked scans against plain windows, with one group holding most rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trialyst.functions.prng import draw
from trialyst.operators.corpus import assign_strata, quota_sample
from trialyst.operators.rank import error_history, errors_before, with_seq_id
from trialyst.operators.scan import order_statistic, ranged, running, take_by_rank


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", i, rng.choice([None, rng.randrange(100)])) for i in range(3000)]
    return spark.createDataFrame(rows, "k string, t bigint, v bigint").cache()


@pytest.mark.parametrize("size", [None, 1, 64, 10_000])
def test_running_equals_window(skewed, size):
    w = Window.partitionBy("k").orderBy("t")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.select(
        "k", "t", F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("s"), F.max("v").over(upto).alias("m"),
        F.count(F.lit(1)).over(upto).alias("c"), F.last("v", True).over(upto).alias("l"), F.lag("v").over(w).alias("p"),
        F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("b"),
    )
    v = F.col("v")
    got = running(
        skewed, ["k"], ["t"], {"s": ("sum", v), "m": ("max", v), "c": ("count", v), "l": ("last", v), "p": ("prev", v), "b": ("before", v)},
        None if size is None else F.floor(F.col("t") / size),
    ).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_take_by_rank_takes_exactly_the_first(spark, skewed):
    quota = spark.createDataFrame([("hot", 500), ("k1", 3), ("k2", 10_000)], "k string, n_take bigint")
    got = take_by_rank(skewed, ["k"], draw(1, "t"), ["t"], quota).select("k", "t").collect()
    ranked = skewed.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(draw(1, "t"), "t"))).join(quota, "k")
    want = ranked.filter("rn <= n_take").select("k", "t").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_take_by_rank_with_equal_ranks(spark):
    df = spark.range(50).select(F.lit("a").alias("k"), F.col("id").alias("t"))
    quota = spark.createDataFrame([("a", 7)], "k string, n_take bigint")
    got = take_by_rank(df, ["k"], F.lit(12345), ["t"], quota)
    assert sorted(r["t"] for r in got.collect()) == list(range(7))


@pytest.mark.parametrize("take", [0, 1, 1234, 4999, 5000, 6000])
def test_an_edge_bucket_of_any_size(spark, take):
    """All ranks in one bucket, many of them equal; the order within is by rank and then tie."""
    df = spark.range(5000).select(F.lit("a").alias("k"), F.col("id").alias("t"), (F.col("id") * 7919 % 13).alias("r"))
    quota = spark.createDataFrame([("a", take), ("absent", 3)], "k string, n_take bigint")
    got = [r["t"] for r in take_by_rank(df, ["k"], F.col("r"), ["t"], quota).collect()]
    want = [t for _, t in sorted((t * 7919 % 13, t) for t in range(5000))][:take]
    assert sorted(got) == sorted(want)


def test_reads_planned_for_quotas(spark, tmp_path):
    """Each of the passes before has been run and kept; the plan reads the rows once more."""
    path = str(tmp_path / "t")
    spark.range(3000).selectExpr("id as task_id", "if(id % 5 = 0, 'one_revise', if(id % 3 = 0, 'two_revise', 'three_revise')) as stratum").write.parquet(path)
    for df in (quota_sample(spark.read.parquet(path)), assign_strata(spark.read.parquet(path).select("task_id"), 0.4, 3)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("tmp_path") + plan.count(path) == 1
        assert "Window" not in plan


@pytest.mark.parametrize("fraction", [0.0, 0.25, 1.0])
def test_assigned_share_is_exact(spark, fraction):
    got = assign_strata(spark.range(333).withColumnRenamed("id", "task_id"), fraction, 5)
    assert got.filter("target = 'no_revise'").count() == round(333 * fraction) and got.count() == 333
    assert assign_strata(spark.range(0).withColumnRenamed("id", "task_id"), fraction, 5).count() == 0


@pytest.mark.parametrize("bins", [1, 3, 4096])
def test_order_statistic(skewed, bins):
    ix = F.floor(F.col("__n") / 2).cast("bigint")
    got = {r["k"]: r["m"] for r in order_statistic(skewed, ["k"], "v", ix, "m", bins).collect()}
    values = {}
    for r in skewed.collect():
        if r["v"] is not None:
            values.setdefault(r["k"], []).append(r["v"])
    assert got == {k: sorted(v)[len(v) // 2] for k, v in values.items()}


def test_results_do_not_depend_on_partitioning(skewed):
    ix = F.floor(F.col("__n") / 2).cast("bigint")
    a = order_statistic(skewed.repartition(1), ["k"], "v", ix, "m").collect()
    b = order_statistic(skewed.repartition(33), ["k"], "v", ix, "m").collect()
    assert sorted(a) == sorted(b)


def test_long_runs_may_be_chunked(spark):
    from trialyst.operators import rank as R

    n = 400
    turns = spark.range(n).select(F.lit(1).alias("g"), (F.col("id") % 2).alias("run_id"), "id", F.concat(F.lit("v"), (F.col("id") % 5 % 2).cast("string")).alias("artifact"))
    args = (turns.withColumnRenamed("id", "iteration"), ["g"])
    assert R.identical_retry(*args).collect() == R.identical_retry(*args, chunk=F.floor(F.col("iteration") / 16)).collect()
    best = turns.select(
        F.col("run_id").alias("task_id"), F.col("id").alias("iter"), F.lit(False).alias("all_pass"), (F.col("id") * 7 % 31).alias("n_pass"),
        F.lit(0).alias("n_fail"), F.lit(0).alias("n_error"), F.lit(0).alias("k"), F.col("id").cast("string").alias("code"),
    )
    whole = sorted(R.carry_best(best).collect())
    assert whole == sorted(R.carry_best(best, F.floor(F.col("iter") / 16)).collect())


def test_order_statistic_of_heavy_tails(spark):
    """One group with a far outlier and many values close together, one of equal values, one of a single row."""
    import random

    from pyspark.sql import functions as F

    from trialyst.operators.scan import order_statistic

    rng = random.Random(9)
    rows = [("t", float(rng.randrange(10**6)) / 10**6) for _ in range(20_000)] + [("t", 1e18), ("t", -1e18)] + [("e", 5.0)] * 3000 + [("o", 2.0), (None, 4.0), (None, 1.0), ("n", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    for at in (0.0, 0.01, 0.5, 0.99, 1.0):
        index = F.floor((F.col("__n") - 1) * at)
        got = {r["k"]: r["m"] for r in order_statistic(df, ["k"], "v", index, "m").collect()}
        assert got == {k: sorted(v)[int((len(v) - 1) * at)] for k, v in groups.items()}


def test_chunks_have_equal_counts_and_follow_the_order(spark, skewed):
    cut = ranged(skewed, ["k", "t"], "c")
    sizes = [r["count"] for r in cut.groupBy("c").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2.5 * 3000 / 8
    assert cut.where("k = 'hot'").select("c").distinct().count() > 4
    bounds = cut.groupBy("c").agg(F.min(F.struct("k", "t")).alias("lo"), F.max(F.struct("k", "t")).alias("hi")).orderBy("c").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(bounds, bounds[1:], strict=False))


def test_rows_are_numbered_without_gaps(spark, skewed):
    numbered = with_seq_id(skewed, "p", ["v", "t"])
    got = [(r["seq"], r["pair_id"]) for r in numbered.orderBy(F.col("v").asc_nulls_first(), "t").collect()]
    assert got == [(i, f"p{i:04d}") for i in range(1, 3001)]


def test_what_meets_in_one_place_does_not_grow(spark):
    """Rows of the window without keys: one per range partition."""
    for n in (1000, 100_000):
        numbered = with_seq_id(spark.range(n), "p", ["id"])
        assert numbered.agg(F.max("seq"), F.countDistinct("seq")).collect()[0] == (n, n)
        plan = numbered._jdf.queryExecution().optimizedPlan().toString()
        window = plan[plan.index("__t_seq") :]
        assert "Aggregate [__chunk" in window
        chunks = [p for p in numbered.inputFiles()]
        assert 0 < len(chunks) <= 8


@pytest.mark.parametrize("n", [0, 1])
def test_running_over_hardly_any_rows(spark, n):
    df = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("t"))
    assert [r["s"] for r in running(df, ["k"], ["t"], {"s": ("count", F.lit(1))}).collect()] == [1] * n


def test_errors_lead_back_to_the_first(spark):
    """One run holds nearly all rows; the index follows its failures without an array per row."""
    rng = random.Random(2)
    rows = [("hot", i, rng.choice([None, "a", "b", f"e{i % 50}"])) for i in range(4000)] + [("none", 1, None), ("one", 1, "x")]
    df = spark.createDataFrame(rows, "run_id string, iteration int, error string")
    got = {(r["run_id"], r["iteration"]): r for r in error_history(df).collect()}
    assert len(got) == len(rows) and got["none", 1].n_prior == 0 and got["one", 1].previous is None
    seen, last, first = 0, None, {}
    for _, i, e in rows[:4000]:
        r = got["hot", i]
        assert (r.n_prior, r.previous) == (seen, last) and r.recurs == (e is not None and e in first)
        if e is not None:
            first.setdefault(e, i)
            seen, last = seen + 1, i
            assert r.first_seen == first[e]
    asked = spark.createDataFrame([("hot", 300), ("one", 1), ("hot", 0)], "run_id string, iteration int")
    texts = {(r["run_id"], r["iteration"]): r["history"] for r in errors_before(df, asked, 1).collect()}
    assert texts["hot", 300] == [e[:1] for _, i, e in rows[:300] if e is not None] and texts["one", 1] == texts["hot", 0] == []


def test_error_history_holds_every_earlier_error(spark):
    """Each iteration sees all earlier errors of its run in order, also across chunks."""
    rng = random.Random(5)
    rows = [("hot", i, rng.choice([None, "a", "b" * 300, f"e{i}"])) for i in range(400)] + [("none", 1, None), ("one", 1, "x"), ("one", 2, None)]
    df = spark.createDataFrame(rows, "run_id string, iteration int, error string")
    got = {(r["run_id"], r["iteration"]): r["history"] for r in error_history(df).collect()}
    assert got["none", 1] == got["one", 1] == [] and got["one", 2] == ["x"]
    for i in range(400):
        assert got["hot", i] == [e for _, _, e in rows[:i] if e is not None]
