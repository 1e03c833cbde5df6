"""Bootstrap by binomial splitting against all resamples of small groups and against draw-by-draw resampling."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialyst.operators import inference as I


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(5)
    rows = [(g, rng.randrange(40), rng.randrange(25)) for g in ("x", "y") for _ in range(400)]
    return spark.createDataFrame(rows, "g string, a bigint, b bigint").cache()


def _ci(pairs, **kw):
    return {r["g"]: (r["n"], r["lo"], r["hi"]) for r in I.bootstrap_ci(pairs, "g", **kw).collect()}


def test_all_resamples_of_a_small_group_in_their_shares(spark):
    rows = [("s", 0, 5), ("s", 1, 0), ("s", 1, 0), ("s", 7, 2)]
    resamples = 20_000
    got = Counter((r.sa, r.sb) for r in I.resample_sums(spark.createDataFrame(rows, "g string, a bigint, b bigint"), "g", resamples, 3).collect())
    every = Counter((sum(rows[i][1] for i in at), sum(rows[i][2] for i in at)) for at in itertools.product(range(4), repeat=4))
    assert sum(got.values()) == resamples and set(got) <= set(every)
    for sums, ways in every.items():
        p = ways / 4**4
        assert abs(got[sums] - resamples * p) < 5 * (resamples * p * (1 - p)) ** 0.5


def test_a_resample_has_n_draws_over_all_blocks(spark, pairs):
    ones = pairs.select("g", F.lit(1).alias("a"), F.monotonically_increasing_id().alias("b"))
    got = I.resample_sums(ones, "g", 50).collect()
    assert len(got) == 100 and all(r.sa == 400 == r.n for r in got)


def test_intervals_are_those_of_plain_draws(pairs):
    got = _ci(pairs, stat="mean_delta", resamples=4000, seed=1)
    rng = np.random.default_rng(0)
    for g in "xy":
        d = np.array([r.b - r.a for r in pairs.where(F.col("g") == g).collect()])
        plain = np.sort(d[rng.integers(0, 400, (4000, 400))].mean(axis=1))
        spread = plain.std()
        assert got[g][0] == 400 and abs(got[g][1] - plain[100]) < 0.15 * spread and abs(got[g][2] - plain[3900]) < 0.15 * spread


def test_the_plain_walk_gives_the_same_sums(spark, pairs):
    """The blocks of one group, walked one after the other in one process."""
    got = {r.r: (r.sa, r.sb) for r in I.resample_sums(pairs.where("g = 'x'"), "g", 30, 9).collect()}
    block = F.pmod(F.xxhash64(F.col("a").cast("double"), F.col("b").cast("double")), F.lit(I.BLOCKS))
    held = {}
    for r in pairs.where("g = 'x'").groupBy("a", "b", block.alias("at")).count().collect():
        held.setdefault(r["at"], []).append((float(r["a"]), float(r["b"]), r["count"]))
    sums = np.zeros((2, 30))
    for at, rows in held.items():
        a, b, c = map(np.array, zip(*rows, strict=True))
        path = [sum(x[2] for k, v in held.items() if k >> s == at >> s for x in v) for s in range(7, -1, -1)]
        sums += I.block_sums(a, b, c, path, at, 30, (9, "x"))
    assert {i: tuple(sums[:, i]) for i in range(30)} == got


def test_intervals_depend_on_the_pairs_alone(spark, pairs):
    whole = _ci(pairs, resamples=300, seed=2)
    assert _ci(pairs.repartition(1), resamples=300, seed=2) == whole == _ci(pairs.repartition(17), resamples=300, seed=2)
    assert _ci(pairs.filter("g = 'x'"), resamples=300, seed=2)["x"] == whole["x"]
    fractions = pairs.selectExpr("g", "a / 7 as a", "b / 3 as b")
    assert _ci(fractions.repartition(1), resamples=300, seed=2) == _ci(fractions.repartition(17), resamples=300, seed=2)


def test_missing_sides_and_groups(spark):
    rows = [(None, 1, 2), (None, 3, 4), ("z", None, 1), ("z", 2, None), ("one", 4, 2)]
    assert _ci(spark.createDataFrame(rows, "g string, a bigint, b bigint"), resamples=200).keys() == {None, "one"}
    assert _ci(spark.createDataFrame(rows, "g string, a bigint, b bigint"), resamples=200)["one"] == (1, -2.0, -2.0)
    assert _ci(spark.createDataFrame([], "g string, a bigint, b bigint"), resamples=200) == {}


def test_ten_million_pairs(spark):
    """Cost follows the distinct pairs; one group holds nearly all of them."""
    pairs = spark.range(10_000_000).selectExpr("if(id < 10, 'small', 'hot') as g", "id % 23 as a", "id % 17 as b")
    got = _ci(pairs, stat="mean_delta", resamples=1000, seed=4)
    assert got["hot"][0] == 9_999_990 and -3.01 < got["hot"][1] < -3.0 < got["hot"][2] < -2.99
