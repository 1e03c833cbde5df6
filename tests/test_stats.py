import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from trialyst.functions import stats
from trialyst.operators.inference import kappa
from trialyst.operators.summary import verification_gap


def _value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def _exact_sign(w, l):
    n, m = w + l, min(w, l)
    tail = sum(Fraction(math.comb(n, i), 2**n) for i in range(m + 1))
    return float(min(Fraction(1), 2 * tail))


@pytest.mark.parametrize("w,l", [(0, 0), (1, 0), (3, 1), (5, 5), (17, 2), (13, 1), (33, 2), (34, 7), (10, 0), (8, 0), (400, 310), (1000, 1000)])
def test_sign_test_is_exact(spark, w, l):
    want = 1.0 if w + l == 0 else _exact_sign(w, l)
    assert _value(spark, stats.sign_test(w, l)) == pytest.approx(want, rel=1e-11)


@pytest.mark.parametrize("w,l,p", [(17, 2, 7.3e-4), (13, 1, 1.8e-3), (33, 2, 3.7e-8), (34, 7, 2.5e-5), (10, 0, 0.002), (3, 1, 0.625)])
def test_published_p_values(spark, w, l, p):
    assert _value(spark, stats.sign_test(w, l)) == pytest.approx(p, rel=0.03)


def test_sign_test_of_a_billion_votes(spark):
    # two standard deviations off centre: close to the normal tail
    n = 10**9
    half, d = n // 2, int(math.sqrt(n))
    p = _value(spark, stats.sign_test(half - d, half + d))
    z = (2 * d - 1) / math.sqrt(n)
    assert p == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-3)


@pytest.mark.parametrize("k,n,p", [(0, 5, 0.3), (2, 7, 0.5), (7, 20, 0.2), (20, 20, 0.9), (0, 0, 0.4)])
def test_binomial_test(spark, k, n, p):
    masses = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
    want = 1.0 if n == 0 else min(1.0, sum(m for m in masses if m <= masses[k] + 1e-12))
    assert _value(spark, stats.binom_test(F.lit(k), F.lit(n), p)) == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("n,c,k", [(5, 0, 1), (5, 5, 3), (5, 2, 1), (5, 2, 4), (5, 2, 5), (3, 1, 5), (200, 3, 100)])
def test_pass_at_k(spark, n, c, k):
    got = _value(spark, stats.pass_at_k(F.lit(n), F.lit(c), k))
    if n < k:
        assert got is None
    else:
        assert got == pytest.approx(1 - math.comb(n - c, k) / math.comb(n, k), abs=1e-12)


def test_pass_at_k_rejects_zero():
    with pytest.raises(ValueError):
        stats.pass_at_k("n", "c", 0)


def test_pass_at_one_is_the_mean_and_pass_at_n_is_any(spark):
    df = spark.createDataFrame([(8, 3), (8, 0), (8, 8)], "n bigint, c bigint")
    rows = df.select("n", "c", stats.pass_at_k("n", "c", 1).alias("one"), stats.pass_at_k("n", "c", 8).alias("all")).collect()
    for r in rows:
        assert r["one"] == pytest.approx(r["c"] / r["n"])
        assert r["all"] == (1.0 if r["c"] else 0.0)


def test_wilson(spark):
    # both ends lie exactly z = 1.96 standard errors, taken at that end, from the share
    w = _value(spark, stats.wilson(F.lit(8), F.lit(10)))
    assert w["lo"] < 0.8 < w["hi"]
    for end in (w["lo"], w["hi"]):
        assert abs(0.8 - end) == pytest.approx(1.96 * math.sqrt(end * (1 - end) / 10), rel=1e-12)
    assert tuple(_value(spark, stats.wilson(F.lit(0), F.lit(0)))) == (0.0, 0.0)


def test_published_kappa(spark):
    # 36 traces: one judge keeps 9, the other 4 of those
    rows = [(True, True)] * 4 + [(True, False)] * 5 + [(False, False)] * 27
    df = spark.createDataFrame([("all", *r) for r in rows], "g string, a boolean, b boolean")
    k = kappa(df, "a", "b", ["g"]).first()
    assert k["agreement"] == pytest.approx(31 / 36)
    assert k["kappa"] == pytest.approx(0.545, abs=5e-4)


def test_binomial_tails_equal_the_sum_of_all_outcomes(spark):
    rng = random.Random(1)
    sizes = [rng.randrange(1, 60) for _ in range(60)] + [rng.randrange(60, 2001) for _ in range(30)]
    rows = [(0, 0), (0, 1), (1, 1), (3, 3)] + [(rng.randrange(n + 1), n) for n in sizes] + [(round(n * q), n) for n in (500, 2000) for q in (0.28, 0.3, 0.31, 0.9)]
    for p in (0.3, 0.9):

        def want(k, n, p=p):
            logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(n + 1)]
            mass = [math.exp(x) for x in logs]
            return min(1.0, math.fsum(m for m in mass if m <= mass[k] + 1e-12)) if n else 1.0

        got = spark.createDataFrame(rows, "k int, n int").select("k", "n", stats.binom_test("k", "n", p).alias("p")).collect()
        assert max(abs(r["p"] - want(r["k"], r["n"])) for r in got) < 1e-11


def test_binomial_cost_does_not_follow_n(spark):
    """A sequence of all outcomes would not fit anywhere."""
    n = 10**11
    k = round(0.3 * n + 2 * (0.21 * n) ** 0.5)  # two standard deviations off
    p = spark.createDataFrame([(k, n)], "k bigint, n bigint").select(stats.binom_test("k", "n", 0.3).alias("p")).collect()[0]["p"]
    assert abs(p - math.erfc(2 / 2**0.5)) < 1e-4


def test_candidates_are_sorted_once_for_the_choice(spark):
    """Best score, lowest index on ties; what made the candidates stands in another stage than the only sort."""
    rows = [("s", 1, 1, False, 5), ("s", 1, 2, True, 5), ("s", 2, 1, False, 3), ("s", 2, 2, True, 4), ("s", 3, 1, False, None)]
    made = spark.createDataFrame(rows, "selector string, task_id bigint, idx bigint, passed boolean, score bigint")
    gap = verification_gap(made)
    r = gap.first()
    assert (r["n_tasks"], r["pass_any"], r["choose_rate"]) == (3, 2 / 3, 1 / 3)
    assert gap._jdf.queryExecution().executedPlan().toString().split("AdaptiveSparkPlan")[1].count("Sort [") == 1
