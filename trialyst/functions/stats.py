"""Exact tests, intervals and estimators as native column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_LOG_TWO_PI = 0.5 * math.log(2.0 * math.pi)


def _col(x) -> Column:
    return x if isinstance(x, Column) else (F.col(x) if isinstance(x, str) else F.lit(x))


def _stirling_error(x: Column) -> Column:
    """ln x! minus Stirling's leading terms, x >= 1."""
    small = F.ln(
        F.aggregate(F.sequence(F.lit(1), F.least(x, F.lit(15)).cast("int")), F.lit(1.0), lambda a, i: a * i)
    ) - (x + 0.5) * F.ln(x) + x - HALF_LOG_TWO_PI
    inv = F.lit(1.0) / x
    inv2 = inv * inv
    series = inv * (1 / 12 - inv2 * (1 / 360 - inv2 * (1 / 1260 - inv2 * (1 / 1680 - inv2 / 1188))))
    return F.when(x < 16, small).otherwise(series)


def half_binomial_pmf(m: Column, n: Column) -> Column:
    """P(X = m) for n fair coin flips, accurate for very large n too."""
    m, n = m.cast("double"), n.cast("double")
    e = (n - m * 2) / n
    deviance = n / 2 * ((1 - e) * F.log1p(-e) + (1 + e) * F.log1p(e))
    log_scale = _stirling_error(n) - _stirling_error(m) - _stirling_error(n - m)
    inner = F.sqrt(n / (2 * math.pi * m * (n - m))) * F.exp(log_scale - deviance)
    return F.when((m == 0) | (m == n), F.exp(-n * math.log(2.0))).otherwise(inner)


def sign_test(wins, losses) -> Column:
    """Two-sided exact sign test; 1 when there is nothing to compare.

    The lower tail is summed downwards from its largest term. Terms below
    about 1e-18 of that term cannot change a double, so 6*sqrt(n) + 64 of
    them are enough whatever n is.
    """
    w, l = _col(wins).cast("bigint"), _col(losses).cast("bigint")
    n, m = w + l, F.least(w, l)
    terms = F.least(m + 1, (F.sqrt(n) * 6 + 64).cast("bigint"))
    tail = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), terms - 1),
        F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")),
        lambda acc, j: F.struct(
            (acc["t"] * (m - j).cast("double") / (n - m + j + 1).cast("double")).alias("t"),
            (acc["s"] + acc["t"]).alias("s"),
        ),
        lambda acc: acc["s"],
    )
    return F.when(n == 0, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), half_binomial_pmf(m, n) * tail * 2)
    )


def binomial_pmf(k: Column, n: Column, p: float) -> Column:
    """P(X = k) for n trials of chance p: the leading terms of the factorials by
    their distance from the mean, the rest by Stirling's errors; accurate for very large n too."""
    def deviance(x: Column, mean: Column) -> Column:
        return x * F.ln(x / mean) + mean - x

    log_scale = _stirling_error(n) - _stirling_error(k) - _stirling_error(n - k)
    apart = deviance(k, n * p) + deviance(n - k, n * (1 - p))
    inner = F.sqrt(n / (2 * math.pi * k * (n - k))) * F.exp(log_scale - apart)
    return F.when(k == 0, F.exp(n * math.log1p(-p))).when(k == n, F.exp(n * math.log(p))).otherwise(inner)


def binom_test(k, n, p: float = 0.5) -> Column:
    """Two-sided exact binomial test: the mass of all outcomes no likelier than
    the observed one (slack 1e-12). n = 0 gives 1; p = 1/2 is the sign test.

    Chances rise up to the mode and fall behind it, so the outcomes that count
    are two tails, whose ends are found by halving. Each tail is summed outwards from its largest
    term; as in the sign test 6*sqrt(n) + 64 terms are enough whatever n is."""
    k, n = _col(k).cast("bigint"), _col(n).cast("bigint")
    if p == 0.5:
        return sign_test(k, n - k)
    given = F.struct(
        n.cast("double").alias("n"), F.floor((n + 1) * F.lit(p)).cast("double").alias("mode"), (binomial_pmf(k.cast("double"), n.cast("double"), p) + 1e-12).alias("limit")
    )

    def halve(g: Column, lo: Column, hi: Column, rises: bool) -> Column:
        """The first whole number from lo on, below hi, whose chance is over the limit, or not over it where chances fall."""

        def step(acc: Column, _: Column) -> Column:
            mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("double")
            within = binomial_pmf(mid, g["n"], p) <= g["limit"]
            go_on, open_ = within if rises else ~within, acc["lo"] < acc["hi"]
            return F.struct(F.when(open_ & go_on, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(open_ & ~go_on, mid).otherwise(acc["hi"]).alias("hi"))

        # 53 halvings end any range of whole doubles
        return F.aggregate(F.sequence(F.lit(1), F.least(F.lit(53), F.ceil(F.log2(hi - lo + 1)).cast("int") + 1)), F.struct(lo.alias("lo"), hi.alias("hi")), step, lambda acc: acc["lo"])

    def tail(g: Column, start: Column, count: Column, ratio) -> Column:
        terms = F.least(count, F.floor(F.sqrt(g["n"]) * 6 + 64).cast("double")).cast("int")
        walk = F.aggregate(
            F.sequence(F.lit(1), terms),
            F.struct(start.alias("i"), binomial_pmf(start, g["n"], p).alias("t"), F.lit(0.0).alias("s")),
            lambda acc, _: F.struct(ratio(acc["i"])[0].alias("i"), (acc["t"] * ratio(acc["i"])[1]).alias("t"), (acc["s"] + acc["t"]).alias("s")),
            lambda acc: acc["s"],
        )
        return F.when(count > 0, walk).otherwise(F.lit(0.0))

    odds = p / (1 - p)

    def both(g: Column) -> Column:
        ends = F.struct(
            g["n"].alias("n"), g["limit"].alias("limit"),
            halve(g, F.lit(0.0), g["mode"] + 1, True).alias("below"), halve(g, F.least(g["mode"] + 1, g["n"] + 1), g["n"] + 1, False).alias("from"),
        )

        def summed(e: Column) -> Column:
            down = tail(e, e["below"] - 1, e["below"], lambda i: (i - 1, i / ((e["n"] - i + 1) * odds)))
            up = tail(e, e["from"], e["n"] + 1 - e["from"], lambda i: (i + 1, (e["n"] - i) * odds / (i + 1)))
            return F.least(F.lit(1.0), down + up)

        return F.get(F.transform(F.array(ends), summed), F.lit(0))

    # one-element arrays carry what is needed several times, so that it is computed once
    return F.when(n == 0, F.lit(1.0)).otherwise(F.get(F.transform(F.array(given), both), F.lit(0)))


def wilson(k, n, z: float = 1.96) -> Column:
    """Wilson score interval as a struct (lo, hi); (0, 0) when n = 0."""
    k, n = _col(k).cast("double"), _col(n).cast("double")
    safe = F.when(n > 0, n)
    p = k / safe
    denom = 1 + z * z / safe
    centre = (p + z * z / (2 * safe)) / denom
    half = z * F.sqrt(p * (1 - p) / safe + z * z / (4 * safe * safe)) / denom
    return F.struct(
        F.coalesce(centre - half, F.lit(0.0)).alias("lo"),
        F.coalesce(centre + half, F.lit(0.0)).alias("hi"),
    )


def pass_at_k(n, c, k: int) -> Column:
    """Unbiased pass@k of one problem, null when n < k.

    1 - C(n-c, k) / C(n, k) as a product of k factors, so its cost does not
    depend on how many samples a problem has.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    n, c = _col(n).cast("double"), _col(c).cast("double")
    miss = F.aggregate(
        F.sequence(F.lit(0), F.lit(k - 1)),
        F.lit(1.0),
        lambda a, j: a * F.greatest(n - c - j, F.lit(0.0)) / (n - j),
    )
    return F.when(n >= k, F.when(c == 0, F.lit(0.0)).when(n - c < k, F.lit(1.0)).otherwise(1 - miss))


def safe_ratio(a, b) -> Column:
    """a / b as a double, null when b is 0."""
    return _col(a).cast("double") / F.nullif(_col(b).cast("double"), F.lit(0.0))


def skew(a, b) -> Column:
    """|a - b| / (a + b), 0 when both are 0."""
    a, b = _col(a).cast("double"), _col(b).cast("double")
    return F.coalesce(F.abs(a - b) / F.nullif(a + b, F.lit(0.0)), F.lit(0.0))
