"""Paired tests, agreement and bootstrap intervals over DataFrames."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialyst.functions.stats import safe_ratio, sign_test
from trialyst.operators.summary import rows

# Into which the distinct pairs of a group are dealt, a power of two.
BLOCKS = 128


def sign_test_pairs(pairs: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Plus, minus and tied pairs of two boolean outcomes with the exact p."""
    x, y = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
    return pairs.groupBy(*by).agg(
        rows().alias("n_pairs"),
        F.count_if(x & ~y).alias("plus"),
        F.count_if(~x & y).alias("minus"),
        F.count_if(x == y).alias("ties"),
    ).withColumn("p_two_sided", sign_test("plus", "minus"))


def kappa(judgements: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Raw agreement and Cohen's kappa of two yes/no judges."""
    g = judgements.groupBy(*by).agg(
        rows().alias("n"),
        F.count_if(F.col(a) & F.col(b)).alias("both_yes"),
        F.count_if(F.col(a)).alias("a_yes"),
        F.count_if(F.col(b)).alias("b_yes"),
    )
    n, both = F.col("n").cast("double"), F.col("both_yes")
    agree = (both * 2 + F.col("n") - F.col("a_yes") - F.col("b_yes")).cast("double") / n
    chance = (
        F.col("a_yes") * F.col("b_yes") + (F.col("n") - F.col("a_yes")) * (F.col("n") - F.col("b_yes"))
    ).cast("double") / (n * n)
    return g.withColumn("agreement", agree).withColumn("kappa", safe_ratio(agree - chance, 1 - chance))


# --- bootstrap ---------------------------------------------------------------


def _statistic(name: str, sa: Column, sb: Column, n: Column) -> Column:
    """Every statistic is a function of the two resample sums and n."""
    if name == "mean_delta":
        return (sb - sa) / n
    if name == "reduction_pct":
        return (1 - sb / F.greatest(sa, F.lit(1.0))) * 100
    if name == "delta_pp":
        return (sb / n - sa / n) * 100
    raise ValueError(f"unknown statistic {name!r}")


def _interval(sums: DataFrame, by: str, stat: str, resamples: int) -> DataFrame:
    """Order statistics at int(.025 B) and int(.975 B), no interpolation. A
    group contributes one value per resample, so the array is bounded by B."""
    values = sums.withColumn("v", _statistic(stat, F.col("sa"), F.col("sb"), F.col("n").cast("double")))
    ordered = values.groupBy(by).agg(F.max("n").alias("n"), F.sort_array(F.collect_list("v")).alias("vs"))
    return ordered.select(
        by, "n",
        F.element_at("vs", int(0.025 * resamples) + 1).alias("lo"),
        F.element_at("vs", int(0.975 * resamples) + 1).alias("hi"),
    )


def _generator(*key) -> np.random.Generator:
    """Random numbers that depend on the key alone."""
    digest = hashlib.sha256(":".join(map(str, key)).encode()).digest()
    return np.random.Generator(np.random.Philox(key=int.from_bytes(digest[:16], "big")))


def _share(rng_key: tuple, draws: np.ndarray, part: int, whole: int) -> np.ndarray:
    """How many of each resample's draws from `whole` pairs fall on `part` of them."""
    if part in (0, whole):
        return draws if part else np.zeros_like(draws)
    return _generator(*rng_key).binomial(draws, part / whole)


def block_sums(a, b, counts, path: list[int], block: int, resamples: int, key: tuple) -> tuple[np.ndarray, np.ndarray]:
    """What a block of pairs adds to both sums of every resample.

    ``path`` holds the number of pairs in the halves of halves around the block, the whole group first and the block itself
    last. The group's n draws are split at every level by a binomial draw that
    both halves make alike, as its random numbers follow from the node; the
    draws left for the block are then split among its distinct pairs in their order."""
    draws = np.full(resamples, path[0], np.int64)
    for depth in range(1, len(path)):
        own, whole = path[depth], path[depth - 1]
        at = block >> (len(path) - 1 - depth)
        first = whole - own if at & 1 else own
        left = _share((*key, depth, at >> 1), draws, first, whole)
        draws = draws - left if at & 1 else left
    order = np.lexsort((b, a))
    rest, rng = path[-1], _generator(*key, "block", block)
    sa, sb = np.zeros(resamples), np.zeros(resamples)
    for i in order.tolist():
        mine = rng.binomial(draws, counts[i] / rest) if counts[i] < rest else draws
        sa += mine * a[i]
        sb += mine * b[i]
        draws, rest = draws - mine, rest - counts[i]
    return sa, sb


def resample_sums(pairs: DataFrame, by: str, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """(by, n, r, sa, sb): both sums of every resample of n draws, with
    replacement, from each group's n pairs.

    Equal pairs are counted first, so a resample is a multinomial draw over the
    distinct pairs. These are dealt into `BLOCKS` blocks by hash, and every
    block finds its share of the draws by binomial splits down the tree of
    block counts. A group of any size is spread over its blocks, no pair is
    numbered, and no draw is a row: the shuffles hold the distinct pairs and at most
    BLOCKS rows per resample. The result does not depend on partitions,
    other groups or retries."""
    block = F.pmod(F.xxhash64("a", "b"), F.lit(BLOCKS)).cast("int").alias("__block")
    counted = pairs.select(by, F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b")).groupBy(by, "a", "b").agg(rows().alias("c"))
    counted = counted.withColumn("__block", block)
    totals = counted.groupBy(by, "__block").agg(F.sum("c").alias("t"))
    every = totals.groupBy(by).agg(F.collect_list(F.struct("__block", "t")).alias("all"))  # at most BLOCKS entries

    def within(of, s):
        return F.aggregate(F.filter("all", lambda x: F.shiftright(x["__block"], s) == F.shiftright(of, s)), F.lit(0).cast("bigint"), lambda acc, x: acc + x["t"])

    levels = BLOCKS.bit_length() - 1
    paths = every.select(by, "all", F.explode("all").alias("e")).select(
        F.col(by).alias("__by"), F.col("e.__block").alias("__at"), F.array(*[within(F.col("e.__block"), s) for s in range(levels, -1, -1)]).alias("__path")
    )
    placed = counted.join(paths, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__block") == F.col("__at"))).withColumn("__name", F.col(by).cast("string"))
    kind = counted.schema[by].dataType.simpleString()

    def summed(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        a, b, c = (frame[x].to_numpy() for x in "abc")
        path = [int(x) for x in frame["__path"].iloc[0]]
        sa, sb = block_sums(a, b, c, path, int(key[1]), resamples, (seed, frame["__name"].iloc[0]))
        return pd.DataFrame({by: pd.Series([key[0]] * resamples, dtype=frame[by].dtype), "n": path[0], "block": key[1], "r": np.arange(resamples), "sa": sa, "sb": sb})

    parts = placed.select(by, "__block", "__name", "__path", "a", "b", "c").groupBy(by, "__block").applyInPandas(summed, f"`{by}` {kind}, n bigint, block int, r int, sa double, sb double")
    # added in the order of the blocks, so that fractions round alike each time
    adding = lambda x: F.aggregate(F.sort_array("parts"), F.lit(0.0), lambda acc, p: acc + p[x])
    return parts.groupBy(by, "n", "r").agg(F.collect_list(F.struct("block", "sa", "sb")).alias("parts")).select(by, "n", "r", adding("sa").alias("sa"), adding("sb").alias("sb"))


def bootstrap_ci(
    pairs: DataFrame,
    by: str,
    stat: str = "mean_delta",
    resamples: int = 10_000,
    seed: int = 0,
) -> DataFrame:
    """Paired bootstrap 95% interval of each group; ``pairs`` has columns
    (by, a, b), one row per pair. Pairs with a null side are left out. Its cost is the number of
    distinct pairs times the resamples, whatever the number of pairs."""
    clean = pairs.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    return _interval(resample_sums(clean, by, resamples, seed), by, stat, resamples)
