"""Budget splits, caps, confidence and rewards as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: phase shares (propose, execute, review) and thresholds
FIXED_SHARES = (0.4, 0.3, 0.3)
FIRST_SHARES = (0.6, 0.2, 0.2)
FINAL_SHARES = (0.2, 0.6, 0.2)
MIDDLE_SHARES = (0.2, 0.4, 0.4)
SURE_SHARES = (0.1, 0.7, 0.2)
LIKELY_SHARES = (0.2, 0.5, 0.3)
UNSURE_SHARES = (0.3, 0.2, 0.5)
SURE, LIKELY = 0.85, 0.5
CAP_FLOOR, CAP_CEILING = 256, 8192


def phase_shares(strategy: str, iteration="iteration", total="total_iterations", confidence="confidence") -> list[Column]:
    it, n, conf = F.col(iteration), F.col(total), F.col(confidence)
    out = []
    for i in range(3):
        adaptive = F.when(it == 1, FIRST_SHARES[i]).when(it == n, FINAL_SHARES[i]).otherwise(MIDDLE_SHARES[i])
        if strategy == "fixed":
            out.append(F.lit(FIXED_SHARES[i]))
        elif strategy == "phase_adaptive":
            out.append(adaptive)
        elif strategy == "confidence_conditioned":
            out.append(
                F.when(conf.isNull(), adaptive)
                .when(conf >= SURE, SURE_SHARES[i])
                .when(conf >= LIKELY, LIKELY_SHARES[i])
                .otherwise(UNSURE_SHARES[i])
            )
        else:
            raise ValueError(f"unknown strategy {strategy!r}")
    return out


def split_budget(budget: Column, shares: list[Column]) -> list[Column]:
    """Whole-number parts that add up to the budget: floors, then one more for
    the largest remainders, the earlier phase first on ties."""
    raw = [s * budget.cast("double") for s in shares]
    low = [F.floor(r).cast("bigint") for r in raw]
    left = [r - f.cast("double") for r, f in zip(raw, low)]
    short = budget - low[0] - low[1] - low[2]
    parts = []
    for i in range(3):
        ahead = F.lit(0)
        for j in range(3):
            if j != i:
                first = left[j] >= left[i] if j < i else left[j] > left[i]
                ahead = ahead + first.cast("int")
        parts.append(low[i] + (ahead < short).cast("bigint"))
    return parts


def allocate(df: DataFrame, strategy: str) -> DataFrame:
    propose, execute, review = split_budget(F.col("budget"), phase_shares(strategy))
    return df.select(
        "*", propose.alias("propose"), execute.alias("execute"), review.alias("review")
    )


def call_cap(share: Column, budget: Column, iterations: Column) -> Column:
    """Per-call token cap of a phase."""
    raw = F.floor(share * budget.cast("double") / iterations.cast("double")).cast("bigint")
    return F.least(F.lit(CAP_CEILING), F.greatest(F.lit(CAP_FLOOR), raw))


def confidence(n_iterations: Column, passed: Column, review_confidence: Column) -> Column:
    """Confidence after the iterations so far."""
    return (
        F.when(n_iterations == 0, 0.0)
        .when(F.coalesce(passed, F.lit(False)), 0.95)
        .when(review_confidence > 0, review_confidence)
        .otherwise(F.least(n_iterations * F.lit(0.1) + 0.3, F.lit(0.8)))
    )


def reward(version: int, n_calls: Column, last_passed: Column, exec_error: Column) -> Column:
    """Reward of a completion from its execution outcome."""
    won = F.when(n_calls >= 2, 1.5).otherwise(1.0) if version == 2 else F.lit(1.0)
    return (
        F.when(n_calls == 0, 0.0)
        .when(F.coalesce(exec_error, F.lit(False)), 0.05)
        .when(F.coalesce(last_passed, F.lit(False)), won)
        .otherwise(0.1)
    )


def budget_plan(df: DataFrame) -> DataFrame:
    """Iterations and samples that a token budget pays for."""
    b = F.col("budget")
    return df.withColumn("iterations", F.greatest(F.lit(1), F.floor(b / 40000)).cast("bigint")).withColumn(
        "samples", F.greatest(F.lit(2), F.floor(b / 50000)).cast("bigint")
    )
