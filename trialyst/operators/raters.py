"""Blind pair building and analysis of a rater study."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialyst.functions.prng import draw
from trialyst.functions.stats import binom_test, safe_ratio, skew, wilson
from trialyst.functions.text import seed_tag
from trialyst.operators.rank import with_seq_id
from trialyst.operators.summary import rows


def build_pairs(runs: DataFrame, seed, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Blind manifest and separate key. Records without both artifacts drop out
    before numbering; the reviewed side is a coin flip per pair; the manifest
    comes in hash order and does not tell the sides."""
    usable = runs.filter((F.length("ss_final_html") > 0) & (F.length("rv_final_html") > 0))
    slim = usable.select(
        "modality", "task_id", "file", "ss_n_defects", "rv_n_defects",
        *[c for c in order if c not in ("modality", "task_id", "file")],
    )
    numbered = with_seq_id(slim, "p", order)
    single_first = draw(seed, "pair_id") % 2 == 0
    sided = numbered.select(
        "pair_id", "modality", "task_id", seed_tag("file").alias("seed"),
        F.when(single_first, "ss").otherwise("rv").alias("A_condition"),
        F.when(single_first, "rv").otherwise("ss").alias("B_condition"),
        F.col("ss_n_defects").alias("ss_defects"), F.col("rv_n_defects").alias("rv_defects"),
        (F.col("ss_n_defects") != F.col("rv_n_defects")).alias("decisive"),
    )
    manifest = sided.select(
        "pair_id", "modality", "decisive", draw(f"{seed}-order", "pair_id").alias("position")
    ).orderBy("position", "pair_id")
    return manifest, sided


def judge_votes(votes: DataFrame, key: DataFrame) -> DataFrame:
    """Votes on known pairs, with what each vote means."""
    reviewed = F.when(F.col("A_condition") == "rv", "A").otherwise("B")
    picked = F.when(F.col("choice") == "same", "same").when(F.col("choice") == reviewed, "rv").otherwise("ss")
    return votes.join(key, "pair_id").withColumn("picked", picked)


def vote_totals(votes: DataFrame, key: DataFrame) -> DataFrame:
    """All votes, votes on known pairs, and raters among the latter."""
    known = key.select("pair_id").withColumn("known", F.lit(True))
    return votes.join(known, "pair_id", "left").agg(
        rows().alias("total_votes"),
        F.count_if("known").alias("known_votes"),
        F.countDistinct(F.when(F.col("known"), F.col("rater_id"))).alias("n_raters"),
    )


def _by_modality(judged: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """Counts for each modality with a preference, that is any other choice than
    "same" on a decisive or an equal pair, and their sums as OVERALL."""
    prefers = F.when(F.col("decisive"), F.col("picked") != "same").otherwise(F.col("choice") != "same")
    per = judged.groupBy("modality").agg(*[F.count_if(c).alias(n) for n, c in counts.items()], F.max(prefers).alias("__p")).filter("__p")
    sums = per.rollup("modality").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counts], F.grouping("modality").alias("__g"))
    return sums.withColumn("modality", F.when(F.col("__g") == 1, "OVERALL").otherwise(F.col("modality")))


def preference(judged: DataFrame) -> DataFrame:
    """Preference for the reviewed side on decisive pairs, by modality and
    overall. Modalities whose only votes are "same" are in neither."""
    g = _by_modality(judged, {k: F.col("decisive") & (F.col("picked") == k) for k in ("rv", "ss", "same")})
    n = F.col("rv") + F.col("ss")
    ci = wilson(F.col("rv"), n)
    return g.select(
        "modality", "rv", "ss", "same",
        safe_ratio("rv", n).alias("fraction"), ci["lo"].alias("lo"), ci["hi"].alias("hi"),
        binom_test(F.col("rv"), n).alias("p"), safe_ratio("same", n + F.col("same")).alias("same_rate"),
    )


def tie_control(judged: DataFrame) -> DataFrame:
    """Side counts and skew on pairs with equal defects; 50/50 is expected.
    The modalities are those of ``preference``, also without such a pair."""
    c, equal = F.col("choice"), ~F.col("decisive")
    g = _by_modality(judged, {"a": equal & (c == "A"), "b": equal & ~c.isin("A", "same"), "same": equal & (c == "same")})
    return g.select(
        "modality", "a", "b", "same",
        skew("a", "b").alias("skew"), binom_test(F.col("a"), F.col("a") + F.col("b")).alias("p"),
    )


def rater_agreement(votes: DataFrame, order: str = "pos") -> DataFrame:
    """Raw pairwise agreement on pairs with two or more raters. A rater's last
    vote on a pair counts. Agreeing pairs of raters come from choice counts, so
    raters are never paired up."""
    last = votes.groupBy("pair_id", "rater_id").agg(F.max_by("choice", order).alias("choice"))
    counts = last.groupBy("pair_id", "choice").agg(rows().alias("n"))
    per = counts.groupBy("pair_id").agg(
        F.sum("n").alias("raters"), F.sum(F.col("n") * (F.col("n") - 1)).alias("agree2")
    ).filter(F.col("raters") >= 2)
    out = per.agg(
        rows().alias("n_pairs"),
        F.coalesce((F.sum("agree2") / 2).cast("bigint"), F.lit(0)).alias("agree"),
        F.coalesce((F.sum(F.col("raters") * (F.col("raters") - 1)) / 2).cast("bigint"), F.lit(0)).alias("total"),
    )
    return out.withColumn("agreement", safe_ratio("agree", "total"))
