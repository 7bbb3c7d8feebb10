"""Is it an edge or the best of many tries: deflated Sharpe, track record length, overfitting probability, purged paths.

Trials are long form, ``trial_id, pos, ret``: a failed trial has no rows and can't shift another one's place. The
number of trials is counted from the data, never passed in where it can be derived.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions.exprs import array_split_segment, div, kurt_unbiased, normal_cdf, skew_unbiased
from panelspark.operators.performance import YEAR, _clean
from panelspark.plans.local import local_table

EULER_GAMMA = 0.5772156649015329
FEW = 5000  # combinations that are made on the driver


def sharpe_ratio(r: Column) -> Column:
    return F.coalesce(div(F.avg(r), F.stddev_samp(r)), F.lit(0.0))


def probabilistic_sharpe(sharpe: Column, n: Column, skew: Column, kurt: Column, benchmark: Column | float = 0.0) -> Column:
    """Probability that the true Sharpe exceeds the benchmark, given the moments; 0 below two observations."""
    b = benchmark if isinstance(benchmark, Column) else F.lit(float(benchmark))
    variance = F.greatest(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe, F.lit(1e-9))
    return F.when(n < 2, 0.0).otherwise(normal_cdf((sharpe - b) * F.sqrt(n - 1) / F.sqrt(variance)))


def expected_max_sharpe(n_trials: int, spread: float) -> float:
    """The Sharpe that the best of ``n_trials`` tries without skill is expected to show."""
    if n_trials < 2 or not spread > 0:
        return 0.0
    inv = NormalDist().inv_cdf
    return spread * ((1 - EULER_GAMMA) * inv(1 - 1 / n_trials) + EULER_GAMMA * inv(1 - 1 / (n_trials * math.e)))


def _moments(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count("ret").alias("n_obs"), sharpe_ratio(F.col("ret")).alias("sharpe"), F.coalesce(skew_unbiased(F.col("ret")), F.lit(0.0)).alias("skew"), F.coalesce(kurt_unbiased(F.col("ret")), F.lit(3.0)).alias("kurt")
    )


def deflated(m: DataFrame, n_trials: int, spread: float | None) -> DataFrame:
    """Adds ``sr0`` and ``deflated_sharpe`` to moments; without a spread of trial Sharpes the Sharpe's own standard error is used."""
    s = F.col("sharpe")
    own = F.sqrt(F.greatest(1 - F.col("skew") * s + (F.col("kurt") - 1) / 4 * s * s, F.lit(0.0)) / F.greatest(F.col("n_obs") - 1, F.lit(1)))
    m = m.withColumn("sr0", expected_max_sharpe(max(2, n_trials), 1.0) * (F.lit(float(spread)) if spread else own))
    return m.withColumn("deflated_sharpe", F.when(F.col("n_obs") >= 8, probabilistic_sharpe(F.col("sharpe"), F.col("n_obs"), F.col("skew"), F.col("kurt"), F.col("sr0"))))


def deflated_sharpe(series: DataFrame, n_trials: int, spread: float | None = None) -> DataFrame:
    """``series_id, n_obs, sharpe, skew, kurt, sr0, psr, deflated_sharpe, label``; null below 8 observations."""
    m = deflated(_moments(_clean(series), "series_id"), n_trials, spread)
    d = F.col("deflated_sharpe")
    label = F.when(d < 0.5, "likely_noise").when(d < 0.9, "marginal").when(d.isNotNull(), "robust")
    return m.select("*", probabilistic_sharpe(F.col("sharpe"), F.col("n_obs"), F.col("skew"), F.col("kurt")).alias("psr"), label.alias("label"))


def min_track_record(series: DataFrame, benchmark: float = 0.0, confidence: float = 0.95) -> DataFrame:
    """``series_id, n_obs, sharpe, min_length, years, sufficient, shortfall``; no length where the Sharpe is at or below the benchmark."""
    z = NormalDist().inv_cdf(confidence)
    m = _moments(_clean(series), "series_id").where("n_obs >= 8")
    s = F.col("sharpe")
    length = 1 + (1 - F.col("skew") * s + (F.col("kurt") - 1) / 4 * s * s) * F.pow(div(F.lit(z), s - benchmark), 2)
    m = m.withColumn("min_length", F.when(s > benchmark, F.greatest(length, F.lit(1.0))))
    short = F.greatest(F.ceil(F.col("min_length") - F.col("n_obs")), F.lit(0)).cast("bigint")
    return m.select("series_id", "n_obs", "sharpe", "min_length", (F.col("min_length") / YEAR).alias("years"), F.coalesce(F.col("n_obs") >= F.col("min_length"), F.lit(False)).alias("sufficient"), short.alias("shortfall"))


def nth_combination(index: int, n: int, k: int) -> tuple[int, ...]:
    """The choice of k out of n with that position in lexicographic order, without those before it."""
    out, first = [], 0
    while k:
        with_first = math.comb(n - first - 1, k - 1)
        if index < with_first:
            out.append(first)
            k -= 1
        else:
            index -= with_first
        first += 1
    return tuple(out)


def _combinations(spark: SparkSession, n: int, k: int, at_most: int | None = None) -> DataFrame:
    """``combo, block, inside``: which of n blocks each choice of k holds; with ``at_most``, so many choices in even steps over all of them.

    Each choice is found from its position, so many of them are made by the tasks that use them."""
    total = math.comb(n, k)
    count = total if at_most is None else min(total, at_most)
    rows = lambda i: [(i, b, b in chosen) for chosen in [set(nth_combination(i * total // count, n, k))] for b in range(n)]
    schema = "combo int, block int, inside boolean"
    if count <= FEW:
        return local_table(spark, [r for i in range(count) for r in rows(i)], schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([r for i in pdf["id"] for r in rows(int(i))], columns=["combo", "block", "inside"])

    return spark.range(count).mapInPandas(run, schema)


def pbo_logits(trials: DataFrame, splits: int = 10, at_most: int | None = None) -> DataFrame:
    """``combo, trial_id, rank, n_configs, logit``: for each half-split of the blocks the trial best inside, and its rank outside.

    All half-splits are taken unless ``at_most`` limits them. Blocks are reduced to moments per trial first; the splits meet those, not the returns.
    """
    splits -= splits % 2
    w = Window.partitionBy("trial_id")
    rows = trials.where("ret IS NOT NULL").select("trial_id", "ret", (F.row_number().over(w.orderBy("pos")) - 1).alias("p"), F.count("*").over(w).alias("n"))
    rows = rows.withColumn("block", array_split_segment(F.col("p"), F.col("n"), splits).cast("int"))
    blocks = rows.groupBy("trial_id", "block").agg(F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"), F.count("*").alias("c"))
    halves = blocks.join(_combinations(trials.sparkSession, splits, splits // 2, at_most), "block").groupBy("combo", "inside", "trial_id").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("c").alias("c"))
    mean = F.col("s") / F.col("c")
    variance = F.col("q") / F.col("c") - mean * mean
    perf = halves.select("combo", "inside", "trial_id", F.when(variance > 0, mean / F.sqrt(variance)).otherwise(0.0).alias("perf"))
    best = perf.where("inside").groupBy("combo").agg(F.max_by("trial_id", F.struct("perf", -F.col("trial_id"))).alias("trial_id"))
    v = Window.partitionBy("combo")  # one row a trial
    out = perf.where("NOT inside").select("combo", "trial_id", F.row_number().over(v.orderBy("perf", "trial_id")).alias("rank"), F.count("*").over(v).alias("n_configs"))
    share = F.least(F.greatest(F.col("rank") / (F.col("n_configs") + 1), F.lit(1e-6)), F.lit(1 - 1e-6))
    return out.join(best, ["combo", "trial_id"]).select("combo", "trial_id", "rank", "n_configs", F.ln(share / (1 - share)).alias("logit"))


def pbo(trials: DataFrame, splits: int = 10, at_most: int | None = None) -> DataFrame:
    """One row: ``pbo, logit_mean, n_partitions, n_configs, verdict``; the share of splits whose winner ends up in the lower half."""
    r = pbo_logits(trials, splits, at_most).agg(F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.avg("logit").alias("logit_mean"), F.count("*").alias("n_partitions"), F.max("n_configs").alias("n_configs"))
    return r.withColumn("verdict", F.when(F.col("pbo") > 0.5, "overfit").when(F.col("pbo") > 0.2, "acceptable").when(F.col("pbo").isNotNull(), "robust"))


def cpcv_paths(series: DataFrame, groups: int = 8, test: int = 2, purge: int = 1, embargo: int = 1, n_trials: int = 1, at_most: int | None = None) -> DataFrame:
    """``series_id, combo, n_obs, sharpe, deflated_sharpe`` of every held-out path, its blocks cut by purge and embargo."""
    rows = _clean(series).where((F.col("n") >= 8) & (F.col("n") >= groups)).withColumn("block", array_split_segment(F.col("pos"), F.col("n"), groups).cast("int"))
    w = Window.partitionBy("series_id", "block")
    rows = rows.select("series_id", "block", "ret", (F.row_number().over(w.orderBy("pos")) - 1).alias("k"), F.count("*").over(w).alias("m"))
    rows = rows.where((F.col("k") >= purge) & (F.col("k") < F.col("m") - embargo))
    chosen = _combinations(series.sparkSession, groups, test, at_most).where("inside")
    m = deflated(_moments(rows.join(chosen, "block"), "series_id", "combo").where("n_obs >= 2"), n_trials, None)
    return m.select("series_id", "combo", "n_obs", (F.col("sharpe") * YEAR**0.5).alias("sharpe"), "deflated_sharpe")


def cpcv(series: DataFrame, **kw) -> DataFrame:
    """One row per series: distribution of path Sharpes and deflated Sharpes, and the verdict by their medians."""
    q = lambda c, p: F.percentile(c, F.lit(p))
    r = cpcv_paths(series, **kw).groupBy("series_id").agg(
        F.count("*").alias("n_paths"), F.avg("sharpe").alias("mean"), F.coalesce(F.stddev_samp("sharpe"), F.lit(0.0)).alias("std"), F.min("sharpe").alias("least"), q("sharpe", 0.25).alias("p25"), q("sharpe", 0.5).alias("median"),
        q("sharpe", 0.75).alias("p75"), F.max("sharpe").alias("greatest"), F.avg((F.col("sharpe") > 0).cast("double")).alias("share_positive"), q("deflated_sharpe", 0.5).alias("deflated_median"), F.count_if(F.col("deflated_sharpe").isNull()).alias("n_short"),
    )
    d = F.col("deflated_median")
    return r.withColumn("verdict", F.when((F.col("median") <= 0) | (d < 0.5), "likely_noise").when(d >= 0.9, "robust").otherwise("inconclusive"))


def verdict(dsr: Column, overfit: Column, trials_source: Column) -> Column:
    """likely_noise, inconclusive or edge; an edge needs a recorded count of trials. The order of the cases is the rule."""
    return (
        F.when(dsr.isNull(), "inconclusive")
        .when(overfit > 0.5, "likely_noise")
        .when(dsr < 0.5, "likely_noise")
        .when(F.coalesce(trials_source, F.lit("not_recorded")) == "not_recorded", "inconclusive")
        .when((dsr >= 0.9) & (F.coalesce(overfit, F.lit(0.0)) <= 0.2), "edge")
        .otherwise("inconclusive")
    )
