"""Performance, tail risk, stress and overlap of return series ``series_id, pos, ret``; many series in one job.

Every operator groups by ``series_id`` and skips null returns. What can't be measured (too few observations, no
spread) is null, never zero, save where a ratio is defined as zero.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.exprs import array_split_segment, bucket_of, div, safe_corr, scalar

YEAR = 252
MIN_PERFORMANCE, MIN_RISK, MIN_SEGMENT, MIN_OVERLAP = 30, 20, 20, 20


def _clean(series: DataFrame) -> DataFrame:
    rows = series.where("ret IS NOT NULL AND NOT isnan(ret)").select("series_id", "pos", "ret")
    w = Window.partitionBy("series_id")
    return rows.select("series_id", "ret", (F.row_number().over(w.orderBy("pos")) - 1).alias("pos"), F.count("*").over(w).alias("n"))


def with_drawdown(series: DataFrame) -> DataFrame:
    """Adds ``equity`` (growth of 1) and ``dd``, its distance below the highest equity so far (from the first row on)."""
    w = Window.partitionBy("series_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    e = _clean(series).withColumn("equity", F.product(F.col("ret") + 1).over(w))
    return e.withColumn("dd", F.coalesce(div(F.col("equity"), F.max("equity").over(w)) - 1, F.lit(0.0)))


def sharpe(r: Column, periods: int = YEAR) -> Column:
    return div(F.avg(r), F.stddev_samp(r)) * (periods**0.5)


def performance_report(series: DataFrame, risk_free: float = 0.0, periods: int = YEAR) -> DataFrame:
    """One row per series of at least 30 returns: Sharpe, Sortino, Calmar, drawdown, totals, VaR and CVaR at 95 %, volatility."""
    rf = risk_free / periods
    rows = with_drawdown(series).where(F.col("n") >= MIN_PERFORMANCE)
    rows = rows.withColumn("cut", F.percentile("ret", F.lit(0.05)).over(Window.partitionBy("series_id")))
    x = F.col("ret") - rf
    down = F.sqrt(F.avg(F.pow(F.least(x, F.lit(0.0)), 2)))
    a = rows.groupBy("series_id").agg(
        F.count("*").alias("n_obs"),
        F.avg(x).alias("m"),
        F.stddev_samp("ret").alias("sd"),
        down.alias("down"),
        F.min("dd").alias("dd"),
        F.max_by("equity", "pos").alias("eq"),
        F.abs(F.max("cut")).alias("var_95"),
        F.abs(F.avg(F.when(F.col("ret") <= F.col("cut"), F.col("ret")))).alias("cvar_95"),
    )
    ratio = F.coalesce(div(F.col("m"), F.col("sd")), F.lit(0.0))
    annual = F.when(F.col("eq") > 0, F.pow("eq", F.lit(float(periods)) / F.col("n_obs")) - 1).otherwise(-1.0)
    return a.select(
        "series_id",
        "n_obs",
        ratio.alias("sharpe"),
        (ratio * periods**0.5).alias("sharpe_annualized"),
        F.coalesce(div(F.col("m"), F.col("down")) * periods**0.5, F.lit(0.0)).alias("sortino"),
        F.when(F.col("dd") < 0, annual / F.abs("dd")).otherwise(0.0).alias("calmar"),
        (F.abs("dd") * 100).alias("max_drawdown_pct"),
        ((F.col("eq") - 1) * 100).alias("total_return_pct"),
        (annual * 100).alias("annualized_return_pct"),
        "var_95",
        "cvar_95",
        (F.col("sd") * periods**0.5 * 100).alias("volatility_pct"),
    )



def _tailed(series: DataFrame) -> DataFrame:
    return _clean(series).withColumn("tail", F.col("n") - F.col("pos"))


def benchmark_report(series: DataFrame, benchmark: DataFrame, risk_free: float = 0.0, periods: int = YEAR) -> DataFrame:
    """``series_id, n_obs, beta, alpha_pct, information_ratio`` against one benchmark series on the common tail (30 or more)."""
    b = _tailed(benchmark).select("tail", F.col("ret").alias("b"))
    j = _tailed(series).join(b, "tail")
    active = F.col("ret") - F.col("b")
    rf = risk_free / periods
    beta = F.coalesce(div(F.covar_samp("ret", "b"), F.var_samp("b")), F.lit(0.0))
    r = j.groupBy("series_id").agg(
        F.count("*").alias("n_obs"), beta.alias("beta"), F.avg(F.col("ret") - rf).alias("ma"), F.avg(F.col("b") - rf).alias("mb"), F.coalesce(sharpe(active, periods), F.lit(0.0)).alias("information_ratio")
    )
    return r.where(F.col("n_obs") >= MIN_PERFORMANCE).select("series_id", "n_obs", "beta", ((F.col("ma") - F.col("beta") * F.col("mb")) * periods * 100).alias("alpha_pct"), "information_ratio")


def var_cvar(series: DataFrame, confidence: float = 0.95, horizon: int = 1, value: float = 1e5) -> DataFrame:
    """Value at risk as positive losses in percent: Gaussian, Cornish-Fisher (Gaussian where that isn't positive), historical, and CVaR."""
    z = NormalDist().inv_cdf(confidence)
    root = horizon**0.5
    rows = _clean(series).where(F.col("n") >= MIN_RISK)
    rows = rows.withColumn("cut", F.percentile("ret", F.lit(1 - confidence)).over(Window.partitionBy("series_id")))
    n = F.count("*")
    a = rows.groupBy("series_id").agg(
        n.alias("n_obs"),
        F.stddev_samp("ret").alias("sd"),
        (F.skewness("ret") * F.pow((n - 1) / n, 1.5)).alias("skewness"),
        ((F.kurtosis("ret") + 3) * F.pow((n - 1) / n, 2) - 3).alias("excess_kurtosis"),
        F.max("cut").alias("cut"),
        F.avg(F.when(F.col("ret") <= F.col("cut"), F.col("ret"))).alias("tail"),
        F.count_if(F.col("ret") <= F.col("cut")).alias("tail_observations"),
    )
    s, k = F.col("skewness"), F.col("excess_kurtosis")
    zcf = F.lit(z) + (z * z - 1) * s / 6 + (z**3 - 3 * z) * k / 24 - (2 * z**3 - 5 * z) * s * s / 36
    eff = F.when(F.coalesce(zcf, F.lit(0.0)) > 0, zcf).otherwise(z)
    return a.select(
        "series_id",
        "n_obs",
        (z * root * F.col("sd") * 100).alias("parametric_var_pct"),
        (z * root * F.col("sd") * value).alias("parametric_var_value"),
        (F.col("sd") * 100).alias("volatility_pct"),
        (eff * root * F.col("sd") * 100).alias("cornish_fisher_var_pct"),
        (F.coalesce(zcf, F.lit(0.0)) <= 0).alias("gaussian_fallback"),
        "skewness",
        "excess_kurtosis",
        (F.abs("cut") * root * 100).alias("historical_var_pct"),
        (F.abs("tail") * 100).alias("cvar_pct"),
        "tail_observations",
    )


def var_bootstrap(series: DataFrame, confidence: float = 0.95, samples: int = 1000, seed: int = 42) -> DataFrame:
    """``series_id, ci_low_pct, ci_high_pct``: 95 % interval of the historical VaR by resampling, one generator per series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("pos")["ret"].to_numpy("float64")
        if len(x) < MIN_RISK:
            return pd.DataFrame({"series_id": [], "ci_low_pct": [], "ci_high_pct": []})
        rng = np.random.default_rng(seed)
        quantiles = [np.percentile(x[rng.integers(0, len(x), len(x))], (1 - confidence) * 100) for _ in range(samples)]  # one resample at a time
        lo, hi = np.abs(np.percentile(quantiles, [2.5, 97.5])) * 100
        return pd.DataFrame({"series_id": [pdf["series_id"].iloc[0]], "ci_low_pct": [min(lo, hi)], "ci_high_pct": [max(lo, hi)]})

    return _clean(series).groupBy("series_id").applyInPandas(run, "series_id string, ci_low_pct double, ci_high_pct double")


def subperiod_stability(series: DataFrame, segments: int = 4) -> DataFrame:
    """``series_id, segment, sharpe, pnl, share_in_best, worst_sharpe``; nothing below 20 returns a segment."""
    k = min(max(int(segments), 2), 12)
    rows = _clean(series).where(F.col("n") >= k * MIN_SEGMENT).withColumn("segment", array_split_segment(F.col("pos"), F.col("n"), k).cast("int"))
    seg = rows.groupBy("series_id", "segment").agg(sharpe(F.col("ret")).alias("sharpe"), F.sum("ret").alias("pnl"))
    w = Window.partitionBy("series_id")
    worst = F.when(F.count("sharpe").over(w) == F.count("*").over(w), F.min("sharpe").over(w))
    return seg.select("*", div(F.max("pnl").over(w), F.sum(F.abs("pnl")).over(w)).alias("share_in_best"), worst.alias("worst_sharpe"))


def cost_ladder(series: DataFrame, turnover: float, levels: tuple[float, ...] = (0, 5, 10, 25, 50)) -> DataFrame:
    """``series_id, bps, sharpe, dies``: Sharpe after costs of turnover times level; the first level at or below zero dies.

    A constant cost leaves the deviation as it is, so one aggregation serves all levels.
    """
    a = _clean(series).groupBy("series_id").agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("sd"))
    steps = F.explode(F.array(*[F.lit(float(b)) for b in sorted({round(float(b), 4) for b in levels})]))
    r = a.select("series_id", "m", "sd", steps.alias("bps")).withColumn("sharpe", div(F.col("m") - turnover * F.col("bps") / 1e4, F.col("sd")) * YEAR**0.5)
    first = F.min(F.when(F.col("sharpe") <= 0, F.col("bps"))).over(Window.partitionBy("series_id"))
    return r.select("series_id", "bps", "sharpe", F.coalesce(F.col("bps") == first, F.lit(False)).alias("dies"))


def drawdown_anatomy(series: DataFrame) -> DataFrame:
    """``series_id, n_obs, max_drawdown_pct, longest_underwater, n_over_10pct, time_underwater_share`` by gaps and islands."""
    d = with_drawdown(series).where("n >= 2")
    w = Window.partitionBy("series_id").orderBy("pos")
    d = d.withColumn("island", F.sum((F.col("dd") >= 0).cast("int")).over(w))
    spells = d.groupBy("series_id", "island").agg(F.count_if(F.col("dd") < 0).alias("k"), F.min("dd").alias("low"), F.count("*").alias("m"))
    return spells.groupBy("series_id").agg(
        F.sum("m").alias("n_obs"), (-F.min("low") * 100).alias("max_drawdown_pct"), F.max("k").alias("longest_underwater"), F.count_if(F.col("low") <= -0.10).alias("n_over_10pct"), (F.sum("k") / F.sum("m")).alias("time_underwater_share")
    )


def overlap(candidate: DataFrame, book: DataFrame) -> DataFrame:
    """``series_id, n_obs, correlation, beta``: each candidate series against one book series on the common tail of 20 or more."""
    b = _tailed(book).select("tail", F.col("ret").alias("b"))
    r = _tailed(candidate).join(b, "tail").groupBy("series_id").agg(F.count("*").alias("n_obs"), safe_corr(F.col("ret"), F.col("b")).alias("c"), F.when(F.stddev_pop("ret") > 0, div(F.covar_samp("ret", "b"), F.var_samp("b"))).alias("be"))
    enough = F.col("n_obs") >= MIN_OVERLAP
    return r.select("series_id", "n_obs", F.when(enough, F.col("c")).alias("correlation"), F.when(enough, F.col("be")).alias("beta"))


def rolling_overlap(candidate: DataFrame, book: DataFrame) -> DataFrame:
    """``series_id, pos, correlation`` over windows of max(20, depth // 4), where the common tail is at least two windows long."""
    b = _tailed(book).select("tail", F.col("ret").alias("b"))
    j = _tailed(candidate).join(b, "tail")
    w = Window.partitionBy("series_id")
    j = j.select("series_id", "ret", "b", F.count("*").over(w).alias("depth"), (F.row_number().over(w.orderBy(F.desc("tail"))) - 1).alias("pos"))
    j = j.withColumn("size", F.greatest(F.lit(20), F.floor(F.col("depth") / 4)).cast("int")).where(F.col("depth") >= 2 * F.col("size"))
    # windows whose size differs by series: running sums, differences of two of them (values centred first)
    c = j.select("series_id", "pos", "size", (F.col("ret") - F.avg("ret").over(w)).alias("x"), (F.col("b") - F.avg("b").over(w)).alias("y"))
    run = w.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = {"sx": F.col("x"), "sy": F.col("y"), "sxx": F.col("x") * F.col("x"), "syy": F.col("y") * F.col("y"), "sxy": F.col("x") * F.col("y")}
    c = c.select("series_id", "pos", "size", *[F.sum(v).over(run).alias(k) for k, v in sums.items()])
    past = c.select("series_id", (F.col("pos") + F.col("size")).alias("pos"), *[F.col(k).alias(f"p{k}") for k in sums])
    c = c.join(past, ["series_id", "pos"], "left").where(F.col("pos") >= F.col("size") - 1)
    s = {k: F.col(k) - F.coalesce(f"p{k}", F.lit(0.0)) for k in sums}
    m = F.col("size")
    cov, vx, vy = s["sxy"] - s["sx"] * s["sy"] / m, s["sxx"] - s["sx"] * s["sx"] / m, s["syy"] - s["sy"] * s["sy"] / m
    return c.select("series_id", "pos", F.when((vx > 0) & (vy > 0), div(cov, F.sqrt(vx * vy))).alias("correlation"))


def book_combine(sleeves: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """``pos, ret``: weighted mean of the sleeves on their common tail; a sleeve without a weight counts 1."""
    t = _tailed(sleeves)
    t = t.join(weights.select("series_id", "weight"), "series_id", "left") if weights is not None else t.withColumn("weight", F.lit(None).cast("double"))
    depth = scalar(t.agg(F.min("n").alias("depth")))["depth"]
    t = t.withColumn("depth", depth).where("tail <= depth").withColumn("w", F.coalesce("weight", F.lit(1.0)))
    return t.groupBy((F.col("depth") - F.col("tail")).alias("pos")).agg(div(F.sum(F.col("w") * F.col("ret")), F.sum("w")).alias("ret"))


def book_overlap(sleeves: DataFrame) -> DataFrame:
    """``a, b, n_obs, correlation`` of every pair of sleeves on its common tail (20 or more); a book has a few sleeves by nature."""
    t = _tailed(sleeves).select("tail", "series_id", "ret")
    j = t.alias("x").join(t.alias("y"), (F.col("x.tail") == F.col("y.tail")) & (F.col("x.series_id") < F.col("y.series_id")))
    r = j.groupBy(F.col("x.series_id").alias("a"), F.col("y.series_id").alias("b")).agg(F.count("*").alias("n_obs"), safe_corr(F.col("x.ret"), F.col("y.ret")).alias("c"))
    return r.select("a", "b", "n_obs", F.when(F.col("n_obs") >= MIN_OVERLAP, F.col("c")).alias("correlation"))


def ar1_effective_n(series: DataFrame) -> DataFrame:
    """``series_id, n_obs, r1, n_effective``: observations discounted for serial correlation, never more than there are."""
    rows = _clean(series).withColumn("prev", F.lag("ret").over(Window.partitionBy("series_id").orderBy("pos")))
    r1 = F.coalesce(safe_corr(F.when(F.col("prev").isNotNull(), F.col("ret")), F.col("prev")), F.lit(0.0))
    a = rows.groupBy("series_id").agg(F.count("ret").alias("n_obs"), r1.alias("r1"))
    r = F.when(F.col("n_obs") < 3, 0.0).otherwise(F.col("r1"))
    eff = F.when(r > -0.999, div(F.col("n_obs") * (1 - r), 1 + r)).otherwise(F.col("n_obs").cast("double"))
    return a.select("series_id", "n_obs", r.alias("r1"), F.greatest(F.lit(1.0), F.least(F.col("n_obs").cast("double"), eff)).alias("n_effective"))


def sketch(series: DataFrame, value: str = "ret", points: int = 256, how: str = "last") -> DataFrame:
    """``series_id, bucket, i, v``: at most ``points`` position buckets, each by its last (or least) value."""
    w = Window.partitionBy("series_id")
    rows = series.where(F.col(value).isNotNull()).select("series_id", F.col(value).alias("v"), (F.row_number().over(w.orderBy("pos")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    rows = rows.withColumn("bucket", bucket_of(F.col("i"), F.col("n"), F.least("n", F.lit(points))))
    v = F.max_by("v", "i") if how == "last" else F.min("v")
    return rows.groupBy("series_id", "bucket").agg(F.max("i").alias("i"), v.alias("v"))
