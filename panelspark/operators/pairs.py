"""Pairs: hedge ratio, spread, half-life, stability, cointegration test, and a screen over all names.

Everything of a pair but the unit-root test is aggregates over the joined legs, so one job serves every pair. Pairs
of names are formed on the names (a list of symbols), and prices join on the date; the test, the only step in
Python, runs on the pairs that pass half-life and stability.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.exprs import div, scalar

MIN_OBS, STABILITY_WINDOW, ZSCORE_WINDOW, TWIN, COMOVEMENT = 126, 60, 60, 0.99, 0.5

# --- fixed values: MacKinnon's response surface for the unit-root test with a constant (published) ------------------
TAU_STAR, TAU_MIN, TAU_MAX = -1.61, -18.83, 2.74
SMALL_P = (2.1659, 1.4412, 0.038269)
LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
# ----------------------------------------------------------------------------------------------------------------


def pair_legs(prices: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``a, b, pos, la, lb``: log closes of each unordered pair of names on their common dates; only positive closes."""
    p = prices.where("close > 0").select("symbol", "ts", F.ln("close").alias("l"))
    if names is not None:
        p = p.join(names.select("symbol"), "symbol", "left_semi")
    x, y = p.toDF("a", "ts", "la"), p.toDF("b", "ts", "lb")
    j = x.join(y, "ts").where("a < b")
    return j.withColumn("pos", F.row_number().over(Window.partitionBy("a", "b").orderBy("ts")) - 1)


def hedge_ratios(legs: DataFrame) -> DataFrame:
    """``a, b, n, hedge_ratio``: total least squares slope of log a on log b in closed form; null where there is none."""
    m = legs.groupBy("a", "b").agg(F.count("*").alias("n"), F.var_pop("la").alias("saa"), F.var_pop("lb").alias("sbb"), F.covar_pop("la", "lb").alias("sab"))
    d = F.col("saa") - F.col("sbb")
    slope = div(d + F.sqrt(d * d + 4 * F.col("sab") * F.col("sab")), 2 * F.col("sab"))
    return m.select("a", "b", "n", F.when((F.col("sab") != 0) & (F.col("sbb") > 1e-24), slope).alias("hedge_ratio"))


def spreads(legs: DataFrame, ratios: DataFrame | None = None) -> DataFrame:
    """The legs with ``spread``, log a less the hedge ratio times log b."""
    r = (ratios if ratios is not None else hedge_ratios(legs)).select("a", "b", "hedge_ratio")
    return legs.join(r, ["a", "b"]).withColumn("spread", F.col("la") - F.col("hedge_ratio") * F.col("lb"))


def half_lives(spread: DataFrame) -> DataFrame:
    """``a, b, half_life`` from the regression of the change on the level before; null if it isn't mean-reverting or below 30."""
    lagged = spread.withColumn("s", F.lag("spread").over(Window.partitionBy("a", "b").orderBy("pos"))).where("s IS NOT NULL")
    dy = F.col("spread") - F.col("s")
    m = lagged.groupBy("a", "b").agg(F.count("*").alias("n"), div(F.covar_pop("s", dy), F.var_pop("s")).alias("slope"))
    return m.select("a", "b", F.when((F.col("slope") < 0) & (F.col("n") >= 29), -math.log(2) / F.col("slope")).alias("half_life"))


def stability(legs: DataFrame, window: int = STABILITY_WINDOW) -> DataFrame:
    """``a, b, stability, mean_corr, std_corr, n_windows``: one less the deviation of rolling correlations of returns, in [0, 1].

    Windows end before the last return, and at least five of them must exist.
    """
    w = Window.partitionBy("a", "b").orderBy("pos")
    r = legs.select("a", "b", "pos", (F.col("la") - F.lag("la").over(w)).alias("x"), (F.col("lb") - F.lag("lb").over(w)).alias("y")).where("x IS NOT NULL")
    f = w.rowsBetween(1 - window, 0)
    r = r.select("*", F.count("*").over(Window.partitionBy("a", "b")).alias("n"), F.row_number().over(w).alias("k"), F.covar_pop("x", "y").over(f).alias("c"), F.stddev_pop("x").over(f).alias("sx"), F.stddev_pop("y").over(f).alias("sy"))
    r = r.where((F.col("k") >= window) & (F.col("k") < F.col("n")) & (F.col("n") >= window + 5))
    m = r.groupBy("a", "b").agg(F.avg(div(F.col("c"), F.col("sx") * F.col("sy"))).alias("mean_corr"), F.stddev_samp(div(F.col("c"), F.col("sx") * F.col("sy"))).alias("std_corr"), F.count(div(F.col("c"), F.col("sx") * F.col("sy"))).alias("n_windows")).where("n_windows >= 5")
    return m.select("a", "b", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("std_corr"))).alias("stability"), "mean_corr", "std_corr", "n_windows")


def mackinnon_p(tau: float) -> float:
    if tau > TAU_MAX:
        return 1.0
    if tau < TAU_MIN:
        return 0.0
    c = SMALL_P if tau <= TAU_STAR else LARGE_P
    return NormalDist().cdf(sum(k * tau**i for i, k in enumerate(c)))


def _ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    inverse = np.linalg.pinv(x.T @ x)
    b = inverse @ (x.T @ y)
    e = y - x @ b
    return b, float(e @ e), inverse


def adf(x: np.ndarray) -> tuple[float, float, int]:
    """Augmented Dickey-Fuller test with a constant, lags by the Akaike criterion: statistic, p-value, lags."""
    n = len(x)
    most = max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2))
    d = np.diff(x)

    def design(lags: int, drop: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(drop, len(d))
        return d[rows], np.column_stack([x[rows], *[d[rows - k] for k in range(1, lags + 1)], np.ones(len(rows))])

    best, best_aic = 0, math.inf
    for lags in range(most + 1):
        y, z = design(lags, most)
        _, sse, _ = _ols(y, z)
        m = len(y)
        aic = m * math.log(max(sse, 1e-300) / m) + 2 * z.shape[1]
        if aic < best_aic - 1e-12:
            best, best_aic = lags, aic
    y, z = design(best, best)
    b, sse, inverse = _ols(y, z)
    se = math.sqrt(sse / (len(y) - z.shape[1]) * inverse[0, 0])
    tau = float(b[0] / se) if se > 0 else float("nan")
    return tau, mackinnon_p(tau), best


def adf_tests(spread: DataFrame) -> DataFrame:
    """``a, b, statistic, p_value, lags`` of each pair's spread of at least 30 values."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("pos")["spread"].to_numpy("float64")
        x = x[np.isfinite(x)]
        t, p, k = adf(x) if len(x) >= 30 and x.std() > 0 else (None, None, None)
        return pd.DataFrame({"a": [pdf["a"].iloc[0]], "b": [pdf["b"].iloc[0]], "statistic": [t], "p_value": [p], "lags": [k]})

    return spread.select("a", "b", "pos", "spread").groupBy("a", "b").applyInPandas(run, "a string, b string, statistic double, p_value double, lags int")


def pair_report(legs: DataFrame, significance: float = 0.05, max_half_life: float = 60.0, min_stability: float = 0.5, entry: float = 2.0, test_all: bool = True) -> DataFrame:
    """One row per pair: hedge ratio, half-life, stability, z-score of the last spread, test, flags and ``trade_signal``.

    With ``test_all`` false the test runs only on pairs that pass half-life and stability; others have no p-value.
    """
    ratios = hedge_ratios(legs).where((F.col("n") >= MIN_OBS) & F.col("hedge_ratio").isNotNull())
    s = spreads(legs, ratios)
    n = Window.partitionBy("a", "b")
    recent = s.withColumn("tail", F.count("*").over(n) - F.col("pos")).where(F.col("tail") <= ZSCORE_WINDOW)
    z = recent.groupBy("a", "b").agg(F.max_by("spread", "pos").alias("last"), F.avg("spread").alias("mu"), F.stddev_samp("spread").alias("sd"))
    z = z.select("a", "b", F.when(F.col("sd") > 1e-9, (F.col("last") - F.col("mu")) / F.col("sd")).alias("zscore"))
    r = ratios.join(half_lives(s), ["a", "b"], "left").join(stability(legs), ["a", "b"], "left").join(z, ["a", "b"], "left")
    r = r.withColumn("half_life_ok", F.coalesce((F.col("half_life") > 1) & (F.col("half_life") < max_half_life), F.lit(False))).withColumn("stable", F.coalesce(F.col("stability") > min_stability, F.lit(False)))
    tested = s if test_all else s.join(r.where("half_life_ok AND stable").select("a", "b"), ["a", "b"], "left_semi")
    r = r.join(adf_tests(tested), ["a", "b"], "left")
    r = r.withColumn("redundant", F.coalesce(F.abs("mean_corr") >= TWIN, F.lit(False))).withColumn("low_comovement", F.coalesce(F.abs("mean_corr") < COMOVEMENT, F.lit(False)))
    r = r.withColumn("cointegrated", F.coalesce(F.col("p_value") < significance, F.lit(False)) & F.col("half_life_ok") & F.col("stable") & ~F.col("redundant"))
    signal = F.when(F.col("cointegrated") & (F.col("zscore") > entry), "short_spread").when(F.col("cointegrated") & (F.col("zscore") < -entry), "long_spread").otherwise("hold")
    return r.withColumn("trade_signal", signal)


def screen_pairs(prices: DataFrame, names: DataFrame | None = None, significance: float = 0.05) -> DataFrame:
    """Every pair of the names, by p-value, with ``expected_false``, the false positives that so many tests would give by chance."""
    r = pair_report(pair_legs(prices, names), significance)
    return r.withColumn("expected_false", scalar(r.agg(F.count("p_value").alias("n")))["n"] * significance)
