"""Technical features at the last bar of each series, as closed forms: no loop over bars, one aggregation per symbol.

Exponential and Wilder smoothing are weighted sums with weights that depend on the position alone, so they are
ordinary aggregates. A feature whose series is too short is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.exprs import wilder_weight
from panelspark.plans.panels import positions


def _deltas(panel: DataFrame) -> DataFrame:
    """Positions plus the change and the true range of each bar."""
    p = positions(panel.where("close IS NOT NULL"))
    w = Window.partitionBy("symbol").orderBy("pos")
    p = p.withColumn("prev", F.lag("close").over(w)).withColumn("delta", F.col("close") - F.col("prev"))
    if "high" not in panel.columns:
        return p
    return p.withColumn("tr", F.when(F.col("prev").isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("prev")), F.abs(F.col("low") - F.col("prev")))))


def sma(window: int) -> Column:
    return F.when(F.count("close") >= window, F.avg(F.when(F.col("tail_pos") <= window, F.col("close"))))


def ema(window: int) -> Column:
    """Seeded by the mean of the first ``window`` closes, then smoothed by 2 / (window + 1)."""
    a = 2.0 / (window + 1)
    k = F.col("n") - 1 - F.col("pos")  # bars since
    weight = F.when(F.col("pos") < window, F.pow(F.lit(1 - a), F.col("n") - window) / window).otherwise(a * F.pow(F.lit(1 - a), k))
    return F.when(F.count("close") >= window, F.sum(weight * F.col("close")))


def _wilder(value: Column, window: int) -> Column:
    return F.sum(value * wilder_weight(F.col("pos"), F.col("n") - 1, window))


def rsi(window: int = 14) -> Column:
    up, down = _wilder(F.greatest("delta", F.lit(0.0)), window), _wilder(F.greatest(-F.col("delta"), F.lit(0.0)), window)
    value = F.when((down == 0) & (up == 0), 50.0).when(down == 0, 100.0).otherwise(100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(up, down)))
    return F.when(F.count("close") >= window + 1, value)


def atr(window: int = 14) -> Column:
    return F.when((F.count("close") >= window + 1) & (F.count("tr") == F.count("close") - 1), _wilder(F.col("tr"), window))


def last_close() -> Column:
    return F.max(F.when(F.col("tail_pos") == 1, F.col("close")))


def technical_features(
    panel: DataFrame, sma_windows: tuple[int, ...] = (50, 150, 200), ema_windows: tuple[int, ...] = (), rsi_window: int = 14, atr_window: int = 14
) -> DataFrame:
    """One row per symbol: last close, each average with whether the close is above it and by how many percent, RSI, ATR,
    ``flags`` (above_sma_W, rsi_overbought, rsi_oversold) and ``insufficient``, the names of what couldn't be computed."""
    p = _deltas(panel)
    parts = {f"sma_{w}": sma(w) for w in sma_windows} | {f"ema_{w}": ema(w) for w in ema_windows} | {f"rsi_{rsi_window}": rsi(rsi_window)}
    if "high" in panel.columns:
        parts[f"atr_{atr_window}"] = atr(atr_window)
    r = p.groupBy("symbol").agg(F.count("close").alias("n_observations"), last_close().alias("last_close"), *[c.alias(k) for k, c in parts.items()])
    averages = [k for k in parts if k[1:3] == "ma"]
    above = [(F.col("last_close") > F.col(k)).alias(f"above_{k}") for k in averages]
    distance = [(F.try_divide(F.col("last_close") - F.col(k), F.col(k)) * 100).alias(f"distance_{k}_pct") for k in averages]
    r = r.select("*", *above, *distance)
    rs = F.col(f"rsi_{rsi_window}")
    flags = [F.when(F.col(f"above_{k}"), F.lit(f"above_{k}")) for k in averages] + [F.when(rs >= 70, F.lit("rsi_overbought")), F.when(rs <= 30, F.lit("rsi_oversold"))]
    missing = [F.when(F.col(k).isNull(), F.lit(k)) for k in parts]
    return r.select("*", F.array_compact(F.array(*flags)).alias("flags"), F.array_compact(F.array(*missing)).alias("insufficient"))
