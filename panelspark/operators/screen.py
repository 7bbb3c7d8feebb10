"""Screening a universe: metrics, range filters with three outcomes, a ranking, and coverage counts that close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.technical import _deltas, rsi, sma

METRICS = ("rsi", "return_pct", "distance_from_sma_pct", "volatility_pct")
MAX_ROWS = 50  # fixed value: the longest shortlist
PERIODS_PER_YEAR = 252


class UnknownMetric(ValueError):
    """A metric outside ``METRICS``."""


def _check(*names: str) -> None:
    for n in names:
        if n not in METRICS:
            raise UnknownMetric(f"{n!r} is none of {', '.join(METRICS)}")


def screen_metrics(prices: DataFrame, rsi_window: int = 14, sma_window: int = 200, return_lookback: int = 63, vol_lookback: int = 63) -> DataFrame:
    """``symbol, n_observations, last_close`` and the metrics, rounded as they are ranked (RSI to 4 places, others to 6)."""
    p = _deltas(prices).withColumn("r", F.try_divide("delta", "prev"))
    ago = lambda k: F.max(F.when(F.col("tail_pos") == k, F.col("close")))
    start, last, mean = ago(return_lookback + 1), ago(1), sma(sma_window)
    recent = F.col("tail_pos") <= vol_lookback
    zero = F.count_if(recent & (F.col("prev") == 0)) > 0
    vol = F.when((F.count("close") >= vol_lookback + 1) & ~zero, F.stddev_samp(F.when(recent, F.col("r"))) * (PERIODS_PER_YEAR**0.5) * 100)
    return p.groupBy("symbol").agg(
        F.count("close").alias("n_observations"),
        F.round(last, 6).alias("last_close"),
        F.round(rsi(rsi_window), 4).alias("rsi"),
        F.round(F.try_divide(last - start, start) * 100, 6).alias("return_pct"),
        F.round(F.try_divide(last - mean, mean) * 100, 6).alias("distance_from_sma_pct"),
        F.round(vol, 6).alias("volatility_pct"),
    )


def passes(filters: dict[str, dict[str, float]]) -> Column:
    """True, false or null (undetermined), the filters in their given order: the first that is missing or out of range decides."""
    out = F.lit(True)
    for metric, bound in reversed(list(filters.items())):
        bad = F.lit(False)
        if bound.get("min") is not None:
            bad = bad | (F.col(metric) < float(bound["min"]))
        if bound.get("max") is not None:
            bad = bad | (F.col(metric) > float(bound["max"]))
        out = F.when(F.col(metric).isNull(), F.lit(None).cast("boolean")).when(bad, False).otherwise(out)
    return out


def screen_universe(prices: DataFrame, rank_by: str = "return_pct", descending: bool = True, top_n: int = 20, filters: dict | None = None, **windows: int) -> tuple[DataFrame, DataFrame]:
    """``(rows, coverage)``: the ranked shortlist (at most 50), and one row of counts.

    ``universe_size = n_evaluated + n_insufficient`` and ``n_evaluated = n_passing + n_failing + n_undetermined``. Score and
    symbol are ordered in the same direction. Names come from ``prices``; one whose closes are all null is insufficient.
    """
    filters = filters or {}
    _check(rank_by, *filters)
    limit = int(top_n)
    if not 1 <= limit <= MAX_ROWS:
        raise ValueError(f"a shortlist holds 1 to {MAX_ROWS} names, not {top_n}")
    m = prices.select("symbol").distinct().join(screen_metrics(prices, **windows), "symbol", "left")
    m = m.withColumn("score", F.col(rank_by)).withColumn("passed", F.when(F.col("score").isNotNull(), passes(filters)))
    order = [F.col("score").desc(), F.col("symbol").desc()] if descending else [F.col("score").asc(), F.col("symbol").asc()]
    top = m.where("score IS NOT NULL AND passed").orderBy(*order).limit(limit)
    rows = top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))).drop("passed")  # at most 50 rows
    known = F.col("score").isNotNull()
    coverage = m.agg(
        F.count("*").alias("universe_size"),
        F.count_if(known).alias("n_evaluated"),
        F.count_if(~known).alias("n_insufficient"),
        F.count_if(known & F.col("passed")).alias("n_passing"),
        F.count_if(known & ~F.col("passed")).alias("n_failing"),
        F.count_if(known & F.col("passed").isNull()).alias("n_undetermined"),
    ).withColumn("n_returned", F.least("n_passing", F.lit(limit)))
    return rows, coverage
