"""How well a signal orders what follows: information coefficients, quantile spreads, decay, cross-sectional regressions.

The two panels are aligned from the end (rule B). Periods don't overlap: t = 0, h, 2h, ... counted from the oldest end.
A period that can't be measured (fewer than eight names, or no spread) is no period, never a zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.exprs import safe_corr
from panelspark.operators.panel import newey_west
from panelspark.plans.panels import align_tail, forward_return

MIN_NAMES = 8


def _periods(signal: DataFrame, prices: DataFrame, horizon: int) -> DataFrame:
    rows, _ = align_tail(signal, prices, need=horizon + 1)
    rows = forward_return(rows, horizon)
    return rows.where((F.col("t") % horizon == 0) & (F.col("t") < F.col("depth") - horizon) & F.col("value").isNotNull() & F.col("fwd").isNotNull())


def _ranked(rows: DataFrame, by: tuple[str, ...] = ("t",)) -> DataFrame:
    w = Window.partitionBy(*by)
    rank = lambda c: F.row_number().over(w.orderBy(c, "symbol")) - 1
    return rows.select("*", rank("value").alias("rv"), rank("fwd").alias("rf"), F.count(F.lit(1)).over(w).alias("m"))


def period_ics(signal: DataFrame, prices: DataFrame, horizon: int = 21, method: str = "spearman") -> DataFrame:
    """``t, ic, n_names`` per period; spearman correlates ranks with ties by symbol, pearson the values."""
    rows = _ranked(_periods(signal, prices, horizon))
    a, b = ("rv", "rf") if method == "spearman" else ("value", "fwd")
    spread = (F.stddev_pop("value") > 0) & (F.stddev_pop("fwd") > 0)
    ics = rows.groupBy("t").agg(F.count("*").alias("n_names"), F.when(spread, safe_corr(F.col(a).cast("double"), F.col(b).cast("double"))).alias("ic"))
    return ics.where(F.col("ic").isNotNull() & (F.col("n_names") >= MIN_NAMES)).select("t", "ic", "n_names")


def information_coefficient(signal: DataFrame, prices: DataFrame, horizon: int = 21) -> DataFrame:
    """One row: ``n_periods, mean_ic, ic_t_stat``; the ordinary t with the sample deviation, null where there is none."""
    t = F.try_divide(F.avg("ic"), F.stddev_samp("ic")) * F.sqrt(F.count("ic"))
    return period_ics(signal, prices, horizon).agg(F.count("ic").alias("n_periods"), F.avg("ic").alias("mean_ic"), t.alias("ic_t_stat"))


def signal_icir(signal: DataFrame, prices: DataFrame, horizon: int = 21, method: str = "spearman") -> DataFrame:
    """One row: ``n_periods, mean_ic, ic_std, icir, nw_t_stat``; icir is mean over deviation times the root of periods."""
    ics = period_ics(signal, prices, horizon, method).withColumn("series_id", F.lit(1))
    nw = newey_west(ics, "ic", 1, order="t").select("series_id", F.col("t_stat").alias("nw_t_stat"))
    icir = F.try_divide(F.avg("ic"), F.stddev_samp("ic")) * F.sqrt(F.count("ic"))
    own = ics.groupBy("series_id").agg(F.count("ic").alias("n_periods"), F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("ic_std"), icir.alias("icir"))
    return own.join(nw, "series_id", "left").drop("series_id")


def _bucketed(signal: DataFrame, prices: DataFrame, horizon: int, quantiles: int) -> DataFrame:
    q = min(max(int(quantiles), 2), 10)
    rows = _ranked(_periods(signal, prices, horizon)).where(F.col("m") >= max(MIN_NAMES, q))
    return rows.withColumn("bucket", F.least(F.floor(F.col("rv") / F.col("m") * q), F.lit(q - 1)).cast("int"))


def quantile_returns(signal: DataFrame, prices: DataFrame, horizon: int = 21, quantiles: int = 5) -> DataFrame:
    """``bucket, mean_return_pct, n_periods``: each period's mean per bucket of the signal, averaged over periods."""
    rows = _bucketed(signal, prices, horizon, quantiles)
    per = rows.groupBy("t", "bucket").agg(F.avg("fwd").alias("r"))
    return per.groupBy("bucket").agg((F.avg("r") * 100).alias("mean_return_pct"), F.count("r").alias("n_periods"))


def signal_decay(signal: DataFrame, prices: DataFrame, horizons: tuple[int, ...] = (1, 5, 21, 63)) -> DataFrame:
    """``horizon, mean_ic, n_periods, is_half_life``: the first later horizon at which the coefficient has halved is marked."""
    out = None
    for h in horizons:  # each horizon has its own alignment, so its own small plan
        one = period_ics(signal, prices, h).agg(F.avg("ic").alias("mean_ic"), F.count("ic").alias("n_periods")).select(F.lit(h).alias("horizon"), "mean_ic", "n_periods")
        out = one if out is None else out.unionByName(one)
    w = Window.partitionBy(F.lit(1)).orderBy("horizon")  # as many rows as horizons
    halved = (F.abs("mean_ic") <= F.abs(F.first("mean_ic").over(w)) / 2) & (F.row_number().over(w) > 1)
    marked = out.withColumn("h", F.coalesce(halved, F.lit(False)))
    before = F.sum(F.col("h").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return marked.select("horizon", "mean_ic", "n_periods", (F.col("h") & (F.coalesce(before, F.lit(0)) == 0)).alias("is_half_life"))


def fama_macbeth(signal: DataFrame, prices: DataFrame, horizon: int = 21) -> DataFrame:
    """One row: ``n_periods, n_skipped, mean_slope, t_stat, nw_t_stat, mean_r2`` of per-period regressions with a constant."""
    rows = _periods(signal, prices, horizon)
    x, y = F.col("value"), F.col("fwd")
    sxy, sxx, syy = F.covar_pop(x, y), F.var_pop(x), F.var_pop(y)
    per = rows.groupBy("t").agg(F.count("*").alias("m"), F.try_divide(sxy, sxx).alias("slope"), F.coalesce(F.try_divide(sxy * sxy, sxx * syy), F.lit(0.0)).alias("r2"))
    good = (F.col("m") >= MIN_NAMES) & F.col("slope").isNotNull()
    per = per.select("t", F.when(good, F.col("slope")).alias("slope"), F.when(good, F.col("r2")).alias("r2"), F.lit(1).alias("series_id"))
    nw = newey_west(per, "slope", 1, order="t").select("series_id", F.col("t_stat").alias("nw_t_stat"))
    t = F.try_divide(F.avg("slope"), F.stddev_samp("slope")) * F.sqrt(F.count("slope"))
    own = per.groupBy("series_id").agg(
        F.count("slope").alias("n_periods"), F.count_if(F.col("slope").isNull()).alias("n_skipped"), F.avg("slope").alias("mean_slope"), t.alias("t_stat"), F.avg("r2").alias("mean_r2")
    )
    return own.join(nw, "series_id", "left").drop("series_id")


def quantile_book(signal: DataFrame, prices: DataFrame, horizon: int = 21, quantiles: int = 5) -> DataFrame:
    """``t, spread, turnover``: top bucket long, bottom short, equally weighted; one-way turnover from the period before."""
    q = min(max(int(quantiles), 2), 10)
    rows = _bucketed(signal, prices, horizon, q)
    w = Window.partitionBy("t", "bucket")
    weight = F.when(F.col("bucket") == q - 1, 1 / F.count("*").over(w)).when(F.col("bucket") == 0, -1 / F.count("*").over(w)).otherwise(0.0)
    held = rows.select("t", "symbol", "fwd", weight.alias("w"))
    spread = held.groupBy("t").agg(F.sum(F.col("w") * F.col("fwd")).alias("spread"))
    # turnover over the periods that are included, names absent from one of two neighbours counting as weight zero there
    order = spread.select("t", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("t")).alias("k"))  # one row a period
    legs = held.where("w <> 0").join(order, "t").select("k", "symbol", "w")
    moves = legs.unionByName(legs.select((F.col("k") + 1).alias("k"), "symbol", (-F.col("w")).alias("w"))).groupBy("k", "symbol").agg(F.sum("w").alias("d"))
    turn = moves.groupBy("k").agg((F.sum(F.abs("d")) / 2).alias("turnover")).join(order.where("k > 1"), "k").select("t", "turnover")
    return spread.join(turn, "t", "left").select("t", "spread", "turnover")
