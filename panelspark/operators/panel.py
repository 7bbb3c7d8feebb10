"""Cross-sectional transforms of a panel ``symbol, ts, value`` and statistics of what comes of them.

A value that could not be measured is null and stays null; a date with too few values gives nulls, never zeros.
Dates are the groups here, so a window holds one row per name and date.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.exprs import safe_corr, scalar


def _date(by: str):
    return Window.partitionBy(by)


def cs_rank(panel: DataFrame, value: str = "value", by: str = "ts") -> DataFrame:
    """Adds ``rank`` from 0 within each date, ties by symbol; null where the value is, or where a date has fewer than two."""
    w = Window.partitionBy(by, F.col(value).isNull()).orderBy(value, "symbol")
    r = F.row_number().over(w) - 1
    return panel.withColumn("rank", F.when(F.col(value).isNotNull() & (F.count(value).over(_date(by)) >= 2), r))


def cs_zscore(panel: DataFrame, value: str = "value", by: str = "ts") -> DataFrame:
    """Adds ``zscore`` with the sample deviation; null on dates of fewer than three values or without spread."""
    w = _date(by)
    sd = F.stddev_samp(value).over(w)
    z = F.try_divide(F.col(value) - F.avg(value).over(w), sd)
    return panel.withColumn("zscore", F.when(F.count(value).over(w) >= 3, z))


def cs_winsorize(panel: DataFrame, lower: float = 0.01, upper: float = 0.99, value: str = "value", by: str = "ts") -> DataFrame:
    """Adds ``winsorized``, clipped to each date's linear quantiles; null on dates of fewer than three values."""
    lo, hi = sorted((min(max(lower, 0.0), 1.0), min(max(upper, 0.0), 1.0)))
    w = _date(by)
    clipped = F.greatest(F.least(F.col(value), F.percentile(value, hi).over(w)), F.percentile(value, lo).over(w))
    return panel.withColumn("winsorized", F.when(F.col(value).isNotNull() & (F.count(value).over(w) >= 3), clipped))


def cs_neutralize(panel: DataFrame, controls: list[str] | None = None, value: str = "value", by: str = "ts") -> DataFrame:
    """Adds ``residual`` of the value on the controls and a constant, date by date.

    A date with no more values than regressors is null throughout. One control is a closed form of window
    aggregates; two or more solve least squares per date, a group of one row per name (minimum norm if collinear).
    """
    controls = controls or []
    ok = F.col(value).isNotNull()
    for c in controls:
        ok = ok & F.col(c).isNotNull()
    w = _date(by)
    v = F.when(ok, F.col(value))
    enough = F.count(v).over(w) > len(controls) + 1
    if not controls:
        return panel.withColumn("residual", F.when(ok & enough, F.col(value) - F.avg(v).over(w)))
    if len(controls) == 1:
        x = F.when(ok, F.col(controls[0]))
        mx, mv = F.avg(x).over(w), F.avg(v).over(w)
        slope = F.coalesce(F.try_divide(F.covar_pop(x, v).over(w), F.var_pop(x).over(w)), F.lit(0.0))
        return panel.withColumn("residual", F.when(ok & enough, v - mv - slope * (x - mx)))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf[[value, *controls]].to_numpy("float64")
        good = np.isfinite(m).all(axis=1)
        res = np.full(len(pdf), np.nan)
        if good.sum() > len(controls) + 1:
            a = np.column_stack([np.ones(good.sum()), m[good, 1:]])
            res[good] = m[good, 0] - a @ np.linalg.lstsq(a, m[good, 0], rcond=None)[0]
        return pdf.assign(residual=res)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in panel.schema.fields)
    return panel.groupBy(by).applyInPandas(solve, f"{kinds}, residual double").withColumn("residual", F.nanvl("residual", F.lit(None).cast("double")))


def newey_west(series: DataFrame, value: str, lags: int = 1, by: str = "series_id", order: str = "pos") -> DataFrame:
    """One row per series: ``n, mean, t_stat`` with a Bartlett-weighted variance of the mean; null t where it isn't positive."""
    clean = series.where(F.col(value).isNotNull())
    w = Window.partitionBy(by)
    e = clean.select(by, order, (F.col(value) - F.avg(value).over(w)).alias("e"), F.col(value).alias("v"))
    at = w.orderBy(order)
    products = [F.sum(F.col("e") * F.col(f"e{k}")) for k in range(1, lags + 1)]
    lagged = e.select("*", *[F.lag("e", k).over(at).alias(f"e{k}") for k in range(1, lags + 1)])
    agg = lagged.groupBy(by).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.sum(F.col("e") * F.col("e")).alias("g0"), *[p.alias(f"g{k}") for k, p in enumerate(products, 1)])
    long_run = F.col("g0")
    for k in range(1, lags + 1):
        # lags beyond n - 1 have no products; the weights count the lags that are used
        used = F.least(F.lit(lags), F.col("n") - 1)
        weight = 1 - F.lit(float(k)) / (used + 1)
        long_run = long_run + F.when(F.lit(k) <= used, 2 * weight * F.coalesce(f"g{k}", F.lit(0.0))).otherwise(0.0)
    variance = F.try_divide(long_run, F.col("n") * F.col("n"))
    return agg.select(by, "n", "mean", F.when((F.col("n") > 1) & (variance > 0), F.try_divide("mean", F.sqrt(variance))).alias("t_stat"))


def grinold_alpha(panel: DataFrame, ic: float, vols: DataFrame | None = None, value: str = "value", by: str = "ts") -> DataFrame:
    """``symbol, zscore, vol, alpha`` on the last date: information coefficient times volatility times score; a missing volatility is 1."""
    last = scalar(panel.agg(F.max(by).alias("last")))["last"]
    z = cs_zscore(panel, value, by).where(F.col(by) == last)
    z = z.join(vols.select("symbol", "vol"), "symbol", "left") if vols is not None else z.withColumn("vol", F.lit(None).cast("double"))
    vol = F.coalesce(F.abs("vol"), F.lit(1.0))
    return z.where("zscore IS NOT NULL").select("symbol", "zscore", vol.alias("vol"), (F.lit(float(ic)) * vol * F.col("zscore")).alias("alpha"))


def breadth_ir(ic: float, n_names: int, holdings: DataFrame | None = None, ideal: DataFrame | None = None, spark=None) -> DataFrame:
    """One row ``transfer, breadth, information_ratio``; transfer is the correlation of held and ideal weights on common names."""
    if holdings is None or ideal is None:
        t = spark.range(1).select(F.lit(1.0).alias("transfer"))
    else:
        both = holdings.select("symbol", F.col("weight").alias("h")).join(ideal.select("symbol", F.col("weight").alias("i")), "symbol")
        t = both.agg(F.coalesce(safe_corr(F.col("h"), F.col("i")), F.lit(0.0)).alias("transfer"))
    return t.select("transfer", F.lit(int(n_names)).cast("bigint").alias("breadth"), (F.col("transfer") * ic * float(n_names) ** 0.5).alias("information_ratio"))




TRANSFORMS = {"rank": cs_rank, "zscore": cs_zscore, "winsorize": cs_winsorize, "neutralize": cs_neutralize}


def panel_transform(panel: DataFrame, method: str = "zscore", **parameters) -> DataFrame:
    """A cross-sectional transform by name."""
    if method not in TRANSFORMS:
        raise ValueError(f"no transform {method!r}; there are {', '.join(TRANSFORMS)}")
    return TRANSFORMS[method](panel, **parameters)
