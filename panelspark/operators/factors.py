"""Factor regression of a return series with autocorrelation-robust errors.

Cross products are aggregates over the rows; only the k by k systems are solved on the driver. Residuals and their
lagged products are computed where the rows are.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIN_OBS, LAGS, HIGH_VIF = 30, 5, 10.0


def _products(df: DataFrame, left: list, right: list) -> np.ndarray:
    row = df.agg(*[F.sum(a * b).alias(f"p{i}_{j}") for i, a in enumerate(left) for j, b in enumerate(right)]).first()
    return np.array(row, "float64").reshape(len(left), len(right))


def decompose(rows: DataFrame, factors: list[str], y: str = "ret", order: str = "pos", risk_free: float = 0.04, periods: int = 252) -> DataFrame:
    """``term, coefficient, std_error, t_stat, p_value, vif`` of the constant (``alpha``, per period) and each factor.

    ``rows`` holds the series and its factors side by side; rows with a null are left out. Errors are Newey-West with
    5 lags, p-values normal. Fewer than 30 rows raise; the summary is in :func:`fit_summary`.
    """
    clean = rows.select(order, F.col(y) - risk_free / periods, *factors).toDF("o", "y", *[f"x{i}" for i in range(len(factors))]).na.drop()
    x = [F.lit(1.0), *[F.col(f"x{i}") for i in range(len(factors))]]
    n = clean.count()
    if n < MIN_OBS:
        raise ValueError(f"{n} observations; a factor regression needs {MIN_OBS}")
    xtx = _products(clean, x, x)
    beta = np.linalg.pinv(xtx) @ _products(clean, x, [F.col("y")])[:, 0]
    fitted = sum((b * c for b, c in zip(map(float, beta[1:]), x[1:], strict=True)), F.lit(float(beta[0])))
    e = clean.withColumn("e", F.col("y") - fitted)
    w = Window.partitionBy(F.lit(1)).orderBy("o")  # one series
    scores = e.select("o", *[(c * F.col("e")).alias(f"g{i}") for i, c in enumerate(x)])
    k = len(x)
    lagged = scores.select("*", *[F.lag(f"g{i}", lag).over(w).alias(f"l{lag}_{i}") for lag in range(1, LAGS + 1) for i in range(k)])
    g = [F.col(f"g{i}") for i in range(k)]
    every = _products(lagged, g, g + [F.col(f"l{lag}_{i}") for lag in range(1, LAGS + 1) for i in range(k)])
    s = every[:, :k].copy()
    for lag in range(1, LAGS + 1):
        part = np.nan_to_num(every[:, lag * k : (lag + 1) * k])
        s += (1 - lag / (LAGS + 1)) * (part + part.T)
    inverse = np.linalg.pinv(xtx)
    se = np.sqrt(np.maximum(np.diag(inverse @ s @ inverse), 0))
    m = xtx[1:, 1:] / n - np.outer(xtx[0, 1:], xtx[0, 1:]) / n**2
    d = np.sqrt(np.diag(m))
    vif = np.diag(np.linalg.pinv(m / np.outer(d, d))) if len(factors) > 1 and (d > 0).all() else [None] * len(factors)
    out = []
    for name, b, u, v in zip(["alpha", *factors], beta, se, [None, *vif], strict=True):
        t = float(b / u) if u > 0 else None
        out.append((name, float(b), float(u), t, 2 * (1 - NormalDist().cdf(abs(t))) if t is not None else None, float(v) if v is not None and math.isfinite(v) else None))
    return rows.sparkSession.createDataFrame(out, "term string, coefficient double, std_error double, t_stat double, p_value double, vif double")


def fit_summary(rows: DataFrame, coefficients: DataFrame, factors: list[str], y: str = "ret", risk_free: float = 0.04, periods: int = 252) -> DataFrame:
    """One row: ``n_obs, r_squared, adj_r_squared, residual_vol_pct, alpha_annual_pct``."""
    b = {r["term"]: r["coefficient"] for r in coefficients.collect()}  # k + 1 rows
    clean = rows.select(F.col(y) - risk_free / periods, *factors).toDF("y", *factors).na.drop()
    e = F.col("y") - sum((b[f] * F.col(f) for f in factors), F.lit(b["alpha"]))
    a = clean.agg(F.count("*").alias("n_obs"), F.var_pop("y").alias("v"), F.avg(e * e).alias("s"), F.stddev_pop(e).alias("sd"))
    r2 = F.when(F.col("v") > 0, 1 - F.col("s") / F.col("v")).otherwise(0.0)
    k = len(factors)
    return a.select("n_obs", r2.alias("r_squared"), (1 - (1 - r2) * (F.col("n_obs") - 1) / (F.col("n_obs") - k - 1)).alias("adj_r_squared"), (F.col("sd") * periods**0.5 * 100).alias("residual_vol_pct"), F.lit(b["alpha"] * periods * 100).alias("alpha_annual_pct"))
