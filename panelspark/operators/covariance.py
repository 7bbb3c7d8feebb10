"""Covariance in long form ``a, b, v`` (a <= b) from a return panel, and what is computed on the small matrix.

Dates are reduced to one matrix of products per task, which are added up. The matrix of at most ``MAX_NAMES`` names
goes to the driver for spectra and allocation; more names are refused there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions.exprs import scalar
from panelspark.operators.performance import _clean
from panelspark.plans.panels import align_longest

MAX_NAMES = 2000


def return_panel(prices: DataFrame) -> DataFrame:
    """``symbol, t, ret`` of the names as long as the longest one (rule A), positions as dates."""
    kept, _ = align_longest(prices, need=3)
    w = Window.partitionBy("symbol").orderBy("pos")
    r = kept.withColumn("ret", F.try_divide("close", F.lag("close").over(w)) - 1).where("pos > 0")
    return r.select("symbol", (F.col("pos") - 1).alias("t"), "ret")


def _pairs(panel: DataFrame) -> DataFrame:
    x = panel.select("t", F.col("symbol").alias("a"), F.col("ret").alias("x"))
    y = panel.select("t", F.col("symbol").alias("b"), F.col("ret").alias("y"))
    return x.join(y, "t").where("a <= b")


def gram(panel: DataFrame) -> DataFrame:
    """``a, b, v`` (a <= b): sums over dates of products of two names' ``ret``.

    Up to ``MAX_NAMES`` names, each task adds its dates' outer products into one matrix and hands on that alone, so the
    shuffle holds matrices, not rows times pairs. More names meet in a join on the date. Missing entries count as zero.
    """
    names = [r[0] for r in panel.select("symbol").distinct().orderBy("symbol").limit(MAX_NAMES + 1).collect()]
    if len(names) > MAX_NAMES:
        return _pairs(panel).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("v"))
    at = {s: i for i, s in enumerate(names)}
    vectors = panel.groupBy("t").agg(F.collect_list("symbol").alias("s"), F.collect_list("ret").alias("r"))  # one entry a name

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(names), len(names)))
        for pdf in batches:
            x = np.zeros((len(pdf), len(names)))
            for k, (s, r) in enumerate(zip(pdf["s"], pdf["r"], strict=True)):
                x[k, [at[n] for n in s]] = r
            total += x.T @ x
        i, j = np.triu_indices(len(names))
        yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "v": total[i, j]})

    part = vectors.mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    label = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    return part.select(F.get(label, F.col("i")).alias("a"), F.get(label, F.col("j")).alias("b"), "v")


def cov_sample(panel: DataFrame) -> DataFrame:
    """Population covariance; every name has a return on every date (rule A)."""
    centred = panel.withColumn("ret", F.col("ret") - F.avg("ret").over(Window.partitionBy("symbol")))
    n = scalar(panel.agg(F.count_distinct("t").alias("n")))["n"]
    return gram(centred).select("a", "b", (F.col("v") / n).alias("v"))


def cov_ewma(panel: DataFrame, lam: float = 0.94) -> DataFrame:
    """Mean-zero, weights lam ** age normalised to sum to one."""
    last = scalar(panel.agg(F.max("t").alias("last")))["last"]
    weighted = panel.withColumn("w", F.pow(F.lit(float(lam)), last - F.col("t")))
    total = scalar(weighted.select("t", "w").distinct().agg(F.sum("w").alias("w")))["w"]
    return gram(weighted.withColumn("ret", F.col("ret") * F.sqrt("w"))).select("a", "b", (F.col("v") / total).alias("v"))


def cov_ledoit_wolf(panel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shrinkage toward the mean variance: the long form, and one row ``shrinkage, mu``. No pass over pairs of pairs."""
    c = panel.withColumn("x", F.col("ret") - F.avg("ret").over(Window.partitionBy("symbol")))
    emp = cov_sample(panel)
    full = F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0)
    stats = emp.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("v"))).alias("trace"), F.count_if(F.col("a") == F.col("b")).alias("n"), F.sum(full * F.col("v") * F.col("v")).alias("norm2"))
    fourth = c.groupBy("t").agg(F.sum(F.col("x") * F.col("x")).alias("s")).agg(F.avg(F.col("s") * F.col("s")).alias("m4"))
    r = stats.withColumn("m4", scalar(fourth)["m4"])
    mu = F.col("trace") / F.col("n")
    delta = (F.col("norm2") - F.col("n") * mu * mu) / F.col("n")
    beta = F.least((F.col("m4") - F.col("norm2")) / F.col("n"), delta)
    r = r.select(F.coalesce(F.least(F.greatest(F.try_divide(beta, delta), F.lit(0.0)), F.lit(1.0)), F.lit(0.0)).alias("shrinkage"), mu.alias("mu"))
    v = (1 - F.col("shrinkage")) * F.col("v") + F.when(F.col("a") == F.col("b"), F.col("shrinkage") * F.col("mu")).otherwise(0.0)
    shrunk = emp.withColumn("s", scalar(r)).select("a", "b", "v", "s.shrinkage", "s.mu")
    return shrunk.select("a", "b", v.alias("v")), r


def to_matrix(cov: DataFrame) -> tuple[list[str], np.ndarray]:
    """Names in order and the dense matrix on the driver; refused beyond ``MAX_NAMES`` names."""
    n = cov.where("a = b").count()
    if n > MAX_NAMES:
        raise ValueError(f"{n} names; the dense part takes at most {MAX_NAMES}")
    pdf = cov.toPandas()
    names = sorted(set(pdf["a"]) | set(pdf["b"]))
    at = {s: i for i, s in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    i, j = pdf["a"].map(at).to_numpy(), pdf["b"].map(at).to_numpy()
    m[i, j] = m[j, i] = pdf["v"].to_numpy("float64")
    return names, m


def from_matrix(spark: SparkSession, names: list[str], m: np.ndarray) -> DataFrame:
    rows = [(names[i], names[j], float(m[i, j])) for i in range(len(names)) for j in range(i, len(names))]
    return spark.createDataFrame(rows, "a string, b string, v double")


def _correlation(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    vol = np.sqrt(np.maximum(np.diag(c), 1e-18))
    r = np.clip(c / np.outer(vol, vol), -1, 1)
    np.fill_diagonal(r, 1.0)
    return r, vol


def _unit_diagonal(r: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.maximum(np.diag(r), 1e-18))
    r = r / np.outer(d, d)
    np.fill_diagonal(r, 1.0)
    return r


def denoise(c: np.ndarray, n_obs: int) -> tuple[np.ndarray, int]:
    """Correlation eigenvalues within the random-matrix bulk replaced by their mean; and the number of those above it."""
    r, vol = _correlation(c)
    values, vectors = np.linalg.eigh(r)
    values = np.maximum(values, 0)
    noise = values <= (1 + math.sqrt(len(c) / max(n_obs, 1))) ** 2 + 1e-12
    if noise.any():
        values[noise] = values[noise].mean()
    return _unit_diagonal((vectors * values) @ vectors.T) * np.outer(vol, vol), int((~noise).sum())


def detone(c: np.ndarray) -> np.ndarray:
    """Without the largest correlation mode, diagonal restored."""
    r, vol = _correlation(c)
    values, vectors = np.linalg.eigh(r)
    return _unit_diagonal(r - values[-1] * np.outer(vectors[:, -1], vectors[:, -1])) * np.outer(vol, vol)


def denoise_cov(cov: DataFrame, n_obs: int) -> DataFrame:
    """:func:`denoise` of a covariance in long form."""
    names, m = to_matrix(cov)
    return from_matrix(cov.sparkSession, names, denoise(m, n_obs)[0])


def detone_cov(cov: DataFrame) -> DataFrame:
    """:func:`detone` of a covariance in long form."""
    names, m = to_matrix(cov)
    return from_matrix(cov.sparkSession, names, detone(m))


def variance_explained(c: np.ndarray) -> list[float]:
    values = np.maximum(np.linalg.eigvalsh(c), 0)[::-1]
    return [float(v / values.sum()) for v in values] if values.sum() > 0 else []


def diagnostics(c: np.ndarray) -> dict[str, float | None]:
    values = np.maximum(np.linalg.eigvalsh(c), 0)
    positive = values[values > 1e-18]
    return {"n_assets": len(c), "trace": float(np.trace(c)), "condition_number": float(values[-1] / positive.min()) if len(positive) else None, "min_eigenvalue": float(values[0]), "max_eigenvalue": float(values[-1])}


def _single_linkage(distance: np.ndarray) -> list[tuple[int, int]]:
    """Merges of single linkage by rising distance, as pairs of cluster ids, the smaller id first."""
    n = len(distance)
    best, parent = distance[0].copy(), np.zeros(n, int)
    inside = np.zeros(n, bool)
    inside[0] = True
    edges = []
    for _ in range(n - 1):  # minimum spanning tree
        k = int(np.argmin(np.where(inside, np.inf, best)))
        edges.append((best[k], int(parent[k]), k))
        inside[k] = True
        closer = distance[k] < best
        best[closer], parent[closer] = distance[k][closer], k
    root = list(range(2 * n - 1))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    merges = []
    for m, (_, i, j) in enumerate(sorted(edges, key=lambda e: e[0])):
        x, y = sorted((find(i), find(j)))
        merges.append((x, y))
        root[x] = root[y] = n + m
    return merges


def hrp_weights(c: np.ndarray) -> np.ndarray:
    """Hierarchical risk parity: leaves in dendrogram order, risk split at each halving by inverse cluster variance."""
    n = len(c)
    r, _ = _correlation(c)
    merges = _single_linkage(np.sqrt(np.maximum((1 - r) / 2, 0)))
    order, stack = [], [2 * n - 2]
    while stack:
        node = stack.pop()
        if node < n:
            order.append(node)
        else:
            left, right = merges[node - n]
            stack += [right, left]
    w = np.ones(n)

    def variance(ids: list[int]) -> float:
        sub = c[np.ix_(ids, ids)]
        p = 1 / np.maximum(np.diag(sub), 1e-18)
        p /= p.sum()
        return float(p @ sub @ p)

    todo = [order]
    while todo:
        ids = todo.pop()
        if len(ids) < 2:
            continue
        a, b = ids[: len(ids) // 2], ids[len(ids) // 2 :]
        va, vb = variance(a), variance(b)
        share = 0.5 if va + vb <= 0 else vb / (va + vb)
        w[a] *= share
        w[b] *= 1 - share
        todo += [a, b]
    return w / w.sum()


def risk_parity_weights(c: np.ndarray, rounds: int = 10_000, tol: float = 1e-14) -> np.ndarray:
    """Equal risk contributions by cyclical coordinate descent from inverse volatility."""
    n = len(c)
    x = 1 / np.sqrt(np.maximum(np.diag(c), 1e-18))
    x /= math.sqrt(x @ c @ x)
    for _ in range(rounds):
        before = x.copy()
        for i in range(n):  # the root of c_ii x^2 + (c x)_i' x - 1/n
            off = c[i] @ x - c[i, i] * x[i]
            x[i] = (-off + math.sqrt(off * off + 4 * c[i, i] / n)) / (2 * c[i, i])
        if np.abs(x - before).max() <= tol * np.abs(x).max():
            break
    return x / x.sum()


def allocate(cov: DataFrame, method: str = "hrp") -> DataFrame:
    """``symbol, weight, risk_share`` for hrp or risk_parity."""
    names, m = to_matrix(cov)
    w = {"hrp": hrp_weights, "risk_parity": risk_parity_weights}[method](m)
    contribution = w * (m @ w)
    total = contribution.sum()
    return cov.sparkSession.createDataFrame([(s, float(x), float(k / total) if total else None) for s, x, k in zip(names, w, contribution, strict=True)], "symbol string, weight double, risk_share double")


COVARIANCES = ("sample", "ewma", "lw", "denoise")


def covariance_by(panel: DataFrame, method: str = "sample", lam: float = 0.94) -> DataFrame:
    """Covariance of a return panel by name: sample, ewma, lw (shrunk) or denoise (the sample one, denoised)."""
    if method not in COVARIANCES:
        raise ValueError(f"no covariance {method!r}; there are {', '.join(COVARIANCES)}")
    if method == "ewma":
        return cov_ewma(panel, lam)
    if method == "lw":
        return cov_ledoit_wolf(panel)[0]
    sample = cov_sample(panel)
    return sample if method == "sample" else denoise_cov(sample, panel.select("t").distinct().count())


def allocate_panel(data: DataFrame, weights: str, cov: str) -> DataFrame:
    """:func:`allocate` of a covariance in long form, or of a return panel by the covariance named."""
    return allocate(data if {"a", "b", "v"} <= set(data.columns) else covariance_by(data, cov), weights)


def hrp(data: DataFrame, cov: str = "sample") -> DataFrame:
    return allocate_panel(data, "hrp", cov)


def risk_parity(data: DataFrame, cov: str = "lw") -> DataFrame:
    return allocate_panel(data, "risk_parity", cov)


def vol_target_by(variances: DataFrame, target: float = 0.10, periods: int = 252) -> DataFrame:
    """:func:`vol_target` by a given variance of each return (``series_id, ret, var``), such as :func:`process.garch_variance`."""
    vol = F.sqrt(F.greatest("var", F.lit(0.0)) * periods)
    r = variances.where("ret IS NOT NULL AND var IS NOT NULL AND NOT isnan(var)").withColumn("lev", F.when(vol > 1e-12, F.lit(target) / vol).otherwise(0.0))
    return r.groupBy("series_id").agg(F.count("*").alias("n_obs"), F.avg("lev").alias("mean_leverage"), F.max("lev").alias("max_leverage"), (F.stddev_samp(F.col("ret") * F.col("lev")) * periods**0.5).alias("realized_vol"))


def vol_target(series: DataFrame, target: float = 0.10, lam: float = 0.94, periods: int = 252) -> DataFrame:
    """``series_id, n_obs, mean_leverage, max_leverage, realized_vol``: leverage to a target by exponentially weighted variance.

    The variance starts from the mean square of the first 20 returns and includes the day's own; as a closed form
    it is a running sum of squares scaled by powers of lam, split by blocks of 256 days so that powers stay finite.
    """
    block = 256
    w = Window.partitionBy("series_id").orderBy("pos")
    r = _clean(series).where("n >= 2").withColumn("start", F.avg(F.when(F.col("pos") < 20, F.col("ret") * F.col("ret"))).over(Window.partitionBy("series_id")))
    r = r.withColumn("k", F.floor(F.col("pos") / block)).withColumn("i", F.col("pos") % block + 1)
    inside = Window.partitionBy("series_id", "k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    own = F.sum((1 - lam) * F.col("ret") * F.col("ret") * F.pow(F.lit(lam), -F.col("i"))).over(inside) * F.pow(F.lit(lam), F.col("i"))
    r = r.withColumn("own", own)
    ends = r.groupBy("series_id", "k").agg(F.max_by("own", "pos").alias("e"), F.max("i").alias("len"), F.max("start").alias("start"))
    # variance at the start of each block: what the blocks before left behind
    past = F.array_sort(F.collect_list(F.struct("k", "e", "len")).over(Window.partitionBy("series_id")))
    carry = F.aggregate(F.filter(past, lambda b: b["k"] < F.col("k")), F.col("start"), lambda v, b: v * F.pow(F.lit(lam), b["len"]) + b["e"])
    ends = ends.select("series_id", "k", carry.alias("v0"))
    r = r.join(ends, ["series_id", "k"]).withColumn("var", F.col("v0") * F.pow(F.lit(lam), F.col("i")) + F.col("own"))
    vol = F.sqrt(F.col("var") * periods)
    r = r.withColumn("lev", F.when(vol > 1e-12, F.lit(target) / vol).otherwise(0.0))
    return r.groupBy("series_id").agg(F.count("*").alias("n_obs"), F.avg("lev").alias("mean_leverage"), F.max("lev").alias("max_leverage"), (F.stddev_samp(F.col("ret") * F.col("lev")) * periods**0.5).alias("realized_vol"))
