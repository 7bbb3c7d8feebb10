"""Parameter sweeps that count their own trials, walk-forward runs, and the shape of the surface they find.

A grid is a DataFrame with one row per combination; a failed trial keeps its row and its reason and has no returns.
Strategies that are expressions need no Python; user functions run one trial per group in Arrow workers.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions.exprs import div, scalar
from panelspark.operators.performance import performance_report
from panelspark.operators.validation import deflated_sharpe, min_track_record, pbo, verdict
from panelspark.plans.local import local_table


def expand_grid(spark: SparkSession, grid: dict[str, list]) -> DataFrame:
    """``trial_id, params, params_hash``: the product of the axes in sorted order of names; an empty grid or axis is an error."""
    if not grid or any(not v for v in grid.values()):
        raise ValueError("a grid needs at least one axis and every axis a value")
    names = sorted(grid)
    rows = [dict(zip(names, v, strict=True)) for v in itertools.product(*[grid[n] for n in names])]
    digest = lambda p: hashlib.sha256(json.dumps(p, sort_keys=True).encode()).hexdigest()[:12]
    return local_table(spark, [(i, json.dumps(p, sort_keys=True), digest(p)) for i, p in enumerate(rows)], "trial_id int, params string, params_hash string")


def sma_grid(spark: SparkSession, fast: tuple[int, ...], slow: tuple[int, ...]) -> DataFrame:
    pairs = [(i, f, s) for i, (f, s) in enumerate((f, s) for f in sorted(fast) for s in sorted(slow) if f < s)]
    return local_table(spark, pairs, "trial_id int, fast int, slow int")


def sma_cross(levels: DataFrame, grid: DataFrame, start: int) -> DataFrame:
    """``trial_id, pos, ret``: long while the fast mean of closes up to the day before is above the slow one, else flat.

    All averages come from one window pass; the grid is the caller's parameters, a few numbers, and becomes literals.
    """
    trials = [tuple(r) for r in grid.select("trial_id", "fast", "slow").collect()]
    sizes = sorted({k for _, *pair in trials for k in pair})
    w = Window.partitionBy("series_id").orderBy("pos")
    means = levels.select("series_id", "pos", "ret", *[F.avg("close").over(w.rowsBetween(1 - k, 0)).alias(f"m{k}") for k in sizes])
    known = means.select("pos", "ret", F.map_from_arrays(F.array(*[F.lit(k) for k in sizes]), F.array(*[F.lag(f"m{k}").over(w) for k in sizes])).alias("m")).where(F.col("pos") >= start)
    long = F.try_element_at("m", F.col("fast")) > F.try_element_at("m", F.col("slow"))
    each = F.array(*[F.struct(F.lit(i).alias("trial_id"), F.lit(f).alias("fast"), F.lit(s).alias("slow")) for i, f, s in trials])
    return known.withColumn("g", F.explode(each)).select("*", "g.*").select("trial_id", (F.col("pos") - start).alias("pos"), F.when(long, F.col("ret")).otherwise(0.0).alias("ret"))


def run_sweep(grid: DataFrame, fn: Callable[..., list], data=None, on_error: str = "record") -> DataFrame:
    """``trial_id, status, pos, ret`` of a user function ``fn(data=..., **params)`` per combination, in parallel.

    A call that raises keeps its slot as one row with its error as status and null pos; NaN and infinite returns are 0.
    ``data`` travels with the function.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        trial, params = int(pdf["trial_id"].iloc[0]), json.loads(pdf["params"].iloc[0])
        try:
            raw = fn(data=data, **params) if data is not None else fn(**params)
            ret = np.nan_to_num(np.asarray(list(raw), "float64"), nan=0.0, posinf=0.0, neginf=0.0)
        except Exception as e:
            if on_error == "raise":
                raise
            return pd.DataFrame({"trial_id": [trial], "status": [f"{type(e).__name__}: {e}"[:500]], "pos": [pd.NA], "ret": [None]})
        return pd.DataFrame({"trial_id": trial, "status": "ok", "pos": np.arange(len(ret)), "ret": ret})

    return grid.groupBy("trial_id").applyInPandas(run, "trial_id int, status string, pos bigint, ret double")


def trial_sharpes(grid: DataFrame, returns: DataFrame) -> DataFrame:
    """The grid with ``n_obs, sharpe`` (per period; 0 without spread); failed trials have null."""
    r = returns.where("ret IS NOT NULL").groupBy("trial_id").agg(F.count("ret").alias("n_obs"), F.coalesce(div(F.avg("ret"), F.stddev_samp("ret")), F.lit(0.0)).alias("sharpe"))
    return grid.join(r, "trial_id", "left")


def sweep_best(trials: DataFrame) -> DataFrame:
    """One row: the trial with the greatest Sharpe, the first of equals, and ``n_trials``, failed ones included."""
    s = F.struct("sharpe", -F.col("trial_id"))
    return trials.agg(F.count("*").alias("n_trials"), F.max_by("trial_id", F.when(F.col("sharpe").isNotNull(), s)).alias("trial_id"), F.max("sharpe").alias("sharpe"))


def surface(trials: DataFrame, axes: tuple[str, ...] = ()) -> DataFrame:
    """One row: ``n_ok, n_failed, best_sharpe, median_sharpe, share_near_best, shape`` and the median of each axis over the strong region."""
    t = trials.withColumn("best", scalar(trials.agg(F.max("sharpe").alias("best")))["best"])
    strong = (F.col("best") > 0) & (F.col("sharpe") >= F.col("best") * 0.8)
    near = F.coalesce(div(F.count_if(strong).cast("double"), F.count("sharpe")), F.lit(0.0))
    r = t.agg(
        F.count("sharpe").alias("n_ok"), F.count_if(F.col("sharpe").isNull()).alias("n_failed"), F.max("sharpe").alias("best_sharpe"), F.percentile("sharpe", F.lit(0.5)).alias("median_sharpe"), near.alias("share_near_best"),
        *[F.percentile(F.when(strong, F.col(a)), F.lit(0.5)).alias(f"{a}_median") for a in axes],
    )
    shape = F.when(F.col("n_ok") == 0, "empty").when(F.col("share_near_best") >= 0.30, "plateau").when(F.col("share_near_best") >= 0.10, "ridge").otherwise("knife_edge")
    return r.withColumn("shape", shape)


def walk_forward(returns: DataFrame, windows: int = 4, oos_fraction: float = 0.25) -> DataFrame:
    """``window, n_is, n_oos, trial_id, is_sharpe, oos_sharpe, failed``: expanding windows over all trials' returns.

    Each window takes the trial that is best before its out-of-sample part and measures it on that part. Windows that
    are too short keep their slot with the reason. Trials must be equally long, which native strategies are.
    """
    n = returns.agg((F.max("pos") + 1).alias("n"))
    cuts = n.select("n", F.explode(F.sequence(F.lit(1), F.lit(int(windows)))).alias("window")).withColumn("cut", F.floor(F.col("n") * F.col("window") / windows))
    oos = F.greatest(F.lit(4), F.bround(F.col("cut") * oos_fraction)).cast("bigint")
    cuts = cuts.withColumn("n_is", F.col("cut") - oos)
    cuts = cuts.withColumn("failed", F.when(F.col("cut") < 16, "window_too_short").when(F.col("n_is") < 8, "is_too_short"))
    usable = F.broadcast(cuts.where("failed IS NULL"))  # a row per window
    j = returns.join(usable, F.col("pos") < F.col("cut")).withColumn("inside", F.col("pos") < F.col("n_is"))
    s = j.groupBy("window", "inside", "trial_id").agg(F.coalesce(div(F.avg("ret"), F.stddev_samp("ret")), F.lit(0.0)).alias("sharpe"))
    best = s.where("inside").groupBy("window").agg(F.max_by("trial_id", F.struct("sharpe", -F.col("trial_id"))).alias("trial_id"), F.max("sharpe").alias("is_sharpe"))
    out = best.join(s.where("NOT inside").select("window", "trial_id", F.col("sharpe").alias("oos_sharpe")), ["window", "trial_id"], "left")
    return cuts.join(out, "window", "left").select("window", "n_is", (F.col("cut") - F.col("n_is")).alias("n_oos"), "trial_id", "is_sharpe", "oos_sharpe", "failed")


def slice_data(data, start: int, end: int):
    """Positions ``start`` to ``end`` of a list, or of every list in a mapping; other values of a mapping stay."""
    if isinstance(data, dict):
        return {k: list(v)[start:end] if isinstance(v, list | tuple | np.ndarray) else v for k, v in data.items()}
    return list(data)[start:end]


def _length(data) -> int:
    if not isinstance(data, dict):
        return len(data)
    lists = [len(v) for k, v in data.items() if isinstance(v, list | tuple | np.ndarray) and ("close" not in data or k == "close")]
    return min(lists, default=0)


def _ratio(returns) -> tuple[float, int]:
    """Sharpe ratio per period (0 without spread) and number of returns; NaN and infinite ones are 0."""
    r = np.nan_to_num(np.asarray(list(returns), "float64"), nan=0.0, posinf=0.0, neginf=0.0)
    sd = r.std(ddof=1) if len(r) > 1 else 0.0
    return float(r.mean() / sd) if sd > 0 else 0.0, len(r)


def walk_forward_fn(grid: DataFrame, fn: Callable[..., list], data, windows: int = 4, oos_fraction: float = 0.25) -> DataFrame:
    """``window, n_is, n_oos, n_trials, trial_id, is_sharpe, oos_sharpe, failed`` of a user function ``fn(data=..., **params)``.

    Windows expand: each runs every combination on the data before its held-out part, takes the best one, the first of
    equals, and runs it on that part alone. Each window and combination is a task's work of its own; the data travel with
    the function. Combinations that raise lose; a window in which all do, or the best one fails on its held-out part, or
    that is too short, keeps its slot with the reason. ``n_trials`` counts windows times combinations, failed ones included.
    """
    n = _length(data)
    windows = max(2, int(windows))
    if n < windows * 8:
        raise ValueError(f"{n} observations are too few for {windows} windows")
    plan = []
    for i in range(windows):
        cut = round((i + 1) * n / windows)
        held = max(4, round(cut * oos_fraction))
        plan.append((i + 1, cut - held, held, "window_too_short" if cut < 16 else "is_too_short" if cut - held < 8 else None))
    spark = grid.sparkSession
    slots = local_table(spark, plan, "window int, n_is bigint, held bigint, reason string")
    usable = [(w, a, b) for w, a, b, reason in plan if reason is None]
    spans = {w: (a, a + b) for w, a, b in usable}
    each = grid.select("trial_id", "params", F.explode(F.array(*[F.lit(w) for w in spans]) if spans else F.array().cast("array<int>")).alias("window"))

    def inside(batches):
        for pdf in batches:
            rows = []
            for trial, params, w in zip(pdf["trial_id"], pdf["params"], pdf["window"], strict=True):
                try:
                    rows.append((w, trial, params, _ratio(fn(data=slice_data(data, 0, spans[w][0]), **json.loads(params)))[0], None))
                except Exception as e:
                    rows.append((w, trial, params, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["window", "trial_id", "params", "is_sharpe", "error"])

    tried = each.repartition("window", "trial_id").mapInPandas(inside, "window int, trial_id int, params string, is_sharpe double, error string")
    best = tried.groupBy("window").agg(
        F.max_by(F.struct("trial_id", "params", "is_sharpe"), F.when(F.col("is_sharpe").isNotNull(), F.struct("is_sharpe", -F.col("trial_id")))).alias("b"), F.min("error").alias("error")
    ).select("window", "b.*", "error")

    def outside(batches):
        for pdf in batches:
            rows = []
            for w, trial, params, sharpe, error in zip(pdf["window"], pdf["trial_id"], pdf["params"], pdf["is_sharpe"], pdf["error"], strict=True):
                if params is None:
                    rows.append((w, None, None, None, None, error))
                    continue
                try:
                    ratio, size = _ratio(fn(data=slice_data(data, *spans[w]), **json.loads(params)))
                    rows.append((w, trial, sharpe, ratio, size, None))
                except Exception as e:
                    rows.append((w, trial, sharpe, None, None, f"{type(e).__name__}: {e}"[:500]))
            out = pd.DataFrame(rows, columns=["window", "trial_id", "is_sharpe", "oos_sharpe", "n_oos", "failed"])
            yield out.astype({"trial_id": "Int64", "n_oos": "Int64"})

    found = best.mapInPandas(outside, "window int, trial_id int, is_sharpe double, oos_sharpe double, n_oos bigint, failed string")
    trials = grid.agg(F.count("*").alias("n")).scalar() * windows
    return slots.join(found, "window", "left").select("window", "n_is", "n_oos", trials.alias("n_trials"), "trial_id", "is_sharpe", "oos_sharpe", F.coalesce("reason", "failed").alias("failed"))


def data_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row ``data_hash, n``: an identity of the rows whatever their order, from per-row digests that are added up."""
    digest = F.conv(F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.substring(F.sha2(F.concat_ws(":", F.sum(digest).cast("string"), F.count("*").cast("string")), 256), 1, 16).alias("data_hash"), F.count("*").alias("n"))


def sweep_verdict(grid: DataFrame, returns: DataFrame, splits: int = 10) -> DataFrame:
    """One row on the best trial, deflated by the number of trials in the grid, failed ones included, with the spread of their Sharpes."""
    trials = trial_sharpes(grid, returns)
    best = sweep_best(trials).withColumn("spread", scalar(trials.agg(F.stddev_samp("sharpe").alias("s")))["s"])
    found = best.first()  # one row
    own = returns.where(F.col("trial_id") == F.lit(found["trial_id"])).select(F.lit("best").alias("series_id"), "pos", "ret")
    d = deflated_sharpe(own, found["n_trials"], found["spread"]).select("series_id", "psr", "sr0", "deflated_sharpe")
    p = performance_report(own).select("series_id", "sharpe_annualized", "max_drawdown_pct", "total_return_pct")
    m = min_track_record(own).select("series_id", "min_length", "sufficient")
    o = scalar(pbo(returns, splits))
    r = d.join(p, "series_id", "left").join(m, "series_id", "left").withColumn("o", o)
    source = F.lit("derived_from_grid")
    return r.select(F.lit(found["trial_id"]).alias("trial_id"), F.lit(found["n_trials"]).alias("n_trials"), "psr", "sr0", "deflated_sharpe", "sharpe_annualized", "max_drawdown_pct", "total_return_pct", "min_length", "sufficient", F.col("o.pbo").alias("pbo"), verdict(F.col("deflated_sharpe"), F.col("o.pbo"), source).alias("verdict"))
