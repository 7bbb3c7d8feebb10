"""Problem 1: implausible readings, flagged by each source's own behaviour.

Rows are first reduced to one reading per source and day (map-side combined), which bounds every group by the
calendar whatever the number of rows a source delivers. Each series is then one row that holds its days in order,
scored batch by batch without pandas. A reading's residual is its distance from the level before and after it, free
of its weekday effect and in units of the source's usual move; its size as a burst is that distance as far as a move
that enters and an equal one that leaves bear it out. The tail of the sizes is fitted per source by peaks over
threshold (generalised Pareto, declustered, its outliers trimmed by forward search), and the quantile at a fixed risk
is the source's cutoff. A source's few excesses say little about the shape of its tail, so the shape is that of all
sources and the scale is drawn towards theirs by a stated weight. Rules for impossible values and for the duration
of stuck values are added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.exprs import clean_symbol

RISK = 1e-8  # probability that a reading without a fault lies beyond its source's cutoff
TAIL = 0.8  # quantile of a source's sizes from which its tail is fitted; a fifth of its readings may be faults
POOL = 50  # excesses that the tail of all sources weighs beside a source's own
#: (excesses, scale, shape): what the tail of all sources starts from, that of normal moves; it decides only where all sources together hold fewer
NORMAL_MOVES = (50, 0.52, -0.19)
FORWARD = 20  # an excess belongs to the tail while the fit expects one as large in a 20th of all such tails
SIDE = 9  # readings that define the level on either side; a burst of up to SIDE // 2 + 1 can't shift it
STUCK_RUN = 5  # readings in a run from which a repeated value counts as stuck
STUCK_SHARE = 0.03  # of the usual move: changes up to this are none
RESTLESS = 0.1  # a source whose share of unchanged readings outside stuck runs is below this moves at nearly every reading
SEASON_MIN = 30  # readings of a weekday from which its own level is trusted


def _growing_medians(x: np.ndarray) -> np.ndarray:
    """Medians of the first 1, 2, ... values."""
    k = np.arange(len(x))
    ordered = np.sort(np.where(k[None, :] <= k[:, None], x[None, :], np.inf), axis=1)
    return (ordered[k, k // 2] + ordered[k, (k + 1) // 2]) / 2


def _side_medians(x: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Median of up to ``side`` values before and after each position; NaN where there are none."""
    n = len(x)
    before, after = np.full(n, np.nan), np.full(n, np.nan)
    if n > side:
        mid = np.median(np.lib.stride_tricks.sliding_window_view(x, side), axis=1)
        before[side:] = mid[: n - side]
        after[: n - side] = mid[1:]
    k = min(side, n)
    before[1:k] = _growing_medians(x[: k - 1])
    after[n - k : n - 1] = _growing_medians(x[::-1][: k - 1])[::-1]
    return before, after


def burst_sizes(x: np.ndarray, score: np.ndarray, longest: int = SIDE // 2 + 1) -> np.ndarray:
    """Size of each reading as part of a burst: the greatest, over the runs of up to ``longest`` readings that hold it, of
    the least of its own distance from the level, the move that enters the run and the opposite one that leaves it."""
    n = len(x)
    size = np.zeros(n)
    move = np.diff(x)
    for length in range(1, min(longest, n - 2) + 1):
        enter, leave = move[: n - 1 - length], -move[length:]
        both = np.where(enter * leave > 0, np.minimum(np.abs(enter), np.abs(leave)), 0.0)
        for k in range(1, length + 1):
            part = size[k : k + len(both)]
            np.maximum(part, np.minimum(both, score[k : k + len(both)]), out=part)
    return size


def tail_excesses(size: np.ndarray) -> tuple[float, np.ndarray]:
    """Threshold, and the excesses over it in ascending order, the largest of each run of neighbours only."""
    threshold = float(np.quantile(size, TAIL, method="lower"))
    above = np.flatnonzero(size > threshold)
    if not len(above):
        return threshold, np.zeros(0)
    runs = np.flatnonzero(np.diff(above, prepend=-2) > 1)
    return threshold, np.sort(np.maximum.reduceat(size[above], runs) - threshold)


def pareto_shape(excess: np.ndarray) -> float:
    """Shape of a generalised Pareto tail by L-moments of its ascending excesses."""
    k = len(excess)
    l1 = excess.mean()
    l2 = 2 * np.sum(np.arange(k) / (k - 1) * excess) / k - l1
    return float(np.clip(2 - l1 / l2, -0.5, 0.5)) if l2 > 0 else 0.0


def pareto_cutoff(threshold: float, mean_excess: float, shape: float, share: float, risk: float) -> float:
    """Quantile at ``risk`` of a tail that holds ``share`` of all values."""
    shape = max(shape, 0.0)  # a bounded tail would end the source's readings at what few of them have shown
    scale, ratio = mean_excess * (1 - shape), risk / share
    return threshold + (-scale * np.log(ratio) if abs(shape) < 1e-6 else scale / shape * (ratio**-shape - 1))


def own_tail(size: np.ndarray) -> tuple[int, float, float]:
    """Excesses of a source, their mean by a median that outliers can't move, and the shape without what lies far beyond."""
    _, excess = tail_excesses(size)
    if not len(excess):
        return 0, np.nan, np.nan
    mean = float(np.median(excess) / np.log(2))
    near = excess[excess <= mean * np.log(FORWARD * len(excess))]
    return len(excess), mean, pareto_shape(near) if len(near) > 4 else np.nan


def fit_tail(size: np.ndarray, mean_of_all: float, shape: float, risk: float = RISK) -> tuple[float, int, int, float, float]:
    """Threshold, excesses, those of them in the tail, mean excess and cutoff of a source.

    The search starts from the tail of all sources and takes in excesses as long as the growing fit expects them."""
    threshold, excess = tail_excesses(size)
    mean, taken = mean_of_all, -1
    while True:
        inside = int(np.searchsorted(excess, mean * np.log(FORWARD * max(1, len(excess))), side="right"))
        if inside <= taken:
            break
        taken = inside
        mean = (excess[:taken].sum() + POOL * mean_of_all) / (taken + POOL)
    return threshold, len(excess), taken, mean, pareto_cutoff(threshold, mean, shape, max(1, taken) / len(size), risk)


def score_series(day: np.ndarray, value: np.ndarray) -> dict[str, np.ndarray]:
    """Usual move, score, size and stuck flag of one source: ``day`` ascending day numbers, ``value`` positive finite readings."""
    n = len(value)
    out = {"usual": np.full(n, np.nan), "score": np.full(n, np.nan), "size": np.full(n, np.nan), "stuck": np.zeros(n, bool)}
    if n < 3:
        return out
    x = np.log(value)
    move = np.abs(np.diff(x))
    moved = move[move > 0]
    if not len(moved):
        return out
    usual = np.median(moved)
    usual = float(np.median(moved[moved > STUCK_SHARE * usual]))
    before, after = _side_medians(x, SIDE)
    # seasonal residual: the weekday's typical distance from the level around it
    around = np.where(np.isnan(before), after, np.where(np.isnan(after), before, (before + after) / 2))
    season = np.zeros(n)
    weekday = day % 7
    for w in range(7):
        own = weekday == w
        if own.sum() >= SEASON_MIN:
            season[own] = np.median((x - around)[own])
    score = np.fmin(np.abs(x - before - season), np.abs(x - after - season)) / usual
    out["usual"][:], out["score"], out["size"] = usual, score, burst_sizes(x / usual, score)
    # stuck: runs of readings that repeat the one before
    same = np.concatenate([[False], move <= STUCK_SHARE * usual])
    run = np.cumsum(~same)
    length = np.bincount(run)[run]
    long = same & (length >= STUCK_RUN)
    if (same & ~long).sum() < RESTLESS * n:
        out["stuck"] = long
    return out


READING = {"day": pa.int32(), "value": pa.float64(), "implausible": pa.bool_()}
RESULT = {"usual": pa.float64(), "score": pa.float64(), "size": pa.float64(), "cutoff": pa.float64(), "spike": pa.bool_(), "stuck": pa.bool_()}


def _series(batch: pa.RecordBatch) -> tuple[pa.StructArray, np.ndarray, list[tuple[np.ndarray, dict[str, np.ndarray]]]]:
    """Readings of a batch of series one after another, where each series ends, and its plausible positions with their scores."""
    lists = batch.column(1)
    flat = lists.flatten()
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    day, value = (flat.field(i).to_numpy(zero_copy_only=False).astype(t) for i, t in ((0, "int64"), (1, "float64")))
    ok = np.isfinite(value) & (value > 0)
    at = [a + np.flatnonzero(ok[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return flat, ends, [(p, score_series(day[p], value[p])) for p in at]


def _own_tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each series that has a tail: excesses, mean excess, shape."""
    for batch in batches:
        got = [own_tail(s["size"]) for _, s in _series(batch)[2] if len(s["size"]) and not np.isnan(s["size"][0])]
        got = [g for g in got if g[0]]
        yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.float64()))], ["k", "mean", "shape"])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fit of each series' tail; nulls where it has none."""
    names = ("n", "threshold", "excesses", "in_tail", "mean_excess", "cutoff", "usual")
    for batch in batches:
        rows = []
        for (p, s), mean, shape in zip(_series(batch)[2], batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            scored = len(p) and not np.isnan(s["size"][0])
            rows.append((len(p), *(fit_tail(s["size"], mean, shape) if scored else (None,) * 5), float(s["usual"][0]) if scored else None))
        kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], batch.column(3)], ["source", *names, "shape"])


def _flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (source, list of day, value, implausible in order of days, tail of all sources) to one row per reading."""
    for batch in batches:
        flat, ends, series = _series(batch)
        got = {k: np.zeros(len(flat), bool) if t == pa.bool_() else np.full(len(flat), np.nan) for k, t in RESULT.items()}
        for (at, scores), mean, shape in zip(series, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            for k, v in scores.items():
                got[k][at] = v
            if len(at) and not np.isnan(scores["size"][0]):
                got["cutoff"][at] = fit_tail(scores["size"], mean, shape)[-1]
        got["spike"] = got["size"] > got["cutoff"]
        source = batch.column(0).take(pa.array(np.repeat(np.arange(len(ends) - 1), np.diff(ends))))
        yield pa.RecordBatch.from_arrays([source, *[flat.field(i) for i in range(3)], *[pa.array(v, RESULT[k]) for k, v in got.items()]], ["source", *READING, *RESULT])


def _with_tail_of_all(df: DataFrame, source: str, time: str, value: str, order: str) -> DataFrame:
    """``source, s, mean, shape``: each source's readings in order of days, and mean excess and shape of the tail of all."""
    v = F.col(value).try_cast("double")
    rows = df.select(
        clean_symbol(F.col(source)).alias("source"),
        F.unix_date(F.col(time).try_cast("date")).alias("day"),
        v.alias("v"),
        F.col(order).alias("o"),
    ).where("source IS NOT NULL AND day IS NOT NULL AND v IS NOT NULL")
    good = ~F.isnan("v") & (F.col("v") > 0) & (F.col("v") < float("inf"))
    days = rows.groupBy("source", "day").agg(
        F.max(F.when(good, F.struct("o", "v"))).getField("v").alias("value"),
        F.bool_or(~good).alias("implausible"),
    )
    series = days.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("day", "value", "implausible"))).alias("s"))
    tails = series.mapInArrow(_own_tails, "k bigint, mean double, shape double")
    prior = df.sparkSession.range(1).select(*[F.lit(v).cast(t).alias(c) for c, t, v in zip(("k", "mean", "shape"), ("bigint", "double", "double"), NORMAL_MOVES, strict=True)])
    # medians over all sources, each with the weight of its excesses, on a grid fine enough not to matter
    of_all = lambda c: F.percentile(F.round(c, 3), F.lit(0.5), F.when(~F.isnan(c), F.col("k")).otherwise(0))
    pooled = tails.unionByName(prior).agg(F.struct(of_all("mean").alias("mean"), of_all("shape").alias("shape")).alias("p")).scalar()
    return series.withColumn("p", pooled).select("source", "s", "p.mean", "p.shape")


def source_cutoffs(df: DataFrame, source: str = "symbol", time: str = "date", value: str = "close", order: str = "loaded_at") -> DataFrame:
    """One row per source with a reading: ``source, n, threshold, excesses, in_tail, mean_excess, shape, risk, cutoff, usual_move``.

    The fit that :func:`flag_readings` judges by, from the same readings. ``in_tail`` of the ``excesses`` belong to the
    tail, the others lie beyond what it expects. A source of fewer than 3 plausible readings, or one that never moves,
    has ``n`` alone; an empty table gives no rows.
    """
    schema = "source string, n bigint, threshold double, excesses bigint, in_tail bigint, mean_excess double, cutoff double, usual_move double, shape double"
    fits = _with_tail_of_all(df, source, time, value, order).mapInArrow(_fitted, schema)
    return fits.select("source", "n", "threshold", "excesses", "in_tail", "mean_excess", F.when(F.col("cutoff").isNotNull(), F.col("shape")).alias("shape"), F.lit(RISK).alias("risk"), "cutoff", "usual_move")


def flag_readings(df: DataFrame, source: str = "symbol", time: str = "date", value: str = "close", order: str = "loaded_at") -> DataFrame:
    """One row per source and day with a reading: ``source, day_iso, value, implausible, spike, stuck, score, size, cutoff, usual_move``.

    * null source, blank source, null time or null value: no reading, no row; an empty table gives no rows;
    * NaN, infinite, zero or negative value: ``implausible``; the day's other values still take part as its reading;
    * repeated rows of a day: the one delivered last (``order``, then the larger value) is the reading;
    * fewer than 3 plausible readings, or a source that never moves: nothing to compare with, so no spike or stuck flag;
    * ``score`` is the smaller distance from the level before and after, in usual moves; ``size`` the part of it that a
      move into and one out of a run of at most five readings bear out; ``spike``: ``size`` beyond the source's ``cutoff``;
      a source's first and last reading have no move into or out of them and so no spike flag;
    * other columns are ignored, whatever their names.
    """
    schema = "source string, day int, value double, implausible boolean, usual double, score double, size double, cutoff double, spike boolean, stuck boolean"
    scored = _with_tail_of_all(df, source, time, value, order).mapInArrow(_flagged, schema)
    return scored.select(
        "source",
        F.date_from_unix_date("day").cast("string").alias("day_iso"),
        F.nanvl("value", F.lit(None).cast("double")).alias("value"),
        "implausible",
        "spike",
        "stuck",
        *[F.nanvl(c, F.lit(None).cast("double")).alias(a) for c, a in (("score", "score"), ("size", "size"), ("cutoff", "cutoff"), ("usual", "usual_move"))],
    )
