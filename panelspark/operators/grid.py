"""Problem 7: irregular readings onto a regular grid, with missing periods filled and marked.

Readings are averaged per source and period (map-side combined, so a hot source shrinks before the shuffle), and
the periods of one source and UTC day form one series: at most 86,400 / grid_s periods, whatever the rows. Each
series goes through iterative singular-spectrum imputation: missing periods start on a straight line, the series
is embedded as a Hankel matrix, its leading singular vectors rebuild it, and the missing entries are replaced
until they settle. How a series is embedded is decided by readings of its own that are hidden for a trial: short
windows for one that wanders, a long window for one that repeats itself, and the straight line where neither does
better. Filled periods are marked, and so is a series that a guard stops before it settles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.exprs import clean_symbol, finite

WINDOW = 12  # rows of the Hankel matrix of a series that repeats itself
RANK = 2  # singular vectors kept of it
#: (rows, vectors, weight) of the Hankel matrices, rebuilt together, of one that wanders: near to level and to slope
SHORT = ((2, 1, 0.8), (3, 2, 0.2))
ROUNDS = 100_000  # a guard only: series with long gaps take thousands; one that gets here is marked as not settled
FLUSH = 200_000  # periods handed on at once; bounds a worker's memory
SETTLED = 1e-3  # largest change of a filled value, in standard deviations of the known ones
HIDDEN = 4  # every fourth reading inside a series is hidden in the trial
TRIAL_SETTLED = 1e-2  # the same change in the trial
CLEARLY = 0.5  # squared error of the long window in the trial, as a part of the others', from which it is taken


def ssa_fill(value: np.ndarray, known: np.ndarray, window: int = WINDOW, rank: int = RANK, rounds: int = ROUNDS) -> np.ndarray:
    """``value`` with its unknown entries imputed; first and last entry are known."""
    return ssa_settle(value, known, window, rank, rounds)[0]


def ssa_settle(value: np.ndarray, known: np.ndarray, window: int = WINDOW, rank: int = RANK, rounds: int = ROUNDS) -> tuple[np.ndarray, bool]:
    """The imputed series, and whether it settled within ``rounds``."""
    return _settle(value, known, ((window, rank, 1.0),), rounds, SETTLED)


def _line(value: np.ndarray, known: np.ndarray) -> np.ndarray:
    x = value.copy()
    gaps, have = np.flatnonzero(~known), np.flatnonzero(known)
    x[gaps] = np.interp(gaps, have, value[have])
    return x


def _settle(value: np.ndarray, known: np.ndarray, parts: tuple, rounds: int, tolerance: float) -> tuple[np.ndarray, bool]:
    x = _line(value, known)
    gaps, n = np.flatnonzero(~known), len(value)
    centre, spread = value[known].mean(), value[known].std()
    if not len(gaps) or n < 4 or spread == 0 or not np.isfinite(spread):
        return x, True
    x -= centre
    parts = [(min(window, n // 2), rank, weight) for window, rank, weight in parts]
    held = [np.convolve(np.ones(window), np.ones(n - window + 1))[gaps] for window, _, _ in parts]  # entries on each anti-diagonal
    settled = False
    for _ in range(rounds):
        new = np.zeros(len(gaps))
        for (window, rank, weight), entries in zip(parts, held, strict=True):
            hankel = np.lib.stride_tricks.sliding_window_view(x, n - window + 1)
            products = hankel @ hankel.T
            lead = np.linalg.eigh(products + products[::-1, ::-1])[1][:, -rank:]  # the same read forwards and backwards
            scores = lead.T @ hankel
            rebuilt = sum(np.convolve(lead[:, j], scores[j]) for j in range(lead.shape[1]))
            new += weight * rebuilt[gaps] / entries
        moved = np.abs(new - x[gaps]).max()
        x[gaps] = new
        if moved <= tolerance * spread:
            settled = True
            break
    return x + centre, settled


def choose_embedding(value: np.ndarray, known: np.ndarray) -> tuple:
    """How to embed a series, by the squared error at readings hidden from the trial; empty for the straight line."""
    inner = np.flatnonzero(known)[1:-1]
    hidden = inner[HIDDEN // 2 :: HIDDEN]
    if not len(hidden):
        return ()
    left = known.copy()
    left[hidden] = False
    start = np.where(left, value, 0.0)
    error = lambda x: float(np.square(x[hidden] - value[hidden]).sum())
    long = ((WINDOW, RANK, 1.0),)
    line, *tried = (error(x) for x in (_line(start, left), *(_settle(start, left, parts, ROUNDS, TRIAL_SETTLED)[0] for parts in (SHORT, long))))
    if len(hidden) >= WINDOW and tried[1] < CLEARLY * min(line, tried[0]):  # fewer readings than rows say nothing of the window
        return long
    return SHORT if tried[0] < line else ()


def impute(value: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, bool, int]:
    """The imputed series, whether it settled, and the rows of its longest Hankel matrix, 1 for the straight line."""
    parts = choose_embedding(value, known) if not known.all() else ()
    if not parts:
        return _line(value, known), True, 1
    return (*_settle(value, known, parts, ROUNDS, SETTLED), max(p[0] for p in parts))


def _dense(grid: int, slots: np.ndarray, values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all periods, values, whether known, and counts."""
    slots = np.asarray(slots, "int64")
    at = (slots - slots.min()) // grid
    n = int(at.max()) + 1
    value, known, count = np.zeros(n), np.zeros(n, bool), np.zeros(n, "int64")
    value[at], known[at], count[at] = values, True, counts
    return slots.min() + grid * np.arange(n), value, known, count


def _in_parts(made: Iterator[dict[str, np.ndarray]]) -> Iterator[pd.DataFrame]:
    """Series put together up to ``FLUSH`` periods."""
    held, size = [], 0
    for one in made:
        held.append(one)
        size += len(one["slot_s"])
        if size >= FLUSH:
            yield pd.DataFrame({c: np.concatenate([h[c] for h in held]) for c in one})
            held, size = [], 0
    if held:
        yield pd.DataFrame({c: np.concatenate([h[c] for h in held]) for c in held[0]})


def _series(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for pdf in batches:
        for source, grid, slots, values, counts in zip(pdf["source"], pdf["grid"], pdf["slots"], pdf["values"], pdf["counts"], strict=True):
            yield source, grid, *_dense(grid, slots, values, counts)


def _fill_series(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def each() -> Iterator[dict[str, np.ndarray]]:
        for source, _, slot, value, known, count in _series(batches):
            filled, settled, window = impute(value, known)
            n = len(slot)
            yield {"source": np.full(n, source, object), "slot_s": slot, "value": filled, "n": count, "filled": ~known, "settled": np.full(n, settled), "window": np.full(n, window)}

    yield from _in_parts(each())


def _fill_hidden(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every tenth known period inside a series, hidden together, beside what the imputation and a straight line make of it."""

    def each() -> Iterator[dict[str, np.ndarray]]:
        for _, grid, slot, value, known, _ in _series(batches):
            inner = np.flatnonzero(known)[1:-1]
            spread = value[known].std()
            hidden = inner[4::10]
            if not len(hidden) or spread == 0 or not np.isfinite(spread):
                continue
            left = known.copy()
            left[hidden] = False
            start = np.where(left, value, 0.0)
            filled, settled, window = impute(start, left)
            n = len(hidden)
            yield {"slot_s": slot[hidden], "grid_s": np.full(n, grid), "window": np.full(n, window), "settled": np.full(n, settled), "fill": (filled - value)[hidden] / spread, "line": (_line(start, left) - value)[hidden] / spread}

    yield from _in_parts(each())


def regular_grid(
    df: DataFrame,
    feeds: DataFrame,
    source: str = "symbol",
    feed: str = "feed_id",
    time: str = "date",
    value: str = "close",
    grid: str = "grid_s",
) -> DataFrame:
    """``source, slot_s, value, n, filled, settled, window``: per source and UTC day the periods from its first to its last reading.

    * ``slot_s`` is the period's start, a multiple of the feed's ``grid_s`` since 1970 UTC, in seconds; a period holds
      its start and not its end; ``value`` is the mean of its ``n`` readings, or the imputed value where ``filled``;
    * ``window`` is the number of rows of the Hankel matrix that filled the series, 1 for a straight line or where nothing was missing;
    * ``settled`` is false in all periods of a series whose imputed values still moved after ``ROUNDS`` rounds;
    * null, NaN and infinite values are no readings; nor are rows with a null or blank source, a null time, or a feed
      that has no positive ``grid_s``; a day without readings has no periods;
    * repeated rows weigh on their period's mean, not on the periods; a source with several feeds has the finest grid;
    * an empty table gives no rows; other columns are ignored, whatever their names.
    """
    schema = "source string, slot_s bigint, value double, n bigint, filled boolean, settled boolean, window int"
    return _day_series(df, feeds, source, feed, time, value, grid).mapInPandas(_fill_series, schema)


def holdout_error(df: DataFrame, feeds: DataFrame, source: str = "symbol", feed: str = "feed_id", time: str = "date", value: str = "close", grid: str = "grid_s") -> DataFrame:
    """``grid_s, n_hidden, rmse_fill, rmse_line, n_unsettled`` per period length and, with a null ``grid_s``, over all: how well the imputation of :func:`regular_grid` meets readings.

    Of every series a tenth of the known periods inside it are hidden; errors are in standard deviations of the series,
    those of a straight line stand beside them. Series too short to hide anything, or without spread, take no part.
    """
    schema = "slot_s bigint, grid_s bigint, window int, settled boolean, fill double, line double"
    hidden = _day_series(df, feeds, source, feed, time, value, grid).mapInPandas(_fill_hidden, schema)
    rmse = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    return hidden.rollup("grid_s").agg(F.count("*").alias("n_hidden"), rmse("fill").alias("rmse_fill"), rmse("line").alias("rmse_line"), F.count_if(~F.col("settled")).alias("n_unsettled"))


def _day_series(df: DataFrame, feeds: DataFrame, source: str, feed: str, time: str, value: str, grid: str) -> DataFrame:
    """``source, grid, slots, values, counts``: the periods with readings of each source and UTC day, as arrays."""
    rows = df.select(
        clean_symbol(F.col(source)).alias("source"),
        F.col(feed).alias("_f"),
        F.floor(F.unix_micros(F.col(time).try_cast("timestamp")) / 1_000_000).cast("bigint").alias("t"),
        finite(F.col(value)).alias("v"),
    ).where("source IS NOT NULL AND t IS NOT NULL AND v IS NOT NULL")
    periods = feeds.where(F.col(grid) > 0).groupBy(F.col(feed).alias("_g")).agg(F.min(grid).cast("bigint").alias("grid"))
    rows = rows.join(periods, F.col("_f") == F.col("_g"))
    slot = F.col("t") - F.pmod("t", F.col("grid"))
    slots = rows.groupBy("source", "grid", slot.alias("slot")).agg(F.avg("v").alias("v"), F.count("v").alias("n"))
    series = slots.groupBy("source", "grid", F.floor(F.col("slot") / 86_400).alias("day")).agg(
        F.collect_list(F.struct("slot", "v", "n")).alias("s")
    )
    return series.select("source", "grid", F.col("s.slot").alias("slots"), F.col("s.v").alias("values"), F.col("s.n").alias("counts"))
