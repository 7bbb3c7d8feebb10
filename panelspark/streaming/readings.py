"""The same readings as a stream: watermarked windows, repeated deliveries dropped, gaps per source as state.

An extension of the batch operators for sources that arrive continuously; every function takes and returns a
streaming (or, for tests and backfills, a batch) DataFrame.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _marked(stream: DataFrame, time: str, late: str | None) -> DataFrame:
    return stream.withWatermark(time, late) if late else stream


def windowed_totals(stream: DataFrame, time: str = "ts", key: str = "event_type", value: str = "value", size: str = "1 hour", slide: str | None = None, late: str | None = "10 minutes") -> DataFrame:
    """Counts and sums per key and tumbling (or sliding) window; rows later than ``late`` are dropped.

    ``late`` is null where the stream has its watermark already, such as one of :func:`first_deliveries`.
    """
    w = F.window(time, size, slide) if slide else F.window(time, size)
    agg = _marked(stream, time, late).groupBy(w.alias("w"), F.col(key).alias("key")).agg(F.count(value).alias("n"), F.sum(value).alias("total"))
    return agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "key", "n", "total")


def sessions(stream: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str | None = "10 minutes") -> DataFrame:
    """Sessions of a key, closed by a gap."""
    agg = _marked(stream, time, late).groupBy(F.session_window(time, gap).alias("w"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return agg.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "key", "n")


def first_deliveries(stream: DataFrame, keys: list[str], time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each reading once, however often it is delivered within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def period_gaps(stream: DataFrame, source: str = "source", time: str = "ts", grid_s: int = 60) -> DataFrame:
    """``source, slot_s`` of each period without a reading between two periods that have one, as soon as the later arrives.

    The state per source is one number, the last period seen; readings of earlier periods are ignored.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        slots = sorted({int(t) for b in batches for t in b["slot"]})
        last = state.get[0] if state.exists else None
        out: list[int] = []
        for s in slots:
            if last is not None and s > last:
                out += range(last + grid_s, s, grid_s)
            last = s if last is None else max(last, s)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"source": [key[0]] * len(out), "slot_s": out})

    t = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / 1_000_000).cast("bigint")
    rows = stream.select(F.col(source).cast("string").alias("source"), (t - F.pmod(t, F.lit(grid_s))).alias("slot")).where("source IS NOT NULL AND slot IS NOT NULL")
    return rows.groupBy("source").applyInPandasWithState(run, "source string, slot_s bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)
