"""Health of a universe before it is used: lengths, spikes, stale runs, and who is live when."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.exprs import scalar
from panelspark.plans.panels import positions

SPIKE, STALE_RUN, MAX_NAMED, MAX_BINS, MAX_BUCKETS = 0.40, 5, 24, 20, 48


def name_health(prices: DataFrame) -> DataFrame:
    """One row per symbol: ``n, readable, nonpositive, n_spikes, worst_move_pct, n_stale_runs, first_ts, last_ts``.

    A name is readable if none of its closes is null. A stale run is a maximal run of equal closes of length 5 or more.
    """
    p = positions(prices)
    w = Window.partitionBy("symbol").orderBy("pos")
    prev = F.lag("close").over(w)
    p = p.select("*", F.abs(F.try_divide("close", prev) - 1).alias("move"), F.coalesce((F.col("close") != prev).cast("int"), F.lit(1)).alias("fresh"))
    p = p.withColumn("run", F.sum("fresh").over(w))
    runs = p.where("close IS NOT NULL").groupBy("symbol", "run").agg(F.count("*").alias("k")).groupBy("symbol").agg(F.count_if(F.col("k") >= STALE_RUN).alias("n_stale_runs"))
    per = p.groupBy("symbol").agg(
        F.count("*").alias("n"),
        (F.count("close") == F.count("*")).alias("readable"),
        (F.count_if(F.col("close") <= 0) > 0).alias("nonpositive"),
        F.count_if(F.col("move") >= SPIKE).alias("n_spikes"),
        (F.max(F.when(F.col("move") >= SPIKE, F.col("move"))) * 100).alias("worst_move_pct"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    return per.join(runs, "symbol", "left").na.fill(0, ["n_stale_runs"])


def profile(prices: DataFrame) -> DataFrame:
    """One row of counts over the universe, with the first names of each kind (at most 24, in order)."""
    h = name_health(prices)
    ends = scalar(h.where("readable").agg(F.max("n").alias("longest"), F.max("last_ts").alias("panel_last")))
    h = h.withColumn("ends", ends).select("*", "ends.longest", "ends.panel_last")
    ok = F.col("readable")
    kinds = {
        "unreadable": ~ok,
        "ragged": ok & (F.col("n") < F.col("longest")),
        "nonpositive": ok & F.col("nonpositive"),
        "spike_names": ok & (F.col("n_spikes") > 0),
        "stale_names": ok & (F.col("n_stale_runs") > 0),
        "ends_early": ok & (F.col("last_ts") < F.col("panel_last")),
    }
    # the least 24 names of each kind: the limit on the rank is applied before the shuffle, so no task holds all names
    tagged = h.select("symbol", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]))).alias("kind"))
    least = tagged.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("symbol"))).where(F.col("r") <= MAX_NAMED)
    listed = least.groupBy("kind").agg(F.array_join(F.array_sort(F.collect_list("symbol")), ",").alias("names"))
    names = scalar(listed.agg(*[F.coalesce(F.max(F.when(F.col("kind") == k, F.col("names"))), F.lit("")).alias(k) for k in kinds]))
    counts = h.agg(
        F.count("*").alias("n_names"),
        F.count_if(ok).alias("usable"),
        F.max(F.when(ok, F.col("n"))).alias("n_obs_max"),
        F.min(F.when(ok, F.col("n"))).alias("n_obs_min"),
        F.percentile(F.when(ok, F.col("n")), 0.5).alias("n_obs_median"),
        F.sum(F.when(ok, F.col("n_spikes"))).alias("n_spikes"),
        *[F.count_if(c).alias(f"n_{k}") for k, c in kinds.items()],
    )
    return counts.withColumn("names", names).select(*counts.columns, "names.*")


def worst_moves(prices: DataFrame, top_n: int = MAX_NAMED) -> DataFrame:
    """The ``top_n`` names with the largest single-period moves of 40 % or more."""
    h = name_health(prices).where("readable AND worst_move_pct IS NOT NULL")
    return h.select("symbol", "worst_move_pct", "n_spikes").orderBy(F.desc("worst_move_pct"), "symbol").limit(top_n)


def length_deciles(prices: DataFrame) -> DataFrame:
    """``decile, length``: percentiles 10 to 100 of the readable names' lengths."""
    ps = [i / 10 for i in range(1, 11)]
    one = name_health(prices).where("readable").agg(F.percentile("n", F.array(*map(F.lit, ps))).alias("q"))
    return one.select(F.posexplode("q").alias("i", "length")).select(((F.col("i") + 1) * 10).alias("decile"), "length")


def histogram(df: DataFrame, value: str, bins=None, at_most: int = MAX_BINS) -> DataFrame:
    """``bin, low, high, count`` of equal-width bins, the last one closed; no rows when all values are equal.

    Without ``bins`` there are max(4, √n) of them, at most ``at_most``.
    """
    v = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    k = F.lit(int(bins)) if bins else F.least(F.lit(at_most), F.greatest(F.lit(4), F.floor(F.sqrt("m")))).cast("int")
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("m")).where("lo < hi").withColumn("k", k)
    width = (F.col("hi") - F.col("lo")) / F.col("k")
    placed = v.withColumn("e", scalar(ends)).where("e IS NOT NULL").select("v", "e.lo", "e.hi", "e.k")
    counts = placed.groupBy(F.least(F.floor((F.col("v") - F.col("lo")) / width), F.col("k") - 1).alias("bin")).agg(F.count("*").alias("c"))
    grid = ends.select("lo", "k", width.alias("w"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("bin"))
    return grid.join(counts, "bin", "left").select(F.col("bin").cast("int").alias("bin"), (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), F.coalesce("c", F.lit(0)).alias("count"))


def live_by_period(prices: DataFrame, buckets: int = MAX_BUCKETS) -> DataFrame:
    """``bucket, period, n_live``: names whose span covers any part of each slice of the union calendar.

    The calendar's dates, one row each, are cut by position into at most 48 slices with half-even bounds. A name adds
    one to the slices from its first date's to its last date's, so spans are exploded over slices, not joined to dates.
    """
    spans = name_health(prices).where("readable").select("symbol", "first_ts", "last_ts")
    cal = prices.select("ts").distinct()
    n = scalar(cal.agg(F.count("*").alias("nd")))["nd"]
    pos = cal.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("ts")) - 1).withColumn("nd", n)  # one row a date
    k = F.least(F.lit(buckets), F.col("nd")).cast("int")
    bound = lambda b: F.bround(b * F.col("nd") / k)
    guess = F.floor(F.col("i") * k / F.col("nd"))
    slot = F.when(F.col("i") >= bound(guess + 1), guess + 1).when(F.col("i") < bound(guess), guess - 1).otherwise(guess)
    pos = pos.where("nd >= 2").select("ts", slot.cast("int").alias("bucket"))
    starts = pos.groupBy("bucket").agg(F.min("ts").alias("period"))
    at = lambda c, a: pos.select(F.col("ts").alias(c), F.col("bucket").alias(a))
    live = spans.join(at("first_ts", "a"), "first_ts").join(at("last_ts", "b"), "last_ts").select(F.explode(F.sequence("a", "b")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    return starts.join(live, "bucket", "left").select("bucket", "period", F.coalesce("n", F.lit(0)).alias("n_live"))
