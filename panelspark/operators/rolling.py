"""Problem 4: totals and averages over trailing days, days without activity included.

Rows are reduced to one per entity and day (repeated rows once, map-side combined), laid out densely between an
entity's first and last value, and summed by binary doubling: blocks of 1, 2, 4, 8 ... days are each two shifted
blocks of half their length, and any window is the blocks of its binary digits laid end to end. After the first
shuffle by entity all windows share one partitioning and one sort. A group is bounded by the calendar, one row a
day, however many rows an entity delivers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.exprs import clean_symbol, measured


def trailing_totals(
    df: DataFrame, windows: tuple[int, ...] = (7, 30), entity: str = "symbol", time: str = "date", value: str = "close"
) -> DataFrame:
    """``entity, day, n_W, total_W, mean_W`` for each window W, one row per entity and calendar day.

    * days run from an entity's first to its last value; null and NaN are no value, infinities are values;
    * a row that repeats entity, day and value counts once; different values of one day all count;
    * a window without values has ``n_W`` 0 and null total and mean; days before the first value count as empty;
    * null or blank entities and null days belong to no series; an empty table gives no rows; other columns are ignored.
    """
    if any(w < 1 for w in windows):
        raise ValueError("windows are whole numbers of days, 1 or more")
    v = measured(F.col(value))
    rows = df.select(clean_symbol(F.col(entity)).alias("entity"), F.unix_date(F.col(time).try_cast("date")).alias("d"), v.alias("v"))
    rows = rows.where("entity IS NOT NULL AND d IS NOT NULL AND v IS NOT NULL")
    days = rows.groupBy("entity", "d").agg(F.sum_distinct("v").alias("s1"), F.count_distinct("v").alias("c1"))
    w = Window.partitionBy("entity").orderBy("d")
    # fill: a day is followed by the empty days up to the next one
    ahead = days.withColumn("next", F.coalesce(F.lead("d").over(w), F.col("d") + 1))
    dense = ahead.select("entity", "s1", "c1", F.posexplode(F.sequence("d", F.col("next") - 1)).alias("k", "d")).select(
        "entity", "d", F.when(F.col("k") == 0, F.col("s1")).otherwise(0.0).alias("s1"), F.when(F.col("k") == 0, F.col("c1")).otherwise(0).alias("c1")
    )
    shift = lambda c, k: F.lag(c, k, 0).over(w) if k else F.col(c)
    block = 1
    while 2 * block <= max(windows):
        dense = dense.select("*", *[(F.col(f"{x}{block}") + shift(f"{x}{block}", block)).alias(f"{x}{2 * block}") for x in "sc"])
        block *= 2
    out = []
    for size in windows:
        parts, at = [], 0
        for b in (1 << i for i in reversed(range(size.bit_length()))):
            if size & b:
                parts.append((b, at))
                at += b
        for x in "sc":
            total = shift(f"{x}{parts[0][0]}", parts[0][1])
            for b, k in parts[1:]:
                total = total + shift(f"{x}{b}", k)
            out.append(total.alias(f"_{x}_{size}"))
    res = dense.select("entity", "d", *out)
    cols = [
        c
        for z in windows
        for c in (
            F.col(f"_c_{z}").alias(f"n_{z}"),
            F.when(F.col(f"_c_{z}") > 0, F.col(f"_s_{z}")).alias(f"total_{z}"),
            F.when(F.col(f"_c_{z}") > 0, F.col(f"_s_{z}") / F.col(f"_c_{z}")).alias(f"mean_{z}"),
        )
    ]
    return res.select("entity", F.date_from_unix_date("d").alias("day"), *cols)
