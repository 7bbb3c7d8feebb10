"""Panels in long form: positions, alignment rules and the fixture panels built from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions.exprs import clean_symbol, finite, scalar


def normalise(df: DataFrame, symbol: str = "symbol", time: str = "ts", **values: str) -> DataFrame:
    """Clean symbols, NaN and infinities to null, one row per symbol and time (the last by value where several differ)."""
    named = [finite(F.col(c)).alias(a) for a, c in values.items()]
    rows = df.select(clean_symbol(F.col(symbol)).alias("symbol"), F.col(time).alias("ts"), *named).where("symbol IS NOT NULL AND ts IS NOT NULL")
    return rows.groupBy("symbol", "ts").agg(*[F.max(a).alias(a) for a in values])


def positions(df: DataFrame, by: str = "symbol", order: str = "ts") -> DataFrame:
    """Adds ``pos`` (from 0, oldest first), ``n`` and ``tail_pos`` (from 1, newest first) within each series."""
    w = Window.partitionBy(by)
    return df.withColumn("pos", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("tail_pos", F.col("n") - F.col("pos"))


def align_longest(df: DataFrame, need: int = 1) -> tuple[DataFrame, DataFrame]:
    """Rule A: the names with as many rows as the longest one, and the names skipped with their lengths."""
    p = positions(df)
    both = p.withColumn("depth", scalar(p.agg(F.max("n").alias("depth")))["depth"])
    kept = both.where((F.col("n") == F.col("depth")) & (F.col("n") >= need)).drop("depth", "tail_pos")
    skipped = both.where((F.col("n") < F.col("depth")) | (F.col("n") < need)).groupBy("symbol").agg(F.max("n").alias("n"))
    return kept, skipped


def align_tail(signal: DataFrame, prices: DataFrame, need: int = 2) -> tuple[DataFrame, DataFrame]:
    """Rule B: names that both panels hold with at least ``need`` rows, cut to the shortest one's depth from the end.

    Returns rows ``symbol, t, depth, value, close`` (t from 0, oldest first) and the skipped names.
    """
    s = positions(signal.where("value IS NOT NULL")).select("symbol", "tail_pos", F.col("n").alias("ns"), "value")
    p = positions(prices.where("close IS NOT NULL")).select("symbol", "tail_pos", F.col("n").alias("np"), "close")
    joined = s.join(p, ["symbol", "tail_pos"]).withColumn("m", F.least("ns", "np"))
    kept = joined.where(F.col("m") >= need)
    depth = scalar(kept.agg(F.min("m").alias("depth")))["depth"]
    rows = kept.withColumn("depth", depth).where("tail_pos <= depth")
    rows = rows.select("symbol", (F.col("depth") - F.col("tail_pos")).alias("t"), "depth", "value", "close")
    names = s.select("symbol").union(p.select("symbol")).distinct()
    return rows, names.join(kept.select("symbol").distinct(), "symbol", "left_anti")


def forward_return(rows: DataFrame, horizon: int) -> DataFrame:
    """Adds ``fwd``: the return over the next ``horizon`` rows of the symbol; null past the end or from a zero start."""
    w = Window.partitionBy("symbol").orderBy("t")
    return rows.withColumn("fwd", F.try_divide(F.lead("close", horizon).over(w), F.col("close")) - 1)


# --- fixture panels -----------------------------------------------------------------------------------------------


def _lines(spark: SparkSession, d: str) -> DataFrame:
    line = spark.read.parquet(f"{d}/lineitem.parquet").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount")
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_brand")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey"))


def _weekly(spark: SparkSession, d: str):
    ts = F.date_trunc("week", "l_shipdate").cast("date").alias("ts")
    return _lines(spark, d).groupBy(F.col("p_brand").alias("symbol"), ts)


def brand_prices(spark: SparkSession, d: str) -> DataFrame:
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return _weekly(spark, d).agg(
        F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 6).alias("close"), F.round(F.max(unit), 6).alias("high"), F.round(F.min(unit), 6).alias("low")
    )


def brand_signal(spark: SparkSession, d: str) -> DataFrame:
    weighted = F.sum(F.col("l_extendedprice") * F.col("l_discount")) / F.sum("l_extendedprice")
    return _weekly(spark, d).agg(F.round(weighted, 8).alias("value"), F.round(F.ln(F.sum("l_quantity")), 8).alias("size"))


def market_returns(spark: SparkSession, d: str) -> DataFrame:
    """``series_id, pos, ts, close, ret``: one market series, week by week."""
    ts = F.date_trunc("week", "l_shipdate").cast("date").alias("ts")
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    weekly = line.groupBy(ts).agg(F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 6).alias("close")).withColumn("series_id", F.lit("market"))
    return returns_of(weekly)


def segment_returns(spark: SparkSession, d: str) -> DataFrame:
    """The same for five sleeves: mean order value by market segment."""
    orders = spark.read.parquet(f"{d}/orders.parquet").join(spark.read.parquet(f"{d}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey"))
    ts = F.date_trunc("week", "o_orderdate").cast("date").alias("ts")
    return returns_of(orders.groupBy(F.col("c_mktsegment").alias("series_id"), ts).agg(F.round(F.avg("o_totalprice"), 4).alias("close")))


def returns_of(levels: DataFrame) -> DataFrame:
    w = Window.partitionBy("series_id").orderBy("ts")
    r = levels.withColumn("ret", F.round(F.try_divide("close", F.lag("close").over(w)) - 1, 10)).withColumn("pos", F.row_number().over(w) - 2)
    return r.where("ret IS NOT NULL").select("series_id", "pos", "ts", "close", "ret")


#: the same panels in DuckDB's SQL, as common table expressions
SQL = {
    "prices": """prices AS (SELECT p_brand AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS ts, round(sum(l_extendedprice) / sum(l_quantity), 6) AS close,
        round(max(l_extendedprice / l_quantity), 6) AS high, round(min(l_extendedprice / l_quantity), 6) AS low
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)""",
    "signal": """signal AS (SELECT p_brand AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS ts, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 8) AS value,
        round(ln(sum(l_quantity)), 8) AS size FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)""",
    "pos": """pos AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM prices)""",
    "market": """market AS (SELECT 'market' AS series_id, row_number() OVER (ORDER BY ts) - 1 AS pos, ts, close, ret FROM (SELECT ts, close, round(close / lag(close) OVER (ORDER BY ts) - 1, 10) AS ret
      FROM (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS ts, round(sum(l_extendedprice) / sum(l_quantity), 6) AS close FROM lineitem GROUP BY 1)) WHERE ret IS NOT NULL)""",
    "sleeves": """sleeves AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS pos, ts, close, ret FROM (SELECT series_id, ts, close, round(close / lag(close) OVER (PARTITION BY series_id ORDER BY ts) - 1, 10) AS ret
      FROM (SELECT c_mktsegment AS series_id, CAST(date_trunc('week', o_orderdate) AS DATE) AS ts, round(avg(o_totalprice), 4) AS close FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)) WHERE ret IS NOT NULL)""",
    "aligned": """sp AS (SELECT symbol, value, count(*) OVER (PARTITION BY symbol) - row_number() OVER (PARTITION BY symbol ORDER BY ts) + 1 AS tp, count(*) OVER (PARTITION BY symbol) AS ns FROM signal),
      pp AS (SELECT symbol, close, count(*) OVER (PARTITION BY symbol) - row_number() OVER (PARTITION BY symbol ORDER BY ts) + 1 AS tp, count(*) OVER (PARTITION BY symbol) AS np FROM prices),
      aligned AS (SELECT symbol, depth - tp AS t, depth, value, close FROM (SELECT symbol, tp, value, close, min(least(ns, np)) OVER () AS depth FROM sp JOIN pp USING (symbol, tp)) WHERE tp <= depth)""",
}
