"""Queries of the loaders, alignment and event windows over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators.parse_rows import close_cells
from panelspark.plans import panels as P
from panelspark.queries.pipeline import LINES
from panelspark.queries.registry import ctes, query
from panelspark.sources import panels as src
from panelspark.streaming import readings as st

WIDE = "abexo brivu cintar dolvex emquo fenlup gravik hestom ivorna jaltex kumbri lorvan".split()


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query(
    """SELECT symbol, date, max_by(close, row_id) AS close FROM (SELECT upper(trim(symbol)) AS symbol, trim(date) AS date, close, row_id FROM long_feed
      WHERE symbol IS NOT NULL AND trim(symbol) <> '' AND close IS NOT NULL AND NOT isnan(close)) GROUP BY 1, 2""",
    "close",
)
def src_long(spark, d):
    return src.long_panel(_read(spark, d, "long_feed"), "date", "symbol", "close", "row_id")


@query(
    f"""SELECT upper(symbol) AS symbol, date, max_by(close, row_id) AS close FROM (SELECT row_id, trim(date) AS date, symbol, close FROM (UNPIVOT wide_prices ON {", ".join(WIDE)} INTO NAME symbol VALUE close)
      WHERE close IS NOT NULL AND NOT isnan(close)) GROUP BY 1, 2""",
    "close",
)
def src_wide(spark, d):
    return src.wide_panel(_read(spark, d, "wide_prices"), "date", WIDE, "row_id")


@query("SELECT line_id, CASE WHEN lower(v) NOT IN ('', 'na', 'n/a', 'nan', 'null', 'none', '-') THEN TRY_CAST(replace(v, ',', '') AS DOUBLE) END AS value FROM (SELECT line_id, trim(regexp_extract(line, '([0-9][0-9,.]*)$', 1)) AS v FROM long_lines) WHERE v <> '' AND TRY_CAST(replace(v, ',', '') AS DOUBLE) IS NOT NULL", "value", 9)
def src_num(spark, d):
    rows = _read(spark, d, "long_lines").select("line_id", F.regexp_extract("line", r"([0-9][0-9,.]*)\z", 1).alias("v"))
    return rows.select("line_id", src.number(F.col("v")).alias("value")).where("value IS NOT NULL")


@query(
    f"""{LINES} SELECT line_id, CASE WHEN ok AND lower(close) NOT IN ('', 'na', 'n/a', 'nan', 'null', 'none', '-') AND NOT isnan(TRY_CAST(replace(close, ',', '') AS DOUBLE)) THEN TRY_CAST(replace(close, ',', '') AS DOUBLE) END AS value FROM v""",
    "value",
)
def src_num_cells(spark, d):
    """Every whole close cell of the body lines; null where it holds no number. src_num sees only what digits, commas and dots end a line."""
    return close_cells(_read(spark, d, "long_lines")).select("line_id", src.number(F.col("cell")).alias("value"))


_SYMBOLS = "w AS (SELECT DISTINCT upper(trim(symbol)) AS symbol FROM documents WHERE symbol IS NOT NULL AND trim(symbol) <> ''), p AS (SELECT DISTINCT upper(trim(symbol)) AS symbol FROM long_prices WHERE symbol IS NOT NULL AND trim(symbol) <> '')"


@query(f"WITH {_SYMBOLS} SELECT symbol, symbol IN (SELECT symbol FROM p) AS kept FROM w")
def coverage(spark, d):
    panel = P.normalise(_read(spark, d, "long_prices"), time="date", close="close")
    kept, missing = src.coverage(panel, _read(spark, d, "documents"))
    return kept.select("symbol").distinct().withColumn("kept", F.lit(True)).unionByName(missing.withColumn("kept", F.lit(False)))


@query(
    f"{ctes('prices')}, r AS (SELECT symbol AS series_id, row_number() OVER w - 2 AS pos, close / nullif(lag(close) OVER w, 0) - 1 AS ret FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY ts)) SELECT series_id, pos, ret FROM r WHERE pos >= 0",
    "ret",
)
def sym_returns(spark, d):
    return src.symbol_returns(P.brand_prices(spark, d), "ts").select("series_id", F.col("pos").cast("bigint").alias("pos"), "ret")


@query(f"{ctes('signal', 'prices', 'aligned')} SELECT symbol, CAST(t AS BIGINT) AS t, CAST(depth AS BIGINT) AS depth, value, close FROM aligned", "value close", 8)
def tail_join(spark, d):
    rows, _ = P.align_tail(P.brand_signal(spark, d), P.brand_prices(spark, d))
    return rows.select("symbol", F.col("t").cast("bigint").alias("t"), F.col("depth").cast("bigint").alias("depth"), "value", "close")


@query(
    "SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS VARCHAR) AS window_start, event_type AS key, count(value) AS n, sum(value) AS total FROM events GROUP BY 1, 2",
    "total",
    4,
)
def event_windows(spark, d):
    e = _read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    r = st.windowed_totals(e, late=None)
    return r.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "key", "n", "total")


@query(
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
      SELECT user_id AS key, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def event_sessions(spark, d):
    e = _read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    r = st.sessions(e, gap="12 hours", late=None)
    return r.select("key", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")
