"""Queries of the cross-sectional operators on fixture panels, each with its equal in DuckDB's SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import health, panel, screen, signals, technical
from panelspark.plans import panels as P
from panelspark.queries.registry import ctes, query


# --- screening and technical features -----------------------------------------------------------------------------

_METRICS = f"""{ctes("prices", "pos")},
 d AS (SELECT *, n - pos AS tp, lag(close) OVER (PARTITION BY symbol ORDER BY pos) AS prev FROM pos),
 w AS (SELECT *, close - prev AS delta, CASE WHEN pos <= 14 THEN pow(1 - 1/14.0, n - 1 - 14) / 14 ELSE pow(1 - 1/14.0, n - 1 - pos) / 14 END AS wt FROM d),
 a AS (SELECT symbol, count(*) AS n_observations, max(close) FILTER (tp = 1) AS last_close, max(close) FILTER (tp = 14) AS c0,
   sum(greatest(delta, 0) * wt) AS up, sum(greatest(-delta, 0) * wt) AS down, avg(close) FILTER (tp <= 50) AS sma50,
   max(close) FILTER (tp = 27) AS start, stddev_samp(delta / nullif(prev, 0)) FILTER (tp <= 26) AS sd FROM w GROUP BY 1),
 metrics AS (SELECT symbol, n_observations, round(last_close, 6) AS last_close,
   CASE WHEN n_observations >= 15 THEN round(CASE WHEN down = 0 AND up = 0 THEN 50 WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END, 4) END AS rsi,
   round((last_close - start) / nullif(start, 0) * 100, 6) AS return_pct,
   CASE WHEN n_observations >= 50 THEN round((last_close - sma50) / nullif(sma50, 0) * 100, 6) END AS distance_from_sma_pct,
   CASE WHEN n_observations >= 27 THEN round(sd * sqrt(252) * 100, 6) END AS volatility_pct FROM a)"""
_WINDOWS = {"rsi_window": 14, "sma_window": 50, "return_lookback": 26, "vol_lookback": 26}
_FILTERS = {"rsi": {"min": 40, "max": 70}, "volatility_pct": {"max": 900}}
_PASSED = "CASE WHEN rsi IS NULL THEN NULL WHEN rsi < 40 OR rsi > 70 THEN false WHEN volatility_pct IS NULL THEN NULL WHEN volatility_pct > 900 THEN false ELSE true END"


@query(f"{_METRICS} SELECT * FROM metrics", "last_close rsi return_pct distance_from_sma_pct volatility_pct", 4)
def screen_metrics(spark, d):
    return screen.screen_metrics(P.brand_prices(spark, d), **_WINDOWS)


@query(
    f"""{_METRICS} SELECT symbol, n_observations, last_close, rsi, return_pct, distance_from_sma_pct, volatility_pct, return_pct AS score,
      CAST(row_number() OVER (ORDER BY return_pct DESC, symbol DESC) AS INTEGER) AS rank FROM metrics WHERE return_pct IS NOT NULL AND {_PASSED} ORDER BY return_pct DESC, symbol DESC LIMIT 10""",
    "last_close rsi return_pct distance_from_sma_pct volatility_pct score",
    4,
)
def screen_top(spark, d):
    return screen.screen_universe(P.brand_prices(spark, d), top_n=10, filters=_FILTERS, **_WINDOWS)[0]


@query(
    f"""{_METRICS}, p AS (SELECT *, {_PASSED} AS passed, return_pct IS NOT NULL AS known FROM metrics)
      SELECT count(*) AS universe_size, count(*) FILTER (known) AS n_evaluated, count(*) FILTER (NOT known) AS n_insufficient, count(*) FILTER (known AND passed) AS n_passing,
      count(*) FILTER (known AND NOT passed) AS n_failing, count(*) FILTER (known AND passed IS NULL) AS n_undetermined, least(count(*) FILTER (known AND passed), 10) AS n_returned FROM p"""
)
def screen_coverage(spark, d):
    return screen.screen_universe(P.brand_prices(spark, d), top_n=10, filters=_FILTERS, **_WINDOWS)[1]


@query(
    f"""{_METRICS}, e AS (SELECT symbol, sum(close * CASE WHEN pos < 12 THEN pow(1 - 2/13.0, n - 12) / 12 ELSE 2/13.0 * pow(1 - 2/13.0, n - 1 - pos) END) AS ema_12,
      sum(greatest(high - low, abs(high - prev), abs(low - prev)) * wt) FILTER (prev IS NOT NULL) AS atr_14 FROM w GROUP BY 1)
      SELECT symbol, n_observations, last_close, sma50 AS sma_50, ema_12,
      CASE WHEN n_observations >= 15 THEN CASE WHEN down = 0 AND up = 0 THEN 50 WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END END AS rsi_14, atr_14 FROM metrics JOIN e USING (symbol) JOIN (SELECT symbol, sma50, up, down FROM a) USING (symbol)""",
    "last_close sma_50 ema_12 rsi_14 atr_14",
    3,
)
def ta_features(spark, d):
    r = technical.technical_features(P.brand_prices(spark, d), sma_windows=(50,), ema_windows=(12,))
    return r.select("symbol", "n_observations", "last_close", "sma_50", "ema_12", "rsi_14", "atr_14")


@query()
def ta_flags(spark, d):
    r = technical.technical_features(P.brand_prices(spark, d), ema_windows=(12, 26))
    return r.withColumn("flags", F.array_join("flags", ",")).withColumn("insufficient", F.array_join("insufficient", ","))


# --- cross-section ------------------------------------------------------------------------------------------------


@query(f"{ctes('signal')} SELECT symbol, ts, CASE WHEN count(value) OVER (PARTITION BY ts) >= 2 THEN CAST(row_number() OVER (PARTITION BY ts ORDER BY value, symbol) - 1 AS INTEGER) END AS rank FROM signal", dates="ts")
def cs_rank(spark, d):
    return panel.cs_rank(P.brand_signal(spark, d)).select("symbol", "ts", "rank")


@query(
    f"{ctes('signal')} SELECT symbol, ts, CASE WHEN count(value) OVER w >= 3 THEN (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) END AS zscore FROM signal WINDOW w AS (PARTITION BY ts)",
    "zscore",
    dates="ts",
)
def cs_zscore(spark, d):
    return panel.cs_zscore(P.brand_signal(spark, d)).select("symbol", "ts", "zscore")


@query(
    f"""{ctes("signal")}, q AS (SELECT ts, count(value) AS m, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM signal GROUP BY 1)
      SELECT symbol, ts, CASE WHEN m >= 3 THEN greatest(least(value, hi), lo) END AS winsorized FROM signal JOIN q USING (ts)""",
    "winsorized",
    10,
    dates="ts",
)
def cs_winsorize(spark, d):
    return panel.cs_winsorize(P.brand_signal(spark, d), 0.05, 0.95).select("symbol", "ts", "winsorized")


@query(f"{ctes('signal')} SELECT symbol, ts, CASE WHEN count(value) OVER w > 1 THEN value - avg(value) OVER w END AS residual FROM signal WINDOW w AS (PARTITION BY ts)", "residual", 11, dates="ts")
def cs_demean(spark, d):
    return panel.cs_neutralize(P.brand_signal(spark, d)).select("symbol", "ts", "residual")


@query(
    f"""{ctes("signal")}, b AS (SELECT ts, count(*) AS m, avg(value) AS mv, avg(size) AS mx, coalesce(covar_pop(size, value) / nullif(var_pop(size), 0), 0) AS slope FROM signal GROUP BY 1)
      SELECT symbol, ts, CASE WHEN m > 2 THEN value - mv - slope * (size - mx) END AS residual FROM signal JOIN b USING (ts)""",
    "residual",
    dates="ts",
)
def cs_neutralize(spark, d):
    return panel.cs_neutralize(P.brand_signal(spark, d), ["size"]).select("symbol", "ts", "residual")


@query(
    f"""{ctes("signal")}, c AS (SELECT symbol, ts, value - avg(value) OVER w AS v, size - avg(size) OVER w AS x, size * size - avg(size * size) OVER w AS y, count(*) OVER w AS m FROM signal WINDOW w AS (PARTITION BY ts)),
      p AS (SELECT ts, sum(x * x) AS xx, sum(y * y) AS yy, sum(x * y) AS xy, sum(x * v) AS xv, sum(y * v) AS yv FROM c GROUP BY 1)
      SELECT symbol, ts, CASE WHEN m > 3 THEN v - (xv * yy - yv * xy) / (xx * yy - xy * xy) * x - (yv * xx - xv * xy) / (xx * yy - xy * xy) * y END AS residual FROM c JOIN p USING (ts)""",
    "residual",
    dates="ts",
)
def cs_neutralize_two(spark, d):
    s = P.brand_signal(spark, d).withColumn("size2", F.col("size") * F.col("size"))
    return panel.cs_neutralize(s, ["size", "size2"]).select("symbol", "ts", "residual")


@query(
    f"""{ctes("prices")}, l AS (SELECT symbol, count(*) AS n FROM prices GROUP BY 1), m AS (SELECT max(n) AS depth FROM l)
      SELECT symbol, n, n = depth AS kept FROM l, m"""
)
def panel_align(spark, d):
    kept, skipped = P.align_longest(P.brand_prices(spark, d))
    return kept.groupBy("symbol").agg(F.max("n").alias("n")).withColumn("kept", F.lit(True)).unionByName(skipped.withColumn("kept", F.lit(False)))


@query(
    f"""{ctes("market")}, e AS (SELECT pos, ret - avg(ret) OVER () AS e, ret FROM market), l AS (SELECT e, ret, lag(e, 1) OVER (ORDER BY pos) AS e1, lag(e, 2) OVER (ORDER BY pos) AS e2, lag(e, 3) OVER (ORDER BY pos) AS e3 FROM e)
      SELECT 'market' AS series_id, count(*) AS n, avg(ret) AS mean, avg(ret) / sqrt((sum(e * e) + 2 * (0.75 * sum(e * e1) + 0.5 * sum(e * e2) + 0.25 * sum(e * e3))) / (count(*) * count(*))) AS t_stat FROM l""",
    "mean t_stat",
)
def nw_tstat(spark, d):
    return panel.newey_west(P.market_returns(spark, d), "ret", 3)


@query(
    f"""{ctes("signal", "prices", "pos")}, z AS (SELECT symbol, ts, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS zscore FROM signal WINDOW w AS (PARTITION BY ts)),
      v AS (SELECT symbol, stddev_samp(close) AS vol FROM prices WHERE symbol <> 'Brand#11' GROUP BY 1)
      SELECT symbol, zscore, coalesce(vol, 1.0) AS vol, 0.05 * coalesce(vol, 1.0) * zscore AS alpha FROM z LEFT JOIN v USING (symbol) WHERE ts = (SELECT max(ts) FROM signal) AND zscore IS NOT NULL""",
    "zscore vol alpha",
)
def grinold(spark, d):
    vols = P.brand_prices(spark, d).where("symbol <> 'Brand#11'").groupBy("symbol").agg(F.stddev_samp("close").alias("vol"))
    return panel.grinold_alpha(P.brand_signal(spark, d), 0.05, vols)


@query(
    f"""{ctes("signal")}, w AS (SELECT symbol, avg(value) AS h, avg(size) AS i FROM signal GROUP BY 1), c AS (SELECT corr(h, i) AS transfer FROM w)
      SELECT transfer, CAST(25 AS BIGINT) AS breadth, transfer * 0.04 * 5 AS information_ratio FROM c""",
    "transfer information_ratio",
)
def breadth_ir(spark, d):
    s = P.brand_signal(spark, d).groupBy("symbol").agg(F.avg("value").alias("h"), F.avg("size").alias("i"))
    return panel.breadth_ir(0.04, 25, s.select("symbol", F.col("h").alias("weight")), s.select("symbol", F.col("i").alias("weight")))


# --- signal evaluation --------------------------------------------------------------------------------------------

_FWD = f"""{ctes("signal", "prices", "aligned")},
 f AS (SELECT *, lead(close, 13) OVER (PARTITION BY symbol ORDER BY t) / nullif(close, 0) - 1 AS fwd FROM aligned),
 g AS (SELECT * FROM f WHERE t % 13 = 0 AND t < depth - 13 AND fwd IS NOT NULL AND value IS NOT NULL),
 r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY value, symbol) - 1 AS rv, row_number() OVER (PARTITION BY t ORDER BY fwd, symbol) - 1 AS rf, count(*) OVER (PARTITION BY t) AS m FROM g),
 ics AS (SELECT t, corr(rv, rf) AS ic, count(*) AS n_names FROM r GROUP BY 1 HAVING count(*) >= 8 AND stddev_pop(value) > 0 AND stddev_pop(fwd) > 0),
 nw AS (SELECT avg(ic) / sqrt((sum(e * e) + sum(e * e1)) / (count(*) * count(*))) AS t FROM (SELECT ic, e, lag(e) OVER (ORDER BY t) AS e1 FROM (SELECT t, ic, ic - avg(ic) OVER () AS e FROM ics))),
 bk AS (SELECT *, CAST(least(floor(rv / m * 5), 4) AS INTEGER) AS bucket FROM r WHERE m >= 8)"""


def _sp(spark, d):
    return P.brand_signal(spark, d), P.brand_prices(spark, d)


@query(f"{ctes('signal', 'prices', 'aligned')} SELECT symbol, CAST(t AS BIGINT) AS t, lead(close, 5) OVER (PARTITION BY symbol ORDER BY t) / nullif(close, 0) - 1 AS fwd FROM aligned", "fwd")
def fwd_ret(spark, d):
    rows, _ = P.align_tail(*_sp(spark, d))
    return P.forward_return(rows, 5).select("symbol", F.col("t").cast("bigint").alias("t"), "fwd")


@query(f"{_FWD} SELECT CAST(t AS BIGINT) AS t, ic, n_names FROM ics", "ic")
def sig_rankcorr(spark, d):
    return signals.period_ics(*_sp(spark, d), 13).select(F.col("t").cast("bigint").alias("t"), "ic", "n_names")


@query(f"{_FWD} SELECT CAST(t AS BIGINT) AS t, corr(value, fwd) AS ic, count(*) AS n_names FROM r GROUP BY 1 HAVING count(*) >= 8", "ic")
def sig_pearson(spark, d):
    return signals.period_ics(*_sp(spark, d), 13, "pearson").select(F.col("t").cast("bigint").alias("t"), "ic", "n_names")


@query(f"{_FWD} SELECT count(ic) AS n_periods, avg(ic) AS mean_ic, avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(ic)) AS ic_t_stat FROM ics", "mean_ic ic_t_stat")
def sig_ic(spark, d):
    return signals.information_coefficient(*_sp(spark, d), 13)


@query(
    f"{_FWD} SELECT count(ic) AS n_periods, avg(ic) AS mean_ic, stddev_samp(ic) AS ic_std, avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(ic)) AS icir, any_value(nw.t) AS nw_t_stat FROM ics, nw",
    "mean_ic ic_std icir nw_t_stat",
)
def sig_icir(spark, d):
    return signals.signal_icir(*_sp(spark, d), 13)


@query(f"{_FWD} SELECT bucket, avg(q) * 100 AS mean_return_pct, count(q) AS n_periods FROM (SELECT t, bucket, avg(fwd) AS q FROM bk GROUP BY 1, 2) GROUP BY 1", "mean_return_pct")
def sig_quantiles(spark, d):
    return signals.quantile_returns(*_sp(spark, d), 13)


def _mean_ic(h: int) -> str:
    return f"""SELECT {h} AS horizon, avg(ic) AS mean_ic, count(ic) AS n_periods FROM (SELECT corr(rv, rf) AS ic FROM (SELECT t, value, fwd, row_number() OVER (PARTITION BY t ORDER BY value, symbol) AS rv, row_number() OVER (PARTITION BY t ORDER BY fwd, symbol) AS rf FROM
      (SELECT *, lead(close, {h}) OVER (PARTITION BY symbol ORDER BY t) / nullif(close, 0) - 1 AS fwd FROM aligned) WHERE t % {h} = 0 AND t < depth - {h} AND fwd IS NOT NULL) GROUP BY t HAVING count(*) >= 8 AND stddev_pop(value) > 0 AND stddev_pop(fwd) > 0)"""


@query(
    f"""{ctes("signal", "prices", "aligned")}, m AS ({" UNION ALL ".join(map(_mean_ic, (1, 5, 13, 26)))}), k AS (SELECT *, horizon > 1 AND abs(mean_ic) <= abs((SELECT mean_ic FROM m WHERE horizon = 1)) / 2 AS halved FROM m)
      SELECT CAST(horizon AS INTEGER) AS horizon, mean_ic, n_periods, coalesce(halved AND horizon = (SELECT min(horizon) FROM k WHERE halved), false) AS is_half_life FROM k""",
    "mean_ic",
)
def sig_decay(spark, d):
    return signals.signal_decay(*_sp(spark, d), (1, 5, 13, 26))


@query(
    f"""{_FWD}, o AS (SELECT t, count(*) AS m, covar_pop(value, fwd) / nullif(var_pop(value), 0) AS slope, pow(covar_pop(value, fwd), 2) / nullif(var_pop(value) * var_pop(fwd), 0) AS r2 FROM g GROUP BY 1),
      k AS (SELECT t, CASE WHEN m >= 8 THEN slope END AS slope, CASE WHEN m >= 8 THEN r2 END AS r2 FROM o),
      v AS (SELECT avg(slope) / sqrt((sum(e * e) + sum(e * e1)) / (count(*) * count(*))) AS t FROM (SELECT slope, e, lag(e) OVER (ORDER BY t) AS e1 FROM (SELECT t, slope, slope - avg(slope) OVER () AS e FROM k WHERE slope IS NOT NULL)))
      SELECT count(slope) AS n_periods, count(*) FILTER (slope IS NULL) AS n_skipped, avg(slope) AS mean_slope, avg(slope) / nullif(stddev_samp(slope), 0) * sqrt(count(slope)) AS t_stat, avg(r2) AS mean_r2, any_value(v.t) AS nw_t_stat FROM k, v""",
    "mean_slope t_stat mean_r2 nw_t_stat",
    5,
)
def fmb(spark, d):
    return signals.fama_macbeth(*_sp(spark, d), 13)


@query(
    f"""{_FWD}, h AS (SELECT t, symbol, fwd, CASE WHEN bucket = 4 THEN 1.0 / count(*) OVER (PARTITION BY t, bucket) WHEN bucket = 0 THEN -1.0 / count(*) OVER (PARTITION BY t, bucket) ELSE 0 END AS w FROM bk),
      s AS (SELECT t, sum(w * fwd) AS spread, row_number() OVER (ORDER BY t) AS k FROM h GROUP BY 1), l AS (SELECT k, symbol, w FROM h JOIN s USING (t) WHERE w <> 0),
      mv AS (SELECT coalesce(a.k, b.k + 1) AS k, abs(coalesce(a.w, 0) - coalesce(b.w, 0)) AS m FROM l a FULL JOIN l b ON a.k = b.k + 1 AND a.symbol = b.symbol)
      SELECT CAST(t AS BIGINT) AS t, spread, turnover FROM s LEFT JOIN (SELECT k, sum(m) / 2 AS turnover FROM mv WHERE k > 1 GROUP BY 1) USING (k)""",
    "spread turnover",
)
def q_book(spark, d):
    return signals.quantile_book(*_sp(spark, d), 13).select(F.col("t").cast("bigint").alias("t"), "spread", "turnover")


# --- health -------------------------------------------------------------------------------------------------------

_LONG = """long_days AS (SELECT upper(trim(symbol)) AS symbol, date AS ts, max(close) AS close FROM long_prices WHERE symbol IS NOT NULL AND trim(symbol) <> '' AND date IS NOT NULL AND isfinite(close) GROUP BY 1, 2),
 lp AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS prev FROM long_days),
 runs AS (SELECT symbol, run, count(*) AS k FROM (SELECT symbol, close, sum(CASE WHEN close <> prev THEN 1 WHEN close IS NULL OR prev IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts) AS run FROM lp) WHERE close IS NOT NULL GROUP BY 1, 2),
 h AS (SELECT symbol, count(*) AS n, count(close) = count(*) AS readable, count(*) FILTER (close <= 0) > 0 AS nonpositive, count(*) FILTER (abs(close / nullif(prev, 0) - 1) >= 0.4) AS n_spikes,
   max(abs(close / nullif(prev, 0) - 1)) FILTER (abs(close / nullif(prev, 0) - 1) >= 0.4) * 100 AS worst_move_pct, min(ts) AS first_ts, max(ts) AS last_ts FROM lp GROUP BY 1),
 hs AS (SELECT h.*, coalesce((SELECT count(*) FROM runs WHERE runs.symbol = h.symbol AND k >= 5), 0) AS n_stale_runs FROM h)"""


def _closes(spark, d):
    return P.normalise(spark.read.parquet(f"{d}/long_prices.parquet"), time="date", close="close").where("close IS NOT NULL")


@query(f"WITH {_LONG} SELECT * FROM hs", "worst_move_pct", dates="first_ts last_ts")
def prof_names(spark, d):
    return health.name_health(_closes(spark, d))


@query(f"WITH {_LONG} SELECT symbol, n_stale_runs FROM hs WHERE n_stale_runs > 0")
def prof_stale(spark, d):
    return health.name_health(_closes(spark, d)).where("n_stale_runs > 0").select("symbol", "n_stale_runs")


_KINDS = {
    "unreadable": "NOT readable",
    "ragged": "readable AND n < (SELECT max(n) FROM hs WHERE readable)",
    "nonpositive": "readable AND nonpositive",
    "spike_names": "readable AND n_spikes > 0",
    "stale_names": "readable AND n_stale_runs > 0",
    "ends_early": "readable AND last_ts < (SELECT max(last_ts) FROM hs WHERE readable)",
}


@query(
    f"""WITH {_LONG} SELECT count(*) AS n_names, count(*) FILTER (readable) AS usable, max(n) FILTER (readable) AS n_obs_max, min(n) FILTER (readable) AS n_obs_min, median(n) FILTER (readable) AS n_obs_median,
      CAST(sum(n_spikes) FILTER (readable) AS BIGINT) AS n_spikes, {", ".join(f"(SELECT count(*) FROM hs WHERE {c}) AS n_{k}" for k, c in _KINDS.items())},
      {", ".join(f"coalesce((SELECT string_agg(symbol, ',' ORDER BY symbol) FROM (SELECT symbol FROM hs WHERE {c} ORDER BY symbol LIMIT 24)), '') AS {k}" for k, c in _KINDS.items())} FROM hs"""
)
def profile(spark, d):
    return health.profile(_closes(spark, d))


@query(f"WITH {_LONG} SELECT symbol, worst_move_pct, n_spikes FROM hs WHERE readable AND worst_move_pct IS NOT NULL ORDER BY worst_move_pct DESC, symbol LIMIT 24", "worst_move_pct")
def prof_worst(spark, d):
    return health.worst_moves(_closes(spark, d))


@query(f"WITH {_LONG} SELECT CAST(i * 10 AS INTEGER) AS decile, (SELECT quantile_cont(n, i / 10.0) FROM hs WHERE readable) AS length FROM (SELECT unnest([1,2,3,4,5,6,7,8,9,10]) AS i)".replace("quantile_cont(n, i / 10.0)", "list_extract(quantile_cont(n, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]), i)"), "length")
def prof_deciles(spark, d):
    return health.length_deciles(_closes(spark, d))


@query(
    f"""WITH {_LONG}, e AS (SELECT min(n) AS lo, max(n) AS hi, CAST(least(20, greatest(4, floor(sqrt(count(*))))) AS INTEGER) AS k FROM hs WHERE readable),
      c AS (SELECT least(floor((n - lo) / ((hi - lo) / k)), k - 1) AS bin, count(*) AS c FROM hs, e WHERE readable GROUP BY 1), g AS (SELECT lo, (hi - lo) / k AS w, unnest(generate_series(0, k - 1)) AS bin FROM e WHERE lo < hi)
      SELECT CAST(g.bin AS INTEGER) AS bin, lo + g.bin * w AS low, lo + (g.bin + 1) * w AS high, coalesce(c, 0) AS count FROM g LEFT JOIN c ON g.bin = c.bin""",
    "low high",
)
def prof_hist(spark, d):
    return health.histogram(health.name_health(_closes(spark, d)).where("readable"), "n")


@query(
    f"""WITH {_LONG}, cal AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS nd FROM (SELECT DISTINCT ts FROM long_days)), k AS (SELECT least(48, max(nd)) AS k, max(nd) AS nd FROM cal),
      b AS (SELECT j AS bucket, round_even(j * nd / k, 0) AS lo, round_even((j + 1) * nd / k, 0) AS hi FROM (SELECT unnest(generate_series(0, k - 1)) AS j, nd, k FROM k)),
      s AS (SELECT a.i AS a, z.i AS z FROM hs JOIN cal a ON a.ts = first_ts JOIN cal z ON z.ts = last_ts WHERE readable)
      SELECT CAST(bucket AS INTEGER) AS bucket, (SELECT ts FROM cal WHERE i = lo) AS period, (SELECT count(*) FROM s WHERE a < hi AND z >= lo) AS n_live FROM b""",
    dates="period",
)
def prof_live(spark, d):
    return health.live_by_period(_closes(spark, d))
