"""Queries of sweeps, backtests, covariance and allocation, pairs, factors and processes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.operators import backtest as bt
from panelspark.operators import covariance as cov
from panelspark.operators import factors as fac
from panelspark.operators import pairs as pr
from panelspark.operators import process as proc
from panelspark.operators import sweep as sw
from panelspark.plans import panels as P
from panelspark.queries.registry import ctes, query
from panelspark.queries.series import _TRIALS, _sma_trials

# --- sweeps -------------------------------------------------------------------------------------------------------

_GRID = {"fast": [3, 5, 8], "slow": [13, 26, 52]}


@query(
    """SELECT CAST(row_number() OVER (ORDER BY f, s) - 1 AS INTEGER) AS trial_id, params, substr(sha256(params), 1, 12) AS params_hash
      FROM (SELECT f, s, '{"fast": ' || f || ', "slow": ' || s || '}' AS params FROM (SELECT unnest([3, 5, 8]) AS f), (SELECT unnest([13, 26, 52]) AS s))"""
)
def grid(spark, d):
    return sw.expand_grid(spark, _GRID)


@query(f"{_TRIALS} SELECT trial_id, CAST(pos AS BIGINT) AS pos, ret FROM tr", "ret", 10)
def sweep_returns(spark, d):
    return _sma_trials(spark, d).select("trial_id", F.col("pos").cast("bigint").alias("pos"), "ret")


_SHARPES = f"{_TRIALS}, sh AS (SELECT trial_id, fast, slow, n_obs, sharpe FROM g JOIN (SELECT trial_id, count(*) AS n_obs, coalesce(avg(ret) / nullif(stddev_samp(ret), 0), 0) AS sharpe FROM tr GROUP BY 1) USING (trial_id))"


def _sharpes(spark, d):
    g = sw.sma_grid(spark, tuple(_GRID["fast"]), tuple(_GRID["slow"]))
    return sw.trial_sharpes(g, _sma_trials(spark, d))


@query(f"{_SHARPES} SELECT trial_id, CAST(fast AS INTEGER) AS fast, CAST(slow AS INTEGER) AS slow, n_obs, sharpe FROM sh", "sharpe")
def sweep_trials(spark, d):
    return _sharpes(spark, d)


@query(f"{_SHARPES} SELECT count(*) AS n_trials, (SELECT trial_id FROM sh ORDER BY sharpe DESC, trial_id LIMIT 1) AS trial_id, max(sharpe) AS sharpe FROM sh", "sharpe")
def sweep_best(spark, d):
    return sw.sweep_best(_sharpes(spark, d))


@query(
    f"""{_SHARPES}, b AS (SELECT max(sharpe) AS best FROM sh), x AS (SELECT count(sharpe) AS n_ok, count(*) FILTER (sharpe IS NULL) AS n_failed, max(sharpe) AS best_sharpe, median(sharpe) AS median_sharpe,
      count(*) FILTER (best > 0 AND sharpe >= best * 0.8) / count(sharpe) AS share_near_best, median(fast) FILTER (best > 0 AND sharpe >= best * 0.8) AS fast_median, median(slow) FILTER (best > 0 AND sharpe >= best * 0.8) AS slow_median FROM sh, b)
      SELECT *, CASE WHEN share_near_best >= 0.3 THEN 'plateau' WHEN share_near_best >= 0.1 THEN 'ridge' ELSE 'knife_edge' END AS shape FROM x""",
    "best_sharpe median_sharpe share_near_best",
)
def sweep_surface(spark, d):
    return sw.surface(_sharpes(spark, d), ("fast", "slow"))


@query()
def sweep_verdict(spark, d):
    g = sw.sma_grid(spark, tuple(_GRID["fast"]), tuple(_GRID["slow"]))
    return sw.sweep_verdict(g, _sma_trials(spark, d))


@query()
def sweep_python(spark, d):
    closes = [r["close"] for r in P.market_returns(spark, d).orderBy("pos").select("close").collect()]  # the data a user's function is given

    def momentum(data, fast, slow):
        if fast >= slow:
            raise ValueError("fast must be below slow")
        mean = lambda i, k: sum(data[i - k : i]) / k
        return [data[i] / data[i - 1] - 1 if mean(i, fast) > mean(i, slow) else 0.0 for i in range(slow, len(data))]

    g = sw.expand_grid(spark, {"fast": [5, 30], "slow": [13, 26]})
    r = sw.run_sweep(g, momentum, closes)
    return r.groupBy("trial_id", "status").agg(F.count("pos").alias("n"), F.avg("ret").alias("mean_ret"))


@query(
    f"""{_TRIALS}, n AS (SELECT max(pos) + 1 AS n FROM tr), c AS (SELECT w AS win, floor(n * w / 4.0) AS cut FROM n, (SELECT unnest([1, 2, 3, 4]) AS w)), k AS (SELECT win, cut, cut - CAST(greatest(4, round_even(cut * 0.25, 0)) AS BIGINT) AS n_is FROM c),
      s AS (SELECT win, pos < n_is AS inside, trial_id, coalesce(avg(ret) / nullif(stddev_samp(ret), 0), 0) AS sharpe FROM tr, k WHERE pos < cut GROUP BY 1, 2, 3), b AS (SELECT win, trial_id, sharpe AS is_sharpe FROM s WHERE inside QUALIFY row_number() OVER (PARTITION BY win ORDER BY sharpe DESC, trial_id) = 1)
      SELECT CAST(k.win AS INTEGER) AS "window", CAST(n_is AS BIGINT) AS n_is, CAST(cut - n_is AS BIGINT) AS n_oos, b.trial_id, is_sharpe, s.sharpe AS oos_sharpe, CAST(NULL AS VARCHAR) AS failed FROM k JOIN b USING (win) JOIN s ON s.win = k.win AND s.trial_id = b.trial_id AND NOT s.inside""",
    "is_sharpe oos_sharpe",
)
def walk_fwd(spark, d):
    return sw.walk_forward(_sma_trials(spark, d).withColumn("pos", F.col("pos").cast("bigint")))


@query()
def hash_data(spark, d):
    return sw.data_hash(P.market_returns(spark, d), ["series_id", "pos", "ret"])


# --- backtests ----------------------------------------------------------------------------------------------------


def _bt_inputs(spark, d):
    """One portfolio per brand, long above its 13-week mean, and one that holds three brands."""
    p = P.brand_prices(spark, d)
    w = Window.partitionBy("symbol").orderBy("ts")
    s = p.withColumn("m", F.avg("close").over(w.rowsBetween(-12, 0))).withColumn("on", (F.col("close") > F.col("m")).cast("double"))
    s = s.withColumn("was", F.lag("on").over(w)).where("was IS NULL OR was <> on")
    base = s.select(F.col("symbol").alias("ticker"), F.col("ts").cast("string").alias("date"), "on")
    alone = base.select(F.col("ticker").alias("portfolio_id"), "ticker", "date", F.col("on").alias("target_weight"), F.lit(None).cast("string").alias("action"))
    trio = base.where("ticker IN ('Brand#11', 'Brand#12', 'Brand#13')").select(F.lit("trio").alias("portfolio_id"), "ticker", "date", F.lit(None).cast("double").alias("target_weight"), F.when(F.col("on") > 0, "buy").otherwise("sell").alias("action"))
    bars = p.select(F.col("symbol").alias("ticker"), F.col("ts").cast("string").alias("date"), F.lit(None).cast("double").alias("open"), "close")
    return alone.unionByName(trio), bars


def _ledger(spark, d, **kw):
    return bt.run_backtest(*_bt_inputs(spark, d), **({"max_position": 1.0} | kw))


_WEIGHTS = f"""{ctes("prices")}, o AS (SELECT symbol, ts, close, close > avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 12 PRECEDING) AS on FROM prices)"""


@query(f"{_WEIGHTS} SELECT symbol AS portfolio_id, upper(symbol) AS ticker, CAST(ts AS VARCHAR) AS date, close, CASE WHEN on THEN 1.0 ELSE 0.0 END::DOUBLE AS weight FROM o".replace(" on ", ' "on" ').replace("WHEN on", 'WHEN "on"').replace("AS on", 'AS "on"'), "close weight")
def bt_ffill(spark, d):
    return bt.known_weights(*_bt_inputs(spark, d)).where("portfolio_id <> 'trio'").drop("open")


@query(
    f"""{_WEIGHTS}, r AS (SELECT symbol, ts, close, lag(close) OVER w AS p, lag("on") OVER w AS held, "on", row_number() OVER w AS k, count(*) OVER (PARTITION BY symbol) AS m FROM o WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
      f AS (SELECT symbol, exp(sum(CASE WHEN held THEN ln(close / p) ELSE 0 END)) AS growth FROM r GROUP BY 1) SELECT symbol AS portfolio_id, growth * 100000 AS final_equity FROM f""".replace("AS on", 'AS "on"'),
    "final_equity",
    3,
)
def bt_free(spark, d):
    """Without costs, a single ticker fully in or out has a closed form."""
    b = _ledger(spark, d, slippage_bps=0.0, commission_bps=0.0).where("kind = 'bar' AND portfolio_id <> 'trio'")
    return b.groupBy("portfolio_id").agg(F.max_by("equity", "date").alias("final_equity"))


@query()
def bt_run(spark, d):
    return bt.equity_returns(_ledger(spark, d))


@query()
def bt_run_open(spark, d):
    volumes = {f"Brand#{i}".upper(): 5e5 for i in range(1, 26)}
    return bt.equity_returns(_ledger(spark, d, fill_timing="next_open", adv=volumes, participation=0.1))


@query()
def bt_score(spark, d):
    return bt.score_backtest(_ledger(spark, d), n_trials=1)


@query()
def bt_trades(spark, d):
    return bt.trade_summary(_ledger(spark, d))


@query()
def bt_mae(spark, d):
    return bt.excursions(_ledger(spark, d).where("kind = 'trade'"), _bt_inputs(spark, d)[1])


def _regimes(spark, d):
    w = Window.partitionBy("series_id").orderBy("pos").rowsBetween(-25, 0)
    m = P.market_returns(spark, d).withColumn("trend", F.sum("ret").over(w))
    return m.select(F.col("ts").alias("date"), F.when(F.col("trend") > 0, "up").otherwise("down").alias("regime"))


@query()
def bt_regime(spark, d):
    return bt.regime_attribution(_ledger(spark, d).where("kind = 'trade'"), _regimes(spark, d))


@query()
def bt_cost(spark, d):
    return bt.cost_report(_ledger(spark, d))


# --- covariance and allocation ------------------------------------------------------------------------------------

_PANEL = f"""{ctes("prices", "pos")}, lp AS (SELECT symbol, pos - 1 AS t, close / lag(close) OVER (PARTITION BY symbol ORDER BY pos) - 1 AS ret FROM pos WHERE n = (SELECT max(n) FROM pos)), rp AS (SELECT * FROM lp WHERE t >= 0),
 pp2 AS (SELECT x.t, x.symbol AS a, y.symbol AS b, x.ret AS x, y.ret AS y FROM rp x JOIN rp y ON x.t = y.t AND x.symbol <= y.symbol)"""


def _panel(spark, d):
    return cov.return_panel(P.brand_prices(spark, d))


@query(f"{_PANEL} SELECT a, b, covar_pop(x, y) AS v FROM pp2 GROUP BY 1, 2", "v")
def cov_sample(spark, d):
    return cov.cov_sample(_panel(spark, d))


@query(f"{_PANEL} SELECT a, b, sum(pow(0.94, m - t) * x * y) / sum(pow(0.94, m - t)) AS v FROM pp2, (SELECT max(t) AS m FROM rp) GROUP BY 1, 2", "v")
def cov_ewma(spark, d):
    return cov.cov_ewma(_panel(spark, d))


_LW = f"""{_PANEL}, e AS (SELECT a, b, covar_pop(x, y) AS v FROM pp2 GROUP BY 1, 2), st AS (SELECT sum(v) FILTER (a = b) AS tr, count(*) FILTER (a = b) AS n, sum(v * v * CASE WHEN a = b THEN 1 ELSE 2 END) AS n2 FROM e),
 f AS (SELECT avg(s * s) AS m4 FROM (SELECT t, sum(x * x) AS s FROM (SELECT t, ret - avg(ret) OVER (PARTITION BY symbol) AS x FROM rp) GROUP BY 1)),
 k AS (SELECT least(greatest(least((m4 - n2) / n, (n2 - tr * tr / n) / n) / nullif((n2 - tr * tr / n) / n, 0), 0), 1) AS shrinkage, tr / n AS mu FROM st, f)"""


@query(f"{_LW} SELECT a, b, (1 - shrinkage) * v + CASE WHEN a = b THEN shrinkage * mu ELSE 0 END AS v FROM e, k", "v")
def cov_lw(spark, d):
    return cov.cov_ledoit_wolf(_panel(spark, d))[0]


@query(f"{_LW} SELECT shrinkage, mu FROM k", "shrinkage mu")
def cov_lw_shrinkage(spark, d):
    return cov.cov_ledoit_wolf(_panel(spark, d))[1]


@query()
def cov_denoise(spark, d):
    panel = _panel(spark, d)
    return cov.covariance_by(panel, "denoise")


@query()
def cov_detone(spark, d):
    return cov.detone_cov(cov.cov_sample(_panel(spark, d)))


@query()
def cov_pca(spark, d):
    shares = cov.variance_explained(cov.to_matrix(cov.cov_sample(_panel(spark, d)))[1])
    return spark.createDataFrame([(i + 1, s) for i, s in enumerate(shares)], "k int, share double")


@query()
def cov_diag(spark, d):
    return spark.createDataFrame([cov.diagnostics(cov.to_matrix(cov.cov_sample(_panel(spark, d)))[1])], "n_assets int, trace double, condition_number double, min_eigenvalue double, max_eigenvalue double")


@query()
def hrp(spark, d):
    return cov.allocate(cov.cov_sample(_panel(spark, d)), "hrp")


@query()
def risk_parity(spark, d):
    return cov.allocate(cov.cov_ledoit_wolf(_panel(spark, d))[0], "risk_parity")


@query(
    f"""WITH RECURSIVE {ctes("sleeves")[5:]}, s AS (SELECT series_id, CAST(pos AS BIGINT) AS pos, ret FROM sleeves), v AS (SELECT series_id, CAST(-1 AS BIGINT) AS pos, avg(ret * ret) FILTER (pos < 20) AS var, 0.0::DOUBLE AS ret FROM s GROUP BY 1 UNION ALL SELECT s.series_id, s.pos, 0.94 * v.var + 0.06 * s.ret * s.ret, s.ret FROM v JOIN s ON s.series_id = v.series_id AND s.pos = v.pos + 1),
      l AS (SELECT series_id, ret, CASE WHEN sqrt(var * 252) > 1e-12 THEN 0.10 / sqrt(var * 252) ELSE 0 END AS lev FROM v WHERE pos >= 0)
      SELECT series_id, count(*) AS n_obs, avg(lev) AS mean_leverage, max(lev) AS max_leverage, stddev_samp(ret * lev) * sqrt(252) AS realized_vol FROM l GROUP BY 1""",
    "mean_leverage max_leverage realized_vol",
)
def vol_target(spark, d):
    return cov.vol_target(P.segment_returns(spark, d))


# --- pairs and factors --------------------------------------------------------------------------------------------

_LEGS = f"""{ctes("prices")}, legs AS (SELECT x.symbol AS a, y.symbol AS b, row_number() OVER (PARTITION BY x.symbol, y.symbol ORDER BY x.ts) - 1 AS pos, ln(x.close) AS la, ln(y.close) AS lb FROM prices x JOIN prices y ON x.ts = y.ts AND x.symbol < y.symbol),
 hr AS (SELECT a, b, count(*) AS n, (var_pop(la) - var_pop(lb) + sqrt(pow(var_pop(la) - var_pop(lb), 2) + 4 * pow(covar_pop(la, lb), 2))) / nullif(2 * covar_pop(la, lb), 0) AS hedge_ratio FROM legs GROUP BY 1, 2),
 sp AS (SELECT a, b, pos, la - hedge_ratio * lb AS spread FROM legs JOIN hr USING (a, b))"""


def _legs(spark, d):
    return pr.pair_legs(P.brand_prices(spark, d))


@query(f"{_LEGS} SELECT a, b, n, atan(hedge_ratio) AS angle FROM hr", "angle", 5)
def pair_tls(spark, d):
    """The ratio as an angle: nearly uncorrelated legs have ratios without a bound."""
    return pr.hedge_ratios(_legs(spark, d)).select("a", "b", "n", F.atan("hedge_ratio").alias("angle"))


@query(
    f"""{_LEGS}, l AS (SELECT a, b, spread, lag(spread) OVER (PARTITION BY a, b ORDER BY pos) AS s FROM sp), m AS (SELECT a, b, count(*) AS n, covar_pop(s, spread - s) / nullif(var_pop(s), 0) AS slope FROM l WHERE s IS NOT NULL GROUP BY 1, 2)
      SELECT a, b, CASE WHEN slope < 0 AND n >= 29 THEN -ln(2) / slope END AS half_life FROM m""",
    "half_life",
    5,
)
def pair_hl(spark, d):
    return pr.half_lives(pr.spreads(_legs(spark, d)))


@query(
    f"""{_LEGS}, r AS (SELECT a, b, pos, la - lag(la) OVER w AS x, lb - lag(lb) OVER w AS y FROM legs WINDOW w AS (PARTITION BY a, b ORDER BY pos)), q AS (SELECT * FROM r WHERE x IS NOT NULL),
      c AS (SELECT a, b, row_number() OVER (PARTITION BY a, b ORDER BY pos) AS k, count(*) OVER (PARTITION BY a, b) AS n, corr(x, y) OVER (PARTITION BY a, b ORDER BY pos ROWS 59 PRECEDING) AS c FROM q),
      m AS (SELECT a, b, avg(c) AS mean_corr, stddev_samp(c) AS std_corr, count(c) AS n_windows FROM c WHERE k >= 60 AND k < n AND n >= 65 GROUP BY 1, 2)
      SELECT a, b, greatest(0.0, least(1.0, 1 - std_corr)) AS stability, mean_corr, std_corr, n_windows FROM m WHERE n_windows >= 5""",
    "stability mean_corr std_corr",
)
def pair_stab(spark, d):
    return pr.stability(_legs(spark, d))


@query()
def pair_adf(spark, d):
    return pr.adf_tests(pr.spreads(_legs(spark, d)))


@query()
def pair_screen(spark, d):
    return pr.screen_pairs(P.brand_prices(spark, d))


def _factor_rows(spark, d):
    w = P.segment_returns(spark, d).groupBy("ts").pivot("series_id", ["BUILDING", "MACHINERY", "FURNITURE"]).agg(F.first("ret"))
    m = P.market_returns(spark, d).select("ts", "pos", "ret")
    return m.join(w, "ts").select("pos", "ret", F.col("BUILDING").alias("building"), F.col("MACHINERY").alias("machinery"), F.col("FURNITURE").alias("furniture"))


@query()
def factors(spark, d):
    return fac.decompose(_factor_rows(spark, d), ["building", "machinery", "furniture"])


@query(
    f"""{ctes("market", "sleeves")}, r AS (SELECT market.ret - 0.04 / 252 AS y, sleeves.ret AS x FROM market JOIN sleeves USING (ts) WHERE sleeves.series_id = 'BUILDING')
      SELECT count(*) AS n_obs, regr_r2(y, x) AS r_squared, 1 - (1 - regr_r2(y, x)) * (count(*) - 1) / (count(*) - 2) AS adj_r_squared, sqrt(var_pop(y) * (1 - regr_r2(y, x))) * sqrt(252) * 100 AS residual_vol_pct, regr_intercept(y, x) * 25200 AS alpha_annual_pct FROM r""",
    "r_squared adj_r_squared residual_vol_pct alpha_annual_pct",
    5,
)
def factor_fit(spark, d):
    rows = _factor_rows(spark, d)
    return fac.fit_summary(rows, fac.decompose(rows, ["building"]), ["building"])


# --- processes ----------------------------------------------------------------------------------------------------


def _levels(spark, d):
    return P.segment_returns(spark, d).select("series_id", "pos", F.col("close").alias("value"))


@query(
    f"""{ctes("sleeves")}, l AS (SELECT series_id, close AS y, lag(close) OVER (PARTITION BY series_id ORDER BY pos) AS x FROM sleeves), m AS (SELECT series_id, count(y) AS n_obs, regr_slope(y, x) AS phi, regr_intercept(y, x) AS c, regr_syy(y, x) / regr_count(y, x) AS vy, regr_sxx(y, x) / regr_count(y, x) AS vx FROM l GROUP BY 1),
      k AS (SELECT *, phi > 0 AND phi < 1 AS ok, CASE WHEN phi > 0 AND phi < 1 THEN -ln(phi) END AS kappa FROM m)
      SELECT series_id, n_obs, phi, kappa, CASE WHEN ok THEN c / (1 - phi) END AS theta, CASE WHEN ok THEN sqrt((vy - phi * phi * vx) * 2 * kappa / (1 - phi * phi)) END AS sigma, ln(2) / kappa AS half_life, ok AS mean_reverting FROM k""",
    "phi kappa theta sigma half_life",
    2,
)
def ou_cal(spark, d):
    return proc.ou_calibrate(_levels(spark, d))


_CHANGES = f"{ctes('sleeves')}, ch AS (SELECT series_id, ln(close) - ln(lag(close) OVER (PARTITION BY series_id ORDER BY pos)) AS r FROM sleeves), cr AS (SELECT * FROM ch WHERE r IS NOT NULL)"


@query(f"{_CHANGES} SELECT series_id, count(r) AS n_obs, avg(r) AS mu, stddev_samp(r) AS sigma FROM cr GROUP BY 1", "mu sigma")
def gbm_cal(spark, d):
    return proc.gbm_calibrate(_levels(spark, d))


@query(
    f"""{_CHANGES}, md AS (SELECT series_id, median(r) AS mid FROM cr GROUP BY 1), th AS (SELECT series_id, 3 * 1.4826 * median(abs(r - mid)) AS threshold FROM cr JOIN md USING (series_id) GROUP BY 1)
      SELECT series_id, count(*) AS n_obs, max(threshold) AS threshold, avg(r) FILTER (abs(r) <= threshold) AS mu, stddev_samp(r) FILTER (abs(r) <= threshold) AS sigma, avg(CASE WHEN abs(r) > threshold THEN 1.0 ELSE 0 END) AS jump_lambda,
        coalesce(avg(r) FILTER (abs(r) > threshold), 0) AS jump_mu, coalesce(stddev_samp(r) FILTER (abs(r) > threshold), 0) AS jump_sigma, count(*) FILTER (abs(r) > threshold) AS n_jumps FROM cr JOIN th USING (series_id) GROUP BY 1""",
    "threshold mu sigma jump_lambda jump_mu jump_sigma",
)
def jump_cal(spark, d):
    return proc.jump_calibrate(_levels(spark, d))


@query()
def garch_cal(spark, d):
    return proc.garch_calibrate(_levels(spark, d))


@query()
def ou_sim(spark, d):
    return proc.fan(proc.ou_simulate(spark, 0.12, 1.0, 0.05, 250))


@query()
def ou_sim_terminal(spark, d):
    return proc.ou_terminal(proc.ou_simulate(spark, 0.12, 1.0, 0.05, 250, x0=2.0), 1.0)


@query()
def dgp_stress(spark, d):
    s = P.market_returns(spark, d).select("series_id", "pos", F.col("close").alias("value"))
    out = None
    for kind in ("gbm", "ou", "jump", "garch"):
        one = proc.dgp_stress(s, kind)
        out = one if out is None else out.unionByName(one)
    return out
