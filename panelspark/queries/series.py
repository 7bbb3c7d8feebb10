"""Queries of the series operators: performance, risk, stress, overlap, validation, sweeps, backtests, processes."""

from __future__ import annotations

import itertools
from statistics import NormalDist

from pyspark.sql import functions as F

from panelspark.operators import book
from panelspark.operators import performance as perf
from panelspark.operators import validation as val
from panelspark.plans import panels as P
from panelspark.queries.registry import ctes, query

Z95 = NormalDist().inv_cdf(0.95)


def _sleeves(spark, d):
    return P.segment_returns(spark, d)


def _market(spark, d):
    return P.market_returns(spark, d)


_EQ = f"""{ctes("sleeves")}, s AS (SELECT series_id, pos, ret, count(*) OVER (PARTITION BY series_id) AS n FROM sleeves),
 eq AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY series_id ORDER BY pos)) AS equity FROM s), dd AS (SELECT *, equity / max(equity) OVER (PARTITION BY series_id ORDER BY pos) - 1 AS dd0 FROM eq),
 dr AS (SELECT *, CASE WHEN abs(dd0) < 1e-12 THEN 0 ELSE dd0 END AS dd FROM dd)"""


@query(
    f"""{_EQ}, c AS (SELECT series_id, quantile_cont(ret, 0.05) AS cut FROM s GROUP BY 1),
      a AS (SELECT series_id, count(*) AS n_obs, avg(ret - 0.02/252) AS m, stddev_samp(ret) AS sd, sqrt(avg(pow(least(ret - 0.02/252, 0), 2))) AS down, min(dd) AS dd, max_by(equity, pos) AS eq, abs(max(cut)) AS var_95, abs(avg(ret) FILTER (ret <= cut)) AS cvar_95 FROM dr JOIN c USING (series_id) GROUP BY 1),
      b AS (SELECT *, pow(eq, 252.0 / n_obs) - 1 AS ann FROM a)
      SELECT series_id, n_obs, m / sd AS sharpe, m / sd * sqrt(252) AS sharpe_annualized, m / down * sqrt(252) AS sortino, CASE WHEN dd < 0 THEN ann / abs(dd) ELSE 0 END AS calmar, abs(dd) * 100 AS max_drawdown_pct,
        (eq - 1) * 100 AS total_return_pct, ann * 100 AS annualized_return_pct, var_95, cvar_95, sd * sqrt(252) * 100 AS volatility_pct FROM b""",
    "sharpe sharpe_annualized sortino calmar max_drawdown_pct total_return_pct annualized_return_pct var_95 cvar_95 volatility_pct",
    5,
)
def perf_report(spark, d):
    return perf.performance_report(_sleeves(spark, d), 0.02)


_BOOK = f"""{ctes("sleeves", "market")}, t AS (SELECT series_id, ret, count(*) OVER (PARTITION BY series_id) - pos AS tail FROM sleeves), m AS (SELECT ret AS b, count(*) OVER () - pos AS tail FROM market), j AS (SELECT * FROM t JOIN m USING (tail))"""


@query(
    f"{_BOOK} SELECT series_id, count(*) AS n_obs, covar_samp(ret, b) / var_samp(b) AS beta, (avg(ret) - covar_samp(ret, b) / var_samp(b) * avg(b)) * 25200 AS alpha_pct, avg(ret - b) / stddev_samp(ret - b) * sqrt(252) AS information_ratio FROM j GROUP BY 1",
    "beta alpha_pct information_ratio",
    5,
)
def perf_benchmark(spark, d):
    return perf.benchmark_report(_sleeves(spark, d), _market(spark, d))


@query(
    f"""{ctes("sleeves")}, c AS (SELECT series_id, quantile_cont(ret, 0.05) AS cut FROM sleeves GROUP BY 1), u AS (SELECT *, avg(ret) OVER (PARTITION BY series_id) AS mu, stddev_samp(ret) OVER (PARTITION BY series_id) AS sd FROM sleeves),
      a AS (SELECT series_id, count(*) AS n_obs, max(sd) AS sd, avg(pow((ret - mu) / sd, 3)) AS s, avg(pow((ret - mu) / sd, 4)) - 3 AS k, max(cut) AS cut, avg(ret) FILTER (ret <= cut) AS tail, count(*) FILTER (ret <= cut) AS tail_observations FROM u JOIN c USING (series_id) GROUP BY 1),
      b AS (SELECT *, {Z95} + (pow({Z95}, 2) - 1) * s / 6 + (pow({Z95}, 3) - 3 * {Z95}) * k / 24 - (2 * pow({Z95}, 3) - 5 * {Z95}) * s * s / 36 AS zcf FROM a)
      SELECT series_id, n_obs, {Z95} * sd * 100 AS parametric_var_pct, {Z95} * sd * 1e5 AS parametric_var_value, sd * 100 AS volatility_pct, CASE WHEN zcf > 0 THEN zcf ELSE {Z95} END * sd * 100 AS cornish_fisher_var_pct, zcf <= 0 AS gaussian_fallback,
        s AS skewness, k AS excess_kurtosis, abs(cut) * 100 AS historical_var_pct, abs(tail) * 100 AS cvar_pct, tail_observations FROM b""",
    "parametric_var_pct parametric_var_value volatility_pct cornish_fisher_var_pct skewness excess_kurtosis historical_var_pct cvar_pct",
    5,
)
def var_cvar(spark, d):
    return perf.var_cvar(_sleeves(spark, d))


@query()
def var_bootstrap(spark, d):
    return perf.var_bootstrap(_sleeves(spark, d))


_SEG = """CAST(CASE WHEN pos < (n % {k}) * (n // {k} + 1) THEN pos // (n // {k} + 1) ELSE (n % {k}) + (pos - (n % {k}) * (n // {k} + 1)) // (n // {k}) END AS INTEGER)"""


@query(
    f"""{ctes("sleeves")}, s AS (SELECT series_id, pos, ret, count(*) OVER (PARTITION BY series_id) AS n FROM sleeves),
      g AS (SELECT series_id, {_SEG.format(k=4)} AS segment, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252) AS sharpe, sum(ret) AS pnl FROM s GROUP BY 1, 2)
      SELECT *, max(pnl) OVER w / sum(abs(pnl)) OVER w AS share_in_best, min(sharpe) OVER w AS worst_sharpe FROM g WINDOW w AS (PARTITION BY series_id)""",
    "sharpe pnl share_in_best worst_sharpe",
)
def subperiods(spark, d):
    return perf.subperiod_stability(_sleeves(spark, d))


@query(
    f"""{ctes("sleeves")}, a AS (SELECT series_id, avg(ret) AS m, stddev_samp(ret) AS sd FROM sleeves GROUP BY 1), l AS (SELECT unnest([0.0, 5.0, 10.0, 25.0, 50.0])::DOUBLE AS bps),
      r AS (SELECT series_id, bps, (m - 0.6 * bps / 1e4) / nullif(sd, 0) * sqrt(252) AS sharpe FROM a, l) SELECT *, coalesce(bps = min(CASE WHEN sharpe <= 0 THEN bps END) OVER (PARTITION BY series_id), false) AS dies FROM r""",
    "sharpe",
)
def cost_ladder(spark, d):
    return perf.cost_ladder(_sleeves(spark, d), 0.6)


@query(
    f"""{_EQ}, i AS (SELECT series_id, dd, sum(CASE WHEN dd >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY pos) AS island FROM dr), g AS (SELECT series_id, island, count(*) FILTER (dd < 0) AS k, min(dd) AS low, count(*) AS m FROM i GROUP BY 1, 2)
      SELECT series_id, CAST(sum(m) AS BIGINT) AS n_obs, -min(low) * 100 AS max_drawdown_pct, max(k) AS longest_underwater, count(*) FILTER (low <= -0.10) AS n_over_10pct, sum(k) / sum(m) AS time_underwater_share FROM g GROUP BY 1""",
    "max_drawdown_pct time_underwater_share",
)
def drawdown(spark, d):
    return perf.drawdown_anatomy(_sleeves(spark, d))


@query(f"{_BOOK} SELECT series_id, count(*) AS n_obs, corr(ret, b) AS correlation, covar_samp(ret, b) / var_samp(b) AS beta FROM j GROUP BY 1", "correlation beta")
def overlap(spark, d):
    return perf.overlap(_sleeves(spark, d), _market(spark, d))


@query(
    f"""{_BOOK}, k AS (SELECT series_id, ret, b, row_number() OVER (PARTITION BY series_id ORDER BY tail DESC) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS depth FROM j),
      r AS (SELECT series_id, pos, depth // 4 AS size, (SELECT corr(y.ret, y.b) FROM k y WHERE y.series_id = x.series_id AND y.pos BETWEEN x.pos - greatest(20, x.depth // 4) + 1 AND x.pos) AS correlation FROM k x WHERE depth >= 2 * greatest(20, depth // 4))
      SELECT series_id, pos, correlation FROM r WHERE pos >= greatest(20, size) - 1""",
    "correlation",
    5,
)
def overlap_roll(spark, d):
    return perf.rolling_overlap(_sleeves(spark, d), _market(spark, d)).select("series_id", F.col("pos").cast("bigint").alias("pos"), "correlation")


@query(
    f"""{ctes("sleeves")}, t AS (SELECT series_id, ret, count(*) OVER (PARTITION BY series_id) - pos AS tail, count(*) OVER (PARTITION BY series_id) AS n FROM sleeves), u AS (SELECT *, min(n) OVER () AS depth, CASE WHEN series_id = 'BUILDING' THEN 3.0 ELSE 1.0 END AS w FROM t)
      SELECT CAST(depth - tail AS BIGINT) AS pos, sum(w * ret) / sum(w) AS ret FROM u WHERE tail <= depth GROUP BY 1""",
    "ret",
)
def book_combine(spark, d):
    weights = spark.createDataFrame([("BUILDING", 3.0)], "series_id string, weight double")
    return perf.book_combine(_sleeves(spark, d), weights).select(F.col("pos").cast("bigint").alias("pos"), "ret")


@query(
    f"""{ctes("sleeves")}, t AS (SELECT series_id, ret, count(*) OVER (PARTITION BY series_id) - pos AS tail FROM sleeves)
      SELECT x.series_id AS a, y.series_id AS b, count(*) AS n_obs, corr(x.ret, y.ret) AS correlation FROM t x JOIN t y ON x.tail = y.tail AND x.series_id < y.series_id GROUP BY 1, 2""",
    "correlation",
)
def book_overlap(spark, d):
    return perf.book_overlap(_sleeves(spark, d))


@query(
    f"""{ctes("sleeves")}, l AS (SELECT series_id, ret, lag(ret) OVER (PARTITION BY series_id ORDER BY pos) AS p FROM sleeves), a AS (SELECT series_id, count(*) AS n_obs, corr(ret, p) AS r1 FROM l GROUP BY 1)
      SELECT *, greatest(1.0, least(n_obs, n_obs * (1 - r1) / (1 + r1))) AS n_effective FROM a""",
    "r1 n_effective",
    5,
)
def ar1_neff(spark, d):
    return perf.ar1_effective_n(_sleeves(spark, d))


@query(
    f"""{ctes("sleeves")}, s AS (SELECT series_id, pos, ret, count(*) OVER (PARTITION BY series_id) AS n FROM sleeves), b AS (SELECT series_id, n, k, round_even(k * n / 32, 0) AS lo, round_even((k + 1) * n / 32, 0) AS hi FROM (SELECT DISTINCT series_id, n FROM s), (SELECT unnest(generate_series(0, 31)) AS k))
      SELECT s.series_id, CAST(k AS INTEGER) AS bucket, max(pos) AS i, max_by(ret, pos) AS v FROM s JOIN b ON s.series_id = b.series_id AND pos >= lo AND pos < hi GROUP BY 1, 2""",
    "v",
    10,
)
def sketch_curve(spark, d):
    return perf.sketch(_sleeves(spark, d), points=32).select("series_id", "bucket", F.col("i").cast("bigint").alias("i"), "v")


# --- validation ---------------------------------------------------------------------------------------------------


def _phi(x: str) -> str:
    """The distribution function in SQL, by the same rational approximation as the operator's."""
    a = f"abs({x})"
    top = "((((((3.52624965998911e-2 * A + 0.700383064443688) * A + 6.37396220353165) * A + 33.912866078383) * A + 112.079291497871) * A + 221.213596169931) * A + 220.206867912376)"
    low = "(((((((8.83883476483184e-2 * A + 1.75566716318264) * A + 16.064177579207) * A + 86.7807322029461) * A + 296.564248779674) * A + 637.333633378831) * A + 793.826512519948) * A + 440.413735824752)"
    upper = f"(exp(-A * A / 2) * {top} / {low})".replace("A", a)
    return f"CASE WHEN {x} > 0 THEN 1 - {upper} ELSE {upper} END"


_MOMENTS = f"""{ctes("sleeves")}, mo AS (SELECT series_id, count(ret) AS n_obs, avg(ret) / stddev_samp(ret) AS sharpe, skewness(ret) AS skew, kurtosis(ret) + 3 AS kurt FROM sleeves GROUP BY 1)"""


@query(f"{_MOMENTS}, z AS (SELECT *, sharpe * sqrt(n_obs - 1) / sqrt(greatest(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe, 1e-9)) AS z FROM mo) SELECT series_id, n_obs, sharpe, {_phi('z')} AS psr FROM z", "sharpe psr")
def psr(spark, d):
    return val.deflated_sharpe(_sleeves(spark, d), 1).select("series_id", "n_obs", "sharpe", "psr")


@query(
    f"""{_MOMENTS}, o AS (SELECT *, {val.expected_max_sharpe(40, 1.0)} * sqrt((1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) / (n_obs - 1)) AS sr0 FROM mo),
      z AS (SELECT *, (sharpe - sr0) * sqrt(n_obs - 1) / sqrt(greatest(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe, 1e-9)) AS z FROM o), y AS (SELECT *, {_phi("z")} AS deflated_sharpe FROM z)
      SELECT series_id, n_obs, sharpe, skew, kurt, sr0, deflated_sharpe, CASE WHEN deflated_sharpe < 0.5 THEN 'likely_noise' WHEN deflated_sharpe < 0.9 THEN 'marginal' ELSE 'robust' END AS label FROM y""",
    "sharpe skew kurt sr0 deflated_sharpe",
    5,
)
def dsr(spark, d):
    return val.deflated_sharpe(_sleeves(spark, d), 40).drop("psr")


@query(
    f"""{_MOMENTS}, l AS (SELECT *, CASE WHEN sharpe > 0 THEN greatest(1, 1 + (1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) * pow({Z95} / sharpe, 2)) END AS min_length FROM mo)
      SELECT series_id, n_obs, sharpe, min_length, min_length / 252 AS years, coalesce(n_obs >= min_length, false) AS sufficient, CAST(greatest(ceil(min_length - n_obs), 0) AS BIGINT) AS shortfall FROM l""",
    "sharpe min_length years",
    4,
)
def min_trl(spark, d):
    return val.min_track_record(_sleeves(spark, d))


@query(
    f"""{_MOMENTS}, l AS (SELECT *, CASE WHEN sharpe > 0 THEN greatest(1, 1 + (1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) * pow({Z95} / sharpe, 2)) END AS min_length FROM mo), k AS (SELECT series_id, n_obs, coalesce(n_obs >= min_length, false) AS sufficient FROM l)
      SELECT series_id, n_obs, sufficient, CASE WHEN sufficient THEN 'ok' ELSE 'undetermined' END AS status, CASE WHEN (SELECT bool_and(sufficient) FROM k) THEN 'ok' ELSE 'undetermined' END AS overall FROM k"""
)
def book_monitor(spark, d):
    return book.book_monitor(_sleeves(spark, d)).drop("cvar_pct")


@query(
    f"""{_MOMENTS}, l AS (SELECT *, CASE WHEN sharpe > 0 THEN greatest(1, 1 + (1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) * pow({Z95} / sharpe, 2)) END AS min_length FROM mo), k AS (SELECT series_id, coalesce(n_obs >= min_length, false) AS sufficient FROM l),
      w AS (SELECT series_id, CASE series_id WHEN 'BUILDING' THEN 0.3::DOUBLE WHEN 'MACHINERY' THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS weight, sufficient FROM k)
      SELECT series_id, (SELECT sum(weight) FROM w) - weight AS held_weight, CASE WHEN sufficient THEN greatest(1 - ((SELECT sum(weight) FROM w) - weight), 0) END AS residual_weight, NOT sufficient AS refused FROM w""",
    "held_weight residual_weight",
)
def book_residual(spark, d):
    weights = spark.createDataFrame([("BUILDING", 0.3), ("MACHINERY", 0.5), ("elsewhere", 0.9)], "series_id string, weight double")
    return book.residual_weight(_sleeves(spark, d), weights).drop("cvar_pct")


@query()
def exp_max_sr(spark, d):
    rows = [(n, val.expected_max_sharpe(n, 0.1)) for n in (1, 2, 10, 100, 1000)]
    return spark.createDataFrame(rows, "n_trials int, expected_max double")


def _sma_trials(spark, d):
    from panelspark.operators.sweep import sma_cross, sma_grid

    return sma_cross(_market(spark, d), sma_grid(spark, (3, 5, 8), (13, 26, 52)), 52)


_TRIALS = f"""{ctes("market")}, g AS (SELECT CAST(row_number() OVER (ORDER BY fast, slow) - 1 AS INTEGER) AS trial_id, fast, slow FROM (SELECT unnest([3, 5, 8]) AS fast), (SELECT unnest([13, 26, 52]) AS slow) WHERE fast < slow),
 ma AS (SELECT pos, ret, {", ".join(f"avg(close) OVER (ORDER BY pos ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS m{w}" for w in (3, 5, 8, 13, 26, 52))} FROM market),
 lg AS (SELECT pos, ret, {", ".join(f"lag(m{w}) OVER (ORDER BY pos) AS m{w}" for w in (3, 5, 8, 13, 26, 52))} FROM ma),
 tr AS (SELECT trial_id, pos - 52 AS pos, CASE WHEN CASE fast {" ".join(f"WHEN {w} THEN m{w}" for w in (3, 5, 8))} END > CASE slow {" ".join(f"WHEN {w} THEN m{w}" for w in (13, 26, 52))} END THEN ret ELSE 0 END AS ret FROM lg, g WHERE pos >= 52)"""
_COMBOS = list(itertools.combinations(range(8), 4))


@query(
    f"""{_TRIALS}, n AS (SELECT trial_id, pos, ret, count(*) OVER (PARTITION BY trial_id) AS n FROM tr), bl AS (SELECT trial_id, {_SEG.format(k=8)} AS block, sum(ret) AS s, sum(ret * ret) AS q, count(*) AS c FROM n GROUP BY 1, 2),
      cb AS (SELECT i.combo, b.block, list_contains(i.blocks, b.block) AS inside FROM (SELECT unnest(generate_series(0, {len(_COMBOS) - 1})) AS combo, unnest([{", ".join(str(list(c)) for c in _COMBOS)}]) AS blocks) i, (SELECT unnest(generate_series(0, 7)) AS block) b),
      h AS (SELECT combo, inside, trial_id, sum(s) / sum(c) AS mean, sum(q) / sum(c) - pow(sum(s) / sum(c), 2) AS v FROM bl JOIN cb USING (block) GROUP BY 1, 2, 3), pf AS (SELECT *, CASE WHEN v > 0 THEN mean / sqrt(v) ELSE 0 END AS perf FROM h),
      be AS (SELECT combo, trial_id FROM pf WHERE inside QUALIFY row_number() OVER (PARTITION BY combo ORDER BY perf DESC, trial_id) = 1), ro AS (SELECT combo, trial_id, row_number() OVER (PARTITION BY combo ORDER BY perf, trial_id) AS r, count(*) OVER (PARTITION BY combo) AS m FROM pf WHERE NOT inside),
      lo AS (SELECT ln((r / (m + 1)) / (1 - r / (m + 1))) AS logit, m FROM ro JOIN be USING (combo, trial_id)), x AS (SELECT avg(CASE WHEN logit <= 0 THEN 1.0 ELSE 0 END) AS pbo, avg(logit) AS logit_mean, count(*) AS n_partitions, max(m) AS n_configs FROM lo)
      SELECT *, CASE WHEN pbo > 0.5 THEN 'overfit' WHEN pbo > 0.2 THEN 'acceptable' ELSE 'robust' END AS verdict FROM x""",
    "pbo logit_mean",
)
def pbo(spark, d):
    return val.pbo(_sma_trials(spark, d), 8)


_PAIRS = list(itertools.combinations(range(8), 2))


@query(
    f"""{ctes("sleeves")}, s AS (SELECT series_id, pos, ret, count(*) OVER (PARTITION BY series_id) AS n FROM sleeves), b AS (SELECT series_id, pos, ret, {_SEG.format(k=8)} AS block FROM s),
      k AS (SELECT series_id, block, ret, row_number() OVER (PARTITION BY series_id, block ORDER BY pos) - 1 AS k, count(*) OVER (PARTITION BY series_id, block) AS m FROM b), u AS (SELECT * FROM k WHERE k >= 1 AND k < m - 1),
      cb AS (SELECT unnest(generate_series(0, {len(_PAIRS) - 1})) AS combo, unnest([{", ".join(str(list(c)) for c in _PAIRS)}]) AS blocks)
      SELECT series_id, CAST(combo AS INTEGER) AS combo, count(*) AS n_obs, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252) AS sharpe FROM u JOIN cb ON list_contains(blocks, block) GROUP BY 1, 2""",
    "sharpe",
)
def cpcv_paths(spark, d):
    return val.cpcv_paths(_sleeves(spark, d)).drop("deflated_sharpe")


_HELD_OUT = f"""{ctes("sleeves")}, s AS (SELECT series_id, pos, ret, count(*) OVER (PARTITION BY series_id) AS n FROM sleeves), b AS (SELECT series_id, pos, ret, {_SEG.format(k=8)} AS block FROM s),
      k AS (SELECT series_id, block, ret, row_number() OVER (PARTITION BY series_id, block ORDER BY pos) - 1 AS k, count(*) OVER (PARTITION BY series_id, block) AS m FROM b), u AS (SELECT * FROM k WHERE k >= 1 AND k < m - 1),
      cb AS (SELECT unnest(generate_series(0, {len(_PAIRS) - 1})) AS combo, unnest([{", ".join(str(list(c)) for c in _PAIRS)}]) AS blocks)"""
_ERROR = "sqrt(greatest(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe, {0}))"


@query(
    f"""{_HELD_OUT}, mo AS (SELECT series_id, combo, count(*) AS n_obs, coalesce(avg(ret) / nullif(stddev_samp(ret), 0), 0) AS sharpe, skewness(ret) AS skew, kurtosis(ret) + 3 AS kurt FROM u JOIN cb ON list_contains(blocks, block) GROUP BY 1, 2),
      o AS (SELECT *, {val.expected_max_sharpe(9, 1.0)} * {_ERROR.format("0.0")} / sqrt(n_obs - 1) AS sr0 FROM mo), zz AS (SELECT *, (sharpe - sr0) * sqrt(n_obs - 1) / {_ERROR.format("1e-9")} AS z FROM o),
      y AS (SELECT series_id, sharpe * sqrt(252) AS s, {_phi("z")} AS dsr FROM zz),
      r AS (SELECT series_id, count(*) AS n_paths, avg(s) AS mean, coalesce(stddev_samp(s), 0) AS std, min(s) AS least, quantile_cont(s, 0.25) AS p25, median(s) AS median, quantile_cont(s, 0.75) AS p75, max(s) AS greatest,
        avg(CASE WHEN s > 0 THEN 1.0 ELSE 0 END) AS share_positive, median(dsr) AS deflated_median, CAST(0 AS BIGINT) AS n_short FROM y GROUP BY 1)
      SELECT *, CASE WHEN median <= 0 OR deflated_median < 0.5 THEN 'likely_noise' WHEN deflated_median >= 0.9 THEN 'robust' ELSE 'inconclusive' END AS verdict FROM r""",
    "mean std least p25 median p75 greatest share_positive deflated_median",
    5,
)
def cpcv(spark, d):
    return val.cpcv(_sleeves(spark, d), n_trials=9)
