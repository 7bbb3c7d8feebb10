"""Published figures, regenerated from their seeds, and closed forms against loops."""

import itertools
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions.exprs import array_split_segment, bucket_of, normal_cdf
from panelspark.operators import covariance as cov
from panelspark.operators import health, panel, performance, process, screen, signals, technical, validation
from panelspark.operators.pairs import adf, hedge_ratios, mackinnon_p, pair_legs, pair_report

SERIES = "series_id string, pos int, ret double"


def _series(spark, **arrays):
    return spark.createDataFrame([(s, i, None if x is None or x != x else float(x)) for s, a in arrays.items() for i, x in enumerate(a)], SERIES)


def _normal(seed, n):
    return np.random.default_rng(seed).normal(0.0006, 0.011, n)


def test_deflated_sharpe_goldens(spark):
    s = _series(spark, a=_normal(9, 200))
    for trials, want in ((1, 0.7566), (5, 0.5090), (40, 0.1650), (250, 0.0524)):
        assert round(validation.deflated_sharpe(s, trials).first().deflated_sharpe, 4) == want
    assert round(validation.deflated_sharpe(s, 5).first().psr, 4) == round(validation.deflated_sharpe(s, 250).first().psr, 4) == 0.8879


def test_pbo_golden(spark):
    m = np.random.default_rng(3).normal(0.0002, 0.01, (240, 6))
    trials = spark.createDataFrame([(j, i, float(m[i, j])) for i in range(240) for j in range(6)], "trial_id int, pos int, ret double")
    r = validation.pbo(trials, 8).first()
    assert (round(r.pbo, 4), round(r.logit_mean, 4), r.n_partitions) == (0.7, -0.3963, 70)


def test_performance_goldens(spark):
    r = performance.performance_report(_series(spark, a=_normal(11, 500))).first()
    assert (round(r.sharpe_annualized, 4), round(r.sortino, 4), round(r.calmar, 4)) == (1.4033, 2.1031, 2.7428)
    v = performance.var_cvar(_series(spark, a=_normal(13, 400))).first()
    assert (round(v.parametric_var_pct, 2), round(v.volatility_pct, 2)) == (1.91, 1.16)
    assert v.cvar_pct >= v.historical_var_pct


def _universe(spark, short=False):
    rows = []
    for i in range(25):
        x = 100 * np.cumprod(1 + np.random.default_rng(i).normal(0.0002 * i, 0.01, 300))
        rows += [(f"S{i:02d}", t, float(c), float(c) * 1.01, float(c) * 0.99) for t, c in enumerate(x)]
    if short:
        rows += [("NEW", t, 1.0, 1.0, 1.0) for t in range(5)] + [("MID", t, 1.0 + t, 1.0, 1.0) for t in range(80)] + [("EMPTY", 0, None, None, None)]
    return spark.createDataFrame(rows, "symbol string, ts int, close double, high double, low double")


def test_screen_golden_and_counts(spark):
    rows, _ = screen.screen_universe(_universe(spark), top_n=3)
    assert [(r.symbol, r.score) for r in rows.orderBy("rank").collect()] == [("S23", 44.3267), ("S14", 42.288308), ("S24", 39.019312)]
    _, c = screen.screen_universe(_universe(spark, True), filters={"distance_from_sma_pct": {"min": 0}, "rsi": {"max": 60}})
    c = c.first()
    assert c.universe_size == 28 == c.n_evaluated + c.n_insufficient and c.n_insufficient == 2
    assert c.n_evaluated == c.n_passing + c.n_failing + c.n_undetermined and c.n_undetermined == 1
    with pytest.raises(screen.UnknownMetric):
        screen.screen_universe(_universe(spark), rank_by="alpha")


def test_filters_are_decided_in_order(spark):
    df = spark.createDataFrame([(None, 90.0), (1.0, None), (5.0, 90.0), (1.0, 10.0)], "return_pct double, rsi double")
    f = {"return_pct": {"max": 2}, "rsi": {"max": 50}}
    assert [r.p for r in df.select(screen.passes(f).alias("p")).collect()] == [None, None, False, True]


def test_smoothing_equals_the_loops(spark):
    x = 100 * np.cumprod(1 + np.random.default_rng(4).normal(0, 0.02, 120))
    df = spark.createDataFrame([("A", i, float(c), float(c) + 1, float(c) - 1) for i, c in enumerate(x)], "symbol string, ts int, close double, high double, low double")
    got = technical.technical_features(df, sma_windows=(20, 500), ema_windows=(12,)).first()
    e = x[:12].mean()
    for v in x[12:]:
        e += 2 / 13 * (v - e)
    d = np.diff(x)
    up, down = np.maximum(d, 0)[:14].mean(), np.maximum(-d, 0)[:14].mean()
    tr = np.maximum.reduce([np.full(119, 2.0), np.abs(x[1:] + 1 - x[:-1]), np.abs(x[1:] - 1 - x[:-1])])
    a = tr[:14].mean()
    for i in range(14, 119):
        up, down, a = (up * 13 + max(d[i], 0)) / 14, (down * 13 + max(-d[i], 0)) / 14, (a * 13 + tr[i]) / 14
    assert got.sma_20 == pytest.approx(x[-20:].mean()) and got.sma_500 is None and "sma_500" in got.insufficient
    assert got.ema_12 == pytest.approx(e) and got.rsi_14 == pytest.approx(100 - 100 / (1 + up / down)) and got.atr_14 == pytest.approx(a)


def test_normal_cdf(spark):
    xs = [-9.0, -7.5, -7.0, -3.2, -1.0, -1e-9, 0.0, 0.3, 1.96, 5.0, 8.0, 40.0]
    got = [r.p for r in spark.createDataFrame([(x,) for x in xs], "x double").select(normal_cdf(F.col("x")).alias("p")).collect()]
    assert got == pytest.approx([NormalDist().cdf(x) for x in xs], abs=1e-14)


@pytest.mark.parametrize("n,k", [(10, 3), (7, 7), (101, 8), (5, 4)])
def test_segments_and_buckets(spark, n, k):
    df = spark.range(n).withColumn("n", F.lit(n))
    got = [r.s for r in df.orderBy("id").select(array_split_segment(F.col("id"), F.col("n"), k).alias("s")).collect()]
    assert got == [j for j, part in enumerate(np.array_split(np.arange(n), k)) for _ in part]
    bounds = [round(i * n / k) for i in range(k + 1)]
    got = [r.s for r in df.orderBy("id").select(bucket_of(F.col("id"), F.col("n"), F.lit(k)).alias("s")).collect()]
    assert got == [next(j for j in range(k) if bounds[j] <= i < bounds[j + 1]) for i in range(n)]


def test_newey_west_equals_the_definition(spark):
    x = _normal(2, 80)
    for lags in (1, 4):
        e = x - x.mean()
        v = e @ e + sum(2 * (1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))
        assert panel.newey_west(_series(spark, a=x), "ret", lags).first().t_stat == pytest.approx(x.mean() / math.sqrt(v / 80**2))


def test_planted_signal_is_found_and_noise_is_not(spark):
    rng = np.random.default_rng(3)
    sig, px = [], []
    for s in range(30):
        v = rng.normal()
        x = 100 * np.cumprod(1 + 0.002 * v + rng.normal(0, 0.01, 260))
        for t in range(260):
            sig.append((f"N{s:02d}", t, v + rng.normal(0, 0.01), 1.0))
            px.append((f"N{s:02d}", t, float(x[t])))
    sig.append(("STUB", 0, 1.0, 1.0))
    a, b = spark.createDataFrame(sig, "symbol string, ts int, value double, x double"), spark.createDataFrame(px, "symbol string, ts int, close double")
    r = signals.signal_icir(a, b, 21).first()
    assert r.mean_ic > 0.5 and r.icir > 5 and r.n_periods == 12
    q = {x.bucket: x.mean_return_pct for x in signals.quantile_returns(a, b, 21).collect()}
    assert q[4] > q[2] > q[0]
    assert signals.fama_macbeth(a, b, 21).first().mean_slope > 0.02
    flat = a.withColumn("value", F.lit(1.0))
    assert signals.information_coefficient(flat, b, 21).first().mean_ic is None


def test_drawdown_and_degenerate_series(spark):
    path = [0.01] * 50 + [-0.02] * 20 + [0.01] * 60
    s = _series(spark, p=path, flat=[0.0] * 60, nan=[float("nan")] * 40)
    got = {r.series_id: r for r in performance.drawdown_anatomy(s).collect()}
    assert got["p"].max_drawdown_pct == pytest.approx((1 - 0.98**20) * 100) and got["p"].n_over_10pct == 1
    perf = {r.series_id: r for r in performance.performance_report(s).collect()}
    assert set(perf) == {"p", "flat"} and perf["flat"].sharpe == 0 and perf["flat"].max_drawdown_pct == 0
    assert performance.overlap(s.where("series_id = 'flat'"), s.where("series_id = 'p'")).first().correlation is None
    assert performance.performance_report(_series(spark)).count() == 0


def test_deflated_sharpe_falls_with_trials(spark):
    s = _series(spark, a=_normal(9, 200))
    d = [validation.deflated_sharpe(s, n).first().deflated_sharpe for n in (2, 10, 100, 1000)]
    assert d == sorted(d, reverse=True)


def test_cross_section(spark):
    rows = [("A", 1, 1.0), ("B", 1, 2.0), ("C", 1, 3.0), ("D", 1, None), ("A", 2, 5.0), ("A", 3, 1.0), ("B", 3, 1.0), ("C", 3, 1.0)]
    p = spark.createDataFrame(rows, "symbol string, ts int, value double")
    get = lambda df, c: {(r.symbol, r.ts): r[c] for r in df.collect()}
    assert get(panel.cs_rank(p), "rank") == {("A", 1): 0, ("B", 1): 1, ("C", 1): 2, ("D", 1): None, ("A", 2): None, ("A", 3): 0, ("B", 3): 1, ("C", 3): 2}
    z = get(panel.cs_zscore(p), "zscore")
    assert (z["A", 1], z["B", 1], z["A", 2], z["A", 3], z["D", 1]) == (-1.0, 0.0, None, None, None)
    w = get(panel.cs_winsorize(p, 0.9, 0.1), "winsorized")
    assert w["A", 1] == pytest.approx(1.2) and w["C", 1] == pytest.approx(2.8) and w["D", 1] is None and w["A", 2] is None
    assert get(panel.cs_neutralize(p), "residual")["C", 1] == 1.0


def test_health_of_a_dirty_universe(spark):
    rows = [("OK", i, 10.0 + i) for i in range(12)] + [("SPLIT", i, 100.0 if i < 6 else 50.0) for i in range(12)] + [("STALE", i, 5.0) for i in range(12)] + [("SHORT", i, 1.0 + i) for i in range(2)] + [("BAD", 0, None), ("NEG", 11, -1.0)]
    r = health.profile(spark.createDataFrame(rows, "symbol string, ts int, close double")).first()
    assert (r.n_names, r.usable, r.unreadable, r.nonpositive, r.spike_names) == (6, 5, "BAD", "NEG", "SHORT,SPLIT")
    assert r.stale_names == "SPLIT,STALE" and r.ends_early == "SHORT" and r.n_ragged == 2


def test_covariance_and_allocation(spark):
    x = np.random.default_rng(5).normal(0, 0.01, (120, 6)) @ np.diag([1, 1, 2, 2, 3, 3])
    p = spark.createDataFrame([(f"N{j}", i, float(x[i, j])) for i in range(120) for j in range(6)], "symbol string, t int, ret double")
    _, s = cov.to_matrix(cov.cov_sample(p))
    assert s == pytest.approx(np.cov(x.T, bias=True))
    w = 0.94 ** np.arange(119, -1, -1)
    assert cov.to_matrix(cov.cov_ewma(p))[1] == pytest.approx((x * (w / w.sum())[:, None]).T @ x)
    c = x - x.mean(axis=0)
    emp, mu = c.T @ c / 120, np.trace(c.T @ c / 120) / 6
    delta = ((emp - mu * np.eye(6)) ** 2).sum() / 6
    beta = ((c**2).T @ c**2 / 120 - emp**2).sum() / 6
    shrunk, k = cov.cov_ledoit_wolf(p)
    assert k.first().shrinkage == pytest.approx(min(1, beta / delta))
    assert cov.to_matrix(shrunk)[1] == pytest.approx((1 - min(1, beta / delta)) * emp + min(1, beta / delta) * mu * np.eye(6))
    rp = cov.risk_parity_weights(s)
    assert rp.sum() == pytest.approx(1) and np.ptp(rp * (s @ rp)) < 1e-10
    assert cov.risk_parity_weights(np.diag([0.01, 0.04])) == pytest.approx([2 / 3, 1 / 3])
    h = cov.hrp_weights(s)
    assert h.sum() == pytest.approx(1) and (h > 0).all() and cov.hrp_weights(np.eye(4)) == pytest.approx([0.25] * 4)
    d, n = cov.denoise(s, 120)
    assert np.linalg.eigvalsh(d).min() > 0 and np.diag(d) == pytest.approx(np.diag(s)) and 0 <= n <= 6
    assert np.diag(cov.detone(s)) == pytest.approx(np.diag(s)) and sum(cov.variance_explained(s)) == pytest.approx(1)
    assert cov.diagnostics(np.diag([1.0, 4.0])) == {"n_assets": 2, "trace": 5.0, "condition_number": 4.0, "min_eigenvalue": 1.0, "max_eigenvalue": 4.0}


def test_vol_target_equals_the_recursion_over_many_blocks(spark):
    r = _normal(8, 700)
    var, lev = np.mean(r[:20] ** 2), []
    for x in r:
        var = 0.94 * var + 0.06 * x * x
        lev.append(0.1 / math.sqrt(var * 252))
    got = cov.vol_target(_series(spark, a=r)).first()
    assert got.mean_leverage == pytest.approx(np.mean(lev)) and got.max_leverage == pytest.approx(max(lev))
    assert got.realized_vol == pytest.approx(np.std(r * lev, ddof=1) * math.sqrt(252))


def test_pairs(spark):
    rng = np.random.default_rng(1)
    b = np.cumsum(rng.normal(0, 0.01, 500))
    e = np.zeros(500)
    for t in range(1, 500):
        e[t] = 0.8 * e[t - 1] + rng.normal(0, 0.005)
    a, c = 1.5 * b + e, np.cumsum(rng.normal(0, 0.01, 500))
    rows = [(s, i, float(math.exp(4 + v[i]))) for s, v in (("A", a), ("B", b), ("C", c)) for i in range(500)]
    p = spark.createDataFrame(rows, "symbol string, ts int, close double")
    r = {(x.a, x.b): x for x in pair_report(pair_legs(p)).collect()}
    assert r["A", "B"].hedge_ratio == pytest.approx(1.5, abs=0.05) and 1.5 < r["A", "B"].half_life < 6 and r["A", "B"].p_value < 0.01
    # two walks of their own may pass at 5 % by chance; then they are marked as not moving together
    assert r["A", "B"].cointegrated and not r["A", "B"].low_comovement and len(r) == 3
    assert r["B", "C"].p_value > 0.01 and r["B", "C"].low_comovement
    u, _, vt = np.linalg.svd(np.column_stack([b - b.mean(), a - a.mean()]), full_matrices=False)
    assert {(x.a, x.b): x.hedge_ratio for x in hedge_ratios(pair_legs(p)).collect()}["A", "B"] == pytest.approx(-vt[-1][0] / vt[-1][1])


def test_unit_root_test():
    rng = np.random.default_rng(0)
    assert adf(rng.normal(size=400))[1] < 1e-6 and adf(np.cumsum(rng.normal(size=400)))[1] > 0.05
    assert mackinnon_p(-2.86) == pytest.approx(0.05, abs=0.002) and mackinnon_p(-3.43) == pytest.approx(0.01, abs=0.001) and mackinnon_p(5) == 1.0


def test_processes_recover_their_parameters(spark):
    rng = np.random.default_rng(2)
    x = np.empty(3000)
    x[0] = 1.0
    for t in range(1, 3000):
        x[t] = x[t - 1] + 0.12 * (1.0 - x[t - 1]) + 0.05 * rng.normal()
    w, a, b, s2 = 1e-5, 0.08, 0.88, 2.5e-4
    g = np.empty(3000)
    for t in range(3000):
        g[t] = math.sqrt(s2) * rng.normal()
        s2 = w + a * g[t] ** 2 + b * s2
    df = lambda v: spark.createDataFrame([("s", i, float(z)) for i, z in enumerate(v)], "series_id string, pos int, value double")
    ou = process.ou_calibrate(df(x)).first()
    assert ou.mean_reverting and ou.kappa == pytest.approx(0.128, abs=0.04) and ou.theta == pytest.approx(1.0, abs=0.05)
    gc = process.garch_calibrate(df(g)).first()
    assert gc.alpha == pytest.approx(0.08, abs=0.04) and gc.beta == pytest.approx(0.88, abs=0.07) and gc.persistence < 0.998
    r = rng.normal(0, 0.01, 2000)
    r[::100] += 0.2
    j = process.jump_calibrate(df(r)).first()
    assert j.n_jumps >= 20 and j.sigma == pytest.approx(0.01, abs=0.001)
    one, two = (process.simulate_paths(spark.newSession() if k else spark, "gbm", 20, {"mu": 0.0, "sigma": 0.1}, 8).orderBy("path", "t").toPandas() for k in (0, 1))
    assert one.equals(two)
    much = process.draw_returns("garch", np.arange(400), 300, {"omega": 1e-6, "alpha": 0.05, "beta": 0.9}, 3)
    assert much.shape == (400, 300) and np.mean(much**2) == pytest.approx(1e-6 / 0.05, rel=0.1)
    leap = process.draw_returns("jump", np.arange(400), 300, {"mu": 0.0, "sigma": 1e-9, "jump_lambda": 0.1, "jump_mu": 1.0, "jump_sigma": 0.0}, 3)
    assert np.mean(leap > 0.5) == pytest.approx(0.1, abs=0.01)
    assert process.draw_returns("ou", np.array([7]), 50, {"kappa": 0.1, "theta": 2.0, "sigma": 0.1}, 3) == pytest.approx(process.draw_returns("ou", np.arange(9), 50, {"kappa": 0.1, "theta": 2.0, "sigma": 0.1}, 3)[7:8])
    stress = process.dgp_stress(df(x), "ou", 20).first()
    assert (stress.n_trials, stress.n_ok) == (20, 20) and stress.sharpe_q10 < stress.sharpe_q90
    flat = process.dgp_stress(df(np.ones(50)), "ou", 5).first()
    assert (flat.n_trials, flat.n_ok, flat.sharpe_q50) == (5, 0, None)
    held = process.dgp_stress(df(r), "gbm", 30, backtest=lambda data: np.full(9, 0.01) + np.arange(9) * data["close"][0] / 1e6).first()
    assert held.n_ok == 30 and held.share_positive == 1.0
    for bad in (lambda: process.dgp_stress(df(x), "walk"), lambda: process.simulate_paths(spark, "gbm", 5, {"mu": 0.0}), lambda: process.simulate_paths(spark, "gbm", 5, {"mu": 0.0, "sigma": 1.0}, 0)):
        with pytest.raises(ValueError):
            bad()
    assert process.ou_calibrate(df(np.ones(50))).first().mean_reverting is False


def test_combinations_by_position(spark):
    assert [validation.nth_combination(i, 7, 3) for i in range(35)] == list(itertools.combinations(range(7), 3))
    of = lambda **kw: {(r.combo, r.block) for r in validation._combinations(spark, 8, 4, **kw).where("inside").collect()}
    want = list(itertools.combinations(range(8), 4))
    assert of() == {(i, b) for i, c in enumerate(want) for b in c}
    assert of(at_most=7) == {(i, b) for i in range(7) for b in want[i * 10]}
    few, validation.FEW = validation.FEW, 10
    try:
        assert of() == {(i, b) for i, c in enumerate(want) for b in c}
    finally:
        validation.FEW = few


def test_paths_of_purged_combinations(spark):
    r = _normal(5, 100)
    got = {x.combo: x for x in validation.cpcv_paths(_series(spark, a=r), groups=5, test=2, purge=2, embargo=3).collect()}
    groups = np.array_split(np.arange(100), 5)
    for i, c in enumerate(itertools.combinations(range(5), 2)):
        x = r[np.concatenate([groups[k][2:-3] for k in c])]
        assert got[i].n_obs == 30 and got[i].sharpe == pytest.approx(x.mean() / x.std(ddof=1) * math.sqrt(252))
