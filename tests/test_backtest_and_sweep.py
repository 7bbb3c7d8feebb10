import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import backtest as bt
from panelspark.operators import sweep as sw

SIGNALS = "portfolio_id string, ticker string, date string, target_weight double, action string"
BARS = "ticker string, date string, open double, close double"


def _run(spark, signals, bars, **kw):
    return bt.run_backtest(spark.createDataFrame(signals, SIGNALS), spark.createDataFrame(bars, BARS), **kw)


def test_a_three_bar_ledger_by_hand(spark):
    bars = [("AAA", "1", None, 100.0), ("AAA", "2", None, 110.0), ("AAA", "3", None, 99.0)]
    led = _run(spark, [("p", "aaa", "1", 1.0, None), ("p", "AAA", "3", None, "exit")], bars, slippage_bps=10.0, commission_bps=20.0)
    paid, n = 100.1, 1000.0
    cash = 1e5 - n * paid - n * paid * 0.002
    got = [r.equity for r in led.where("kind = 'bar'").orderBy("date").collect()]
    sold = 99.0 * 0.999
    assert got == pytest.approx([cash + n * 100, cash + n * 110, cash + n * sold * 0.998])
    t = led.where("kind = 'trade'").first()
    assert (t.side, t.entry_date, t.date) == ("long", "1", "3") and t.pnl == pytest.approx(n * (sold - paid)) and t.shares == n


def test_missing_bars_holds_and_flips(spark):
    bars = [("A", "1", None, 10.0), ("A", "3", None, 12.0), ("B", "1", None, 5.0), ("B", "2", None, 5.0), ("B", "3", None, 5.0)]
    signals = [("p", "A", "1", 0.5, None), ("p", "A", "2", None, "hold"), ("p", "A", "3", -0.5, None), ("p", "B", "9", None, None)]
    free = {"slippage_bps": 0.0, "commission_bps": 0.0}
    led = _run(spark, signals, bars, **free)
    assert [r.equity for r in led.where("kind = 'bar'").orderBy("date").collect()] == pytest.approx([1e5, 1e5, 1.1e5])
    assert [r.equity for r in _run(spark, signals, bars, compat=True, **free).where("kind = 'bar'").orderBy("date").collect()] == pytest.approx([1e5, 5e4, 1.1e5])
    sides = [r.side for r in led.where("kind = 'trade'").orderBy("side").collect()]
    assert sides == ["long", "short"]
    assert _run(spark, [], bars).count() == 0 and _run(spark, signals, []).count() == 0


def test_next_open_and_capacity(spark):
    bars = [("A", str(d), 100.0, 100.0) for d in range(1, 6)]
    led = _run(spark, [("p", "A", "2", 1.0, None)], bars, fill_timing="next_open", slippage_bps=0.0, commission_bps=0.0, adv={"a": 1e5}, participation=0.4, impact=0.0)
    traded = {r.date: r.notional for r in led.where("kind = 'bar'").collect()}
    assert traded == pytest.approx({"1": 0.0, "2": 0.0, "3": 4e4, "4": 4e4, "5": 2e4})


def test_weights_known_at_each_bar(spark):
    s = spark.createDataFrame([("p", "A", "2", 5.0, None), ("p", "A", "4", None, "nonsense"), ("p", "A", "5", None, "Sell_Short ")], SIGNALS)
    b = spark.createDataFrame([("A", str(d), None, 1.0) for d in range(1, 7)], BARS)
    assert [r.weight for r in bt.known_weights(s, b, 0.8).orderBy("date").collect()] == [0.0, 0.8, 0.8, 0.8, -0.8, -0.8]


def test_attribution(spark):
    bars = [("A", str(d), None, c) for d, c in enumerate([10.0, 8.0, 15.0, 12.0], 1)]
    led = _run(spark, [("p", "A", "1", 1.0, None), ("p", "A", "4", 0.0, None)], bars, slippage_bps=0.0, commission_bps=0.0)
    x = bt.excursions(led.where("kind = 'trade'"), spark.createDataFrame(bars, BARS)).first()
    assert (x.mae_pct, x.mfe_pct) == pytest.approx((-20.0, 50.0))
    reg = bt.regime_attribution(led.where("kind = 'trade'"), spark.createDataFrame([("1", "up")], "date string, regime string")).first()
    assert (reg.regime, reg.n_trades, reg.win_rate_pct) == ("up", 1, 100.0)
    s = bt.trade_summary(led).first()
    assert s.n_trades == 1 and s.total_pnl == pytest.approx(2e4) and s.profit_factor is None
    c = bt.cost_report(led).first()
    assert c.total_cost == 0 and c.net_sharpe == pytest.approx(c.gross_sharpe)


def test_failed_trials_keep_their_slot(spark):
    def fn(data, k):
        if k == 0:
            raise RuntimeError("no")
        return [x * k for x in data] + [float("nan")]

    grid = sw.expand_grid(spark, {"k": [0, 1, 2]})
    r = sw.run_sweep(grid, fn, [0.1, -0.05, 0.02])
    t = sw.trial_sharpes(grid, r)
    best = sw.sweep_best(t).first()
    assert best.n_trials == 3 and best.trial_id == 1  # the first of equals
    status = {x.trial_id: x.status for x in r.select("trial_id", "status").distinct().collect()}
    assert status[0].startswith("RuntimeError") and status[1] == "ok"
    s = sw.surface(t).first()
    assert (s.n_ok, s.n_failed, s["shape"]) == (2, 1, "plateau")
    with pytest.raises(ValueError):
        sw.expand_grid(spark, {"k": []})


def test_native_and_python_strategies_agree(spark):
    closes = [100 + ((i * 37) % 23) - ((i * 11) % 17) for i in range(90)]
    levels = spark.createDataFrame([("m", i, float(c), c / closes[i - 1] - 1 if i else 0.0) for i, c in enumerate(closes)], "series_id string, pos int, close double, ret double")
    native = sw.sma_cross(levels, sw.sma_grid(spark, (3, 5), (13,)), 20)

    def fn(data, fast, slow):
        mean = lambda i, k: sum(data[i - k : i]) / k
        return [data[i] / data[i - 1] - 1 if mean(i, fast) > mean(i, slow) else 0.0 for i in range(20, len(data))]

    python = sw.run_sweep(sw.expand_grid(spark, {"fast": [3, 5], "slow": [13]}), fn, [float(c) for c in closes])
    j = native.join(python.withColumnRenamed("ret", "r2"), ["trial_id", "pos"])
    assert j.count() == 140 and j.where(F.abs(F.col("ret") - F.col("r2")) > 1e-12).count() == 0


def test_walk_forward_and_hash(spark):
    rows = [(t, i, 0.01 if (i + t) % 3 else -0.005) for t in range(2) for i in range(100)]
    r = spark.createDataFrame(rows, "trial_id int, pos bigint, ret double")
    w = sw.walk_forward(r, 10).orderBy("window").collect()
    assert [x.failed for x in w][:2] == ["window_too_short", None] and w[-1].n_is == 75 and w[-1].n_oos == 25 and len(w) == 10
    assert sw.data_hash(r, ["pos", "ret"]).first() == sw.data_hash(r.orderBy(F.desc("pos")), ["pos", "ret"]).first()
    assert sw.data_hash(r, ["pos", "ret"]).first() != sw.data_hash(r.limit(199), ["pos", "ret"]).first()


def test_scores_name_what_they_lack(spark):
    bars = [("A", f"{d:03d}", None, 100.0 + (d * 7 % 11)) for d in range(60)]
    led = _run(spark, [("p", "A", "000", 1.0, None)], bars)
    r = bt.score_backtest(led).first()
    assert (r.verdict, r.n_trials_source) == ("inconclusive", "not_recorded") and "deflated_sharpe" in r.not_computed and "sharpe" not in r.not_computed.split(",")
    assert bt.score_backtest(led, 3).first().deflated_sharpe is not None
    assert bt.score_backtest(_run(spark, [("q", "A", "000", 1.0, None)], bars[:5])).first().sharpe is None


def test_verdicts(spark):
    cases = [(None, None, "x", "inconclusive"), (0.95, 0.6, "x", "likely_noise"), (0.4, 0.1, None, "likely_noise"), (0.95, 0.1, None, "inconclusive"), (0.95, 0.1, "derived", "edge"), (0.95, None, "derived", "edge"), (0.7, 0.1, "derived", "inconclusive")]
    df = spark.createDataFrame(cases, "d double, p double, s string, want string")
    assert all(r.got == r.want for r in df.select("want", sw.verdict(F.col("d"), F.col("p"), F.col("s")).alias("got")).collect())


def test_the_verdict_of_a_sweep_counts_every_trial(spark):
    rows = [(t, i, 0.002 * t + 0.01 * (((i * 7 + t) % 5) - 2)) for t in range(1, 5) for i in range(80)]
    r = spark.createDataFrame(rows, "trial_id int, pos int, ret double")
    v = sw.sweep_verdict(sw.expand_grid(spark, {"k": [0, 1, 2, 3, 4]}), r, 4).first()
    assert v.n_trials == 5 and v.trial_id == 4 and v.verdict == "edge"


def test_walk_forward_with_a_users_function(spark):
    rng = np.random.default_rng(4)
    data = {"close": list(np.cumsum(rng.normal(0.05, 1, 80)) + 100), "name": "x"}

    def fn(data, lag, side):
        if lag > 9:
            raise RuntimeError("no")
        c = np.asarray(data["close"])
        return side * (c[lag:] / c[:-lag] - 1)

    grid = sw.expand_grid(spark, {"lag": [1, 2, 10], "side": [1, -1]})
    got = {r.window: r for r in sw.walk_forward_fn(grid, fn, data, windows=4).collect()}
    params = {r.trial_id: json.loads(r.params) for r in grid.collect()}
    ratio = lambda r: float(np.mean(r) / np.std(r, ddof=1))
    for w, cut in ((1, 20), (2, 40), (3, 60), (4, 80)):
        held = max(4, round(cut * 0.25))
        part = lambda a, b: sw.slice_data(data, a, b)
        want = {i: ratio(fn(part(0, cut - held), **p)) for i, p in params.items() if p["lag"] < 10}
        best = max(want, key=lambda i: (want[i], -i))
        assert (got[w].n_is, got[w].trial_id, got[w].n_trials, got[w].failed) == (cut - held, best, 24, None)
        assert got[w].is_sharpe == pytest.approx(want[best]) and got[w].oos_sharpe == pytest.approx(ratio(fn(part(cut - held, cut), **params[best])))
    bad = sw.walk_forward_fn(grid.where("params LIKE '%10%'"), fn, data, windows=5).orderBy("window").collect()
    assert [r.failed for r in bad] == ["RuntimeError: no"] * 5 and all(r.trial_id is None and r.n_trials == 10 for r in bad)
    short = sw.walk_forward_fn(grid, fn, {"close": data["close"][:32]}, windows=4).orderBy("window").collect()
    assert [r.failed for r in short][:1] == ["window_too_short"]
    with pytest.raises(ValueError):
        sw.walk_forward_fn(grid, fn, {"close": [1.0] * 10})


def test_book_and_garch_target(spark):
    from panelspark.operators import book, covariance, process

    rng = np.random.default_rng(3)
    rows = [("good", i, float(x)) for i, x in enumerate(rng.normal(0.004, 0.01, 300))] + [("weak", i, float(x)) for i, x in enumerate(rng.normal(0.0, 0.01, 300))] + [("new", 0, 0.01), ("none", 0, None)]
    sleeves = spark.createDataFrame(rows, "series_id string, pos int, ret double")
    got = {r.series_id: (r.status, r.overall) for r in book.book_monitor(sleeves).collect()}
    assert got == {"good": ("ok", "unchecked"), "weak": ("undetermined", "unchecked"), "new": ("unchecked", "unchecked"), "none": ("unchecked", "unchecked")}
    weights = spark.createDataFrame([("weak", 0.4), ("new", 0.9)], "series_id string, weight double")
    left = {r.series_id: r for r in book.residual_weight(sleeves, weights, 1.5).collect()}
    assert left["good"].residual_weight == pytest.approx(0.2) and not left["good"].refused and left["good"].cvar_pct > 0
    assert left["weak"].refused and left["weak"].residual_weight is None and left["weak"].held_weight == pytest.approx(0.9)
    var = process.garch_variance(sleeves)
    assert var.where("series_id = 'new'").first().var is None or np.isnan(var.where("series_id = 'new'").first().var)
    target = {r.series_id: r for r in covariance.vol_target_by(var, 0.1).collect()}
    assert set(target) == {"good", "weak"} and target["weak"].realized_vol == pytest.approx(0.1, rel=0.15) and target["weak"].n_obs == 300
