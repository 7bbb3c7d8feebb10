"""The operations by name, each a function of DataFrames. A session's own handlers extend or replace them."""

from __future__ import annotations

from collections.abc import Callable

from panelspark.operators import backtest, covariance, factors, health, pairs, panel, performance, process, screen, signals, sweep, technical, validation
from panelspark.sources import artifacts

OPERATIONS: dict[str, Callable] = {
    "data.profile": health.profile,
    "data.describe": health.name_health,
    "data.resolve": sweep.data_hash,
    "compute.sweep": sweep.run_sweep,
    "compute.deflated_sharpe": validation.deflated_sharpe,
    "compute.pbo_cscv": validation.pbo,
    "compute.min_track_record_length": validation.min_track_record,
    "compute.performance_report": performance.performance_report,
    "compute.compute_var_cvar": performance.var_cvar,
    "compute.technical_features": technical.technical_features,
    "compute.screen": screen.screen_universe,
    "compute.signal_ic": signals.information_coefficient,
    "compute.signal_quantiles": signals.quantile_returns,
    "compute.signal_decay": signals.signal_decay,
    "compute.subperiods": performance.subperiod_stability,
    "compute.cost_ladder": performance.cost_ladder,
    "compute.drawdown_anatomy": performance.drawdown_anatomy,
    "compute.overlap": performance.overlap,
    "compute.backtest": backtest.run_backtest,
    "compute.score_backtest": backtest.score_backtest,
    "compute.cpcv": validation.cpcv,
    "compute.factors": factors.decompose,
    "compute.pairs": pairs.pair_report,
    "compute.cointegrated_pairs": pairs.screen_pairs,
    "compute.walk_forward": sweep.walk_forward,
    "compute.book_overlap": performance.book_overlap,
    "compute.panel_transform": panel.panel_transform,
    "compute.signal_icir": signals.signal_icir,
    "compute.fama_macbeth": signals.fama_macbeth,
    "compute.quantile_book": signals.quantile_book,
    "compute.ewma_cov": covariance.cov_ewma,
    "compute.denoise_cov": covariance.denoise_cov,
    "compute.hrp": covariance.hrp,
    "compute.risk_parity": covariance.risk_parity,
    "compute.vol_target": covariance.vol_target,
    "compute.ou_calibrate": process.ou_calibrate,
    "compute.ou_simulate": process.ou_simulate,
    "compute.gbm_calibrate": process.gbm_calibrate,
    "compute.jump_calibrate": process.jump_calibrate,
    "compute.garch": process.garch_calibrate,
    "compute.dgp_stress": process.dgp_stress,
    "compute.grinold_alpha": panel.grinold_alpha,
    "compute.breadth_ir": panel.breadth_ir,
    "compute.detone_cov": covariance.detone_cov,
    "emit.study": artifacts.emit_study,
    **{f"emit.{name}": artifacts.emit for name in ("screen", "monitor", "sizing_decision", "signal_report", "health", "stress", "overlap", "process_report")},
    **{f"record.{name}": artifacts.record for name in ("note", "decision", "approval")},
}


def run(name: str, *args, handlers: dict[str, Callable] | None = None, **params):
    known = OPERATIONS | (handlers or {})
    if name not in known:
        raise KeyError(f"no operation {name!r}")
    return known[name](*args, **params)
