"""What must hold of results that SQL can't compute: random, iterative or sequential ones. Each query is one row of facts, its SQL the same facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.queries import models as m

from panelspark.queries.registry import QUERIES, ctes, query


def _of(name: str, spark, d) -> DataFrame:
    return QUERIES[name](spark, d)


def _near(a, b, within: float):
    return F.bool_and(F.abs(a - b) <= within)


_NAMES = f"{ctes('prices')}, n AS (SELECT symbol, count(*) AS n FROM prices GROUP BY 1), k AS (SELECT count(*) AS names FROM n WHERE n = (SELECT max(n) FROM n))"


@query(f"{_NAMES} SELECT names AS n_names, true AS even_risk, true AS whole FROM k")
def risk_parity_holds(spark, d):
    r = _of("risk_parity", spark, d)
    n = F.count("*")
    return r.agg(n.alias("n_names"), ((F.max("risk_share") - F.min("risk_share")) < 1e-5).alias("even_risk"), (F.abs(F.sum("weight") - 1) < 1e-5).alias("whole"))


@query(f"{_NAMES} SELECT names AS n_names, true AS positive, true AS whole FROM k")
def hrp_holds(spark, d):
    return _of("hrp", spark, d).agg(F.count("*").alias("n_names"), F.bool_and(F.col("weight") >= 0).alias("positive"), (F.abs(F.sum("weight") - 1) < 1e-5).alias("whole"))


@query(f"{_NAMES} SELECT names AS n_names, true AS whole, true AS falling FROM k")
def cov_pca_holds(spark, d):
    r = _of("cov_pca", spark, d)
    ordered = F.array_sort(F.collect_list(F.struct("k", "share")))  # a row a name
    falling = F.col("o.share") == F.reverse(F.array_sort("o.share"))
    return r.agg(F.count("*").alias("n_names"), (F.abs(F.sum("share") - 1) < 1e-4).alias("whole"), ordered.alias("o")).select("n_names", "whole", falling.alias("falling"))


def _diagonals(name: str, spark, d) -> DataFrame:
    sample = _of("cov_sample", spark, d).where("a = b").select("a", F.col("v").alias("own"))
    return _of(name, spark, d).where("a = b").join(sample, "a").agg(F.count("*").alias("n_names"), _near(F.col("v"), F.col("own"), 2e-6).alias("variances_kept"))


@query(f"{_NAMES} SELECT names AS n_names, true AS variances_kept FROM k")
def cov_denoise_holds(spark, d):
    return _diagonals("cov_denoise", spark, d)


@query(f"{_NAMES} SELECT names AS n_names, true AS variances_kept FROM k")
def cov_detone_holds(spark, d):
    return _diagonals("cov_detone", spark, d)


@query(f"{_NAMES} SELECT CAST(names AS INTEGER) AS n_assets, true AS trace_kept, true AS conditioned FROM k")
def cov_diag_holds(spark, d):
    trace = _of("cov_sample", spark, d).where("a = b").agg(F.sum("v").alias("v")).scalar()
    r = _of("cov_diag", spark, d).withColumn("t", trace)
    return r.select("n_assets", (F.abs(F.col("trace") - F.col("t")) < 1e-4).alias("trace_kept"), (F.col("max_eigenvalue") >= F.col("min_eigenvalue")).alias("conditioned"))


@query(f"{ctes('sleeves')} SELECT count(DISTINCT series_id) AS n_series, true AS ordered FROM sleeves")
def var_bootstrap_holds(spark, d):
    return _of("var_bootstrap", spark, d).agg(F.count("*").alias("n_series"), F.bool_and((F.col("ci_low_pct") <= F.col("ci_high_pct")) & (F.col("ci_low_pct") > 0)).alias("ordered"))


@query(f"{ctes('sleeves')} SELECT count(DISTINCT series_id) AS n_series, true AS stationary FROM sleeves")
def garch_cal_holds(spark, d):
    inside = (F.col("alpha") >= 0) & (F.col("beta") >= 0) & (F.col("omega") >= 0) & (F.col("persistence") < 0.999)
    return _of("garch_cal", spark, d).agg(F.count("*").alias("n_series"), F.bool_and(inside).alias("stationary"))


@query("SELECT CAST(250 AS BIGINT) AS n_steps, true AS ordered, true AS from_theta")
def ou_sim_holds(spark, d):
    start = F.bool_and((F.col("t") > 0) | ((F.col("low") == 1) & (F.col("high") == 1)))
    return _of("ou_sim", spark, d).agg(F.count("*").alias("n_steps"), F.bool_and((F.col("low") <= F.col("mid")) & (F.col("mid") <= F.col("high"))).alias("ordered"), start.alias("from_theta"))


@query("SELECT CAST(200 AS BIGINT) AS n_paths, true AS reverted, true AS stationary")
def ou_sim_terminal_holds(spark, d):
    """After 250 steps a path is at the stationary law: mean 1, deviation 0.05 / sqrt(1 - 0.88^2) = 0.105."""
    r = _of("ou_sim_terminal", spark, d)
    return r.select("n_paths", (F.abs(F.col("terminal_mean") - 1) < 0.03).alias("reverted"), F.col("terminal_vol").between(0.085, 0.125).alias("stationary"))


@query("SELECT unnest(['garch', 'gbm', 'jump', 'ou']) AS dgp, CAST(200 AS BIGINT) AS n_trials, true AS ordered")
def dgp_stress_holds(spark, d):
    ordered = (F.col("sharpe_q10") <= F.col("sharpe_q50")) & (F.col("sharpe_q50") <= F.col("sharpe_q90")) | (F.col("n_ok") == 0)
    return _of("dgp_stress", spark, d).select("dgp", "n_trials", ordered.alias("ordered"))


@query("SELECT true AS within, true AS some")
def pair_adf_holds(spark, d):
    r = _of("pair_adf", spark, d)
    return r.agg(F.bool_and(F.col("p_value").isNull() | F.col("p_value").between(0, 1)).alias("within"), (F.count("*") > 0).alias("some"))


@query("SELECT true AS some, true AS signalled, true AS counted")
def pair_screen_holds(spark, d):
    r = _of("pair_screen", spark, d)
    holds = F.bool_and(F.col("cointegrated") | (F.col("trade_signal") == "hold"))
    return r.agg((F.count("*") > 0).alias("some"), holds.alias("signalled"), (F.abs(F.max("expected_false") - 0.05 * F.count("p_value")) < 1e-5).alias("counted"))


@query("SELECT true AS same_in_any_order, true AS other_where_changed, true AS whole")
def hash_data_holds(spark, d):
    from panelspark.operators.sweep import data_hash

    data = m.P.market_returns(spark, d)
    columns = ["series_id", "pos", "ret"]
    of = lambda df: data_hash(df, columns).select("data_hash").scalar()
    changed = data.withColumn("ret", F.when(F.col("pos") == 5, F.col("ret") + 1).otherwise(F.col("ret")))
    one = spark.range(1).select(of(data).alias("a"), of(data.repartition(5, "ret")).alias("b"), of(changed).alias("c"))
    return one.select((F.col("a") == F.col("b")).alias("same_in_any_order"), (F.col("a") != F.col("c")).alias("other_where_changed"), (F.length("a") == 16).alias("whole"))


@query("SELECT true AS rising, true AS none_for_one")
def exp_max_sr_holds(spark, d):
    r = _of("exp_max_sr", spark, d)
    up = F.array_sort(F.collect_list(F.struct("n_trials", "expected_max")))  # five rows
    return r.agg(up.alias("u")).select(F.forall(F.sequence(F.lit(1), F.size("u") - 1), lambda i: F.get("u", i)["expected_max"] > F.get("u", i - 1)["expected_max"]).alias("rising"), (F.get("u", 0)["expected_max"] == 0).alias("none_for_one"))


def _ledger_totals(spark, d) -> DataFrame:
    """Per portfolio: its trades and what they brought."""
    return m._ledger(spark, d).where("kind = 'trade'").groupBy("portfolio_id").agg(F.count("*").alias("n"), F.sum("pnl").alias("pnl"))


@query("SELECT true AS counted, true AS totalled")
def bt_trades_holds(spark, d):
    j = _of("bt_trades", spark, d).join(_ledger_totals(spark, d), "portfolio_id", "full")
    return j.agg(F.bool_and(F.col("n") == F.col("n_trades")).alias("counted"), _near(F.col("pnl"), F.col("total_pnl"), 1e-3).alias("totalled"))


@query("SELECT true AS around, true AS some")
def bt_mae_holds(spark, d):
    r = _of("bt_mae", spark, d)
    return r.agg(F.bool_and(F.col("mae_pct") <= F.col("mfe_pct")).alias("around"), (F.count("*") > 0).alias("some"))


@query("SELECT true AS drag, true AS turned")
def bt_cost_holds(spark, d):
    r = _of("bt_cost", spark, d)
    return r.agg(_near(F.col("cost_drag_pct"), F.col("total_cost") / 1000, 1e-4).alias("drag"), F.bool_and(F.col("turnover") >= 0).alias("turned"))


@query("SELECT true AS not_worse, true AS some")
def p7_holdout_holds(spark, d):
    """Over all hidden readings the imputation is as near as a straight line, or nearer, and every series has settled."""
    from panelspark.queries.pipeline import p7_holdout

    r = p7_holdout(spark, d).where("grid_s IS NULL")
    return r.select((F.col("rmse_fill") <= 1.01 * F.col("rmse_line")).alias("not_worse"), ((F.col("n_hidden") > 0) & (F.col("n_unsettled") == 0)).alias("some"))


@query("SELECT count(DISTINCT upper(trim(symbol))) AS n_sources, true AS decided FROM long_prices WHERE symbol IS NOT NULL AND trim(symbol) <> '' AND date IS NOT NULL AND close IS NOT NULL")
def p1_cutoffs_holds(spark, d):
    """Every source that moves has a cutoff from its tail, beyond its threshold."""
    from panelspark.queries.pipeline import p1_cutoffs

    r = p1_cutoffs(spark, d)
    return r.agg(F.count("*").alias("n_sources"), F.bool_and(F.col("usual_move").isNull() | ((F.col("cutoff") > F.col("threshold")) & (F.col("in_tail") <= F.col("excesses")))).alias("decided"))


@query("SELECT true AS subset, true AS lasting")
def p5_changes_holds(spark, d):
    """The lasting changes are p5_found's."""
    from panelspark.queries.pipeline import p5_changes, p5_found

    keys = ["stream_id", "file_no", "field_name", "change_kind", "new_name"]
    all_, found = p5_changes(spark, d).where("lasting").select(*keys), p5_found(spark, d)
    both = all_.withColumn("a", F.lit(1)).unionByName(found.withColumn("a", F.lit(-1)), allowMissingColumns=True).groupBy(*keys).agg(F.sum("a").alias("a"))
    return both.agg(F.bool_and(F.col("a") == 0).alias("subset"), (F.count("*") > 0).alias("lasting"))


