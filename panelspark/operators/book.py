"""A book of return sleeves: what each may be claimed to be, and the weight that is left for one more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators.performance import var_cvar
from panelspark.operators.validation import min_track_record


def _checked(sleeves: DataFrame) -> DataFrame:
    """``series_id, n_obs, sufficient, cvar_pct`` of every sleeve, one without returns included."""
    measured = F.col("ret").isNotNull() & ~F.isnan("ret")
    n = sleeves.groupBy("series_id").agg(F.count_if(measured).alias("n_obs"))
    length = min_track_record(sleeves).select("series_id", "sufficient")
    risk = var_cvar(sleeves).select("series_id", "cvar_pct")
    return n.join(length, "series_id", "left").join(risk, "series_id", "left")


def book_monitor(sleeves: DataFrame) -> DataFrame:
    """``series_id, n_obs, sufficient, cvar_pct, status, overall``: nothing that wasn't checked reads as all-clear.

    A sleeve of fewer than two returns is ``unchecked``, one whose record is shorter than its Sharpe needs, or too short to
    tell, is ``undetermined``, else ``ok``. ``overall`` is the worst status of the book.
    """
    status = F.when(F.col("n_obs") < 2, "unchecked").when(F.coalesce("sufficient", F.lit(False)), "ok").otherwise("undetermined")
    rows = _checked(sleeves).withColumn("status", status)
    worst = rows.agg(F.when(F.bool_or(F.col("status") == "unchecked"), "unchecked").when(F.bool_or(F.col("status") != "ok"), "undetermined").otherwise("ok").alias("o")).scalar()
    return rows.select("series_id", "n_obs", "sufficient", "cvar_pct", "status", worst.alias("overall"))


def residual_weight(sleeves: DataFrame, weights: DataFrame, target: float = 1.0) -> DataFrame:
    """``series_id, held_weight, residual_weight, refused, cvar_pct``: for each sleeve what the others leave of ``target``.

    A sleeve whose record is too short is refused, with no weight: a small one would still be a claim. ``weights``
    (``series_id, weight``) names at most one weight a sleeve; one without has none; weights of other names don't count.
    """
    one = weights.groupBy("series_id").agg(F.max("weight").alias("weight"))
    rows = _checked(sleeves).join(one, "series_id", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    total = rows.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("t")).scalar()
    rows = rows.withColumn("held", total - F.col("weight")).withColumn("refused", ~F.coalesce("sufficient", F.lit(False)))
    left = F.greatest(F.lit(float(target)) - F.col("held"), F.lit(0.0))
    return rows.select("series_id", F.col("held").alias("held_weight"), F.when(~F.col("refused"), left).alias("residual_weight"), "refused", F.when(~F.col("refused"), F.col("cvar_pct")).alias("cvar_pct"))
