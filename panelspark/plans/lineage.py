"""Lineage control that survives the loss of executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's ``spark.checkpoint.dir``; a private folder only where that is unset and Spark runs in one process (tests, laptops)."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is not None:
        return
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="panelspark-checkpoint-")
    sc.setCheckpointDir(folder)


def shared(df: DataFrame, *by: str) -> DataFrame:
    """``df`` behind one exchange by the named columns that every reader in a plan uses again.

    Readers that take different columns or rows would each have an exchange of their own, with all that is below it. Packed
    into one array, the columns can't be told apart before the exchange, so it is the same for all. Nothing is written
    but the shuffle, and lost parts are computed again from their lineage.
    """
    packed = F.array(F.struct(*[c for c in df.columns if c not in by])).alias("_packed")
    return df.select(*by, packed).repartition(*by).selectExpr(*by, "inline(_packed)")


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)
