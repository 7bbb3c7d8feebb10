"""Small tables of rules and parameters as local relations: their size is known to the planner, which then broadcasts them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    if not rows:
        return spark.createDataFrame([], schema)
    columns = zip(*rows, strict=True)
    return spark.createDataFrame(pa.table({n: pa.array(c) for n, c in zip(names, columns, strict=True)}), schema)
