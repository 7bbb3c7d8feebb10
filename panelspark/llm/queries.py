"""Queries of the text operators (problems 8 to 10), over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.encode import encode_corpus
from panelspark.llm.mix import mix_sources
from panelspark.llm.split import check_pieces, split_oversized


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/corpus_sources.parquet")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(_tables(spark, d)[0])


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(*_tables(spark, d))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(*_tables(spark, d))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(*_tables(spark, d))[1].where("short").select("source")


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(*_tables(spark, d))


def p10_check(spark: SparkSession, d: str) -> DataFrame:
    """Limits, overlaps and rebuilt texts of all pieces."""
    docs, sources = _tables(spark, d)
    return check_pieces(split_oversized(docs, sources), docs, sources).drop("n_oversized")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(*_tables(spark, d)).where(F.col("oversized") & (F.col("piece_no") == 0)).select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p8_ids, p9_found, p9_mixture, p9_shares, p10_found, p10_pieces, p10_check)}
ORACLE: dict[str, str] = {
    # what holds of all pieces whatever the cuts
    "p10_check": "SELECT count(*) AS n_texts, CAST(0 AS BIGINT) AS n_over_limit, CAST(0 AS BIGINT) AS n_short_overlap, CAST(0 AS BIGINT) AS n_not_rebuilt FROM documents WHERE text <> '' AND doc_id IS NOT NULL",
}
