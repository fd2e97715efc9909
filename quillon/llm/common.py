"""Helpers shared by the corpus operators.

Internal columns start with ``_lm_`` so that extra columns of the caller's tables cannot clash with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.graph import connected_components
from quillon.session import discard, materialize, shared_dir, temporary

__all__ = ["connected_components", "crc32_utf8", "discard", "materialize", "partitions", "shared_dir", "small_batches", "table", "temporary"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_utf8(text: Column) -> Column:
    return F.crc32(F.encode(text, "UTF-8"))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python in batches of at most so many rows: the usual 10,000 take hundreds of MB a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)
