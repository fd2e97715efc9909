"""Vectors of a table: which rows count, and their matrices in tasks."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Scaled components stay below this, so that doubles hold them exactly.
EXACT = 1 << 53


def usable(vector: str) -> Column:
    """True for a vector that is not null and has neither null nor non-finite components."""
    # the bound is the largest double, so only the infinities are beyond it
    return F.col(vector).isNotNull() & F.forall(vector, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) <= np.finfo(np.float64).max.item()), F.lit(False)))


def matrix(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """floor(scale * component) of the vectors of a list column, as 64-bit integers; shorter vectors count as padded with zeros."""
    sizes = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) and scale * np.abs(flat).max() >= EXACT:
        raise ValueError("a scaled component is not below 2^53")
    values = np.floor(scale * flat).astype(np.int64)
    if (sizes == dims).all():
        return values.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = values
    return out


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows that hold whole blocks go to Python in batches of at most so many, for what is computed meanwhile."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)
