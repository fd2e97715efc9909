"""Whitening of embeddings by the polarisation identity.

A component c becomes the integer x = floor(scale * c) + shift. All sums are of integers and exact: of each dimension (S), of
the squares of each dimension centred at the integer nearest to its mean, and of the squares of each sum of two centred
dimensions. What the centre is off the mean is taken out in integers too. Half of the variance of i + j, less those of i and j, is
the covariance of i and j; the matrix of them, rounded once, goes to an eigensolver on the driver, as d x d numbers. Rows
are whitened in tasks; what leaves a task before that is at most a number for each pair of dimensions.

Rows with a null vector, or null or non-finite components, take no part; null or repeated ids and repeated rows count as they
stand. Shorter vectors count as padded with zeros, so an empty one is zeros. Components whose eigenvalue is 0, to the solver's
precision, cannot be whitened and are left out; so a table of one row, or of equal rows, gives no rows, as an empty one does. A deviation
that does not fit a long is null. Columns other than the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.vectors import matrix, usable

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
SAFE = 1 << 62


def _integers(values: np.ndarray, most: int) -> np.ndarray:
    """``values`` as they are if results up to ``most`` fit 64 bits, else as Python's integers."""
    return values if most < SAFE else values.astype(object)


def _sums(rows: DataFrame, add, kind: str) -> dict[tuple[int, int], Decimal | float]:
    """Sums over all rows, by pair of numbers: ``add(column)`` gives those of a batch; a task hands on one row a pair."""
    arrow = pa.decimal128(38, 0) if kind == "decimal(38,0)" else pa.float64()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        for batch in batches:
            if batch.num_rows:
                own = add(batch.column(0))
                held = own if held is None else [(i, j, a + b) for (i, j, a), (*_, b) in zip(held, own, strict=True)]
        if held is not None:
            i, j, s = zip(*held, strict=True)
            values = [Decimal(int(v)) for v in s] if kind == "decimal(38,0)" else [float(v) for v in s]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(values, arrow)], names=["i", "j", "s"])

    found = rows.mapInArrow(partial, f"i int, j int, s {kind}").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    return {(r.i, r.j): r.s for r in found}


def covariance(rows: DataFrame, dims: int, n: int, scale: int, shift: int) -> tuple[list[int], list[list[int]]]:
    """S of each dimension, and n * n times the covariance of each pair, all exact. rows: one column of vectors."""
    most = 1 << 53  # of a component; a task adds at most as many rows as a batch has before it goes to Python's integers

    def plain(column: pa.Array) -> list:
        x = matrix(column, dims, scale)
        return [(k, k, int(v)) for k, v in enumerate(_integers(x, most=int(np.abs(x).max(initial=0)) * len(x)).sum(axis=0))]

    sums = _sums(rows, plain, "decimal(38,0)")
    totals = [int(sums[k, k]) for k in range(dims)]
    middle = np.array([(2 * t + n) // (2 * n) for t in totals], np.int64)

    def squares(column: pa.Array) -> list:
        y = matrix(column, dims, scale) - middle
        y = _integers(y, most=(2 * min(int(np.abs(y).max(initial=0)), most)) ** 2 * len(y))
        out = [(k, k, int(v)) for k, v in enumerate((y * y).sum(axis=0))]
        for i in range(dims - 1):
            both = y[:, i : i + 1] + y[:, i + 1 :]
            out += [(i, i + 1 + k, int(v)) for k, v in enumerate((both * both).sum(axis=0))]
        return out

    found = _sums(rows, squares, "decimal(38,0)")
    off = [t - n * int(m) for t, m in zip(totals, middle, strict=True)]  # sums of the centred values
    single = [n * int(found[i, i]) - off[i] ** 2 for i in range(dims)]
    exact = [[0] * dims for _ in range(dims)]
    for i in range(dims):
        exact[i][i] = single[i]
        for j in range(i + 1, dims):
            pair = n * int(found[i, j]) - (off[i] + off[j]) ** 2
            exact[i][j] = exact[j][i] = (pair - single[i] - single[j]) // 2  # even: twice a sum of integers
    return [t + n * shift for t in totals], exact


def whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = 32, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """A row for each usable row and component: the projection of x less its mean on the component, over the root of its eigenvalue.

    ``identity_error`` is measured on the whitened rows themselves, in a pass of its own.
    """
    spark = df.sparkSession
    rows = df.where(usable(vector)).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    n, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    nothing = spark.createDataFrame([], SCHEMA)
    if not n or not dims:
        return nothing
    totals, exact = covariance(rows.select("v"), dims, n, scale, shift)
    v = np.array([[c / (n * n) for c in line] for line in exact])
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    keep = int((values[: min(components, dims)] > max(values[0], 0) * 1e-13 * dims).sum())
    if not keep:
        return nothing
    explained = values[:keep] / (sum(exact[i][i] for i in range(dims)) / (n * n))
    turned = vectors[:, :keep] / np.sqrt(values[:keep])
    plain = [t - n * shift for t in totals]
    middle = np.array([(2 * t + n) // (2 * n) for t in plain], np.int64)
    rest = np.array([(t - n * int(m)) / n for t, m in zip(plain, middle, strict=True)])
    off = np.array([t - n * int(m) for t, m in zip(plain, middle, strict=True)], object)

    def products(column: pa.Array) -> list:
        w = (matrix(column, dims, scale) - middle - rest) @ turned
        square = w.T @ w
        return [(k, -1, float(x)) for k, x in enumerate(w.sum(axis=0))] + [(i, j, float(square[i, j])) for i in range(keep) for j in range(i, keep)]

    found = _sums(rows.select("v"), products, "double")
    error = max(abs(found[i, j] / n - found[i, -1] / n * found[j, -1] / n - (i == j)) for i in range(keep) for j in range(i, keep))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = matrix(batch.column(1), dims, scale) - middle
            most = n * (int(np.abs(y).max(initial=0)) + 1)  # of n * y less the sum
            z = n * _integers(y, dims * most**2) - (off if dims * most**2 >= SAFE else off.astype(np.int64))
            deviation = [d if d < 1 << 63 else None for d in (z * z).sum(axis=1).tolist()]
            ids, many = batch.column(0), batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(np.repeat(np.arange(many), keep))), pa.array(np.tile(np.arange(1, keep + 1, dtype=np.int32), many)), pa.array(np.full(many * keep, n, np.int64)), pa.array([d for d in deviation for _ in range(keep)], pa.int64()), pa.array(((y - rest) @ turned).ravel()), pa.array(np.tile(explained, many)), pa.array(np.full(many * keep, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, SCHEMA)
