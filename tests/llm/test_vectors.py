"""Hard negatives and whitening against brute force, and on hard cases."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import hard_negatives, queries, whitening

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")
HARD = [(None, None, None), (0, None, 1), (50, [0.5, -0.25], None), (100, [0.5, None], 1), (100, [0.5, NAN], 1), (150, [INF, 0.5], 1)]


def test_hard_negatives_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(map(tuple, queries.op11_hard_negatives(spark, SF).collect())) == sorted(con.execute(hard_negatives.ORACLE).fetchall())


def mined(rows, every=50, positives=5, negatives=3):
    """Brute force, row by row; shorter vectors are padded."""
    use = [(i, k, lab, [math.floor(256 * c) for c in v]) for i, (k, v, lab) in enumerate(rows) if v is not None and lab is not None and all(c is not None and math.isfinite(c) for c in v)]
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for i, k, lab, v in use:
        if k is None or k % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=False)), other, lab2 == lab) for j, other, lab2, w in use if j != i]
        for score, other, _ in sorted((s for s in scored if s[2]), key=order)[:positives]:
            inside = sorted((s for s in scored if not s[2] and 50 * score <= 100 * s[0] <= 95 * score), key=order)[:negatives]
            out += [(k, other, r, n, score, s) for r, (s, n, _) in enumerate(inside, start=1)]
    return out


@pytest.mark.parametrize("kind", ["hot", "signs", "large"])
def test_hard_negatives_against_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(hard_negatives, "BLOCK", 40)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    r = random.Random(kind)
    scale = 3e5 if kind == "large" else 1
    rows = [(i, [scale * r.choice([0.125, 0.25, -0.5, 0.75, r.random()]) + (kind != "signs") * scale for _ in range(r.choice([6, 6, 6, 5]))], r.randrange(3)) for i in range(300)]
    if kind == "hot":  # a third of all rows are one vector, some rows come twice, some ids are null
        rows = [(i, [1.0] * 6, lab) if i % 3 == 0 else (i, v, lab) for i, v, lab in rows] + rows[:60] + [(None, [1.0] * 6, 1), (None, [1.0] * 6, 2)]
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows + HARD, SCHEMA.replace("float", "double")).withColumn("own", F.lit("theirs")).withColumn("block", F.lit(1)), every=10)
    key = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(mined(rows + HARD, every=10), key=key)


def test_hard_negatives_of_little(spark):
    for rows in ([], HARD, [(0, [], 1), (1, [], 1)], [(0, [0.0, 0.0], 1), (1, [0.0, 0.0], 1), (2, [0.0], 2)], [(1, [1.0], 1)]):
        got = hard_negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA))
        assert sorted(map(tuple, got.collect())) == sorted(mined(rows))
    with pytest.raises(ValueError):
        hard_negatives.hard_negatives(spark.createDataFrame([(0, [1e9, 1e9], 1)], SCHEMA))


def test_score_bounds_hold_and_exclude():
    g = np.random.default_rng(1)
    centers = g.normal(size=(8, 16)) * 100
    x = np.floor(centers[g.integers(0, 8, 600)] + g.normal(size=(600, 16)) * 8).astype(np.int64)
    x[:20] = 0
    x[20:40] = x[40]  # parallel rows: the interval is a point
    known = hard_negatives.references(x)
    norms = np.sqrt((x.astype(float) ** 2).sum(axis=1))
    angles = np.arccos(np.clip(x @ known.T / np.where(norms > 0, norms, 1)[:, None], -1, 1))
    ids = np.arange(600).astype(np.int64).tobytes()
    block = hard_negatives.Block({"own": ids, "order": ids, "labels": ids, "vectors": x.astype("<i2").tobytes(), "norms": norms.tobytes(), "angles": angles.tobytes()}, 16, "<i2")
    low, high = block.bounds(block)
    scores = x @ x.T
    assert (low <= scores).all() and (scores <= high).all()
    best = np.sort(scores, axis=1)[:, -6]
    assert (high >= best[:, None]).mean() < 0.5  # most rows need no inner product


def whitened(rows):
    """Exact sums in Python's integers, and numpy's covariance of the centred values."""
    use = [(k, v) for k, v, _ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max(len(v) for _, v in use)
    x = [[math.floor(64 * c) + 1_000_000 for c in [*v, *[0] * (dims - len(v))]] for _, v in use]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = np.array([[n * a - s for a, s in zip(v, sums, strict=True)] for v in x], float) / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    return [k for k, _ in use], n, [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x], centred @ vectors[:, ::-1] / np.sqrt(np.abs(values[::-1])), values[::-1] / np.trace(cov), cov


def check_whitened(df, rows, dims):
    ids, n, deviations, projected, explained, _ = whitened(rows)
    got = df.toPandas()
    keep = min(32, dims)
    assert len(got) == len(ids) * keep and (got.n == n).all() and got.identity_error.nunique() == 1 and got.identity_error[0] <= 1e-4
    assert sorted(got[got.component == 1].deviation) == sorted(deviations)
    for k in range(keep):
        own = got[got.component == k + 1].sort_values("vec_id")
        want = projected[np.argsort(ids, kind="stable"), k]
        assert np.allclose(own.explained, explained[k], rtol=1e-6)
        assert np.allclose(own.whitened, want, atol=1e-6) or np.allclose(own.whitened, -want, atol=1e-6)


def test_whitening_of_the_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitened(queries.op13_whitening(spark, SF), rows, 64)


def test_whitening_hard(spark):
    r = random.Random(3)
    rows = [(i, [r.uniform(-2, 2) + 1e3, r.uniform(-1, 1), 3 * r.random()][: 3 - (i == 7)], None) for i in range(80)]
    df = spark.createDataFrame(rows + HARD, SCHEMA.replace("float", "double")).withColumn("component", F.lit(1)).withColumn("v", F.lit(2))
    finite = [x for x in rows + HARD if x[1] is not None and len(x[1]) > 2] + [rows[7], (50, [0.5, -0.25], None)]
    check_whitened(whitening.whiten(df), finite, 3)
    for none in ([], HARD[:2], [(1, [], 1)], [(1, [0.5], 1)], [(1, [0.5, 0.25], 1)] * 4):
        assert whitening.whiten(spark.createDataFrame(none, SCHEMA)).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 1.0], 0) for i in range(10)], SCHEMA)  # one component has no variance
    assert {x.component for x in whitening.whiten(flat).collect()} == {1}


def test_covariance_is_exact(spark):
    r = random.Random(4)
    rows = [[r.randrange(-(1 << 40), 1 << 40) / 64 for _ in range(4)] for _ in range(50)]
    totals, exact = whitening.covariance(spark.createDataFrame([(v,) for v in rows], "v array<double>"), 4, 50, 64, 7)
    x = [[math.floor(64 * c) + 7 for c in v] for v in rows]
    assert totals == [sum(c) for c in zip(*x, strict=True)]
    z = [[50 * a - s for a, s in zip(v, totals, strict=True)] for v in x]
    assert exact == [[sum(v[i] * v[j] for v in z) // 50 for j in range(4)] for i in range(4)]
