"""Hard negatives of anchors, with angular triangle filtering.

Every row stores its angles to a few reference directions. For an anchor a and a row v, the triangle inequality of angles bounds
the angle between them by |theta_a - theta_v| and theta_a + theta_v for each reference; cosines of the bounds, multiplied by both norms and
widened by more than their rounding, enclose the score. Only rows whose interval meets an anchor's window get an integer inner product: for
positives the window is all that reaches the last best one so far, for negatives the shares of its positives' scores.

Rows lie in blocks of about ``BLOCK`` rows, dealt by nearest reference and, within it, by a hash, so equal vectors spread over
blocks; anchors lie in blocks too. Each block of anchors meets every block of rows in tasks that hold one of each; a block whose own
interval misses all windows is left out whole. A task hands on the few best of each anchor, and the best of all tasks are taken by a window
of a bounded number of rows an anchor.

Rows with a null label, a null vector or a null or non-finite component take no part. A null id is never an anchor's, and comes after all
others on ties. Repeated rows count as rows: an anchor leaves out itself alone. Shorter vectors count as padded with zeros. Scores
must fit 64 bits, else it is an error. Columns other than the three are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize, partitions
from quillon.llm.vectors import batches_of, matrix, usable

SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
#: Rows of a block, anchors of a block, blocks that go to Python at a time, rows that the references are chosen from.
BLOCK, ANCHORS, AT_ONCE, SAMPLE = 1024, 256, 64, 1024
LAST = np.iinfo(np.int64).max
LEAST = np.iinfo(np.int64).min


def references(sample: np.ndarray, most: int = 12) -> np.ndarray:
    """Directions far from each other: the first row, then over and over the row whose nearest reference is farthest."""
    norms = np.sqrt((sample.astype(np.float64) ** 2).sum(axis=1))
    units = sample[norms > 0] / norms[norms > 0, None]
    if not len(units):
        return np.eye(1, sample.shape[1])
    chosen = [0]
    near = units @ units[0]
    while len(chosen) < min(most, len(units)) and near.min() < 1 - 1e-9:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, units @ units[chosen[-1]])
    return units[chosen]


class Block:
    """Rows side by side: identity, id and its order, label, vector, and the norm times cosine and sine of each stored angle."""

    def __init__(self, row: dict, dims: int, kind: str):
        self.own = np.frombuffer(row["own"], np.int64)
        self.order = np.frombuffer(row["order"], np.int64)
        self.labels = np.frombuffer(row["labels"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], kind).reshape(len(self.own), dims)
        self.norms = np.frombuffer(row["norms"], np.float64)
        angles = np.frombuffer(row["angles"], np.float64).reshape(len(self.own), -1)
        self.cosines, self.sines = self.norms[:, None] * np.cos(angles), self.norms[:, None] * np.sin(angles)

    def bounds(self, other: "Block") -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest scores of each pair: cos(x - y) is least, and cos(x + y) greatest, over the references."""
        low = high = None
        for r in range(self.cosines.shape[1]):
            c, s = np.outer(self.cosines[:, r], other.cosines[:, r]), np.outer(self.sines[:, r], other.sines[:, r])
            low, high = (c - s, c + s) if low is None else (np.maximum(low, c - s, out=low), np.minimum(high, c + s, out=high))
        slack = 1e-9 * float(self.norms.max(initial=0)) * float(other.norms.max(initial=0)) + 1e-9  # angles and products are off by some 1e-15
        return np.ceil(low - slack), np.floor(high + slack)


def _pack(dims: int, kind: str, extra: list[str]):
    def pack(table: pa.Table) -> pa.Table:
        joined = {c: b"".join(table[c].to_pylist()) for c in ("vectors", "angles")}
        flat = {c: table[c].to_numpy().astype(t).tobytes() for c, t in (("own", np.int64), ("order", np.int64), ("labels", np.int64), ("norms", np.float64))}
        names = ["block", *BLOCK_COLUMNS, *extra]
        lists = {c: [b"".join(table[c].to_pylist())] for c in extra}
        row = {"block": [table["block"][0].as_py()], **{c: [v] for c, v in flat.items()}, **{c: [v] for c, v in joined.items()}, **lists}
        return pa.table({n: pa.array(row[n], pa.string() if n == "block" else pa.binary()) for n in names})

    return pack


BLOCK_COLUMNS = ["own", "order", "labels", "vectors", "norms", "angles"]


def _best(scores: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Places of the best ``most``: higher scores first, ties by the order of ids."""
    if len(scores) > most:
        least = np.partition(scores, len(scores) - most)[len(scores) - most]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((order[some], -scores[some]))][:most]


def _meetings(pairs: DataFrame, dims: int, kind: str, seek, schema: str) -> DataFrame:
    """``seek(anchors, rows, state)`` for each meeting of blocks; state lasts while the same block of anchors goes on, and is handed on then."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, anchors, state = None, None, None

        def out() -> pa.RecordBatch:
            found = [(int(anchors.own[k]), *x) for k, best in state.items() for x in best]
            columns = list(zip(*found, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                if row["a_block"] != current:
                    if state:
                        yield out()
                    current, state = row["a_block"], {}
                    anchors = Block({c: row[f"a_{c}"] for c in BLOCK_COLUMNS}, dims, kind)
                    anchors.windows = row.get("a_windows")
                seek(anchors, Block(row, dims, kind), state)
        if state:
            yield out()

    return pairs.mapInArrow(run, schema)


def _scores(block: Block, some: np.ndarray, vector: np.ndarray, exact: type) -> np.ndarray:
    """Inner products of some rows, exact: in doubles where all sums stay below 2^53, else in 64-bit integers."""
    return (block.vectors[some].astype(exact) @ vector.astype(exact)).astype(np.int64)


def hard_negatives(
    df: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """For each anchor (ids divisible by ``every``) and each of its best same-label rows, the best rows of other labels whose score is
    from ``low`` to ``high`` percent of the positive's."""
    spark = df.sparkSession
    ids = F.col(key).cast("long")
    rows = df.where(usable(vector) & F.col(label).isNotNull()).select(ids.alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    n, dims, most = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(F.expr(f"aggregate(v, 0D, (m, c) -> greatest(m, abs(floor({scale} * c))))")), F.lit(0.0))).first()
    nothing = spark.createDataFrame([], SCHEMA)
    if not n or not dims:
        return nothing
    if dims * int(most) ** 2 >= 1 << 63:
        raise ValueError("scores would not fit 64 bits")
    exact = np.float64 if dims * int(most) ** 2 < 1 << 53 else np.int64
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    sample = rows.select("id", "v").orderBy(F.xxhash64("id", "v")).limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    known = references(matrix(sample, dims, scale))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(2), dims, scale)
            norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
            cosines = np.clip((x @ known.T) / np.where(norms > 0, norms, 1)[:, None], -1, 1)
            angles, packed = np.arccos(cosines), x.astype(kind)
            cells = cosines.argmax(axis=1).astype(np.int32) if batch.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v.tobytes() for v in packed], pa.binary()), pa.array(norms), pa.array([a.tobytes() for a in angles], pa.binary()), pa.array(cells)], names=["id", "labels", "vectors", "norms", "angles", "cell"])

    measured = rows.mapInArrow(measure, "id long, labels long, vectors binary, norms double, angles binary, cell int")
    # an identity of each row, fixed by being written
    stored = materialize(measured.withColumn("own", F.monotonically_increasing_id()).withColumn("order", F.coalesce("id", F.lit(LAST))), "vectors")
    cells = {r.cell: r.n for r in stored.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row a reference
    many = F.create_map(*[F.lit(x) for c, k in cells.items() for x in (c, -(-k // BLOCK))])
    blocks = -(-n // BLOCK)
    parts = min(blocks, 4 * partitions(spark))
    dealt = stored.withColumn("block", F.concat_ws("-", "cell", F.pmod(F.xxhash64("own"), many[F.col("cell")])))
    schema = "block string, " + ", ".join(f"{c} binary" for c in BLOCK_COLUMNS)
    row_blocks = materialize(dealt.groupBy("block").applyInArrow(_pack(dims, kind, []), schema).withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts))), "blocks")
    anchors = stored.where(F.col("id") % every == 0)
    n_anchors = anchors.count()
    if not n_anchors:
        return nothing
    grouped = anchors.withColumn("block", F.pmod(F.xxhash64("own"), F.lit(-(-n_anchors // ANCHORS))).cast("string"))

    def meet(grouped: DataFrame, extra: list[str]) -> DataFrame:
        """Each block of anchors beside each block of rows: the stated queries against all rows, block by block."""
        own = grouped.groupBy("block").applyInArrow(_pack(dims, kind, extra), schema + "".join(f", {c} binary" for c in extra))
        own = own.select(*[F.col(c).alias(f"a_{c}") for c in own.columns], F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
        return own.join(row_blocks.hint("merge"), "part").drop("part")

    def seek_positives(a: Block, b: Block, state: dict) -> None:
        _, upper = a.bounds(b)
        reach = np.array([state[k][-1][2] if len(state.get(k, ())) == positives else LEAST for k in range(len(a.own))], np.float64)
        hit = (upper >= reach[:, None]) & (a.labels[:, None] == b.labels) & (a.own[:, None] != b.own)
        for k in np.flatnonzero(hit.any(axis=1)).tolist():
            some = np.flatnonzero(hit[k])
            scores = _scores(b, some, a.vectors[k], exact)
            some, scores = (x[i] for i in [_best(scores, b.order[some], positives)] for x in (some, scores))
            state[k] = sorted([*state.get(k, []), *zip(b.own[some].tolist(), b.order[some].tolist(), scores.tolist(), strict=True)], key=lambda x: (-x[2], x[1], x[0]))[:positives]

    def seek_negatives(a: Block, b: Block, state: dict) -> None:
        lower, upper = a.bounds(b)
        windows = np.frombuffer(a.windows, np.int64).reshape(len(a.own), positives, 3)  # place, least and greatest; none where place is 0
        floor = windows[:, :, 1].copy()
        for k, best in state.items():
            for place in range(1, positives + 1):
                if len(own := [x for x in best if x[0] == place]) == negatives:
                    floor[k, place - 1] = own[-1][3]
        hit = (upper >= floor.min(axis=1)[:, None]) & (lower <= windows[:, :, 2].max(axis=1)[:, None]) & (a.labels[:, None] != b.labels)
        for k in np.flatnonzero(hit.any(axis=1)).tolist():
            some = np.flatnonzero(hit[k])
            scores = _scores(b, some, a.vectors[k], exact)
            for place, (least, greatest) in enumerate(zip(floor[k].tolist(), windows[k, :, 2].tolist(), strict=True), start=1):
                inside = np.flatnonzero((scores >= least) & (scores <= greatest))
                if not len(inside):
                    continue
                best = inside[_best(scores[inside], b.order[some[inside]], negatives)]
                new = [(place, *x) for x in zip(b.own[some[best]].tolist(), b.order[some[best]].tolist(), scores[best].tolist(), strict=True)]
                mine = [x for x in state.get(k, []) if x[0] == place]
                state[k] = [x for x in state.get(k, []) if x[0] != place] + sorted([*mine, *new], key=lambda x: (-x[3], x[2], x[1]))[:negatives]

    with batches_of(spark, AT_ONCE):
        found = _meetings(meet(grouped, []), dims, kind, seek_positives, "anchor long, own long, order long, score long")
        best = found.selectExpr("*", "row_number() over (partition by anchor order by score desc, order, own) as place").where(F.col("place") <= positives)
        best = materialize(best, "positives")
        scaled = best.select("anchor", F.struct("place", F.expr(f"cast(ceil(cast({low} as decimal(38,0)) * score / 100) as long)").alias("least"), F.expr(f"cast(floor(cast({high} as decimal(38,0)) * score / 100) as long)").alias("greatest")).alias("w"))
        windows = scaled.groupBy("anchor").agg(F.collect_list("w").alias("w"))  # at most `positives` an anchor

        def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for found in batch.column(1).to_pylist():
                    own = np.tile(np.array([0, LAST, LEAST], np.int64), (positives, 1))
                    for w in found:
                        own[w["place"] - 1] = (w["place"], w["least"], w["greatest"])
                    out.append(own.tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["own", "windows"])

        seeking = grouped.join(windows.mapInArrow(lay, "own long, windows binary"), "own")
        found = _meetings(meet(seeking, ["windows"]), dims, kind, seek_negatives, "anchor long, place long, own long, order long, score long")
        chosen = materialize(found.selectExpr("*", "row_number() over (partition by anchor, place order by score desc, order, own) as rank").where(F.col("rank") <= negatives), "negatives")

    named = lambda t, c: stored.select(F.col("own").alias(t), F.col("id").alias(c))
    firsts = best.select("anchor", F.col("place").cast("long").alias("place"), F.col("own").alias("positive"), F.col("score").alias("positive_score"))
    paired = chosen.select("anchor", "place", "rank", F.col("own").alias("negative"), F.col("score").alias("negative_score")).join(firsts, ["anchor", "place"])
    known_ids = paired.join(named("anchor", "anchor_id"), "anchor").join(named("positive", "positive_id"), "positive").join(named("negative", "negative_id"), "negative")
    return known_ids.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


#: Brute force over every pair. The label's change where the id is divisible by 7 is the query's.
ORACLE = """
WITH usable AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(CAST(a.x AS DOUBLE[]), CAST(b.x AS DOUBLE[])) AS BIGINT) AS score
    FROM usable a JOIN usable b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), firsts AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), inside AS (
    SELECT f.anchor_id, f.positive_id, s.other_id AS negative_id, f.positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY f.anchor_id, f.positive_id ORDER BY s.score DESC, s.other_id) AS rank
    FROM firsts f JOIN scored s ON f.anchor_id = s.anchor_id AND NOT s.same AND 50 * f.positive_score <= 100 * s.score AND 100 * s.score <= 95 * f.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM inside WHERE rank <= 3
"""
