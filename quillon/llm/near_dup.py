"""Near-duplicate documents by DartMinHash signatures, banding and exact weighted Jaccard similarity.

A document is the multiset of its shingles of five words (lower-cased runs without white space; of all its words if it has
fewer). Darts fall into each element's region: one unit cell a repetition, and in each cell a Poisson process along the rank axis
that the element's hash seeds. Ranks are taken in slabs that double, and slabs are thrown only until every coordinate has a dart;
the earliest dart of a coordinate is its value. Two documents agree in a coordinate with a probability of their weighted Jaccard
similarity. Bands of coordinates give buckets; ``linking.link`` verifies and joins them. A pair at the threshold meets in some
band with a probability over 0.999.

Exact copies count as one document until the end. Null texts are alone; empty texts are copies of each other. Rows may repeat
and doc_ids may be null or tie: each row has its own place. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize, small_batches, temporary
from quillon.llm.linking import bitmap, link, maybe_in

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64. Those up to 2**21 are kept for the next call, and no more of them."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, 1 << 16)
        inverse = pow(int(BASE), -1, 1 << 64)
        found = [np.cumprod(np.concatenate([[U(1)], np.full(n, b, U)]), dtype=U) for b in (BASE, U(inverse))]
        if n > 1 << 21:
            return found[0], found[1]
        _powers[:] = found
    return _powers[0], _powers[1]


def word_hashes(text: str, chunk: int = 1 << 20) -> np.ndarray:
    """A hash of each word, from prefix sums of a polynomial over the UTF-8 bytes; a long text goes in chunks that end between words."""
    b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    out, at = [], 0
    while at < len(b):
        end = min(at + chunk, len(b))
        while end < len(b) and not SPACES[b[end]]:
            end += 1
        out.append(hashes_of(b[at:end]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, U)


def hashes_of(b: np.ndarray) -> np.ndarray:
    space = np.concatenate([[True], SPACES[b], [True]])
    starts, ends = np.flatnonzero(space[:-2] & ~space[1:-1]), np.flatnonzero(~space[1:-1] & space[2:]) + 1
    up, down = powers(len(b) + 1)
    sums = np.concatenate([[U(0)], np.cumsum((b.astype(U) + U(1)) * up[: len(b)], dtype=U)])
    return mix((sums[ends] - sums[starts]) * down[starts])


def cells(text: str | None, words: int = 5) -> np.ndarray:
    """The shingle multiset as sorted distinct numbers: the c-th repetition of a shingle is a number of its own."""
    w = word_hashes(text or "")
    n = min(words, len(w))
    if not n:
        return w
    shingles = np.zeros(len(w) - n + 1, U)
    for k in range(n):
        shingles = mix(shingles * U(0x2545F4914F6CDD1D) + w[k : len(w) - n + 1 + k])
    shingles.sort()
    first = np.concatenate([[True], shingles[1:] != shingles[:-1]])
    nth = np.arange(len(shingles)) - np.maximum.accumulate(np.where(first, np.arange(len(shingles)), 0))
    out = mix(shingles + nth.astype(U) * BASE)
    out.sort()
    return out


def poisson_steps(mean: float) -> np.ndarray:
    """Thresholds of a uniform 32-bit number between counts 0, 1, 2 ..."""
    p, total, out = math.exp(-mean), 0.0, []
    for k in range(1, 25):
        total += p
        out.append(min(total, 1.0) * 2**32)
        p *= mean / k
    return np.array(out)


#: Slabs of ranks (start, length): 1/64 first, each as long as all before it, and of length 1 from rank 1 on.
def slabs() -> Iterator[tuple[float, float]]:
    start = 1 / 64
    yield 0.0, start
    while start < 1:
        yield start, start
        start *= 2
    while True:
        yield start, 1.0
        start += 1


def dart_signatures(documents: list[np.ndarray], k: int) -> np.ndarray:
    """Signatures (documents x k) of non-empty cell arrays: per coordinate the earliest dart's hash."""
    owner = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
    cell = np.concatenate(documents)
    out, got = np.zeros(len(documents) * k, U), np.zeros(len(documents) * k, bool)
    for number, (start, length) in enumerate(slabs()):
        seed = mix(cell + U((number + 1) * 0xD1342543DE82EF95 % 2**64))
        darts = np.searchsorted(poisson_steps(length), (seed >> U(32)).astype(np.float64), "right")
        hit = np.flatnonzero(darts)
        many = darts[hit]
        at = np.repeat(hit, many)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        dart = mix(seed[at] ^ mix(nth.astype(U) + U(0x632BE59BD9B4E019)))
        rank = mix(dart + BASE)
        place = owner[at] * k + ((dart >> U(20)) % U(k)).astype(np.int64)
        free = ~got[place]
        place, rank, dart = place[free], rank[free], dart[free]
        order = np.argsort(rank)[::-1]
        out[place[order]] = dart[order]
        got[place] = True
        done = got.reshape(-1, k).all(axis=1)
        if done.all():
            return out.reshape(-1, k)
        keep = ~done[owner]
        owner, cell = owner[keep], cell[keep]


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    rows = signatures.shape[1] // bands
    out = np.repeat(np.arange(1, bands + 1, dtype=U)[None, :], len(signatures), axis=0)
    for r in range(rows):
        out = mix(out * BASE + signatures[:, r::rows][:, :bands])
    return out.view(np.int64)


def sketches(signatures: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate by planes: for every 64 coordinates four 64-bit numbers, of the first bits, the second and so on."""
    n, k = signatures.shape
    padded = np.zeros((n, -(-k // 64) * 64), U)
    padded[:, :k] = signatures & U(15)
    groups = padded.reshape(n, -1, 1, 64) >> np.arange(4, dtype=U)[None, None, :, None] & U(1)
    return (groups << np.arange(64, dtype=U)).sum(axis=3, dtype=U).reshape(n, -1).view(np.int64)


def differing(words: int) -> str:
    """SQL for the number of coordinates in which the sketches ``sketch`` and ``x_sketch`` differ. Every number is read once: a longer expression would not be compiled."""
    return " + ".join("bit_count(" + " | ".join(f"(sketch[{k}] ^ x_sketch[{k}])" for k in range(i, i + 4)) + ")" for i in range(0, words, 4))


def classes(docs: DataFrame, bands: int = 20, rows: int = 5, threshold: float = 0.8, words: int = 5, coordinates: int = 320) -> DataFrame:
    """Per row: doc_id, text_md5, class_id (the least doc_id of the class) and kept (true for one row of each class).

    Bands use the first bands * rows of the coordinates. Members of a bucket whose sketches (four bits a coordinate) agree in fewer
    coordinates than a pair at the threshold does, less 4.5 standard deviations, are not looked at further: one true pair in 100,000.
    """
    with temporary(docs.sparkSession) as keep:
        named = keep(_classed(docs, bands, rows, threshold, words, coordinates))
    first = named.groupBy("_lm_class").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_lm_row")).getField("_lm_row").alias("_lm_first"))
    return named.join(first, "_lm_class").select("doc_id", "text_md5", "class_id", (F.col("_lm_row") == F.col("_lm_first")).alias("kept"))


def _classed(docs: DataFrame, bands: int, rows: int, threshold: float, words: int, coordinates: int) -> DataFrame:
    """Per row: doc_id, text_md5, _lm_row and the number _lm_class of its class."""
    small_batches(docs.sparkSession)
    agree = threshold + (1 - threshold) / 16
    most = math.floor(coordinates * (1 - agree) + 4.5 * math.sqrt(coordinates * agree * (1 - agree)))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys, held = batch.column(0), [[]] * batch.num_rows, [[]] * batch.num_rows
            at = 0
            while at < len(texts):
                found, size = [], 0
                while at < len(texts) and size < 250_000:
                    if len(c := cells(texts[at].as_py(), words)):
                        found.append((at, c))
                        size += len(c)
                    at += 1
                if found:
                    signatures = dart_signatures([c for _, c in found], coordinates)
                    for (i, _), k, s in zip(found, band_keys(signatures[:, : bands * rows], bands), sketches(signatures), strict=True):
                        keys[i], held[i] = k.tolist(), s.tolist()
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(keys, longs), pa.array(held, longs)], names=["doc_id", "text_md5", "_lm_row", "keys", "sketch"])

    read = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.encode("text", "UTF-8")).alias("text_md5"), F.monotonically_increasing_id().alias("_lm_row"))
    rows_ = materialize(read.mapInArrow(signed, "doc_id long, text_md5 string, _lm_row long, keys array<bigint>, sketch array<bigint>"), "dart-bands")
    # one representative of each text: the row of least number; a null text is alone
    text_key = F.coalesce("text_md5", F.concat(F.lit("row "), F.col("_lm_row")))
    reps = materialize(rows_.groupBy(text_key.alias("_lm_text")).agg(F.min("_lm_row").alias("id")), "text-classes")
    members = materialize(rows_.select(F.col("_lm_row").alias("id"), F.col("keys").alias("buckets"), "sketch").join(reps.select("id"), "id", "left_semi"), "band-members")

    @F.pandas_udf("binary")
    def packed(text):  # noqa: ANN001, ANN202
        return text.map(lambda t: cells(t, words).tobytes())

    @F.pandas_udf("array<bigint>")
    def cell_list(cells_):  # noqa: ANN001, ANN202
        return cells_.map(lambda c: np.frombuffer(c, np.int64))

    @F.pandas_udf("double")
    def similarity(x, y):  # noqa: ANN001, ANN202
        import pandas as pd

        def one(p: bytes, q: bytes) -> float:
            p, q = np.frombuffer(p, U), np.frombuffer(q, U)
            both = len(np.intersect1d(p, q, assume_unique=True))
            return both / (len(p) + len(q) - both)

        return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    def prepare(shared: DataFrame):  # noqa: ANN202
        # the shingles of every document that shares a bucket
        needed = shared.select("id").distinct().join(reps, "id").select("id", "_lm_text")
        needed = materialize(needed.withColumn("_lm_k", F.xxhash64("_lm_text")), "to-verify")
        source = docs.select(F.md5(F.encode("text", "UTF-8")).alias("_lm_text"), "text").withColumn("_lm_k", F.xxhash64("_lm_text"))
        texts = maybe_in(source, "_lm_k", bitmap(needed, "_lm_k")).join(needed.select("id", "_lm_text"), "_lm_text")
        held = materialize(texts.select("id", packed("text").alias("cells")).dropDuplicates(["id"]), "shingles")
        tested: list[DataFrame] = []

        def viable(rows: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
            """How many cells an item has, and how many of them another item of ``rows`` has too: no more can be common. Items with too few of these go."""
            ids = rows.select("id").distinct()
            own = materialize(maybe_in(held, "id", bitmap(ids, "id")).join(ids, "id").select("id", F.explode(cell_list("cells")).alias("cell")), "open-cells")
            twice = own.groupBy("cell").agg(F.count("*").alias("c")).where("c > 1").select("cell", F.lit(1).alias("again"))
            bounds = own.join(twice, "cell", "left").groupBy("id").agg(F.count("*").alias("cells_n"), F.count("again").alias("shared_n"))
            return rows.join(bounds.where(f"shared_n >= {threshold} * cells_n"), "id"), ("cells_n", "shared_n")

        def compare(rows: DataFrame, others: DataFrame, last: bool) -> DataFrame:
            test = f"comp <> x_comp and {differing(4 * -(-coordinates // 64))} <= {most}"
            if last:
                test += f" and least(shared_n, x_shared_n) >= {threshold} * (cells_n + x_cells_n - least(shared_n, x_shared_n))"
            pairs = rows.join(others, "bucket").where(test).select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")).distinct()
            if tested:  # what has been tested goes in one join
                pairs = pairs.join(reduce(DataFrame.union, tested), ["a", "b"], "left_anti")
            pairs = materialize(pairs, "pairs")
            own = held
            if tested:  # few pairs are left: only their shingles need move
                ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
                own = maybe_in(held, "id", bitmap(ends, "id"))
            tested.append(pairs)
            with_a = pairs.join(own.select(F.col("id").alias("a"), F.col("cells").alias("p")), "a")
            return with_a.join(own.select(F.col("id").alias("b"), F.col("cells").alias("q")), "b").where(similarity("p", "q") >= threshold).select("a", "b")

        return compare, viable

    # eight coordinates each make 40 bands, in one of which a pair at the threshold meets but for one in 5000
    planes = ", ".join(f"shiftrightunsigned(sketch[4 * (i div 8) + {p}], 8 * (i % 8)) & 255" for p in range(4))
    finer = f"transform(sequence(0, {coordinates // 8 - 1}), i -> xxhash64(i, {planes}))"
    comps = link(members, prepare, carry=("sketch",), refine=finer)
    named = rows_.select("doc_id", "text_md5", "_lm_row", text_key.alias("_lm_text")).join(reps, "_lm_text").join(comps, F.col("id") == F.col("node"), "left")
    return materialize(named.select("doc_id", "text_md5", "_lm_row", F.coalesce("comp", "id").alias("_lm_class")), "near-classes")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class, all columns as they were."""
    kept = classes(docs).where("kept").select(F.col("doc_id").alias("_lm_id"), F.col("text_md5").alias("_lm_md5"))
    keyed = docs.withColumn("_lm_m", F.md5(F.encode("text", "UTF-8")))
    # a null text is no one's copy: every such row stays
    same = keyed["_lm_m"].eqNullSafe(kept["_lm_md5"]) & keyed["doc_id"].cast("long").eqNullSafe(kept["_lm_id"])
    found = keyed.where("text is not null").join(kept.where("_lm_md5 is not null"), same, "left_semi").dropDuplicates(["doc_id", "_lm_m"])
    return found.unionByName(keyed.where("text is null")).drop("_lm_m")
