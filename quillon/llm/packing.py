"""Best-fit packing of token sequences by a configuration linear program over the length histogram.

Lengths are whole numbers up to the capacity, so the program has at most ``capacity`` rows whatever the number of documents,
and only the histogram reaches the driver. Its columns are configurations (what one sequence holds). Multiplicative weights
solve it: a round prices all rooms by an unbounded-knapsack dynamic program, adds configurations priced within ``tolerance`` of
the best, and lowers the weights of the lengths that they cover. What no such configuration covers is covered in further rounds that
accept twice the tolerance each, so the solution covers everything. Weights over the best price are a dual solution, and so a
lower bound; how far the solution is above it is stated. The fractional solution is rounded with the remainder carried from one configuration to the next; what is left over
is placed by best fit decreasing, on counts, not on items. Pieces then find their places by arithmetic: the i-th piece of a length
goes to the sequence and offset that the plan gives to that number.

Null and empty texts give one piece holding the end id. Repeated rows are separate documents. Other columns are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize, small_batches
from quillon.llm.tokens import encoder

Pattern = tuple[tuple[int, int], ...]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Cut each document's ids (with ``end_id`` after them) into pieces of at most ``capacity``; only longer ones are cut."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(own.ids(text.as_py()) + end)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def knapsack(weights: np.ndarray, capacity: int) -> np.ndarray:
    """The greatest weight that each room up to the capacity can hold, any length any number of times. weights[l] is that of length l."""
    lengths = np.flatnonzero(weights > 0)
    worth, value = weights[lengths], np.zeros(capacity + 1)
    for room in range(1, capacity + 1):
        k = int(np.searchsorted(lengths, room, "right"))
        value[room] = max(value[room - 1], (worth[:k] + value[room - lengths[:k]]).max()) if k else value[room - 1]
    return value


class Program(NamedTuple):
    """A fractional solution: how often each configuration is used, how far its price is below the best, a lower bound of any solution, and what each length is covered by."""

    used: dict[Pattern, float]
    gap: dict[Pattern, float]
    bound: float
    cover: np.ndarray

    @property
    def excess(self) -> float:
        """The share by which the solution is above the lower bound."""
        return sum(self.used.values()) / self.bound - 1 if self.bound else 0.0


def configuration_program(need: np.ndarray, capacity: int, rounds: int = 16, step: float = 0.34, rate: float = 0.25, tolerance: float = 0.02) -> Program:
    """Cover need[l] items of each length l by as few sequences as can be.

    A round covers at most the share ``step`` of a length's need, so that no length is covered far ahead of the others. Every length
    starts configurations of its own; the rest of the room goes to lengths with need left in this round, by their weight and by
    the value of the room that they leave. After ``rounds`` rounds, or one that adds nothing, the tolerance doubles; at 1 every
    configuration will do, so all is covered a few rounds later.
    """
    some, size = need > 0, np.arange(capacity + 1) / capacity
    cover, bound = np.zeros(capacity + 1), 0.0
    used: dict[Pattern, float] = defaultdict(float)
    gap: dict[Pattern, float] = {}
    done = 0
    while (need - cover > 1e-9 * np.maximum(need, 1)).any():
        share = np.where(some, cover / np.maximum(need, 1), 0)
        weights = np.where(some, size * np.exp(-rate * share), 0)
        value = knapsack(weights, capacity)
        best = value[capacity]
        if best > 0:
            bound = max(bound, float((need * weights).sum() / best))
        left = np.where(some, np.minimum(step * need, need - cover), 0)
        least = 1e-9 * np.maximum(need, 1)
        alive, before = np.flatnonzero(left > least)[::-1], sum(used.values())
        for length in alive.tolist():
            while left[length] > least[length]:
                held: dict[int, int] = defaultdict(int)
                held[length], room = 1, capacity - length
                alive = alive[left[alive] > least[alive]]
                while len(fit := alive[np.searchsorted(-alive, -room) :]):
                    take = int(fit[np.argmax(weights[fit] + value[room - fit])])
                    held[take] += 1
                    room -= take
                below = 1 - sum(weights[k] * n for k, n in held.items()) / best
                if below > tolerance:
                    break
                config = tuple(sorted(held.items(), reverse=True))
                amount = min(left[k] / n for k, n in config)
                used[config] += amount
                gap[config] = min(below, gap.get(config, below))
                for k, n in config:
                    left[k] -= amount * n
                    cover[k] += amount * n
        done += 1
        if done >= rounds or sum(used.values()) <= before:
            tolerance = min(1.0, 2 * tolerance)
    return Program(used, gap, bound, cover)


def rounded(program: Program, left: np.ndarray, most: float) -> list[tuple[Pattern, int]]:
    """Whole uses of the configurations, best priced first, as far as items are left and until ``most`` sequences are placed; ``left`` is lowered by them."""
    plan, carried, placed = [], 0.0, 0
    for config, amount in sorted(program.used.items(), key=lambda x: (round(program.gap[x[0]], 4), -x[1], x[0])):
        if placed >= most:
            break
        carried = min(carried + amount, amount + 1)
        times = min([int(carried + 1e-9), *(int(left[length]) // n for length, n in config)])
        if times > 0:
            carried -= times
            placed += times
            plan.append((config, times))
            for length, n in config:
                left[length] -= n * times
    return plan


class Plan(NamedTuple):
    """Configurations and how often each is used, together holding every item once; how many sequences the program placed; the lower bound."""

    configs: list[tuple[Pattern, int]]
    placed: int
    bound: int


def solve(counts: dict[int, int], capacity: int) -> Plan:
    """Work and memory depend on the capacity, not on the counts.

    The program places all that it can first, then less of it, down to somewhat more than half of the bound, until the plan meets the
    bound; else the best of these plans is taken. Best fit places the rest.
    """
    need = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        need[length] = n
    full = [(((capacity, 1),), int(need[capacity]))] if need[capacity] else []
    need[capacity] = 0
    program = configuration_program(need.astype(float), capacity)
    least = math.ceil(program.bound - 1e-6)
    best: tuple[int, list[tuple[Pattern, int]], int] | None = None
    for share in (1.0, 0.8, 0.65, 0.55):
        left = need.copy()
        plan = rounded(program, left, share * program.bound)
        placed = sum(times for _, times in plan)
        plan += best_fit_decreasing(left, capacity)
        total = sum(times for _, times in plan)
        if best is None or total < best[0]:
            best = (total, plan, placed)
        if total <= least:
            break
    more = sum(times for _, times in full)
    return Plan(full + best[1], best[2] + more, least + more)


def best_fit_decreasing(left: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit decreasing for counts: open sequences of equal content are one group, so the cost follows the distinct lengths."""
    open_by_room: list[dict[Pattern, int]] = [defaultdict(int) for _ in range(capacity + 1)]
    rooms: set[int] = set()
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            room = min((r for r in rooms if r >= length), default=0)
            if not room:
                each = min(capacity // length, n)
                times = n // each
                content: Pattern = ((length, each),)
                open_by_room[capacity - each * length][content] += times
                rooms.add(capacity - each * length)
                n -= times * each
                continue
            content, times = next(iter(open_by_room[room].items()))
            each = min(room // length, n)
            took = min(times, n // each)
            if took == times:
                del open_by_room[room][content]
                if not open_by_room[room]:
                    rooms.discard(room)
            else:
                open_by_room[room][content] = times - took
            open_by_room[room - each * length][(*content, (length, each))] += took
            rooms.add(room - each * length)
            n -= took * each
    return [(content, times) for held in open_by_room for content, times in held.items()]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, bucket_rows: int = 50_000) -> DataFrame:
    """Place every piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces are numbered within their length through buckets of about ``bucket_rows`` pieces, so that a length on a third of
    all rows is spread; only counts by (length, bucket) meet in one task.
    """
    small_batches(docs.sparkSession)
    cut = materialize(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    buckets = max(1, -(-cut.count() // bucket_rows))
    cut = cut.withColumn("_lm_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = materialize(cut.groupBy("length", "_lm_b").count(), "piece-counts")
    plan = solve({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}, capacity).configs

    by_length: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    reach: dict[int, int] = defaultdict(int)
    first = 0
    for config, times in plan:
        offset = 0
        for length, n in config:
            by_length[length].append((reach[length], times, first, offset))
            reach[length] += n * times
            offset += n * length
        first += times
    flat = [(length, *x) for length in sorted(by_length) for x in by_length[length]]
    table = np.array(flat, np.int64).reshape(-1, 5)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0].astype(object) * (1 << 48) + table[:, 1]
        keys = keys.astype(np.int64)
        for batch in batches:
            length, index = batch.column("length").to_numpy(), batch.column("_lm_i").to_numpy()
            row = table[np.searchsorted(keys, length * (1 << 48) + index, "right") - 1]
            within = index - row[:, 1]
            copy, instance = np.divmod(within, row[:, 2]) if len(row) else (within, within)
            kept = [batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(row[:, 3] + instance, pa.int64()), pa.array(row[:, 4] + copy * length, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    before = counts.selectExpr("length as _lm_l", "_lm_b as _lm_c", "coalesce(sum(count) over (partition by length order by _lm_b rows between unbounded preceding and 1 preceding), 0) as _lm_o")
    numbered = cut.selectExpr("*", "row_number() over (partition by length, _lm_b order by doc_id, piece, start, ids_crc32) - 1 as _lm_r")
    indexed = numbered.join(before, (F.col("length") == F.col("_lm_l")) & (F.col("_lm_b") == F.col("_lm_c"))).withColumn("_lm_i", (F.col("_lm_o") + F.col("_lm_r")).cast("long"))
    return indexed.select("doc_id", "piece", "start", "length", "ids_crc32", "_lm_i").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
