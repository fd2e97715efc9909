"""Benchmark decontamination by pigeonhole edit matching.

A document is contaminated by a benchmark item if some stretch of it is within the item's error budget of edits. The item is split
into one piece more than the budget, so an occurrence with that many edits leaves a piece untouched: an Aho-Corasick automaton
finds exact piece hits, and each hit's surroundings are verified by Myers' bit-parallel edit distance. Both sides are compared in
lower case with runs of white space as one space. The budget is a ``piece_chars``-th of the item's length, less one (none for
items shorter than two pieces), so pieces have at least ``piece_chars`` characters, but for items shorter than that.

The benchmark goes to the executors in blocks of at most ``block_chars`` characters, ``blocks_a_plan`` of them at a time; a larger
benchmark makes more passes, whose hits are written to the shared folder, so that neither driver nor worker holds it whole. Null or blank items match nothing; null and empty texts hold nothing. Repeated items count each by its item_id; a null item_id
shows as null in the list. An empty benchmark leaves all clean. Columns of the input are carried on.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize, small_batches

Item = tuple[int | None, str, int]  # item_id, text, error budget


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(length: int, budget: int) -> list[tuple[int, int]]:
    cuts = [length * k // (budget + 1) for k in range(budget + 2)]
    return list(zip(cuts, cuts[1:], strict=False))


def distance_within(masks: dict[str, int], m: int, text: str) -> int:
    """Least edit distance between a pattern of m characters and any stretch of ``text`` (Myers, 1999), on integers of m bits."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for ch in text:
        eq = masks.get(ch, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        rise, fall = down | (full & ~(diagonal | up)), up & diagonal
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
            if score < best:
                best = score
        rise, fall = (rise << 1) & full, (fall << 1) & full
        vertical = eq | down
        up, down = fall | (full & ~(vertical | rise)), rise & vertical
    return best


def masks_of(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for k, ch in enumerate(text):
        out[ch] = out.get(ch, 0) | 1 << k
    return out


class Matcher:
    """Finds a block's items in texts; made once a process for each block."""

    def __init__(self, items: list[Item]):
        import ahocorasick

        self.items, self.masks = items, [None] * len(items)
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, budget) in enumerate(items):
            for a, b in pieces(len(text), budget):
                places.setdefault(text[a:b], []).append((k, b))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, where)
        self.automaton.make_automaton()

    def find(self, raw: str | None) -> dict[int, int]:
        """Item number -> least distance found, for the items within their budgets.

        Around every start that a piece points to lies the window that an item within its budget would fill; windows of an item that
        overlap are one, in which the distance is worked out once. So a text that repeats itself costs each item one pass at most.
        """
        text, found, starts = normal(raw), {}, {}
        for last, where in self.automaton.iter(text):
            for k, end in where:
                start = last + 1 - end  # of the whole item, if there were no edit before the piece
                if found.get(k) == 0:
                    continue
                if start >= 0 and text.startswith(self.items[k][1], start):
                    found[k] = 0
                    starts.pop(k, None)
                elif self.items[k][2]:
                    starts.setdefault(k, set()).add(start)
        for k, own in starts.items():
            _, item, budget = self.items[k]
            if self.masks[k] is None:
                self.masks[k] = masks_of(item)
            for low, high in windows(own, len(item), budget):
                d = distance_within(self.masks[k], len(item), text[low:high])
                if d <= budget:
                    found[k] = min(d, found.get(k, d))
        return found


def windows(starts: set[int], length: int, budget: int) -> list[tuple[int, int]]:
    """Where an item that begins near one of the starts can lie, overlapping windows joined."""
    out: list[tuple[int, int]] = []
    for start in sorted(starts):
        low, high = max(0, start - budget), start + length + budget
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


#: The matchers of the plan at work, by block; another plan's are dropped, so a worker never keeps more than one plan's.
_matchers: dict[str, Matcher] = {}
_plan: list[str] = []


def matcher(plan: str, name: str, block: list[Item]) -> Matcher:
    if _plan != [plan]:
        _matchers.clear()
        _plan[:] = [plan]
    if name not in _matchers:
        _matchers[name] = Matcher(block)
    return _matchers[name]


def blocks(benchmark: DataFrame, piece_chars: int, block_chars: int) -> Iterator[list[Item]]:
    """The items, a bounded block at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        if text := normal(row[1]):
            block.append((row[0], text, max(0, len(text) // piece_chars - 1)))
            size += len(text)
            if size >= block_chars:
                yield block
                block, size = [], 0
    if block:
        yield block


def matches(text: Column, block: list[Item], plan: str, name: str) -> Column:
    """An array of structs (item_id, distance) for one block of items."""

    @F.pandas_udf("array<struct<item_id: bigint, distance: int>>")
    def found(texts):  # noqa: ANN001, ANN202
        own = matcher(plan, name, block)
        return texts.map(lambda t: [{"item_id": block[k][0], "distance": d} for k, d in own.find(t).items()])

    return found(text)


def contamination(docs: DataFrame, benchmark: DataFrame, piece_chars: int = 16, block_chars: int = 4_000_000, blocks_a_plan: int = 2) -> DataFrame:
    """``docs`` with contaminated (boolean), item_ids (sorted) and distance (least number of edits; null if clean)."""
    small_batches(docs.sparkSession)
    none = F.expr("cast(array() as array<struct<item_id: bigint, distance: int>>)")
    out, plan, columns = docs.withColumn("_lm_hits", none), uuid.uuid4().hex, []
    for k, block in enumerate(blocks(benchmark, piece_chars, block_chars)):
        if len(columns) == blocks_a_plan:  # what these blocks found is written down, and they are let go
            out = materialize(out.withColumn("_lm_hits", F.concat("_lm_hits", *columns)).drop(*columns), "benchmark-hits")
            plan, columns = uuid.uuid4().hex, []
        columns.append(f"_lm_hits_{k}")
        out = out.withColumn(columns[-1], matches(F.col("text"), block, plan, columns[-1]))
    out = out.withColumn("_lm_hits", F.concat("_lm_hits", *columns)).drop(*columns)
    added = {"contaminated": F.size("_lm_hits") > 0, "item_ids": F.sort_array(F.col("_lm_hits.item_id")), "distance": F.array_min(F.col("_lm_hits.distance"))}
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added], *[v.alias(k) for k, v in added.items()])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones, all columns as they were."""
    own = [f"_lm_{k}" for k in range(len(docs.columns))]
    renamed = docs.select(*[F.col(f"`{c}`").alias("text" if c == "text" else n) for c, n in zip(docs.columns, own, strict=True)])
    marked = contamination(renamed, benchmark).where("not contaminated")
    return marked.select(*[F.col("text" if c == "text" else n).alias(c) for c, n in zip(docs.columns, own, strict=True)])
