"""A JSON array document read by many tasks, however few lines it has.

Spark's text reader splits a file by bytes at any separator, so the document is read in fragments that end in a closing brace; each
block of the file is read by one task. What a character means depends on whether it stands in a string, and how deep; a block does not
know that of its start. So a first pass gives each block's effect: whether it holds an odd number of quotes, and, for either
start, how far it goes up or down and how many commas it has at each depth. Running sums over the blocks of a file, a small table, turn the
effects into every block's state at its start. With that a second pass cuts the blocks into elements; what is left at the ends
of blocks is put together by the number of the element. It works wherever Spark can read; a compressed file is one block.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import materialize

ESCAPE = re.compile(rb"\\.", re.DOTALL)
CHUNK = 1 << 20
#: Blocks whose states are broadcast at most, 30 bytes each or so.
MOST_BLOCKS = 1_000_000
EFFECT = "file string, block long, odd boolean, first string, up0 long, up1 long, commas0 map<int,long>, commas1 map<int,long>"


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], bytes, int]]:
    """Text of neighbouring fragments of a block, in pieces of about ``CHUNK`` bytes, with the place of its first row."""
    files, blocks, values = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()
    at = 0
    while at < len(values):
        end, size, own = at, 0, (files[at], blocks[at])
        while end < len(values) and size < CHUNK and (files[end], blocks[end]) == own:
            size += len(values[end]) + 1
            end += 1
        yield own, b"}".join(values[at:end]) + b"}", at
        at = end


class Marks:
    """Structure of a piece of JSON, for a start outside of strings and for one inside: characters that count, and the depth after each."""

    def __init__(self, data: bytes):
        self.bytes = np.frombuffer(ESCAPE.sub(b"__", data) if b"\\" in data else data, np.uint8)
        self.quoted = np.cumsum(self.bytes == ord('"'), dtype=np.int32) & 1
        self.odd = bool(self.quoted[-1])
        self.opens = (self.bytes == ord("{")) | (self.bytes == ord("["))
        self.closes = (self.bytes == ord("}")) | (self.bytes == ord("]"))
        self.comma = self.bytes == ord(",")

    def depth(self, inside: bool) -> tuple[np.ndarray, np.ndarray]:
        """(whether a character stands outside of strings, depth after it, from 0 at the start)"""
        outside = self.quoted == inside
        return outside, np.cumsum((self.opens & outside).astype(np.int8) - (self.closes & outside), dtype=np.int32)


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a block. Characters before the first that is no white space are none, so ``first`` tells an array from another document."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("odd", pa.bool_()), ("first", pa.string()), ("up0", pa.int64()), ("up1", pa.int64()), ("commas0", pa.map_(pa.int32(), pa.int64())), ("commas1", pa.map_(pa.int32(), pa.int64()))])
    own, odd, first, ups, commas = None, False, "", [0, 0], [Counter(), Counter()]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([*own, odd, first, *ups, *(list(c.items()) for c in commas)], schema, strict=True)], schema=schema)

    for batch in batches:
        for key, data, _ in _chunks(batch):
            if key != own:
                if own:
                    yield row()
                own, odd, first, ups, commas = key, False, "", [0, 0], [Counter(), Counter()]
            first = first or data.lstrip()[:1].decode("utf-8", "replace")
            marks = Marks(data)
            for start in (0, 1):  # in a string at the block's start, or not
                outside, depth = marks.depth(odd != bool(start))
                levels, many = np.unique(depth[marks.comma & outside], return_counts=True)
                commas[start].update({int(d) + ups[start]: int(n) for d, n in zip(levels, many, strict=True)})
                ups[start] += int(depth[-1])
            odd ^= marks.odd
    if own:
        yield row()


def block_states(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, inside, depth, element): each block's state at its start, and how many elements end before it. Written down.

    A file that is no array, or is cut off, is an error.
    """
    effects = materialize(_fragments(spark, path).mapInArrow(_effects, EFFECT), "blocks")
    before = "over (partition by file order by block rows between unbounded preceding and 1 preceding)"
    known = effects.selectExpr("*", f"coalesce(sum(cast(odd as int)) {before}, 0) % 2 = 1 as inside")
    known = known.selectExpr("*", "if(inside, up1, up0) as up", "if(inside, commas1, commas0) as commas", f"coalesce(sum(if(inside, up1, up0)) {before}, 0) as depth")
    known = known.selectExpr("*", "coalesce(try_element_at(commas, cast(1 - depth as int)), 0) as ended")
    states = known.selectExpr("*", f"coalesce(sum(ended) {before}, 0) as element")
    # behind the last bracket stands the brace that the reader takes every fragment to end in
    wrong = states.groupBy("file").agg(F.min_by("first", "block").alias("first"), F.sum("up").alias("end"), F.sum(F.col("odd").cast("int")).alias("quotes"))
    if bad := wrong.where("first <> '[' or end <> -1 or quotes % 2 = 1").first():
        raise ValueError(f"an array document is cut off or no JSON array: {bad['file']}")
    return materialize(states.select("file", "block", "inside", F.col("depth").cast("int").alias("depth"), "element"), "states")


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, element, block, cut, text) of whole elements, and of pieces (cut) at a block's ends."""
    own, inside, depth, element, cut, rest = None, False, 0, 0, True, []
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=["file", "element", "block", "cut", "text"])

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    for batch in batches:
        states = batch.select(["inside", "depth", "element"])
        for key, data, at in _chunks(batch):
            if key != own:
                if own and (piece := b"".join(rest)):
                    out.append((own[0], element, own[1], True, piece.decode()))
                own, (inside, depth, element), cut, rest = key, (states.column(k)[at].as_py() for k in range(3)), True, []
            marks = Marks(data)
            outside, levels = marks.depth(inside)
            levels = levels + depth
            ends = marks.comma & outside & (levels == 1)
            close = marks.closes & outside & (levels == 0)  # the array's end
            start = marks.opens & outside & (levels == 1)
            begin = 0
            for place in np.flatnonzero(ends | close | (start & (marks.bytes == ord("[")))).tolist():
                if start[place]:  # nothing of the array stands before its bracket
                    begin, cut, rest = place + 1, False, []
                    continue
                rest.append(data[begin:place])
                if (text := b"".join(rest)).strip() or cut:
                    out.append((own[0], element, own[1], cut, text.decode()))
                begin, rest, cut = place + 1, [], False
                element += bool(ends[place])
                if close[place]:
                    begin = len(data)
            if levels[-1] > 0 or inside != marks.odd:
                rest.append(data[begin:])
            inside, depth = inside != marks.odd, int(levels[-1])
        if out:
            yield flush()
    if own and (piece := b"".join(rest)):
        out.append((own[0], element, own[1], True, piece.decode()))
    if out:
        yield flush()


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """One JSON text an element of the arrays in the files of ``path``, in column ``system``."""
    states = block_states(spark, path)
    if states.limit(MOST_BLOCKS + 1).count() > MOST_BLOCKS:
        raise ValueError(f"more than {MOST_BLOCKS} blocks; read with larger spark.sql.files.maxPartitionBytes")
    known = _fragments(spark, path).join(F.broadcast(states), ["file", "block"])  # keeps the order of the fragments
    found = materialize(known.select("file", "block", "value", "inside", "depth", "element").mapInArrow(_elements, "file string, element long, block long, cut boolean, text string"), "elements")
    joined = found.where("cut").groupBy("file", "element").agg(F.sort_array(F.collect_list(F.struct("block", "text"))).alias("pieces"))  # two a block at most
    whole = joined.select(F.concat_ws("", F.col("pieces.text")).alias("system"))
    return found.where("not cut").select(F.col("text").alias("system")).union(whole).select(F.expr(r"trim(both ' \t\r\n' from system)").alias("system")).where("system <> ''")
