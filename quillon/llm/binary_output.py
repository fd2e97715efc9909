"""Token-id output: concatenated ids with Elias-Fano document boundaries.

File format: a folder of Parquet part files whose rows are self-contained blocks, in ascending document order. A block holds
the ids of whole documents back to back (unsigned 16- or 32-bit little-endian) and the documents' end offsets as an
Elias-Fano sequence: each offset's low bits packed at a fixed width, its high bits as unary gaps in a bit vector, and the
position of every 64th set bit so that ``select`` starts near its answer. That is about 2 + log2(ids/documents) bits a
document and no 64-bit offset table. The documents' ids ascend, and are such a sequence too, above the block's first. The only
64-bit numbers are two bases a block. Readers take offsets and ids by ``select``. Spark's committer writes the files, so a
lost executor costs a task, and any store Spark can write will do.

Empty text gives the end id alone, and so does null text. Null doc_ids come first. Repeated rows are separate documents, in
the order of doc_id, then text. Other columns of the input are not read.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import partitions, shared_dir
from quillon.llm.tokens import encoder

SAMPLE = 64
BLOCK_SCHEMA = "part int, block int, part_base long, n_ids long, n_docs int, n_null int, id_base long, id_bits int, id_low binary, id_high binary, id_samples binary, width int, ids binary, low_bits int, low binary, high binary, samples binary"
#: A block's document ids lie within this of its first.
ID_RANGE = 1 << 62


class EliasFano:
    """A non-decreasing sequence of numbers up to ``universe``; ``select(i)`` returns the i-th."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> "EliasFano":
        n = len(values)
        low_bits = max(0, int(math.floor(math.log2(universe / n)))) if n and universe > n else 0
        low = ((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8).ravel() if low_bits else np.zeros(0, np.uint8)
        ones = (values >> low_bits) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, low_bits, np.packbits(low, bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """The i-th number: from the nearest sampled set bit on, whole bytes are skipped by their counts of set bits."""
        start = int.from_bytes(self.samples[4 * (i // SAMPLE) : 4 * (i // SAMPLE) + 4], "little")
        left, byte = i % SAMPLE, start // 8
        word = self.high[byte] & (0xFF << (start % 8))
        while left >= (ones := word.bit_count()):
            left -= ones
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        high = byte * 8 + (word & -word).bit_length() - 1 - i
        bit = i * self.low_bits
        low = int.from_bytes(self.low[bit // 8 : (bit + self.low_bits + 7) // 8], "little") >> (bit % 8)
        return high << self.low_bits | low & ((1 << self.low_bits) - 1)

    def all(self) -> np.ndarray:
        """Every number of the sequence at once."""
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)) << self.low_bits
        if not self.low_bits:
            return high
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return high + bits @ (1 << np.arange(self.low_bits, dtype=np.int64))


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, block_ids: int = 500_000) -> None:
    """Encode every whole text, append ``end_id``, and write blocks of about ``block_ids`` ids in ascending doc_id order.

    The texts are range-partitioned by (doc_id, a hash of the text), so even one id on a third of all rows spreads.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, base = TaskContext.get().partitionId(), 0, 0
        own, end = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        ids, chunks, size, low = [], [], 0, None

        def block() -> pa.RecordBatch:
            ends = np.cumsum([len(c) // 4 for c in chunks])
            joined = np.frombuffer(b"".join(chunks), "<u4")
            width = 2 if not len(joined) or joined.max() < 1 << 16 else 4
            ef = EliasFano.encode(ends, int(ends[-1]))
            known = [i for i in ids if i is not None]
            first = known[0] if known else 0
            near = np.array([i - first for i in known], np.int64)
            own_ids = EliasFano.encode(near, int(near[-1]) if known else 0)
            row = {"part": part, "block": number, "part_base": base, "n_ids": size, "n_docs": len(ids), "n_null": len(ids) - len(known), "id_base": first, "id_bits": own_ids.low_bits, "id_low": own_ids.low, "id_high": own_ids.high, "id_samples": own_ids.samples, "width": width, "ids": joined.astype(f"<u{width}").tobytes(), "low_bits": ef.low_bits, "low": ef.low, "high": ef.high, "samples": ef.samples}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in BLOCK_SCHEMA.split(", "))])
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if low is not None and doc_id - low >= ID_RANGE:  # known ids come after the nulls
                    yield block()
                    base, number, ids, chunks, size, low = base + size, number + 1, [], [], 0, None
                low = doc_id if low is None else low
                chunks.append(own.ids(text.as_py()) + end)
                ids.append(doc_id)
                size += len(chunks[-1]) // 4
                if size >= block_ids:
                    yield block()
                    base, number, ids, chunks, size, low = base + size, number + 1, [], [], 0, None
        if ids:
            yield block()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    dealt.mapInArrow(blocks, BLOCK_SCHEMA).write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and ids (binary).

    The bases of the parts are a running sum over one row a written partition.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    bases = parts.selectExpr("part", "coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0) as base")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, nulls = row["n_docs"], row["n_null"]
                bounds = EliasFano(n, row["low_bits"], row["low"], row["high"], row["samples"])
                own_ids = EliasFano(n - nulls, row["id_bits"], row["id_low"], row["id_high"], row["id_samples"])
                ends = np.array([bounds.select(i) for i in range(n)], np.int64)
                doc_ids = [None] * nulls + [row["id_base"] + own_ids.select(i) for i in range(n - nulls)]
                starts = np.concatenate([[0], ends[:-1]])
                joined = memoryview(np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4").tobytes())
                crc = [zlib.crc32(joined[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts + row["base"], pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    framed = blocks.join(F.broadcast(bases), "part").select("n_docs", "n_null", "id_base", "id_bits", "id_low", "id_high", "id_samples", "width", "ids", "low_bits", "low", "high", "samples", (F.col("base") + F.col("part_base")).alias("base"))
    return framed.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = 1) -> DataFrame:
    """Write the files (into the shared folder unless ``path`` is given), read them back, and return a row a document."""
    path = path or f"{shared_dir(docs.sparkSession).rstrip('/')}/token-ids-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer_path, end_id)
    return read_documents(docs.sparkSession, path)
