"""A streaming source that tails the logs of a folder by byte offsets.

The built-in file source reads each file once; a log that grows needs offsets within the file. The offset is {file: bytes read}. On the
first start only what comes after the end of the files is read; files that appear later are read from their beginning. Only whole
lines are taken, so one that is half-written waits for its end. The driver looks at sizes and at the last line end alone; a task
reads each range of up to ``RANGE`` bytes, so the folder must be one that executors see.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from quillon.sources.logs import GLOB

#: Bytes of a file that one task reads; lines that begin in its range are its own.
RANGE = 32 << 20


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, last: int):
        self.path, self.start, self.end, self.last = path, start, end, last


def last_line_end(path: str, start: int, step: int = 1 << 16) -> int:
    """Where the last whole line after ``start`` ends; ``start`` if there is none. The file is read backwards, a step at a time."""
    end = at = os.path.getsize(path)
    with open(path, "rb") as f:
        while at > start:
            at = max(start, at - step)
            f.seek(at)
            found = f.read(min(step, end - at)).rfind(b"\n")
            if found >= 0:
                return at + found + 1
    return start


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.backlog = options["path"], options.get("startingoffsets", options.get("startingOffsets", "latest")) == "earliest"
        self.at: dict | None = None

    def files(self) -> list[str]:
        return sorted(glob.glob(os.path.join(self.folder, GLOB)), key=lambda p: (os.path.getmtime(p), p))

    def initialOffset(self) -> dict:  # noqa: N802
        self.at = {os.path.basename(p): 0 if self.backlog else os.path.getsize(p) for p in self.files()}
        return self.at

    def latestOffset(self) -> dict:  # noqa: N802
        known = self.at or {}
        self.at = known | {os.path.basename(p): last_line_end(p, known.get(os.path.basename(p), 0)) for p in self.files()}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for name, to in end.items():
            first = int(start.get(name, 0))
            out += [Range(os.path.join(self.folder, name), a, min(a + RANGE, int(to)), int(to)) for a in range(first, int(to), RANGE)]
        # what a stream begins with is not always read through this object
        self.at = {**(self.at or {}), **end}
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        """The lines that begin within the range; the first range of a batch begins with one."""
        with open(partition.path, "rb") as f:
            at = partition.start
            f.seek(max(at - 1, 0))
            if at and f.read(1) != b"\n":
                at += len(f.readline())  # the line belongs to the range before
            while at < partition.end:
                line = f.readline(partition.last - at)
                yield os.path.basename(partition.path), at, line.decode("utf-8", errors="replace").rstrip("\r\n")
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """``spark.readStream.format("tail").load(folder)`` after ``spark.dataSource.register(TailSource)``: columns file, position (of the line, in bytes), value."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "file string, position bigint, value string"

    def streamReader(self, schema: StructType) -> TailReader:  # noqa: N802
        return TailReader(self.options)


