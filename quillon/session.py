"""Settings and the shared folder."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: With this, the shuffle files of a write go as it ends; without, when the driver happens to collect its garbage, however many there are by then.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Of the innermost ``temporary``: the paths of what has been written in it, by the folder's name.
_written: ContextVar[dict[str, str] | None] = ContextVar("written", default=None)


def session(name: str = "quillon", **conf: str) -> SparkSession:
    """A session with the settings that the engine expects: UTC times and adaptive execution."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return SparkSession.builder.appName(name).config(map=base | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a new one, if all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here, and lost executors lose nothing."""
    spark, folder = df.sparkSession, f"{name}-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{folder}"
    if (own := _written.get()) is not None:
        own[folder] = path
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is materialized inside is deleted at the end, but for the tables that a DataFrame reads which is given to the function this yields.

    Those last as long as what is around: the next ``temporary`` further out, if there is one.
    """
    outer, own = _written.get(), {}

    def keep(df: DataFrame) -> DataFrame:
        for folder in {file.rsplit("/", 2)[-2] for file in df.inputFiles()} & own.keys():
            path = own.pop(folder)
            if outer is not None:
                outer[folder] = path
        return df

    token = _written.set(own)
    try:
        yield keep
    finally:
        _written.reset(token)
        for path in own.values():
            _delete(spark, path)


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` has written and nothing will read any more, where a ``temporary`` is around; elsewhere it stays."""
    own = _written.get()
    for folder in {file.rsplit("/", 2)[-2] for file in df.inputFiles()} & (own or {}).keys():
        _delete(df.sparkSession, own.pop(folder))


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most so many rows, which is checked; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def settings(flags: dict[str, Any], path: str | None = None, defaults: dict[str, Any] | None = None) -> dict[str, Any]:
    """Settings by precedence: a flag that is set, then the JSON file (ignored if it is not there or not valid), then the default."""
    stored: dict[str, Any] = {}
    if path and os.path.exists(path):
        try:
            with open(path, encoding="utf-8") as f:
                found = json.load(f)
            stored = found if isinstance(found, dict) else {}
        except (OSError, ValueError):
            stored = {}
    return (defaults or {}) | stored | {k: v for k, v in flags.items() if v is not None}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that their Python finds it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_quillon_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quillon-"), "quillon.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.join("quillon", os.path.relpath(full, here)))
    context.addPyFile(path)
    context._quillon_shipped = True
