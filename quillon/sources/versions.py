"""A table of Parquet files in versions: an upsert or a scoped replacement rewrites only the files that it meets.

A version is a manifest that names its files, each with the least key in it. The keys from one file's least to the next one's are that
file's; so a new key belongs to one file, and files without new keys stay as they are. A change writes new files first, then a new
manifest beside the old ones, moved to its number in one step that fails if the number is taken. Whatever is lost before that leaves
the old version; readers of an older version keep its files. The driver holds a line a file. Manifests and files are reached
through Spark and Hadoop alone, so any store will do whose renames do not replace.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.session import broadcast_if_small, materialize
from quillon.sources import dump

KEYS = (T.StringType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DoubleType, T.BooleanType)


def _place(values) -> tuple:  # noqa: ANN001
    """Values in Spark's order: nulls first."""
    return tuple((v is not None, v if v is not None else 0) for v in values)


class VersionedTable:
    """path: the table's folder. key: its columns of key, strings, whole numbers, doubles or booleans; rows_per_file: about so many."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], rows_per_file: int = 1_000_000):
        self.spark, self.path, self.key, self.rows_per_file = spark, path.rstrip("/"), key, rows_per_file
        self.jvm = spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()

    # -- versions

    def version(self) -> int:
        """The newest version; 0 before the first."""
        folder = self.jvm.Path(f"{self.path}/_versions")
        fs = folder.getFileSystem(self.conf)
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"schema": None, "files": []}
        return json.loads(self.spark.read.text(f"{self.path}/_versions/{version:010d}.json", wholetext=True).first()[0])

    def files(self, version: int | None = None) -> list[str]:
        return [f["file"] for f in self.manifest(version)["files"]]

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.manifest(version))

    def _read(self, manifest: dict, some: set[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        names = [f"{self.path}/{f['file']}" for k, f in enumerate(manifest["files"]) if some is None or k in some]
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)

    def _commit(self, base: int, schema: T.StructType, files: list[dict]) -> int:
        """Make the files the next version after ``base``; an error if someone else has made it."""
        files = sorted(files, key=lambda f: _place(f["low"]))
        done, held = self.jvm.Path(f"{self.path}/_versions/{base + 1:010d}.json"), self.jvm.Path(f"{self.path}/_versions/.{uuid.uuid4().hex}")
        out = held.getFileSystem(self.conf).create(held, False)
        out.write(bytearray(json.dumps({"schema": schema.jsonValue(), "files": files}).encode()))
        out.close()
        kinds = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self.jvm.FileContext.getFileContext(done.toUri(), self.conf).rename(held, done, kinds)
        return base + 1

    # -- changes

    def _slot(self, manifest: dict) -> Column:
        """The number of the file that a key belongs to."""
        lows = [_place(f["low"]) for f in manifest["files"]][1:]

        @F.pandas_udf(T.IntegerType())
        def slot(keys: pd.DataFrame) -> pd.Series:
            none = keys.isna().to_numpy()
            rows = zip(*[keys[c].tolist() for c in keys.columns], strict=True)
            return pd.Series([bisect_right(lows, tuple((not n, 0 if n else v) for v, n in zip(row, nulls, strict=True))) for row, nulls in zip(rows, none, strict=True)], dtype="int32")

        return slot(F.struct(*self.key)) if lows else F.lit(0)

    def _write(self, df: DataFrame, slot: Column, rows: int) -> list[dict]:
        """Write rows sorted by key, none of the files across two slots; a line a new file."""
        if bad := [c for c in self.key if not isinstance(df.schema[c].dataType, KEYS)]:
            raise ValueError(f"no keys of this type: {', '.join(bad)}")
        name = f"data/{uuid.uuid4().hex}"
        dealt = df.withColumn("_slot", slot).repartitionByRange(max(1, -(-rows // self.rows_per_file)), "_slot", *self.key).sortWithinPartitions("_slot", *self.key)
        dealt.write.partitionBy("_slot").parquet(f"{self.path}/{name}")
        written = self.spark.read.schema(df.schema).option("recursiveFileLookup", True).parquet(f"{self.path}/{name}")
        lines = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(F.struct(*self.key)).alias("low"), F.count("*").alias("rows")).collect()
        return [{"file": name + r["file"].split(name, 1)[1], "low": list(r["low"]), "rows": r["rows"]} for r in lines]

    def overwrite(self, df: DataFrame) -> int:
        """The rows as the next version, whatever was there before. Keys are taken to be there once."""
        base, df = self.version(), materialize(df, "rows")
        return self._commit(base, df.schema, self._write(df, F.lit(0), df.count()))

    def _rewrite(self, base: int, manifest: dict, new: DataFrame, touched: set[int], change) -> int:  # noqa: ANN001
        slot = self._slot(manifest)
        touched = touched | {r["_slot"] for r in new.select(slot.alias("_slot")).distinct().collect()}  # a number a file
        old = self._read(manifest, touched)
        rows = sum(manifest["files"][k]["rows"] for k in touched if k < len(manifest["files"])) + new.count()
        fresh = self._write(materialize(change(old, new), "merged"), slot, rows) if touched else []
        return self._commit(base, T.StructType.fromJson(manifest["schema"]), [f for k, f in enumerate(manifest["files"]) if k not in touched] + fresh)

    def upsert(self, new: DataFrame, order: str, columns: list[str] | None = None) -> int:
        """New rows in place of those of the same key, of several the last by ``order``; with ``columns`` only those are taken over.

        Null keys are equal to none, as in SQL: such rows are added. The new version's number.
        """
        base = self.version()
        manifest = self.manifest(base)
        names = [f["name"] for f in manifest["schema"]["fields"]]
        last = new.groupBy(*self.key).agg(F.max_by(F.struct(*[c for c in new.columns if c not in self.key]), order).alias("_new"))
        last = materialize(last.select(*self.key, "_new.*").select(*[c for c in names if c in new.columns]), "new")
        change = (lambda old, rows: dump.update_columns(old, rows, self.key, columns).select(*names)) if columns else self._put
        return self._rewrite(base, manifest, last, set(), change)

    def _put(self, old: DataFrame, rows: DataFrame) -> DataFrame:
        return old.join(rows.select(*self.key), self.key, "left_anti").unionByName(rows, allowMissingColumns=True).select(*old.columns)

    def replace(self, new: DataFrame, scopes: DataFrame) -> int:
        """All rows of the scopes (rows of some columns) go, also of scopes that ``new`` has nothing for; the new rows, which must be in
        the scopes, come. Both in one version."""
        base = self.version()
        manifest = self.manifest(base)
        names = [f["name"] for f in manifest["schema"]["fields"]]
        scopes, new = broadcast_if_small(materialize(scopes.distinct(), "scopes")), materialize(new.select(*names), "new")
        if not new.join(scopes, scopes.columns, "left_anti").isEmpty():
            raise ValueError("rows outside of the scopes")
        held = self._read(manifest).withColumn("_file", F.col("_metadata.file_path")).join(scopes, scopes.columns, "left_semi").select("_file").distinct().collect()
        own = {"data/" + r["_file"].rsplit("/data/", 1)[1] for r in held}
        touched = {k for k, f in enumerate(manifest["files"]) if f["file"] in own}
        return self._rewrite(base, manifest, new, touched, lambda old, rows: self._put(old.join(scopes, scopes.columns, "left_anti").select(*names), rows))
