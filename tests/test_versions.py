"""Tables in versions, scoped replacement, canonical JSON."""

import json

import pytest
from pyspark.sql import functions as F

from quillon.sources import dump, sinks
from quillon.sources.versions import VersionedTable

SCHEMA = "g string, k long, v double"


def rows(table, version=None):
    return sorted(map(tuple, table.read(version).collect()), key=str)


def test_upsert_rewrites_only_what_it_meets(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["g", "k"], rows_per_file=25)
    assert t.version() == 0 and t.files() == []
    old = [(g, k, float(k)) for g in "abcd" for k in range(50)]
    assert t.overwrite(spark.createDataFrame(old, SCHEMA)) == 1
    before = t.files()
    assert len(before) >= 6
    new = spark.createDataFrame([("b", 7, -1.0, 1), ("b", 7, -2.0, 2), ("b", 1000, 5.0, 1), (None, 1, 1.0, 1)], SCHEMA + ", at long")
    assert t.upsert(new, "at") == 2
    want = [r for r in old if r[:2] != ("b", 7)] + [("b", 7, -2.0), ("b", 1000, 5.0), (None, 1, 1.0)]
    assert rows(t) == sorted(want, key=str) and rows(t, 1) == sorted(old, key=str)
    kept = set(before) & set(t.files())
    assert len(kept) >= len(before) - 3  # the files of (b, 7), of (b, 1000), and the first, to which a null belongs
    t.upsert(spark.createDataFrame([("c", 3, 9.0, 1), ("e", 1, 2.0, 1)], SCHEMA + ", at long"), "at", columns=["v"])
    want = [r for r in want if r[:2] != ("c", 3)] + [("c", 3, 9.0), ("e", 1, 2.0)]
    assert rows(t) == sorted(want, key=str)
    # many upserts keep keys once and files apart
    for i in range(3):
        t.upsert(spark.createDataFrame([("a", k, float(i), i) for k in range(i, 120, 7)], SCHEMA + ", at long"), "at")
        want = [r for r in want if not (r[0] == "a" and r[1] in range(i, 120, 7))] + [("a", k, float(i)) for k in range(i, 120, 7)]
    assert rows(t) == sorted(want, key=str)


def test_a_failed_change_leaves_the_version(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["k"])
    t.overwrite(spark.createDataFrame([(1, 1.0), (2, 2.0)], "k long, v double"))
    bad = spark.createDataFrame([(2, 3.0)], "k long, v double").withColumn("v", F.when(F.col("k") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("v")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        t.upsert(bad, "v")
    assert t.version() == 1 and rows(t) == [(1, 1.0), (2, 2.0)]
    manifest = t.manifest()
    with pytest.raises(Exception, match="exist"):  # another writer was first
        t._commit(0, t.read().schema, manifest["files"])
    assert t.version() == 1 and t.manifest() == manifest


def test_replaced_scopes_may_become_empty(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["g", "k"], rows_per_file=10)
    t.overwrite(spark.createDataFrame([(g, k, 0.0) for g in "abc" for k in range(20)], SCHEMA))
    before = t.files()
    scopes = spark.createDataFrame([("a",), ("b",)], "g string")
    t.replace(spark.createDataFrame([("a", 5, 1.0)], SCHEMA), scopes)
    assert rows(t) == sorted([("a", 5, 1.0)] + [("c", k, 0.0) for k in range(20)], key=str) and set(before) & set(t.files())
    with pytest.raises(ValueError):
        t.replace(spark.createDataFrame([("c", 5, 1.0)], SCHEMA), scopes)
    t.replace(spark.createDataFrame([], SCHEMA), spark.createDataFrame([("a",), ("c",), ("z",)], "g string"))
    assert rows(t) == []
    t.upsert(spark.createDataFrame([("q", 1, 1.0)], SCHEMA), "v")
    assert rows(t) == [("q", 1, 1.0)]


def test_partitions_of_empty_scopes_go(spark, tmp_path):
    df = spark.createDataFrame([("a", "x/y", 1), ("b", None, 2), ("c", "z", 3)], "g string, h string, k int")
    path = str(tmp_path / "p")
    sinks.replace_scope(df, path, ["g", "h"])
    sinks.replace_scope(df.where("g = 'c'").withColumn("k", F.lit(9)), path, ["g", "h"], df.where("g <> 'b'").select("g", "h"))
    assert sorted((r.g, r.k) for r in spark.read.parquet(path).collect()) == [("b", 2), ("c", 9)]
    sinks.replace_scope(df.limit(0), path, ["g", "h"], df.select("g", "h"))
    assert spark.read.schema(df.schema).parquet(path).count() == 0


def test_canonical_json(spark):
    texts = ['{"name":"R","b":1,"a":2}', '{"é":{"z":[1,{"y":null,"x":true}],"a":"\\u00e9\\n"},"n":1.50,"m":1e3,"big":123456789012345678901234567890}', "[3, 2]", "no json", None, "", '{"a":1,"a":2}', '"😀"']
    got = [r.c for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", dump.canonical_json("t").alias("c")).orderBy("i").collect()]
    want = [None if t in (None, "", "no json") else json.dumps(json.loads(t), sort_keys=True) for t in texts]
    assert got == want and got[0] == '{"a": 2, "b": 1, "name": "R"}'
    systems = spark.createDataFrame([('{"name":"S","id64":7,"bodies":[{"name":"B","bodyId":1,"rings":[{"name":"R","b":1,"a":2}]}]}',)], "system string")
    kept = dump.payloads(systems, "all")
    assert kept["rings_payloads"].first().raw_json == '{"a": 2, "b": 1, "name": "R"}' and kept["systems_raw"].first().raw_json.startswith('{"bodies": [{"bodyId": 1, ')
