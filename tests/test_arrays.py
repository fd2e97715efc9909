"""Array documents read by blocks, against the serial reading."""

import gzip
import json
import random

import pytest

from quillon.sources import arrays
from quillon.sources.dump import read_systems


def elements(r, n):
    odd = ['a"b', "\\", "\\\\\"", "}{", "[,]", "é😀\n", "", "x" * 300, '","', "\\u0041"]
    thing = lambda d: r.choice([r.random(), None, True, r.choice(odd), [thing(d - 1) for _ in range(r.randint(0, 3))], {r.choice(odd) + str(k): thing(d - 1) for k in range(r.randint(0, 3))}]) if d else r.choice(odd)
    return [{"id": i, "name": r.choice(odd), "parts": thing(3)} for i in range(n)]


@pytest.mark.parametrize("size, indent, ascii_only", [(300, None, False), (700, 2, True), (1 << 27, None, True)])
def test_blocks_equal_the_serial_reading(spark, tmp_path, monkeypatch, size, indent, ascii_only):
    monkeypatch.setattr(arrays, "CHUNK", 100)
    r = random.Random(size)
    want = []
    for k in range(2):
        own = elements(r, 25) + [1, None, "plain, text", [], {}] * (k == 1)
        want += own
        (tmp_path / f"{k}.json").write_text(" \n"[: k + 1] + json.dumps(own, indent=indent, ensure_ascii=ascii_only) + "\n" * k, encoding="utf-8")
    (tmp_path / "empty.json").write_text("[ ]")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = [json.loads(x.system) for x in arrays.read_array(spark, str(tmp_path)).collect()]
        tasks = arrays.block_states(spark, str(tmp_path)).count()
        objects = read_systems(spark, str(tmp_path), "document").count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    key = lambda x: json.dumps(x, sort_keys=True)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert objects == sum(isinstance(x, dict) for x in want)
    assert tasks > 10 if size <= 700 else tasks >= 3


@pytest.mark.parametrize("text", ['[{"a":1},{"a":', '[{"a":1},{"a":2}', '[{"a":"x}]', '{"a":1}', "[", '[{"a":[1}]'])
def test_cut_off_documents_raise(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(ValueError):
        arrays.read_array(spark, str(tmp_path / "a.json"))


def test_compressed_document(spark, tmp_path):
    with gzip.open(tmp_path / "a.json.gz", "wt", encoding="utf-8") as f:
        json.dump([{"name": f"s{i}"} for i in range(500)], f)
    assert read_systems(spark, str(tmp_path / "a.json.gz"), "document", partitions=3).count() == 500
