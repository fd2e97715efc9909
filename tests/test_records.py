"""The queries of ``plans.records`` against their SQL on the smallest tables, and what they stand on in small cases."""

import glob
import json
import os

import duckdb
import pytest

from quillon.operators import sites
from quillon.plans import records
from quillon.plans.queries import ORACLES, QUERIES
from quillon.sources import logs

SMALL = "/root/testdata/sf0.001"
NAMES = [name for name, f in QUERIES.items() if f.__module__ == records.__name__]


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_against_sql(spark, name):
    found = QUERIES[name](spark, SMALL)
    columns = sorted(found.columns)
    with duckdb.connect() as con:
        con.execute("set timezone = 'UTC'")
        for path in glob.glob(f"{SMALL}/*.parquet"):
            con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
        result = con.execute(f"select {', '.join(f'"{c}"' for c in columns)} from ({ORACLES[name]})")
        want = sorted([plain(v) for v in row] for row in result.fetchall())
    got = sorted([plain(v) for v in row] for row in found.select(*columns).collect())
    assert got and got == want


def test_every_query_has_its_sql():
    assert NAMES and all(name in ORACLES for name in NAMES)


def test_logs_are_named_by_day_and_old_ones_are_not_read(spark, tmp_path):
    folder = str(tmp_path / "logs")
    lines = spark.createDataFrame([('{"event": "Scan", "timestamp": "2024-01-02T00:00:00Z"}', "240102000000"), ('{"event": "Scan", "timestamp": "2024-03-02T00:00:00Z"}', "2024-03-02T000000"), ("", "2024-03-02T000000"), ('["Scan"]', "2024-03-02T000000"), ('{"event": ', "2024-03-02T000000")], "value string, day string")
    records.write_logs(lines, "day", folder)
    assert sorted(os.path.basename(p).rsplit(".", 2)[0] for p in glob.glob(f"{folder}/Journal.*.log")) == ["Journal.2024-03-02T000000", "Journal.240102000000"]
    read = logs.read_lines_since(spark, folder, "2024-02-01")
    assert read.count() == 4 and logs.events(read).select("timestamp").collect() == [("2024-03-02T00:00:00Z",)]
    assert logs.events(logs.read_lines(spark, folder)).count() == 2


def test_sector_rings_take_numbers_as_texts(spark):
    raw = [json.dumps({"type": "Icy", "mass": "5", "innerRad": 1, "outerRadius": "x"}), json.dumps({"RingClass": "Rocky", "massMT": 2.5, "innerRadius": "3", "outerRad": 4}), "not json", None]
    got = logs.sector_rings(spark.createDataFrame([(x,) for x in raw], "raw_json string")).collect()
    assert got == [("Icy", 5.0, 1.0, None), ("Rocky", 2.5, 3.0, 4.0), (None, None, None, None), (None, None, None, None)]


def test_pages_with_a_record_are_not_taken_again(spark):
    pages = spark.createDataFrame([("https://x/a?p=1", "<h1>A</h1>"), ("https://x/b#t", None)], "url string, html string")
    done = spark.createDataFrame([("https://x/a#z",)], "source_url string")
    got = sites.unseen(sites.parse_sites(pages), done).select("source_url", "system_name", "parse_warnings").collect()
    assert got == [("https://x/b", "", "materials_missing")]


def test_one_of_takes_values_in_turn(spark):
    got = [r[0] for r in spark.range(4).select(records.one_of("id", "a", None, "c")).collect()]
    assert got == ["a", None, "c", "a"]
