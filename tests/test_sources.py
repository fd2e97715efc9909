import gzip
import json
import time

import pytest
from pyspark.sql import functions as F

from quillon import schema
from quillon.operators import ranking, sites
from quillon.session import settings
from quillon.sources import dump, logs, sinks, tail
from quillon.sources.tail import TailReader, TailSource
from quillon.streaming import live, runner

SYSTEM = {"name": "Test System", "id64": 123456789, "coords": {"x": 10, "y": 20, "z": 30}, "bodies": [{"name": "Test System A", "type": "Star", "spectralClass": "K4 VI", "bodyId": 1}, {"name": "Test System A 1", "bodyId": 5, "type": "Planet", "distanceToArrival": 500.0, "gravity": 0.2, "rings": [{"name": "Test Ring A", "ringClass": "eRingClass_Icy", "reserveLevel": "Pristine", "massMT": 100, "innerRad": 1, "outerRad": 3}, {"ringClass": "x"}]}]}
ALT = {"StarSystem": "Alt", "x": "1", "y": 2, "z": 3, "Bodies": [{"Name": "Alt 1", "BodyID": None, "id": 7, "Rings": [{"RingName": "R", "RingClass": None, "class": "Rocky", "mass": "5", "innerRadius": 3, "outerRadius": 2}]}]}


@pytest.mark.parametrize("kind", ["jsonl", "document", "gzip"])
def test_flatten(spark, tmp_path, kind):
    path = str(tmp_path / ("d.json.gz" if kind == "gzip" else "d.json"))
    lines = [json.dumps(SYSTEM), "{bad", "[]", "", json.dumps(ALT)]
    text = json.dumps([SYSTEM, ALT]) if kind == "document" else "\n".join(lines)
    with (gzip.open if kind == "gzip" else open)(path, "wt") as f:
        f.write(text)
    assert dump.detect_format(path) == ("document" if kind == "document" else "jsonl")
    rows = {r.ring_name: r for r in dump.flatten(dump.read_systems(spark, path, dump.detect_format(path), 2), "now").collect()}
    a, r = rows["Test Ring A"], rows["R"]
    assert len(rows) == 2 and (a.ring_width, a.linear_density, a.x, a.body_id, a.primary_star_class) == (2.0, 50.0, 10.0, 5, "K4 VI") and abs(a.surface_density - 100 / (8 * 3.141592653589793)) < 1e-12
    assert (r.ring_type, r.mass, r.ring_width, r.surface_density, r.x, r.body_id) == ("Rocky", 5.0, None, None, 1.0, 7)
    import hashlib

    assert a.ring_id == hashlib.sha1(b"123456789|5|Test Ring A|1|3").hexdigest() and r.ring_id == hashlib.sha1(b"Alt|7|R|3|2").hexdigest()


def test_document_that_is_cut_off_fails(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([SYSTEM, ALT])[:-40])
    with pytest.raises(Exception, match="cut off"):
        dump.read_systems(spark, str(tmp_path / "d.json"), "document").collect()


def test_flatten_limit_and_payloads(spark):
    df = spark.createDataFrame([(json.dumps(SYSTEM),), (json.dumps(ALT),), (json.dumps(SYSTEM),)], "system string")
    assert dump.flatten(df, "now", limit=1).count() == 1
    assert dump.payloads(df, "none") == {} and {k: v.count() for k, v in dump.payloads(df, "all").items()} == {"rings_payloads": 3, "bodies_raw": 3, "systems_raw": 2}


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, v string, s double")
    new = spark.createDataFrame([(2, "c", None, 1), (2, "d", None, 2), (3, "e", 9.0, 1)], "k int, v string, s double, seq int")
    assert sorted(map(tuple, dump.upsert(old.withColumn("seq", F.lit(0)), new, ["k"], "seq").select("k", "v", "s").collect())) == [(1, "a", 1.0), (2, "d", None), (3, "e", 9.0)]
    assert sorted(map(tuple, dump.update_columns(old, new.where("seq = 1"), ["k"], ["v"]).collect())) == [(1, "a", 1.0), (2, "c", 2.0), (3, "e", None)]


def scan(body, cls, mass, **extra):
    return {"timestamp": "2026-01-02T00:00:00Z", "event": "Scan", "StarSystem": "S", "BodyName": f"S {body}", "BodyID": body, "ReserveLevel": "PristineResources", "PlanetClass": "Icy body", "Rings": [{"Name": f"S {body} A Ring", "RingClass": cls, "MassMT": mass, "InnerRad": 1.0, "OuterRad": 2.0}]} | extra


def test_log_ranking(spark, tmp_path):
    rows = [scan(1, "eRingClass_Icy", 10.0), scan(2, "eRingClass_Metalic", 20.0), scan(3, "eRingClass_MetalRich", 99.0), scan(4, "eRingClass_Icy", 30.0, ReserveLevel="Common"), {"timestamp": "2026-01-02T00:00:00Z", "event": "SAAScanComplete", "StarSystem": "S", "BodyName": "S 1"}, {"timestamp": "t", "event": "SAASignalsFound", "StarSystem": "S", "BodyName": "S 1", "Signals": [{"Type": "Tritium", "Count": 7}, {"Type": "Tritium", "Count": 1}]}, {"timestamp": "t", "event": "SAAScanComplete", "StarSystem": "S", "BodyName": "S 9"}]
    (tmp_path / "Journal.2026-01-02T00.01.log").write_text("\n".join([*map(json.dumps, rows), "", "{", "[1]", '{"x": 1}']))
    (tmp_path / "other.log").write_text(json.dumps(rows[0]))
    events = logs.events(logs.read_lines(spark, str(tmp_path)))
    assert events.count() == len(rows) and logs.live_events(events).count() == 4 and logs.since(events, "2026-01-01").count() == 5
    ranked = {r.body_name: r for r in ranking.rank_log(events).collect()}
    assert set(ranked) == {"S 1", "S 2"} and abs(ranked["S 1"].sigma_norm - 10 / 15) < 1e-9 and ranked["S 1"].tritium == 2 and ranked["S 1"].mapped
    assert abs(ranked["S 1"].rmoi_tritium - 10 / 15 * (1 + __import__("math").log(3))) < 1e-9 and abs(ranked["S 2"].rmoi_platinum - 20 / 15) < 1e-9
    assert [r.BodyName for r in ranking.unmatched_mapping(events).collect()] == ["S 9"] and ranking.tasking(ranking.rank_log(events), "tritium").count() == 1
    assert ranking.rank_log(events, sigma_min=1.0).count() == 1


def test_dated_logs_are_pruned_by_name(spark, tmp_path):
    names = ["Journal.251231000000.01.log", "Journal.260102000000.01.log", "Journal.2026-01-01T000000.01.log", "Journal.2025-12-31T000000.01.log", "Journal.odd.log", "other.log"]
    for name in names:
        (tmp_path / name).write_text(name + "\n")
    read = logs.read_lines_since(spark, f"file://{tmp_path}", "2026-01-01T10:00:00")
    assert sorted(r.value for r in read.collect()) == sorted(names[1:3] + names[4:5]) and all(r.value == r.file for r in read.collect())
    scan = next(p for p in _nodes(read) if "Scan" in p.nodeName())
    scan.execute().count()  # the metric is set when the scan runs
    assert scan.metrics().apply("numFiles").value() == 3
    r = spark.range(1).select(logs.file_date(F.lit("Journal.260102000000.01.log")).alias("a"), logs.file_date(F.lit("x")).alias("b")).first()
    assert (r.a, r.b) == ("2026-01-02", None)


def _nodes(df):
    """The nodes of the physical plan, by Spark's own objects."""
    todo, out = [df._jdf.queryExecution().sparkPlan()], []
    while todo:
        out.append(todo.pop())
        children = out[-1].children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_medians():
    full = {k: {"ring_type": k, "baseline_median": 1.5, "method": "m", "source_date": "d", "provenance_notes": "p"} for k in logs.TYPES}
    assert logs.medians(json.dumps(full))["Icy"] == 1.5 and logs.medians(json.dumps({k: v for k, v in full.items() if k != "Icy"})) == {} and logs.medians("x") == {}


def test_resolution(spark):
    df = spark.createDataFrame([(1, 2.0)], "ring_id int, moi_raw double")
    assert schema.metric_column(df) == "moi_raw" and schema.rank_column(df) == "rank_in_cohort" and schema.coordinate_columns(df) == ("x", "y", "z")
    with pytest.raises(ValueError):
        schema.metric_column(df, "nope")
    roles = schema.resolve_roles(["System Name", "body_name", "ring_name", "RingClass", "mass_mt", "inner_rad", "outer_rad"])
    assert roles["system"] == "System Name" and roles["ring_class"] == "RingClass" and roles["inner"] == "inner_rad"
    assert schema.best_table({"a": ["x"], "rings": ["ring_name", "ring_class", "mass_mt", "inner_rad", "outer_rad"]}, ("ring_class", "mass")) == "rings"
    assert "updated_at_utc" in schema.with_missing(df, schema.RINGS_RAW).columns


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 1.23456789), ("b", 2, None)], "g string, k int, v double")
    sinks.write_csv(df, str(tmp_path / "c"), {"v": 6}, ["g"])
    assert "1.234568" in "".join(p.read_text() for p in (tmp_path / "c" / "g=a").glob("*.csv"))
    path = str(tmp_path / "p")
    sinks.replace_scope(df, path, ["g"])
    sinks.replace_scope(df.where("g = 'a'").withColumn("k", F.lit(9)), path, ["g"])
    assert sorted((r.g, r.k) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 2)]
    sinks.append_run(spark, str(tmp_path / "r"), {"run": 1, "params": {"b": 1, "a": 2}})
    sinks.append_run(spark, str(tmp_path / "r"), {"run": 2, "params": None})
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2
    assert "| a | 1 |" in sinks.markdown(df.orderBy("k"), "T") and sinks.parse_k_map("E-inner=3, N=1") == {"E-inner": 3, "N": 1} and sinks.policy_text(b=1, a=2) == "a=2|b=1"
    with pytest.raises(ValueError):
        sinks.parse_k_map("x")
    assert {k: v.count() for k, v in sinks.subset({"t": df.withColumn("system_name", F.col("g")), "u": df}, spark.createDataFrame([("a",)], "system_name string")).items()} == {"t": 1, "u": 2}
    assert settings({"a": None, "b": 2}, None, {"a": 1, "b": 1}) == {"a": 1, "b": 2}


PAGE = """<html><head><title>Sys | Site</title></head><body><h1>Sys A</h1><div>Mining Location <table><tr><th>Planet(s)</th><td>AB2 and AB3 rings</td></tr></table>
<p>Material Type Tritium, Platinum Mining Type Laser Overlap # 2 Thanks to: Bob</p></div><p>First words.</p><p>First words.</p><p>Second words.</p><a href="/mining-location/x?y=1">x</a><a href="/p2" rel="next">go</a></body></html>"""


def test_deep_pages_and_names_of_outputs(spark, tmp_path):
    assert sites.site("<div>" * 3000 + "<h1>Deep</h1>")["system_name"] == "Deep"
    assert sinks.dated_name("/a/b.sqlite", "2026-01-02") == "/a/b_2026-01-02.sqlite" and sinks.dated_name("/a/b.db", "2026-01-02") == "/a/b.db_2026-01-02"
    top = spark.createDataFrame([("S", "B", "R", "Icy", 1)], "system_name string, body_name string, ring_name string, category string, rank int")
    sinks.write_top_tables(top, str(tmp_path / "top"))
    assert spark.read.parquet(str(tmp_path / "top" / "flags")).first().top_rank == 1 and json.loads(sinks.json_report(top, "T"))["rows"][0]["category"] == "Icy"
    systems = spark.createDataFrame([(" s ", 1.0, 2.0, 3.0, 1), ("S", 4.0, 0.0, 0.0, 2), ("T", None, None, None, 1)], "system_name string, x double, y double, z double, seq int")
    rings = spark.createDataFrame([("S",), ("T",)], "system_name string")
    assert [r.distance for r in ranking.with_distance(rings, systems, (0.0, 0.0, 0.0), "seq").collect()] == [4.0] and ranking.without_place(rings, systems).first()["count"] == 1
    events = spark.createDataFrame([("S", None), (" s", "X"), ("", "S"), (None, None), ("X", "S")], "StarSystem string, SystemName string")
    assert ranking.of_systems(events, systems).count() == 3


def test_sites(spark):
    pages = spark.createDataFrame([("http://h/a?q#z", PAGE), ("http://h/b", None)], "url string, html string")
    rows = {r.source_url: r for r in sites.parse_sites(pages).collect()}
    a = rows["http://h/a"]
    assert (a.system_name, a.planets, a.mining_type, a.overlap, a.tritium_explicit, a.materials) == ("Sys A", "AB2 and AB3 rings", "Laser", "2", 1, ["Tritium", "Platinum"])
    assert a.description == "Mining Location Planet(s)" or a.description.startswith("Material Type") or "First words." in a.description
    assert rows["http://h/b"].parse_warnings == "materials_missing" and rows["http://h/b"].tritium_inferred == 1
    listed = {r.url: r for r in sites.listing(pages).collect()}["http://h/a?q#z"]
    assert listed.links == ["http://h/mining-location/x"] and listed.next_url == "http://h/p2"
    links = spark.createDataFrame([("http://h/a",), ("http://h/c",)], "source_url string")
    assert [r.source_url for r in sites.unseen(links, pages.select(F.col("url").alias("source_url"))).collect()] == ["http://h/c"]


MEDIANS = dict.fromkeys(logs.TYPES, 1.0)


def test_live_rows(spark):
    area = 3 * 3.141592653589793
    rows = [scan(1, "eRingClass_Icy", 1.95 * area), scan(2, "eRingClass_Metalic", 2.5 * area), scan(3, "Rocky", 0.5 * area), scan(4, "what", 1.0), {"event": "Scan", "BodyID": 5}]
    events = logs.events(spark.createDataFrame([(json.dumps(r),) for r in rows], "value string"))
    got = {r.ring_key: r for r in live.ring_rows(events, MEDIANS).collect()}
    assert {k: v.tier for k, v in got.items()} == {"1:A": "green", "2:A": "red", "3:A": "black", "4:A": "unknown"}
    assert got["1:A"].delta_label == "+95%" and got["4:A"].ring_type == "what" and got["1:A"].body == "1" and got["1:A"].body_type == "Icy World"


def test_batch_twin(spark):
    rows = [("u", 1, "jump", "A", None, None, 0), ("u", 2, "ring", None, "1:A", "red", 0), ("u", 3, "jump", "A", None, None, 0), ("u", 4, "ring", None, "2:A", "black", 0), ("u", 5, "ring", None, "3:A", "black", 100), ("u", 6, "ring", None, "1:A", "green", 100), ("v", 1, "ring", None, "9:A", "red", 0), ("v", 2, "jump", "B", None, None, 0)]
    df = spark.createDataFrame(rows, "session string, seq int, kind string, system string, ring_key string, tier string, at int").withColumn("seen", F.timestamp_seconds("at"))
    got = {(r.session, r.ring_key): (r.tier, r.first_order) for r in live.final_table(df, "session", "seq", "seen", "1970-01-01 00:03:00").collect()}
    assert got == {("u", "1:A"): ("green", 2), ("u", "3:A"): ("black", 5)}


def test_tail_reader(tmp_path):
    log = tmp_path / "Journal.1.log"
    log.write_text("old\n")
    reader = TailReader({"path": str(tmp_path)})
    rows = lambda start, end: sorted(r for p in reader.partitions(start, end) for r in reader.read(p))
    at = reader.initialOffset()
    with log.open("a") as f:
        f.write("one\ntw")
    at2 = reader.latestOffset()
    assert rows(at, at2) == [("Journal.1.log", 4, "one")]
    with log.open("a") as f:
        f.write("o\n")
    (tmp_path / "Journal.2.log").write_text("three\n")
    at3 = reader.latestOffset()
    assert rows(at2, at3) == [("Journal.1.log", 8, "two"), ("Journal.2.log", 0, "three")] and reader.latestOffset() == at3 and rows(at3, at3) == []


def test_tail_ranges_split_a_file_between_lines(tmp_path, monkeypatch):
    text = "".join(f"line {k} {'x' * (k % 7)}\n" for k in range(50))
    (tmp_path / "Journal.1.log").write_text(text + "half")
    reader = TailReader({"path": str(tmp_path), "startingOffsets": "earliest"})
    start, end = reader.initialOffset(), reader.latestOffset()
    for size in (1, 5, 64, 10_000):
        monkeypatch.setattr(tail, "RANGE", size)
        found = [r for p in reader.partitions(start, end) for r in reader.read(p)]
        assert [v for _, _, v in found] == text.splitlines() and [text[a:].split("\n")[0] for _, a, _ in found] == text.splitlines()


def test_stream_equals_batch(spark, tmp_path):
    folder, log = tmp_path / "logs", tmp_path / "logs" / "Journal.1.log"
    folder.mkdir()
    log.write_text(json.dumps({"event": "FSDJump", "StarSystem": "Old"}) + "\n")
    spark.dataSource.register(TailSource)
    lines = spark.readStream.format("tail").option("startingOffsets", "earliest").load(str(folder))
    changes: list = []
    query = live.live_table(logs.events(lines), MEDIANS).writeStream.outputMode("update").foreachBatch(lambda df, _: changes.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        # with processing-time timers the stream never runs out of batches, so this waits for what it looks for, and only so long
        until = time.time() + 30
        while time.time() < until and query.lastProgress is None and query.isActive:
            time.sleep(0.5)
        with log.open("a") as f:
            f.write("\n".join(json.dumps(r) for r in [scan(1, "eRingClass_Icy", 99.0), {"event": "FSDJump", "StarSystem": "New"}, scan(2, "eRingClass_Icy", 99.0), scan(2, "eRingClass_Icy", 1.0)]) + "\n{bad\n")
        until = time.time() + 30
        while time.time() < until and sum(c.change == "upserted" for c in changes) < 3 and query.isActive:
            time.sleep(0.5)
    finally:
        query.stop()
    table: dict = {}
    for c in changes:
        if c.change == "upserted":
            table[c.ring_key] = c.tier
        else:
            table.pop(c.ring_key, None)
    assert table == {"2:A": "black"} and [c.change for c in changes].count("cleared") == 1


def test_bad_lines_and_events_come_once_each(spark, tmp_path, monkeypatch):
    """A query that dies between its two sinks, and one that goes on from its checkpoint."""
    folder, log, out, checkpoint = tmp_path / "logs", tmp_path / "logs" / "Journal.1.log", str(tmp_path / "out"), str(tmp_path / "cp")
    folder.mkdir()
    spark.dataSource.register(TailSource)
    lines = lambda: spark.readStream.format("tail").option("startingOffsets", "earliest").load(str(folder))
    good = [json.dumps({"event": "FSDJump", "StarSystem": f"S{k}"}) for k in range(5)]
    bad = {"{bad": "malformed", "  ": "blank", "[1]": "no object", '{"a":1}': "no event", '"event"': "no object"}
    log.write_text("\n".join([*good, *bad]) + "\n")

    real = runner.put

    def dies(df, path, batch):
        if path.endswith("bad"):
            raise RuntimeError("killed")
        real(df, path, batch)

    def finish(query):
        until = time.time() + 60
        while query.isActive and time.time() < until:
            time.sleep(0.2)
        query.stop()

    monkeypatch.setattr(runner, "put", dies)
    finish(runner.run_events(lines(), out, checkpoint, every="1 second"))  # dies in its first batch
    assert runner.taken(spark, f"{out}/events").count() == 5
    monkeypatch.setattr(runner, "put", real)
    with log.open("a") as f:
        f.write("{worse\n" + good[0] + "\n")
    query = runner.run_events(lines(), out, checkpoint, every="1 second")
    until = time.time() + 60
    while time.time() < until and query.isActive and (query.lastProgress is None or not (tmp_path / "out" / "bad" / "batch=1").exists()):
        time.sleep(0.3)
    query.processAllAvailable()
    query.stop()
    assert sorted(r.StarSystem for r in runner.taken(spark, f"{out}/events").collect()) == sorted([*[f"S{k}" for k in range(5)], "S0"])
    assert sorted((r.value, r.reason) for r in runner.taken(spark, f"{out}/bad").collect()) == sorted([*bad.items(), ("{worse", "malformed")])
