import csv
import math
import os
import random
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions.quantiles import medians, ranked
from quillon.operators import crosswalk, nearest, ranking, routes, scoring, spatial
from quillon.operators import graph
from quillon.operators.graph import components_of_links, connected_components

#: A folder with published point sets, one CSV a quadrant; without it that test is skipped.
PUBLISHED = os.environ.get("PUBLISHED_QUADRANTS", "")


def test_norms(spark):
    df = spark.createDataFrame([("Metallic", f"r{i:02}", float(i)) for i in range(1, 11)] + [("Icy", "x", 42.0), ("Rocky", "y", None)], "t string, id string, v double")
    rows = {r.t: r for r in scoring.norms(df, ["t"], "v", "id").collect()}
    m = rows["Metallic"]
    assert (m.n, m["mean"], m.p95, m.p99, m.p99_5, m.p99_9, m["min"], m["max"]) == (10, 5.5, 9, 9, 9, 9, 1, 10) and math.isclose(m.stddev, math.sqrt(8.25))
    assert rows["Icy"].stddev == 0 and rows["Icy"].p95 == 42 and "Rocky" not in rows


def test_score(spark):
    df = spark.createDataFrame([("r001", "Metallic", 10.0, 100.0, 500.0), ("r002", "Icy", 20.0, 80.0, 200.0), ("r003", "Rocky", 15.0, 120.0, None), ("r004", "Metallic", None, 130.0, 100.0), ("r005", "Icy", 9.0, None, 50.0)], "ring_id string, ring_type string, surface_density double, linear_density double, arrival_distance_ls double")
    rows = {r.ring_id: r for r in scoring.score(df).collect()}
    assert len(rows) == 5 and {r.norm_count for r in rows.values()} == {3}
    assert [rows[k].moi_final for k in ("r001", "r002", "r003", "r004")] == [0.0, 0.5, 1.0, None] and rows["r005"].flags == "missing_linear_density"
    assert scoring.score(df.where("ring_id = 'r001'")).first().moi_final == 1.0


def test_cohort(spark):
    df = spark.createDataFrame([("M", "b", 10.0), ("M", "a", 10.0), ("M", "c", 9.0), ("M", "b2", 9.0), ("M", "d", 8.0)], "t string, id string, v double")
    rows = sorted(scoring.cohort(df, ["t"], "v", "id", 3).collect(), key=lambda r: r.rank_in_cohort)
    assert [r.id for r in rows] == ["a", "b", "b2"] and rows[0].theta_id == "b2" and rows[0].theta_value == 9
    with pytest.raises(ValueError, match="5 rows"):
        scoring.cohort(df, ["t"], "v", "id", 6)


def test_histogram(spark):
    df = spark.createDataFrame([(0.4,), (0.7,), (0.9,), (0.97,), (0.995,), (None,)], "p double")
    assert {r.bucket: r["rows"] for r in scoring.histogram(df, "p").collect()} == dict.fromkeys([b for b, _ in scoring.BUCKETS], 1)
    assert sum(r["rows"] for r in scoring.histogram(df.where("false"), "p").collect()) == 0


def test_medians_and_shares(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.0, 5.0, 7.5])) for _ in range(300)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    own = lambda g: sorted(v for h, v in rows if h == g and v is not None)
    assert {r.g: r["median"] for r in medians(df, ["g"], "v").collect()} == {g: statistics.median(own(g)) for g in ("a", "b", None, "one")}
    assert medians(df, [], "v").first()[0] == statistics.median(v for _, v in rows if v is not None) and medians(df.where("g = 'none'"), [], "v").collect() == [(None,)]
    got = scoring.percentile_of_known(df, ["g"], "v").collect()
    assert len(got) == sum(v is not None for _, v in rows) and all(abs(r.percentile - sum(x <= r.v for x in own(r.g)) / len(own(r.g))) < 1e-12 for r in got)
    plan = scoring.percentile_of_known(df, ["g"], "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "cume_dist" not in plan.lower() and "percentile(" not in plan.lower()


@pytest.mark.parametrize("partitions", [7, None])
def test_ranked_is_a_global_row_number(spark, partitions):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randint(0, 5), i) for i in range(500)]
    got = {r.id: (r.idx, r.n) for r in ranked(spark.createDataFrame(rows, "g string, v int, id int"), ["g"], [F.col("v"), F.col("id")], partitions).collect()}
    for g in "ab":
        own = sorted((v, i) for h, v, i in rows if h == g)
        assert all(got[i] == (k, len(own)) for k, (_, i) in enumerate(own))


def test_components(spark):
    df = spark.createDataFrame([(f"r{i + 1}", float(x), 0.0, 0.0, 1.0) for i, x in enumerate([0, 1000, 1900, 10000, 11000, 30000])], "id string, x double, y double, z double, moi double")
    sizes = lambda t: sorted(r["count"] for r in spatial.components(df, "id", t).groupBy("comp").count().collect())
    assert sizes(2000.0) == [1, 2, 3] and sizes(500.0) == [1] * 6
    assert [r.cluster_id for r in spatial.numbered_clusters(spatial.components(df, "id", 2000.0), "id", "moi", "D2000").orderBy("cluster_id").collect()] == ["D2000_C001", "D2000_C002", "D2000_C003"]
    assert spatial.sweep(df, "id", [500.0, 2000.0]).orderBy("threshold").select("clusters").collect() == [(6,), (3,)]


def test_components_against_all_pairs(spark):
    """Dense clumps, a chain, points at the threshold and equal points."""
    rng = random.Random(7)
    rows = [(k, rng.gauss(3 * (k % 3), 0.4), rng.gauss(0, 0.4), rng.gauss(0, 0.4)) for k in range(240)] + [(300 + k, 20 + k * 0.5, 0.0, 0.0) for k in range(9)] + [(400, 50.0, 0.0, 0.0), (401, 50.5, 0.0, 0.0), (402, 51.00001, 0.0, 0.0), (403, 50.0, 0.0, 0.0)]
    rows += [(500 + k, 70 + rng.random() * 3, rng.random() * 3, 0.0) for k in range(60)]
    parent = {r[0]: r[0] for r in rows}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for i, p in enumerate(rows):
        for q in rows[:i]:
            if sum((u - v) * (u - v) for u, v in zip(p[1:], q[1:], strict=True)) <= 0.25:
                a, b = find(p[0]), find(q[0])
                parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*rows, (999, None, 0.0, 0.0)], "id int, x double, y double, z double")
    got = {r.id: r.comp for r in spatial.components(df, "id", 0.5).collect()}
    assert got == {i: find(i) for i in parent}


def test_one_tree_answers_all_thresholds(spark):
    r = random.Random(12)
    rows = [(k, *[r.choice([r.gauss(0, 0.05), r.random() * 6]) for _ in range(3)]) for k in range(300)] + [(300, None, 0.0, 0.0)]
    df, levels = spark.createDataFrame(rows, "id int, x double, y double, z double"), [0.2, 0.9]
    tree = spatial.threshold_tree(df, "id", levels).collect()
    assert len({t.node for t in tree}) == len(tree) < 300
    comp = {k: k for k, x, *_ in rows if x is not None}
    swept = {x.threshold: x for x in spatial.sweep(df, "id", levels).collect()}
    for level, threshold in enumerate(levels, start=1):
        up = {t.node: t.parent for t in tree if t.level == level}
        comp = {k: up.get(c, c) for k, c in comp.items()}
        assert comp == {x.id: x.comp for x in spatial.components(df, "id", threshold).collect()}
        sizes = Counter(comp.values())
        assert (swept[threshold].clusters, swept[threshold].largest, swept[threshold].single) == (len(sizes), max(sizes.values()), sum(v == 1 for v in sizes.values()))


def test_graph_components_against_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)]
    parent = list(range(301))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.comp for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert all(got[a] == find(a) and got[b] == find(b) for a, b in edges if a != b)
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


@pytest.mark.parametrize("small", [graph.SMALL_GRAPH, 10])
def test_components_of_links_in_one_task_or_by_joins(spark, monkeypatch, small):
    """Texts and numbers as ids, a long chain, repeated and null links, links of a node with itself."""
    monkeypatch.setattr(graph, "SMALL_GRAPH", small)
    rng = random.Random(3)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [(k + 1, k) for k in range(500, 560)] + [(7, 7), (500, 501)]
    parent = list(range(600))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.comp for r in components_of_links(spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")).collect()} == want
    named = spark.createDataFrame([(f"n{a:04d}", f"n{b:04d}") for a, b in edges], "a string, b string")
    assert {r.node: r.comp for r in components_of_links(named).collect()} == {f"n{a:04d}": f"n{c:04d}" for a, c in want.items()}
    assert components_of_links(spark.createDataFrame([], "a long, b long")).count() == 0


def test_kmeans(spark):
    xy = [(0, 0), (1, 0), (0, 1), (100, 100), (101, 100), (100, 101), (200, 0), (201, 0)]
    df = spark.createDataFrame([(f"r{i + 1}", float(a), float(b), 0.0, float(m)) for i, ((a, b), m) in enumerate(zip(xy, [90, 85, 82, 80, 79, 78, 70, 69], strict=True))], "id string, x double, y double, z double, moi double")
    for k, want in ((2, 2), (3, 3)):
        out, centers, _ = spatial.kmeans(df, "id", "moi", k)
        again = spatial.kmeans(df.orderBy("x"), "id", "moi", k)[1]
        assert out.select("cluster").distinct().count() == want and centers == again
    groups = {r.id: r.cluster for r in spatial.kmeans(df, "id", "moi", 3)[0].collect()}
    assert groups["r1"] == groups["r2"] == groups["r3"] != groups["r4"] == groups["r6"] != groups["r7"] == groups["r8"]
    with pytest.raises(ValueError):
        spatial.kmeans(df, "id", "moi", 9)


def test_bands(spark):
    df = spark.createDataFrame([(f"e{i}", float(i), 0.0, 0.0) for i in range(1, 7)] + [("no", None, 0.0, 0.0)], "id string, x double, y double, z double")
    rows = {r.id: r.subregion for r in spatial.bands(spatial.quadrants(df, (0.0, 0.0, 0.0)), "id", (0.0, 0.0, 0.0)).collect()}
    assert rows == {"e1": "E-inner", "e2": "E-inner", "e3": "E-mid", "e4": "E-mid", "e5": "E-outer", "e6": "E-outer"}
    assert tuple(spatial.skipped(df).first()) == (6, 1)


def test_proximity(spark, monkeypatch):
    way = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 10.0, 0.0, 0.0), (3, 20.0, 0.0, 0.0)], "seq int, x double, y double, z double")
    df = spark.createDataFrame([("m1", 0.0, 3.0, 0.0, 90.0), ("m2", 10.0, 4.0, 0.0, 80.0), ("m3", 5.0, 0.0, 0.0, 85.0), ("m4", 30.0, 0.0, 0.0, 95.0)], "id string, x double, y double, z double, moi double")
    for rows in (10_000, 0):  # by broadcast and by grid cells
        monkeypatch.setattr(spatial, "BROADCAST_ROWS", rows)
        got = {r.id: r.source_waypoint_seq for r in spatial.proximity(df, way, "id", "moi", 5.0, 82.0).collect()}
        assert got == {"m1": 1, "m3": 1}
        assert {r.id for r in spatial.proximity_top(df, way, "id", "moi", 5.0, 1).collect()} == {"m1", "m3"}


def test_long_route_makes_no_pairs(spark, monkeypatch):
    """Every point finds its stop in trees, in one pass or several: as by broadcast, rows that repeat too, and never by pairs within the radius."""
    rng = random.Random(4)
    place = lambda: [rng.randrange(-8, 8) / 4 for _ in range(3)]  # noqa: E731, few places, so stops coincide and tie
    way = spark.createDataFrame([(2**60 - k, *place()) for k in range(400)] + [(5, None, 0.0, 0.0), (6, math.nan, 0.0, 0.0)], "seq long, x double, y double, z double")
    points = [(k, *(c + rng.choice([0.0, 0.125]) for c in place()), 1.0) for k in range(300)]
    df = spark.createDataFrame(points + points[:20] + [(900, 50.0, 0.0, 0.0, 1.0), (901, math.nan, 0.0, 0.0, 1.0)], "id long, x double, y double, z double, moi double")
    plain = lambda rows: sorted((r.id, r.distance_to_route, r.source_waypoint_seq) for r in rows.collect())
    want = plain(spatial.proximity(df, way.where("x is not null and not isnan(x)"), "id", "moi", 0.5))
    assert len({i for i, _, _ in want}) > 200 and len(want) > len({i for i, _, _ in want})
    monkeypatch.setattr(spatial, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(spatial, "near_pairs", None)
    for most in (spatial.TREE_ROWS, 100):
        monkeypatch.setattr(spatial, "TREE_ROWS", most)
        assert plain(spatial.proximity(df, way, "id", "moi", 0.5)) == want
    assert spatial.proximity(df, way.where("seq < 0"), "id", "moi", 0.5).count() == 0


def test_fixed_points_are_searched_exactly():
    g = np.random.default_rng(3)
    for n, step in ((1, 0), (15, 0), (17, 0), (3000, 0), (3000, 0.5), (500, 100)):
        points, at = g.normal(size=(n, 3)), g.normal(size=(400, 3))
        if step:  # many equals
            points, at = np.round(points / step) * step, np.round(at / step) * step
        every = routes.squared(points[None], at[:, None])
        least, first = every.min(axis=1), every.argmin(axis=1)
        for radius in (0.05, 0.4, 1e9):
            d2, place = nearest.Fixed(points).nearest(at, np.full(400, radius * radius), most=500)
            near = least <= radius * radius
            assert (d2[near] == least[near]).all() and (place[near] == first[near]).all() and np.isinf(d2[~near]).all() and (place[~near] == n).all()


def points(spark, rows, name="g"):
    return spark.createDataFrame([(name, "inner", *map(str, r[:1]), *[float(v) for v in r[1:4]], None if r[4] is None else float(r[4])) for r in rows], "subregion string, band string, ring_id string, x double, y double, z double, moi double")


def test_medoids(spark):
    got = routes.stage_clusters(points(spark, [("a", 0, 0, 0, 1), ("b", 1, 0, 0, 10), ("c", 2, 0, 0, 1), ("d", 100, 0, 0, 1)]), k=1).collect()
    assert {r.medoid_id for r in got} == {"b"}
    got = routes.stage_clusters(points(spark, [("a", 0, 0, 0, 10), ("b", 20000, 0, 0, 9)])).collect()
    assert {r.k for r in got} == {2}
    same = routes.stage_clusters(points(spark, [("a", 0, 0, 0, None), ("b", 0, 0, 0, 9), ("c", 5, 0, 0, 9)]), k=3).collect()
    assert len(same) == 3
    assert routes.stage_clusters(points(spark, [("a", 0, 0, 0, 1)]).unionByName(points(spark, [("b", 0, 0, 0, 1)], "h")), only=["h"]).select("ring_id").collect() == [("b",)]


@pytest.mark.parametrize("k", [3, None])
def test_medoids_of_large_groups_are_the_same(spark, monkeypatch, k):
    """By one call a group, and by jobs over blocks of its points."""
    rng = random.Random(9)
    rows = [(f"p{i:03}", rng.choice([0, 20_000, 45_000]) + rng.random() * 6000, rng.random() * 6000, rng.random(), None if i % 9 == 0 else rng.randint(0, 5)) for i in range(70)]
    df = points(spark, rows + [("twin", *rows[0][1:4], 3)])
    costs = routes._costs
    monkeypatch.setattr(routes, "_costs", lambda assigned, block: costs(assigned, 20))
    plain = lambda d: sorted((r.ring_id, r.k, r.cluster_index, r.cluster_id, r.medoid_id, r.assign_rank, round(r.distance, 6)) for r in d.collect())
    assert plain(routes.stage_clusters(df, k=k, scope="s")) == plain(routes.stage_clusters(df, k=k, scope="s", limit=0))


def test_route(spark):
    df = spark.createDataFrame([("x", i, float(a), float(b), 0.0, float(m)) for i, a, b, m in [("r_a", 1, 0, 30), ("r_b", -1, 0, 30), ("r_c", 0, 1, 20), ("r_d", 2, 0, 10), ("r_e", -2, 0, 5)]], "route string, ring_id string, x double, y double, z double, moi double")
    rows = sorted(routes.greedy_route(df, (0.0, 0.0, 0.0)).collect(), key=lambda r: r.seq)
    assert [r.ring_id for r in rows] == ["r_a", "r_d", "r_c", "r_b", "r_e"] and math.isclose(rows[-1].cumulative, 3 + math.sqrt(5) + math.sqrt(2))
    assert [r.ring_id for r in sorted(routes.greedy_route(df).collect(), key=lambda r: r.seq)][0] == "r_a"


def test_itinerary(spark):
    s = spark.createDataFrame([("E", 10.0, 0.0, 0.0, 1.0), ("N", 10.0, 0.0, 10.0, 2.0), ("W", -10.0, 0.0, 0.0, 3.0)], "region_name string, centroid_x double, centroid_y double, centroid_z double, radius_max double")
    m = spark.createDataFrame([("E", "e1", 11.0, 0.0, 0.0, 1.0), ("E", "e2", 9.0, 0.0, 0.0, 9.0), ("N", "n1", 10.0, 0.0, 10.0, None), ("W", "w1", -10.0, 0.0, 0.0, 1.0)], "region_name string, ring_id string, x double, y double, z double, moi double")
    rows = sorted(routes.itinerary(s, m, "region_name", (12.0, 0.0, 0.0)).collect(), key=lambda r: r.seq)
    assert [r.region for r in rows] == ["E", "N", "W"] and rows[0].entry_id == "e1"


def test_sequence_flags_long_legs(spark):
    c = [("E-inner", 1, "c-1", "m1", 1000.0, 9, 1.0), ("E-inner", 2, "c-2", "m2", 3000.0, 4, 1.0), ("N-inner", 1, "c-3", "m3", 12000.0, 25, 1.0), ("N-inner", 2, "c-4", "m4", 16000.0, 16, 1.0)]
    df = spark.createDataFrame([(*r[:4], r[4], 0.0, 0.0, *r[5:]) for r in c], "subregion string, cluster_index int, cluster_id string, medoid_id string, x double, y double, z double, size_n int, p90 double")
    rows = sorted(routes.sequence_clusters(df, (0.0, 0.0, 0.0)).collect(), key=lambda r: (r.subregion, r.sequence))
    assert [(r.cluster_id, r.from_cluster, r.staging_required) for r in rows] == [("c-1", "START", False), ("c-2", "c-1", False), ("c-3", "START", True), ("c-4", "c-3", False)] and rows[2].leg == 12000


def test_places_of_medoids_and_systems(spark):
    clusters = spark.createDataFrame([("E", "m1"), ("E", "m2"), ("E", "m3")], "subregion string, medoid_id string")
    regions = spark.createDataFrame([("E", "m1", 1.0, 1.0, None), ("N", "m2", 9.0, 9.0, 9.0)], "subregion string, ring_id string, x double, y double, z double")
    rings = spark.createDataFrame([("m1", 5.0, 5.0, 5.0), ("m2", 6.0, 6.0, 6.0)], "ring_id string, x double, y double, z double")
    got = {r.medoid_id: (r.x, r.y, r.z) for r in routes.placed_clusters(clusters, regions, rings, ("subregion",)).collect()}
    assert got == {"m1": (1.0, 1.0, 5.0), "m2": (6.0, 6.0, 6.0), "m3": (None, None, None)}
    named = spark.createDataFrame([("Sol", 1.0, 0.0, 0.0), ("SOL", 3.0, 0.0, 0.0), ("sol", None, 0.0, 0.0), ("Elsewhere", None, None, None)], "system_name string, x double, y double, z double")
    assert [tuple(r) for r in spatial.system_average(named).collect()] == [("sol", "SOL", 2.0, 0.0, 0.0, 2)]


def test_kmeans_sweep(spark):
    df = spark.createDataFrame([(f"r{i}", float(10 * (i // 3) + i % 3), 0.0, 0.0, float(-i)) for i in range(9)], "id string, x double, y double, z double, moi double")
    rows = {r.k: r for r in spatial.kmeans_sweep(df, "id", "moi", [2, 3], near=1.5).collect()}
    assert (rows[3].size_min, rows[3].size_max, rows[3].radius_max, rows[3].size_ratio, rows[3].within, rows[3].best) == (3, 3, 1.0, 1.0, 9, True) and not rows[2].best and rows[2].n_points == 9


def test_latest_run(spark):
    runs = spark.createDataFrame([("s", "r1", "09:00", 1), ("s", "r2", "10:00", 2), ("s", "r0", "10:00", 3)], "scope string, run_id string, created_utc string, k int")
    assert routes.latest_run(runs, ["scope"]).first().run_id == "r2"


@pytest.mark.skipif(not os.path.isdir(PUBLISHED), reason="needs the published point sets")
@pytest.mark.parametrize("quadrant,want", [("E", {"E-inner": (30, [1], 12076.409749), "E-mid": (30, [1], 10846.560869), "E-outer": (30, [2, 5, 3, 1, 4], 19417.657300)}), ("N", {"N-inner": (46, [1], 11584.585688), "N-mid": (47, [1], 16730.920207), "N-outer": (46, [5, 2, 3, 6, 1, 4], 3102.428651)})])
def test_published_chain(spark, quadrant, want):
    with open(f"{PUBLISHED}/quadrant_{quadrant}.csv", newline="") as f:
        rows = [(r["ring_id"], float(r["x"]), float(r["y"]), float(r["z"]), float(r["moi_metric"]), float(r["theta_deg"])) for r in csv.DictReader(f)]
    df = spark.createDataFrame(rows, "ring_id string, x double, y double, z double, moi double, theta double")
    placed = spatial.quadrants(df)
    assert placed.where(F.abs(F.col("theta") - F.col("theta_deg")) > 1e-5).count() == 0 and {r.quadrant for r in placed.select("quadrant").distinct().collect()} == {quadrant}
    members = routes.stage_clusters(spatial.bands(placed, "ring_id")).persist()
    stats = routes.cluster_stats(members).join(df.select(F.col("ring_id").alias("medoid_id"), "x", "y", "z"), "medoid_id").withColumnRenamed("radius_p90", "p90")
    order = routes.sequence_clusters(stats, (11272.03125, -164.9375, 34440.625)).collect()
    for name, (n, visit, leg) in want.items():
        own = sorted((r for r in order if r.subregion == name), key=lambda r: r.sequence)
        assert members.where(F.col("subregion") == name).count() == n and [r.cluster_index for r in own] == visit and abs(own[0].leg - leg) < 1e-5


def test_crosswalk(spark):
    sites = spark.createDataFrame([("u1", "Sys", "AB2 rings"), ("u2", "sys", "3"), ("u3", "Nowhere", "1")], "source_url string, system_name string, planets string")
    rings = spark.createDataFrame([("i1", "SYS", "Sys AB 2", "Sys AB 2 A Ring"), ("m1", "Sys", "Sys AB 2", "Sys AB 2 B Ring"), ("r3", "Sys", "Sys 3", "x"), ("r13", "Sys", "Sys 13", "x")], "ring_id string, system_name string, body_name string, ring_name string")
    scores = spark.createDataFrame([("i1", "Icy", 10.0), ("m1", "Metallic", 99.0), ("r3", "Rocky", None)], "ring_id string, ring_type string, moi_final double")
    rows = {r.source_url: r for r in crosswalk.best_matches(sites, rings, scores).collect()}
    assert rows["u1"].best_ring_id == "i1" and rows["u1"].percentile == 1.0 and rows["u1"].top_candidates == "i1:10.000000:Icy; m1:99.000000:Metallic"
    assert rows["u2"].best_ring_id == "r3" and rows["u2"].matches == 1 and rows["u3"].status == "NOT_FOUND" and rows["u1"].status == "MATCHED_MULTIPLE"


def test_merge_keeps_first_names_and_greater_density(spark):
    schema = "system_name string, body_name string, ring_name string, category string, surface_density double, distance double, mapped boolean"
    db = spark.createDataFrame([("S", "B", "R", "Icy", 1.0, 5.0, False), ("S", "C", "R", "Icy", 2.0, 5.0, False)], schema)
    log = spark.createDataFrame([("s", "b ", "r", "Icy", 3.0, 0.0, True), ("s", "c", "r", "Icy", 2.0, 0.0, False)], schema)
    rows = {r.body_name: r for r in ranking.merge_sources(db, log).collect()}
    assert (rows["B"].surface_density, rows["B"].source, rows["B"].distance, rows["B"].mapped) == (3.0, "journal", 5.0, True) and rows["C"].source == "db"
    assert [r.body_name for r in ranking.top_by_category(ranking.merge_sources(db, log), 1).collect()] == ["B"]


def test_plans(spark):
    df = spark.range(1000).selectExpr("id % 3 as g", "id", "rand(1) as v").withColumn("v", F.col("v"))
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan(scoring.top_rows(df, ["g"], [F.col("v").desc()], 3)) and "TakeOrderedAndProject" in plan(scoring.best(df, "v", "id", 5))


def test_costs_of_medoids_leave_out_only_what_cannot_be_least():
    g = np.random.default_rng(3)
    for points in (g.normal(size=(400, 3)), g.integers(0, 3, size=(200, 3)).astype(float), np.zeros((5, 3)), np.r_[g.normal(size=(300, 3)), g.normal(size=(300, 3)) + 50]):
        every = np.array([np.sqrt(routes.squared(points, p)).sum() for p in points])
        costs = routes.medoid_costs(points)
        summed = np.isfinite(costs)
        assert (costs[summed] == every[summed]).all() and summed[every <= every.min() + routes.EPS].all()
    assert np.isfinite(routes.medoid_costs(g.normal(size=(20_000, 3)))).sum() < 2_000


def test_remaining_points_against_all_distances():
    r, g = random.Random(4), np.random.default_rng(4)
    for xyz in (g.normal(size=(300, 3)), g.integers(0, 4, size=(300, 3)).astype(float), np.ones((50, 3))):
        tree, left = nearest.Remaining(xyz), set(range(len(xyz)))
        while left:
            at = g.normal(size=3) * 2
            own, d2 = tree.nearest(at, 1e-12)
            want = {i: float(routes.squared(xyz[i], at)) for i in left}
            assert sorted(own.tolist()) == sorted(i for i, d in want.items() if d <= min(want.values()) + 1e-12) and all(want[i] == d for i, d in zip(own.tolist(), d2.tolist(), strict=True))
            gone = r.choice(sorted(left))
            tree.remove(gone)
            left.remove(gone)


def test_long_route_is_walked(spark):
    rows = spark.range(60_000).selectExpr("'a' as route", "lpad(cast(id as string), 9, '0') as ring_id", "cast(id % 300 as double) as x", "cast(id div 300 as double) as y", "0D as z", "cast(-id as double) as moi")
    steps = routes.greedy_route(rows).agg(F.count("*").alias("n"), F.countDistinct("ring_id").alias("k"), F.max("cumulative").alias("length")).first()
    assert steps.n == steps.k == 60_000 and 59_999 <= steps.length < 70_000
