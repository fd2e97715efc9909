"""Grouped algorithms that go step by step: k-medoids, greedy routes, sequencing with lookahead.

Groups of k-medoids (subregions of a cohort) up to ``limit`` rows are worked on by one pandas call each, which Spark deals out; larger
ones by Spark jobs over blocks of their points, with the same result. Routes and sequences are walked by one call a group, since each
step depends on the one before; routes find their next point in a k-d tree. There a group may have at most ``limit`` rows, checked before
it is gathered: a larger one is an error, never a cut.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import scalar as S
from quillon.operators.nearest import Remaining
from quillon.session import broadcast_if_small, materialize

EPS = 1e-12
#: Fixed values: (greatest radius, greatest k) of each band.
POLICY = {"inner": (8000.0, 3), "mid": (10000.0, 6), "outer": (12000.0, 10)}
XYZ = ["x", "y", "z"]


def bounded_groups(df: DataFrame, group: list[str], limit: int) -> None:
    over = df.groupBy(*group).count().where(F.col("count") > limit).first()
    if over:
        raise ValueError(f"group { {g: over[g] for g in group} } has {over['count']} rows; at most {limit} can be worked on step by step")


def squared(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    d = points - to
    return d[..., 0] ** 2 + d[..., 1] ** 2 + d[..., 2] ** 2


def choose(scores: np.ndarray, metric: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> int:
    """The allowed place of least score; of those equal to within EPS, of greatest metric, then least id."""
    at = np.flatnonzero(allowed)
    tied = at[scores[at] <= scores[at].min() + EPS]
    tied = tied[metric[tied] >= metric[tied].max() - EPS] if np.isfinite(metric[tied].max()) else tied
    return int(min(tied, key=lambda i: ids[i]))


def medoid_costs(points: np.ndarray) -> np.ndarray:
    """Each point's sum of distances to all, or infinity for points that cannot be of the least sum.

    By the triangle inequality a sum is at least |n d - s|, for the distance d to a point of known sum s. Points are summed from the middle
    outwards, and those whose bound lies above the least sum so far, by more than ties and rounding, are not summed.
    """
    n, least = len(points), math.inf
    low, costs = np.zeros(n), np.full(n, np.inf)
    for i in np.argsort(squared(points, points.mean(axis=0)), kind="stable").tolist():
        if low[i] <= least * (1 + 1e-9) + EPS:
            d = np.sqrt(squared(points, points[i]))
            costs[i] = d.sum()
            least = min(least, costs[i])
            np.maximum(low, np.abs(n * d - costs[i]), out=low)
    return costs


def k_medoids(xyz: np.ndarray, metric: np.ndarray, ids: np.ndarray, centroid: np.ndarray, k: int, rounds: int = 10) -> tuple[list[int], np.ndarray]:
    """(places of the medoids, each point's medoid by its number among them). A cluster left empty keeps its medoid."""
    n = len(ids)
    chosen = [choose(squared(xyz, centroid), metric, ids, np.ones(n, bool))]
    near = squared(xyz, xyz[chosen[0]])
    while len(chosen) < min(k, n):
        chosen.append(choose(-near, metric, ids, ~np.isin(np.arange(n), chosen)))
        near = np.minimum(near, squared(xyz, xyz[chosen[-1]]))
    by_id = lambda places: sorted(set(places), key=lambda i: ids[i])
    medoids = by_id(chosen)

    def assign() -> np.ndarray:
        d2 = np.stack([squared(xyz, xyz[m]) for m in medoids])
        return np.argmax(d2 <= d2.min(axis=0) + EPS, axis=0)  # the first, so the least id, of those as near

    for _ in range(rounds):
        own, new = assign(), []
        for c, old in enumerate(medoids):
            members = np.flatnonzero(own == c)
            if not len(members):
                new.append(old)
                continue
            costs = medoid_costs(xyz[members])
            new.append(int(members[choose(costs, metric[members], ids[members], np.ones(len(members), bool))]))
        if (new := by_id(new)) == medoids:
            break
        medoids = new
    return medoids, assign()


def auto_k(xyz: np.ndarray, metric: np.ndarray, ids: np.ndarray, centroid: np.ndarray, band: str) -> tuple[int, list[int], np.ndarray]:
    """The least k whose clusters all lie within the band's radius, or the band's greatest k."""
    radius, most = POLICY.get(band.lower(), POLICY["outer"])
    k, medoids, own = 1, [], np.zeros(len(ids), int)
    for k in range(1, min(most, len(ids)) + 1):
        medoids, own = k_medoids(xyz, metric, ids, centroid, k)
        if math.sqrt(squared(xyz, xyz[medoids][own]).max()) <= radius + EPS:
            break
    return k, medoids, own


MEMBERS = "subregion string, k int, cluster_index int, cluster_id string, medoid_id string, ring_id string, distance double, distance2 double, assign_rank int"


def stage_clusters(points: DataFrame, k: int | None = None, k_map: dict[str, int] | None = None, auto: bool = True, scope: str = "", limit: int = 20_000, only: list[str] | None = None) -> DataFrame:
    """Clusters of each subregion (columns subregion, band, ring_id, x, y, z, moi): a row a member, ranked in its cluster.

    k comes from ``k_map``, else ``k``, else the search by radius if ``auto``, else 1. ``only`` names the subregions to work on.
    """
    import hashlib

    rows = points.select("subregion", "band", "ring_id", *XYZ, "moi")
    if only is not None:
        rows = rows.where(F.col("subregion").isin(*only))

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ring_id", kind="stable").reset_index(drop=True)
        xyz, ids = rows[XYZ].to_numpy(float), rows["ring_id"].to_numpy(object)
        metric = rows["moi"].astype(float).fillna(-np.inf).to_numpy()
        name, band = rows["subregion"][0], rows["band"][0]
        wanted = (k_map or {}).get(name, k)
        if wanted is None and auto:
            found, medoids, own = auto_k(xyz, metric, ids, xyz.mean(axis=0), band)
        else:
            found = wanted or 1
            medoids, own = k_medoids(xyz, metric, ids, xyz.mean(axis=0), found)
        d2 = squared(xyz, xyz[medoids][own])
        out = pd.DataFrame({"subregion": name, "k": found, "cluster_index": own + 1, "medoid_id": ids[np.array(medoids)[own]], "ring_id": ids, "distance": np.sqrt(d2), "distance2": d2, "_m": -metric})
        out["cluster_id"] = [hashlib.sha1(f"{scope}|{name}|{i}|{m}".encode()).hexdigest() for i, m in zip(out["cluster_index"], out["medoid_id"], strict=True)]
        out = out.sort_values(["cluster_index", "distance2", "_m", "ring_id"], kind="stable")
        out["assign_rank"] = out.groupby("cluster_index").cumcount() + 1
        return out[[c.split()[0] for c in MEMBERS.split(", ")]]

    large = [r["subregion"] for r in rows.groupBy("subregion").count().where(F.col("count") > limit).select("subregion").collect()]
    small = rows.where(~F.col("subregion").isin(*large)) if large else rows
    out = small.groupBy("subregion").applyInPandas(work, MEMBERS)
    for name in large:
        out = out.unionByName(_large_clusters(materialize(rows.where(F.col("subregion") == name), "subregion"), name, (k_map or {}).get(name, k), auto, scope))
    return out


Medoid = tuple[str, float, float, float]


def _pick(rows: DataFrame, score: str) -> Medoid:
    """The row of least score; of those equal to within EPS, of greatest metric, then least id: two grouped minima."""
    least = rows.agg(F.min(score)).first()[0]
    r = rows.where(F.col(score) <= least + EPS).orderBy(F.col("moi").desc_nulls_last(), "ring_id").select("ring_id", *XYZ).first()
    return (r[0], r[1], r[2], r[3])


def _assigned(points: DataFrame, medoids: list[Medoid]) -> DataFrame:
    """Points with _c, the number of the nearest medoid (the first of those equal to within EPS), and _d2."""
    far = F.array(*[F.struct(S.distance2("x", "y", "z", *[F.lit(float(v)) for v in m[1:]]).alias("d2"), F.lit(i).alias("c")) for i, m in enumerate(medoids)])
    least = F.array_min(far).getField("d2")
    return points.withColumn("_n", F.get(F.filter(far, lambda m: m["d2"] <= least + EPS), 0)).withColumns({"_c": F.col("_n.c"), "_d2": F.col("_n.d2")}).drop("_n")


def _candidates(assigned: DataFrame, pivots: int = 8) -> DataFrame:
    """``assigned`` with _may, false for points that cannot be of the least cost in their cluster by the triangle inequality (see ``medoid_costs``).

    The pivots are the point nearest to the cluster's mean and some of least hashes; their costs are sums over all points, taken at once.
    """
    centers = F.broadcast(assigned.groupBy("_c").agg(*[F.avg(c).alias(f"_m{c}") for c in XYZ], F.count("*").alias("_many")))  # a row a cluster
    place = F.struct(*XYZ)
    near = F.min_by(place, S.distance2("x", "y", "z", "_mx", "_my", "_mz"))
    chosen = assigned.join(centers, "_c").groupBy("_c", "_many").agg(F.array(near, *[F.min_by(place, F.xxhash64("ring_id", F.lit(j))) for j in range(pivots - 1)]).alias("_pivots"))
    chosen = F.broadcast(materialize(chosen, "pivots"))
    far = lambda p: S.distance("x", "y", "z", p["x"], p["y"], p["z"])
    joined = assigned.join(chosen, "_c")
    sums = joined.groupBy("_c").agg(F.array(*[F.sum(far(F.col("_pivots")[j])) for j in range(pivots)]).alias("_sums"))
    known = joined.join(F.broadcast(materialize(sums, "pivot-sums")), "_c")
    bound = F.greatest(*[F.abs(F.col("_many") * far(F.col("_pivots")[j]) - F.col("_sums")[j]) for j in range(pivots)])
    return known.withColumn("_may", bound <= F.array_min("_sums") * (1 + 1e-9) + EPS).drop("_many", "_pivots", "_sums")


def _costs(assigned: DataFrame, block: int) -> DataFrame:
    """Candidates with cost, the sum of their distances to all members of their cluster.

    The members lie in blocks of about ``block`` points; every block of candidates meets every block of members of its cluster once,
    as two arrays, so no pair of points is a row and no task holds more than two blocks.
    """
    n = max(1, -(-assigned.count() // block))
    blocked = _candidates(assigned).withColumn("_b", F.pmod(F.xxhash64("ring_id"), F.lit(n)))
    held = materialize(blocked.groupBy("_c", "_b").agg(F.sort_array(F.collect_list(F.struct("ring_id", *XYZ, "moi", "_may"))).alias("all")), "blocks")
    held = held.withColumn("own", F.filter("all", lambda p: p["_may"]))
    others = held.select("_c", F.col("_b").alias("_o"), F.transform("all", lambda p: F.array(p["x"], p["y"], p["z"])).alias("members"))

    @F.pandas_udf("array<double>")
    def sums(own: pd.Series, members: pd.Series) -> pd.Series:
        def one(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            a, b = np.stack(a), np.stack(b)
            return np.array([np.sqrt(squared(b, p)).sum() for p in a])

        return pd.Series([one(a, b) for a, b in zip(own, members, strict=True)])

    # each block goes to the tasks of its pairs of blocks, so that one cluster's pairs spread over many
    pairs = lambda df, other: df.join(F.broadcast(numbers), "_c").withColumn(other, F.explode("_all"))
    numbers = held.groupBy("_c").agg(F.collect_list("_b").alias("_all"))  # a row a cluster, a number a block
    met = pairs(held.where(F.size("own") > 0).drop("all"), "_o").drop("_all").join(pairs(others, "_b").drop("_all"), ["_c", "_b", "_o"]).select("_c", "_b", "own", sums(F.transform("own", lambda p: F.array(p["x"], p["y"], p["z"])), "members").alias("part"))
    rows = met.select("_c", F.explode(F.arrays_zip("own", "part")).alias("z")).select("_c", *[F.col(f"z.own.{c}").alias(c) for c in ("ring_id", *XYZ, "moi")], F.col("z.part").alias("part"))
    return rows.groupBy("_c", "ring_id", *XYZ, "moi").agg(F.sum("part").alias("cost"))


def _large_medoids(points: DataFrame, k: int, rounds: int = 10, block: int = 2000) -> list[Medoid]:
    """``k_medoids`` of one group by Spark jobs; the medoids, k of them at most, are what the driver holds."""
    center = points.agg(*[F.avg(c) for c in XYZ]).first()
    first = points.withColumn("_s", sum((F.pow(F.col(c) - F.lit(v), 2) for c, v in zip(XYZ, center, strict=True)), F.lit(0.0)))
    chosen = [_pick(first, "_s")]
    while len(chosen) < k:
        left = _assigned(points, chosen).where(~F.col("ring_id").isin(*[m[0] for m in chosen])).withColumn("_s", -F.col("_d2"))
        if left.isEmpty():
            break
        chosen.append(_pick(left, "_s"))
    medoids = sorted(chosen)
    for _ in range(rounds):
        costs = materialize(_costs(_assigned(points, medoids), block), "medoid-costs")
        new = []
        for c, old in enumerate(medoids):
            own = costs.where(F.col("_c") == c)
            new.append(old if own.isEmpty() else _pick(own, "cost"))
        if (new := sorted(set(new))) == medoids:
            break
        medoids = new
    return medoids


def _large_clusters(points: DataFrame, name: str, k: int | None, auto: bool, scope: str) -> DataFrame:
    """``stage_clusters`` of one subregion that is too large for one task."""
    from quillon.functions.quantiles import ranked

    if k is None and auto:
        radius, most = POLICY.get(points.first()["band"].lower(), POLICY["outer"])
        for k in range(1, most + 1):
            medoids = _large_medoids(points, k)
            if math.sqrt(_assigned(points, medoids).agg(F.max("_d2")).first()[0]) <= radius + EPS:
                break
    else:
        k = k or 1
        medoids = _large_medoids(points, k)
    ids = F.array(*[F.lit(m[0]) for m in medoids])
    out = _assigned(points, medoids).withColumns({"cluster_index": F.col("_c") + 1, "medoid_id": F.get(ids, F.col("_c")), "k": F.lit(k)})
    out = out.withColumn("cluster_id", F.sha1(F.concat_ws("|", F.lit(scope), F.lit(name), F.col("cluster_index").cast("string"), "medoid_id")))
    numbered = ranked(out, ["cluster_index"], [F.col("_d2"), F.col("moi").desc_nulls_last(), F.col("ring_id")])
    return numbered.select("subregion", "k", "cluster_index", "cluster_id", "medoid_id", "ring_id", F.sqrt("_d2").alias("distance"), F.col("_d2").alias("distance2"), (F.col("idx") + 1).cast("int").alias("assign_rank"))


def placed_clusters(clusters: DataFrame, regions: DataFrame, rings: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Clusters (medoid_id and ``keys``) with the place x, y, z of their medoid: from its row of the regions, else from the rings' table."""
    first = regions.select(*keys, F.col("ring_id").alias("medoid_id"), *[F.col(c).alias(f"_i{c}") for c in XYZ])
    second = rings.select(F.col("ring_id").alias("medoid_id"), *[F.col(c).alias(f"_r{c}") for c in XYZ])
    joined = clusters.join(first, [*keys, "medoid_id"], "left").join(second, "medoid_id", "left")
    return joined.select(*clusters.columns, *[F.coalesce(f"_i{c}", f"_r{c}").alias(c) for c in XYZ])


def cluster_stats(members: DataFrame) -> DataFrame:
    """Per cluster: size, greatest distance, low 90th percentile, cost."""
    from quillon.functions.quantiles import floor_quantiles

    keys = ["subregion", "cluster_index", "cluster_id", "medoid_id"]
    p90 = floor_quantiles(members, keys, "distance2", "ring_id", {"p90": 0.9}).select(*keys, F.sqrt("p90").alias("radius_p90"))
    return members.groupBy(*keys).agg(F.count("*").alias("size_n"), F.max("distance").alias("radius_max"), F.sum("distance").alias("cost_sum")).join(p90, keys)


ROUTE = "route string, seq int, ring_id string, x double, y double, z double, step double, cumulative double"


def greedy_route(points: DataFrame, start: tuple[float, float, float] | None = None, list_order: bool = False, limit: int = 2_000_000) -> DataFrame:
    """Routes (columns route, ring_id, x, y, z, moi) that always go to the nearest point left, from ``start`` or the best point.

    Of equally near ones the greater metric goes first, then the lesser id; with ``list_order`` the better ranked one, and a
    missing coordinate counts as no distance. A step looks the nearest point up in a k-d tree from which visited points go, so a route of n
    points takes some n log n; with ``list_order`` all points left are compared in each step, and a route may have a hundredth of ``limit``.
    """
    bounded_groups(points, ["route"], limit // 100 if list_order else limit)

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(_m=rows["moi"].astype(float).fillna(-np.inf)).sort_values(["_m", "ring_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        xyz, ids, metric = rows[XYZ].to_numpy(float), rows["ring_id"].to_numpy(object), rows["_m"].to_numpy()
        at, order, steps = np.array(start, float) if start else xyz[0], [], []
        if list_order:
            left = np.ones(len(rows), bool)
            while left.any():
                d2 = squared(xyz, at)
                d2 = np.where(np.isnan(d2), 0.0, d2)
                order.append(int(np.flatnonzero(left)[np.argmin(d2[left])]))
                steps.append(math.sqrt(d2[order[-1]]))
                left[order[-1]], at = False, xyz[order[-1]]
        else:
            remaining = Remaining(xyz)
            for _ in range(len(rows)):
                near, d2 = remaining.nearest(at, EPS)
                k = choose(d2, metric[near], ids[near], np.ones(len(near), bool)) if len(near) > 1 else 0
                order.append(int(near[k]))
                steps.append(math.sqrt(d2[k]))
                remaining.remove(order[-1])
                at = xyz[order[-1]]
        out = rows.iloc[order].assign(seq=range(1, len(order) + 1), step=steps, cumulative=np.cumsum(steps))
        return out[[c.split()[0] for c in ROUTE.split(", ")]]

    source = points.select("route", "ring_id", *XYZ, "moi") if list_order else points.select("route", "ring_id", *XYZ, "moi").where("x is not null and y is not null and z is not null")
    return source.groupBy("route").applyInPandas(work, ROUTE)


def itinerary(summaries: DataFrame, members: DataFrame, group: str, start: tuple[float, float, float], limit: int = 10_000) -> DataFrame:
    """Regions in greedy order of their centroids (ties: lesser radius, then name), each with its entry ring.

    The entry is the member nearest to the centroid before (to ``start`` at first); ties go to the greater metric, then the lesser id.
    """
    order = "seq int, region string, from_x double, from_y double, from_z double, leg double"

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["radius_max", "region"], kind="stable").reset_index(drop=True)
        xyz, at, left, out = rows[["centroid_x", "centroid_y", "centroid_z"]].to_numpy(float), np.array(start, float), list(range(len(rows))), []
        while left:
            d = np.sqrt(squared(xyz[left], at))
            i = left[int(np.flatnonzero(d <= d.min() + EPS)[0])]
            out.append((len(out) + 1, rows["region"][i], *at, float(np.sqrt(squared(xyz[i], at)))))
            left.remove(i)
            at = xyz[i]
        return pd.DataFrame(out, columns=[c.split()[0] for c in order.split(", ")])

    regions = summaries.select(F.col(group).alias("region"), "centroid_x", "centroid_y", "centroid_z", "radius_max").withColumn("_all", F.lit(1))
    bounded_groups(regions, ["_all"], limit)
    walked = regions.groupBy("_all").applyInPandas(lambda rows: walk(rows), order)
    met = members.join(broadcast_if_small(walked), F.col(group) == F.col("region"))
    d = F.sqrt(F.pow(F.col("x") - F.col("from_x"), 2) + F.pow(F.col("y") - F.col("from_y"), 2) + F.pow(F.col("z") - F.col("from_z"), 2))
    entry = met.groupBy("seq", "region", "leg").agg(F.min(F.struct(d.alias("distance"), (-F.coalesce("moi", F.lit(-1e300))).alias("m"), "ring_id")).alias("e"))
    return entry.select("seq", "region", "leg", F.col("e.ring_id").alias("entry_id"), F.col("e.distance").alias("entry_distance"))


SEQUENCE = "subregion string, sequence int, cluster_index int, cluster_id string, medoid_id string, from_cluster string, leg double, staging_required boolean"


def sequence_clusters(clusters: DataFrame, start: tuple[float, float, float], max_leg: float = 8000.0, lookahead: int = 3, limit: int = 10_000) -> DataFrame:
    """Clusters (columns subregion, cluster_index, cluster_id, medoid_id, x, y, z, size_n, p90) of each subregion in visiting order.

    Of the ``lookahead`` nearest ones the one of least step score comes next: distance, a penalty beyond ``max_leg``, less 250 times
    the log of the size, plus 50 times p90. Every subregion begins at ``start``; a leg beyond ``max_leg`` wants a staging point.
    """
    bounded_groups(clusters, ["subregion"], limit)

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["cluster_index", "medoid_id", "cluster_id"], kind="stable").reset_index(drop=True)
        xyz, at, left, out, last = rows[XYZ].to_numpy(float), np.array(start, float), list(range(len(rows))), [], "START"
        extra = -250.0 * np.log1p(rows["size_n"].to_numpy(float)) + 50.0 * rows["p90"].to_numpy(float)
        while left:
            d = dict(zip(left, np.sqrt(squared(xyz[left], at)), strict=True))
            near = sorted(left, key=lambda i: (d[i], i))[:lookahead]
            score = {i: d[i] + (1e5 if d[i] > max_leg else 0.0) + extra[i] for i in near}
            low = min(score.values())
            i = min((i for i in near if score[i] <= low + EPS), key=lambda i: (d[i], i))
            row = rows.iloc[i]
            out.append((row["subregion"], len(out) + 1, int(row["cluster_index"]), row["cluster_id"], row["medoid_id"], last, float(d[i]), bool(d[i] > max_leg)))
            left.remove(i)
            at, last = xyz[i], row["cluster_id"]
        return pd.DataFrame(out, columns=[c.split()[0] for c in SEQUENCE.split(", ")])

    return clusters.select("subregion", "cluster_index", "cluster_id", "medoid_id", *XYZ, "size_n", "p90").groupBy("subregion").applyInPandas(work, SEQUENCE)


def sequence_targets(sequence: DataFrame, members: DataFrame) -> DataFrame:
    """The members of the sequenced clusters in order of their visit: the medoid first, then by distance and id."""
    from pyspark.sql import Window

    order = Window.partitionBy("subregion", "sequence").orderBy((F.col("ring_id") != F.col("medoid_id")).asc(), "distance", "ring_id")
    joined = sequence.select("subregion", "sequence", "cluster_id").join(members, ["subregion", "cluster_id"])
    return joined.withColumn("target_order", F.row_number().over(order))


def latest_run(runs: DataFrame, scope: list[str]) -> DataFrame:
    """The last run of each scope by created_utc, then run_id."""
    pick: Callable = lambda c: F.max_by(c, F.struct("created_utc", "run_id"))
    return runs.groupBy(*scope).agg(*[pick(c).alias(c) for c in runs.columns if c not in scope])


def export_candidates(clusters: DataFrame, members: DataFrame, keys: tuple[str, ...] = ("cluster_id",)) -> tuple[DataFrame, DataFrame]:
    """(clusters by priority, members in cluster order): p90 from the members' distances, else the stored one.

    ``keys`` join clusters and members: all the scope's keys, where the tables hold several versions, cohorts or runs.
    """
    from pyspark.sql import Window

    from quillon.functions.quantiles import floor_quantiles

    by = list(keys)
    own = floor_quantiles(members, by, "distance", "ring_id", {"own_p90": 0.9}).select(*by, "own_p90")
    known = clusters.join(own, by, "left").withColumn("p90", F.coalesce("own_p90", "radius_p90"))
    known = known.withColumn("priority", S.cluster_priority("size_n", "p90"))
    scope = [c for c in by if c not in ("cluster_id", "subregion", "cluster_index")]
    order = Window.partitionBy("subregion", *scope).orderBy(F.col("priority").desc(), F.col("p90"), F.col("size_n").desc(), F.col("cluster_index"))
    out = known.withColumn("cluster_rank", F.row_number().over(order)).drop("own_p90")
    return out, members.join(out.select(*by, "cluster_rank"), by).orderBy("subregion", "cluster_rank", "assign_rank")
