"""The two log rankings: the best rings of a sector by category, and tasking lists by a median-normalised score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import scalar as S
from quillon.functions.quantiles import medians
from quillon.session import broadcast_if_small

RING_KEY = ("system_name", "body_name", "ring_name")


def funnel_reason(ring_class: str = "ring_class", mass: str = "mass", inner: str = "inner", outer: str = "outer") -> Column:
    """Why a ring is left out, by the first test it fails; null if it stays."""
    area = S.ring_area_or_zero(inner, outer)
    return (
        F.when(S.category(ring_class).isNull(), "unknown_category")
        .when(F.col(mass).isNull() | F.col(inner).isNull() | F.col(outer).isNull(), "missing_mass_radii")
        .when(area <= 0, "invalid_radii")
        .when(S.surface_density_or_zero(mass, area) <= 0, "invalid_density")
    )


def through_funnel(rings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rings that pass, with category and surface_density; counters by reason)."""
    marked = rings.withColumn("reason", funnel_reason())
    area = S.ring_area_or_zero("inner", "outer")
    kept = marked.where("reason is null").withColumn("category", S.category("ring_class")).withColumn("surface_density", S.surface_density_or_zero("mass", area)).drop("reason")
    return kept, marked.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).count()


def system_places(systems: DataFrame, order: str | None = None) -> DataFrame:
    """(_key, p): a place for each system by normalised name. Of several the last by ``order``; without that the greatest, since rows have no order."""
    placed = systems.withColumn("_key", S.normal_name("system_name")).where("x is not null and y is not null and z is not null")
    place = F.struct("x", "y", "z")
    return placed.groupBy("_key").agg((F.max_by(place, F.struct(order, "x", "y", "z")) if order else F.max(place)).alias("p"))


def without_place(rings: DataFrame, systems: DataFrame) -> DataFrame:
    """Counter (reason, count) of the rings that ``with_distance`` leaves out, in the form of ``through_funnel``'s."""
    known = system_places(systems).select("_key")
    return rings.withColumn("_key", S.normal_name("system_name")).join(known, "_key", "left_anti").agg(F.lit("missing_coords").alias("reason"), F.count("*").alias("count"))


def with_distance(rings: DataFrame, systems: DataFrame, anchor: tuple[float, float, float], order: str | None = None) -> DataFrame:
    """Rings with the distance of their system (by normalised name) from the anchor; those of unknown systems go."""
    places = system_places(systems, order)
    joined = rings.withColumn("_key", S.normal_name("system_name")).join(places, "_key")
    return joined.withColumn("distance", S.distance("p.x", "p.y", "p.z", F.lit(anchor[0]), F.lit(anchor[1]), F.lit(anchor[2]))).drop("_key", "p")


def merge_sources(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row a ring of two sources (columns of ``RING_KEY``, category, surface_density, distance, mapped).

    The greater density stays, of equals the first source's; names and distance are the first source's where it has the ring; mapped
    if either says so.
    """
    both = first.withColumn("source_order", F.lit(0)).withColumn("source", F.lit("db")).unionByName(second.withColumn("source_order", F.lit(1)).withColumn("source", F.lit("journal")))
    keyed = both.withColumns({f"_k{i}": S.normal_name(c) for i, c in enumerate(RING_KEY)})
    best = F.max_by(F.struct("surface_density", "source", "category"), F.struct("surface_density", -F.col("source_order")))
    seen = F.min_by(F.struct(*RING_KEY, "distance"), F.struct("source_order", -F.col("surface_density"), *RING_KEY))
    merged = keyed.groupBy("_k0", "_k1", "_k2").agg(best.alias("b"), seen.alias("f"), F.bool_or("mapped").alias("mapped"))
    return merged.select("f.*", "b.*", "mapped")


def top_by_category(rings: DataFrame, limit: int = 10) -> DataFrame:
    """The densest rings of each category: density descending, distance, then names without case."""
    order = [F.col("surface_density").desc(), F.col("distance").asc(), *[F.lower(c).asc() for c in RING_KEY]]
    return rings.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy(*order))).where(F.col("rank") <= limit)


def with_top_flags(rings: DataFrame, top: DataFrame, view: str | None = None) -> DataFrame:
    """Every ring with its place in the top lists, by exact names; registered as a view if named."""
    flags = top.select(*RING_KEY, F.col("category").alias("top_category"), F.col("rank").alias("top_rank"), F.lit(True).alias("is_top"))
    out = rings.join(flags, list(RING_KEY), "left").withColumn("is_top", F.coalesce("is_top", F.lit(False)))
    if view:
        out.createOrReplaceTempView(view)
    return out


def body_key(address: str = "SystemAddress", system: str = "StarSystem", body: str = "BodyName") -> Column:
    """One key for a body: by the system's address where there is one, else by its name."""
    return F.concat_ws("|", F.coalesce(F.col(address).cast("string"), F.col(system)), F.col(body))


def resolved(rows: DataFrame, column: str, lookup: DataFrame, key: str, name: str, into: str) -> DataFrame:
    """``rows`` with the lookup's name for what a column says: that name itself if there is one so spelt, else the name of that key, else null.

    Keys are compared as texts. Of several rows of a key, the greatest name counts; nulls are neither names nor keys.
    """
    said = F.col(column).cast("string")
    names = lookup.where(F.col(name).isNotNull()).select(F.col(name).alias("_name")).distinct()
    keys = lookup.where(F.col(name).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("_key")).agg(F.max(name).alias("_of_key"))
    out = rows.join(broadcast_if_small(names), said == F.col("_name"), "left").join(broadcast_if_small(keys), said == F.col("_key"), "left")
    return out.withColumn(into, F.coalesce("_name", "_of_key")).drop("_name", "_key", "_of_key")


def log_rings(events: DataFrame) -> DataFrame:
    """The rings of Scan events, one row each."""
    scans = events.where("event = 'Scan'").withColumn("_key", body_key())
    return scans.select("_key", F.coalesce("StarSystem", F.lit("")).alias("system_name"), F.coalesce("BodyName", F.lit("")).alias("body_name"), "ReserveLevel", F.explode("Rings").alias("r")).select(
        "_key", "system_name", "body_name", F.col("r.Name").alias("ring_name"), F.col("r.RingClass").alias("ring_class"), F.col("ReserveLevel").alias("reserve_level"), F.coalesce("r.MassMT", F.lit(0.0)).alias("mass"), F.coalesce("r.InnerRad", F.lit(0.0)).alias("inner"), F.coalesce("r.OuterRad", F.lit(0.0)).alias("outer")
    )


def mapped_bodies(events: DataFrame) -> DataFrame:
    return events.where("event = 'SAAScanComplete' and coalesce(BodyName, '') <> ''").select(body_key().alias("_key")).distinct()


def hotspots(events: DataFrame) -> DataFrame:
    """Tritium and platinum entries by body; an entry counts once, whatever its own count says."""
    found = events.where("event = 'SAASignalsFound' and coalesce(BodyName, '') <> ''").select(body_key().alias("_key"), F.explode("Signals").alias("s"))
    return found.groupBy("_key").agg(*[F.count_if(F.col("s.Type") == t).alias(t.lower()) for t in ("Tritium", "Platinum")])


def rank_log(events: DataFrame, sigma_min: float | None = None, dedup: bool = False) -> DataFrame:
    """Pristine icy and metallic rings with their score for tritium and platinum.

    The density is normalised by one median over all of them. Repeated scans of a ring weigh in it, unless ``dedup``.
    """
    rings = log_rings(events).where((F.col("reserve_level") == "PristineResources") & F.col("ring_class").isin(S.LOG_CLASSES["icy"], S.LOG_CLASSES["metallic"], S.LOG_CLASSES["metallic_alt"]))
    if dedup:
        rings = rings.dropDuplicates()
    rings = rings.withColumn("surface_density", S.surface_density_or_zero("mass", S.ring_area_or_zero("inner", "outer")))
    median = medians(rings.where("surface_density > 0").select("surface_density"), [], "surface_density")
    scored = rings.crossJoin(F.broadcast(median)).withColumn("sigma_norm", F.coalesce(S.sigma("surface_density", "median"), F.lit(0.0))).drop("median")  # one row
    scored = scored.join(mapped_bodies(events).withColumn("mapped", F.lit(True)), "_key", "left").join(hotspots(events), "_key", "left")
    scored = scored.withColumn("mapped", F.coalesce("mapped", F.lit(False))).fillna(0, ["tritium", "platinum"])
    icy = F.col("ring_class") == S.LOG_CLASSES["icy"]
    scored = scored.withColumn("rmoi_tritium", F.when(icy, F.col("sigma_norm")).otherwise(0.0) * S.hotspot_factor("tritium", "mapped")).withColumn("rmoi_platinum", F.when(icy, 0.0).otherwise(F.col("sigma_norm")) * S.hotspot_factor("platinum", "mapped"))
    scored = scored.withColumn("dss_required", ~F.col("mapped"))
    return scored if sigma_min is None else scored.where(F.col("sigma_norm") >= sigma_min)


def tasking(ranked: DataFrame, metal: str, limit: int = 200) -> DataFrame:
    """The best rings for a metal, with names as the last tie-break."""
    return ranked.where(F.col(f"rmoi_{metal}") > 0).orderBy(F.col(f"rmoi_{metal}").desc(), F.col("mass").desc(), "system_name", "body_name", "ring_name").limit(limit)


def unmatched_mapping(events: DataFrame) -> DataFrame:
    """Mapping events of bodies none of whose rings were scanned."""
    known = log_rings(events).select("_key").distinct()
    mapping = events.where("event in ('SAAScanComplete', 'SAASignalsFound') and coalesce(BodyName, '') <> ''").withColumn("_key", body_key())
    return mapping.join(known, "_key", "left_anti").select("event", "timestamp", F.coalesce("StarSystem", F.lit("")).alias("system_name"), "BodyName")


def class_medians(rings: DataFrame, ring_class: str = "ring_class", density: str = "surface_density") -> DataFrame:
    """Median density and number of rings by sector type; rings with no density count but do not weigh."""
    typed = rings.select(S.sector_type(ring_class).alias("type"), F.col(density).alias("_d"))
    found = medians(typed.where("_d > 0"), ["type"], "_d").withColumnRenamed("type", "_type")
    counts = typed.groupBy("type").agg(F.count("*").alias("ring_count"))
    return counts.join(found, F.col("type").eqNullSafe(F.col("_type")), "left").select("type", "median", "ring_count")


def of_systems(events: DataFrame, systems: DataFrame) -> DataFrame:
    """Events of the systems of a sector, by normalised name (StarSystem, else SystemName); events without one go."""
    names = systems.select(S.normal_name("system_name").alias("_key")).where("_key <> ''").distinct()
    return events.withColumn("_key", S.normal_name(F.coalesce(F.nullif("StarSystem", F.lit("")), F.nullif("SystemName", F.lit(""))))).join(names, "_key", "left_semi").drop("_key")
