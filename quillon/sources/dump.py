"""The nested dump: system -> bodies -> rings, as JSON lines or one array document, plain or gzip."""

from __future__ import annotations

import gzip
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import scalar as S
from quillon.schema import first_value
from quillon.sources.arrays import read_array


def detect_format(path: str) -> str:
    """jsonl, document or unknown, by the first line that is not blank. For files that the driver can open."""
    with (gzip.open if path.endswith(".gz") else open)(path, "rt", encoding="utf-8", errors="replace") as f:
        first = next((line.strip() for line in f if line.strip()), "")
    if first.startswith("["):
        return "document"
    if first.startswith("{"):
        try:
            return "jsonl" if isinstance(json.loads(first), dict) else "document"
        except ValueError:
            return "document"
    return "unknown"


def read_systems(spark: SparkSession, path: str, kind: str = "jsonl", partitions: int | None = None) -> DataFrame:
    """One JSON text a system. Bad lines and what is no object go.

    An array document with one system a line can be read by lines; ``document`` reads arrays of any layout by blocks, many tasks a
    file, and fails on one that is cut off. A gzip file is one partition, so it is dealt out anew at once.
    """
    if kind == "document":
        rows = read_array(spark, path)
    else:
        line = F.regexp_replace(F.trim("value"), r"^\[\s*|\s*\]$|,$", "")
        rows = spark.read.text(path).select(line.alias("system")).where("system <> ''")
    if partitions:
        rows = rows.repartition(partitions)
    return rows.where(F.try_parse_json("system").isNotNull() & F.ltrim("system").startswith("{"))


def _parts(json_text: str, *keys: str) -> Column:
    """Elements (JSON texts) of the first of the array fields that is there; none if there is none."""
    arrays = F.from_json(first_value(json_text, *keys), "array<string>")
    return F.filter(F.coalesce(arrays, F.array().cast("array<string>")), lambda x: F.ltrim(x).startswith("{"))


def primary_star(bodies: Column) -> Column:
    """Spectral struct of the main star, else of the first star, among a system's bodies."""
    kind = lambda b: F.coalesce(first_value(b, "type", "bodyType", "class"), F.lit(""))
    stars = F.filter(bodies, lambda b: F.lower(kind(b)).contains("star") | (F.trim(F.coalesce(first_value(b, "starType", "StarType"), F.lit(""))) != ""))
    main = lambda found: F.filter(found, lambda b: F.coalesce(first_value(b, "mainStar", "isMainStar"), F.lit("false")) == "true")
    chosen = S.let(stars, lambda found: F.coalesce(F.get(main(found), 0), F.get(found, 0)))
    return S.let(chosen, lambda star: S.spectral(first_value(star, "spectralClass", "SpectralClass", "subType", "starType", "StarType")))


def flatten(systems: DataFrame, updated_at: str, limit: int | None = None) -> DataFrame:
    """A row per ring (schema RINGS_RAW); rings without a name, or of an unnamed body or system, go.

    Alternate key spellings are looked up in order; keys are case-sensitive. What belongs to a system or a body is read once for it,
    before its parts are taken apart.
    """
    v = first_value
    coords = lambda c: F.coalesce(F.get_json_object("system", f"$.coords.{c}"), F.when(F.get_json_object("system", "$.coords").isNull(), F.get_json_object("system", f"$.{c}"))).try_cast("double")
    own = systems.select(
        v("system", "name", "systemName", "StarSystem").alias("system_name"),
        S.safe_int(v("system", "id64", "systemAddress", "SystemAddress")).alias("system_address"),
        *[coords(c).alias(c) for c in "xyz"],
        _parts("system", "bodies", "Bodies").alias("bodies"),
    ).where("coalesce(system_name, '') <> ''")
    above = ["system_name", "system_address", "x", "y", "z", "star"]
    bodies = own.withColumn("star", primary_star(F.col("bodies"))).select(*above, F.explode("bodies").alias("body")).select(
        *above,
        v("body", "name", "Name", "bodyName", "BodyName").alias("body_name"),
        S.safe_int(v("body", "bodyId", "BodyID", "id")).alias("body_id"),
        v("body", "type", "bodyType", "class").alias("body_type"),
        v("body", "subType", "subtype", "subClass", "subclass", "planetClass").alias("body_sub_type"),
        S.safe_float(v("body", "distanceToArrival", "DistanceFromArrivalLS", "distanceFromArrivalLS")).alias("arrival_distance_ls"),
        S.safe_float(v("body", "gravity", "Gravity", "surfaceGravity", "SurfaceGravity")).alias("parent_body_gravity"),
        _parts("body", "rings", "Rings").alias("rings"),
    ).where("coalesce(body_name, '') <> ''")
    raw = bodies.select(*[c for c in bodies.columns if c != "rings"], F.explode("rings").alias("ring")).select(
        *[c for c in bodies.columns if c not in ("rings", "star")],
        *[F.col(f"star.{k}").alias(f"primary_star_{k}") for k in ("spectral", "type", "subtype", "luminosity", "class")],
        v("ring", "name", "Name", "ringName", "RingName").alias("ring_name"),
        v("ring", "ringClass", "RingClass", "type", "class").alias("ring_type"),
        v("ring", "reserveLevel", "ReserveLevel").alias("reserve_level"),
        S.safe_float(v("ring", "massMT", "MassMT", "mass")).alias("mass"),
        v("ring", "innerRad", "InnerRad", "innerRadius", "InnerRadius").alias("_inner"),
        v("ring", "outerRad", "OuterRad", "outerRadius", "OuterRadius").alias("_outer"),
    ).where("coalesce(ring_name, '') <> ''")
    sized = raw.withColumns({"inner_radius": S.safe_float("_inner"), "outer_radius": S.safe_float("_outer")})
    sized = sized.withColumns({"ring_width": S.ring_width("inner_radius", "outer_radius"), "ring_area": S.ring_area("inner_radius", "outer_radius")})
    sized = sized.withColumns({"surface_density": S.surface_density("mass", "ring_area"), "linear_density": S.linear_density("mass", "ring_width")})
    ident = S.sha1_id(F.coalesce(F.col("system_address").cast("string"), "system_name"), F.coalesce(F.col("body_id").cast("string"), "body_name"), "ring_name", S.id_part("_inner"), S.id_part("_outer"))
    columns = "ring_id system_name system_address x y z primary_star_spectral primary_star_type primary_star_subtype primary_star_luminosity primary_star_class body_name body_id body_type body_sub_type ring_name ring_type reserve_level mass inner_radius outer_radius ring_width ring_area surface_density linear_density arrival_distance_ls parent_body_gravity updated_at_utc"
    out = sized.withColumn("ring_id", ident).withColumn("updated_at_utc", F.lit(updated_at)).select(*columns.split())
    return out.orderBy("ring_id").limit(limit) if limit is not None else out


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON with its keys sorted at every level, ", " and ": " between, and ASCII only; of equal keys the last. Null where it is none."""

    def canonical(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text), ensure_ascii=True, sort_keys=True)
        except (ValueError, RecursionError):
            return None

    return texts.map(canonical)


def payloads(systems: DataFrame, mode: str) -> dict[str, DataFrame]:
    """JSON kept by mode, in its canonical form: none, ring, ring+body or all; one row a key."""
    v = first_value
    out: dict[str, DataFrame] = {}
    if mode == "none":
        return out
    named = systems.withColumn("system_key", F.coalesce(v("system", "id64", "systemAddress", "SystemAddress"), v("system", "name", "systemName", "StarSystem")))
    bodies = named.select("system_key", F.explode(_parts("system", "bodies", "Bodies")).alias("body")).withColumn("body_key", F.coalesce(v("body", "bodyId", "BodyID", "id"), v("body", "name", "Name")))
    rings = bodies.select("system_key", "body_key", F.explode(_parts("body", "rings", "Rings")).alias("ring")).withColumn("ring_name", v("ring", "name", "Name"))
    out["rings_payloads"] = rings.groupBy("system_key", "body_key", "ring_name").agg(F.min("ring").alias("raw_json"))
    if mode in ("ring+body", "all"):
        out["bodies_raw"] = bodies.groupBy("system_key", "body_key").agg(F.min("body").alias("raw_json"))
    if mode == "all":
        out["systems_raw"] = named.groupBy("system_key").agg(F.min("system").alias("raw_json"))
    return {name: df.withColumn("raw_json", canonical_json("raw_json")) for name, df in out.items()}


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """The table with the new rows in place of those of the same key; of several new rows the last by ``order`` counts.

    A null in the key is equal to no old row's, as for SQL's unique keys: old rows with one stay.
    """
    last = new.groupBy(*key).agg(*[F.max_by(F.struct(c), order)[c].alias(c) for c in new.columns if c not in key])
    return old.join(last.select(*key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def update_columns(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """The table with some columns taken from the new rows of the same key, the rest as it was; new keys are added."""
    n = new.select(*key, F.struct(*columns).alias("_new"))
    joined = old.join(n, key, "full_outer")
    return joined.select(*key, *[(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) if c in columns else F.col(c)).alias(c) for c in old.columns if c not in key])


