"""Schemas of the engine's tables and the resolution of columns by name."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RINGS_RAW = (
    "ring_id string, system_name string, system_address bigint, x double, y double, z double, "
    "primary_star_spectral string, primary_star_type string, primary_star_subtype string, primary_star_luminosity string, primary_star_class string, "
    "body_name string, body_id bigint, body_type string, body_sub_type string, ring_name string, ring_type string, reserve_level string, "
    "mass double, inner_radius double, outer_radius double, ring_width double, ring_area double, surface_density double, linear_density double, "
    "arrival_distance_ls double, parent_body_gravity double, updated_at_utc string"
)
RINGS_SCORED = (
    "ring_id string, ring_type string, score_version string, computed_at string, moi_raw double, moi_normalized double, moi_final double, "
    "norm_population string, norm_count bigint, flags string"
)
LOG_EVENT = (
    "timestamp string, event string, StarSystem string, SystemName string, SystemAddress bigint, BodyName string, BodyID bigint, StarType string, Subclass int, "
    "PlanetClass string, ReserveLevel string, ProbesUsed int, Rings array<struct<Name: string, RingClass: string, MassMT: double, InnerRad: double, OuterRad: double, ReserveLevel: string>>, "
    "Signals array<struct<Type: string, Count: int>>"
)
#: Names under which a metric is looked for, best first.
METRICS = ("moi_final", "moi_normalized", "moi_raw", "moi0", "moi_0", "moi")


def metric_column(df: DataFrame, preferred: str | None = None) -> str:
    """The metric's column: ``preferred``, which must then be there, else the first known name."""
    if preferred:
        if preferred not in df.columns:
            raise ValueError(f"no metric column {preferred!r}; there are {', '.join(df.columns)}")
        return preferred
    for name in METRICS:
        if name in df.columns:
            return name
    raise ValueError(f"none of {', '.join(METRICS)} among {', '.join(df.columns)}")


def rank_column(df: DataFrame) -> str:
    return "rank" if "rank" in df.columns else "rank_in_cohort"


def coordinate_columns(df: DataFrame) -> tuple[str, str, str]:
    prefix = "system_" if "system_x" in df.columns else ""
    return (f"{prefix}x", f"{prefix}y", f"{prefix}z")


def first_present(tables: dict[str, DataFrame], *names: str) -> DataFrame:
    """The first table there under one of its names (preferred, then legacy)."""
    for name in names:
        if name in tables:
            return tables[name]
    raise ValueError(f"none of the tables {', '.join(names)}")


def with_missing(df: DataFrame, ddl: str) -> DataFrame:
    """``df`` with every column of the schema, the missing ones null: the additive migration."""
    wanted = [part.strip().split(" ", 1) for part in re.split(r",(?![^<]*>)", ddl)]
    return df.select(*[F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name) for name, kind in wanted], *[c for c in df.columns if c not in {n for n, _ in wanted}])


def alnum(name: str) -> str:
    return re.sub(r"[^0-9a-z]+", "", name.lower())


#: For each role, name patterns in order of preference and the weight of a table that has it.
ROLES: dict[str, tuple[tuple[str, ...], int]] = {
    "system": (("systemname", "starsystem", "system"), 3),
    "body": (("bodyname", "body"), 3),
    "ring": (("ringname", "name"), 2),
    "ring_class": (("ringclass", "ringtype", "class", "type"), 3),
    "mass": (("massmt", "mass"), 3),
    "inner": (("innerrad", "inner"), 3),
    "outer": (("outerrad", "outer"), 3),
    "x": (("systemx", "coordx", "x"), 1),
    "y": (("systemy", "coordy", "y"), 1),
    "z": (("systemz", "coordz", "z"), 1),
    "mapped": (("ismapped", "mapped", "wasmapped"), 1),
}


def resolve_roles(columns: list[str]) -> dict[str, str]:
    """role -> column of a table of unknown schema: patterns in order, an exact name before a part of one."""
    plain, found = {c: alnum(c) for c in columns}, {}
    for role, (patterns, _) in ROLES.items():
        for pattern in patterns:
            fits = [c for c in columns if plain[c] == pattern] or ([c for c in columns if pattern in plain[c]] if len(pattern) > 2 else [])
            if fits:
                found[role] = fits[0]
                break
    return found


def best_table(tables: dict[str, list[str]], needed: tuple[str, ...]) -> str | None:
    """The table whose columns fill the most of the roles by weight, among those that fill all of ``needed``; the first of equals."""
    best, most = None, 0
    for name, columns in tables.items():
        roles = resolve_roles(columns)
        score = sum(ROLES[r][1] for r in roles)
        if all(r in roles for r in needed) and score > most:
            best, most = name, score
    return best


def first_value(json: Column | str, *keys: str) -> Column:
    """The first of the keys of a JSON object text that is there and not null, as text. Keys are case-sensitive."""
    return F.coalesce(*[F.get_json_object(json, f"$.{key}") for key in keys])
