"""Known sites matched to rings by system and tokens, with the best candidate and its percentile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import scalar as S
from quillon.functions.quantiles import shares_at
from quillon.session import broadcast_if_small, materialize


def candidates(sites: DataFrame, rings: DataFrame) -> DataFrame:
    """Rings of each site's system (without case) whose body or ring name holds one of the site's planet tokens."""
    tokened = sites.select("source_url", "system_name", "planets", S.planet_tokens("planets").alias("tokens"), F.lower("system_name").alias("_key"))
    near = rings.select("ring_id", "body_name", "ring_name", F.lower("system_name").alias("_key"))
    met = tokened.join(near, "_key").where(S.token_matches(F.col("tokens"), "body_name") | S.token_matches(F.col("tokens"), "ring_name"))
    body = S.normal_name("body_name")
    return met.select("source_url", "ring_id", "body_name", "ring_name", S.token_matches_whole(F.col("tokens"), "body_name").alias("boundary"), F.exists("tokens", lambda k: body.contains(k)).alias("exactish"))


def ranked_candidates(matches: DataFrame, scores: DataFrame) -> DataFrame:
    """Candidates with their place: icy first, then whole-word, then partial matches, then scored ones by score, then id."""
    scored = matches.join(scores.select("ring_id", "ring_type", "moi_final"), "ring_id", "left")
    order = [(F.coalesce("ring_type", F.lit("")) != "Icy").asc(), F.col("boundary").desc(), F.col("exactish").desc(), F.col("moi_final").desc_nulls_last(), F.col("ring_id").asc()]
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("source_url").orderBy(*order)))


def best_matches(sites: DataFrame, rings: DataFrame, scores: DataFrame, icy_core: DataFrame | None = None) -> DataFrame:
    """A row per site: status, number of matches, best candidate, its share of its type's scores not above it, the top three.

    With ``icy_core``, members by ring_id, also whether the best candidate is one, and whether any candidate is.
    """
    ranked = ranked_candidates(candidates(sites, rings), scores)
    first = materialize(ranked.where("place = 1"), "best-candidates")
    shares = shares_at(scores, ["ring_type"], "moi_final", first, "percentile").select(F.col("ring_type").alias("_type"), F.col("moi_final").alias("_score"), "percentile")
    best = first.join(broadcast_if_small(shares), F.col("ring_type").eqNullSafe(F.col("_type")) & (F.col("moi_final") == F.col("_score")), "left").select("source_url", F.col("ring_id").alias("best_ring_id"), F.col("ring_type").alias("best_ring_type"), F.col("moi_final").alias("best_moi"), "percentile")
    text = F.concat_ws(":", "ring_id", F.coalesce(F.format_string("%.6f", "moi_final"), F.lit("")), F.coalesce("ring_type", F.lit("")))
    top = ranked.where("place <= 3").groupBy("source_url").agg(F.concat_ws("; ", F.transform(F.sort_array(F.collect_list(F.struct("place", text.alias("t")))), lambda x: x["t"])).alias("top_candidates"))
    counts = ranked.groupBy("source_url").agg(F.count("*").alias("matches"))
    out = sites.join(counts, "source_url", "left").join(best, "source_url", "left").join(top, "source_url", "left")
    n = F.coalesce("matches", F.lit(0))
    out = out.withColumn("matches", n).withColumn("status", F.when(n == 0, "NOT_FOUND").when(n == 1, "MATCHED").otherwise("MATCHED_MULTIPLE"))
    if icy_core is not None:
        members = icy_core.select(F.col("ring_id").alias("best_ring_id")).distinct().withColumn("in_icy_core", F.lit(True))
        out = out.join(members, "best_ring_id", "left").withColumn("in_icy_core", F.coalesce("in_icy_core", F.lit(False)))
        some = ranked.join(members.select(F.col("best_ring_id").alias("ring_id")), "ring_id", "left_semi").select("source_url").distinct().withColumn("any_in_icy_core", F.lit(True))
        out = out.join(some, "source_url", "left").withColumn("any_in_icy_core", F.coalesce("any_in_icy_core", F.lit(False)))
    return out.orderBy("system_name", "planets", "source_url")


def report_counts(matched: DataFrame) -> DataFrame:
    """One row: sites, sites by status, sites with a candidate in the core, and with the best one in it. For matches with ``icy_core``."""
    state = lambda name: F.count_if(F.col("status") == name)
    return matched.agg(
        F.count("*").alias("total_sites"), state("MATCHED").alias("matched"), state("MATCHED_MULTIPLE").alias("matched_multiple"), state("NOT_FOUND").alias("not_found"),
        F.count_if("any_in_icy_core").alias("in_core"), F.count_if("in_icy_core").alias("best_in_core"),
    )


def status_counts(matched: DataFrame) -> DataFrame:
    return matched.groupBy("status").count()


def site_table(sites: DataFrame) -> DataFrame:
    """One row a site key, the last by source_url."""
    keyed = sites.withColumn("site_key", S.site_key("system_name", "planets"))
    return keyed.groupBy("site_key").agg(*[F.max_by(c, "source_url").alias(c) for c in sites.columns])
