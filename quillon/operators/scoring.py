"""Scores, norms and cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import scalar as S
from quillon.functions.quantiles import floor_quantiles, rank_fraction, share_not_above, weighed
from quillon.session import broadcast_if_small

QUANTILES = {"p95": 0.95, "p99": 0.99, "p99_5": 0.995, "p99_9": 0.999}


def score(rings: DataFrame, version: str = "moi_v1", computed_at: str | None = None) -> DataFrame:
    """Raw composite score, its rank fraction over all scored rings (raw, ring_id), flags of missing inputs. Every ring stays."""
    raw = rings.select("ring_id", "ring_type", S.composite_score("surface_density", "linear_density", "arrival_distance_ls").alias("moi_raw"), S.missing_flags("surface_density", "linear_density", "arrival_distance_ls").alias("flags"))
    ranked = rank_fraction(raw, "moi_raw", "ring_id", "moi_normalized")
    stamp = F.lit(computed_at) if computed_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return ranked.select("ring_id", "ring_type", F.lit(version).alias("score_version"), stamp.alias("computed_at"), "moi_raw", "moi_normalized", F.col("moi_normalized").alias("moi_final"), F.lit("all_scored").alias("norm_population"), "norm_count", "flags")


def moments(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """n, mean, population deviation (0 for one value), min and max of the known values; a group without any has no row."""
    return df.where(F.col(value).isNotNull()).groupBy(*group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("stddev"), F.min(value).alias("min"), F.max(value).alias("max"))


def norms(df: DataFrame, group: list[str], value: str, ident: str, quantiles: dict[str, float] | None = None) -> DataFrame:
    """Moments and exact low quantiles of a metric by group."""
    base, tails = moments(df, group, value), floor_quantiles(df, group, value, ident, quantiles or QUANTILES).drop("n")
    return base.join(tails, group)


def norms_of_metrics(df: DataFrame, group: list[str], metrics: list[str], ident: str) -> DataFrame:
    """``norms`` of several metrics, one row per (group, metric)."""
    pairs = ", ".join(f"'{m}', `{m}`" for m in metrics)
    long = df.selectExpr(*group, ident, f"stack({len(metrics)}, {pairs}) as (metric, value)")
    return norms(long, [*group, "metric"], "value", ident)


def top_rows(df: DataFrame, group: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each group with their rank; the limit is pushed below the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= n)


def cohort(df: DataFrame, group: list[str], value: str, ident: str, target: int, strict: bool = True) -> DataFrame:
    """Members 1..target of each group by value descending, id ascending, with theta (the last one's value and id).

    With ``strict``, a group with fewer known values is an error.
    """
    ranked = top_rows(df.where(F.col(value).isNotNull()), group, [F.col(value).desc(), F.col(ident).asc()], target, "rank_in_cohort")
    theta = ranked.groupBy(*group).agg(F.max_by(value, "rank_in_cohort").alias("theta_value"), F.max_by(ident, "rank_in_cohort").alias("theta_id"), F.max("rank_in_cohort").alias("_have"))
    if strict and (short := theta.where(F.col("_have") < target).first()):
        raise ValueError(f"{ {g: short[g] for g in group} } has {short['_have']} rows, and {target} are asked for")
    return ranked.join(broadcast_if_small(theta.drop("_have")), group)


def best(df: DataFrame, value: str, ident: str, n: int, arrival: str | None = None) -> DataFrame:
    """The n best rows: value descending with nulls last, then the nearer to arrival, unknown ones last, then id ascending."""
    near = [F.col(arrival).asc_nulls_last()] if arrival else []
    return df.orderBy(F.col(value).desc_nulls_last(), *near, F.col(ident).asc()).limit(n)


def percentile_of_known(df: DataFrame, group: list[str], value: str, name: str = "percentile") -> DataFrame:
    """The share of the group's known values that are not greater."""
    shares = share_not_above(df, group, value, name).select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate([*group, value])], name)
    same = F.lit(True)
    for i, c in enumerate([*group, value]):
        same = same & F.col(c).eqNullSafe(F.col(f"_s{i}"))
    return df.where(F.col(value).isNotNull()).join(shares, same).drop(*[f"_s{i}" for i in range(len(group) + 1)])


#: Percentile buckets, and where each begins.
BUCKETS = (("<0.50", 0.0), ("0.50-0.80", 0.5), ("0.80-0.95", 0.8), ("0.95-0.99", 0.95), (">=0.99", 0.99))


def bucket(percentile: Column) -> Column:
    out = F.when(percentile < BUCKETS[1][1], BUCKETS[0][0])
    for (name, _), (_, end) in zip(BUCKETS[1:], [*BUCKETS[2:], ("", None)], strict=True):
        out = out.when((percentile < end) if end else percentile.isNotNull(), name)
    return out


def histogram(df: DataFrame, percentile: str, weight: str | None = None) -> DataFrame:
    """Rows per bucket, zeros too; null percentiles are left out. With ``weight`` a row counts so often."""
    names = df.sparkSession.createDataFrame([(b,) for b, _ in BUCKETS], "bucket string")
    counts = df.where(F.col(percentile).isNotNull()).groupBy(bucket(F.col(percentile)).alias("bucket")).agg((F.sum(weight) if weight else F.count("*")).alias("count"))
    return F.broadcast(names).join(counts, "bucket", "left").select("bucket", F.coalesce("count", F.lit(0)).cast("bigint").alias("rows"))


def percentile_histogram(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Rows per bucket of the share of their group's known values that are not greater: counted on the different values, so no row is joined."""
    shares = weighed(df, group, value).withColumn("_share", (F.col("idx") + F.col("_w")) / F.col("n"))
    return histogram(shares, "_share", "_w")
