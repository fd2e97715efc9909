"""The registered queries: the engine's operators on the given tables, each with the same thing in DuckDB SQL where SQL can say it.

Computed doubles are rounded alike on both sides. Points are the first three numbers of the embeddings; a metric is the fourth.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import scalar as S
from quillon.functions.quantiles import medians, rank_fraction
from quillon.operators import crosswalk, ranking, routes, scoring, sites, spatial
from quillon.session import materialize, shared_dir
from quillon.sources import dump
from quillon.sources.versions import VersionedTable
from quillon.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *[e[i].cast("double").alias(c) for i, c in enumerate("xyz")], e[3].cast("double").alias("moi"))


POINTS = "with p as (select vec_id, label, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z, embedding[4]::double as moi from embeddings)"


# --- norms, scores, cohorts ------------------------------------------------------------------------------------------------------


@query("""
with r as (select o_orderpriority as ring_type, o_totalprice as v, row_number() over (partition by o_orderpriority order by o_totalprice, o_orderkey) - 1 as i,
  count(*) over (partition by o_orderpriority) as n from orders)
select ring_type, count(*) as n, round(avg(v), 4) as mean, round(stddev_pop(v), 4) as stddev, min(v) as "min", max(v) as "max",
  max(case when i = floor((n - 1) * 0.95) then v end) as p95, max(case when i = floor((n - 1) * 0.99) then v end) as p99,
  max(case when i = floor((n - 1) * 0.995) then v end) as p99_5, max(case when i = floor((n - 1) * 0.999) then v end) as p99_9
from r group by ring_type""")
def norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("ring_type"), "o_totalprice", "o_orderkey")
    out = scoring.norms(orders, ["ring_type"], "o_totalprice", "o_orderkey")
    return out.select("ring_type", "n", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"), "min", "max", *scoring.QUANTILES)


@query("""
with l as (select c_mktsegment as seg, 'acctbal' as metric, c_acctbal as value, c_custkey as id from customer
  union all select c_mktsegment, 'nation', c_nationkey::double, c_custkey from customer),
r as (select *, row_number() over (partition by seg, metric order by value, id) - 1 as i, count(*) over (partition by seg, metric) as n from l)
select seg, metric, count(*) as n, round(avg(value), 4) as mean, max(case when i = floor((n - 1) * 0.95) then value end) as p95 from r group by seg, metric""")
def norms_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").cast("double").alias("nation"), "c_custkey")
    return scoring.norms_of_metrics(c, ["seg"], ["acctbal", "nation"], "c_custkey").select("seg", "metric", "n", F.round("mean", 4).alias("mean"), "p95")


@query("""
select o_orderkey, round((row_number() over (order by o_totalprice, o_orderkey) - 1) / (count(*) over () - 1)::double, 9) as moi_normalized, count(*) over () as norm_count from orders""")
def rank_fraction_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return rank_fraction(orders, "o_totalprice", "o_orderkey", "f").select("o_orderkey", F.round("f", 9).alias("moi_normalized"), "norm_count")


@query("""
with s as (select o_orderkey, sum(l_extendedprice) as sd, max(nullif(l_discount, 0.0)) as ld, min(nullif(l_tax, 0.0)) as arr from orders join lineitem on l_orderkey = o_orderkey group by 1),
m as (select o_orderkey, 0.70 * sd + 0.25 * ld + 0.05 * case when arr is null then 0.0 else 1.0 / (1.0 + greatest(arr, 0.0)) end as raw,
  concat_ws('|', case when arr is null then 'missing_arrival_distance_ls' end, case when ld is null then 'missing_linear_density' end, case when sd is null then 'missing_surface_density' end) as flags from s)
select o_orderkey, round(raw, 4) as moi_raw, flags, (select count(raw) from m) as norm_count from m""")
def composite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    per = per.groupBy(F.col("l_orderkey").alias("ring_id")).agg(F.sum("l_extendedprice").alias("surface_density"), F.max(F.nullif("l_discount", F.lit(0.0))).alias("linear_density"), F.min(F.nullif("l_tax", F.lit(0.0))).alias("arrival_distance_ls"))
    out = scoring.score(per.withColumn("ring_type", F.lit("x")), computed_at="1970-01-01T00:00:00Z")
    return out.select(F.col("ring_id").alias("o_orderkey"), F.round("moi_raw", 4).alias("moi_raw"), "flags", "norm_count")


@query("""
with r as (select o_orderpriority, o_orderkey, o_totalprice, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as rank_in_cohort from orders),
k as (select * from r where rank_in_cohort <= 100)
select k.*, t.o_totalprice as theta_value, t.o_orderkey as theta_id from k join k t on t.o_orderpriority = k.o_orderpriority and t.rank_in_cohort = 100""")
def cohort_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return scoring.cohort(orders, ["o_orderpriority"], "o_totalprice", "o_orderkey", 100)


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls last, o_orderkey limit 100")
def best_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.best(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 100)


@query("""
select o_orderpriority, count(*) as orders, count(distinct o_custkey) as customers from orders group by 1""")
def counts_by_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("customers"))


@query("""
with c as (select cume_dist() over (partition by o_orderpriority order by o_totalprice) as p from orders),
b as (select case when p < 0.5 then '<0.50' when p < 0.8 then '0.50-0.80' when p < 0.95 then '0.80-0.95' when p < 0.99 then '0.95-0.99' else '>=0.99' end as bucket from c)
select v.bucket, count(b.bucket) as rows from (values ('<0.50'), ('0.50-0.80'), ('0.80-0.95'), ('0.95-0.99'), ('>=0.99')) v(bucket) left join b on b.bucket = v.bucket group by 1""")
def percentile_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.percentile_histogram(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")


@query("""
with m as (select p_type, median(p_retailprice) as med, count(*) as ring_count from part group by 1), g as (select median(p_retailprice) as med from part),
s as (select p_partkey, p_retailprice / m.med as s1, p_retailprice / g.med as s2, ring_count from part join m using (p_type), g)
select p_partkey, round(s1, 9) as sigma, round(s2, 9) as galactic_sigma, round((s1 - 1.0) * 100.0, 6) as delta_pct, ring_count,
  case when (s2 - 1.0) * 100.0 >= 99 then 'red' when (s2 - 1.0) * 100.0 >= 90 then 'green' else 'black' end as tier,
  case when s1 >= 3 then 99 when s1 >= 2.5 then 95 when s1 >= 2 then 90 when s1 >= 1.5 then 80 when s1 >= 1 then 50 else trunc(s1 * 50)::int end as percentile from s""")
def sigma_and_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    by_type = part.groupBy("p_type").agg(F.count("*").alias("ring_count")).join(medians(part.select("p_type", "p_retailprice"), ["p_type"], "p_retailprice", "med"), "p_type")
    total = medians(part.select("p_retailprice"), [], "p_retailprice", "gmed")
    joined = part.join(by_type, "p_type").crossJoin(F.broadcast(total))  # one row
    s = joined.withColumn("s", S.sigma("p_retailprice", "med")).withColumn("g", S.sigma("p_retailprice", "gmed"))
    return s.select("p_partkey", F.round("s", 9).alias("sigma"), F.round("g", 9).alias("galactic_sigma"), F.round(S.delta_percent("s"), 6).alias("delta_pct"), "ring_count", S.tier(S.delta_percent("g")).alias("tier"), S.sigma_percentile("s").alias("percentile"))


@query("""
with m as (select p_partkey, case p_size % 5 when 0 then 'eRingClass_Icy' when 1 then 'eRingClass_Metalic' when 2 then 'eRingClass_MetalRich' when 3 then 'eRingClass_Rocky' else 'x' end as cls,
  case p_partkey % 4 when 0 then 'PristineResources' when 1 then 'MajorResources' when 2 then 'Depleted' end as res, p_retailprice / (select median(p_retailprice) from part) as s from part),
c as (select *, coalesce(res, 'Unknown') as r, case when cls = 'eRingClass_Icy' then 'Icy' else 'Metallic' end as kind, printf('%.2f', s) as t,
  case when s >= 3 then 99 when s >= 2.5 then 95 when s >= 2 then 90 when s >= 1.5 then 80 when s >= 1 then 50 else trunc(s * 50)::int end as p from m)
select p_partkey,
  case when cls = 'eRingClass_Rocky' or cls = 'x' then false when r = 'PristineResources' then s >= 1.1 when s >= 2.25 then true when r in ('MajorResources', 'CommonResources') then false else s >= 1.5 end as should_scan,
  round(case when cls in ('eRingClass_Rocky', 'x') then 0 when r = 'PristineResources' and s >= 1.5 then s * 2 when r = 'PristineResources' and s >= 1.1 then s when r = 'PristineResources' then 0
    when s >= 2.25 then s * 1.5 when r in ('MajorResources', 'CommonResources') then 0 when s >= 1.5 then s else 0 end, 6) as priority,
  case when cls = 'eRingClass_Rocky' then 'Rocky (low value)' when cls = 'x' then 'Unknown ring class: x' when r = 'PristineResources' and s >= 1.5 then 'Pristine ' || kind || ', σ=' || t || ' (top ' || (100 - p) || '%)'
    when r = 'PristineResources' and s >= 1.1 then 'Pristine ' || kind || ', above median density' when r = 'PristineResources' then 'Pristine ' || kind || ' (density below median)'
    when s >= 2.25 then 'Exceptionally dense (' || r || '), σ=' || t when r in ('MajorResources', 'CommonResources') then r || ', σ=' || t || ' (low priority)'
    when s >= 1.5 then 'Unknown reserves, high density (σ=' || t || ')' else 'Unknown reserves, low density' end as reason from c""")
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    cls = F.when(F.col("p_size") % 5 == 0, S.LOG_CLASSES["icy"]).when(F.col("p_size") % 5 == 1, S.LOG_CLASSES["metallic"]).when(F.col("p_size") % 5 == 2, S.LOG_CLASSES["metal_rich"]).when(F.col("p_size") % 5 == 3, S.LOG_CLASSES["rocky"]).otherwise("x")
    res = F.when(F.col("p_partkey") % 4 == 0, "PristineResources").when(F.col("p_partkey") % 4 == 1, "MajorResources").when(F.col("p_partkey") % 4 == 2, "Depleted")
    joined = part.crossJoin(F.broadcast(medians(part.select("p_retailprice"), [], "p_retailprice", "m")))  # one row
    r = joined.withColumn("r", S.recommendation(cls, res, S.sigma("p_retailprice", "m"), F.lit(True), F.lit(False)))
    return r.select("p_partkey", "r.should_scan", F.round("r.priority", 6).alias("priority"), "r.reason")


# --- names and text --------------------------------------------------------------------------------------------------------------


@query("""
select p_partkey, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) as name, regexp_replace(lower(p_name), '[^0-9a-z]+', '', 'g') as identifier, regexp_replace(p_name, '[^0-9A-Za-z]+', '_', 'g') as slug,
  case when lower(p_type) like '%icy%' then 'icy' when lower(p_type) like '%rocky%' then 'rocky' when lower(p_type) like '%metallic%' then 'metallic' when lower(p_type) like '%metal%' or lower(p_type) like '%rich%' then 'metal_rich' end as sector_type,
  sha1(concat_ws('|', p_partkey::varchar, p_brand, p_name)) as id from part""")
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", S.normal_name("p_name").alias("name"), S.identifier("p_name").alias("identifier"), S.slug("p_name").alias("slug"), S.sector_type("p_type").alias("sector_type"), S.sha1_id(F.col("p_partkey").cast("string"), "p_brand", "p_name").alias("id"))


@query("""
with h as (select page_id, url, regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1) as hs from pages),
u as (select url, unnest(hs) as href, unnest(range(len(hs))) as pos from h)
select url, regexp_replace(href, '[?#].*$', '') as link, min(pos)::bigint as pos from u group by 1, 2""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.page_links(table(spark, sf_dir, "pages"))


@query("""
select regexp_replace(url, '[?#].*$', '') as source_url, count(*) as pages, max(page_id) as last_page from pages group by 1""")
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(S.canonical_url("url").alias("source_url")).agg(F.count("*").alias("pages"), F.max("page_id").alias("last_page"))


@query()
def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of every page by the site parser; the parser's rules are held against small pages in the tests."""
    return sites.parse_sites(table(spark, sf_dir, "pages")).select("source_url", "system_name", "description", "parse_warnings", "tritium_explicit", "tritium_inferred")


@query("""
select event_id, (props->>'$.k')::bigint as k, coalesce(props->>'$.K', props->>'$.k') as first_key, event_type from events where event_type in ('view', 'click')""")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.schema import first_value

    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    return e.select("event_id", S.safe_int(first_value("props", "k")).alias("k"), first_value("props", "K", "k").alias("first_key"), "event_type")


# --- merges and top lists --------------------------------------------------------------------------------------------------------

MERGED = """
with a as (select c_mktsegment as category, lower(c_name) as body_name, o_totalprice as d, o_orderdate from customer join orders on o_custkey = c_custkey),
db as (select category, body_name, max(d) as d from a where o_orderdate < timestamp '1997-01-01' group by 1, 2),
jr as (select category, body_name, max(d) as d from a where o_orderdate >= timestamp '1996-01-01' group by 1, 2),
u as (select category, body_name, greatest(coalesce(db.d, 0), coalesce(jr.d, 0)) as surface_density, case when coalesce(jr.d, -1) > coalesce(db.d, -1) then 'journal' else 'db' end as source, db.d is null or jr.d is null as alone
  from db full join jr using (category, body_name))"""


def _two_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice", "o_orderdate")
    rows = table(spark, sf_dir, "customer").join(orders, "c_custkey").select(F.col("c_mktsegment").alias("category"), F.lit("s").alias("system_name"), F.col("c_name").alias("body_name"), F.lit("r").alias("ring_name"), "o_totalprice", "o_orderdate")
    early, late = F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"), F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")
    per = rows.groupBy("category", "system_name", "body_name", "ring_name").agg(F.max(F.when(early, F.col("o_totalprice"))).alias("db"), F.max(F.when(late, F.col("o_totalprice"))).alias("log"))
    per = materialize(per, "two-sources")  # both sources from one pass over the orders
    source = lambda c: per.where(F.col(c).isNotNull()).select("category", "system_name", "body_name", "ring_name", F.col(c).alias("surface_density"), F.lit(0.0).alias("distance"), F.lit(False).alias("mapped"))
    return source("db"), source("log")


@query(MERGED + " select category, body_name, surface_density, source from u")
def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.merge_sources(*_two_sources(spark, sf_dir))
    return out.select("category", F.lower("body_name").alias("body_name"), "surface_density", "source")


@query(MERGED + """ select category, body_name, surface_density, source, rank from
 (select *, row_number() over (partition by category order by surface_density desc, body_name) as rank from u) where rank <= 10""")
def top_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.top_by_category(ranking.merge_sources(*_two_sources(spark, sf_dir)), 10)
    return out.select("category", F.lower("body_name").alias("body_name"), "surface_density", "source", "rank")


@query("""
select case when l_returnflag = 'R' then 'unknown_category' when l_discount = 0 or l_tax = 0 then 'missing_mass_radii' when l_linenumber::double <= l_quantity / 10 then 'invalid_radii' else 'kept' end as reason, count(*) as count
from lineitem group by 1""")
def validity_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") != "R", "Icy").alias("ring_class"), F.nullif("l_discount", F.lit(0.0)).alias("mass"), F.when(F.col("l_tax") != 0, F.col("l_quantity") / 10).alias("inner"), F.col("l_linenumber").cast("double").alias("outer"))
    return ranking.through_funnel(rings)[1]


# The log of a survey: an order is a body, its lines are rings; two of three orders are scanned, those of status F mapped.
LOG = """
with b as (select o_orderkey, 'O' || o_orderkey as body_name, 'C' || o_custkey as system_name, o_orderkey % 3 <> 0 as scanned, o_orderstatus = 'F' as mapped,
  case when o_orderpriority like '1%' then 2 when o_orderpriority like '2%' then 1 else 0 end as tritium, case when o_orderpriority like '5%' then 1 else 0 end as platinum, o_orderpriority not like '3%' as pristine from orders),
r as (select b.*, 'R' || l_linenumber as ring_name, l_extendedprice as mass, case l_returnflag when 'N' then 'icy' when 'A' then 'metallic' else 'rocky' end as type,
  l_extendedprice / (pi() * ((l_linenumber + l_quantity) * (l_linenumber + l_quantity) - l_linenumber * l_linenumber)) as d from lineitem join b on l_orderkey = o_orderkey where scanned),
k as (select *, d / (select median(d) from r where pristine and type <> 'rocky') as s, 1.0 + case when mapped then ln(1.0 + tritium) else 0 end as ft, 1.0 + case when mapped then ln(1.0 + platinum) else 0 end as fp from r where pristine and type <> 'rocky'),
z as (select *, case when type = 'icy' then s else 0.0 end * ft as rt, case when type = 'icy' then 0.0 else s end * fp as rp from k)"""


def survey_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the form of the log, made of orders (bodies) and their lines (rings)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.concat(F.lit("C"), "o_custkey").alias("StarSystem"), F.concat(F.lit("O"), "o_orderkey").alias("BodyName"))
    kind = F.when(F.col("l_returnflag") == "N", S.LOG_CLASSES["icy"]).when(F.col("l_returnflag") == "A", S.LOG_CLASSES["metallic"]).otherwise(S.LOG_CLASSES["rocky"])
    ring = F.struct(F.concat(F.lit("R"), "l_linenumber").alias("Name"), kind.alias("RingClass"), F.col("l_extendedprice").alias("MassMT"), F.col("l_linenumber").cast("double").alias("InnerRad"), (F.col("l_linenumber") + F.col("l_quantity")).alias("OuterRad"))
    rings = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(ring).alias("Rings"))
    none, key = F.lit(None), F.lit(None).cast("bigint").alias("SystemAddress")
    scans = o.where("o_orderkey % 3 <> 0").join(rings, "o_orderkey").select(F.lit("Scan").alias("event"), F.lit("t").alias("timestamp"), key, "StarSystem", "BodyName", F.when(~F.col("o_orderpriority").startswith("3"), "PristineResources").alias("ReserveLevel"), "Rings", none.cast("array<struct<Type: string, Count: int>>").alias("Signals"))
    blank = [none.cast("string").alias("ReserveLevel"), none.cast(scans.schema["Rings"].dataType).alias("Rings")]
    mapped = o.where("o_orderstatus = 'F'").select(F.lit("SAAScanComplete").alias("event"), F.lit("t").alias("timestamp"), key, "StarSystem", "BodyName", *blank, none.cast("array<struct<Type: string, Count: int>>").alias("Signals"))
    hot = F.when(F.col("o_orderpriority").startswith("1"), F.array(F.lit("Tritium"), F.lit("Tritium"))).when(F.col("o_orderpriority").startswith("2"), F.array(F.lit("Tritium"))).when(F.col("o_orderpriority").startswith("5"), F.array(F.lit("Platinum")))
    signals = F.transform(hot, lambda t: F.struct(t.alias("Type"), F.lit(7).alias("Count")))
    found = o.where(hot.isNotNull()).select(F.lit("SAASignalsFound").alias("event"), F.lit("t").alias("timestamp"), key, "StarSystem", "BodyName", *blank, signals.alias("Signals"))
    return scans.unionByName(mapped).unionByName(found)


@query(LOG + " select system_name, body_name, ring_name, mapped, tritium, platinum, not mapped as dss_required, round(s, 9) as sigma_norm, round(rt, 9) as rmoi_tritium, round(rp, 9) as rmoi_platinum from z")
def log_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.rank_log(materialize(survey_log(spark, sf_dir), "log"))
    return out.select("system_name", "body_name", "ring_name", "mapped", "tritium", "platinum", "dss_required", *[F.round(c, 9).alias(c) for c in ("sigma_norm", "rmoi_tritium", "rmoi_platinum")])


@query(LOG + " select system_name, body_name, ring_name, round(mass, 4) as mass, round(rt, 9) as rmoi_tritium from z where rt > 0 order by rt desc, mass desc, system_name, body_name, ring_name limit 200")
def log_tasking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.tasking(ranking.rank_log(materialize(survey_log(spark, sf_dir), "log")), "tritium", 200)
    return out.select("system_name", "body_name", "ring_name", F.round("mass", 4).alias("mass"), F.round("rmoi_tritium", 9).alias("rmoi_tritium"))


@query(LOG + """ select 'C' || o_custkey || '|O' || o_orderkey as body, coalesce(mapped, false) as mapped, tritium, platinum from orders
 left join (select o_orderkey as k, mapped, tritium, platinum from b) on k = o_orderkey where mapped or tritium + platinum > 0""")
def mapped_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = materialize(survey_log(spark, sf_dir), "log")
    both = ranking.mapped_bodies(log).withColumn("mapped", F.lit(True)).join(ranking.hotspots(log), "_key", "full")
    return both.select(F.col("_key").alias("body"), F.coalesce("mapped", F.lit(False)).alias("mapped"), F.coalesce("tritium", F.lit(0)).alias("tritium"), F.coalesce("platinum", F.lit(0)).alias("platinum"))


@query(LOG + """ select system_name, body_name as "BodyName", 'SAAScanComplete' as event from b where not (scanned and o_orderkey in (select l_orderkey from lineitem)) and mapped union all select system_name, body_name, 'SAASignalsFound' from b where not (scanned and o_orderkey in (select l_orderkey from lineitem)) and tritium + platinum > 0""")
def unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.unmatched_mapping(materialize(survey_log(spark, sf_dir), "log")).select("system_name", "BodyName", "event")


@query(LOG + " select case type when 'rocky' then 'rocky' when 'icy' then 'icy' else 'metal_rich' end as type, round(median(d), 9) as median, count(*) as ring_count from r group by 1")
def class_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = ranking.log_rings(survey_log(spark, sf_dir)).withColumn("surface_density", S.surface_density_or_zero("mass", S.ring_area_or_zero("inner", "outer")))
    return ranking.class_medians(rings).select("type", F.round("median", 9).alias("median"), "ring_count")


@query("""
with n as (select distinct user_id from events where event_type = 'signup')
select event_id, 'U ' || user_id as system_name from events where user_id in (select user_id from n) and event_type = 'view'""")
def sector_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the systems of a sector; their names differ in case and spaces."""
    e = table(spark, sf_dir, "events")
    log = e.where("event_type = 'view'").select("event_id", F.concat(F.lit("U "), "user_id").alias("StarSystem"), F.lit(None).cast("string").alias("SystemName"))
    systems = e.where("event_type = 'signup'").select(F.concat(F.lit(" u  "), "user_id").alias("system_name"))
    return ranking.of_systems(log, systems).select("event_id", F.col("StarSystem").alias("system_name"))


DUMP = """
with r as (select 'C' || o_custkey as system_name, o_custkey as system_address, 'O' || o_orderkey as body_name, 'R' || l_linenumber as ring_name, l_extendedprice as mass, l_linenumber as a, l_linenumber + l_quantity - 5 as b from orders join lineitem on l_orderkey = o_orderkey)"""


def dump_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested systems as JSON texts: customers, their orders as bodies and the lines of these as rings; every other system in the other spelling of the keys."""
    ring = F.struct(F.concat(F.lit("R"), "l_linenumber").alias("name"), F.col("l_extendedprice").alias("massMT"), F.col("l_linenumber").alias("innerRad"), (F.col("l_linenumber") + F.col("l_quantity") - 5).alias("outerRad"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(ring).alias("rings"))
    bodies = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey").select("o_custkey", F.struct(F.concat(F.lit("O"), "o_orderkey").alias("name"), "rings").alias("body"))
    systems = bodies.groupBy("o_custkey").agg(F.collect_list("body").alias("bodies"))
    first = F.to_json(F.struct(F.concat(F.lit("C"), "o_custkey").alias("name"), F.col("o_custkey").alias("id64"), "bodies"))
    other = F.to_json(F.struct(F.concat(F.lit("C"), "o_custkey").alias("StarSystem"), F.col("o_custkey").alias("SystemAddress"), F.col("bodies").alias("Bodies")))
    return systems.select(F.when(F.col("o_custkey") % 2 == 0, first).otherwise(other).alias("system"))


@query(DUMP + """ select system_name, system_address, body_name, ring_name, round(mass, 4) as mass, case when b > a then b - a end as ring_width, round(case when b > a then pi() * (b * b - a * a) end, 6) as ring_area,
 round(case when b > a then mass / (pi() * (b * b - a * a)) end, 6) as surface_density, round(case when b > a then mass / (b - a) end, 6) as linear_density from r""")
def flattened_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dump.flatten(dump_of_orders(spark, sf_dir), "1970-01-01T00:00:00Z")
    return out.select("system_name", "system_address", "body_name", "ring_name", F.round("mass", 4).alias("mass"), "ring_width", *[F.round(c, 6).alias(c) for c in ("ring_area", "surface_density", "linear_density")])


@query("select o_orderkey as order_key, o_custkey as customer, o_orderstatus as status, o_totalprice as price, o_orderpriority as priority from orders")
def array_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders written as array documents of one line, some 20,000 elements each, and read back by blocks."""
    orders = table(spark, sf_dir, "orders")
    files = orders.count() // 20_000 + 1
    element = F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.struct(F.col("o_custkey").alias("id")).alias("customer"), F.struct(F.col("o_totalprice").alias("price"), F.array("o_orderstatus", "o_orderpriority").alias("marks")).alias("own")))
    documents = orders.groupBy(F.pmod(F.xxhash64("o_orderkey"), F.lit(files))).agg(F.concat(F.lit("["), F.concat_ws(", ", F.collect_list(element)), F.lit("]")).alias("value"))
    path = f"{shared_dir(spark).rstrip('/')}/arrays-{uuid.uuid4().hex}"
    documents.select("value").repartition(files).write.text(path)
    of = lambda key: F.get_json_object("system", f"$.{key}")
    return dump.read_systems(spark, path, "document").select(of("key").cast("bigint").alias("order_key"), of("customer.id").cast("bigint").alias("customer"), of("own.marks[0]").alias("status"), of("own.price").cast("double").alias("price"), of("own.marks[1]").alias("priority"))


@query(DUMP + " select 'bodies_raw' as payload, count(distinct body_name) as keys from r union all select 'rings_payloads', count(distinct body_name || ring_name) from r union all select 'systems_raw', count(distinct system_name) from r")
def payload_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dump.payloads(materialize(dump_of_orders(spark, sf_dir), "dump"), "all")
    out = None
    for name in sorted(kept):
        row = kept[name].agg(F.lit(name).alias("payload"), F.count("*").alias("keys"))
        out = row if out is None else out.unionByName(row)
    return out


@query("""
with e as (select *, event_id % 3 <> 0 as later from events)
select user_id, event_type, case when bool_or(later) then max_by(event_id, struct_pack(a := later, b := event_id)) else max(event_id) end as event_id,
 max_by(value, struct_pack(a := later, b := event_id)) as value from e group by 1, 2""")
def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the events is the table as it stands, by key; the others are upserted into it."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value").withColumn("_seq", F.col("event_id"))
    key, old = ["user_id", "event_type"], e.where("event_id % 3 = 0")
    stands = dump.upsert(old.where("false"), old, key, "_seq")
    return dump.upsert(stands, e.where("event_id % 3 <> 0"), key, "_seq").drop("_seq")


@query("""
with e as (select *, event_id % 3 <> 0 as later from events)
select user_id, event_type, case when bool_or(later) then max_by(event_id, struct_pack(a := later, b := event_id)) else max(event_id) end as event_id,
 max_by(value, struct_pack(a := later, b := event_id)) as value from e group by 1, 2""")
def merged_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a table in versions: a third of the events is its first version, the others are merged into the files that they meet."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    new = e.where("event_id % 3 <> 0")
    first = e.where("event_id % 3 = 0").groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))
    held = VersionedTable(spark, f"{shared_dir(spark).rstrip('/')}/versions-{uuid.uuid4().hex}", ["user_id", "event_type"], rows_per_file=50_000)
    held.overwrite(first)
    held.upsert(new, "event_id")
    return held.read()


@query("""
select o_orderkey, o_orderpriority, o_orderstatus, o_totalprice from orders where o_orderpriority not in ('1-URGENT', '5-LOW')
union all select o_orderkey, o_orderpriority, o_orderstatus, -o_totalprice from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F'""")
def replaced_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two priorities are replaced in one version; for one of them there is nothing new, so it becomes empty."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    held = VersionedTable(spark, f"{shared_dir(spark).rstrip('/')}/versions-{uuid.uuid4().hex}", ["o_orderpriority", "o_orderkey"], rows_per_file=500_000)
    held.overwrite(orders)
    new = orders.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").withColumn("o_totalprice", -F.col("o_totalprice"))
    held.replace(new, spark.createDataFrame([("1-URGENT",), ("5-LOW",)], "o_orderpriority string"))
    return held.read()


@query("""select event_id, '{"event": {"k": ' || json_extract_string(props, '$.k') || ', "type": "' || event_type || '"}, "ids": [' || event_id || ', {"user": ' || user_id || '}], "text": "\\u00e9' || event_type || '", "value": ' || cast(value as varchar) || '}' as raw_json from events""")
def canonical_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON with keys out of order, in its canonical form."""
    text = F.format_string('{"value":%s,"text":"é%s","ids":[%d,{"user":%d}],"event":{"type":"%s","k":%s}}', F.col("value").cast("string"), "event_type", "event_id", "user_id", "event_type", F.get_json_object("props", "$.k"))
    return table(spark, sf_dir, "events").select("event_id", dump.canonical_json(text).alias("raw_json"))


@query("""
with a as (select user_id, event_id, value from events where event_type = 'purchase'), b as (select user_id, event_id, value * 2 as value from events where event_type = 'click'),
x as (select user_id, max(value) as v from a group by 1), y as (select user_id, max(value) as v from b group by 1)
select user_id, case when y.user_id is not null then y.v else x.v end as v from x full join y using (user_id)""")
def updated_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    old = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("value").alias("v"))
    new = e.where("event_type = 'click'").groupBy("user_id").agg(F.max(F.col("value") * 2).alias("v"))
    return dump.update_columns(old, new, ["user_id"], ["v"])


@query("""
select event_id, round(sum(value) over (partition by user_id order by ts rows unbounded preceding), 4) as cumulative, coalesce(lag(event_type) over (partition by user_id order by ts), 'START') as from_cluster from events""")
def cumulative_and_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts")
    return table(spark, sf_dir, "events").select("event_id", F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("cumulative"), F.lag("event_type", 1, "START").over(w).alias("from_cluster"))


# --- space -----------------------------------------------------------------------------------------------------------------------

BANDS = POINTS + """,
t as (select *, degrees(atan2(z, x)) as theta, sqrt(x * x + y * y + z * z) as rho from p),
q as (select *, case when theta >= -45 and theta < 45 then 'E' when theta >= 45 and theta < 135 then 'N' when theta >= 135 or theta < -135 then 'W' else 'S' end as quadrant from t),
i as (select *, row_number() over (partition by quadrant order by rho, vec_id) - 1 as i, count(*) over (partition by quadrant) as n from q),
c as (select quadrant, max(case when i = floor((n - 1) * 0.3333333333) then rho end) as p33, max(case when i = floor((n - 1) * 0.6666666667) then rho end) as p66 from i group by 1),
b as (select q.*, case when rho <= p33 then 'inner' when rho <= p66 then 'mid' else 'outer' end as band from q join c using (quadrant))"""


def _banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.bands(spatial.quadrants(points(spark, sf_dir), (0.0, 0.0, 0.0)), "vec_id", (0.0, 0.0, 0.0))


@query(BANDS + " select vec_id, round(theta, 6) as theta_deg, round(rho, 6) as rho, quadrant, band, quadrant || '-' || band as subregion from b")
def quadrants_and_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _banded(spark, sf_dir).select("vec_id", F.round("theta_deg", 6).alias("theta_deg"), F.round("rho", 6).alias("rho"), "quadrant", "band", "subregion")


@query(BANDS + """,
g as (select quadrant || '-' || band as subregion, count(*) as n, avg(x) as cx, avg(y) as cy, avg(z) as cz, max(moi) as moi_max, median(moi) as moi_median, min(vec_id) as min_id from b group by 1)
select g.subregion, any_value(n) as n, round(any_value(cx), 6) as centroid_x, round(any_value(moi_max), 6) as moi_max, round(any_value(moi_median), 6) as moi_median, any_value(min_id) as min_id,
 round(max(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz))), 6) as radius_max from b join g on g.subregion = quadrant || '-' || band group by 1""")
def region_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spatial.summaries(_banded(spark, sf_dir), "subregion", "vec_id", "moi")
    return out.select("subregion", "n", F.round("centroid_x", 6).alias("centroid_x"), F.round("moi_max", 6).alias("moi_max"), F.round("moi_median", 6).alias("moi_median"), "min_id", F.round("radius_max", 6).alias("radius_max"))


@query(POINTS + """, w as (select vec_id as seq, x, y, z from p where label = 0), d as (select p.vec_id, w.seq, (p.x-w.x)*(p.x-w.x)+(p.y-w.y)*(p.y-w.y)+(p.z-w.z)*(p.z-w.z) as d2 from p, w where p.label <> 0 and p.moi >= 0),
n as (select vec_id, sqrt(min(d2)) as d, arg_min(seq, struct_pack(a := d2, b := seq)) as seq from d group by 1)
select vec_id, round(d, 6) as distance_to_route, seq as source_waypoint_seq from n where d <= 0.1""")
def route_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    out = spatial.proximity(p.where("label <> 0"), p.where("label = 0").withColumn("seq", F.col("vec_id")), "vec_id", "moi", 0.1, 0.0)
    return out.select("vec_id", F.round("distance_to_route", 6).alias("distance_to_route"), "source_waypoint_seq")


@query(POINTS + """, w as (select vec_id as seq, x, y, z from p where label = 0), d as (select p.vec_id, p.moi, w.seq, (p.x-w.x)*(p.x-w.x)+(p.y-w.y)*(p.y-w.y)+(p.z-w.z)*(p.z-w.z) as d2 from p, w where p.label <> 0),
k as (select distinct vec_id from (select *, row_number() over (partition by seq order by moi desc, vec_id) as r from d where d2 <= 0.1 * 0.1 + 1e-12) where r <= 2)
select vec_id, round(sqrt(min(d2)), 6) as distance_to_route, arg_min(seq, struct_pack(a := d2, b := seq)) as source_waypoint_seq from d where vec_id in (select vec_id from k) group by 1""")
def proximity_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    out = spatial.proximity_top(p.where("label <> 0"), p.where("label = 0").withColumn("seq", F.col("vec_id")), "vec_id", "moi", 0.1, 2)
    return out.select("vec_id", F.round("distance_to_route", 6).alias("distance_to_route"), "source_waypoint_seq")


@query(POINTS + " select a.vec_id, b.vec_id as r_vec_id from p a join p b on a.vec_id < b.vec_id and (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 0.05 * 0.05")
def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("vec_id", "x", "y", "z")
    return spatial.near_pairs(p, p, 0.05).where("vec_id < r_vec_id").select("vec_id", "r_vec_id")


@query("with recursive " + POINTS[5:] + """, e as (select a.vec_id as a, b.vec_id as b from p a join p b on (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 0.05 * 0.05),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on e.a = r.b) select a as vec_id, min(b) as comp from r group by 1""")
def threshold_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.components(points(spark, sf_dir), "vec_id", 0.05).select("vec_id", "comp")


SWEEP = (0.05, 0.1, 0.2)


@query("with recursive " + POINTS[5:] + """, t as (select unnest([0.05, 0.1, 0.2])::double as threshold),
e as (select t.threshold, a.vec_id as a, b.vec_id as b from t, p a join p b on (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= threshold * threshold),
r(threshold, a, b) as (select threshold, a, b from e union select r.threshold, r.a, e.b from r join e on e.a = r.b and e.threshold = r.threshold),
c as (select threshold, a, min(b) as comp from r group by 1, 2), s as (select threshold, comp, count(*) as size from c group by 1, 2)
select threshold, count(*) as clusters, max(size) as largest, count(*) filter (size = 1) as single from s group by 1""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.sweep(points(spark, sf_dir), "vec_id", list(SWEEP))


@query("with recursive " + POINTS[5:] + """, t as (select unnest([0.05, 0.1, 0.2])::double as threshold, unnest([1, 2, 3]) as level),
e as (select level, a.vec_id as a, b.vec_id as b from t, p a join p b on (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= threshold * threshold),
r(level, a, b) as (select level, a, b from e union select r.level, r.a, e.b from r join e on e.a = r.b and e.level = r.level),
c as (select level, a, min(b) as comp from r group by 1, 2 union all select 0, vec_id, vec_id from p)
select distinct l.comp as node, u.comp as parent, u.level from c l join c u on u.a = l.a and u.level = l.level + 1 where l.comp <> u.comp""")
def threshold_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.threshold_tree(points(spark, sf_dir), "vec_id", list(SWEEP))


@query()
def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic k-means of all points; held against brute force in the tests."""
    return spatial.kmeans(points(spark, sf_dir), "vec_id", "moi", 8)[0].select("vec_id", "cluster", F.round("d2", 9).alias("d2"))


@query()
def staged_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-medoids of each whole subregion; held against brute force and known cases in the tests."""
    banded = _banded(spark, sf_dir).withColumn("ring_id", F.format_string("%09d", "vec_id"))
    return routes.stage_clusters(banded, k=3).drop("cluster_id").withColumn("distance", F.round("distance", 9)).withColumn("distance2", F.round("distance2", 9))


GREEDY = "with recursive " + BANDS[5:] + """,
co as (select quadrant as route, vec_id, x, y, z, moi, row_number() over (partition by quadrant order by moi desc, vec_id) as k from b qualify k <= 60),
w as (select route, 1 as seq, vec_id, x, y, z, 0.0::double as step, [vec_id] as seen from co where k = 1
  union all select * exclude (pos) from (select co.route, w.seq + 1 as seq, co.vec_id, co.x, co.y, co.z, sqrt((co.x-w.x)*(co.x-w.x)+(co.y-w.y)*(co.y-w.y)+(co.z-w.z)*(co.z-w.z)) as step, list_append(w.seen, co.vec_id) as seen,
    row_number() over (partition by co.route order by (co.x-w.x)*(co.x-w.x)+(co.y-w.y)*(co.y-w.y)+(co.z-w.z)*(co.z-w.z), co.moi desc, co.vec_id) as pos from w join co on co.route = w.route and not list_contains(w.seen, co.vec_id)) where pos = 1)"""


@query(GREEDY + " select route, seq::int as seq, vec_id, round(step, 6) as step, round(sum(step) over (partition by route order by seq rows unbounded preceding), 6) as cumulative from w")
def greedy_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy routes through the cohort of the 60 best points of each quadrant."""
    best = scoring.cohort(_banded(spark, sf_dir).select("quadrant", "vec_id", "x", "y", "z", "moi"), ["quadrant"], "moi", "vec_id", 60, strict=False)
    out = routes.greedy_route(best.select(F.col("quadrant").alias("route"), F.format_string("%09d", "vec_id").alias("ring_id"), "x", "y", "z", "moi"))
    return out.select("route", "seq", F.col("ring_id").cast("bigint").alias("vec_id"), F.round("step", 6).alias("step"), F.round("cumulative", 6).alias("cumulative"))


@query("with recursive " + BANDS[5:] + """,
g as (select quadrant || '-' || band as region, avg(x) as cx, avg(y) as cy, avg(z) as cz from b group by 1),
w as (select 0 as seq, 'start' as region, 1.0::double as cx, 0.0::double as cy, 0.0::double as cz, 0.0::double as fx, 0.0::double as fy, 0.0::double as fz, 0.0::double as leg, ['start'] as seen
  union all select * exclude (pos) from (select w.seq + 1 as seq, g.region, g.cx, g.cy, g.cz, w.cx as fx, w.cy as fy, w.cz as fz, sqrt((g.cx-w.cx)*(g.cx-w.cx)+(g.cy-w.cy)*(g.cy-w.cy)+(g.cz-w.cz)*(g.cz-w.cz)) as leg, list_append(w.seen, g.region) as seen,
    row_number() over (order by (g.cx-w.cx)*(g.cx-w.cx)+(g.cy-w.cy)*(g.cy-w.cy)+(g.cz-w.cz)*(g.cz-w.cz), g.region) as pos from w join g on not list_contains(w.seen, g.region)) where pos = 1),
m as (select w.seq, w.region, w.leg, b.vec_id, sqrt((b.x-fx)*(b.x-fx)+(b.y-fy)*(b.y-fy)+(b.z-fz)*(b.z-fz)) as d, row_number() over (partition by w.seq order by (b.x-fx)*(b.x-fx)+(b.y-fy)*(b.y-fy)+(b.z-fz)*(b.z-fz), moi desc, vec_id) as pos from w join b on b.quadrant || '-' || b.band = w.region)
select seq::int as seq, region, round(leg, 6) as leg, vec_id as entry, round(d, 6) as entry_distance from m where pos = 1""")
def region_itinerary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy order of the subregions with their entry points."""
    banded = _banded(spark, sf_dir).withColumn("ring_id", F.format_string("%09d", "vec_id"))
    out = routes.itinerary(spatial.summaries(banded, "subregion", "ring_id", "moi"), banded, "subregion", (1.0, 0.0, 0.0))
    return out.select("seq", "region", F.round("leg", 6).alias("leg"), F.col("entry_id").cast("bigint").alias("entry"), F.round("entry_distance", 6).alias("entry_distance"))


# Clusters for sequencing: the points of a quadrant with one label, about their mean.
LABELLED = BANDS + """,
o as (select quadrant as subregion, label as cluster_index, avg(x) as x, avg(y) as y, avg(z) as z, count(*) as size_n from b group by 1, 2),
e as (select b.vec_id, o.*, sqrt((b.x-o.x)*(b.x-o.x)+(b.y-o.y)*(b.y-o.y)+(b.z-o.z)*(b.z-o.z)) as d from b join o on b.quadrant = o.subregion and b.label = o.cluster_index),
f as (select *, row_number() over (partition by subregion, cluster_index order by d, vec_id) - 1 as i from e),
u as (select subregion, cluster_index, any_value(x) as x, any_value(y) as y, any_value(z) as z, any_value(size_n) as size_n, max(case when i = floor((size_n - 1) * 0.9) then d end) as p90, max(d) as radius_max, sum(d) as cost from f group by 1, 2)"""


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(clusters, members) of the points of a quadrant with one label."""
    p = _banded(spark, sf_dir).select(F.col("quadrant").alias("subregion"), F.col("label").alias("cluster_index"), "vec_id", "x", "y", "z")
    means = p.groupBy("subregion", "cluster_index").agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"], F.count("*").alias("size_n"))
    ident = F.concat_ws("/", "subregion", F.col("cluster_index").cast("string"))
    members = p.join(means.drop("size_n"), ["subregion", "cluster_index"]).select("subregion", "cluster_index", ident.alias("cluster_id"), ident.alias("medoid_id"), F.format_string("%09d", "vec_id").alias("ring_id"), S.distance("x", "y", "z", "cx", "cy", "cz").alias("distance"))
    members = materialize(members.withColumn("distance2", F.col("distance") * F.col("distance")), "members")
    stats = routes.cluster_stats(members)
    clusters = stats.join(means.select("subregion", "cluster_index", *[F.col(f"c{c}").alias(c) for c in "xyz"]), ["subregion", "cluster_index"])
    return clusters, members


@query(LABELLED + " select subregion, cluster_index, size_n, round(p90, 6) as radius_p90, round(radius_max, 6) as radius_max, round(cost, 6) as cost_sum from u")
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters, _ = _labelled(spark, sf_dir)
    return clusters.select("subregion", "cluster_index", "size_n", *[F.round(c, 6).alias(c) for c in ("radius_p90", "radius_max", "cost_sum")])


@query("with recursive " + LABELLED[5:] + """,
w as (select subregion, 0 as sequence, -1 as cluster_index, 'START' as last, 0.0::double as x, 0.0::double as y, 0.0::double as z, 0.0::double as leg, [-1] as seen from (select distinct subregion from u)
  union all select * exclude (near, pos) from (select *, row_number() over (partition by subregion order by score, leg) as pos from
   (select u.subregion, w.sequence + 1 as sequence, u.cluster_index, case when w.sequence = 0 then 'START' else w.subregion || '/' || w.cluster_index end as last, u.x, u.y, u.z, sqrt((u.x-w.x)*(u.x-w.x)+(u.y-w.y)*(u.y-w.y)+(u.z-w.z)*(u.z-w.z)) as leg, list_append(w.seen, u.cluster_index) as seen,
     sqrt((u.x-w.x)*(u.x-w.x)+(u.y-w.y)*(u.y-w.y)+(u.z-w.z)*(u.z-w.z)) + case when sqrt((u.x-w.x)*(u.x-w.x)+(u.y-w.y)*(u.y-w.y)+(u.z-w.z)*(u.z-w.z)) > 0.05 then 100000.0 else 0 end - 250.0 * ln(1.0 + size_n) + 50.0 * p90 as score,
     row_number() over (partition by u.subregion order by (u.x-w.x)*(u.x-w.x)+(u.y-w.y)*(u.y-w.y)+(u.z-w.z)*(u.z-w.z), u.cluster_index) as near from w join u on u.subregion = w.subregion and not list_contains(w.seen, u.cluster_index)) where near <= 3) where pos = 1)
select subregion, sequence::int as sequence, cluster_index, last as from_cluster, round(leg, 6) as leg, leg > 0.05 as staging_required from w where sequence > 0""".replace("* exclude (near, pos)", "* exclude (near, pos, score)"))
def cluster_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters, _ = _labelled(spark, sf_dir)
    out = routes.sequence_clusters(clusters.withColumnRenamed("radius_p90", "p90"), (0.0, 0.0, 0.0), 0.05)
    return out.select("subregion", "sequence", "cluster_index", "from_cluster", F.round("leg", 6).alias("leg"), "staging_required")


@query(LABELLED + """, a as (select *, sqrt(size_n) / (p90 + 1.0) as priority from u)
select subregion, cluster_index, row_number() over (partition by subregion order by priority desc, p90, size_n desc, cluster_index)::int as cluster_rank, round(priority, 6) as priority from a""")
def candidate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters, members = _labelled(spark, sf_dir)
    out, _ = routes.export_candidates(clusters, members.withColumn("assign_rank", F.lit(1)), ("subregion", "cluster_index"))
    return out.select("subregion", "cluster_index", "cluster_rank", F.round("priority", 6).alias("priority"))


@query(LABELLED + """, v as (select *, dense_rank() over (partition by subregion order by cluster_index) as sequence from f)
select subregion, sequence::int as sequence, vec_id, row_number() over (partition by subregion, sequence order by d, vec_id)::int as target_order from v""")
def sequence_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of clusters that are visited in the order of their labels."""
    clusters, members = _labelled(spark, sf_dir)
    order = clusters.select("subregion", F.dense_rank().over(Window.partitionBy("subregion").orderBy("cluster_index")).cast("int").alias("sequence"), "cluster_id")
    out = routes.sequence_targets(order, members)
    return out.select("subregion", "sequence", F.col("ring_id").cast("bigint").alias("vec_id"), "target_order")


@query(BANDS + """ select vec_id, case when quadrant in ('E', 'N') then 'region' else 'ring' end as found, round(case when quadrant in ('E', 'N') then x + 1 else x end, 6) as x from b""")
def medoid_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of medoids: from the regions' table, which has half of them here, else from the rings'."""
    b = _banded(spark, sf_dir).withColumn("ring_id", F.format_string("%09d", "vec_id"))
    regions = b.where("quadrant in ('E', 'N')").select("ring_id", (F.col("x") + 1).alias("x"), "y", "z")
    out = routes.placed_clusters(b.select("vec_id", F.col("ring_id").alias("medoid_id"), "quadrant"), regions, b.select("ring_id", "x", "y", "z"))
    return out.select("vec_id", F.when(F.col("quadrant").isin("E", "N"), "region").otherwise("ring").alias("found"), F.round("x", 6).alias("x"))


@query(BANDS + " select quadrant, vec_id, round(moi, 9) as moi, row_number() over (partition by quadrant order by moi desc, vec_id) as place, count(*) over (partition by quadrant) as listed from b")
def quadrant_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point's place in its quadrant's list."""
    out = spatial.listed(_banded(spark, sf_dir).select("quadrant", "vec_id", "moi"), "quadrant", "vec_id", "moi")
    return out.select("quadrant", "vec_id", F.round("moi", 9).alias("moi"), "place", "listed")


@query("""with said as (select c_custkey, case when c_custkey % 3 = 0 then n_name when c_custkey % 3 = 1 then c_nationkey::varchar else 'nowhere ' || c_nationkey end as said from customer join nation on c_nationkey = n_nationkey)
select c_custkey, coalesce(a.n_name, b.n_name) as nation from said left join nation a on said = a.n_name left join nation b on said = b.n_nationkey::varchar""")
def resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What customers say of their nation, its name, its key or neither, as a name."""
    nations, k = table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_custkey")
    named = table(spark, sf_dir, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))  # a row a nation
    said = named.select("c_custkey", F.when(k % 3 == 0, F.col("n_name")).when(k % 3 == 1, F.col("c_nationkey").cast("string")).otherwise(F.concat(F.lit("nowhere "), "c_nationkey")).alias("said"))
    return ranking.resolved(said, "said", nations, "n_nationkey", "n_name", "nation").select("c_custkey", "nation")


@query(POINTS + " select 'l' || label as system_key, count(*) as rings, round(avg(x), 9) as x, round(avg(y), 9) as y, round(avg(z), 9) as z from p group by 1")
def system_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean places of systems whose names come in either case."""
    p = points(spark, sf_dir).withColumn("system_name", F.concat(F.when(F.col("vec_id") % 2 == 0, "L").otherwise("l"), "label"))
    out = spatial.system_average(p)
    return out.select("system_key", "rings", *[F.round(c, 9).alias(c) for c in "xyz"])


# --- crosswalk, live -------------------------------------------------------------------------------------------------------------


CROSSWALK = r"""
with s as (select 'u' || s_suppkey as source_url, 's' || s_suppkey as key, ['a ' || (s_suppkey % 7), 'b ' || (s_suppkey % 11)] as toks from supplier),
r as (select c_custkey as ring_id, 's' || (c_custkey // 15) as key, 'S' || (c_custkey // 15) || ' A ' || (c_custkey % 7) as body, 'Ring B ' || (c_custkey % 11) as ring, case when c_mktsegment = 'BUILDING' then 'Icy' else 'Rocky' end as type, c_acctbal as moi from customer),
m as (select *, list_bool_or(list_transform(toks, lambda t: contains(lower(body), t))) as inb, list_bool_or(list_transform(toks, lambda t: contains(lower(ring), t))) as inr,
  list_bool_or(list_transform(toks, lambda t: regexp_matches(lower(body), '\b' || t || '\b'))) as whole from s join r using (key)),
c as (select *, row_number() over (partition by source_url order by type <> 'Icy', whole desc, inb desc, moi desc, ring_id) as place, count(*) over (partition by source_url) as n from m where inb or inr),
p as (select ring_id, cume_dist() over (partition by type order by moi) as percentile from r)
"""


@query(CROSSWALK + """select s.source_url, coalesce(c.n, 0) as matches, case when c.n is null then 'NOT_FOUND' when c.n = 1 then 'MATCHED' else 'MATCHED_MULTIPLE' end as status, c.ring_id as best_ring_id, c.type as best_ring_type, c.moi as best_moi, round(p.percentile, 9) as percentile
from s left join c on c.source_url = s.source_url and c.place = 1 left join p on p.ring_id = c.ring_id""")
def token_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites made of suppliers, matched to rings made of customers by system and planet tokens."""
    out = crosswalk.best_matches(*_sites_and_rings(spark, sf_dir))
    return out.select("source_url", "matches", "status", "best_ring_id", "best_ring_type", "best_moi", F.round("percentile", 9).alias("percentile"))


@query(CROSSWALK + """, core as (select ring_id from r where type = 'Icy' and moi > 3000),
w as (select s.source_url, count(m.ring_id) filter (m.inb or m.inr) as n, coalesce(bool_or((m.inb or m.inr) and m.ring_id in (select ring_id from core)), false) as any_in from s left join m using (source_url) group by 1)
select count(*) as total_sites, count(*) filter (n = 1) as matched, count(*) filter (n > 1) as matched_multiple, count(*) filter (n = 0) as not_found, count(*) filter (any_in) as in_core,
  (select count(*) from c where place = 1 and ring_id in (select ring_id from core)) as best_in_core from w""")
def crosswalk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, rings, scores = _sites_and_rings(spark, sf_dir)
    return crosswalk.report_counts(crosswalk.best_matches(known, rings, scores, scores.where("ring_type = 'Icy' and moi_final > 3000")))


def _sites_and_rings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    known = table(spark, sf_dir, "supplier").select(F.concat(F.lit("u"), k).alias("source_url"), F.concat(F.lit("s"), k).alias("system_name"), F.concat(F.lit("A"), k % 7, F.lit(" and B"), k % 11, F.lit(" rings")).alias("planets"))
    system = F.concat(F.lit("S"), F.expr("c_custkey div 15"))
    rings = table(spark, sf_dir, "customer").select(c.alias("ring_id"), system.alias("system_name"), F.concat(system, F.lit(" A "), c % 7).alias("body_name"), F.concat(F.lit("Ring B "), c % 11).alias("ring_name"), F.when(F.col("c_mktsegment") == "BUILDING", "Icy").otherwise("Rocky").alias("ring_type"), F.col("c_acctbal").alias("moi_final"))
    return known, rings.select("ring_id", "system_name", "body_name", "ring_name"), rings.select("ring_id", "ring_type", "moi_final")


LIVE = """
with e as (select *, (props->>'$.k') as k from events where event_type in ('signup', 'view')),
x as (select *, last_value(case when event_type = 'signup' then k end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as prev from e),
y as (select *, sum(case when event_type = 'signup' and k is not null and k is distinct from prev then 1 else 0 end) over (partition by user_id order by event_id rows unbounded preceding) as epoch from x),
z as (select * from y where event_type = 'view' and epoch = (select max(epoch) from y y2 where y2.user_id = y.user_id)),
f as (select user_id, k as ring_key, max_by(case when value >= 50 then 'red' else 'black' end, event_id) as tier, max_by(ts, event_id) as seen, min(event_id) as first_order from z group by 1, 2)
select user_id, ring_key, tier, first_order from f where not (tier = 'black' and epoch((select max(ts) from events)) - epoch(seen) >= 86400)"""


@query(LIVE)
def live_table_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    now = str(e.agg(F.max("ts")).first()[0])
    k = F.get_json_object("props", "$.k")
    rows = e.where(F.col("event_type").isin("signup", "view")).select("user_id", "event_id", F.col("ts").alias("seen"), F.when(F.col("event_type") == "signup", "jump").otherwise("ring").alias("kind"), F.when(F.col("event_type") == "signup", k).alias("system"), k.alias("ring_key"), F.when(F.col("value") >= 50, "red").otherwise("black").alias("tier"))
    return live.final_table(rows, "user_id", "event_id", "seen", now, 86400.0).select("user_id", "ring_key", "tier", "first_order")
