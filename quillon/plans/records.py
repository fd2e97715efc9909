"""More registered queries: logs, labels, parsed values, site pages, flags and reports, each with the same thing in DuckDB SQL.

Importing this module adds them to those of ``queries``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import scalar as S
from quillon.operators import ranking, sites, spatial
from quillon.plans.queries import MERGED, POINTS, _two_sources, points, query, table
from quillon.session import materialize, shared_dir
from quillon.sources import logs, sinks


def one_of(number: str, *values: str | None) -> Column:
    """The value at the number modulo how many there are."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(number) % len(values)).cast("int") + 1)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- labels ----------------------------------------------------------------------------------------------------------------------


@query("""
with p as (select p_partkey, p_retailprice * p_size * p_size / 1e9 / pi() * 1e6 as d, case when p_size % 10 <> 0 then p_size - 25 + 0.3 end as delta, (p_partkey % 2000) / 7.0 - 100 as pc from part)
select p_partkey, case when d >= 100 then format('{:,}', round(d)::bigint) when d >= 10 then printf('%.1f', d) else printf('%.2f', d) end || ' t/km²' as density, coalesce(printf('%+.0f%%', delta::double), '') as delta,
  case when pc < 0 then printf('(%.2f%%)', -pc::double) else printf('%.2f%%', pc::double) end as share,
  (['Icy', 'Metallic', 'Metal Rich', 'Metal Rich', 'Rocky', 'Metal Rich', null, null, null])[(p_partkey % 9) + 1] as ring_type,
  (['Icy', 'Metallic', 'Metal Rich', 'Metal Rich', 'Rocky', 'Metal Rich', 'Icy', null, null])[(p_partkey % 9) + 1] as category from p""")
def label_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Densities, differences and shares as texts, and class names in their spellings; exact names against names that hold a word."""
    name = one_of("p_partkey", "Icy", "eRingClass_Metalic", "metal-rich", "METALRICH", " Rocky", "eRingClass_MetalRich", "very icy", "dusty", None)
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") * F.col("p_size") * F.col("p_size") / 1e9 / F.pi()).alias("d"), F.when(F.col("p_size") % 10 != 0, F.col("p_size") - 25 + 0.3).alias("delta"), ((F.col("p_partkey") % 2000) / 7.0 - 100).alias("pc"), name.alias("name"))
    return p.select("p_partkey", S.density_label("d").alias("density"), S.delta_label("delta").alias("delta"), S.percent_label("pc").alias("share"), S.ring_type("name").alias("ring_type"), S.category("name").alias("category"))


@query("""
with o as (select o_orderkey as k, 'C' || o_custkey as s from orders)
select k, case k % 5 when 0 then chr((65 + k % 26)::int) when 1 then chr((65 + k % 26)::int) else '?' end as letter,
  case k % 5 when 0 then k::varchar when 1 then 'Main Star' when 2 then '?' when 3 then 'X' || k else k::varchar end as designation,
  (['K5', 'M', 'C1 GG', 'Earthlike World', 'Odd Body', 'Unknown Body'])[(k % 6) + 1] as body_type from o""")
def body_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ring letters, designations within a system and types of bodies, for names made of orders."""
    k, letter = F.col("k"), F.chr(65 + F.col("k") % 26)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("C"), "o_custkey").alias("system"))
    pick = lambda *values: F.element_at(F.array(*[F.coalesce(v, F.lit(None).cast("string")) for v in values]), (k % 5).cast("int") + 1)
    body = pick(F.concat("system", F.lit("  "), k), F.concat(F.lit(" "), "system"), F.lit(" "), F.concat(F.lit("X"), k), F.concat("system", k))
    ring = pick(F.concat(F.lit("O 1 "), letter, F.lit(" Ring")), F.concat(F.lower(letter), F.lit(" RING ")), F.concat(F.lit("AB"), letter, F.lit(" Ring")), F.lit("Belt"), F.lit(None).cast("string"))
    kind = S.body_type_label(one_of("k", "K", "M", None, None, "", None), F.when(k % 6 == 0, 5), one_of("k", None, None, "Sudarsky class I gas giant", " EARTHLIKE body ", "Odd Body", ""))
    return o.withColumn("body", body).select("k", S.ring_letter(ring).alias("letter"), S.body_designation("system", "body").alias("designation"), kind.alias("body_type"))


# --- parsed values ---------------------------------------------------------------------------------------------------------------


@query("""
with o as (select o_orderkey as k, o_orderdate as d, o_totalprice as v, o_orderpriority as clerk from orders)
select k, case k % 4 when 0 then d when 1 then d - interval 2 hour when 2 then d end as at, (k % 7) in (0, 1, 3, 6) as flag,
  case k % 3 when 0 then v when 1 then k + 0.5 end as number, case k % 3 when 0 then k end as whole,
  case k % 2 when 0 then 'Gold|Tritium' else 'ice|' || clerk end as materials, 'c' || k || '|a ' || (k % 9) as site from o""")
def parsed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times with and without a zone, flags, numbers in texts, lists of materials and keys of sites."""
    k = F.col("k")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("d"), F.col("o_totalprice").alias("v"), F.col("o_orderpriority").alias("clerk"))
    at = F.when(k % 4 == 0, F.concat("d", F.lit("Z"))).when(k % 4 == 1, F.concat("d", F.lit("+02:00"))).when(k % 4 == 2, F.concat(F.lit(" "), "d")).otherwise(F.concat("d", F.lit(" o'clock")))
    flag = one_of("k", "yes", " 2.5 ", "no", "Mapped", "0", None, "TRUE")
    number = F.when(k % 3 == 0, F.col("v").cast("string")).when(k % 3 == 1, F.concat(F.lit("about "), k, F.lit(".5 ly, or 7"))).otherwise("none")
    materials = F.when(k % 2 == 0, F.lit(" Gold ,gold;Tritium|GOLD")).otherwise(F.concat(F.lit("ice/"), "clerk", F.lit(", Ice,,")))
    site = S.site_key(F.concat(F.lit("C"), k), F.concat(F.lit(" A  "), k % 9, F.lit(" ")))
    whole = S.safe_int(F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, "x").otherwise(""))
    found = F.coalesce(S.safe_float(number), S.number_in_text(number))
    return o.select("k", S.timestamp(at).cast("timestamp_ntz").alias("at"), S.truthy(flag).alias("flag"), found.alias("number"), whole.alias("whole"), F.concat_ws("|", S.materials(materials)).alias("materials"), site.alias("site"))


# --- logs ------------------------------------------------------------------------------------------------------------------------

START = "2024-01-16"


def write_logs(lines: DataFrame, day: str, folder: str) -> None:
    """Lines (value) as log files named by the text column ``day``: written by Spark, then renamed, one move a file."""
    spark = lines.sparkSession
    lines.select("value", day).repartition(day).write.partitionBy(day).text(folder)
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(folder)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    moves = [(f.getPath(), d.getPath().getName().split("=", 1)[1]) for d in system.listStatus(root) if d.isDirectory() for f in system.listStatus(d.getPath()) if f.getPath().getName().startswith("part-")]
    for i, (path, name) in enumerate(moves):
        system.rename(path, hadoop.Path(root, f"Journal.{name}.{i:04d}.log"))


@query(f"""
select event_id, case event_type when 'view' then 'Scan' when 'click' then 'FSDJump' else 'Location' end as event, 'U ' || user_id as system_name, date_trunc('second', ts) as at from events
where event_type in ('view', 'click', 'signup') and event_id % 7 <> 0 and event_id % 11 <> 0 and date_trunc('second', ts) >= timestamp '{START}'""")
def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as dated log files with blank, broken and other lines among them, read back from a date on: files by their names, lines by their times."""
    e = table(spark, sf_dir, "events")
    name = F.when(F.col("event_type") == "view", "Scan").when(F.col("event_type") == "click", "FSDJump").when(F.col("event_type") == "signup", "Location").otherwise("Docked")
    line = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), name.alias("event"), F.concat(F.lit("U "), "user_id").alias("StarSystem"), F.col("event_id").alias("BodyID")))
    marred = F.when(F.col("event_id") % 77 == 0, "").when(F.col("event_id") % 7 == 0, F.expr("substring(line, 1, length(line) - 9)")).when(F.col("event_id") % 11 == 0, F.concat(F.lit("["), "line", F.lit("]"))).otherwise(F.col("line"))
    day = F.when(F.dayofmonth("ts") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'000000")).otherwise(F.date_format("ts", "yyMMdd'000000'"))
    folder = new_folder(spark, "logs")
    write_logs(e.withColumn("line", line).select(marred.alias("value"), day.alias("day")), "day", folder)
    kept = logs.since(logs.live_events(logs.events(logs.read_lines_since(spark, folder, START))), START)
    return kept.select(F.col("BodyID").alias("event_id"), "event", F.col("StarSystem").alias("system_name"), S.timestamp("timestamp").cast("timestamp_ntz").alias("at"))


SECTOR = """
with r as (select case when l_returnflag = 'N' then 'Icy' when l_returnflag = 'A' then 'Metallic' when l_linenumber = 1 then 'Rocky' else 'Metal Rich' end as t,
  case when l_linenumber + l_quantity - 5 > l_linenumber then l_extendedprice / (pi() * ((l_linenumber + l_quantity - 5) * (l_linenumber + l_quantity - 5) - l_linenumber * l_linenumber)) else 0 end as d from lineitem),
m as (select t, median(d) filter (d > 0) as m, count(*) as n from r group by 1)"""


@query(SECTOR + " select case t when 'Icy' then 'icy' when 'Metallic' then 'metallic' when 'Rocky' then 'rocky' else 'metal_rich' end as type, n as ring_count, round(m, 6) as sector_median, case t when 'Icy' then 4.0 when 'Metallic' then 8.0 when 'Rocky' then 2.0 else 16.0 end::double as stored_median, round(m / stored_median, 6) as sigma from m")
def sector_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians by type of rings kept as JSON texts, some numbers as texts, beside those of a stored library."""
    icy = F.when(F.col("l_returnflag") == "N", "eRingClass_Icy").when(F.col("l_returnflag") == "A", "eRingClass_Metallic").when(F.col("l_linenumber") == 1, "Rocky").otherwise("eRingClass_MetalRich")
    outer = F.col("l_linenumber") + F.col("l_quantity") - 5
    first = F.to_json(F.struct(icy.alias("ringClass"), F.col("l_extendedprice").alias("mass"), F.col("l_linenumber").alias("innerRadius"), outer.alias("outerRadius")))
    other = F.to_json(F.struct(icy.alias("type"), F.col("l_extendedprice").cast("string").alias("massMT"), F.col("l_linenumber").cast("string").alias("innerRad"), outer.cast("string").alias("outerRad")))
    rings = logs.sector_rings(table(spark, sf_dir, "lineitem").select(F.when(F.col("l_orderkey") % 2 == 0, first).otherwise(other).alias("raw_json")))
    rings = materialize(rings, "sector-rings")  # a median reads its input several times, the texts are read once
    rings = rings.withColumn("surface_density", S.surface_density_or_zero("mass", S.ring_area_or_zero("inner", "outer")))
    library = json.dumps({"baselines": {t: {"ring_type": t, "baseline_median": v, "method": "m", "source_date": "d", "provenance_notes": "p"} for t, v in zip(logs.TYPES, (4.0, 8.0, 16.0, 2.0), strict=True)}})
    stored = logs.median_table(spark, logs.medians(library)).select(S.sector_type("ring_type").alias("type"), F.col("median").alias("stored_median"))
    out = ranking.class_medians(rings).join(F.broadcast(stored), "type")  # four rows
    return out.select("type", "ring_count", F.round("median", 6).alias("sector_median"), "stored_median", F.round(S.sigma("median", "stored_median"), 6).alias("sigma"))


# --- systems, flags, cohorts -----------------------------------------------------------------------------------------------------


@query(MERGED + """, t as (select * from (select *, row_number() over (partition by category order by surface_density desc, body_name) as rank from u) where rank <= 10)
select lower(c_name) as body_name, c_mktsegment as segment, t.rank is not null as is_top, t.category as top_category, t.rank as top_rank from customer left join t on t.body_name = lower(c_name) and t.category = c_mktsegment""")
def top_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ring with its place in the top lists, which are written and read back; as a view that SQL reads."""
    top = ranking.top_by_category(ranking.merge_sources(*_two_sources(spark, sf_dir)), 10)
    folder = new_folder(spark, "top")
    sinks.write_top_tables(top, folder)
    rings = table(spark, sf_dir, "customer").select(F.lit("s").alias("system_name"), F.col("c_name").alias("body_name"), F.lit("r").alias("ring_name"), F.col("c_mktsegment").alias("segment"))
    ranking.with_top_flags(rings, spark.read.parquet(f"{folder}/ranked"), "rings_with_top_flags")
    return spark.sql("select lower(body_name) as body_name, segment, is_top, top_category, top_rank from rings_with_top_flags")


@query(POINTS + """, s as (select vec_id % 97 as k, max_by({'x': x, 'y': y, 'z': z}, vec_id) as p from p group by 1)
select c_custkey, round(sqrt(power(s.p.x - 1, 2) + power(s.p.y - 2, 2) + power(s.p.z + 3, 2)), 9) as distance, null::bigint as left_out from customer join s on c_custkey % 120 = s.k
union all select null, null, count(*) from customer where c_custkey % 120 not in (select k from s)""")
def system_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings by the distance of their system, whose name is spelt otherwise; the last place of a system counts. Then how many have no place."""
    systems = points(spark, sf_dir).select(F.concat(F.lit(" sys  "), F.col("vec_id") % 97).alias("system_name"), "vec_id", "x", "y", "z")
    rings = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("SYS "), F.col("c_custkey") % 120).alias("system_name"))
    placed = ranking.with_distance(rings, systems, (1.0, 2.0, -3.0), "vec_id").select("c_custkey", F.round("distance", 9).alias("distance"), F.lit(None).cast("bigint").alias("left_out"))
    return placed.union(ranking.without_place(rings, systems).select(F.lit(None).cast("bigint"), F.lit(None).cast("double"), "count"))


@query(POINTS + """, co as (select vec_id from p where label < 5)
select p.vec_id, p.x, round(case when p.vec_id % 3 <> 0 then p.moi end, 6) as moi, 'S' || p.label as system_name from co join p using (vec_id)""")
def cohort_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a cohort with their places, and their scores of one version where they have any."""
    p = points(spark, sf_dir).withColumn("ring_id", F.col("vec_id"))
    rings = p.select("ring_id", F.concat(F.lit("S"), "label").alias("system_name"), F.lit("b").alias("body_name"), F.lit("r").alias("ring_name"), "x", "y", "z")
    scores = p.where("vec_id % 3 <> 0").select("ring_id", F.lit("v2").alias("score_version"), "moi").union(p.select("ring_id", F.lit("v1"), -F.col("moi")))
    out = spatial.cohort_points(p.where("label < 5").select("ring_id"), rings, scores, "v2", "moi")
    return out.select(F.col("ring_id").alias("vec_id"), "x", F.round("moi", 6).alias("moi"), "system_name")


@query(POINTS + """, d as (select a.vec_id, min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))) as d from p a, p b where a.label <> 0 and b.label = 0 group by 1)
select count(*) as n, printf('%.6f', min(d)) as min, printf('%.6f', median(d)) as median, printf('%.6f', max(d)) as max from d where d <= 0.2""")
def route_distance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the distances from a route as a report with fixed decimals, written as CSV and read back."""
    p = points(spark, sf_dir)
    near = materialize(spatial.proximity(p.where("label <> 0"), p.where("label = 0").withColumn("seq", F.col("vec_id")), "vec_id", "moi", 0.2), "near-route")
    folder = new_folder(spark, "report")
    sinks.write_csv(spatial.distance_stats(near), folder, {"min": 6, "median": 6, "max": 6})
    return spark.read.option("header", True).schema("n bigint, min string, median string, max string").csv(folder)


@query("""
select 'customer' as name, count(*) as rows from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 1)
union all select 'supplier', count(*) from supplier where s_nationkey in (select n_nationkey from nation where n_regionkey = 1) union all select 'region', count(*) from region""")
def table_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables cut down to the nations of one region: small ones without the key stay whole, large ones without it stay out."""
    nations = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("nation"))
    tables = {"customer": table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "nation"), "supplier": table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "nation"), "region": table(spark, sf_dir, "region"), "orders": table(spark, sf_dir, "orders")}
    kept = sinks.subset(tables, nations, "nation")
    out = None
    for name, df in kept.items():
        row = df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"))
        out = row if out is None else out.union(row)
    return out


# --- site pages ------------------------------------------------------------------------------------------------------------------


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, html): a page a part, as table rows, as term lists or as blocks "label: value"; a fifth of them without a heading."""
    k, name = F.col("p_partkey"), F.col("p_name")
    values = {
        "Planet(s)": F.concat(F.lit("A "), k % 7, F.lit(" and B "), k % 11),
        "Estimated light years from the bubble": F.concat("p_size", F.lit(","), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(".5 ly")),
        "Material Type": F.when(k % 4 == 0, F.lit("Tritium, Gold; gold")).when(k % 4 == 3, F.lit("")).otherwise(F.concat(F.lit("Gold / "), "p_brand")),
        "Mining Type": F.lit("Laser &amp; core"), "Overlap #": (k % 5).cast("string"), "Thanks to:": F.concat(F.lit("Cmdr "), k),
    }
    form = lambda start, mid, end: F.concat(*[x for label, v in values.items() for x in (F.lit(f"{start}{label}{mid}"), v, F.lit(end))])
    body = F.when(k % 3 == 0, F.concat(F.lit("<table>"), form("<tr><th>", "</th><td>", "</td></tr>"), F.lit("</table>"))).when(k % 3 == 1, F.concat(F.lit("<dl>"), form("<dt>", "</dt><dd>", "</dd>"), F.lit("</dl>"))).otherwise(form("<div><b>", "</b> ", "</div>"))
    about = F.concat(F.lit("<p>About  <b>"), name, F.lit("</b></p><script>var p = 1;</script><p>"), F.when(k % 2 == 0, F.concat(F.lit("Size "), "p_size")).otherwise(F.concat(F.lit("About "), name)), F.lit("</p>"))
    head = F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("<h1>"), name, F.lit("</h1>")))
    html = F.concat(F.lit("<html><head><title>"), name, F.lit(" | Sites</title></head><body>"), head, about, body, F.lit("</body></html>"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("https://x.example/mining-location/"), k, F.lit("?page=2#top")).alias("url"), html.alias("html"), "p_partkey")


@query("""
select 'https://x.example/mining-location/' || p_partkey as source_url, p_name as system_name, 'A ' || (p_partkey % 7) || ' and B ' || (p_partkey % 11) as planets, p_size * 1000 + p_partkey % 1000 + 0.5 as estimated_ly,
  case p_partkey % 4 when 0 then 'Tritium|Gold' when 3 then '' else 'Gold|' || p_brand end as materials, 'Laser & core' as mining_type, (p_partkey % 5)::varchar as overlap, 'Cmdr ' || p_partkey as thanks_to,
  case p_partkey % 2 when 0 then 'About ' || p_name || chr(10) || chr(10) || 'Size ' || p_size else 'About ' || p_name end as description,
  case when p_partkey % 4 = 3 then 'materials_missing' end as parse_warnings, (p_partkey % 4 = 0)::int as tritium_explicit, (p_partkey % 4 <> 0)::int as tritium_inferred from part where p_partkey % 6 <> 0""")
def site_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the pages of all parts in three layouts; those with a record from before are not taken again."""
    pages = site_pages(spark, sf_dir)
    done = pages.where("p_partkey % 6 = 0").select(F.col("url").alias("source_url"))
    found = sites.unseen(sites.parse_sites(pages), done)
    return found.select("source_url", "system_name", "planets", "estimated_ly", F.concat_ws("|", "materials").alias("materials"), "mining_type", "overlap", "thanks_to", "description", "parse_warnings", "tritium_explicit", "tritium_inferred")

