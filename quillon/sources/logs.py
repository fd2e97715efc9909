"""Log files: batch scans of a folder, parsing of lines, pruning by the date in the file name, medians from JSON."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import scalar as S
from quillon.schema import LOG_EVENT

#: The names of log files, and the events that the live view reads.
GLOB = "Journal.*.log"
LIVE_EVENTS = ("Scan", "FSDJump", "Location")
TYPES = ("Icy", "Metallic", "Metal Rich", "Rocky")


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(value, file) of every line of the folder's logs."""
    return spark.read.option("pathGlobFilter", GLOB).text(folder).select("value", F.col("_metadata.file_name").alias("file"))


def events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines as rows of LOG_EVENT; what is blank, malformed, no object or without an event goes."""
    parsed = lines.withColumn("_e", F.from_json(F.col(value), LOG_EVENT, {"mode": "PERMISSIVE"}))
    return parsed.where(F.col("_e.event").isNotNull()).select("_e.*", *[c for c in lines.columns if c != value])


def live_events(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("event").isin(*LIVE_EVENTS))


def since(parsed: DataFrame, start: str) -> DataFrame:
    """Events from a time on; those without a readable time go."""
    return parsed.where(S.timestamp("timestamp") >= S.timestamp(F.lit(start)))


def file_date(name: Column) -> Column:
    """yyyy-mm-dd from a log's name, in its long or its six-digit form; null if there is none."""
    long = F.regexp_extract(name, r"Journal\.(\d{4}-\d{2}-\d{2})", 1)
    short = F.regexp_extract(name, r"Journal\.(\d{6})", 1)
    return F.when(long != "", long).when(short != "", F.concat(F.lit("20"), short.substr(1, 2), F.lit("-"), short.substr(3, 2), F.lit("-"), short.substr(5, 2)))


def read_lines_since(spark: SparkSession, folder: str, start: str) -> DataFrame:
    """(value, file) of the lines of the folder's logs whose name has no date before ``start`` (yyyy-mm-dd); undated ones are read.

    The condition is on the files' names alone, so Spark leaves files out as it lists them and opens none of those. It works for any path
    that Spark can list.
    """
    named = spark.read.option("pathGlobFilter", GLOB).text(folder)
    date = file_date(F.col("_metadata.file_name"))
    return named.where(date.isNull() | (date >= F.lit(start[:10]))).select("value", F.col("_metadata.file_name").alias("file"))


def medians(text: str) -> dict[str, float]:
    """Medians by ring type from the library's JSON; nothing unless all four types are there and valid."""
    try:
        stored = json.loads(text)
        stored = stored.get("baselines", stored)
        out = {}
        for kind in TYPES:
            row = stored[kind]
            value = float(row["baseline_median"])
            if row["ring_type"] != kind or not value > 0 or not all(str(row[k]).strip() for k in ("method", "source_date", "provenance_notes")):
                return {}
            out[kind] = value
        return out
    except (KeyError, TypeError, ValueError, AttributeError):
        return {}


def median_table(spark: SparkSession, found: dict[str, float]) -> DataFrame:
    return spark.createDataFrame([(k, found.get(k)) for k in TYPES], "ring_type string, median double")


def sector_rings(raw: DataFrame, column: str = "raw_json") -> DataFrame:
    """Class, mass and radii of rings kept as JSON texts, numbers as texts or not."""
    pick = lambda key: F.get_json_object(column, f"$.{key}")
    return raw.select(F.coalesce(pick("type"), pick("ringClass"), pick("RingClass")).alias("ring_class"), S.safe_float(F.coalesce(pick("mass"), pick("massMT"))).alias("mass"), S.safe_float(F.coalesce(pick("innerRadius"), pick("innerRad"))).alias("inner"), S.safe_float(F.coalesce(pick("outerRadius"), pick("outerRad"))).alias("outer"))
