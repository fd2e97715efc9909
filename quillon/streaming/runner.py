"""Streams that run for good: good rows and bad lines into folders, each once, however often a batch is tried.

A batch writes into folders named by its number and replaces what an earlier try has left there; after a restart the checkpoint repeats
the last batch with the same lines. So a query that was killed between its two sinks has every row and every bad line once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.sources import logs
from quillon.streaming import live


def fault(line: str) -> Column:
    """Why a line is no event: blank, malformed, no object or no event; null for one."""
    text = F.trim(F.coalesce(F.col(line), F.lit("")))
    parsed = F.try_parse_json(text)
    return (
        F.when(text == "", "blank").when(parsed.isNull(), "malformed").when(~F.schema_of_variant(parsed).startswith("OBJECT"), "no object")
        .when(F.coalesce(F.get_json_object(text, "$.event"), F.lit("")) == "", "no event")
    )


def split(lines: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """(events, lines that are none with their reason). A line that parses as JSON but not as an event's fields is bad too."""
    judged = lines.withColumn("reason", fault(line))
    events = logs.events(judged.where("reason is null").drop("reason"), line)
    return events, judged.where("reason is not null")


def put(df: DataFrame, path: str, batch: int) -> None:
    """A batch's rows in a folder of its own, in place of what an earlier try of it has left."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def taken(spark: SparkSession, path: str) -> DataFrame:
    """All batches' rows, with the number of the batch."""
    return spark.read.parquet(path)


def run_events(lines: DataFrame, path: str, checkpoint: str, every: str = "2 seconds", once: bool = False) -> StreamingQuery:
    """Start the query that takes a stream of lines apart: events to ``path/events``, bad lines to ``path/bad``.

    ``every`` is the interval of the batches; with ``once`` what is there is worked on and the query ends.
    """

    def work(batch: DataFrame, number: int) -> None:
        events, bad = split(batch)
        put(events, f"{path}/events", number)
        put(bad, f"{path}/bad", number)

    trigger = {"availableNow": True} if once else {"processingTime": every}
    return lines.writeStream.queryName("events").foreachBatch(work).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def run_live(lines: DataFrame, medians: dict[str, float], path: str, checkpoint: str, every: str = "2 seconds", session: str | None = None) -> StreamingQuery:
    """Start the query of the live table: its changes go to ``path/changes``. Its state is in the RocksDB store that the session names; bad
    lines do not reach it, and are kept by ``run_events``, a query of its own that a fault here leaves alone."""
    events, _ = split(lines)
    changes = live.live_table(events, medians, session)
    return changes.writeStream.queryName("live").outputMode("update").foreachBatch(lambda df, number: put(df, f"{path}/changes", number)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
