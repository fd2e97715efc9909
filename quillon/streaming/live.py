"""The live view: rings of scanned bodies, scored against galactic medians, in a table that expires and is reset by jumps."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quillon.functions import scalar as S
from quillon.sources.logs import TYPES

TTL_SECONDS = 180.0


def ring_rows(events: DataFrame, medians: dict[str, float]) -> DataFrame:
    """A row per ring of the scans: key, labels, density, delta, tier. Other columns of the events are carried on."""
    median = F.try_element_at(F.create_map(*[x for k in TYPES for x in (F.lit(k), F.lit(medians.get(k)).cast("double"))]), F.col("_type"))
    rest = [c for c in events.columns if c not in ("Rings", "Signals")]
    rings = events.where("event = 'Scan'").select(*rest, F.explode("Rings").alias("r")).withColumn("_type", S.ring_type("r.RingClass"))
    # the scan's reserve level holds for its rings, unless a ring has its own
    rings = rings.withColumn("reserve_level", F.coalesce("r.ReserveLevel", "ReserveLevel"))
    density = S.surface_density_or_zero(F.coalesce("r.MassMT", F.lit(0.0)), S.ring_area_or_zero("r.InnerRad", "r.OuterRad"))
    rings = rings.withColumn("density", F.coalesce(density, F.lit(0.0))).withColumn("sigma", S.sigma("density", median))
    letter = S.ring_letter("r.Name")
    delta = S.delta_percent("sigma")
    named = rings.select(*rest, "reserve_level", F.concat(F.coalesce(F.col("BodyID").cast("string"), F.lit("None")), F.lit(":"), letter).alias("ring_key"), S.body_designation("StarSystem", "BodyName").alias("body"), S.body_type_label("StarType", "Subclass", "PlanetClass").alias("body_type"), letter.alias("ring"), F.coalesce("_type", "r.RingClass", F.lit("Unknown")).alias("ring_type"), "density", S.density_label("density").alias("density_label"), delta.alias("delta_pct"))
    return named.withColumn("delta_label", S.delta_label("delta_pct")).withColumn("tier", S.tier("delta_pct"))


def final_table(rows: DataFrame, session: str, order: str, seen: str, now: str, ttl: float = TTL_SECONDS) -> DataFrame:
    """The batch twin of the live table, from rows with columns kind ('jump' or 'ring'), system, ring_key, tier.

    Rows are taken in ``order`` within a session. A jump to another system begins a new epoch, and only the last epoch's rings are
    there; of a ring its last row; a black one not if it was seen ``ttl`` seconds or longer before ``now``.
    """
    by = Window.partitionBy(session).orderBy(order)
    jumps = rows.withColumn("_before", F.last(F.when(F.col("kind") == "jump", F.col("system")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    new = (F.col("kind") == "jump") & F.col("system").isNotNull() & ~F.col("system").eqNullSafe(F.col("_before"))
    epochs = jumps.withColumn("epoch", F.sum(new.cast("int")).over(by))
    last = epochs.groupBy(session).agg(F.max("epoch").alias("epoch"))
    rings = epochs.where("kind = 'ring'").join(last, [session, "epoch"], "left_semi")
    out = rings.groupBy(session, "ring_key").agg(F.max_by(F.struct("tier", seen), order).alias("r"), F.min(order).alias("first_order")).select(session, "ring_key", "r.*", "first_order")
    return out.where(~((F.col("tier") == "black") & (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col(seen).cast("timestamp")) >= ttl)))


ROW = StructType([StructField("tier", StringType()), StructField("text", StringType()), StructField("seen_ms", LongType()), StructField("position", LongType())])
OUT = "session string, ring_key string, tier string, text string, position long, change string"


class LiveTable(StatefulProcessor):
    """State a session: the current system, and rings by key. Emits upserts, expiries and clears."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.system = handle.getValueState("system", StructType([StructField("name", StringType())]))
        self.count = handle.getValueState("count", StructType([StructField("n", LongType())]))
        self.rings = handle.getMapState("rings", StructType([StructField("ring_key", StringType())]), ROW)

    def now(self, timers) -> int:  # noqa: ANN001
        at = timers.getCurrentProcessingTimeInMs()
        return at if at is not None and at >= 0 else int(time.time() * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        out, now = [], self.now(timerValues)
        for batch in rows:
            for row in batch.sort_values("seq", kind="stable").itertuples():
                if row.kind == "jump":
                    before = self.system.get()[0] if self.system.exists() else None
                    if row.system and row.system != before:
                        self.system.update((row.system,))
                        out += [(key[0], k[0], v[0], v[1], v[3], "cleared") for k, v in list(self.rings.iterator())]
                        self.rings.clear()
                else:
                    if self.rings.containsKey((row.ring_key,)):
                        position = self.rings.getValue((row.ring_key,))[3]
                    else:
                        position = (self.count.get()[0] if self.count.exists() else 0) + 1
                        self.count.update((position,))
                    self.rings.updateValue((row.ring_key,), (row.tier, row.text, now, position))
                    out.append((key[0], row.ring_key, row.tier, row.text, position, "upserted"))
                    if row.tier == "black":
                        self.handle.registerTimer(now + int(TTL_SECONDS * 1000))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now = self.now(timerValues)
        gone = [(k[0], v) for k, v in self.rings.iterator() if v[0] == "black" and now - v[2] >= TTL_SECONDS * 1000]
        for ring, _ in gone:
            self.rings.removeKey((ring,))
        if gone:
            yield pd.DataFrame([(key[0], k, v[0], v[1], v[3], "expired") for k, v in gone], columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def live_input(events: DataFrame, medians: dict[str, float], session: str | None = None) -> DataFrame:
    """Rows (session, seq, kind, system, ring_key, tier, text) of jumps and rings; malformed events are gone already.

    seq is the order of arrival: the file and the line's position in it.
    """
    key = F.col(session) if session else F.lit("all")
    numbered = events.withColumn("session", key).withColumn("seq", F.concat_ws("|", "file", F.lpad(F.col("position").cast("string"), 20, "0")))
    jumps = numbered.where("event in ('FSDJump', 'Location')").select("session", "seq", F.lit("jump").alias("kind"), F.col("StarSystem").alias("system"), *[F.lit(None).cast("string").alias(c) for c in ("ring_key", "tier", "text")])
    rings = ring_rows(numbered, medians).select("session", "seq", F.lit("ring").alias("kind"), F.col("StarSystem").alias("system"), "ring_key", "tier", F.concat_ws(" ", "body", "body_type", "ring", "ring_type", "density_label", "delta_label").alias("text"))
    return jumps.unionByName(rings)


def live_table(events: DataFrame, medians: dict[str, float], session: str | None = None) -> DataFrame:
    """The stream of changes to the live table; needs the RocksDB state store."""
    return live_input(events, medians, session).groupBy("session").transformWithStateInPandas(LiveTable(), OUT, "Update", "ProcessingTime")


def last_system(events: DataFrame, order: str) -> DataFrame:
    """Events with the system that the traveller is in: that of the last jump or location so far."""
    system = F.when(F.col("event").isin("FSDJump", "Location"), F.col("StarSystem"))
    return events.withColumn("current_system", F.last(system, ignorenulls=True).over(Window.partitionBy("session").orderBy(order)))
