"""Exact ranks and quantiles that no single task has to sort whole.

The quantile rule is the low one: of n values in order, the one at floor((n - 1) * q), counted from 0.
"""

from __future__ import annotations

import math

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.session import broadcast_if_small, materialize

#: Bits that a pass of the selection looks at, groups times places that the driver holds, rows that are left to the last step.
DIGIT, MOST_PLACES, FEW_ROWS = 16, 50_000, 250_000


def ranked(df: DataFrame, group: list[str], order: list[Column], partitions: int | None = None, weight: str | None = None) -> DataFrame:
    """``df`` with idx (from 0, by ``order`` within ``group``) and n (rows of the group).

    The rows are dealt by ranges of (group, order), so a group with most of the rows spreads over many tasks; each task numbers its
    own rows, and an offset per (range, group) is added. With ``weight``, a column of whole numbers, a row counts so often: idx is
    the weight of the rows before it and n the weight of the group. Few rows are numbered at once, with the same result.
    """
    spark = df.sparkSession
    if partitions is None and df.limit(FEW_ROWS + 1).count() <= FEW_ROWS:
        whole = Window.partitionBy(*group)
        upto = whole.orderBy(*order)
        at = F.sum(weight).over(upto.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight) if weight else F.row_number().over(upto) - 1
        return df.select(*df.columns, at.cast("bigint").alias("idx"), (F.sum(weight) if weight else F.count("*")).over(whole).cast("bigint").alias("n"))
    many = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(many, *[F.col(g) for g in group], *order).withColumn("_range", F.spark_partition_id())
    dealt = materialize(dealt, "ranked")
    keys = ["_range", *group]
    sizes = dealt.groupBy(*keys).agg((F.sum(weight) if weight else F.count("*")).alias("_size"))
    by = f"partition by {', '.join(group)} " if group else ""
    offsets = sizes.selectExpr(*keys, f"coalesce(sum(_size) over ({by}order by _range rows between unbounded preceding and 1 preceding), 0) as _before", f"sum(_size) over ({by.strip()}) as n")
    offsets = broadcast_if_small(materialize(offsets, "offsets"))
    window = Window.partitionBy(*keys).orderBy(*order)
    before = F.sum(weight).over(window.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight) if weight else F.row_number().over(window) - 1
    own = dealt.withColumn("_row", before)
    same = own["_range"] == offsets["_range"]
    for g in group:
        same = same & own[g].eqNullSafe(offsets[g])
    return own.join(offsets, same).select(*[own[c] for c in df.columns], (F.col("_before") + F.col("_row")).cast("bigint").alias("idx"), offsets["n"].cast("bigint").alias("n"))


def weighed(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, _w, idx, n): the different known values of each group in order, and how often each is there."""
    return ranked(df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_w")), group, [F.col(value)], weight="_w")


def with_bits(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with a whole number for each double, in the doubles' order: exponent and fraction as IEEE 754 lays them out, negated below zero.

    Both zeros are 0, NaN is the greatest. The logarithm may be off by one near powers of two, which the scaled number shows; all
    products are by powers of two and exact. The steps are columns of their own, so each is computed once.
    """
    v = F.col(value).cast("double")
    out = df.withColumn("_size", F.abs(v))
    out = out.withColumn("_near", F.greatest(F.lit(-1022.0), F.least(F.lit(1023.0), F.log2("_size"))).cast("int"))
    out = out.withColumn("_part", F.col("_size") * F.pow(F.lit(2.0), -F.col("_near")))
    over, under = F.col("_part") >= 2, (F.col("_part") < 1) & (F.col("_near") > -1022)
    out = out.withColumn("_step", F.when(over, 1).when(under, -1).otherwise(0))
    part = F.col("_part") * F.when(F.col("_step") == 1, 0.5).when(F.col("_step") == -1, 2.0).otherwise(1.0)
    normal = (F.col("_near") + F.col("_step") + 1023).cast("long") * F.lit(1 << 52) + ((part - 1) * F.lit(float(1 << 52))).cast("long")
    subnormal = (F.col("_size") * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")
    out = out.withColumn("_bits", F.when(F.isnan("_size"), F.lit((1 << 63) - 1)).when(F.col("_size") == float("inf"), F.lit(0x7FF << 52)).when(F.col("_size") < 2.0**-1022, subnormal).otherwise(normal))
    return out.withColumn(name, F.when(v < 0, -F.col("_bits")).otherwise(F.col("_bits"))).drop("_size", "_near", "_part", "_step", "_bits")


def _keyed(df: DataFrame, value: str, name: str) -> DataFrame | None:
    """``df`` with whole numbers in the order of a column's values; none for types without such numbers here."""
    kind = df.schema[value].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return df.withColumn(name, F.col(value).cast("long"))
    return with_bits(df, value, name) if isinstance(kind, (T.FloatType, T.DoubleType)) else None


def _same(left: list[str], right: list[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def select_places(df: DataFrame, group: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """A row per group with a known value: n and, under each name, the value at the place (from 0) that ``places`` gives for n.

    Selection by digits of the ordered bits: a pass counts the rows of each (group, digit) among those that share a wanted place's digits
    so far, which is a count combined before the shuffle, and takes the digit that holds the place. Passes go on while more than
    ``FEW_ROWS`` rows are left and bits are unused; then the different values that are left are counted and numbered. No row is shuffled
    or written before that. The driver holds a row a group and place; with more of them than ``MOST_PLACES``, and for types without
    such bits, the different values are dealt by ranges and numbered.
    """
    known = df.where(F.col(value).isNotNull()).select(*group, value)
    if known.limit(FEW_ROWS + 1).count() <= FEW_ROWS:
        values = known.groupBy(*group, value).agg(F.count("*").alias("_w"))
        by = Window.partitionBy(*group)
        return _picked(values.withColumns({"idx": F.sum("_w").over(by.orderBy(value)) - F.col("_w"), "n": F.sum("_w").over(by)}), group, value, places)
    keyed, spark = _keyed(known, value, "_key"), df.sparkSession
    cut = [f"_g{i}" for i in range(len(group))]
    held = T.StructType([T.StructField(c, df.schema[g].dataType) for c, g in zip(cut, group, strict=True)] + [T.StructField("_name", T.StringType())] + [T.StructField(c, T.LongType()) for c in ("_n", "_at", "_digits", "_rows")])
    if keyed is None:
        return _picked(weighed(known, group, value), group, value, places)
    shift = 64 - DIGIT
    by = Window.partitionBy(*group)
    counts = keyed.groupBy(*group, F.shiftright("_key", shift).alias("_digits")).agg(F.count("*").alias("_rows"))
    counts = counts.withColumns({"_before": F.sum("_rows").over(by.orderBy("_digits")) - F.col("_rows"), "_n": F.sum("_rows").over(by)})
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), place(F.col("_n")).cast("long").alias("at")) for name, place in places.items()]))
    inside = (F.col("_w.at") >= F.col("_before")) & (F.col("_w.at") < F.col("_before") + F.col("_rows"))
    first = counts.withColumn("_w", wanted).where(inside).select(*[F.col(g).alias(c) for g, c in zip(group, cut, strict=True)], F.col("_w.name").alias("_name"), "_n", (F.col("_w.at") - F.col("_before")).alias("_at"), "_digits", "_rows")
    found = first.limit(MOST_PLACES + 1).collect()
    while True:
        if len(found) > MOST_PLACES:
            return _picked(weighed(known, group, value), group, value, places)
        targets = F.broadcast(spark.createDataFrame(found, held))
        cells = F.broadcast(targets.select(*cut, F.col("_digits").alias("_cell")).distinct())
        left = keyed.join(cells, _same(group, cut) & (F.shiftright("_key", shift) == F.col("_cell"))).drop(*cut)
        if shift == 0 or sum({(tuple(r[c] for c in cut), r["_digits"]): r["_rows"] for r in found}.values()) <= FEW_ROWS:
            break
        shift -= DIGIT
        counts = left.groupBy(*group, "_cell", F.shiftright("_key", shift).alias("_next")).agg(F.count("*").alias("_many"))
        counts = counts.withColumn("_before", F.sum("_many").over(Window.partitionBy(*group, "_cell").orderBy("_next")) - F.col("_many"))
        met = counts.join(targets, _same(group, cut) & (F.col("_cell") == F.col("_digits"))).where((F.col("_at") >= F.col("_before")) & (F.col("_at") < F.col("_before") + F.col("_many")))
        found = met.select(*cut, "_name", "_n", (F.col("_at") - F.col("_before")).alias("_at"), F.col("_next").alias("_digits"), F.col("_many").alias("_rows")).collect()
    values = left.groupBy(*group, "_cell", value).agg(F.count("*").alias("_many"))
    values = values.withColumn("_before", F.sum("_many").over(Window.partitionBy(*group, "_cell").orderBy(value)) - F.col("_many"))
    met = values.join(targets, _same(group, cut) & (F.col("_cell") == F.col("_digits"))).where((F.col("_at") >= F.col("_before")) & (F.col("_at") < F.col("_before") + F.col("_many")))
    return met.groupBy(*group).agg(F.max("_n").alias("n"), *[F.max(F.when(F.col("_name") == name, F.col(value))).alias(name) for name in places])


def _picked(values: DataFrame, group: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Values at places of (group, value, _w, idx, n), the different values with how often each is there and how many are before it."""
    at = lambda place: (F.col("idx") <= place) & (place < F.col("idx") + F.col("_w"))
    return values.groupBy(*group).agg(F.max("n").alias("n"), *[F.max(F.when(at(place(F.col("n"))), F.col(value))).alias(name) for name, place in places.items()])


def medians(df: DataFrame, group: list[str], value: str, name: str = "median") -> DataFrame:
    """A row per group with a known value: the mean of the middle two. Without a group one row, null if nothing is known."""
    middle = select_places(df, group, value, {"_lower": lambda n: F.floor((n - 1) / 2), "_upper": lambda n: F.floor(n / 2)})
    return middle.select(*group, ((F.col("_lower") + F.col("_upper")) / 2.0).alias(name))


def share_not_above(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """(group, value, name): for each different known value, the share of its group's known values that are not greater."""
    return weighed(df, group, value).select(*group, value, ((F.col("idx") + F.col("_w")) / F.col("n")).alias(name))


def shares_at(df: DataFrame, group: list[str], value: str, probes: DataFrame, name: str, most: int = MOST_PLACES) -> DataFrame:
    """(group, value, name) for the different known values of ``probes``: the share of the group's known values in ``df`` not greater.

    The probes lie sorted in every task, which counts its values between them by binary search; the counts of all tasks are summed, one row
    a probe, and run up. No value is shuffled. With more than ``most`` probes the values are counted and numbered instead. A probe of a
    group without known values has no row.
    """
    wanted = probes.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias(value)).distinct()
    held = wanted.limit(most + 1).collect()
    known = df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias(value))
    if len(held) > most:
        both = known.withColumn("_w", F.lit(1)).unionByName(wanted.withColumn("_w", F.lit(0))).groupBy(*group, value).agg(F.sum("_w").alias("_w"), F.count_if(F.col("_w") == 0).alias("_probe"))
        ranks = ranked(both, group, [F.col(value)], weight="_w").where((F.col("_probe") > 0) & (F.col("n") > 0))
        return ranks.select(*group, value, ((F.col("idx") + F.col("_w")) / F.col("n")).alias(name))
    sorted_probes: dict[tuple, list[float]] = {}
    for row in sorted(held, key=lambda r: math.inf if math.isnan(r[value]) else r[value]):
        sorted_probes.setdefault(tuple(row[g] for g in group), []).append(row[value])
    kinds = T.StructType([*[df.schema[g] for g in group], T.StructField("_at", T.IntegerType()), T.StructField("_many", T.LongType())])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[tuple, np.ndarray] = {}
        for rows in batches:
            parts = [((), rows)] if not group else rows.groupby(group, dropna=False, sort=False)
            for key, own in parts:
                key = tuple(None if pd.isna(k) else k for k in key)
                if key in sorted_probes:
                    at = np.searchsorted(sorted_probes[key], own[value].to_numpy(float), side="left")
                    counts[key] = counts.get(key, 0) + np.bincount(at, minlength=len(sorted_probes[key]) + 1)
        for key, many in counts.items():
            at = np.flatnonzero(many)
            yield pd.DataFrame({**{g: [k] * len(at) for g, k in zip(group, key, strict=True)}, "_at": at.astype("int32"), "_many": many[at]})

    spark = df.sparkSession
    counted = known.mapInPandas(count, kinds).groupBy(*group, "_at").agg(F.sum("_many").alias("_many"))
    places = spark.createDataFrame([(*key, v, i) for key, vs in sorted_probes.items() for i, v in enumerate(vs)], T.StructType([*[df.schema[g] for g in group], T.StructField(value, T.DoubleType()), T.StructField("_at", T.IntegerType())]))
    by = Window.partitionBy(*group)
    run = counted.unionByName(places.select(*group, "_at", F.lit(0).cast("bigint").alias("_many"))).groupBy(*group, "_at").agg(F.sum("_many").alias("_many"))
    run = run.withColumns({"_upto": F.sum("_many").over(by.orderBy("_at")), "_n": F.sum("_many").over(by)}).where(F.col("_n") > 0)
    cut = run.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_at").alias("_place"), "_upto", "_n")
    met = places.join(cut, _same(group, [f"_g{i}" for i in range(len(group))]) & (F.col("_at") == F.col("_place")))
    return met.select(*group, value, (F.col("_upto") / F.col("_n")).alias(name))


def floor_quantiles(df: DataFrame, group: list[str], value: str, ident: str, quantiles: dict[str, float]) -> DataFrame:
    """A row per group: n and, under each name, the value at floor((n - 1) * q). Nulls in ``value`` are left out."""
    return select_places(df, group, value, {name: lambda n, q=q: F.floor((n - 1) * F.lit(q)) for name, q in quantiles.items()})


def rank_fraction(df: DataFrame, value: str, ident: str, name: str, count: str = "norm_count") -> DataFrame:
    """``df`` with idx / (n - 1) by (value, ident) over the rows with a value; 1.0 for a single one, null without a value."""
    df = materialize(df, "to-rank")
    known = ranked(df.where(F.col(value).isNotNull()), [], [F.col(value), F.col(ident)])
    fraction = F.when(F.col("n") == 1, F.lit(1.0)).otherwise(F.col("idx") / (F.col("n") - 1))
    scored = known.withColumn(name, fraction).select(*df.columns, name)
    unknown = df.where(F.col(value).isNull()).withColumn(name, F.lit(None).cast("double"))
    total = df.agg(F.count(value).alias(count))
    return scored.unionByName(unknown).crossJoin(F.broadcast(total))  # one row
