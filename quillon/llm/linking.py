"""From buckets of candidates to components, without all pairs: used by the near-duplicate operators.

A bucket (a band's value) holds items that may be alike. At first every bucket names one pivot, the member that meets most others in
all its buckets, and its members are compared with that pivot alone, so work is in proportion to the members, whatever the size of the bucket. Links join items into components; a bucket whose
members are one component is finished. In the others, up to ``pivots`` members outside the bucket's largest component, the strays, are
the next pivots, compared with everything that is not yet theirs: a stray that has been a pivot is settled. So are twice as many
members of the largest component, dealt by hash: a stray that is linked with a part of its members is likely to meet one of these, at a
cost that follows the strays and not the pairs. What is still open after ``rounds``
of these is settled at once, strays against the members of other components. With ``refine`` they meet in finer buckets for that:
many items may share a bucket by a common passage alone, and those seldom share a finer one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import connected_components, materialize

#: Bits of a membership bitmap: 512 rows of 4 KB, whatever the number of keys.
BITS = 1 << 24


Compare = Callable[[DataFrame, DataFrame, bool], DataFrame]
Viable = Callable[[DataFrame], tuple[DataFrame, tuple[str, ...]]]


def link(members: DataFrame, prepare: Callable[[DataFrame], tuple[Compare, Viable | None]], rounds: int = 2, pivots: int = 8, carry: tuple[str, ...] = (), refine: str | None = None, at_once: int = 0) -> DataFrame:
    """members: rows (id, buckets), a long and a list of different longs. Returns (node, comp) for the ids that have a link.

    Once strays and the members they would meet make at most ``at_once`` pairs for each member, no further pivots are taken and all is settled.
    ``prepare`` gets all (bucket, id) that share a bucket, and returns the comparison: of rows (bucket, id, comp) with rows
    (bucket, x, x_comp) of the same bucket and another component it returns the linked (a, b). Before the last round, where all strays
    are compared, what ``prepare`` also returns gets the rows that are left and returns those that may be linked with any other, with columns
    of bounds that the last comparison (its third argument is true then) can use. Columns of members that ``carry`` names come along, as
    they are and with x_ before their names. ``refine`` is SQL over these for an item's finer buckets, an array.
    """
    flat = members.select("id", F.explode("buckets").alias("bucket"), *carry)
    shared = materialize(flat.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "shared-buckets")
    open_ = materialize(maybe_in(flat, "bucket", bitmap(shared, "bucket")).join(shared, "bucket"), "bucket-members")
    compare, viable = prepare(open_)
    # what others were copied from meets most of them, while two copies may each be too far from the other: it is the best pivot
    degrees = open_.groupBy("id").agg(F.sum("n").alias("degree"))
    open_ = materialize(open_.join(degrees, "id"), "bucket-degrees")
    first = open_.groupBy("bucket").agg(F.max(F.struct("degree", "id", *carry)).alias("p"))
    first = materialize(first.select("bucket", F.col("p.id").alias("x"), F.col("p.id").alias("x_comp"), *[F.col(f"p.{c}").alias(f"x_{c}") for c in carry]), "pivots")
    edges = materialize(compare(open_.select("bucket", "id", F.col("id").alias("comp"), *carry), first, False), "edges")
    used = first.select("bucket", F.col("x").alias("id"))
    open_ = open_.where("n > 2").select("bucket", "id", "degree", *carry)
    comps = connected_components(edges)
    for k in range(rounds + 1):
        named = open_.join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        mixed = named.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
        named = materialize(named.join(mixed, "bucket"), "mixed-buckets")
        largest = named.groupBy("bucket", "comp").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.max(F.struct("c", "comp")).alias("most"), F.sum("c").alias("n"))
        last = k == rounds
        if at_once and not last:
            left = largest.agg(F.sum((F.col("n") - F.col("most.c")) * F.col("n")).alias("pairs"), F.sum("n").alias("rows")).first()
            last = (left.pairs or 0) <= at_once * (left.rows or 0)
        if viable and last:
            named, extra = viable(named)
            named, carry = materialize(named, "viable-members"), (*carry, *extra)
            largest = named.groupBy("bucket", "comp").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.max(F.struct("c", "comp")).alias("most"))
        strays = named.join(largest.select("bucket", F.col("most.comp").alias("large")), "bucket").withColumn("stray", F.col("comp") != F.col("large")).drop("large", "n")
        if not last:
            strays = strays.join(used, ["bucket", "id"], "left_anti").withColumn("rank", F.when(F.col("stray"), -F.col("degree")).otherwise(F.xxhash64("id")))
            numbered = strays.selectExpr("*", "row_number() over (partition by bucket, stray order by rank, id) as r")
            # a constant limit first: Spark applies it below the shuffle, so no task sorts a whole bucket
            strays = numbered.where(F.col("r") <= 2 * pivots).where(~F.col("stray") | (F.col("r") <= pivots))
        else:
            strays = strays.where("stray").join(used, ["bucket", "id"], "left_anti")
        strays = materialize(strays.select("bucket", "id", "comp", "degree", *carry), "strays")
        if strays.isEmpty():
            break
        rows, pivots_ = named, strays
        if refine and last:
            rows, pivots_ = finer(named, strays, refine, carry)
        found = materialize(compare(rows, pivots_.select("bucket", *[F.col(c).alias(n) for c, n in [("id", "x"), *[(c, f"x_{c}") for c in ("comp", *carry)]]]), last), "edges")
        used, open_ = used.union(strays.select("bucket", "id")), named.select("bucket", "id", "degree", *carry)
        if not found.isEmpty():
            edges = edges.union(found)
            comps = connected_components(edges)
        if last:
            break
    return comps


def finer(named: DataFrame, strays: DataFrame, refine: str, carry: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The rows (bucket, id, comp) of the finer buckets that hold a stray and another component, and the strays among them."""
    items = named.select("id", "comp", *carry).dropDuplicates(["id"]).join(strays.select("id", F.lit(True).alias("stray")).distinct(), "id", "left")
    items = materialize(items.withColumn("stray", F.coalesce("stray", F.lit(False))), "open-items")
    flat = items.select("id", "comp", "stray", F.explode(F.expr(refine)).alias("bucket"))
    mixed = flat.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("stray").alias("any")).where("lo < hi and any").select("bucket")
    rows = materialize(flat.join(mixed, "bucket"), "finer-buckets").join(items.select("id", *carry), "id")
    return rows, rows.where("stray")


def bitmap(keys: DataFrame, key: str) -> DataFrame:
    """The set of a long column's values, hashed to a fixed number of bits: at most 512 rows (_lm_bucket, _lm_words).

    _lm_words has 1024 numbers of 32 bits each.
    """
    at = F.pmod(F.col(key), F.lit(BITS)) + 1
    bits = keys.select(F.bitmap_bucket_number(at).alias("_lm_bucket"), F.bitmap_bit_position(at).alias("_lm_p")).groupBy("_lm_bucket").agg(F.bitmap_construct_agg("_lm_p").alias("_lm_bits"))
    words = "transform(array(_lm_bits), b -> transform(sequence(0, 1023), i -> cast(conv(hex(substring(b, 4 * i + 1, 4)), 16, 10) as bigint)))[0]"
    return bits.select("_lm_bucket", F.expr(words).alias("_lm_words"))


def _marked(df: DataFrame, key: str, bits: DataFrame, how: str) -> tuple[DataFrame, Column]:
    at = F.pmod(F.col(key), F.lit(BITS)) + 1
    joined = df.withColumns({"_lm_bucket2": F.bitmap_bucket_number(at), "_lm_bit": F.bitmap_bit_position(at)}).join(F.broadcast(bits), F.col("_lm_bucket2") == F.col("_lm_bucket"), how)
    # the bytes of a word are its higher ones first, the bits of a byte its lower ones first
    there = F.expr("shiftright(get(_lm_words, cast(shiftright(_lm_bit, 5) as int)), cast((3 - (shiftright(_lm_bit, 3) & 3)) * 8 + (_lm_bit & 7) as int)) & 1")
    return joined, F.coalesce(there == 1, F.lit(False))


def maybe_in(df: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """Rows whose key may be in the set; the others surely are not. The bitmap has a fixed size, so it may be broadcast."""
    joined, there = _marked(df, key, bits, "inner")
    return joined.where(there).drop("_lm_words", "_lm_bucket", "_lm_bucket2", "_lm_bit")


def not_in(df: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """The rows that ``maybe_in`` leaves out, those with a null key too."""
    joined, there = _marked(df, key, bits, "left")
    return joined.where(~there).drop("_lm_words", "_lm_bucket", "_lm_bucket2", "_lm_bit")
