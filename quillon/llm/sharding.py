"""Resharding by minimum-cost flow: move the fewest bytes from old shards of any size to new ones of given capacities.

Only the sizes of the old and new shards (a small, bounded table) reach the driver. The flow network has an edge from every
old shard to every new one, with a cost a byte: 0 where the new shard lives in the old one's place, else 1 (or a matrix of
the caller's). Its solution says how many bytes each old shard sends where. The documents of an old shard lie one after the
other, in blocks, and each flow takes the next interval of their bytes; a document goes where its middle byte falls, so a new
shard's size is off its capacity by at most half a document at either end of each interval.

A null key, doc_id or text is a value like any other (a null text has size 1). Repeated rows are separate documents in any
order. An empty table gives an empty result. Columns of the input with other names are carried on. Documents with equal texts
are told apart by their ids only and may go to different shards: the law ``bytes`` asks for near-equal sizes, not for whole groups.
A doc_id that many different texts share, or none, is dealt over the blocks by text.
"""

from __future__ import annotations

import uuid
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import crc32_utf8, materialize, shared_dir

Flow = tuple[int, int, int]


def near_equal(total: int, n: int) -> list[int]:
    return [total // n + (k < total % n) for k in range(n)]


def homes(sizes: dict[int, int], n: int) -> dict[int, int]:
    """new shard -> the old shard in whose place it lives: the n largest, each in the shard of its own number if it can be."""
    largest = sorted(sorted(sizes, key=lambda i: (-sizes[i], i))[:n])
    own = {j: j for j in largest if j < n}
    free = iter([j for j in range(n) if j not in own])
    return own | {next(free): i for i in largest if i >= n}


def min_cost_flow(supply: dict[int, int], capacity: list[int], cost: dict[tuple[int, int], int]) -> list[Flow]:
    """Flows (old, new, bytes) of least total cost that empty all supplies: successive shortest paths on the residual graph.

    supply and capacity have equal sums. A path is found by Bellman-Ford on a queue; every path fills a supply, a capacity or
    a reversed edge, so the count of paths follows the shards and never the bytes.
    """
    old, new = sorted(supply), range(len(capacity))
    left, room = dict(supply), list(capacity)
    flow: dict[tuple[int, int], int] = {}
    while any(left.values()):
        dist, via = {("o", i): 0 for i in old if left[i]}, {}
        queue = deque(dist)
        while queue:
            u = queue.popleft()
            side, k = u
            edges = (((("n", j)), cost[k, j]) for j in new) if side == "o" else ((("o", i), -cost[i, k]) for i in old if flow.get((i, k)))
            for v, c in edges:
                if v not in dist or dist[u] + c < dist[v]:
                    dist[v], via[v] = dist[u] + c, u
                    queue.append(v)
        end = min((j for j in new if room[j] and ("n", j) in dist), key=lambda j: (dist["n", j], j))
        path = [("n", end)]
        while path[-1] in via:
            path.append(via[path[-1]])
        path.reverse()
        most = min(left[path[0][1]], room[end], *(flow[v[1], u[1]] for u, v in zip(path, path[1:], strict=False) if u[0] == "n"))
        for u, v in zip(path, path[1:], strict=False):
            edge, sign = ((u[1], v[1]), 1) if u[0] == "o" else ((v[1], u[1]), -1)
            flow[edge] = flow.get(edge, 0) + sign * most
        left[path[0][1]] -= most
        room[end] -= most
    return sorted((i, j, n) for (i, j), n in flow.items() if n)


def plan_moves(sizes: dict[int, int], shards: int, capacity: list[int] | None = None, cost: dict[tuple[int, int], int] | None = None) -> tuple[list[Flow], dict[int, int]]:
    """The flows and the home of each new shard; flows out of a home into its own shard come first, so what stays is a prefix."""
    at = homes(sizes, shards)
    cost = cost or {(i, j): int(at.get(j) != i) for i in sizes for j in range(shards)}
    flows = min_cost_flow(sizes, capacity or near_equal(sum(sizes.values()), shards), cost)
    return sorted(flows, key=lambda f: (f[0], cost[f[0], f[1]], f[1])), at


def reshard(docs: DataFrame, old_shard: Column, shards: int = 8, block_rows: int = 4_000, capacity: list[int] | None = None, carry: bool = True) -> DataFrame:
    """``docs`` with size, text_crc32, law, shard, slot, grown_shard, old_shard and moved; ``old_shard`` gives small whole numbers.

    law is ``bytes``: shard sizes are near equal (or near ``capacity``), and grown_shard is null. slot is gapless from 0 in
    every shard. With ``carry`` off, only doc_id of the other columns is kept. Old shards are worked on in blocks of about ``block_rows`` documents, so that one old shard with a third of
    all rows is many tasks; a task sees the table of blocks only.
    """
    spark = docs.sparkSession
    named = docs.withColumns({"_lm_size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1, "_lm_crc": F.coalesce(crc32_utf8(F.col("text")), F.lit(0)).cast("long"), "_lm_old": F.coalesce(old_shard.cast("int"), F.lit(0))})
    carried = docs.columns if carry else ["doc_id"]
    named = named.select(*[F.col(f"`{c}`") for c in carried], "_lm_size", "_lm_crc", "_lm_old")
    counts = named.groupBy("_lm_old").agg(F.sum("_lm_size").alias("bytes"), F.count("*").alias("rows")).collect()
    flows, at = plan_moves({r["_lm_old"]: r["bytes"] for r in counts}, shards, capacity)
    blocks = max(1, -(-sum(r["rows"] for r in counts) // block_rows))
    intervals, start = [], {}
    for i, j, n in flows:
        a = start.get(i, 0)
        intervals.append((i, j, a, a + n, at.get(j) != i))
        start[i] = a + n
    moves = F.broadcast(spark.createDataFrame(intervals, "_lm_old int, _lm_shard int, _lm_from long, _lm_to long, _lm_moved boolean"))  # at most old x new shards

    named = named.withColumn("_lm_b", F.pmod(F.xxhash64("doc_id", "_lm_crc", "_lm_size"), F.lit(blocks)))
    tie = "_lm_old, _lm_b order by doc_id, _lm_crc, _lm_size"
    sizes = named.groupBy("_lm_old", "_lm_b").agg(F.sum("_lm_size").alias("_lm_n"))
    starts = sizes.selectExpr("_lm_old", "_lm_b", "coalesce(sum(_lm_n) over (partition by _lm_old order by _lm_b rows between unbounded preceding and 1 preceding), 0) as _lm_before")

    def place(rows: DataFrame) -> DataFrame:
        inside = rows.selectExpr("*", f"sum(_lm_size) over (partition by {tie} rows between unbounded preceding and current row) - _lm_size as _lm_in", f"row_number() over (partition by {tie}) as _lm_rank")
        placed = inside.join(starts, ["_lm_old", "_lm_b"]).withColumn("_lm_at", F.col("_lm_before") + F.col("_lm_in"))
        placed = placed.join(moves, "_lm_old").where("_lm_at + shiftright(_lm_size, 1) >= _lm_from and _lm_at + shiftright(_lm_size, 1) < _lm_to")
        return placed.drop("_lm_from", "_lm_to", "_lm_before", "_lm_in")

    # the counts come from the keys alone; the other columns are then moved once
    keys = materialize(place(named.select("doc_id", "_lm_size", "_lm_crc", "_lm_old", "_lm_b")), "resharded")
    held = keys.groupBy("_lm_shard", "_lm_old", "_lm_b").agg(F.count("*").alias("_lm_n"), F.min("_lm_rank").alias("_lm_least"))
    base = held.selectExpr("_lm_shard", "_lm_old", "_lm_b", "_lm_least", "coalesce(sum(_lm_n) over (partition by _lm_shard order by _lm_old, _lm_b rows between unbounded preceding and 1 preceding), 0) as _lm_base")
    ranked = (place(named) if carry else keys).join(materialize(base, "blocks"), ["_lm_shard", "_lm_old", "_lm_b"]).withColumn("_lm_rank", F.col("_lm_rank") - F.col("_lm_least"))
    added = {"size": F.col("_lm_size"), "text_crc32": F.col("_lm_crc"), "law": F.lit("bytes"), "shard": F.col("_lm_shard"), "slot": (F.col("_lm_base") + F.col("_lm_rank")).cast("long"), "grown_shard": F.lit(None).cast("int"), "old_shard": F.col("_lm_old"), "moved": F.col("_lm_moved")}
    return ranked.select(*[F.col(f"`{c}`") for c in carried if c.lower() not in added], *[v.alias(k) for k, v in added.items()])


def reshard_files(docs: DataFrame, old_shard: Column, shards: int = 8, block_rows: int = 4_000) -> DataFrame:
    """``reshard`` with all columns, and the affected shards rewritten as files in the shared folder; the result is read back from them.

    The rows of unaffected shards lie where they lay, and come from the input.
    """
    spark = docs.sparkSession
    placed = reshard(docs, old_shard, shards, block_rows)
    path = f"{shared_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    affected = rewrite_affected(placed, path)
    if not affected:
        return placed
    files = spark.read.schema(placed.schema).parquet(path).select(*[F.col(f"`{c}`") for c in placed.columns])
    if len(affected) == shards:
        return files
    return files.unionByName(placed.where(~F.col("shard").isin(affected)))


def rewrite_affected(resharded: DataFrame, path: str) -> list[int]:
    """Write each new shard that gains or loses documents to ``path/shard=j`` and leave the others' files alone.

    ``resharded`` is a result of ``reshard``. Returns the shards written. A shard is unaffected if no document moved into it
    and none left the old shard in whose place it lives.
    """
    by = resharded.groupBy("old_shard", "shard").agg(F.max("moved").alias("moved")).collect()
    left = {r["old_shard"] for r in by if r["moved"]}
    affected = sorted({r["shard"] for r in by if r["moved"] or r["old_shard"] in left})
    # a task has the blocks of an old shard that it placed, so a shard gets a file a task and no row moves again
    resharded.where(F.col("shard").isin(affected)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    return affected
