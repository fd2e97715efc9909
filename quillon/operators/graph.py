"""Connected components as joins and grouped minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import discard, materialize, temporary

#: Links up to which a graph is small.
SMALL_GRAPH = 250_000


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph given as rows ``(a, b)``: returns ``(node, comp)``, comp the least node.

    Alternates large-star and small-star steps (each a grouped minimum and two narrow joins), so a star with millions of
    leaves costs one pre-aggregated minimum, never a collected group. Every round is written to the shared folder, and the one
    before it deleted; the loop ends when a round changes nothing. Nodes without an edge do not appear. An empty edge table gives an empty result.
    Null ends are ignored.
    """
    with temporary(edges.sparkSession) as keep:
        links = _settled(edges, max_rounds)
        return keep(links.select(F.col("b").alias("node"), F.col("a").alias("comp")).union(links.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct()))


def _settled(edges: DataFrame, max_rounds: int) -> DataFrame:
    """(a, b), a the least node of b's component, for every other node b."""
    links = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct()
    written = materialize(links, "cc")
    links, before = written, None
    # a small graph is worked on in one task, where no step needs a shuffle; a larger one by as many tasks as a shuffle has
    one_task = links.count() <= SMALL_GRAPH
    for _ in range(max_rounds):
        if one_task:
            links = links.coalesce(1)
        # large-star: every larger neighbour of a node moves to the node's least neighbour (itself included)
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if one_task:
            both = both.coalesce(1)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small-star: every smaller neighbour of a node, and the node itself, move to its least neighbour
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        links = large.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b").union(least.select(F.col("m").alias("a"), "b"))
        last, written = written, materialize((links.coalesce(1) if one_task else links).distinct(), "cc")
        discard(last)
        links = written
        now = (links.coalesce(1) if one_task else links).agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (now.n, now.h) == before:
            break
        before = (now.n, now.h)
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    return links


def components_of_links(edges: DataFrame) -> DataFrame:
    """As ``connected_components``, in one job if there are few links: their number is checked, and one task then joins them by union-find.

    Ids may be of any type that Arrow can sort. More than ``SMALL_GRAPH`` links go by rounds of joins.
    """
    links = edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct()
    links = materialize(links, "links")
    if links.limit(SMALL_GRAPH + 1).count() > SMALL_GRAPH:
        return connected_components(links)
    ident = links.schema["a"].dataType.simpleString()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        ids = pa.concat_arrays([table.column(c).combine_chunks() for c in ("a", "b")]).unique()
        ids = ids.take(pa.compute.array_sort_indices(ids))  # places in ascending order: the least place is the least id
        ends = [pa.compute.index_in(table.column(c), ids).to_numpy() for c in ("a", "b")]
        roots = least_roots(len(ids), *ends)
        yield pa.RecordBatch.from_arrays([ids, ids.take(pa.array(roots))], names=["node", "comp"])

    return materialize(links.coalesce(1).mapInArrow(joined, f"node {ident}, comp {ident}"), "components")


def least_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place of each place's component: roots hang below lesser roots, and paths are cut to their roots, all places at once."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    return root
