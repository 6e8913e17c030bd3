"""Connected components by alternating stars, a few shuffles of the edges a round; few edges are joined by one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import durable


HUBS = 5_000
TASK_EDGES = 2_000_000  # edges that a task holds with ease, should they all be one node's


def least_neighbours(edges: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """(a, m), the least of each a and its neighbours, and ``edges`` (a, b), at most ``count``, each with the m of its a.

    Minima are summed before the shuffle, so a hub costs a row a task. Hubs are taken apart: nodes with over
    ``count / HUBS`` edges. There are at most HUBS of them, however large the input, so their minima are broadcast and
    their edges stay where they are; the edges of other nodes meet theirs by a shuffle, in which no key holds more than a
    hub's share.
    """
    least = durable(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree")).withColumn("m", F.least("a", "m")))
    limit = count // HUBS
    hubs = F.broadcast(least.where(F.col("degree") > limit).select("a", "m"))
    others = edges.join(hubs.select("a"), "a", "left_anti").join(least.where(F.col("degree") <= limit).select("a", "m"), "a")
    return least.drop("degree"), edges.join(hubs, "a").unionByName(others)


def _both(edges: DataFrame, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """Two edges of each row, in one pass."""
    pairs = F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in (first, second)])
    return edges.select(F.inline(pairs))


def large_round(now: DataFrame, count: int) -> DataFrame:
    both = _both(now, ("a", "b"), ("b", "a"))
    large = durable(least_neighbours(both, count)[1].where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
    low, hung = least_neighbours(large, count)
    return hung.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _counted(edges: DataFrame) -> tuple[DataFrame, dict]:
    """A durable copy, with its number of rows and a sum of their hashes from the pass that writes it."""
    seen = Observation()
    out = durable(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")))
    return out, seen.get


def least_of_each(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of the component of each of the nodes 0 to n - 1."""
    least = np.arange(n)
    while True:
        before = least.copy()
        low = np.minimum(least[a], least[b])
        for x in (before[a], before[b], a, b):
            np.minimum.at(least, x, low)
        while (least[least] != least).any():
            least = least[least]
        if (least == before).all():
            return least


def joined(edges: pa.Table) -> pa.Table:
    """(node, label) of the nodes of edges (a, b)."""
    ends = pa.chunked_array([*edges.column("a").chunks, *edges.column("b").chunks]).combine_chunks().dictionary_encode()
    nodes = ends.dictionary
    order = pc.array_sort_indices(nodes).to_numpy()
    rank = np.empty(len(nodes), np.int64)
    rank[order] = np.arange(len(nodes))
    at = rank[ends.indices.to_numpy()]
    least = least_of_each(at[: len(edges)], at[len(edges) :], len(nodes))
    return pa.table({"node": nodes.take(pa.array(order)), "label": nodes.take(pa.array(order[least]))})


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, label) for every node of the undirected edges (a, b); label is the component's least node.

    Each round hangs the larger neighbours of every node, then the smaller ones, on the least of them. A round's edges
    are cut from their lineage, so a lost executor repeats one round at most. Edges that a task holds with ease, a fixed
    number of them however large the input, are joined by one task without rounds: those of few edges cost the driver
    thousands of tasks, each of next to nothing.
    """
    now, state = _counted(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    kind = now.schema["a"].dataType.simpleString()

    def whole(batches):
        held = list(batches)
        if held:
            yield from joined(pa.Table.from_batches(held)).to_batches(max_chunksize=100_000)

    while state["n"]:
        if 2 * state["n"] <= task_edges:
            return durable(now.coalesce(1).mapInArrow(whole, f"node {kind}, label {kind}"))
        before = state
        now, state = _counted(large_round(now, 2 * state["n"]))
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
