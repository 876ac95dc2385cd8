"""Connected components of an edge table, as rounds of DataFrame joins.

Each round runs a large-star and a small-star step: every neighbour of a node is linked to the
smallest node around it. The number of rounds grows with the logarithm of the longest path. Before the
rounds, and after each, every task contracts its own edges to a disjoint-set forest (``contracted``, in pieces of bounded
size), so paths that lie within a task are stars at once and repeated edges are gone before any shuffle. A
step takes minima by ``groupBy`` (partial aggregation, so a hub costs one row per task) and joins
them back to the edges. Nodes with more than ``HUB`` edges, or than a hundred-thousandth of all
edges, are joined by broadcast, so no task gets all edges of a hub: there are at most a hundred
thousand of them by count. Each round is cut at the shared folder, so lost executors cost one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.runtime import cut


#: Edges from which a node may be a hub; most hubs there can be.
HUB, MOST_HUBS = 10_000, 100_000
#: Edges that a task contracts at a time.
FOREST = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges (a, b) as stars: of each component its least node with every other one. Loops stay, once each."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = places[: len(a)], places[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        x, y = parent[u], parent[v]
        if (x == y).all():
            break
        # the larger root goes below the smaller one, then all point to their roots
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent != (up := parent[parent])).any():
            parent = up
    below = np.flatnonzero(parent != np.arange(len(nodes)))
    loops = np.unique(a[a == b])
    return np.concatenate([nodes[parent[below]], loops]), np.concatenate([nodes[below], loops])


def contracted(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) with the same components, and fewer: each task's are stars."""
    kind = dict(edges.dtypes)["a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            sides = [np.concatenate([x[i].to_numpy(zero_copy_only=False) for x in held]) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(x, held[0][0].type) for x in forest(*sides)], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0), batch.column(1)))
                n += batch.num_rows
            if n >= FOREST:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    return edges.select("a", "b").mapInArrow(run, f"a {kind}, b {kind}")


def _with_least(edges: DataFrame, least: DataFrame, node: str, hub: int | None) -> DataFrame:
    """``edges`` with the minimum ``m`` of their node. ``least``: (node, m, n), n being its edges."""
    if hub is None:
        return edges.join(least.drop("n"), node)
    # their edges add up to no more than all, so there are at most MOST_HUBS
    hubs = F.broadcast(cut(least.filter(F.col("n") > hub).drop("n")))
    rest = edges.join(hubs, node, "left_anti").join(least.filter(F.col("n") <= hub).drop("n"), node)
    return edges.join(hubs, node).unionByName(rest)


def _large_star(edges: DataFrame, hub: int | None = None) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _with_least(both.filter("b > a"), least, "a", hub).select(F.col("m").alias("a"), "b")


def _small_star(edges: DataFrame, hub: int | None = None) -> DataFrame:
    least = edges.groupBy("b").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _with_least(edges, least, "b", hub).filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), "b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an edge; component is the smallest node reachable.

    ``edges`` may hold both directions, loops and repeats. Edges with a null end are ignored; a
    node whose only edges are loops forms a component of its own.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    start = cut(contracted(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))))
    loops = start.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    now = start.filter("a < b")
    state = _state(now)
    while state[0]:
        # both directions count; a table of few edges has no hub
        hub = max(HUB, 2 * state[0] // MOST_HUBS) if 2 * state[0] > HUB else None
        now = cut(contracted(_small_star(_large_star(now, hub), hub)))
        new = _state(now)
        if new == state:
            break
        state = new
    stars = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return stars.union(roots).union(loops).groupBy("node").agg(F.min("component").alias("component"))
