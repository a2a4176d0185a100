"""Connected components of a link table, as DataFrames only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.common import drop, staged


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component), for links held in memory."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


#: Links of a node from which it is a hub.
HUB = 1 << 18


def _with_least(edges: DataFrame, low: DataFrame, n: int) -> DataFrame:
    """``edges`` (a, b) with ``m`` of ``low`` (a, m, n); a hub's links stay in the tasks that they are in.

    Of ``n`` links, at most n / HUB nodes are hubs: that many rows are broadcast.
    """
    if n <= HUB:
        return edges.join(low.drop("n"), "a")
    hubs = low.where(F.col("n") > HUB).drop("n")
    others = edges.join(F.broadcast(hubs.select("a")), "a", "left_anti").join(low.where(F.col("n") <= HUB).drop("n"), "a")
    return others.unionByName(edges.join(F.broadcast(hubs), "a"))


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (a, b) that isn't the smallest of its component.

    Alternates the large-star and small-star steps until the links no longer change, which they do after some
    rounds for any links; each round's links are written to the shared folder, so that neither lineage nor lost
    executors pile up work. Neighbour lists are never gathered: a step is a minimum by node and a join back.
    """
    edges = staged(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    seen = _digest(edges)
    while seen[0]:
        n = 2 * seen[0]
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = _with_least(both, low, n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, low, n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, edges = edges, staged(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        drop(last)
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
