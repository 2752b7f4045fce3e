"""Connected components of a table of edges, by large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisift.llm.common import staged


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (node, least node of its component) with the same components as the edges; for the edges of one task."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(nodes)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for x, y in zip(back[: len(a)].tolist(), back[len(a) :].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    root = np.array([find(i) for i in range(len(nodes))], np.int64)
    child = root != np.arange(len(nodes))
    return nodes[child], nodes[root[child]]


#: Edges from which a node may be hot: fewer are a megabyte, which a task that meets them does not notice.
HOT = 1 << 16


def _least(edges: DataFrame, hot: int | None) -> DataFrame:
    """(u, v, m): each neighbour v of u beside the least of u and all its neighbours. Minima are combined before the
    shuffle. Nodes with ``hot`` edges or more are few and sent to all tasks, so that their edges stay where they are; hot is
    None where there is no such node."""
    if hot is not None:
        edges = staged(edges, "ends")  # read three times
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"), "k")
    if hot is None:
        return edges.join(low, F.col("u") == F.col("w")).select("u", "v", "m")
    much = low.where(F.col("k") >= hot).select(F.col("w").alias("h"), F.col("m").alias("least"))
    marked = edges.join(F.broadcast(much), F.col("u") == F.col("h"), "left")
    rest = marked.where(F.col("h").isNull()).select("u", "v").join(low.where(F.col("k") < hot), F.col("u") == F.col("w"))
    return rest.select("u", "v", "m").unionByName(marked.where(F.col("h").isNotNull()).select("u", "v", F.col("least").alias("m")))


def _state(edges: DataFrame) -> tuple[bool, int | None]:
    """Whether the edges, each once and from the greater node to the less, are stars: no node that has a lesser one has
    another edge. And the number of edges that makes a node hot, None where no node has so many. Of the 2 n ends of n edges at
    most 2**19 nodes have an n / 2**18th or more, which bounds what is sent to all tasks. A node with fewer is met by a
    sort-merge join that holds one row of it, and its edges are less than a partition's, so no task grows with it."""
    end = lambda c, up: F.struct(F.col(c).alias("w"), F.lit(up).alias("up"))
    ends = edges.select(F.explode(F.array(end("u", 1), end("v", 0))).alias("e")).select("e.*")
    per = ends.groupBy("w").agg(F.count(F.lit(1)).alias("k"), F.sum("up").alias("ups"))
    found = per.agg(F.sum("ups").alias("n"), F.max("k").alias("most"), F.max(F.when(F.col("ups") > 0, F.col("k"))).alias("leaf")).first()
    hot = max(HOT, (found["n"] or 0) >> 18)
    return (found["leaf"] or 0) <= 1, hot if (found["most"] or 0) >= hot else None


def _rows(df: DataFrame, *pairs) -> DataFrame:
    """Several (u, v) of each row, without reading the rows twice."""
    return df.select(F.explode(F.array(*[F.struct(F.expr(u).alias("u"), F.expr(v).alias("v")) for u, v in pairs])).alias("e")).select("e.*").where("u <> v")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node with an edge; the component is its least node. Edges need no direction; nodes may be
    of any type that has an order."""
    now = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    while True:
        stars, hot = _state(now)
        if stars:
            break
        large = _rows(_least(_rows(now, ("u", "v"), ("v", "u")), hot).where("v > u"), ("v", "m"))
        small = _rows(_least(large, hot), ("v", "m"), ("u", "m"))
        now = staged(small.distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
