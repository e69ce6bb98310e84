"""Graph fix points over edge tables: connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoloom.session import cut


def _jump(parent: DataFrame) -> DataFrame:
    """Replace each parent by its own parent, where it has one."""
    up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
    return parent.join(up, "parent", "left").select("node", F.coalesce("top", "parent").alias("parent"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node per node.

    `edges(a, b)` are undirected; loops, repeats and either order are allowed. Returns
    `(node, component)` for every node of a proper edge; nodes seen only in loops or nulls are
    left out. Each round points every node at its smallest neighbour, jumps pointers three
    times and contracts the edges, so the edge table shrinks geometrically and no group is
    ever gathered in one task: minima are partial aggregates, relabelling is an equi-join.
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = cut(pairs)
    layers: list[DataFrame] = []
    for _ in range(max_rounds):
        if pairs.isEmpty():
            break
        sym = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))
        parent = sym.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("parent"))
        parent = cut(_jump(_jump(_jump(parent))))
        layers.append(parent)
        left = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        right = parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        joined = pairs.join(left, "a").join(right, "b").where("pa <> pb")
        pairs = cut(joined.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    else:
        raise RuntimeError("components did not settle")
    if not layers:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = layers[0].select("node", F.col("parent").alias("component"))
    for layer in layers[1:]:
        step = layer.select(F.col("node").alias("component"), F.col("parent").alias("next"))
        out = out.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return out
