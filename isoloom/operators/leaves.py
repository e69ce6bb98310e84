"""Leaves of a finished tree: their contributors, samples, numbers and refinement near the surface."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoloom.functions import scalar as S
from isoloom.operators.numbering import numbered
from isoloom.operators.octree import CELL, VALUES, Grid, balance, child_contributors, children, contributors, corner_samples, with_surface
from isoloom.session import cut


def leaf_contributors(p: DataFrame, leaves: DataFrame, g: Grid) -> DataFrame:
    """Contributors of leaves that tile the domain. Pairs go down the tree and stop at the leaf they meet."""
    keys = leaves.select(*CELL)
    live, levels = contributors(p, g), []
    for depth in range(g.max_depth + 1):
        levels.append(live.join(keys, CELL, "left_semi"))
        if depth < g.max_depth:
            live = cut(child_contributors(live.join(keys, CELL, "left_anti"), g))
    return reduce(DataFrame.unionByName, [level.select(*CELL, "pid", "x", "y", "z", "h") for level in levels])


def leaf_samples(leaves: DataFrame, contrib: DataFrame, g: Grid) -> DataFrame:
    """Leaves with corner values, zeros where nothing contributes, the sign mask and `n`."""
    found = leaves.select(*CELL).join(corner_samples(contrib, g), CELL, "left")
    return with_surface(found.selectExpr(*CELL, "coalesce(n, 0) AS n", *[f"coalesce({v}, 0e0) AS {v}" for v in VALUES]), g)


def with_ids(leaves: DataFrame) -> DataFrame:
    """Add `lid`, dense in the order of depth and Morton key."""
    return numbered(leaves.withColumn("_morton", F.expr(S.morton_encode("ix", "iy", "iz"))), ["depth", "_morton"], "lid").drop("_morton")


def refine_surface_band(p: DataFrame, leaves: DataFrame, g: Grid, target: float) -> DataFrame:
    """Split leaves with a sign change until none is wider than `target` or above the largest depth; then balance."""
    leaves = cut(leaves.select(*CELL))
    for depth in range(g.max_depth):
        if g.width(depth) <= target:
            break
        contrib = leaf_contributors(p, leaves, g).where(F.col("depth") == depth)
        split = cut(with_surface(corner_samples(contrib, g), g).where("mask NOT IN (0, 255)").select(*CELL))
        leaves = cut(leaves.join(split, CELL, "left_anti").unionByName(children(split).select(*CELL)))
    return balance(leaves, g.max_depth)


def thickening_band(solid: DataFrame, nbr: DataFrame, dist: DataFrame, radius: float, target: float) -> DataFrame:
    """`(lid)` of leaves wider than `target` within radius + 2 target of the solid, and of such neighbours of theirs.

    Empty where the band is fully refined, but for leaves of the largest depth. `dist` is the distance of outside leaves.
    """
    wide = solid.where(F.col("size") > target).select("lid")
    near = dist.where(F.col("dist") <= radius + 2 * target).select("lid").unionAll(solid.where("inside").select("lid")).distinct()
    core = wide.join(near, "lid", "left_semi")
    ring = nbr.join(core, "lid", "left_semi").select(F.col("nid").alias("lid")).join(wide, "lid", "left_semi")
    return core.unionAll(ring).distinct()


def refine_thickening_band(leaves: DataFrame, band: DataFrame, g: Grid) -> DataFrame | None:
    """Leaves `CELL, lid` with those of the band split and the tree balanced; None where none can be split."""
    split = cut(leaves.join(band, "lid", "left_semi").where(F.col("depth") < g.max_depth).select(*CELL))
    if split.isEmpty():
        return None
    return balance(leaves.join(split, CELL, "left_anti").select(*CELL).unionByName(children(split).select(*CELL)), g.max_depth)
