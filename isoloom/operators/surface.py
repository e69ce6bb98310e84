"""Dual contouring: vertices of active leaves and the faces between them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoloom.functions import scalar as S
from isoloom.operators.numbering import numbered
from isoloom.operators.octree import CELL, VALUES, Grid, balance, children, corner_samples, hermite, leaf_lookup, qef, with_surface
from isoloom.session import cut

#: The four cells around a lattice edge, as steps back from its start: for x, y and z edges, in winding order.
AROUND = [
    [(0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 0)],
    [(0, 0, 0), (1, 0, 0), (1, 0, 1), (0, 0, 1)],
    [(0, 0, 0), (0, 1, 0), (1, 1, 0), (1, 0, 0)],
]


def vertices(leaves: DataFrame, contrib: DataFrame, g: Grid) -> DataFrame:
    """One vertex for each leaf with a sign change: `CELL, vid, x, y, z, nx, ny, nz`."""
    return numbered_vertices(cell_vertices(leaves, contrib, g))


def cell_vertices(leaves: DataFrame, contrib: DataFrame, g: Grid) -> DataFrame:
    """`CELL` and vertex of the leaves given that have a sign change; used for single cells too."""
    samples = with_surface(corner_samples(contrib.join(leaves.select(*CELL), CELL, "left_semi"), g), g).where("mask NOT IN (0, 255)")
    found = qef(hermite(samples, contrib, g), g)
    return found.selectExpr(*CELL, "vx AS x", "vy AS y", "vz AS z", "ax AS nx", "ay AS ny", "az AS nz")


def numbered_vertices(found: DataFrame) -> DataFrame:
    """Add `vid`, dense in the order of depth and Morton key."""
    keyed = found.withColumn("morton", F.expr(S.morton_encode("ix", "iy", "iz")))
    return numbered(keyed, ["depth", "morton"], "vid").select(*CELL, "vid", "x", "y", "z", "nx", "ny", "nz")


def lattice_signs(leaves: DataFrame, active: DataFrame, g: Grid) -> DataFrame:
    """Finest-lattice places around active leaves and whether the field is at least iso there."""
    span = f"(1 << ({g.max_depth} - depth))"
    at = active.select(*CELL)
    for a in "xyz":
        at = at.withColumn(f"j{a}", F.explode(F.expr(f"sequence(i{a} * {span} - 1, (i{a} + 1) * {span})")))
    places = at.select("jx", "jy", "jz").distinct()
    held = leaf_lookup(places, leaves, g.max_depth, VALUES)
    t = [f"(CAST(j{a} - i{a} * {span} AS double) / CAST({span} AS double))" for a in "xyz"]
    return held.selectExpr("jx", "jy", "jz", f"{S.trilinear(VALUES, *t)} >= {S.num(g.isovalue)} AS inside")


def crossed_edges(signs: DataFrame) -> DataFrame:
    """Finest-lattice edges whose ends differ in sign and that have cells all around: `(axis, ex, ey, ez, inside)`."""
    ends = signs.withColumnRenamed("inside", "other")
    edges = None
    for axis, a in enumerate("xyz"):
        other = ends.selectExpr(*[f"j{b} - {int(b == a)} AS j{b}" for b in "xyz"], "other")
        rest = " AND ".join(f"j{b} > 0" for b in "xyz" if b != a)
        one = signs.join(other, ["jx", "jy", "jz"]).where(f"inside <> other AND {rest}").selectExpr(f"{axis} AS axis", "jx AS ex", "jy AS ey", "jz AS ez", "inside")
        edges = one if edges is None else edges.unionAll(one)
    return edges


def around(edges: DataFrame) -> DataFrame:
    """The four finest places around each edge, with their turn `k`."""
    steps = ", ".join(f"array({', '.join(f'named_struct(\'k\', {k}, \'sx\', {s[0]}, \'sy\', {s[1]}, \'sz\', {s[2]})' for k, s in enumerate(row))})" for row in AROUND)
    return edges.selectExpr("*", f"inline(array({steps})[axis])").selectExpr("axis", "ex", "ey", "ez", "inside", "k", *[f"e{a} - s{a} AS j{a}" for a in "xyz"])


def missing_incident(leaves: DataFrame, verts: DataFrame, g: Grid, rings: int = 2) -> DataFrame:
    """Leaves without a vertex around edges that need one, and `rings` times their neighbours without.

    `leaves` has corner values. Neighbours are found by one probe towards each of 26 directions.
    """
    none = leaves.join(verts.select(*CELL), CELL, "left_anti").select(*CELL)
    edges = crossed_edges(cut(lattice_signs(leaves, verts, g)))
    found = cut(leaf_lookup(around(edges).select("jx", "jy", "jz").distinct(), none, g.max_depth, []).select(*CELL).distinct())
    span = f"(1 << ({g.max_depth} - depth))"
    for _ in range(rings):
        probes = found.select(*CELL)
        for a in "xyz":
            probes = probes.withColumn(f"j{a}", F.expr(f"explode(array(i{a} * {span} - 1, i{a} * {span}, (i{a} + 1) * {span}))"))
        near = leaf_lookup(probes.select("jx", "jy", "jz").distinct(), none, g.max_depth, []).select(*CELL)
        found = cut(found.unionByName(near).distinct())
    return found


def split_missing(leaves: DataFrame, missing: DataFrame, g: Grid) -> DataFrame | None:
    """Leaves with the missing ones that no sample can give a vertex split, balanced; None where there are none.

    Such a leaf has all corners on one side, so its surface, if any, is only seen by smaller cells.
    """
    split = cut(leaves.join(missing, CELL, "left_semi").where(f"mask IN (0, 255) AND depth < {g.max_depth}").select(*CELL))
    if split.isEmpty():
        return None
    return balance(leaves.join(split, CELL, "left_anti").select(*CELL).unionByName(children(split).select(*CELL)), g.max_depth)


def activate_missing(leaves: DataFrame, missing: DataFrame, verts: DataFrame, contrib: DataFrame, g: Grid) -> DataFrame:
    """`verts` and, numbered after them, vertices of the missing leaves that have samples."""
    more = cell_vertices(leaves.join(missing, CELL, "left_semi"), contrib, g).join(verts.select(*CELL), CELL, "left_anti")
    top = verts.agg(F.coalesce(F.max("vid") + 1, F.lit(0)).alias("top"))
    more = numbered_vertices(more).join(F.broadcast(top)).withColumn("vid", F.expr("vid + top")).drop("top")
    return verts.unionByName(more)


def vertex_adjacency(leaves: DataFrame, verts: DataFrame, g: Grid) -> DataFrame:
    """Directed neighbours `(src, dst)` of vertices whose leaves share a face, each once, both ways.

    Every finest face of a leaf with a vertex is probed, so that all smaller leaves behind it are met.
    """
    span = f"(1 << ({g.max_depth} - depth))"
    sides = []
    for f, d in enumerate(S.FACES):
        at = verts.select("vid", *CELL)
        for i, a in enumerate("xyz"):
            e = f"i{a} * {span} - 1" if d[i] < 0 else f"(i{a} + 1) * {span}" if d[i] > 0 else f"explode(sequence(i{a} * {span}, (i{a} + 1) * {span} - 1))"
            at = at.withColumn(f"j{a}", F.expr(e))
        sides.append(at.selectExpr("vid AS src", *[f"CAST(j{a} AS int) AS j{a}" for a in "xyz"]))
    probes = reduce(DataFrame.unionAll, sides)
    met = leaf_lookup(probes, verts.withColumnRenamed("vid", "dst"), g.max_depth, ["dst"]).select("src", "dst").where("src <> dst")
    return met.unionAll(met.selectExpr("dst AS src", "src AS dst")).distinct()


def faces(leaves: DataFrame, verts: DataFrame, g: Grid) -> DataFrame:
    """Triangles `(v0, v1, v2)` of lattice edges whose ends differ in sign and whose four leaves have vertices.

    `leaves` has corner values, zeros where there are no contributors. A quad with three distinct
    leaves gives one triangle, with fewer none; it is reversed where the edge's start is inside.
    """
    signs = cut(lattice_signs(leaves, verts, g))
    places = around(crossed_edges(signs))
    met = leaf_lookup(places, verts, g.max_depth, ["vid"])
    quads = met.groupBy("axis", "ex", "ey", "ez", "inside").agg(F.array_sort(F.collect_list(F.struct("k", "vid"))).alias("q")).where("size(q) = 4")
    ring = quads.selectExpr("if(inside, reverse(array_distinct(q.vid)), array_distinct(q.vid)) AS r").where("size(r) >= 3")
    return ring.selectExpr("inline(if(size(r) = 3, array(named_struct('v0', r[0], 'v1', r[1], 'v2', r[2])), array(named_struct('v0', r[0], 'v1', r[1], 'v2', r[2]), named_struct('v0', r[0], 'v1', r[2], 'v2', r[3]))))")
