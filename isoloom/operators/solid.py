"""Solid morphology on leaves: occupancy, distances, opening, clean-up, blocky surface."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoloom.functions import scalar as S
from isoloom.operators.graph import connected_components
from isoloom.operators.numbering import numbered
from isoloom.operators.octree import CELL, VALUES, Grid, kernel_at, leaf_lookup
from isoloom.session import cut


def face_neighbours(leaves: DataFrame, g: Grid) -> DataFrame:
    """`(lid, face, nid, nsize)`: the leaf at each face's centre, one probe a face; none outside."""
    span = f"(1 << ({g.max_depth} - depth))"
    rows = [f"named_struct('face', {f}, " + ", ".join(f"'j{a}', {f'i{a} * {span} + {span} div 2' if d[i] == 0 else (f'(i{a} + 1) * {span}' if d[i] > 0 else f'i{a} * {span} - 1')}" for i, a in enumerate("xyz")) + ")" for f, d in enumerate(S.FACES)]
    probes = leaves.selectExpr("lid", f"inline(array({', '.join(rows)}))").selectExpr("lid", "face", *[f"CAST(j{a} AS int) AS j{a}" for a in "xyz"])
    held = leaf_lookup(probes, leaves.withColumnRenamed("lid", "nid"), g.max_depth, ["nid"])
    return held.selectExpr("lid", "face", "nid", f"{S.num(g.width())} / CAST((1 << depth) AS double) AS nsize")


def classify(leaves: DataFrame, contrib: DataFrame, g: Grid) -> DataFrame:
    """Leaves `CELL, lid` and corner values with `size`, `center_value` and `inside`.

    Inside: the field at the centre, or four corners or more, are at least iso.
    """
    lo, hi = g.bounds()
    center = [f"(({lo[i]} + {hi[i]}) / 2e0)" for i in range(3)]
    value = contrib.join(leaves.select(*CELL), CELL, "left_semi").groupBy(*CELL).agg(F.expr(f"CAST(sum({kernel_at(*center)}) AS double)").alias("c"))
    corners = " + ".join(f"CAST({v} >= {S.num(g.isovalue)} AS int)" for v in VALUES)
    return leaves.join(value, CELL, "left").selectExpr("lid", *CELL, f"{S.num(g.width())} / CAST((1 << depth) AS double) AS size", "coalesce(c, 0e0) AS center_value", f"coalesce(c, 0e0) >= {S.num(g.isovalue)} OR {corners} >= 4 AS inside")


def occupancy(solid: DataFrame, nbr: DataFrame) -> DataFrame:
    """0 outside, 1 inside, 2 and 3 the same next to a leaf of the other kind."""
    mark = solid.select(F.col("lid").alias("nid"), F.col("inside").alias("other"))
    edge = nbr.join(mark, "nid").join(solid.select("lid", "inside"), "lid").where("inside <> other").select("lid").distinct().withColumn("edge", F.lit(True))
    return solid.join(edge, "lid", "left").selectExpr("lid", "CASE WHEN edge IS NULL THEN if(inside, 1, 0) ELSE if(inside, 2, 3) END AS occupancy")


def relax(seeds: DataFrame, sizes: DataFrame, nbr: DataFrame, limit: float) -> DataFrame:
    """Least path cost from seed leaves, `(lid, dist)`; a step costs half of both sizes; beyond `limit`
    nothing is kept. Each round joins the frontier with its neighbours and keeps what got better."""
    s = sizes.select("lid", "size")
    step = nbr.select("lid", "nid").join(s, "lid").join(s.select(F.col("lid").alias("nid"), F.col("size").alias("nsize")), "nid").selectExpr("lid", "nid", "0.5e0 * (size + nsize) AS cost")
    step = cut(step)
    dist = cut(seeds.select("lid", "dist").groupBy("lid").agg(F.min("dist").alias("dist")))
    frontier = dist
    while not frontier.isEmpty():
        reach = frontier.join(step, "lid").selectExpr("nid AS lid", "dist + cost AS dist").where(F.col("dist") <= limit).groupBy("lid").agg(F.min("dist").alias("new"))
        frontier = cut(reach.join(dist, "lid", "left").where("dist IS NULL OR new < dist").selectExpr("lid", "new AS dist"))
        dist = cut(dist.join(frontier.withColumnRenamed("dist", "new"), "lid", "full").selectExpr("lid", "coalesce(new, dist) AS dist"))
    return dist


def outside_distance(solid: DataFrame, nbr: DataFrame, limit: float) -> DataFrame:
    """Distance to the solid for outside leaves near it; 0 on the inside leaves it starts from."""
    out = solid.where("NOT inside").select(F.col("lid").alias("nid"))
    faces = nbr.groupBy("lid").agg(F.count("*").alias("n"))
    open_face = solid.where("inside").select("lid").join(faces, "lid", "left").where("n IS NULL OR n < 6").select("lid")
    seeds = nbr.join(out, "nid", "left_semi").join(solid.where("inside").select("lid"), "lid", "left_semi").select("lid").unionAll(open_face).distinct().withColumn("dist", F.lit(0.0))
    to_outside = nbr.join(out, "nid", "left_semi")
    return relax(seeds, solid.withColumn("size", F.least("size", F.lit(limit))), to_outside, limit)


def clearance(solid: DataFrame, nbr: DataFrame, occ: DataFrame, limit: float) -> DataFrame:
    """Distance of inside leaves to the boundary leaves inside."""
    inside = solid.where("inside").select(F.col("lid").alias("nid"))
    return relax(occ.where("occupancy = 2").withColumn("dist", F.lit(0.0)), solid, nbr.join(inside, "nid", "left_semi"), limit)


def mask_distance(solid: DataFrame, nbr: DataFrame, mask: DataFrame, limit: float) -> DataFrame:
    """Distance of any leaf to the leaves of a mask `(lid)`."""
    return relax(mask.withColumn("dist", F.lit(0.0)), solid, nbr, limit)


def erode(solid: DataFrame, clear: DataFrame, radius: float) -> DataFrame:
    """Inside leaves with at least that clearance; those never reached are deeper than the limit."""
    return solid.where("inside").join(clear, "lid", "left").where(f"dist IS NULL OR dist >= {S.num(radius)}").select("lid")


def dilate(mask: DataFrame, dist: DataFrame, radius: float) -> DataFrame:
    return mask.select("lid").unionAll(dist.where(F.col("dist") <= radius).select("lid")).distinct()


def _parts(mask: DataFrame, nbr: DataFrame) -> DataFrame:
    """`(lid, component)` of the mask's leaves; neighbours count either way."""
    m = mask.select("lid")
    links = nbr.join(m, "lid", "left_semi").join(m.select(F.col("lid").alias("nid")), "nid", "left_semi").select(F.col("lid").alias("a"), F.col("nid").alias("b"))
    found = connected_components(links)
    return m.join(found.withColumnRenamed("node", "lid"), "lid", "left").selectExpr("lid", "coalesce(component, lid) AS component")


def _volumes(parts: DataFrame, solid: DataFrame) -> DataFrame:
    return parts.join(solid.select("lid", "size"), "lid").groupBy("component").agg(F.expr("CAST(sum(CAST(size * size * size AS decimal(28, 9))) AS double)").alias("volume"))


def prune(mask: DataFrame, solid: DataFrame, nbr: DataFrame, ratio: float = 0.05) -> DataFrame:
    """Without components smaller than `ratio` times the largest."""
    parts = cut(_parts(mask, nbr))
    volumes = _volumes(parts, solid)
    top = volumes.agg(F.max("volume").alias("top"))
    keep = volumes.join(F.broadcast(top)).where(f"volume >= {S.num(ratio)} * top").select("component")
    return parts.join(keep, "component", "left_semi").select("lid")


def fill_cavities(mask: DataFrame, solid: DataFrame, nbr: DataFrame, ratio: float = 0.05) -> DataFrame:
    """With outside components of at most `ratio` times the mask's volume that do not touch the domain's end."""
    outside = solid.select("lid").join(mask, "lid", "left_anti")
    parts = cut(_parts(outside, nbr))
    faces = nbr.groupBy("lid").agg(F.count("*").alias("n"))
    touching = parts.join(faces, "lid", "left").where("n IS NULL OR n < 6").select("component").distinct()
    total = _volumes(mask.select("lid", F.lit(0).alias("component")), solid).selectExpr("volume AS total")
    fill = _volumes(parts, solid).join(touching, "component", "left_anti").join(F.broadcast(total)).where(f"volume <= {S.num(ratio)} * total")
    return mask.select("lid").unionAll(parts.join(fill.select("component"), "component", "left_semi").select("lid"))


def exposed_faces(mask: DataFrame, nbr: DataFrame) -> DataFrame:
    """`(lid, face)` of the mask's faces with no leaf of the mask behind them."""
    all_faces = mask.select("lid").withColumn("face", F.explode(F.sequence(F.lit(0), F.lit(5))))
    covered = nbr.join(mask.select(F.col("lid").alias("nid")), "nid", "left_semi").select("lid", "face")
    return all_faces.join(covered, ["lid", "face"], "left_anti")


def drop_contacts(mask: DataFrame, nbr: DataFrame) -> DataFrame:
    """Without leaves that expose five faces or more."""
    thin = exposed_faces(mask, nbr).groupBy("lid").agg(F.count("*").alias("n")).where("n >= 5").select("lid")
    return mask.select("lid").join(thin, "lid", "left_anti")


def boundary_samples(mask: DataFrame, solid: DataFrame, nbr: DataFrame, g: Grid) -> DataFrame:
    """Centre and outward axis normal of each exposed face: `(lid, face, x, y, z, nx, ny, nz)`."""
    lo, hi = g.bounds()
    at = exposed_faces(mask, nbr).join(solid.select("lid", *CELL), "lid")
    pos = [f"CASE face WHEN {2 * i} THEN {lo[i]} WHEN {2 * i + 1} THEN {hi[i]} ELSE ({lo[i]} + {hi[i]}) / 2e0 END AS {a}" for i, a in enumerate("xyz")]
    normal = [f"CASE face WHEN {2 * i} THEN -1e0 WHEN {2 * i + 1} THEN 1e0 ELSE 0e0 END AS n{a}" for i, a in enumerate("xyz")]
    return at.selectExpr("lid", "face", *pos, *normal)


def exposed_places(mask: DataFrame, solid: DataFrame, g: Grid) -> DataFrame:
    """`(face, jx, jy, jz)`: finest faces of the mask's leaves without a leaf of the mask behind, by the place in front.

    Faces wholly covered by a leaf of the same size go first; only of the rest each finest face is looked up.
    """
    span = f"(1 << ({g.max_depth} - depth))"
    cells = cut(solid.join(mask.select("lid"), "lid", "left_semi").select(*CELL))
    steps = ", ".join(f"named_struct('face', {f}, 'dx', {d[0]}, 'dy', {d[1]}, 'dz', {d[2]})" for f, d in enumerate(S.FACES))
    sides = cells.selectExpr(*CELL, f"inline(array({steps}))")
    same = cells.selectExpr("depth", *[f"i{a} AS n{a}" for a in "xyz"])
    sides = sides.selectExpr("*", *[f"i{a} + d{a} AS n{a}" for a in "xyz"]).join(same, ["depth", "nx", "ny", "nz"], "left_anti")
    for a in "xyz":
        at = f"explode(CASE d{a} WHEN 0 THEN sequence(i{a} * {span}, (i{a} + 1) * {span} - 1) WHEN 1 THEN array((i{a} + 1) * {span} - 1) ELSE array(i{a} * {span}) END) AS m{a}"
        sides = sides.selectExpr("*", at)
    fronts = sides.selectExpr("face", *[f"m{a}" for a in "xyz"], *[f"m{a} + d{a} AS j{a}" for a in "xyz"])
    covered = leaf_lookup(fronts, cells, g.max_depth, []).select("face", "mx", "my", "mz")
    return fronts.join(covered, ["face", "mx", "my", "mz"], "left_anti").selectExpr("face", *[f"m{a} AS j{a}" for a in "xyz"])


def _quads(places: DataFrame) -> DataFrame:
    """Corner keys `k0` to `k3` of each finest face, outward."""
    kinds = []
    for f in range(6):
        axis, up = f // 2, f % 2
        u, v = [(1, 2), (2, 0), (0, 1)][axis]
        points = []
        for p, q in [(0, 0), (1, 0), (1, 1), (0, 1)] if up else [(0, 0), (0, 1), (1, 1), (1, 0)]:
            k = [0, 0, 0]
            k[axis], k[u], k[v] = up, p, q
            points.append("(CAST(jx + {} AS bigint) << 42) | (CAST(jy + {} AS bigint) << 21) | CAST(jz + {} AS bigint)".format(*k))
        kinds.append(points)
    return places.selectExpr(*[f"CASE face {' '.join(f'WHEN {f} THEN {points[i]}' for f, points in enumerate(kinds))} END AS k{i}" for i in range(4)])


def blocky_surface(mask: DataFrame, solid: DataFrame, g: Grid) -> tuple[DataFrame, DataFrame]:
    """Vertices `(vid, x, y, z)` and outward triangles of the mask's exposed finest faces."""
    quads = cut(_quads(exposed_places(mask, solid, g)))
    keys = quads.selectExpr("explode(array(k0, k1, k2, k3)) AS k").distinct()
    w = S.num(g.width(g.max_depth))
    ids = cut(numbered(keys, ["k"], "vid"))
    verts = ids.selectExpr("vid", *[f"{S.num(g.low)} + CAST(((k >> {s}) & {S.MAX_COORDINATE}) AS double) * {w} AS {a}" for a, s in (("x", 42), ("y", 21), ("z", 0))])
    for i in range(4):
        quads = quads.join(ids.select(F.col("k").alias(f"k{i}"), F.col("vid").alias(f"q{i}")), f"k{i}")
    return verts, quads.selectExpr("inline(array(named_struct('v0', q0, 'v1', q1, 'v2', q2), named_struct('v0', q0, 'v1', q2, 'v2', q3)))")


def resolve_ambiguities(mask: DataFrame, solid: DataFrame, nbr: DataFrame, g: Grid) -> DataFrame:
    """The mask with edges cleared at which two leaves of the mask meet diagonally.

    Such a finest edge has four exposed faces. Of the two leaves outside around it the one with most
    neighbours in the mask joins it; of equal ones the smaller, then the one with the lowest number.
    """
    quads = _quads(exposed_places(mask, solid, g))
    ends = quads.selectExpr("inline(array(named_struct('s', k0, 't', k1), named_struct('s', k1, 't', k2), named_struct('s', k2, 't', k3), named_struct('s', k3, 't', k0)))")
    edges = cut(ends.selectExpr("least(s, t) AS s", "greatest(s, t) AS t").groupBy("s", "t").agg(F.count("*").alias("n")).where("n > 2").select("s", "t"))
    axis = "CASE t - s WHEN 1L THEN 2 WHEN 2097152L THEN 1 ELSE 0 END"
    at = [f"CAST((s >> {b}) & {S.MAX_COORDINATE} AS int)" for b in (42, 21, 0)]
    turns = [(0, 0), (0, 1), (1, 1), (1, 0)]
    rows = [f"named_struct('k', {k}, 'u', {u}, 'v', {v})" for k, (u, v) in enumerate(turns)]
    places = edges.selectExpr("s", "t", f"{axis} AS axis", *[f"{e} AS e{a}" for a, e in zip("xyz", at)]).selectExpr("*", f"inline(array({', '.join(rows)}))")
    back = [f"CASE axis WHEN {i} THEN 0 WHEN {(i + 1) % 3} THEN v ELSE u END" for i in range(3)]
    places = places.selectExpr("s", "t", "k", *[f"e{a} - ({b}) AS j{a}" for a, b in zip("xyz", back)])
    opened = mask.select("lid", F.lit(True).alias("opened"))
    met = leaf_lookup(places, solid, g.max_depth, ["lid", "size"]).join(opened, "lid", "left").selectExpr("s", "t", "k", "lid", "size", "coalesce(opened, false) AS opened")
    pattern = met.groupBy("s", "t").agg(F.expr("sum(CASE WHEN opened THEN 1 << k ELSE 0 END)").alias("bits")).where("bits IN (5, 10)")
    free = met.where("NOT opened").join(pattern, ["s", "t"], "left_semi").select("s", "t", "lid", "size").distinct()
    support = nbr.join(mask.select(F.col("lid").alias("nid")), "nid", "left_semi").groupBy("lid").agg(F.count("*").alias("n"))
    ranked = free.join(support, "lid", "left").groupBy("s", "t").agg(F.max_by("lid", F.expr("struct(coalesce(n, 0), -size, -lid)")).alias("lid"))
    return mask.select("lid").unionAll(ranked.select("lid")).distinct()


def counts(solid: DataFrame, occ: DataFrame, opened: DataFrame) -> DataFrame:
    """One row: leaves, leaves inside, on either side of the boundary, and of the opened mask."""
    marked = solid.select("lid", "inside").join(occ.select("lid", "occupancy"), "lid", "left").join(opened.select("lid", F.lit(True).alias("opened")), "lid", "left")
    return marked.agg(F.count("*").alias("n_leaves"), F.count_if("inside").alias("n_inside"), F.count_if(F.col("occupancy") == 2).alias("n_boundary_inside"), F.count_if(F.col("occupancy") == 3).alias("n_boundary_outside"), F.count_if("opened").alias("n_opened"))
