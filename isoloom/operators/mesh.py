"""Mesh post-processing on vertex tables `(vid, x, y, z)` and face tables `(v0, v1, v2)`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoloom.functions import scalar as S
from isoloom.operators.graph import connected_components
from isoloom.operators.numbering import numbered
from isoloom.session import cut


def edges(faces: DataFrame) -> DataFrame:
    """Each triangle's three undirected edges, repeated as often as used."""
    e = faces.selectExpr("inline(array(named_struct('s', v0, 't', v1), named_struct('s', v1, 't', v2), named_struct('s', v2, 't', v0)))")
    return e.selectExpr("least(s, t) AS a", "greatest(s, t) AS b")


def edge_counts(faces: DataFrame) -> DataFrame:
    return edges(faces).groupBy("a", "b").agg(F.count("*").alias("n"))


def adjacency(faces: DataFrame) -> DataFrame:
    """Directed neighbours `(src, dst)`, each once."""
    e = edges(faces).distinct().where("a <> b")
    return e.selectExpr("inline(array(named_struct('src', a, 'dst', b), named_struct('src', b, 'dst', a)))")


def laplacian(verts: DataFrame, adj: DataFrame, iterations: int, strength: float) -> DataFrame:
    """Jacobi smoothing: each vertex moves towards its neighbours' mean; lone vertices stay."""
    lam = min(max(strength, 0.0), 1.0)
    return _smooth(verts, adj, [lam] * iterations)


def taubin(verts: DataFrame, adj: DataFrame, iterations: int, lam: float = 0.5, nu: float = 0.5) -> DataFrame:
    """Alternate shrinking and inflating steps."""
    return _smooth(verts, adj, [lam if i % 2 == 0 else -nu for i in range(iterations)])


def _smooth(verts: DataFrame, adj: DataFrame, steps: list[float]) -> DataFrame:
    for i, s in enumerate(steps):
        near = adj.join(verts.select(F.col("vid").alias("dst"), "x", "y", "z"), "dst").groupBy("src").agg(*[F.expr(f"CAST(sum(CAST({a} AS decimal(28, 9))) AS double) / count(*)").alias(f"m{a}") for a in "xyz"])
        verts = verts.join(near.withColumnRenamed("src", "vid"), "vid", "left").selectExpr("vid", *[f"CASE WHEN m{a} IS NULL THEN {a} ELSE (1e0 - {S.num(s)}) * {a} + {S.num(s)} * m{a} END AS {a}" for a in "xyz"])
        if i % 4 == 3:
            verts = cut(verts)
    return verts


def vertex_normals(verts: DataFrame, faces: DataFrame) -> DataFrame:
    """Unit sums of the face normals around each vertex."""
    n = F.expr("inline(array(named_struct('vid', v0), named_struct('vid', v1), named_struct('vid', v2)))")
    at = with_points(verts, faces).selectExpr("v0", "v1", "v2", "(y1-y0)*(z2-z0)-(z1-z0)*(y2-y0) AS fx", "(z1-z0)*(x2-x0)-(x1-x0)*(z2-z0) AS fy", "(x1-x0)*(y2-y0)-(y1-y0)*(x2-x0) AS fz")
    s = at.select("fx", "fy", "fz", n).groupBy("vid").agg(*[F.expr(f"CAST(sum(CAST(f{a} AS decimal(28, 9))) AS double)").alias(a) for a in "xyz"])
    d = "sqrt(x * x + y * y + z * z)"
    return s.selectExpr("vid", *[f"CASE WHEN {d} <= 1e-12 THEN 0e0 ELSE {a} / {d} END AS n{a}" for a in "xyz"])


def with_points(verts: DataFrame, faces: DataFrame) -> DataFrame:
    out = faces
    for i in range(3):
        out = out.join(verts.selectExpr(f"vid AS v{i}", *[f"{a} AS {a}{i}" for a in "xyz"]), f"v{i}")
    return out


def long_edges(verts: DataFrame, faces: DataFrame, sizes: DataFrame, ratio: float) -> DataFrame:
    """Edges longer than `ratio` times the smaller cell size `(vid, size)` of their ends, once each, with the number of
    segments `seg` they need and their ends' places."""
    pos = verts.select("vid", "x", "y", "z").join(sizes, "vid")
    e = edges(faces).distinct().join(pos.selectExpr("vid AS a", "x AS xa", "y AS ya", "z AS za", "size AS sa"), "a").join(pos.selectExpr("vid AS b", "x AS xb", "y AS yb", "z AS zb", "size AS sb"), "b")
    e = e.selectExpr("*", f"{S.distance('xb - xa', 'yb - ya', 'zb - za')} AS len", f"{S.num(ratio)} * least(sa, sb) AS target")
    return e.where("target > 0e0 AND len > target").selectExpr("*", "CAST(ceil(len / target) AS int) AS seg")


def subdivide_long(verts: DataFrame, faces: DataFrame, sizes: DataFrame, ratio: float) -> tuple[DataFrame, DataFrame]:
    """Cut long edges into their segments and fan each face.

    New vertices are numbered after the old ones by (lower end, upper end, place).
    """
    e = long_edges(verts, faces, sizes, ratio)
    points = e.selectExpr("a", "b", "seg", "explode(sequence(1, seg - 1)) AS m", *[f"{a}a AS {a}0" for a in "xyz"], *[f"{a}b AS {a}1" for a in "xyz"])
    points = points.selectExpr("a", "b", "m", *[f"{a}0 + ({a}1 - {a}0) * (CAST(m AS double) / CAST(seg AS double)) AS {a}" for a in "xyz"])
    top = verts.agg(F.coalesce(F.max("vid") + 1, F.lit(0)).alias("top"))
    new = cut(numbered(points, ["a", "b", "m"], "k").join(F.broadcast(top)).selectExpr("a", "b", "m", "CAST(k + top AS bigint) AS vid", "x", "y", "z"))
    chain = new.groupBy("a", "b").agg(F.expr("transform(array_sort(collect_list(named_struct('m', m, 'v', vid))), p -> p.v)").alias("c"))
    out = faces
    for i, (s, t) in enumerate(((0, 1), (1, 2), (2, 0))):
        keyed = out.withColumn("a", F.least(f"v{s}", f"v{t}")).withColumn("b", F.greatest(f"v{s}", f"v{t}"))
        out = keyed.join(chain, ["a", "b"], "left").selectExpr("*", f"coalesce(if(v{s} < v{t}, c, reverse(c)), CAST(array() AS array<bigint>)) AS c{i}").drop("a", "b", "c")
    ring = out.selectExpr("concat(array(v0), c0, array(v1), c1, array(v2), c2) AS r")
    fan = ring.selectExpr("inline(transform(sequence(1, size(r) - 2), i -> named_struct('v0', r[0], 'v1', r[i], 'v2', r[i + 1])))")
    return verts.select("vid", "x", "y", "z").unionByName(new.select("vid", "x", "y", "z")), fan


def islands(verts: DataFrame, faces: DataFrame) -> DataFrame:
    """`(component, faces, volume)`: connected parts and their signed-volume magnitude."""
    parts = connected_components(edges(faces))
    tri = with_points(verts, faces).join(parts.withColumnRenamed("node", "v0"), "v0")
    vol = "(x0 * (y1 * z2 - z1 * y2) - y0 * (x1 * z2 - z1 * x2) + z0 * (x1 * y2 - y1 * x2)) / 6e0"
    return tri.groupBy("component").agg(F.count("*").alias("faces"), F.expr(f"abs(CAST(sum(CAST({vol} AS decimal(28, 9))) AS double))").alias("volume"))


def remove_islands(verts: DataFrame, faces: DataFrame, fraction: float | None) -> DataFrame:
    """Faces of parts with at least `fraction` of the largest volume; 0 keeps the largest alone, None all."""
    if fraction is None:
        return faces
    found = cut(islands(verts, faces))
    top = found.agg(F.max(F.struct("volume", (-F.col("component")).alias("c"))).alias("t")).selectExpr("t.volume AS top", "-t.c AS best")
    rule = "component = best" if fraction <= 0 else f"volume >= {S.num(fraction)} * top"
    keep = found.join(F.broadcast(top)).where(rule).select("component")
    parts = connected_components(edges(faces)).join(keep, "component", "left_semi").select(F.col("node").alias("v0"))
    return faces.join(parts, "v0", "left_semi").select("v0", "v1", "v2")


def process(verts: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices of one place merged into the lowest number; faces without area of their own and repeats dropped."""
    same = verts.groupBy("x", "y", "z").agg(F.min("vid").alias("to"))
    to = cut(verts.join(same, ["x", "y", "z"]).select("vid", "to"))
    out = faces
    for i in range(3):
        out = out.join(to.select(F.col("vid").alias(f"v{i}"), F.col("to").alias(f"t{i}")), f"v{i}")
    out = out.selectExpr("t0 AS v0", "t1 AS v1", "t2 AS v2").where("v0 <> v1 AND v1 <> v2 AND v2 <> v0")
    once = out.selectExpr("*", "array_sort(array(v0, v1, v2)) AS key").groupBy("key").agg(F.min(F.struct("v0", "v1", "v2")).alias("f"))
    return verts.join(to.where("vid = to").select("vid"), "vid", "left_semi"), once.select("f.v0", "f.v1", "f.v2")


def stitch(faces: DataFrame, largest: int = 128) -> DataFrame:
    """Faces with simple boundary loops of up to `largest` edges closed by a fan; longer ones stay open.

    Loops are found as components of boundary edges and counted before they are gathered, so that what a task
    walks along has a fixed size.
    """
    directed = faces.selectExpr("inline(array(named_struct('s', v0, 't', v1), named_struct('s', v1, 't', v2), named_struct('s', v2, 't', v0)))")
    rim = cut(directed.selectExpr("s", "t", "least(s, t) AS a", "greatest(s, t) AS b").join(edge_counts(faces).where("n = 1"), ["a", "b"]).select("a", "b", "s", "t"))
    loop = rim.join(connected_components(rim).withColumnRenamed("node", "s"), "s")
    simple = loop.groupBy("component").agg(F.count("*").alias("n"), F.countDistinct("s").alias("from"), F.countDistinct("t").alias("into")).where(f"n = from AND n = into AND n BETWEEN 3 AND {largest}")
    ends = loop.join(simple.select("component"), "component", "left_semi").groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("s", "t"))).alias("next"), F.count("*").alias("n"))
    walk = "aggregate(sequence(2, CAST(n AS int)), array(component), (w, i) -> concat(w, array(next[element_at(w, -1)])))"
    ring = ends.selectExpr(f"{walk} AS r", "n").where("size(array_distinct(r)) = n")
    fan = ring.selectExpr("inline(transform(sequence(1, size(r) - 2), i -> named_struct('v0', r[0], 'v1', r[i + 1], 'v2', r[i])))")
    return faces.select("v0", "v1", "v2").unionAll(fan)


def fix_winding(verts: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces turned so that neighbours run through their edge in opposite directions and closed parts have volume >= 0.

    Each face stands twice in a graph, as it is and turned, linked with the like of its neighbours that fits;
    a part that can be oriented falls into two mirrored components, of which one is taken. Others stay.
    """
    f = cut(numbered(faces.select("v0", "v1", "v2"), ["v0", "v1", "v2"], "fid"))
    sides = f.selectExpr("fid", "inline(array(named_struct('s', v0, 't', v1), named_struct('s', v1, 't', v2), named_struct('s', v2, 't', v0)))").selectExpr("fid", "least(s, t) AS a", "greatest(s, t) AS b", "s < t AS up")
    two = sides.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("fid", "up")).alias("p"), F.max(F.struct("fid", "up")).alias("q")).where("n = 2 AND p.fid <> q.fid")
    turn = two.selectExpr("p.fid AS f", "q.fid AS g", "if(p.up = q.up, 1, 0) AS w")
    links = turn.selectExpr("inline(array(named_struct('a', 2 * f, 'b', 2 * g + w), named_struct('a', 2 * f + 1, 'b', 2 * g + 1 - w)))")
    label = connected_components(links)
    both = f.join(label.selectExpr("node div 2 AS fid", "node % 2 AS w", "component").groupBy("fid").agg(F.min(F.when(F.col("w") == 0, F.col("component"))).alias("c0"), F.min(F.when(F.col("w") == 1, F.col("component"))).alias("c1")), "fid", "left")
    laid = both.selectExpr("v0", "if(c1 < c0, v2, v1) AS v1", "if(c1 < c0, v1, v2) AS v2", "coalesce(least(c0, c1), 2 * fid) AS part")
    vol = "(x0 * (y1 * z2 - z1 * y2) - y0 * (x1 * z2 - z1 * x2) + z0 * (x1 * y2 - y1 * x2))"
    inward = with_points(verts, laid).groupBy("part").agg(F.expr(f"sum({vol})").alias("volume")).where("volume < 0e0").select("part", F.lit(True).alias("turned"))
    return laid.join(inward, "part", "left").selectExpr("v0", "if(turned, v2, v1) AS v1", "if(turned, v1, v2) AS v2")


def repair(verts: DataFrame, faces: DataFrame, smoothing: int = 0) -> tuple[DataFrame, DataFrame]:
    """Merge, close small holes, smooth by Taubin's steps and turn faces outward."""
    verts, faces = process(verts, faces)
    verts, faces = cut(verts), cut(stitch(cut(faces)))
    if smoothing > 0:
        verts = cut(taubin(verts, cut(adjacency(faces)), 2 * smoothing))
    return verts, cut(fix_winding(verts, faces))


def decimate(verts: DataFrame, faces: DataFrame, fraction: float, max_rounds: int = 200) -> tuple[DataFrame, DataFrame]:
    """Edges collapsed by least quadric error until max(4, round(fraction * faces)) faces are left.

    Each round collapses all edges that are the cheapest of their ends' neighbourhoods: no two touch, so they
    do not depend on order, and no part is gathered in one task. Edges that would pinch the surface, as
    their ends have other than two neighbours in common, stay, as do boundary vertices.
    """
    if not 0 < fraction <= 1:
        raise ValueError("the fraction of faces to keep must be above 0 and at most 1")
    left = faces.count()
    target = max(4, round(left * fraction))
    verts, faces = cut(verts.select("vid", "x", "y", "z")), cut(faces.select("v0", "v1", "v2"))
    pairs = [(a, b) for i, a in enumerate("abcd") for b in "abcd"[i:]]
    for _ in range(max_rounds):
        if left <= target:
            break
        n = ["(y1-y0)*(z2-z0)-(z1-z0)*(y2-y0)", "(z1-z0)*(x2-x0)-(x1-x0)*(z2-z0)", "(x1-x0)*(y2-y0)-(y1-y0)*(x2-x0)"]
        plane = with_points(verts, faces).selectExpr("v0", "v1", "v2", "x0", "y0", "z0", *[f"{e} AS n{c}" for c, e in zip("abc", n)]).selectExpr("*", "sqrt(na * na + nb * nb + nc * nc) AS len").where("len > 0e0")
        plane = plane.selectExpr("v0", "v1", "v2", "len", *[f"n{c} / len AS {c}" for c in "abc"], "-(na * x0 + nb * y0 + nc * z0) / len AS d")
        quadric = plane.selectExpr(*[f"len * {p} * {q} AS {p}{q}" for p, q in pairs], "explode(array(v0, v1, v2)) AS vid").groupBy("vid").agg(*[F.sum(f"{p}{q}").alias(f"{p}{q}") for p, q in pairs])
        count = cut(edge_counts(faces).where("a <> b"))
        near = cut(count.selectExpr("n", "inline(array(named_struct('v', a, 'w', b), named_struct('v', b, 'w', a)))"))
        fixed = near.where("n <> 2").select(F.col("v").alias("vid")).distinct().withColumn("fixed", F.lit(True))
        common = count.join(near.select(F.col("v").alias("a"), "w"), "a").join(near.select(F.col("v").alias("b"), "w"), ["b", "w"]).groupBy("a", "b").agg(F.count("*").alias("shared")).where("shared = 2")
        state = cut(verts.join(quadric, "vid").join(fixed, "vid", "left"))
        of = lambda s: state.select(*[F.col(c).alias(f"{s}_{c}") for c in state.columns]).withColumnRenamed(f"{s}_vid", s)
        edge = count.where("n = 2").join(common, ["a", "b"], "left_semi").join(of("a"), "a").join(of("b"), "b").where("a_fixed IS NULL OR b_fixed IS NULL")

        def error(x: str, y: str, z: str) -> str:
            v = dict(zip("abcd", (x, y, z, "1e0")))
            return "(" + " + ".join(f"{'' if p == q else '2e0 * '}(a_{p}{q} + b_{p}{q}) * {v[p]} * {v[q]}" for p, q in pairs) + ")"

        spots = [["a_x", "a_y", "a_z"], ["b_x", "b_y", "b_z"], ["(a_x + b_x) / 2e0", "(a_y + b_y) / 2e0", "(a_z + b_z) / 2e0"]]
        may = ["b_fixed IS NULL", "a_fixed IS NULL", "a_fixed IS NULL AND b_fixed IS NULL"]
        best = ", ".join(f"CASE WHEN {m} THEN named_struct('e', {error(*s)}, 'x', {s[0]}, 'y', {s[1]}, 'z', {s[2]}) END" for s, m in zip(spots, may))
        cost = cut(edge.selectExpr("a", "b", f"array_min(filter(array({best}), p -> p IS NOT NULL)) AS p").selectExpr("named_struct('e', p.e, 'a', a, 'b', b) AS key", "a", "b", "p"))
        own = cost.selectExpr("key", "explode(array(a, b)) AS v").groupBy("v").agg(F.min("key").alias("m"))
        ring = near.select("v", "w").join(own.withColumnRenamed("v", "w"), "w").select("v", "m").unionAll(own.select("v", "m")).groupBy("v").agg(F.min("m").alias("m"))
        chosen = cost.join(ring.select(F.col("v").alias("a"), F.col("m").alias("ma")), "a").join(ring.select(F.col("v").alias("b"), F.col("m").alias("mb")), "b").where("key = ma AND key = mb")
        chosen = cut(chosen.select("key", "a", "b", "p").orderBy("key").limit(-(-(left - target) // 2)))
        if chosen.isEmpty():
            break
        moved = chosen.select(F.col("a").alias("vid"), "p")
        verts = cut(verts.join(chosen.select(F.col("b").alias("vid")), "vid", "left_anti").join(moved, "vid", "left").selectExpr("vid", *[f"coalesce(p.{c}, {c}) AS {c}" for c in "xyz"]))
        for i in range(3):
            faces = faces.join(chosen.select(F.col("b").alias(f"v{i}"), F.col("a").alias("to")), f"v{i}", "left").withColumn(f"v{i}", F.coalesce("to", f"v{i}")).drop("to")
        faces = cut(faces.select("v0", "v1", "v2").where("v0 <> v1 AND v1 <> v2 AND v2 <> v0"))
        left = faces.count()
    return verts, faces


def scale_to_print(verts: DataFrame, size_cm: float) -> DataFrame:
    """Scale the longest extent to `size_cm`, in millimetres; a flat mesh stays as it is."""
    span = verts.agg(F.expr("greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z))").alias("span"))
    return verts.join(F.broadcast(span)).selectExpr("vid", *[f"CASE WHEN span > 0e0 THEN {a} * ({S.num(size_cm * 10)} / span) ELSE {a} END AS {a}" for a in "xyz"])


def translate(verts: DataFrame, offset: tuple[float, float, float]) -> DataFrame:
    return verts.selectExpr("vid", *[f"{a} + {S.num(d)} AS {a}" for a, d in zip("xyz", offset)])


def merge(first: tuple[DataFrame, DataFrame], second: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Concatenate two meshes; the second's vertex numbers follow the first's."""
    top = first[0].agg(F.coalesce(F.max("vid") + 1, F.lit(0)).alias("top"))
    v = second[0].join(F.broadcast(top)).selectExpr("vid + top AS vid", "x", "y", "z")
    f = second[1].join(F.broadcast(top)).selectExpr("v0 + top AS v0", "v1 + top AS v1", "v2 + top AS v2")
    return first[0].select("vid", "x", "y", "z").unionByName(v), first[1].select("v0", "v1", "v2").unionByName(f)
