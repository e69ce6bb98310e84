"""Fallback vertices, gaps where depths meet, masks, ambiguous edges, groups, repair, decimation and files."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoloom import api, cli
from isoloom.functions import scalar as S
from isoloom.operators import fof, leaves, mesh, octree, solid, surface
from isoloom.operators.octree import CELL, Grid
from isoloom.sources import meshfiles
from isoloom.sources import particles as P

HERMITE = "depth int, ix int, iy int, iz int, edge int, px double, py double, pz double, nx double, ny double, nz double"
POINTS, FACES = "vid long, x double, y double, z double", "v0 long, v1 long, v2 long"
#: An octahedron, outward.
OCTA = [(0, 1.0, 0.0, 0.0), (1, -1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, -1.0, 0.0), (4, 0.0, 0.0, 1.0), (5, 0.0, 0.0, -1.0)]
OCTA_FACES = [(0, 2, 4), (2, 1, 4), (1, 3, 4), (3, 0, 4), (2, 0, 5), (1, 2, 5), (3, 1, 5), (0, 3, 5)]


def ball(spark, centre=(1.0, 1.0, 1.0), radius=0.5, step=0.15):
    axes = [np.arange(c - radius, c + radius + 1e-9, step) for c in centre]
    at = np.stack(np.meshgrid(*axes), -1).reshape(-1, 3)
    at = at[np.linalg.norm(at - np.array(centre), axis=1) < radius]
    return P.from_arrays(spark, at, np.full(len(at), 0.35))


def volume(m):
    return mesh.islands(m[0], m[1]).agg(F.sum("volume").alias("v")).first()["v"]


def test_cells_without_normals_have_their_centre(spark):
    rows = [(0, 1, 0, 0, 0, 1.2, 0.5, 0.5, 0.0, 0.0, 0.0), (0, 1, 0, 0, 1, 1.4, 0.5, 0.5, 0.0, 0.0, 0.0), (0, 0, 0, 0, 0, 0.3, 0.5, 0.5, -1.0, 0.0, 0.0)]
    got = {r["ix"]: r for r in octree.qef(spark.createDataFrame(rows, HERMITE), Grid(0.0, 4.0, 4, 1.0)).collect()}
    assert [got[1][c] for c in ("vx", "vy", "vz", "ax", "ay", "az", "usable", "rms")] == [1.5, 0.5, 0.5, 0.0, 0.0, 0.0, 0, 0.0]
    assert got[0]["vx"] == pytest.approx(0.35 / 1.1) and got[0]["usable"] == 1  # (0.3 + 0.1 * 0.5) / 1.1
    # without a weight one plane leaves the equations singular: the sample's place is taken
    flat = octree.qef(spark.createDataFrame(rows[2:], HERMITE), Grid(0.0, 4.0, 4, 1.0), weight=0.0).first()
    assert (flat["vx"], flat["vy"], flat["vz"]) == (0.3, 0.5, 0.5)


def test_no_length_links_nothing(spark):
    p = spark.createDataFrame([(7,), (3,), (9,)], "pid long")
    assert sorted(map(tuple, fof.cluster(p, 0.0).select("pid", "group").collect())) == [(3, 0), (7, 1), (9, 2)]


def test_closed_forms(spark):
    row = spark.range(1).selectExpr(
        f"{S.profile('0.5e0')} AS w", f"{S.kernel('0e0', '2e0')} AS top", f"{S.sign_mask(['0e0', '2e0', '2e0', '0e0', '2e0', '2e0', '0e0', '0e0'], '1e0')} AS mask",
        f"{S.neighbour_key('0', '0', 0, -1, 4)} AS out", f"{S.neighbour_key('7', '1', 0, 1, 1)} AS far", f"{S.neighbour_key('6', '1', 0, 1, 1)} AS near",
    ).first()
    assert row["w"] == pytest.approx(0.5**4 * 3) and row["top"] == pytest.approx(21 / (2 * math.pi) / 8)
    assert (row["mask"], row["out"], row["far"], row["near"]) == (54, None, None, 7)


@pytest.fixture(scope="module")
def deep(spark):
    """A tree of three depths around a ball and a speck, as its refinement rule gives it."""
    small = P.from_arrays(spark, [[3.1, 3.1, 3.1], [3.15, 3.1, 3.1], [3.1, 3.16, 3.1]], [0.3, 0.3, 0.3]).selectExpr("pid + 1000 AS pid", "x", "y", "z", "h")
    return api.build_tree(ball(spark, (1.3, 1.3, 1.3)).unionByName(small), Grid(0.0, 4.0, 4, 40.0, 2))


def test_surface_over_several_depths(deep):
    """Splitting missing leaves leaves few open edges: where a coarse leaf's interpolation and a fine one's sample differ
    in sign at the finest depth. Repair closes them."""
    assert deep.leaves.select("depth").distinct().count() > 1
    tree, verts = api.tree_vertices(deep)
    m = api.extract_mesh(deep, max_edge_ratio=0)
    n = [r["n"] for r in mesh.edge_counts(m.faces).collect()]
    assert n.count(2) >= 0.9 * len(n) and max(n) == 2
    assert {r["n"] for r in mesh.edge_counts(api.repair_mesh(m).faces).collect()} == {2}
    missing = surface.missing_incident(tree.leaves, verts, tree.grid, rings=0)
    assert missing.join(tree.leaves.where("depth < 2"), CELL).where("mask IN (0, 255)").count() == 0
    near = {(r["src"], r["dst"]) for r in surface.vertex_adjacency(tree.leaves, verts, tree.grid).collect()}
    assert near and all((b, a) in near for a, b in near)


def test_missing_leaves_are_split_and_activated(spark):
    """A coarse leaf whose corners miss what fine leaves beside it see in the middle of its face is found and split."""
    g = Grid(0.0, 2.0, 2, 10.0, 1)
    top = octree.top_cells(spark, g)
    cells = top.where("ix = 0").unionByName(octree.children(top.where("ix = 1")).select(*CELL))
    p = P.from_arrays(spark, [[1.05, 0.5, 0.5]], [0.4])
    tree = api.sampled(g, p, cells)
    verts = surface.vertices(tree.leaves, tree.contributors, g)
    missing = surface.missing_incident(tree.leaves, verts, g)
    assert missing.where("depth = 0").count() > 0
    split = surface.split_missing(tree.leaves, missing, g)
    assert split.where("depth = 1 AND ix < 2").count() > 0
    full = surface.activate_missing(tree.leaves, missing, verts, tree.contributors, g)
    assert sorted(r["vid"] for r in full.collect()) == list(range(full.count()))
    m = api.extract_mesh(tree, max_edge_ratio=0)
    assert {r["n"] for r in mesh.edge_counts(m.faces).collect()} == {2}


def test_masks_counts_and_diagonal_edges(spark):
    g = Grid(0.0, 4.0, 4, 1.0)
    cells = octree.top_cells(spark, g).selectExpr(*CELL, "CAST(ix * 16 + iy * 4 + iz AS bigint) AS lid", "1e0 AS size", "ix = 1 AND iy = 1 AND iz = 1 AS inside")
    nbr = solid.face_neighbours(cells.select("lid", *CELL), g)
    two = spark.createDataFrame([(21,), (41,)], "lid long")  # (1,1,1) and (2,2,1) meet in an edge
    full = {r["lid"] for r in solid.resolve_ambiguities(two, cells, nbr, g).collect()}
    assert full == {21, 41, 25}  # of (1,2,1) and (2,1,1), equal in all else, the lower number
    verts, faces = solid.blocky_surface(spark.createDataFrame([(k,) for k in full], "lid long"), cells, g)
    assert {r["n"] for r in mesh.edge_counts(faces).collect()} == {2} and volume((verts, faces)) == pytest.approx(3.0)
    tree = api.TreeState(g, None, cells, None)
    state = api.TopologyState(tree, cells, nbr, two)
    assert api.topology_counts(state).first().asDict() == {"n_leaves": 64, "n_inside": 1, "n_boundary_inside": 1, "n_boundary_outside": 6, "n_opened": 2}
    assert volume(solid.blocky_surface(api.with_mask(state, spark.createDataFrame([(5,)], "lid long")).opened, cells, g)) == pytest.approx(1.0)
    for bad in ([(99,)], [(5,), (5,)]):
        with pytest.raises(ValueError):
            api.with_mask(state, spark.createDataFrame(bad, "lid long"))
    dist = solid.outside_distance(cells, nbr, 2.0)
    assert leaves.thickening_band(cells, nbr, dist, 0.5, 1.0).count() == 0
    assert leaves.thickening_band(cells, nbr, dist, 0.5, 0.4).count() > 7
    assert leaves.refine_thickening_band(cells, cells.select("lid"), g) is None


def test_mesh_of_a_thickness(spark):
    m = api.generate_mesh(ball(spark), 0.0, 2.0, 4, 1, 40.0, max_edge_ratio=0, min_feature_thickness=0.4, pre_thickening_radius=0.25)
    assert m.faces.count() > 0 and {r["n"] for r in mesh.edge_counts(m.faces).collect()} == {2}


def test_each_group_has_a_surface(spark):
    p = ball(spark, (0.8, 0.8, 0.8), 0.4).unionByName(ball(spark, (3.0, 3.0, 3.0), 0.4).selectExpr("pid + 1000 AS pid", "x", "y", "z", "h"))
    p = p.unionByName(spark.createDataFrame([(5000, 0.1, 3.9, 0.1, 0.1)], p.schema))
    labels = p.selectExpr("pid", "CAST(pid div 1000 AS bigint) AS group")
    m = api.generate_group_meshes(p, labels, 0.0, 4.0, 4, 1, 40.0, max_edge_ratio=0)
    assert mesh.islands(m.vertices, m.faces).count() == 2
    with pytest.raises(ValueError):
        api.generate_group_meshes(p, labels, 0.0, 4.0, 4, 1, 40.0, least=10_000)


def test_repair_closes_turns_and_merges(spark):
    verts = spark.createDataFrame(OCTA + [(9, 0.0, 0.0, 1.0)], POINTS)
    faces = OCTA_FACES[:-1]  # one face is missing, some are turned, one has a vertex of its own
    faces = [(a, c, b) if i % 3 else (a, b, c) for i, (a, b, c) in enumerate(faces)]
    faces = [tuple(9 if v == 4 and i == 2 else v for v in f) for i, f in enumerate(faces)] + [(0, 0, 2)]
    points, whole = mesh.process(verts, spark.createDataFrame(faces, FACES))
    assert points.count() == 6 and whole.count() == 7
    fixed = mesh.fix_winding(points, whole)
    directed = [(r[a], r[b]) for r in fixed.collect() for a, b in ((0, 1), (1, 2), (2, 0))]
    assert len(set(directed)) == len(directed)
    closed = mesh.stitch(fixed)
    assert {r["n"] for r in mesh.edge_counts(closed).collect()} == {2}
    m = mesh.repair(verts, spark.createDataFrame([OCTA_FACES[0][::-1], *OCTA_FACES[1:]], FACES))
    assert volume(m) == pytest.approx(4 / 3)
    assert sorted(tuple(sorted(r)) for r in m[1].collect()) == sorted(tuple(sorted(f)) for f in OCTA_FACES)


def test_decimation(spark):
    verts, faces = spark.createDataFrame(OCTA, POINTS), spark.createDataFrame(OCTA_FACES, FACES)
    m = api.subdivide_mesh(api.Mesh(verts, faces, 1.0), 2)
    before = volume((m.vertices, m.faces))
    assert api.simplify_mesh(m, 1.0) is m
    small = api.simplify_mesh(m, 0.5)
    assert small.faces.count() == 64 and small.vertices.count() == 34
    assert {r["n"] for r in mesh.edge_counts(small.faces).collect()} == {2}
    assert volume((small.vertices, small.faces)) == pytest.approx(before, rel=0.15)
    with pytest.raises(ValueError):
        mesh.decimate(verts, faces, 0.0)


def test_files(spark, deep, tmp_path):
    verts, faces = spark.createDataFrame(OCTA, POINTS), spark.createDataFrame(OCTA_FACES, FACES)
    assert api.Mesh(verts, faces, 1.0).save(tmp_path / "m.obj") == 8
    lines = (tmp_path / "m.obj").read_text().split("\n")
    assert lines[0] == "v 1.0 0.0 0.0" and sum(x.startswith("f ") for x in lines) == 8
    with pytest.raises(ValueError):
        meshfiles.save_mesh(verts, faces, tmp_path / "m.xyz")
    path = str(tmp_path / "tree")
    deep.save(path, vertices=surface.vertices(deep.leaves, deep.contributors, deep.grid), labels=deep.particles.selectExpr("pid", "0L AS group"))
    assert api.TreeState.load(spark, path).leaves.count() == deep.leaves.count()
    extra = api.TreeState.load_extra(spark, path)
    assert set(extra) == {"vertices", "labels"} and extra["labels"].count() == deep.particles.count()


def test_snapshots_without_lengths_or_box(spark, tmp_path):
    p = ball(spark).drop("h").withColumn("box", F.array(F.lit(1.0), F.lit(2.0)))
    p.write.parquet(str(tmp_path / "p"))
    assert P.box_size(spark, str(tmp_path / "p")) == 2.0 and P.box_size(spark, str(tmp_path / "p"), 3) == 3.0
    loaded = P.load(spark, str(tmp_path / "p"), box=2.0)
    assert loaded.where("h > 0").count() == p.count()
    with pytest.raises(ValueError):
        P.load(spark, str(tmp_path / "p"))
    out = tmp_path / "m.stl"
    assert cli.main([str(tmp_path / "p"), "-o", str(out), "--max-depth", "0", "--base-resolution", "6", "-t", "20", "--fof", "--linking-factor", "1.5", "--simplify-factor", "0.7", "--silent"]) == 0
    assert len(meshfiles.read_stl(out)) > 10
    assert cli.main(["-o", str(out)]) == 1 and cli.main([str(tmp_path / "p"), "--load-octree", "x", "--fof"]) == 1
