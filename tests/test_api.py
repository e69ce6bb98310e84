import numpy as np
import pytest

from isoloom import api, cli
from isoloom.operators import mesh, subdivision
from isoloom.operators.octree import CELL, Grid, contributors
from isoloom.operators.leaves import leaf_contributors
from isoloom.sources import meshfiles
from isoloom.sources import particles as P


@pytest.fixture(scope="module")
def ball(spark):
    at = np.stack(np.meshgrid(*[np.arange(0.55, 1.5, 0.15)] * 3), -1).reshape(-1, 3)
    at = at[np.linalg.norm(at - 1.0, axis=1) < 0.5]
    return P.from_arrays(spark, at, np.full(len(at), 0.35))


@pytest.fixture(scope="module")
def tree(ball):
    return api.build_tree(ball, Grid(0.0, 2.0, 4, 60.0, 1))


def corners(spark):
    verts = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 4.0, 0.0, 0.0), (2, 0.0, 4.0, 0.0), (3, 0.0, 0.0, 4.0)], "vid long, x double, y double, z double")
    return verts, spark.createDataFrame([(0, 2, 1), (0, 1, 3), (0, 3, 2), (1, 2, 3)], "v0 long, v1 long, v2 long")


def test_leaf_contributors_are_those_of_each_depth(ball, tree):
    got = {tuple(r) for r in leaf_contributors(ball, tree.leaves, tree.grid).select(*CELL, "pid").collect()}
    want = set()
    for depth in (0, 1):
        want |= {tuple(r) for r in contributors(ball, tree.grid, depth).join(tree.leaves, CELL, "left_semi").select(*CELL, "pid").collect()}
    assert got == want and len(got) > 0


def test_surface_of_a_ball_is_closed(tree):
    m = api.extract_mesh(tree, max_edge_ratio=0)
    assert m.faces.count() > 20
    assert {r["n"] for r in mesh.edge_counts(m.faces).collect()} == {2}
    assert 0.1 < mesh.islands(m.vertices, m.faces).first()["volume"] < 1.5


def test_opened_solid_and_stored_tree(spark, tree, tmp_path):
    tree.save(str(tmp_path / "tree"))
    again = api.TreeState.load(spark, str(tmp_path / "tree"))
    assert again.grid == tree.grid and again.leaves.count() == tree.leaves.count()
    state = api.regularize(again, 0.5, clean=True)
    m = api.extract_mesh(state, smoothing_iterations=1, max_edge_ratio=0)
    assert all(r["n"] % 2 == 0 for r in mesh.edge_counts(m.faces).collect())
    with pytest.raises(TypeError):
        api.extract_mesh("tree")
    with pytest.raises(ValueError):
        api.regularize(tree, 0.0)


def test_stl_round_trip(spark, tmp_path):
    verts, faces = corners(spark)
    assert meshfiles.save_stl(verts, faces, tmp_path / "m.stl") == 4
    got = {tuple(map(tuple, t)) for t in meshfiles.read_stl(tmp_path / "m.stl").tolist()}
    at = {r["vid"]: (r["x"], r["y"], r["z"]) for r in verts.collect()}
    assert got == {tuple(at[v] for v in f) for f in faces.collect()}
    with pytest.raises(Exception):
        meshfiles.save_stl(verts.selectExpr("vid", "x", "y", "raise_error('no') AS z"), faces, tmp_path / "n.stl")
    assert [f.name for f in tmp_path.iterdir()] == ["m.stl"]


def test_loop_subdivision(spark):
    verts, faces = subdivision.loop(*corners(spark), 2)
    assert (verts.count(), faces.count()) == (34, 64)
    assert {r["n"] for r in mesh.edge_counts(faces).collect()} == {2}
    one, _ = subdivision.loop(*corners(spark))
    # valence 3: weight 3/16 of each neighbour
    assert one.where("vid = 0").first()["x"] == pytest.approx(4 * 3 / 16)


def test_command_line(ball, tmp_path, capsys):
    ball.write.parquet(str(tmp_path / "p"))
    out = tmp_path / "ball.stl"
    args = [str(tmp_path / "p"), "-b", "2", "-o", str(out), "--base-resolution", "4", "--max-depth", "0", "-t", "60", "-s", "5"]
    assert cli.main(args) == 0
    t = meshfiles.read_stl(out).reshape(-1, 3)
    assert (t.max(0) - t.min(0)).max() == pytest.approx(50, rel=1e-4)
    assert cli.main(args + ["--center", "1", "1", "1"]) == 1
