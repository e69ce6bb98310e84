"""Closed-form values and invariants of the field engine."""

import duckdb
import pytest

from isoloom.functions import scalar as S
from isoloom.operators import fof, mesh, octree
from isoloom.operators.graph import connected_components
from isoloom.operators.numbering import numbered
from isoloom.operators.octree import CELL, Grid
from isoloom.sources import particles as P


def value(spark, sql):
    return spark.sql(f"SELECT {sql} AS v").first()["v"]


def test_morton_round_trip(spark):
    assert value(spark, S.morton_encode("7", "11", "13")) == 3423
    assert [value(spark, S.morton_decode("3423", i)) for i in range(3)] == [7, 11, 13]


def test_kernel_ends(spark):
    assert value(spark, S.profile("0e0")) == 1.0
    assert value(spark, S.profile("1e0")) == 0.0
    assert value(spark, S.kernel("0e0", "0e0")) == 0.0


def test_sign_mask_and_straddle(spark):
    v = [f"{x}e0" for x in (0, 0.6, 0.7, 0.2, 0.8, 0.9, 0.1, 0)]
    assert value(spark, S.sign_mask(v, "0.5e0")) == 54
    assert value(spark, S.straddles(v, "0.5e0")) is True
    assert value(spark, S.straddles(["0.1e0"] * 8, "0.5e0")) is False


def test_print_units():
    assert S.native_length(0.4, 2.0, 10.0) == pytest.approx(0.08)
    with pytest.raises(ValueError):
        S.print_scale(0.0, 10.0)


def test_bins_and_contributors(spark):
    p = P.from_arrays(spark, [(0.1, 0.1, 0.1), (0.6, 0.1, 0.1), (0.6, 0.6, 0.6)], [0.05, 0.2, 0.05])
    g = Grid(0.0, 1.0, 2, 0.5)
    counts = [r["n"] for r in octree.bin_counts(p, g).orderBy("ix", "iy", "iz").collect()]
    assert counts == [1, 0, 0, 0, 1, 0, 0, 1]
    pairs = {(r["ix"], r["iy"], r["iz"], r["pid"]) for r in octree.contributors(p, g).collect()}
    assert {(0, 0, 0, 0), (1, 0, 0, 1), (0, 0, 0, 1), (1, 1, 1, 2)} <= pairs
    assert {r["pid"] for r in octree.query_box(p, [0.5] * 3, [1.0] * 3).collect()} == {2}


def test_bad_input(spark):
    with pytest.raises(ValueError):
        Grid(0.0, 1.0, 0, 0.5)
    with pytest.raises(ValueError):
        P.from_arrays(spark, [(1.0, 2.0)], [0.1])
    with pytest.raises(ValueError):
        P.tighten(P.from_arrays(spark, [(0.5, 0.5, 0.5)], [0.1]).where("pid < 0"), 1.0)


def test_qef_of_one_plane(spark):
    rows = [(0, 0, 0, 0, e, 0.35, y, z, 1.0, 0.0, 0.0) for e, (y, z) in enumerate(((0.2, 0.2), (0.8, 0.2), (0.2, 0.8), (0.8, 0.8)))]
    samples = spark.createDataFrame(rows, "depth int, ix int, iy int, iz int, edge int, px double, py double, pz double, nx double, ny double, nz double")
    got = octree.qef(samples, Grid(0.0, 1.0, 1, 0.5)).first()
    assert got["vx"] == pytest.approx((4 * 0.35 + 0.1 * 0.5) / 4.1)
    assert got["vy"] == pytest.approx(0.5) and got["alignment"] == pytest.approx(1.0)


def test_balance_is_two_to_one(spark):
    from isoloom.plans.catalog import _corner_tree

    leaves = [tuple(r) for r in octree.balance(_corner_tree(spark), 3).select(*CELL).collect()]
    assert sum(8.0**-d for d, *_ in leaves) == pytest.approx(64)
    box = [([i << (3 - d) for i in at], 1 << (3 - d), d) for d, *at in leaves]
    for a, s, d in box:
        for b, t, e in box:
            touch = [a[i] + s == b[i] or b[i] + t == a[i] for i in range(3)]
            over = [a[i] < b[i] + t and b[i] < a[i] + s for i in range(3)]
            if any(touch[i] and all(over[j] for j in range(3) if j != i) for i in range(3)):
                assert abs(d - e) <= 1


def test_components_match_recursion(spark):
    pairs = [(i, i + 1) for i in range(0, 40) if i % 7] + [(100, 3), (5, 5), (None, 2)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE e(a BIGINT, b BIGINT)")
    con.executemany("INSERT INTO e VALUES (?, ?)", [p for p in pairs if p[0] is not None and p[0] != p[1]])
    want = dict(con.sql("WITH RECURSIVE s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(n, m) AS (SELECT a, a FROM s UNION SELECT s.b, r.m FROM r JOIN s ON s.a = r.n) SELECT n, min(m) FROM r GROUP BY n").fetchall())
    assert got == want


def test_fof_two_groups(spark):
    p = P.from_arrays(spark, [(0.0, 0, 0), (0.1, 0, 0), (5.0, 5, 5), (5.1, 5, 5), (5.2, 5, 5)], [0.1] * 5)
    labels = fof.cluster(p, 0.15)
    assert [r["group"] for r in labels.orderBy("pid").collect()] == [0, 0, 1, 1, 1]
    assert fof.drop_small(p, labels, 3).count() == 3
    with pytest.raises(ValueError):
        fof.drop_small(p, labels, 0)


def test_numbers_are_dense(spark):
    got = numbered(spark.range(1000).selectExpr("id * 7 % 1009 AS k"), ["k"], "n").orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(1000))


def test_mesh_operators(spark):
    verts = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 4.0, 0.0, 0.0), (2, 0.0, 4.0, 0.0), (3, 0.0, 0.0, 4.0)], "vid long, x double, y double, z double")
    faces = spark.createDataFrame([(0, 2, 1), (0, 1, 3), (0, 3, 2), (1, 2, 3)], "v0 long, v1 long, v2 long")
    assert {r["n"] for r in mesh.edge_counts(faces).collect()} == {2}
    assert mesh.islands(verts, faces).first()["volume"] == pytest.approx(64 / 6)
    v, f = mesh.subdivide_long(verts, faces, verts.selectExpr("vid", "2e0 AS size"), 1.0)
    assert v.count() == 4 + 3 * 1 + 3 * 2 and f.count() == sum(n - 2 for n in (7, 7, 7, 9))
    assert mesh.remove_islands(verts, faces, 0.0).count() == 4
