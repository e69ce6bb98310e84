"""Registered queries of the field engine and their DuckDB equivalents.

The SQL is written for a plain engine and by itself: range joins are theta joins, components are recursive, and
scalar functions have formulas of their own in `plain.py`. Kernel sums take the same terms on both sides, as their
decimals have to agree to the last digit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoloom.functions import scalar as S
from isoloom.operators import fof, mesh, octree, solid, subdivision, surface
from isoloom.operators.leaves import leaf_contributors, leaf_samples, with_ids
from isoloom.operators.octree import CELL, VALUES, Grid
from isoloom.plans import plain
from isoloom.session import cut
from isoloom.sources import particles as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

WIDE = Grid(0.0, 4.0, 8, 200.0)  # orders
FINE = Grid(0.0, 4.0, 16, 60.0)  # embeddings
TREE = Grid(0.0, 4.0, 8, 60.0, 1)
LINK, LIMIT = 0.16, 1.0

P_ORDER = """P AS (SELECT o_orderkey AS pid, o_totalprice / 125000e0 AS x, o_custkey::double * 4e0 / (SELECT max(o_custkey) + 1 FROM orders)::double AS y,
 datediff('day', timestamp '1995-01-01', o_orderdate)::double / 602e0 AS z, 0.25e0 AS h FROM orders)"""
P_EMB = "P AS (SELECT vec_id AS pid, embedding[1]::double * 2e0 + 2e0 AS x, embedding[2]::double * 2e0 + 2e0 AS y, embedding[3]::double * 2e0 + 2e0 AS z, 0.2e0 + 0.01e0 * label::double AS h FROM embeddings)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def columns(name: str, view: Query, cte: str, plain_columns: list[str], *cols: str) -> None:
    """A query that only computes columns of particles; DuckDB gets formulas of its own."""
    SQL[name] = f"WITH {cte} SELECT pid, {', '.join(plain_columns)} FROM P"
    QUERIES[name] = lambda s, d: view(s, d).selectExpr("pid", *cols)


def cells_sql(r: int, depth: int = 0) -> str:
    n = f"unnest(range({r})) AS"
    return f"X AS (SELECT {n} ix), Y AS (SELECT {n} iy), Z AS (SELECT {n} iz), C AS (SELECT {depth} AS depth, ix::int AS ix, iy::int AS iy, iz::int AS iz FROM X, Y, Z)"


def contrib_sql(g: Grid) -> str:
    lo, hi = g.bounds()
    return f"K AS (SELECT C.*, P.* FROM C JOIN P ON {S.support_overlaps(lo, hi)})"


def samples_sql(g: Grid, source: str = "K", name: str = "V") -> str:
    lo, hi = g.bounds()
    sums = [f"CAST(sum({octree.kernel_at(*[hi[k] if b else lo[k] for k, b in enumerate(bits)])}) AS double) AS v{i}" for i, bits in enumerate(S.CORNERS)]
    inner = f"SELECT depth, ix, iy, iz, count(*) AS n, {', '.join(sums)} FROM {source} GROUP BY depth, ix, iy, iz"
    return f"{name} AS (SELECT *, {plain.sign_mask(VALUES, g.isovalue)} AS mask, {plain.straddles(VALUES, g.isovalue)} AS straddles FROM ({inner}))"


def hermite_sql(g: Grid, v: str = "V", k: str = "K", x: str = "") -> str:
    """Tables E, G and H (with a suffix): edge crossings, their gradients, unit normals."""
    lo, hi = g.bounds()
    parts = []
    for e, (a, b) in enumerate(S.EDGES):
        axis = (a ^ b).bit_length() - 1
        at = [hi[i] if S.CORNERS[a][i] else lo[i] for i in range(3)]
        at[axis] = f"({lo[axis]} + ({plain.crossing(f'v{a}', f'v{b}', g.isovalue)}) * ({hi[axis]} - {lo[axis]}))"
        parts.append(f"SELECT depth, ix, iy, iz, {e} AS edge, {at[0]} AS px, {at[1]} AS py, {at[2]} AS pz FROM {v} WHERE mask NOT IN (0, 255) AND ((mask >> {a}) & 1) <> ((mask >> {b}) & 1)")
    slope = S.kernel_slope(S.distance("px - x", "py - y", "pz - z"), "h")
    sums = ", ".join(f"CAST(sum(CAST((p{a} - {a}) * ({slope}) AS decimal(28, 9))) AS double) AS g{a}" for a in "xyz")
    norm = "sqrt(gx * gx + gy * gy + gz * gz)"
    normal = ", ".join(f"CASE WHEN {norm} <= 1e-12 THEN 0e0 ELSE -g{a} / {norm} END AS n{a}" for a in "xyz")
    return f"E{x} AS ({' UNION ALL '.join(parts)}), G{x} AS (SELECT depth, ix, iy, iz, edge, px, py, pz, {sums} FROM E{x} JOIN {k} USING (depth, ix, iy, iz) GROUP BY ALL), H{x} AS (SELECT depth, ix, iy, iz, edge, px, py, pz, {normal} FROM G{x})"


def qef_sql(g: Grid, x: str = "") -> str:
    """The normal equations solved by elimination, row by row, instead of Cramer's rule; then residuals by a join.

    Tables Q (vertices, also of cells without a usable normal) and R (with alignment and rms).
    """
    lo, hi = g.bounds()
    c = [f"(({lo[i]} + {hi[i]}) / 2e0)" for i in range(3)]
    d = "(nx * px + ny * py + nz * pz)"
    m = ", ".join(f"sum(n{a} * n{b}){' + 0.1e0' if a == b else ''} AS m{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))
    r = ", ".join(f"sum({d} * n{a}) + 0.1e0 * {c[i]} AS r{a}" for i, a in enumerate("xyz"))
    some = "(nx <> 0 OR ny <> 0 OR nz <> 0)"
    unit = ", ".join(f"CASE WHEN sqrt(sx * sx + sy * sy + sz * sz) <= 1e-12 THEN 0e0 ELSE s{a} / sqrt(sx * sx + sy * sy + sz * sz) END AS a{a}" for a in "xyz")
    off = "((vx - px) * nx + (vy - py) * ny + (vz - pz) * nz)"
    return f"""Q0{x} AS (SELECT depth, ix, iy, iz, count(*) FILTER ({some}) AS usable, {m}, {r}, sum(nx) AS sx, sum(ny) AS sy, sum(nz) AS sz FROM H{x} GROUP BY depth, ix, iy, iz),
 Q1{x} AS (SELECT *, myy - mxy * mxy / mxx AS b22, myz - mxy * mxz / mxx AS b23, mzz - mxz * mxz / mxx AS b33, ry - mxy * rx / mxx AS c2, rz - mxz * rx / mxx AS c3 FROM Q0{x}),
 Q2{x} AS (SELECT *, (c3 - b23 * c2 / b22) / (b33 - b23 * b23 / b22) AS qz FROM Q1{x}), Q3{x} AS (SELECT *, (c2 - b23 * qz) / b22 AS qy FROM Q2{x}), Q4{x} AS (SELECT *, (rx - mxy * qy - mxz * qz) / mxx AS qx FROM Q3{x}),
 Q{x} AS (SELECT depth, ix, iy, iz, usable, {', '.join(f'CASE WHEN usable = 0 THEN {c[i]} ELSE least(greatest(q{a}, {lo[i]}), {hi[i]}) END AS v{a}' for i, a in enumerate('xyz'))}, {unit} FROM Q4{x}),
 RS{x} AS (SELECT depth, ix, iy, iz, sqrt(avg({off} * {off})) AS rms, CASE WHEN count(*) < 2 THEN 1e0 ELSE min(nx * ax + ny * ay + nz * az) END AS alignment FROM H{x} JOIN Q{x} USING (depth, ix, iy, iz) WHERE {some} GROUP BY depth, ix, iy, iz),
 R{x} AS (SELECT Q{x}.*, coalesce(rms, 0e0) AS rms, coalesce(alignment, 1e0) AS alignment FROM Q{x} LEFT JOIN RS{x} USING (depth, ix, iy, iz))"""


# particles -------------------------------------------------------------------------------------------

query("prj1_shift_wrap", f"WITH {P_ORDER} SELECT pid, ((x + 1.3e0) - 4e0 * floor((x + 1.3e0) / 4e0)) AS x, ((y + -2.1e0) - 4e0 * floor((y + -2.1e0) / 4e0)) AS y, ((z + 0.7e0) - 4e0 * floor((z + 0.7e0) / 4e0)) AS z, h FROM P")(
    lambda s, d: P.shift(P.orders_view(s, d), (1.3, -2.1, 0.7), 4.0)
)
_delta = lambda a, c: f"((({a} - {c}e0 + 2e0) - 4e0 * floor(({a} - {c}e0 + 2e0) / 4e0)) - 2e0)"
query("prj2_crop_periodic", f"WITH {P_ORDER}, D AS (SELECT pid, h, {_delta('x', 0.2)} AS dx, {_delta('y', 3.9)} AS dy, {_delta('z', 2.0)} AS dz FROM P) SELECT pid, dx + 0.75e0 AS x, dy + 0.75e0 AS y, dz + 0.75e0 AS z, h FROM D WHERE abs(dx) <= 0.75e0 AND abs(dy) <= 0.75e0 AND abs(dz) <= 0.75e0")(
    lambda s, d: P.crop(P.orders_view(s, d), (0.2, 3.9, 2.0), 1.5, 4.0)
)
query("prj3_crop_box", f"WITH {P_ORDER} SELECT pid, x - 1e0 AS x, y - 1.25e0 AS y, z - 1.5e0 AS z, h FROM P WHERE x >= 1e0 AND x < 2.5e0 AND y >= 1.25e0 AND y < 2.75e0 AND z >= 1.5e0 AND z < 3e0")(
    lambda s, d: P.crop(P.orders_view(s, d), (1.75, 2.0, 2.25), 1.5, 4.0, periodic=False)
)
query("prj4_tight_bounds", f"WITH {P_EMB}, B AS (SELECT greatest(min(x - h), 0e0) AS x0, greatest(min(y - h), 0e0) AS y0, greatest(min(z - h), 0e0) AS z0, least(max(x + h), 4e0) AS x1, least(max(y + h), 4e0) AS y1, least(max(z + h), 4e0) AS z1 FROM P) SELECT x0, y0, z0, greatest(x1 - x0, y1 - y0, z1 - z0) AS side FROM B")(
    lambda s, d: P.tight_bounds(P.embeddings_view(s, d), 4.0)
)
query("prj6_isovalue", f"WITH {P_EMB} SELECT round(quantile_cont(21e0 / (2e0 * pi() * h * h * h), 0.05), 6) AS isovalue FROM P")(lambda s, d: P.isovalue(P.embeddings_view(s, d), 5).selectExpr("round(isovalue, 6) AS isovalue"))
_lo, _hi = ["1e0", "1e0", "1e0"], ["2.5e0", "2e0", "3e0"]
columns("prj8_closed_box", P.orders_view, P_ORDER, plain.CLOSED_BOX, f"{S.closed_box(_lo, _hi)} AS inside")
columns("prj9_box_predicates", P.orders_view, P_ORDER, plain.BOXES, f"{S.box_contains(_lo, _hi)} AS inside", f"{S.box_overlaps(_lo, _hi, ['x - h', 'y - h', 'z - h'], ['x + h', 'y + h', 'z + h'])} AS overlaps")
columns("prj10_centre_extent", P.orders_view, P_ORDER, plain.CENTRE, *[f"{v} AS {n}{a}" for a in "xyz" for n, v in zip("ce", P.centre_and_extent(f"{a} - h", f"{a} + 3e0 * h"))])

# scalar functions ------------------------------------------------------------------------------------

_IX = ["CAST(floor(x * 1000e0) AS bigint)", "CAST(floor(y * 1000e0) AS bigint)", "CAST(floor(z * 1000e0) AS bigint)"]
columns("fn1_morton_encode", P.orders_view, P_ORDER, plain.MORTON, f"{S.morton_encode(*_IX)} AS morton")
columns("fn2_morton_decode", P.orders_view, P_ORDER, plain.DECODED, *[f"CAST({S.morton_decode('pid', i)} AS bigint) AS i{a}" for i, a in enumerate("xyz")])
columns("fn3_pack", P.orders_view, P_ORDER, plain.PACKED, f"{S.pack(*_IX)} AS packed")
_R = S.distance("x - 2e0", "y - 2e0", "z - 2e0")
_nine = plain.nine  # how values are shown, the same on both sides
columns("fn4_kernel_profile", P.orders_view, P_ORDER, plain.PROFILE, _nine(S.profile(f"({_R} / 2e0)"), "w"))
columns("fn5_kernel", P.embeddings_view, P_EMB, plain.KERNEL, _nine(S.kernel(_R, "(4e0 * h)"), "w"), _nine(S.kernel(_R, "(4e0 * h)", False), "raw"))
columns("fn6_kernel_grad", P.embeddings_view, P_EMB, plain.SLOPE, *[_nine(f"({a} - 2e0) * ({S.kernel_slope(_R, '(4e0 * h)')})", f"g{a}") for a in "xyz"])
columns("fn7_support_overlap", P.orders_view, P_ORDER, plain.SUPPORT, f"{S.support_overlaps(_lo, _hi)} AS touches")
columns("fn8_bins", P.orders_view, P_ORDER, plain.BINS, *[f"{S.bin_of(a, 0.5, 0.5, 6)} AS i{a}" for a in "xyz"])
columns("fn10_crossing", P.orders_view, P_ORDER, plain.CROSSING, _nine(S.crossing("x", "y", "2e0"), "t"))
_V8 = ["x", "y", "z", "x * y", "y * z", "x + z", "z - x", "h"]
columns("fn11_straddle", P.orders_view, P_ORDER, plain.STRADDLE, f"{S.straddles(_V8, '2.5e0')} AS straddles")
columns("fn12_sign_mask", P.orders_view, P_ORDER, plain.MASK, f"{S.sign_mask(_V8, '2e0')} AS mask")
columns("fn16_trilinear_sign", P.orders_view, P_ORDER, plain.TRILINEAR, _nine(S.trilinear(_V8, "0.337e0", "0.519e0", "0.731e0"), "v"), f"round({S.trilinear(_V8, '0.337e0', '0.519e0', '0.731e0')}, 9) >= 2e0 AS inside")
columns("fn17_neighbour_key", P.orders_view, P_ORDER, plain.NEIGHBOUR, *[f"{S.neighbour_key('(pid % 512)', '3', i, d, 1)} AS k{i}{'ab'[d > 0]}" for i in range(3) for d in (-1, 1)])


@query("fn18_share_face", plain.SHARE_FACE.format(P=P_ORDER))
def _share_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = P.orders_view(spark, sf_dir).selectExpr("pid", "CAST(pid % 3 AS int) AS adepth", "CAST(pid div 3 % 3 AS int) AS bdepth", "pid div 9 AS r")
    o = o.selectExpr("*", *[f"CAST((r div {7**k}) % (2 << {c}depth) AS int) AS {c}i{a}" for c, ks in (("a", (0, 1, 2)), ("b", (2, 0, 1))) for a, k in zip("xyz", ks)])
    return o.selectExpr("pid", f"{S.share_face('a', 'b', 2)} AS share")


@query("fn13_child_bounds", plain.CHILD_BOUNDS)
def _child_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi = WIDE.bounds()
    return octree.children(octree.top_cells(spark, WIDE)).selectExpr(*CELL, "child", *[f"{e} AS {n}{a}" for n, b in (("lo", lo), ("hi", hi)) for a, e in zip("xyz", b)])


# joins and aggregates --------------------------------------------------------------------------------

_bins = ", ".join(f"CAST(least(greatest(floor({a} / 0.5e0), 0), 7) AS int) AS i{a}" for a in "xyz")
query("jn1_bin_counts", f"WITH {P_ORDER}, {cells_sql(8)}, B AS (SELECT {_bins} FROM P) SELECT C.ix, C.iy, C.iz, count(B.ix) AS n FROM C LEFT JOIN B USING (ix, iy, iz) GROUP BY ALL")(lambda s, d: octree.bin_counts(P.orders_view(s, d), WIDE))
query("jn2_query_contributors", f"WITH {P_ORDER} SELECT pid FROM P WHERE {S.support_overlaps(_lo, _hi)}")(lambda s, d: octree.query_box(P.orders_view(s, d), [1.0, 1.0, 1.0], [2.5, 2.0, 3.0]).select("pid"))
_base = f"WITH {P_ORDER}, {cells_sql(8)}, {contrib_sql(WIDE)}"
_emb = f"WITH {P_EMB}, {cells_sql(16)}, {contrib_sql(FINE)}, {samples_sql(FINE)}"
query("jn3_cell_contributors", f"{_base} SELECT ix, iy, iz, pid FROM K")(lambda s, d: octree.contributors(P.orders_view(s, d), WIDE).select("ix", "iy", "iz", "pid"))
query("jn4_child_contributors", f"WITH {P_EMB}, {cells_sql(16, 1)}, {contrib_sql(WIDE)} SELECT depth, ix, iy, iz, pid FROM K")(
    lambda s, d: octree.child_contributors(octree.contributors(P.embeddings_view(s, d), WIDE), WIDE).select(*CELL, "pid")
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-level cells with contributors: count, sign mask, whether the surface may pass."""
    found = octree.with_surface(octree.corner_samples(octree.contributors(P.orders_view(spark, sf_dir), WIDE), WIDE), WIDE)
    return found.select("ix", "iy", "iz", "n", "mask", "straddles")


query("m1_straddling_cells", f"{_base}, {samples_sql(WIDE)} SELECT ix, iy, iz, n, mask, straddles FROM V")(flagship)
query("ag2_corner_samples", f"{_base}, {samples_sql(WIDE)} SELECT ix, iy, iz, {', '.join(VALUES)} FROM V")(
    lambda s, d: octree.corner_samples(octree.contributors(P.orders_view(s, d), WIDE), WIDE).select("ix", "iy", "iz", *VALUES)
)


@query("ag1_density", f"WITH {P_EMB}, {cells_sql(17)}, Q AS (SELECT ix * 10000 + iy * 100 + iz AS qid, ix * 0.25e0 AS qx, iy * 0.25e0 AS qy, iz * 0.25e0 AS qz FROM C) SELECT qid, count(*) AS n, CAST(sum({octree.kernel_at('qx', 'qy', 'qz')}) AS double) AS density FROM Q JOIN P ON (qx - x) * (qx - x) + (qy - y) * (qy - y) + (qz - z) * (qz - z) < h * h GROUP BY qid")
def _density(spark: SparkSession, sf_dir: str) -> DataFrame:
    lattice = octree.top_cells(spark, Grid(0.0, 4.0, 17, 0.0)).selectExpr("ix * 10000 + iy * 100 + iz AS qid", *[f"i{a} * 0.25e0 AS q{a}" for a in "xyz"])
    return octree.density(lattice, P.embeddings_view(spark, sf_dir), FINE)


query("ag6_bin_max_h", f"WITH {P_EMB}, B AS (SELECT {_bins}, h FROM P) SELECT ix, iy, iz, max(h) AS max_h FROM B GROUP BY ALL UNION ALL SELECT NULL, NULL, NULL, max(h) FROM B")(
    lambda s, d: P.bin_max_h(P.embeddings_view(s, d), 0.0, 0.5, 8)
)
query("src3_lengths", f"WITH {P_EMB}, B AS (SELECT pid, x, y, z, {_bins} FROM P), D AS (SELECT p.pid, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)) AS d FROM B p JOIN B q ON p.pid <> q.pid AND abs(p.ix - q.ix) <= 1 AND abs(p.iy - q.iy) <= 1 AND abs(p.iz - q.iz) <= 1), N AS (SELECT pid, d, row_number() OVER (PARTITION BY pid ORDER BY d) AS k FROM D) SELECT P.pid, round(coalesce(1.8e0 * max(d) FILTER (k <= 32), 0.5e0), 9) AS h FROM P LEFT JOIN N USING (pid) GROUP BY P.pid")(
    lambda s, d: P.estimate_lengths(P.embeddings_view(s, d), 4.0, 8).groupBy("pid").agg(F.round(F.max("h"), 9).alias("h"))
)


def _mesh_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    contrib = octree.contributors(P.embeddings_view(spark, sf_dir), FINE)
    return contrib, octree.with_surface(octree.corner_samples(contrib, FINE), FINE)


_H6 = ", ".join(f"round({c}, 6) AS {c}" for c in ("px", "py", "pz", "nx", "ny", "nz"))
_Q6 = ", ".join(f"round(v{a}, 6) AS v{a}" for a in "xyz")


@query("ag3_gradient", f"{_emb}, {hermite_sql(FINE)} SELECT ix, iy, iz, edge, round(gx, 6) AS gx, round(gy, 6) AS gy, round(gz, 6) AS gz FROM G")
def _gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    contrib, v = _mesh_parts(spark, sf_dir)
    points = octree.hermite(v, contrib, FINE).select(*CELL, "edge", "px", "py", "pz")
    return octree.gradient(points, CELL, contrib).selectExpr("ix", "iy", "iz", "edge", *[f"round(g{a}, 6) AS g{a}" for a in "xyz"])


@query("ag4_hermite", f"{_emb}, {hermite_sql(FINE)} SELECT ix, iy, iz, edge, {_H6} FROM H")
def _hermite(spark: SparkSession, sf_dir: str) -> DataFrame:
    contrib, v = _mesh_parts(spark, sf_dir)
    return octree.hermite(v, contrib, FINE).selectExpr("ix", "iy", "iz", "edge", *[f"round({c}, 6) AS {c}" for c in ("px", "py", "pz", "nx", "ny", "nz")])


@query("ag5_qef", f"{_emb}, {hermite_sql(FINE)}, {qef_sql(FINE)} SELECT ix, iy, iz, usable, {_Q6} FROM Q")
def _qef(spark: SparkSession, sf_dir: str) -> DataFrame:
    contrib, v = _mesh_parts(spark, sf_dir)
    return octree.qef(octree.hermite(v, contrib, FINE), FINE).selectExpr("ix", "iy", "iz", "usable", *[f"round(v{a}, 6) AS v{a}" for a in "xyz"])


@query("fn14_normal_alignment", f"{_emb}, {hermite_sql(FINE)}, {qef_sql(FINE)} SELECT ix, iy, iz, round(alignment, 6) AS alignment, round(rms, 6) AS rms FROM R")
def _alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    contrib, v = _mesh_parts(spark, sf_dir)
    return octree.qef(octree.hermite(v, contrib, FINE), FINE).selectExpr("ix", "iy", "iz", "round(alignment, 6) AS alignment", "round(rms, 6) AS rms")


# octree ----------------------------------------------------------------------------------------------

query("ot1_top_cells", f"WITH {cells_sql(8)} SELECT depth, ix, iy, iz, {S.morton_encode('ix', 'iy', 'iz')} AS morton FROM C")(lambda s, d: octree.top_cells(s, WIDE).selectExpr(*CELL, f"{S.morton_encode('ix', 'iy', 'iz')} AS morton"))
query("ot2_children", f"WITH {cells_sql(16, 1)} SELECT depth, ix, iy, iz FROM C")(lambda s, d: octree.children(octree.top_cells(s, WIDE)).select(*CELL))
_fit = f"usable >= 3 AND alignment >= 0.97e0 AND rms <= 0.1e0 * {S.num(TREE.width() * 3**0.5 / 2)}"
_T0 = f"{P_EMB}, {cells_sql(8)}, {contrib_sql(TREE)}, {samples_sql(TREE)}, {hermite_sql(TREE)}, {qef_sql(TREE)}, L0 AS (SELECT C.*, coalesce(n, 0) AS n, coalesce(mask, 0) AS mask, coalesce(n >= 2 AND straddles, false) AS live, coalesce(n >= 2 AND straddles, false) AND NOT coalesce({_fit}, false) AS split, {', '.join(f'coalesce({v}, 0e0) AS {v}' for v in VALUES)} FROM C LEFT JOIN V USING (depth, ix, iy, iz) LEFT JOIN R USING (depth, ix, iy, iz))"
_child = f"C1 AS (SELECT 1 AS depth, ix * 2 + a AS ix, iy * 2 + b AS iy, iz * 2 + c AS iz FROM L0, (SELECT unnest([0, 1]) AS a) A, (SELECT unnest([0, 1]) AS b) B, (SELECT unnest([0, 1]) AS c) D WHERE split), K1 AS (SELECT C1.*, P.* FROM C1 JOIN P ON {S.support_overlaps(*TREE.bounds())}), {samples_sql(TREE, 'K1', 'V1')}"
_near = " AND ".join(f"HP.p{a} BETWEEN C1.i{a} * 0.25e0 - 1e-12 AND (C1.i{a} + 1) * 0.25e0 + 1e-12 AND C1.i{a} // 2 = HP.i{a}" for a in "xyz")
_hint = f"HP AS (SELECT ix, iy, iz, px, py, pz FROM H UNION ALL SELECT ix, iy, iz, vx, vy, vz FROM Q), HI AS (SELECT DISTINCT C1.depth, C1.ix, C1.iy, C1.iz, true AS hint FROM C1 JOIN HP ON {_near})"
_T1 = f"{_T0}, {_child}, {_hint}, T AS (SELECT depth, ix, iy, iz, NOT split AS is_leaf, live AND NOT split AS is_active, mask, n FROM L0 UNION ALL SELECT C1.*, true, coalesce(n >= 2 AND (straddles OR coalesce(hint, false)), false), coalesce(mask, 0), coalesce(n, 0) FROM C1 LEFT JOIN V1 USING (depth, ix, iy, iz) LEFT JOIN HI USING (depth, ix, iy, iz))"
_tree = lambda s, d: octree.refine(P.embeddings_view(s, d), TREE)
query("ot4_refine", f"WITH {_T1} SELECT * FROM T")(lambda s, d: _tree(s, d).selectExpr(*CELL, "is_leaf", "is_active", "mask", "n"))
query("ot4_refine_adaptive")(lambda s, d: octree.refine(P.embeddings_view(s, d), Grid(0.0, 4.0, 8, 60.0, 2)).selectExpr(*CELL, "is_leaf", "is_active", "mask", "n"))
query(
    "snk5_tree_summary",
    f"WITH {_T1} SELECT depth, count(*) AS total, count(*) FILTER (is_leaf) AS leaf, count(*) FILTER (NOT is_leaf) AS internal, count(*) FILTER (is_active) AS active, count(*) FILTER (NOT is_active) AS inactive, count(*) FILTER (mask NOT IN (0, 255)) AS surface FROM T GROUP BY ROLLUP (depth)",
)(lambda s, d: octree.tree_summary(_tree(s, d)).select("depth", "total", "leaf", "internal", "active", "inactive", "surface"))
query("ot5_balance")(lambda s, d: octree.balance(octree.refine(P.embeddings_view(s, d), Grid(0.0, 4.0, 2, 60.0, 3)).where("is_leaf"), 3))
query("jn5_leaf_lookup", f"WITH {_T1} SELECT pid, t.depth, t.ix, t.iy, t.iz FROM P JOIN T t ON t.is_leaf AND floor(x / (0.5e0 / (1 << t.depth))) = t.ix AND floor(y / (0.5e0 / (1 << t.depth))) = t.iy AND floor(z / (0.5e0 / (1 << t.depth))) = t.iz")(
    lambda s, d: octree.leaf_lookup(P.embeddings_view(s, d).selectExpr("pid", *[f"CAST(floor({a} / 0.25e0) AS int) AS j{a}" for a in "xyz"]), _tree(s, d).where("is_leaf"), 1, []).select("pid", *CELL)
)

# groups ----------------------------------------------------------------------------------------------

_PAIRS = f"F AS (SELECT s.pid AS a, t.pid AS b FROM P s JOIN P t ON s.pid < t.pid AND (s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) + (s.z - t.z) * (s.z - t.z) < {S.num(LINK * LINK)})"
_GROUPS = f"WITH RECURSIVE {P_EMB}, {_PAIRS}, E AS (SELECT a, b FROM F UNION ALL SELECT b, a FROM F), R(pid, root) AS (SELECT pid, pid FROM P UNION SELECT E.b, R.root FROM R JOIN E ON E.a = R.pid), M AS (SELECT pid, min(root) AS root FROM R GROUP BY pid), GR AS (SELECT pid, dense_rank() OVER (ORDER BY root) - 1 AS grp FROM M)"
_labels = lambda s, d: fof.cluster(P.embeddings_view(s, d), LINK)
query("jn7_fof_pairs", f"WITH {P_EMB}, {_PAIRS} SELECT a, b FROM F")(lambda s, d: fof.pairs(P.embeddings_view(s, d), LINK))
query("gr1_fof", f"{_GROUPS} SELECT pid, grp FROM GR")(lambda s, d: _labels(s, d).withColumnRenamed("group", "grp"))
query("ag14_group_sizes", f"{_GROUPS} SELECT grp, count(*) AS size FROM GR GROUP BY grp")(lambda s, d: _labels(s, d).groupBy(F.col("group").alias("grp")).agg(F.count("*").alias("size")))
query("prj7_fof_filter", f"{_GROUPS}, Z AS (SELECT grp FROM GR GROUP BY grp HAVING count(*) >= 5) SELECT pid, grp FROM GR JOIN Z USING (grp)")(
    lambda s, d: fof.drop_small(P.embeddings_view(s, d).select("pid"), _labels(s, d), 5).withColumnRenamed("group", "grp").select("pid", "grp")
)

# surface: leaves of two depths -------------------------------------------------------------------------

_lv = ", ".join(VALUES)
_LV = f"{_T1}, LV AS (SELECT row_number() OVER (ORDER BY depth, morton) - 1 AS lid, * FROM (SELECT depth, ix, iy, iz, {plain.morton('ix', 'iy', 'iz')} AS morton, {_lv} FROM (SELECT depth, ix, iy, iz, {_lv} FROM L0 WHERE NOT split UNION ALL SELECT C1.*, {', '.join(f'coalesce({v}, 0e0)' for v in VALUES)} FROM C1 LEFT JOIN V1 USING (depth, ix, iy, iz))))"
_KL = "KL AS (SELECT K.* FROM K JOIN LV USING (depth, ix, iy, iz) UNION ALL SELECT * FROM K1), VL AS (SELECT V.* FROM V JOIN LV USING (depth, ix, iy, iz) UNION ALL SELECT * FROM V1)"
_VERTS = f"WITH {_LV}, {_KL}, {hermite_sql(TREE, 'VL', 'KL', 'L')}, {qef_sql(TREE, 'L')}, VT AS (SELECT *, row_number() OVER (ORDER BY depth, {plain.morton('ix', 'iy', 'iz')}) - 1 AS vid FROM QL)"
#: Each place of the finest lattice with its leaf.
_JL = "JX AS (SELECT unnest(range(16))::int AS jx), JL AS (SELECT jx, jy, jz, LV.* FROM JX, (SELECT jx AS jy FROM JX) JY, (SELECT jx AS jz FROM JX) JZ JOIN LV ON LV.ix = jx // (2 >> LV.depth) AND LV.iy = jy // (2 >> LV.depth) AND LV.iz = jz // (2 >> LV.depth))"


def _leaves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Numbered leaves with corner values, and their contributors."""
    p = cut(P.embeddings_view(spark, sf_dir))
    leaves = cut(octree.refine(p, TREE).where("is_leaf").select(*CELL))
    contrib = cut(leaf_contributors(p, leaves, TREE))
    return cut(with_ids(leaf_samples(leaves, contrib, TREE))), contrib


def _surface(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    leaves, contrib = _leaves(spark, sf_dir)
    verts = cut(surface.vertices(leaves, contrib, TREE))
    return verts, surface.faces(leaves, verts, TREE), leaves


_V6 = ", ".join([f"round(v{a}, 6) AS v{a}" for a in "xyz"] + [f"round(a{a}, 6) AS n{a}" for a in "xyz"])


@query("ms1_vertices", f"{_VERTS} SELECT vid, depth, ix, iy, iz, {_V6} FROM VT")
def _vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _surface(spark, sf_dir)[0].selectExpr("vid", *CELL, *[f"round({a}, 6) AS v{a}" for a in "xyz"], *[f"round(n{a}, 6) AS n{a}" for a in "xyz"])


_FACES = f"{_VERTS}, {_JL}, {plain.faces(TREE.isovalue)}"
_FT = f"WITH FT AS ({_FACES}), ED AS (SELECT least(v0, v1) AS a, greatest(v0, v1) AS b FROM FT UNION ALL SELECT least(v1, v2), greatest(v1, v2) FROM FT UNION ALL SELECT least(v2, v0), greatest(v2, v0) FROM FT)"
query("ms6_faces", _FACES)(lambda s, d: _surface(s, d)[1])
query("ag9_edge_counts", f"{_FT} SELECT a, b, count(*) AS n FROM ED GROUP BY a, b")(lambda s, d: mesh.edge_counts(_surface(s, d)[1]))
query("jn10_triangle_adjacency", f"{_FT} SELECT a AS src, b AS dst FROM ED UNION SELECT b, a FROM ED")(lambda s, d: mesh.adjacency(_surface(s, d)[1]))
query("jn9_vertex_adjacency", f"{_VERTS}, {_JL}, JV AS (SELECT jx, jy, jz, VT.vid FROM JL JOIN VT USING (depth, ix, iy, iz)) SELECT DISTINCT a.vid AS src, b.vid AS dst FROM JV a JOIN JV b ON abs(a.jx - b.jx) + abs(a.jy - b.jy) + abs(a.jz - b.jz) = 1 WHERE a.vid <> b.vid")(
    lambda s, d: (lambda m: surface.vertex_adjacency(m[2], m[0], TREE))(_surface(s, d))
)


def _points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A mesh over all customers: bands of five, each customer the first corner of a face of its band.

    No field, so that mesh operators are tested by themselves.
    """
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal", "c_nationkey")
    verts = c.selectExpr("c_custkey AS vid", "c_acctbal / 1000e0 AS x", "CAST(c_nationkey AS double) AS y", "CAST(c_custkey % 37 AS double) AS z")
    turn = "(c_custkey - 1) div 5 * 5 + (c_custkey - 1 + {}) % 5 + 1"
    faces = c.selectExpr("c_custkey AS v0", f"{turn.format(1)} AS v1", f"{turn.format(2)} AS v2")
    faces = faces.join(verts.selectExpr("vid AS v1"), "v1", "left_semi").join(verts.selectExpr("vid AS v2"), "v2", "left_semi")
    return verts, faces.select("v0", "v1", "v2")


_MESH = "VX AS (SELECT c_custkey AS vid, c_acctbal / 1000e0 AS x, c_nationkey::double AS y, (c_custkey % 37)::double AS z FROM customer), FX AS (SELECT v0, v1, v2 FROM (SELECT c_custkey AS v0, (c_custkey - 1) // 5 * 5 + c_custkey % 5 + 1 AS v1, (c_custkey - 1) // 5 * 5 + (c_custkey + 1) % 5 + 1 AS v2 FROM customer) WHERE v1 IN (SELECT vid FROM VX) AND v2 IN (SELECT vid FROM VX)), EX AS (SELECT DISTINCT least(s, t) AS a, greatest(s, t) AS b FROM (SELECT v0 AS s, v1 AS t FROM FX UNION ALL SELECT v1, v2 FROM FX UNION ALL SELECT v2, v0 FROM FX)), AX AS (SELECT a AS src, b AS dst FROM EX UNION ALL SELECT b, a FROM EX)"
_LAP = "L{n} AS (SELECT p.vid, " + ", ".join(f"CASE WHEN m.m{a} IS NULL THEN p.{a} ELSE (1e0 - 0.3e0) * p.{a} + 0.3e0 * m.m{a} END AS {a}" for a in "xyz") + " FROM {p} p LEFT JOIN (SELECT src, " + ", ".join(f"CAST(sum(CAST(q.{a} AS decimal(28, 9))) AS double) / count(*) AS m{a}" for a in "xyz") + " FROM AX JOIN {p} q ON q.vid = dst GROUP BY src) m ON m.src = p.vid)"
query("mp1_laplacian", f"WITH {_MESH}, {_LAP.format(n=1, p='VX')}, {_LAP.format(n=2, p='L1')} SELECT vid, round(x, 11) AS x, round(y, 11) AS y, round(z, 11) AS z FROM L2")(
    lambda s, d: mesh.laplacian(_points(s, d)[0], mesh.adjacency(_points(s, d)[1]), 2, 0.3).selectExpr("vid", *[f"round({a}, 11) AS {a}" for a in "xyz"])
)
_N = "(y1-y0)*(z2-z0)-(z1-z0)*(y2-y0) AS fx, (z1-z0)*(x2-x0)-(x1-x0)*(z2-z0) AS fy, (x1-x0)*(y2-y0)-(y1-y0)*(x2-x0) AS fz"
query("ag12_vertex_normals", f"WITH {_MESH}, W AS (SELECT v0, v1, v2, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, c.x AS x2, c.y AS y2, c.z AS z2 FROM FX JOIN VX a ON a.vid = v0 JOIN VX b ON b.vid = v1 JOIN VX c ON c.vid = v2), N AS (SELECT *, {_N} FROM W), U AS (SELECT v0 AS vid, fx, fy, fz FROM N UNION ALL SELECT v1, fx, fy, fz FROM N UNION ALL SELECT v2, fx, fy, fz FROM N), T AS (SELECT vid, CAST(sum(CAST(fx AS decimal(28, 9))) AS double) AS x, CAST(sum(CAST(fy AS decimal(28, 9))) AS double) AS y, CAST(sum(CAST(fz AS decimal(28, 9))) AS double) AS z FROM U GROUP BY vid), D AS (SELECT *, sqrt(x * x + y * y + z * z) AS d FROM T) SELECT vid, " + ", ".join(f"round(CASE WHEN d <= 1e-12 THEN 0e0 ELSE {a} / d END, 6) AS n{a}" for a in "xyz") + " FROM D")(
    lambda s, d: mesh.vertex_normals(*_points(s, d)).selectExpr("vid", *[f"round(n{a}, 6) AS n{a}" for a in "xyz"])
)
query("mp7_print_scale", f"WITH {_MESH}, B AS (SELECT greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS span FROM VX) SELECT vid, x * (100e0 / span) AS x, y * (100e0 / span) AS y, z * (100e0 / span) AS z FROM VX, B")(lambda s, d: mesh.scale_to_print(_points(s, d)[0], 10.0))
query("mp8_merge", f"WITH {_MESH}, T AS (SELECT max(vid) + 1 AS top FROM VX) SELECT v0, v1, v2 FROM FX UNION ALL SELECT v0 + top, v1 + top, v2 + top FROM FX, T")(lambda s, d: mesh.merge(_points(s, d), _points(s, d))[1])
query("mp8_translate", f"WITH {_MESH}, T AS (SELECT max(vid) + 1 AS top FROM VX) SELECT vid, x, y, z FROM VX UNION ALL SELECT vid + top, x + 2.5e0, y - 1e0, z FROM VX, T")(
    lambda s, d: (lambda m: mesh.merge(m, (mesh.translate(m[0], (2.5, -1.0, 0.0)), m[1]))[0])(_points(s, d))
)
_SEG = f"{_MESH}, SG AS (SELECT a, b, ceil(len / 6e0)::int AS seg FROM (SELECT a, b, sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z)) AS len FROM EX JOIN VX p ON p.vid = a JOIN VX q ON q.vid = b) WHERE len > 6e0)"
_CUT = f"{_SEG}, NP AS (SELECT *, (SELECT max(vid) FROM VX) + row_number() OVER (ORDER BY a, b, m) AS vid FROM (SELECT a, b, seg, unnest(range(1, seg)) AS m FROM SG))"
_sizes = lambda m: m[0].selectExpr("vid", "4e0 AS size")
query("ag10_edge_segments", f"WITH {_SEG} SELECT a, b, seg FROM SG")(lambda s, d: (lambda m: mesh.long_edges(*m, _sizes(m), 1.5).select("a", "b", "seg"))(_points(s, d)))
query("mp2_subdivide", f"WITH {_CUT}, CH AS (SELECT a, b, list(vid ORDER BY m) AS c FROM NP GROUP BY a, b), RG AS (SELECT [v0] || coalesce(CASE WHEN v0 < v1 THEN p.c ELSE list_reverse(p.c) END, []) || [v1] || coalesce(CASE WHEN v1 < v2 THEN q.c ELSE list_reverse(q.c) END, []) || [v2] || coalesce(CASE WHEN v2 < v0 THEN r.c ELSE list_reverse(r.c) END, []) AS ring FROM FX LEFT JOIN CH p ON p.a = least(v0, v1) AND p.b = greatest(v0, v1) LEFT JOIN CH q ON q.a = least(v1, v2) AND q.b = greatest(v1, v2) LEFT JOIN CH r ON r.a = least(v2, v0) AND r.b = greatest(v2, v0)), FN AS (SELECT ring, unnest(range(2, len(ring))) AS i FROM RG) SELECT ring[1] AS v0, ring[i] AS v1, ring[i + 1] AS v2 FROM FN")(
    lambda s, d: (lambda m: mesh.subdivide_long(*m, _sizes(m), 1.5)[1])(_points(s, d))
)
query("mp2_points", f"WITH {_CUT} SELECT vid, round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z FROM VX UNION ALL SELECT NP.vid, " + ", ".join(f"round(((seg - m) * p.{c} + m * q.{c}) / seg, 9)" for c in "xyz") + " FROM NP JOIN VX p ON p.vid = a JOIN VX q ON q.vid = b")(
    lambda s, d: (lambda m: mesh.subdivide_long(*m, _sizes(m), 1.5)[0].selectExpr("vid", *[f"round({a}, 9) AS {a}" for a in "xyz"]))(_points(s, d))
)
_LOOP = f"WITH {_MESH}, SX AS (SELECT v0 AS s, v1 AS t, v2 AS o FROM FX UNION ALL SELECT v1, v2, v0 FROM FX UNION ALL SELECT v2, v0, v1 FROM FX), EO AS (SELECT least(s, t) AS a, greatest(s, t) AS b, count(*) AS n, " + ", ".join(f"CAST(sum(CAST(x.{c} AS decimal(28, 9))) AS double) AS o{c}" for c in "xyz") + " FROM SX JOIN VX x ON x.vid = o GROUP BY ALL), NV AS (SELECT (SELECT max(vid) FROM VX) + row_number() OVER (ORDER BY a, b) AS vid, " + ", ".join(f"CASE WHEN n = 2 THEN 0.375e0 * (p.{c} + q.{c}) + 0.125e0 * o{c} ELSE 0.5e0 * (p.{c} + q.{c}) END AS {c}" for c in "xyz") + " FROM EO JOIN VX p ON p.vid = a JOIN VX q ON q.vid = b), DX AS (SELECT a AS vid, b AS w, n FROM EO UNION ALL SELECT b, a, n FROM EO), NR AS (SELECT DX.vid, count(*) AS k, count(*) FILTER (n <> 2) AS opened, " + ", ".join(f"sum(x.{c}) AS s{c}, CAST(sum(CAST(CASE WHEN n <> 2 THEN x.{c} ELSE 0e0 END AS decimal(28, 9))) AS double) AS t{c}" for c in "xyz") + " FROM DX JOIN VX x ON x.vid = w GROUP BY DX.vid), OV AS (SELECT v.vid, " + ", ".join(f"CASE WHEN opened = 0 THEN v.{c} + (0.625e0 - pow(0.375e0 + 0.25e0 * cos(2e0 * pi() / k), 2)) / k * (s{c} - k * v.{c}) WHEN opened = 2 THEN 0.75e0 * v.{c} + 0.125e0 * t{c} ELSE v.{c} END AS {c}" for c in "xyz") + " FROM VX v LEFT JOIN NR ON NR.vid = v.vid) SELECT vid, " + ", ".join(f"round({c}, 9) AS {c}" for c in "xyz") + " FROM (SELECT * FROM OV UNION ALL SELECT * FROM NV)"
query("mp5_loop_subdivision", _LOOP)(lambda s, d: subdivision.loop(*_points(s, d))[0].selectExpr("vid", *[f"round({a}, 9) AS {a}" for a in "xyz"]))
query("mp5_loop_faces", _LOOP[: _LOOP.index(", DX AS")].replace("NV AS (SELECT (SELECT max", "NV AS (SELECT a, b, (SELECT max") + ", QF AS (SELECT v0, v1, v2, p.vid AS m, q.vid AS n, r.vid AS o FROM FX JOIN NV p ON p.a = least(v0, v1) AND p.b = greatest(v0, v1) JOIN NV q ON q.a = least(v1, v2) AND q.b = greatest(v1, v2) JOIN NV r ON r.a = least(v2, v0) AND r.b = greatest(v2, v0)) SELECT v0, m AS v1, o AS v2 FROM QF UNION ALL SELECT m, v1, n FROM QF UNION ALL SELECT o, n, v2 FROM QF UNION ALL SELECT m, n, o FROM QF")(lambda s, d: subdivision.loop(*_points(s, d))[1])
_vol = "(p.x * (q.y * r.z - q.z * r.y) - p.y * (q.x * r.z - q.z * r.x) + p.z * (q.x * r.y - q.y * r.x)) / 6e0"
query("gr8_islands", f"WITH RECURSIVE {_MESH}, R(vid, root) AS (SELECT src, src FROM AX UNION SELECT AX.dst, R.root FROM R JOIN AX ON AX.src = R.vid), M AS (SELECT vid, min(root) AS component FROM R GROUP BY vid) SELECT component, count(*) AS faces, round(abs(CAST(sum(CAST({_vol} AS decimal(28, 9))) AS double)), 6) AS volume FROM FX JOIN M ON M.vid = v0 JOIN VX p ON p.vid = v0 JOIN VX q ON q.vid = v1 JOIN VX r ON r.vid = v2 GROUP BY component")(
    lambda s, d: mesh.islands(*_points(s, d)).selectExpr("component", "faces", "round(volume, 6) AS volume")
)

# solids: leaves of two depths ----------------------------------------------------------------------------

_center = [f"((i{a} + 0.5e0) * (0.5e0 / (1 << depth)))" for a in "xyz"]
_SL = f"{_LV}, {_KL}, CV AS (SELECT depth, ix, iy, iz, CAST(sum({octree.kernel_at(*_center)}) AS double) AS c FROM KL GROUP BY depth, ix, iy, iz), SL AS (SELECT lid, depth, ix, iy, iz, 0.5e0 / (1 << depth) AS size, coalesce(c, 0) AS center_value, coalesce(c, 0) >= 60e0 OR list_sum(list_transform([{_lv}], lambda v: (v >= 60e0)::int)) >= 4 AS inside FROM LV LEFT JOIN CV USING (depth, ix, iy, iz)), {_JL}, {plain.NEIGHBOURS}"
_SOLID = f"WITH RECURSIVE {_SL}"


def _solid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    leaves, contrib = _leaves(spark, sf_dir)
    return cut(solid.classify(leaves, contrib, TREE)), cut(solid.face_neighbours(leaves.select("lid", *CELL), TREE))


ERODE, DILATE = 0.25, 0.4
_step = lambda name, rule, limit: f"SELECT NB.nid, {name}.dist + 0.5e0 * (s.size + n.size) FROM {name} JOIN NB USING (lid) JOIN SL s ON s.lid = NB.lid JOIN SL n ON n.lid = NB.nid WHERE {rule} AND {name}.dist + 0.5e0 * (s.size + n.size) <= {limit}"
_OCC = "OC AS (SELECT s.lid, CASE WHEN coalesce(bool_or(s.inside <> n.inside), false) THEN (CASE WHEN s.inside THEN 2 ELSE 3 END) ELSE (CASE WHEN s.inside THEN 1 ELSE 0 END) END AS occupancy FROM SL s LEFT JOIN NB ON NB.lid = s.lid LEFT JOIN SL n ON n.lid = NB.nid GROUP BY s.lid, s.inside)"
_CLEAR = f"{_OCC}, CL(lid, dist) AS (SELECT lid, 0e0 FROM OC WHERE occupancy = 2 UNION {_step('CL', 'n.inside', LIMIT)}), CD AS (SELECT lid, min(dist) AS dist FROM CL GROUP BY lid)"
query("jn6_face_neighbours", f"{_SOLID} SELECT lid, face, nid, size AS nsize FROM NB JOIN (SELECT lid AS nid, size FROM SL) USING (nid)")(lambda s, d: _solid(s, d)[1].select("lid", "face", "nid", "nsize"))
query("so2_occupancy", f"{_SOLID}, {_OCC} SELECT lid, occupancy, inside, round(center_value, 6) AS center_value FROM OC JOIN SL USING (lid)")(
    lambda s, d: (lambda a: solid.occupancy(*a).join(a[0].selectExpr("lid", "inside", "round(center_value, 6) AS center_value"), "lid"))(_solid(s, d))
)


@query("gr3_outside_distance", f"{_SOLID}, OW(lid, dist) AS (SELECT s.lid, 0e0 FROM SL s LEFT JOIN NB USING (lid) LEFT JOIN SL n ON n.lid = NB.nid WHERE s.inside GROUP BY s.lid HAVING count(n.lid) < 6 OR bool_or(NOT n.inside) UNION {_step('OW', 'NOT n.inside', LIMIT)}) SELECT lid, min(dist) AS dist FROM OW GROUP BY lid")
def _outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solid.outside_distance(*_solid(spark, sf_dir), LIMIT)


def _eroded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s, nbr = _solid(spark, sf_dir)
    clear = solid.clearance(s, nbr, solid.occupancy(s, nbr), LIMIT)
    return s, nbr, cut(solid.erode(s, clear, ERODE))


query("gr4_clearance", f"{_SOLID}, {_CLEAR} SELECT lid, dist FROM CD")(lambda s, d: (lambda a: solid.clearance(a[0], a[1], solid.occupancy(*a), LIMIT))(_solid(s, d)))
_ERO = f"{_CLEAR}, ER AS (SELECT s.lid FROM SL s LEFT JOIN CD USING (lid) WHERE inside AND (dist IS NULL OR dist >= {ERODE}))"
query("so5_erode", f"{_SOLID}, {_ERO} SELECT lid FROM ER")(lambda s, d: _eroded(s, d)[2])
_DIL = f"{_ERO}, DW(lid, dist) AS (SELECT lid, 0e0 FROM ER UNION {_step('DW', 'true', DILATE)}), OP AS (SELECT DISTINCT lid FROM DW)"


def _opened(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s, nbr, eroded = _eroded(spark, sf_dir)
    return s, nbr, cut(solid.dilate(eroded, solid.mask_distance(s, nbr, eroded, DILATE), DILATE))


query("gr5_dilation_distance", f"{_SOLID}, {_DIL} SELECT lid, min(dist) AS dist FROM DW GROUP BY lid")(lambda s, d: (lambda a: solid.mask_distance(a[0], a[1], a[2], DILATE))(_eroded(s, d)))
query("so4_dilate", f"{_SOLID}, {_DIL} SELECT lid FROM OP")(lambda s, d: _opened(s, d)[2])
query("so7_edge_contacts", f"{_SOLID}, {_DIL}, {plain.EXPOSED} SELECT OP.lid FROM OP LEFT JOIN XF USING (lid) GROUP BY OP.lid HAVING count(face) < 5")(lambda s, d: (lambda a: solid.drop_contacts(a[2], a[1]))(_opened(s, d)))
query("so8_boundary", f"{_SOLID}, {_DIL}, {plain.EXPOSED} {plain.BOUNDARY}")(lambda s, d: (lambda a: solid.boundary_samples(a[2], a[0], a[1], TREE))(_opened(s, d)))
query("so9_blocky_surface", f"{_SOLID}, {_DIL}, {plain.BLOCKS} SELECT q0 AS v0, q1 AS v1, q2 AS v2 FROM QI UNION ALL SELECT q0, q2, q3 FROM QI")(lambda s, d: (lambda a: solid.blocky_surface(a[2], a[0], TREE)[1])(_opened(s, d)))
query("so9_blocky_points", f"{_SOLID}, {_DIL}, {plain.BLOCKS} SELECT vid, px * 0.25e0 AS x, py * 0.25e0 AS y, pz * 0.25e0 AS z FROM ID")(lambda s, d: (lambda a: solid.blocky_surface(a[2], a[0], TREE)[0])(_opened(s, d)))
query("so10_ambiguities", f"{_SOLID}, {_DIL}, {plain.AMBIGUOUS}")(lambda s, d: (lambda a: solid.resolve_ambiguities(a[2], *a[:2], TREE))(_opened(s, d)))
query("ag13_counts", f"{_SOLID}, {_DIL} SELECT count(*) AS n_leaves, count(*) FILTER (inside) AS n_inside, count(*) FILTER (occupancy = 2) AS n_boundary_inside, count(*) FILTER (occupancy = 3) AS n_boundary_outside, count(OP.lid) AS n_opened FROM SL JOIN OC USING (lid) LEFT JOIN OP USING (lid)")(
    lambda s, d: (lambda a: solid.counts(a[0], solid.occupancy(a[0], a[1]), a[2]))(_opened(s, d))
)
_COMP = "LN AS (SELECT NB.lid AS a, NB.nid AS b FROM NB JOIN OP p ON p.lid = NB.lid JOIN OP q ON q.lid = NB.nid), LS AS (SELECT a, b FROM LN UNION SELECT b, a FROM LN), PR(lid, root) AS (SELECT lid, lid FROM OP UNION SELECT LS.b, PR.root FROM PR JOIN LS ON LS.a = PR.lid), PC AS (SELECT lid, min(root) AS component FROM PR GROUP BY lid), PV AS (SELECT component, sum(size * size * size) AS volume FROM PC JOIN SL USING (lid) GROUP BY component)"
query("gr6_prune", f"{_SOLID}, {_DIL}, {_COMP} SELECT lid FROM PC JOIN PV USING (component) WHERE volume >= 0.05e0 * (SELECT max(volume) FROM PV)")(lambda s, d: (lambda a: solid.prune(a[2], a[0], a[1]))(_opened(s, d)))
query("gr7_cavities", f"{_SOLID}, {_DIL}, {plain.CAVITIES}")(lambda s, d: (lambda a: solid.fill_cavities(a[2], a[0], a[1], 0.25))(_opened(s, d)))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
