"""DuckDB formulas of the field queries, written apart from the engine's own expressions.

They take other ways to the same values: lists and sums of bits for keys and masks, powers for the kernel, nested
interpolation, intervals for boxes, tables of places for leaves. `P`, `LV`, `SL`, `JL`, `NB` and `OP` are tables that the
queries define: particles, leaves, classified leaves, places of the finest lattice with their leaf, face neighbours
and the opened mask.
"""

from __future__ import annotations

_IX = [f"floor({a} * 1000e0)::bigint" for a in "xyz"]
_R = "sqrt((x - 2e0) * (x - 2e0) + (y - 2e0) * (y - 2e0) + (z - 2e0) * (z - 2e0))"


def nine(e: str, name: str) -> str:
    """Nine digits, without a negative zero."""
    return f"CASE WHEN abs({e}) < 5e-10 THEN 0e0 ELSE round({e}, 9) END AS {name}"


def morton(x: str, y: str, z: str) -> str:
    return f"list_sum(list_transform(range(21), lambda b: (((({x})::bigint >> b) & 1) << (3 * b)) + (((({y})::bigint >> b) & 1) << (3 * b + 1)) + (((({z})::bigint >> b) & 1) << (3 * b + 2))))::bigint"


def sign_mask(v: list[str], iso: float) -> str:
    return f"list_sum(list_transform([{', '.join(v)}], lambda c, i: CASE WHEN c >= {iso!r} THEN 1 << (i - 1) ELSE 0 END))::int"


def straddles(v: list[str], iso: float) -> str:
    every = f"[{', '.join(v)}]"
    return f"({iso!r} BETWEEN list_min({every}) AND list_max({every}) AND list_min({every}) < list_max({every}))"


def crossing(a: str, b: str, iso: float) -> str:
    return f"CASE WHEN abs({a} - {b}) < 1e-12 THEN 0.5e0 ELSE greatest(0e0, least(1e0, ({iso!r} - {a}) / ({b} - {a}))) END"


CLOSED_BOX = ["x BETWEEN 1e0 - 1e-12 AND 2.5e0 + 1e-12 AND y BETWEEN 1e0 - 1e-12 AND 2e0 + 1e-12 AND z BETWEEN 1e0 - 1e-12 AND 3e0 + 1e-12 AS inside"]
BOXES = [
    "NOT (x < 1e0 OR x >= 2.5e0 OR y < 1e0 OR y >= 2e0 OR z < 1e0 OR z >= 3e0) AS inside",
    "NOT (x + h <= 1e0 OR x - h >= 2.5e0 OR y + h <= 1e0 OR y - h >= 2e0 OR z + h <= 1e0 OR z - h >= 3e0) AS overlaps",
]
CENTRE = [f"(({a} - h) + ({a} + 3e0 * h)) / 2e0 AS c{a}, ({a} + 3e0 * h) - ({a} - h) AS e{a}" for a in "xyz"]
MORTON = [f"{morton(*_IX)} AS morton"]
DECODED = [f"list_sum(list_transform(range(21), lambda b: ((pid::bigint >> (3 * b + {i})) & 1) << b))::bigint AS i{a}" for i, a in enumerate("xyz")]
PACKED = [f"CASE WHEN list_min([{', '.join(_IX)}]) >= 0 AND list_max([{', '.join(_IX)}]) < 2097152 THEN {_IX[0]} * 4398046511104 + {_IX[1]} * 2097152 + {_IX[2]} END AS packed"]
PROFILE = [nine(f"(CASE WHEN {_R} < 2e0 THEN pow(1e0 - {_R} / 2e0, 4) * (2e0 * {_R} + 1e0) ELSE 0e0 END)", "w")]
_raw = f"(CASE WHEN {_R} < 4e0 * h THEN pow(1e0 - {_R} / (4e0 * h), 4) * ({_R} / h + 1e0) ELSE 0e0 END)"
KERNEL = [nine(f"({_raw} * 21e0 / (2e0 * pi()) / pow(4e0 * h, 3))", "w"), nine(_raw, "raw")]
SLOPE = [nine(f"(CASE WHEN {_R} > 0e0 AND {_R} < 4e0 * h THEN (2e0 - {a}) * 20e0 * pow(1e0 - {_R} / (4e0 * h), 3) / pow(4e0 * h, 5) * 21e0 / (2e0 * pi()) ELSE 0e0 END)", f"g{a}") for a in "xyz"]
SUPPORT = ["pow(x - greatest(1e0, least(2.5e0, x)), 2) + pow(y - greatest(1e0, least(2e0, y)), 2) + pow(z - greatest(1e0, least(3e0, z)), 2) <= pow(h, 2) AS touches"]
BINS = [f"greatest(0, least(5, floor(2e0 * {a} - 1e0)))::int AS i{a}" for a in "xyz"]
CROSSING = [nine(f"({crossing('x', 'y', 2.0)})", "t")]
_V8 = ["x", "y", "z", "x * y", "y * z", "x + z", "z - x", "h"]
STRADDLE = [f"{straddles(_V8, 2.5)} AS straddles"]
MASK = [f"{sign_mask(_V8, 2.0)} AS mask"]


def lerp(v: list[str], t: list[str]) -> str:
    """Interpolation along x, then y, then z."""
    for f in t:
        v = [f"(({a}) * (1e0 - {f}) + ({b}) * {f})" for a, b in zip(v[::2], v[1::2])]
    return v[0]


_tri = lerp(_V8, ["0.337e0", "0.519e0", "0.731e0"])
TRILINEAR = [nine(_tri, "v"), f"round({_tri}, 9) >= 2e0 AS inside"]


def _moved(axis: int, step: int) -> str:
    k = "(pid::bigint % 512)"
    c = f"list_sum(list_transform(range(3), lambda b: (({k} >> (3 * b + {axis})) & 1) << b))::bigint"
    put = lambda v: f"list_sum(list_transform(range(3), lambda b: ((({v}) >> b) & 1) << (3 * b + {axis})))::bigint"
    return f"CASE WHEN {c} + {step} BETWEEN 0 AND 7 THEN {k} - {put(c)} + {put(f'greatest({c} + {step}, 0)')} END AS k{axis}{'ab'[step > 0]}"


NEIGHBOUR = [_moved(i, d) for i in range(3) for d in (-1, 1)]


def _share() -> str:
    at = {}
    for c, ks in (("a", (0, 1, 2)), ("b", (2, 0, 1))):
        for a, k in zip("xyz", ks):
            at[c + a] = f"(r // {7**k} % (2 << {c}d)::bigint)"
    low = ", ".join(f"{e} / (1 << {n[0]}d)::double AS l{n}, ({e} + 1) / (1 << {n[0]}d)::double AS h{n}" for n, e in at.items())
    touch = {a: f"(ha{a} = lb{a} OR hb{a} = la{a})" for a in "xyz"}
    meet = {a: f"least(ha{a}, hb{a}) > greatest(la{a}, lb{a})" for a in "xyz"}
    rule = " OR ".join(f"({touch[a]} AND {' AND '.join(meet[b] for b in 'xyz' if b != a)})" for a in "xyz")
    return "WITH {P}, " + f"A AS (SELECT pid, (pid % 3)::int AS ad, (pid // 3 % 3)::int AS bd, pid // 9 AS r FROM P), B AS (SELECT pid, {low} FROM A) SELECT pid, ({rule}) AS share FROM B"


SHARE_FACE = _share()
CHILD_BOUNDS = "WITH N AS (SELECT unnest(range(8)) AS i), C AS (SELECT a.i AS x, b.i AS y, c.i AS z, d.i AS child FROM N a, N b, N c, N d) SELECT 1 AS depth, " + ", ".join(f"(2 * {a} + (child >> {k} & 1))::int AS i{a}" for k, a in enumerate("xyz")) + ", child::int AS child, " + ", ".join(f"{a} * 0.5e0 + CASE WHEN child >> {k} & 1 = 1 THEN 0.25e0 ELSE 0e0 END AS lo{a}, {a} * 0.5e0 + CASE WHEN child >> {k} & 1 = 1 THEN 0.5e0 ELSE 0.25e0 END AS hi{a}" for k, a in enumerate("xyz")) + " FROM C"


def faces(iso: float) -> str:
    """Triangles around sign-changing edges of the finest lattice, from `JL` and the vertices `VT`."""
    t = [f"((j{a} - i{a} * (2 >> depth)) / (2 >> depth)::double)" for a in "xyz"]
    edges = " UNION ALL ".join(
        f"SELECT {k} AS axis, s.jx AS ex, s.jy AS ey, s.jz AS ez, s.inside FROM SG s JOIN SG t ON t.jx = s.jx + {d[0]} AND t.jy = s.jy + {d[1]} AND t.jz = s.jz + {d[2]} WHERE s.inside <> t.inside AND {rest}"
        for k, (d, rest) in enumerate((((1, 0, 0), "s.jy > 0 AND s.jz > 0"), ((0, 1, 0), "s.jx > 0 AND s.jz > 0"), ((0, 0, 1), "s.jx > 0 AND s.jy > 0")))
    )
    # fixed values: the four cells around an edge in winding order, as steps back
    turns = "(0, 0, 0, 0, 0), (0, 1, 0, 0, 1), (0, 2, 0, 1, 1), (0, 3, 0, 1, 0), (1, 0, 0, 0, 0), (1, 1, 1, 0, 0), (1, 2, 1, 0, 1), (1, 3, 0, 0, 1), (2, 0, 0, 0, 0), (2, 1, 0, 1, 0), (2, 2, 1, 1, 0), (2, 3, 1, 0, 0)"
    return f"""SG AS (SELECT jx, jy, jz, {lerp([f'v{i}' for i in range(8)], t)} >= {iso!r} AS inside FROM JL), EG AS ({edges}),
 AR AS (SELECT * FROM (VALUES {turns}) t(axis, k, sx, sy, sz)), JV AS (SELECT jx, jy, jz, vid FROM JL JOIN VT USING (depth, ix, iy, iz)),
 QD AS (SELECT axis, ex, ey, ez, inside, list(vid ORDER BY k) AS q FROM EG JOIN AR USING (axis) JOIN JV ON JV.jx = ex - sx AND JV.jy = ey - sy AND JV.jz = ez - sz GROUP BY ALL HAVING count(*) = 4),
 UQ AS (SELECT inside, list_filter(q, lambda v, i: list_position(q, v) = i) AS u FROM QD), RG AS (SELECT CASE WHEN inside THEN list_reverse(u) ELSE u END AS r FROM UQ WHERE len(u) >= 3)
 SELECT r[1] AS v0, r[2] AS v1, r[3] AS v2 FROM RG UNION ALL SELECT r[1], r[3], r[4] FROM RG WHERE len(r) = 4"""


_side = lambda a, d: f"CASE {d} WHEN 0 THEN i{a} * sp + sp // 2 WHEN 1 THEN (i{a} + 1) * sp ELSE i{a} * sp - 1 END"
NEIGHBOURS = f"""NB AS (SELECT p.lid, p.face, JL.lid AS nid FROM (SELECT lid, face, {_side('x', 'dx')} AS px, {_side('y', 'dy')} AS py, {_side('z', 'dz')} AS pz FROM (SELECT *, 2 >> depth AS sp FROM SL),
 (VALUES (0, -1, 0, 0), (1, 1, 0, 0), (2, 0, -1, 0), (3, 0, 1, 0), (4, 0, 0, -1), (5, 0, 0, 1)) F(face, dx, dy, dz)) p JOIN JL ON JL.jx = px AND JL.jy = py AND JL.jz = pz)"""
EXPOSED = "CO AS (SELECT NB.lid, NB.face FROM NB JOIN OP ON OP.lid = NB.nid), XF AS (SELECT OP.lid, f.face FROM OP CROSS JOIN (SELECT unnest(range(6))::int AS face) f LEFT JOIN CO ON CO.lid = OP.lid AND CO.face = f.face WHERE CO.lid IS NULL)"
BOUNDARY = "SELECT XF.lid, face, " + ", ".join(f"(i{a} + CASE face WHEN {2 * k} THEN 0e0 WHEN {2 * k + 1} THEN 1e0 ELSE 0.5e0 END) * size AS {a}, CASE face WHEN {2 * k} THEN -1e0 WHEN {2 * k + 1} THEN 1e0 ELSE 0e0 END AS n{a}" for k, a in enumerate("xyz")) + " FROM XF JOIN SL USING (lid)"
#: Direction and corners of a cell's faces, seen from outside counter-clockwise.
_CORNERS = """(-1, 0, 0, 0, 0, 0, 0, 0, 1, 0, 1, 1, 0, 1, 0), (1, 0, 0, 1, 0, 0, 1, 1, 0, 1, 1, 1, 1, 0, 1), (0, -1, 0, 0, 0, 0, 1, 0, 0, 1, 0, 1, 0, 0, 1),
 (0, 1, 0, 0, 1, 0, 0, 1, 1, 1, 1, 1, 1, 1, 0), (0, 0, -1, 0, 0, 0, 0, 1, 0, 1, 1, 0, 1, 0, 0), (0, 0, 1, 0, 0, 1, 1, 0, 1, 1, 1, 1, 0, 1, 1)"""
_corner = ", ".join(f"c.j{a} + {a}{k} AS p{a}{k}" for k in range(4) for a in "xyz")
BLOCKS = f"""BX AS (SELECT jx, jy, jz FROM JL JOIN OP USING (lid)), FC AS (SELECT * FROM (VALUES {_CORNERS}) f(dx, dy, dz, {', '.join(f'{a}{k}' for k in range(4) for a in 'xyz')})),
 QP AS (SELECT {_corner} FROM BX c CROSS JOIN FC LEFT JOIN BX b ON b.jx = c.jx + dx AND b.jy = c.jy + dy AND b.jz = c.jz + dz WHERE b.jx IS NULL),
 PT AS ({' UNION '.join(f'SELECT px{k} AS px, py{k} AS py, pz{k} AS pz FROM QP' for k in range(4))}), ID AS (SELECT row_number() OVER (ORDER BY px, py, pz) - 1 AS vid, px, py, pz FROM PT),
 QI AS (SELECT {', '.join(f'i{k}.vid AS q{k}' for k in range(4))} FROM QP {' '.join(f'JOIN ID i{k} ON i{k}.px = px{k} AND i{k}.py = py{k} AND i{k}.pz = pz{k}' for k in range(4))})"""
AMBIGUOUS = """AE AS (SELECT axis, jx + CASE axis WHEN 0 THEN 0 WHEN 1 THEN v ELSE u END AS ex, jy + CASE axis WHEN 0 THEN u WHEN 1 THEN 0 ELSE v END AS ey, jz + CASE axis WHEN 0 THEN v WHEN 1 THEN u ELSE 0 END AS ez, u, v, JL.lid, OP.lid IS NOT NULL AS opened
 FROM JL CROSS JOIN (VALUES (0), (1), (2)) x(axis) CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) y(u, v) LEFT JOIN OP ON OP.lid = JL.lid),
 DG AS (SELECT axis, ex, ey, ez FROM AE GROUP BY ALL HAVING count(*) FILTER (opened) = 2 AND count(*) FILTER (opened AND u = v) IN (0, 2)),
 SU AS (SELECT NB.lid, count(*) AS n FROM NB JOIN OP ON OP.lid = NB.nid GROUP BY NB.lid),
 FR AS (SELECT DISTINCT axis, ex, ey, ez, AE.lid, coalesce(n, 0) AS n, size FROM AE JOIN DG USING (axis, ex, ey, ez) JOIN SL ON SL.lid = AE.lid LEFT JOIN SU ON SU.lid = AE.lid WHERE NOT opened),
 RK AS (SELECT lid, row_number() OVER (PARTITION BY axis, ex, ey, ez ORDER BY n DESC, size, lid) AS k FROM FR) SELECT lid FROM OP UNION SELECT lid FROM RK WHERE k = 1"""
CAVITIES = """XO AS (SELECT lid FROM SL WHERE lid NOT IN (SELECT lid FROM OP)), XE AS (SELECT NB.lid AS a, NB.nid AS b FROM NB JOIN XO p ON p.lid = NB.lid JOIN XO q ON q.lid = NB.nid), XL AS (SELECT a, b FROM XE UNION SELECT b, a FROM XE),
 XT AS (SELECT XO.lid FROM XO LEFT JOIN NB USING (lid) GROUP BY XO.lid HAVING count(NB.nid) < 6), XR(lid) AS (SELECT lid FROM XT UNION SELECT XL.b FROM XR JOIN XL ON XL.a = XR.lid), XH AS (SELECT lid FROM XO WHERE lid NOT IN (SELECT lid FROM XR)),
 XP(lid, root) AS (SELECT lid, lid FROM XH UNION SELECT XL.b, XP.root FROM XP JOIN XL ON XL.a = XP.lid), XC AS (SELECT lid, min(root) AS component FROM XP GROUP BY lid),
 XV AS (SELECT component, sum(size * size * size) AS volume FROM XC JOIN SL USING (lid) GROUP BY component)
 SELECT lid FROM OP UNION ALL SELECT lid FROM XC JOIN XV USING (component) WHERE volume <= 0.25e0 * (SELECT sum(size * size * size) FROM OP JOIN SL USING (lid))"""
