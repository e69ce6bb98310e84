"""Cells, contributors, field samples and refinement.

A cell is `(depth, ix, iy, iz)` on the lattice of its depth; its Morton key is a function of these. Joins
of particles and cells are equi-joins on bins that each particle's support covers, never nested loops.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoloom.functions import scalar as S
from isoloom.session import cut

CELL = ["depth", "ix", "iy", "iz"]
VALUES = [f"v{i}" for i in range(8)]


@dataclass(frozen=True)
class Grid:
    """A cubic domain [low, high)^3 with `resolution` top-level cells along an axis."""

    low: float
    high: float
    resolution: int
    isovalue: float
    max_depth: int = 0

    def __post_init__(self) -> None:
        if self.resolution < 1 or self.high <= self.low or not 0 <= self.max_depth < 21:
            raise ValueError("a grid needs a positive resolution and extent and a depth below 21")
        if self.resolution << self.max_depth > S.MAX_COORDINATE:
            raise ValueError("the finest lattice has more than 2**21 - 1 cells along an axis")

    def width(self, depth: int = 0) -> float:
        return (self.high - self.low) / (self.resolution << depth)

    def bounds(self, p: str = "", depth: str = "depth") -> tuple[list[str], list[str]]:
        """SQL of a cell's bounds."""
        w = f"({S.num(self.width())} / CAST((1 << {p}{depth}) AS double))"
        at = lambda a, k: f"({S.num(self.low)} + CAST({p}i{a} + {k} AS double) * {w})"
        return [at(a, 0) for a in "xyz"], [at(a, 1) for a in "xyz"]


def top_cells(spark: SparkSession, g: Grid) -> DataFrame:
    """All R^3 cells of depth 0, generated where they are used."""
    r = g.resolution
    return spark.range(r**3).selectExpr("0 AS depth", f"CAST(id div {r * r} AS int) AS ix", f"CAST(id div {r} % {r} AS int) AS iy", f"CAST(id % {r} AS int) AS iz")


def children(cells: DataFrame) -> DataFrame:
    """The eight children of each cell, with its number in `child`; other columns stay."""
    rest = [c for c in cells.columns if c not in CELL]
    out = cells.withColumn("child", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return out.selectExpr("depth + 1 AS depth", "ix * 2 + (child & 1) AS ix", "iy * 2 + ((child >> 1) & 1) AS iy", "iz * 2 + ((child >> 2) & 1) AS iz", "child", *rest)


def bin_counts(p: DataFrame, g: Grid) -> DataFrame:
    """Particles of each top-level bin; empty bins count 0."""
    w = g.width()
    n = p.selectExpr(*[f"{S.bin_of(a, g.low, w, g.resolution)} AS i{a}" for a in "xyz"]).groupBy("ix", "iy", "iz").agg(F.count("*").alias("n"))
    return top_cells(p.sparkSession, g).drop("depth").join(n, ["ix", "iy", "iz"], "left").selectExpr("ix", "iy", "iz", "coalesce(n, 0) AS n")


def contributors(p: DataFrame, g: Grid, depth: int = 0) -> DataFrame:
    """Pairs of cells of one depth and the particles whose support touches them, with particle columns."""
    w, r = g.width(depth), g.resolution << depth
    out = p
    for a in "xyz":
        lo = f"CAST(greatest(0, ceil(({a} - h - {S.num(g.low)}) / {S.num(w)}) - 1) AS int)"
        hi = f"CAST(least({r - 1}, floor(({a} + h - {S.num(g.low)}) / {S.num(w)})) AS int)"
        out = out.where(f"{lo} <= {hi}").selectExpr("*", f"explode(sequence({lo}, {hi})) AS i{a}")
    lo, hi = g.bounds()
    return out.selectExpr(f"{depth} AS depth", "ix", "iy", "iz", "pid", "x", "y", "z", "h").where(S.support_overlaps(lo, hi))


def query_box(p: DataFrame, low: list[float], high: list[float]) -> DataFrame:
    """Particles whose support touches a box."""
    return p.where(S.support_overlaps([S.num(v) for v in low], [S.num(v) for v in high]))


def child_contributors(contrib: DataFrame, g: Grid) -> DataFrame:
    """Contributors of the children of cells that have contributors: they are among the parents'."""
    lo, hi = g.bounds()
    return children(contrib).where(S.support_overlaps(lo, hi)).select(*CELL, "pid", "x", "y", "z", "h")


def kernel_at(px: str, py: str, pz: str) -> str:
    """A particle's kernel at a point, as an exact decimal: sums do not depend on their order."""
    return f"CAST({S.kernel(S.distance(f'{px} - x', f'{py} - y', f'{pz} - z'), 'h')} AS decimal(28, 9))"


def corner_samples(contrib: DataFrame, g: Grid) -> DataFrame:
    """Field at the eight corners of each cell that has contributors, and their number.

    Relative distances are projected first, so that a kernel term takes one root and no division.
    """
    lo, hi = g.bounds()
    near, sums = [], []
    for i, bits in enumerate(S.CORNERS):
        at = [hi[k] if b else lo[k] for k, b in enumerate(bits)]
        r = S.distance(*[f"{at[k]} - {a}" for k, a in enumerate("xyz")])
        near.append(f"CASE WHEN h <= 0e0 THEN 1e0 ELSE {r} / h END AS q{i}")
        sums.append(F.expr(f"CAST(sum(CAST(({S.profile(f'q{i}')}) * scale AS decimal(28, 9))) AS double)").alias(f"v{i}"))
    scale = f"CASE WHEN h <= 0e0 THEN 0e0 ELSE {S.num(S.NORM)} / (h * h * h) END AS scale"
    return contrib.selectExpr(*CELL, scale, *near).groupBy(*CELL).agg(F.count("*").alias("n"), *sums)


def with_surface(samples: DataFrame, g: Grid) -> DataFrame:
    """Add the sign mask and whether the surface may pass."""
    iso = S.num(g.isovalue)
    return samples.selectExpr("*", f"{S.sign_mask(VALUES, iso)} AS mask", f"{S.straddles(VALUES, iso)} AS straddles")


def density(points: DataFrame, p: DataFrame, g: Grid) -> DataFrame:
    """Field at points `(qid, qx, qy, qz)` with any particle in reach."""
    w = g.width()
    reach = p
    for a in "xyz":
        lo = f"CAST(floor(({a} - h - {S.num(g.low)}) / {S.num(w)}) AS int)"
        hi = f"CAST(floor(({a} + h - {S.num(g.low)}) / {S.num(w)}) AS int)"
        reach = reach.selectExpr("*", f"explode(sequence({lo}, {hi})) AS i{a}")
    q = points.selectExpr("*", *[f"CAST(floor((q{a} - {S.num(g.low)}) / {S.num(w)}) AS int) AS i{a}" for a in "xyz"])
    d2 = "(qx - x) * (qx - x) + (qy - y) * (qy - y) + (qz - z) * (qz - z)"
    return q.join(reach, ["ix", "iy", "iz"]).where(f"{d2} < h * h").groupBy("qid").agg(F.count("*").alias("n"), F.expr(f"CAST(sum({kernel_at('qx', 'qy', 'qz')}) AS double)").alias("density"))


def gradient(points: DataFrame, pairs_on: list[str], contrib: DataFrame) -> DataFrame:
    """Field gradient at points that carry a cell key, from that cell's contributors. Adds gx, gy, gz."""
    rest = [c for c in points.columns if c not in pairs_on]
    slope = S.kernel_slope(S.distance("px - x", "py - y", "pz - z"), "h")
    sums = [F.expr(f"CAST(sum(CAST((p{a} - {a}) * ({slope}) AS decimal(28, 9))) AS double)").alias(f"g{a}") for a in "xyz"]
    return points.join(contrib, pairs_on).groupBy(*pairs_on, *rest).agg(*sums)


def hermite(samples: DataFrame, contrib: DataFrame, g: Grid) -> DataFrame:
    """Edge crossings of cells with sign changes: position and unit normal (0 where the gradient is)."""
    lo, hi = g.bounds()
    iso, rows = S.num(g.isovalue), []
    for e, (a, b) in enumerate(S.EDGES):
        axis = (a ^ b).bit_length() - 1
        at = [hi[k] if S.CORNERS[a][k] else lo[k] for k in range(3)]
        t = S.crossing(f"v{a}", f"v{b}", iso)
        at[axis] = f"({lo[axis]} + ({t}) * ({hi[axis]} - {lo[axis]}))"
        rows.append(f"named_struct('edge', {e}, 'px', {at[0]}, 'py', {at[1]}, 'pz', {at[2]}, 'cut', (shiftright(mask, {a}) & 1) <> (shiftright(mask, {b}) & 1))")
    points = samples.where("mask NOT IN (0, 255)").selectExpr(*CELL, f"inline(array({', '.join(rows)}))").where("cut").drop("cut")
    with_g = gradient(points, CELL, contrib)
    norm = "sqrt(gx * gx + gy * gy + gz * gz)"
    return with_g.selectExpr(*CELL, "edge", "px", "py", "pz", *[f"CASE WHEN {norm} <= 1e-12 THEN 0e0 ELSE -g{a} / {norm} END AS n{a}" for a in "xyz"])


def qef(samples: DataFrame, g: Grid, weight: float = 0.1) -> DataFrame:
    """Vertex of each cell from its Hermite samples: regularised least squares, clamped to the cell.

    Adds the mean normal, usable samples, the alignment of the worst normal and the residual's rms. A cell
    without a usable normal has its centre and no normal; where the equations are singular, as they can be
    without a weight, the mean of the sample points is taken. A cell has twelve samples at most, which stay
    together for the residuals, so that one aggregation does.
    """
    lo, hi = g.bounds()
    center = [f"(({lo[i]} + {hi[i]}) / 2e0)" for i in range(3)]
    s = lambda e, n: F.expr(f"sum({e})").alias(n)
    given = samples.selectExpr("*", "(nx * px + ny * py + nz * pz) AS d", "(nx <> 0e0 OR ny <> 0e0 OR nz <> 0e0) AS use")
    sums = [s(f"n{a} * n{b}", f"m{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")] + [s(f"d * n{a}", f"r{a}") for a in "xyz"] + [s(f"n{a}", f"s{a}") for a in "xyz"]
    sums += [F.expr(f"coalesce(avg(CASE WHEN use THEN p{a} END), 0e0)").alias(f"mean{a}") for a in "xyz"]
    hold = F.expr("collect_list(CASE WHEN use THEN named_struct('px', px, 'py', py, 'pz', pz, 'nx', nx, 'ny', ny, 'nz', nz) END)").alias("hs")
    m = given.groupBy(*CELL).agg(F.count_if("use").alias("usable"), *sums, hold)
    w = S.num(weight)
    m = m.selectExpr(*CELL, "usable", "hs", *[f"m{a}{a} + {w} AS m{a}{a}" for a in "xyz"], "mxy", "mxz", "myz", *[f"r{a} + {w} * {center[i]} AS r{a}" for i, a in enumerate("xyz")], *[f"{v}{a}" for v in ("s", "mean") for a in "xyz"])
    det = "(mxx * (myy * mzz - myz * myz) - mxy * (mxy * mzz - myz * mxz) + mxz * (mxy * myz - myy * mxz))"
    sol = [
        "(rx * (myy * mzz - myz * myz) - mxy * (ry * mzz - myz * rz) + mxz * (ry * myz - myy * rz))",
        "(mxx * (ry * mzz - myz * rz) - rx * (mxy * mzz - myz * mxz) + mxz * (mxy * rz - ry * mxz))",
        "(mxx * (myy * rz - ry * myz) - mxy * (mxy * rz - ry * mxz) + rx * (mxy * myz - myy * mxz))",
    ]
    length = "sqrt(sx * sx + sy * sy + sz * sz)"
    best = [f"CASE WHEN usable = 0 THEN {center[i]} WHEN abs({det}) <= 1e-10 THEN mean{a} ELSE {sol[i]} / {det} END" for i, a in enumerate("xyz")]
    v = m.selectExpr(*CELL, "usable", "hs", *[f"least(greatest({best[i]}, {lo[i]}), {hi[i]}) AS v{a}" for i, a in enumerate("xyz")], *[f"CASE WHEN {length} <= 1e-12 THEN 0e0 ELSE s{a} / {length} END AS a{a}" for a in "xyz"])
    off = "((vx - p.px) * p.nx + (vy - p.py) * p.ny + (vz - p.pz) * p.nz)"
    rms = f"CASE WHEN usable = 0 THEN 0e0 ELSE sqrt(aggregate(hs, 0e0, (s, p) -> s + {off} * {off}) / usable) END AS rms"
    alignment = "CASE WHEN usable < 2 THEN 1e0 ELSE array_min(transform(hs, p -> p.nx * ax + p.ny * ay + p.nz * az)) END AS alignment"
    return v.selectExpr(*CELL, "usable", *[f"{k}{a}" for k in "va" for a in "xyz"], rms, alignment)


def refine(p: DataFrame, g: Grid, min_usable: int = 3, max_rms_ratio: float = 0.1, min_alignment: float = 0.97) -> DataFrame:
    """Adaptive cells, level by level: `(depth, ix, iy, iz, is_leaf, is_active, mask, n)`.

    A cell with two contributors or more through which the surface may pass, or which its parent's
    vertex or samples point at, is split unless it has the largest depth or its vertex fits well. One
    pass for each depth; what a level hands to the next is checkpointed.
    """
    spark = p.sparkSession
    cells = top_cells(spark, g).withColumn("hint", F.lit(False))
    contrib = contributors(p, g)
    levels = []
    for depth in range(g.max_depth + 1):
        samples = with_surface(corner_samples(contrib, g), g)
        state = cut(cells.join(samples, CELL, "left").selectExpr(*CELL, "hint", "coalesce(n, 0) AS n", "coalesce(mask, 0) AS mask", "coalesce(straddles, false) AS straddles", *VALUES))
        live = state.where("n >= 2 AND (straddles OR hint)")
        if depth < g.max_depth:
            h = hermite(live.where("straddles"), contrib, g)
            fit = qef(h, g)
            diagonal = S.num(g.width(depth) * 3**0.5 / 2)
            good = fit.where(f"usable >= {min_usable} AND alignment >= {S.num(min_alignment)} AND rms <= {S.num(max_rms_ratio)} * {diagonal}").select(*CELL, F.lit(True).alias("good"))
            split = cut(live.join(good, CELL, "left").where("good IS NULL").select(*CELL, "straddles"))
            if split.isEmpty():
                split = None
        else:
            split = None
        marked = state.join(split.select(*CELL, F.lit(True).alias("split")), CELL, "left") if split is not None else state.withColumn("split", F.lit(None).cast("boolean"))
        levels.append(marked.selectExpr(*CELL, "split IS NULL AS is_leaf", "n >= 2 AND (straddles OR hint) AND split IS NULL AS is_active", "mask", "n", *VALUES))
        if split is None:
            break
        young = children(split.drop("straddles"))
        parents = fit.select(*CELL, F.col("vx").alias("px"), F.col("vy").alias("py"), F.col("vz").alias("pz")).unionByName(h.select(*CELL, "px", "py", "pz"))
        lo, hi = g.bounds()
        at = children(parents.join(split, CELL, "left_semi")).where(S.closed_box(lo, hi, names=("px", "py", "pz")))
        hints = at.select(*CELL).distinct().withColumn("hint", F.lit(True))
        cells = cut(young.join(hints, CELL, "left").selectExpr(*CELL, "coalesce(hint, false) AS hint"))
        contrib = cut(child_contributors(contrib.join(split.select(*CELL), CELL, "left_semi"), g))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def leaf_lookup(points: DataFrame, leaves: DataFrame, max_depth: int, columns: list[str]) -> DataFrame:
    """The leaf that holds each finest-lattice place `(jx, jy, jz)`: an equi-join on one key a depth.

    Leaves tile the domain, so a place inside meets exactly one; places outside meet none and go.
    """
    keyed = points.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(max_depth))))
    keyed = keyed.where("jx >= 0 AND jy >= 0 AND jz >= 0").selectExpr("*", *[f"(j{a} >> ({max_depth} - depth)) AS i{a}" for a in "xyz"])
    return keyed.join(leaves.select(*CELL, *columns), CELL)


def balance(leaves: DataFrame, max_depth: int) -> DataFrame:
    """Split leaves until face neighbours differ by one depth at most: strict 2:1 closure of `CELL` keys."""
    leaves = cut(leaves.select(*CELL))
    for _ in range(max_depth * max_depth + 1):
        probes = None
        for f in S.FACES:
            at = leaves.where("depth >= 2").selectExpr("depth - 1 AS pd", *[f"(i{a} >> 1) + {d} AS q{a}" for a, d in zip("xyz", f)])
            probes = at if probes is None else probes.unionAll(at)
        places = probes.distinct().selectExpr(*[f"q{a} << ({max_depth} - pd) AS j{a}" for a in "xyz"], "pd")
        coarse = leaf_lookup(places, leaves, max_depth, []).where("depth < pd").select(*CELL).distinct()
        coarse = cut(coarse)
        if coarse.isEmpty():
            return leaves
        leaves = cut(leaves.join(coarse, CELL, "left_anti").unionByName(children(coarse).select(*CELL)))
    raise RuntimeError("balance did not settle")


def tree_summary(cells: DataFrame) -> DataFrame:
    """Counts by depth, and of all depths where depth is null."""
    one = lambda c, n: F.sum(F.expr(f"CAST({c} AS bigint)")).alias(n)
    return cells.rollup("depth").agg(F.count("*").alias("total"), one("is_leaf", "leaf"), one("NOT is_leaf", "internal"), one("is_active", "active"), one("NOT is_active", "inactive"), one("mask NOT IN (0, 255)", "surface"))
