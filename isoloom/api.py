"""The staged interface: `build_tree`, `regularize`, `extract_mesh`, and `generate_mesh` for all of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoloom.operators import fof, mesh, octree, solid, subdivision, surface
from isoloom.operators.leaves import leaf_contributors, leaf_samples, refine_surface_band, refine_thickening_band, thickening_band, with_ids
from isoloom.operators.octree import CELL, Grid
from isoloom.session import cut
from isoloom.sources import meshfiles

PARTICLE = ["pid", "x", "y", "z", "h"]
#: What a saved tree says of itself.
VERSION, KERNEL = "1.0", "wendland_c2"
META = "low double, high double, resolution int, isovalue double, max_depth int, version string, kernel string, has_vertices boolean, has_labels boolean"


@dataclass(frozen=True)
class TreeState:
    """Balanced leaves with corner values and `lid`, their contributors, and the particles."""

    grid: Grid
    particles: DataFrame
    leaves: DataFrame
    contributors: DataFrame

    def save(self, path: str, vertices: DataFrame | None = None, labels: DataFrame | None = None) -> None:
        """Tables `meta`, `particles`, `leaves`, `contributors` and, if given, `vertices` and group `labels`."""
        spark, g = self.leaves.sparkSession, self.grid
        meta = spark.createDataFrame([(g.low, g.high, g.resolution, g.isovalue, g.max_depth, VERSION, KERNEL, vertices is not None, labels is not None)], META)
        tables = {"meta": meta, "particles": self.particles, "leaves": self.leaves, "contributors": self.contributors}
        meshfiles.save_tables(tables | ({"vertices": vertices} if vertices is not None else {}) | ({"labels": labels} if labels is not None else {}), path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> TreeState:
        """A saved tree. Another version or kernel is an error. Its vertices and labels: `load_extra`."""
        t = meshfiles.load_tables(spark, path, ["meta", "particles", "leaves", "contributors"])
        meta = t["meta"].first().asDict()
        if (meta["version"], meta["kernel"]) != (VERSION, KERNEL):
            raise ValueError(f"a tree of version {meta['version']}, kernel {meta['kernel']}, cannot be read")
        return TreeState(Grid(*[meta[k] for k in ("low", "high", "resolution", "isovalue", "max_depth")]), t["particles"], t["leaves"], t["contributors"])

    @staticmethod
    def load_extra(spark: SparkSession, path: str) -> dict[str, DataFrame]:
        """The `vertices` and `labels` saved with a tree, as far as there are any."""
        meta = meshfiles.load_tables(spark, path, ["meta"])["meta"].first()
        return meshfiles.load_tables(spark, path, [n for n in ("vertices", "labels") if meta[f"has_{n}"]])


@dataclass(frozen=True)
class TopologyState:
    """A tree whose solid was opened: classified leaves, face neighbours, and the leaves `(lid)` that stay."""

    tree: TreeState
    solid: DataFrame
    neighbours: DataFrame
    opened: DataFrame


@dataclass(frozen=True)
class Mesh:
    vertices: DataFrame
    faces: DataFrame
    isovalue: float

    def save(self, path: str) -> int:
        return meshfiles.save_mesh(self.vertices, self.faces, path)


def build_tree(particles: DataFrame, grid: Grid, min_usable: int = 3, max_rms_ratio: float = 0.1, min_alignment: float = 0.97, band: float | None = None) -> TreeState:
    """Refine, optionally split the surface band down to `band`, balance and sample. No particles is an error."""
    p = cut(particles.select(*PARTICLE))
    if p.isEmpty():
        raise ValueError("no particles")
    leaves = octree.refine(p, grid, min_usable, max_rms_ratio, min_alignment).where("is_leaf")
    return sampled(grid, p, refine_surface_band(p, leaves, grid, band) if band else octree.balance(leaves, grid.max_depth))


def sampled(grid: Grid, p: DataFrame, leaves: DataFrame) -> TreeState:
    """A tree of leaves that tile the domain, with their contributors, corner values and numbers."""
    contrib = cut(leaf_contributors(p, leaves, grid))
    return TreeState(grid, p, cut(with_ids(leaf_samples(leaves, contrib, grid))), contrib)


def _solid(tree: TreeState) -> tuple[DataFrame, DataFrame]:
    state = cut(solid.classify(tree.leaves, tree.contributors, tree.grid))
    return state, cut(solid.face_neighbours(tree.leaves.select("lid", *CELL), tree.grid))


def regularize(tree: TreeState, min_feature_thickness: float, pre_thickening_radius: float = 0.0, clean: bool = False) -> TopologyState:
    """Thicken, erode and dilate the solid by half the thickness.

    With `clean`, leaves that thickening reaches are first refined to half the thickness, and of the opened
    solid small cavities are filled, small parts and leaves with five free faces dropped and ambiguous edges cleared.
    """
    if min_feature_thickness <= 0 or pre_thickening_radius < 0:
        raise ValueError("the thickness must be positive, the pre-thickening radius not negative")
    radius = target = min_feature_thickness / 2
    state, nbr = _solid(tree)
    if pre_thickening_radius > 0:
        for _ in range(tree.grid.max_depth if clean else 0):
            near = solid.outside_distance(state, nbr, pre_thickening_radius + 2 * target)
            finer = refine_thickening_band(tree.leaves, thickening_band(state, nbr, near, pre_thickening_radius, target), tree.grid)
            if finer is None:
                break
            tree = sampled(tree.grid, tree.particles, finer)
            state, nbr = _solid(tree)
        near = solid.outside_distance(state, nbr, pre_thickening_radius)
        thick = solid.dilate(state.where("inside"), near, pre_thickening_radius).withColumn("in", F.lit(True))
        state = cut(state.drop("inside").join(thick, "lid", "left").withColumn("inside", F.coalesce("in", F.lit(False))).drop("in"))
    # a clearance limit above the radius: leaves that stay unreached are deeper than the erosion goes
    clear = solid.clearance(state, nbr, solid.occupancy(state, nbr), radius + tree.grid.width())
    eroded = cut(solid.erode(state, clear, radius))
    opened = cut(solid.dilate(eroded, solid.mask_distance(state, nbr, eroded, radius), radius))
    if clean:
        opened = cut(solid.prune(cut(solid.fill_cavities(opened, state, nbr)), state, nbr))
        opened = cut(solid.drop_contacts(opened, nbr))
        opened = cut(solid.resolve_ambiguities(opened, state, nbr, tree.grid))
    return TopologyState(tree, state, nbr, opened)


def with_mask(state: TopologyState, mask: DataFrame) -> TopologyState:
    """The state with an edited mask `(lid)` in place of the opened one. Numbers that no leaf has, and repeats, are errors."""
    m = cut(mask.select("lid"))
    if m.join(state.solid.select("lid"), "lid", "left_anti").union(m.groupBy("lid").count().where("count > 1").select("lid")).limit(1).count():
        raise ValueError("the mask must name leaves of the tree, each once")
    return TopologyState(state.tree, state.solid, state.neighbours, m)


def topology_counts(state: TopologyState) -> DataFrame:
    """One row: leaves in all, inside, on either side of the boundary, and opened."""
    return solid.counts(state.solid, solid.occupancy(state.solid, state.neighbours), state.opened)


def tree_vertices(tree: TreeState) -> tuple[TreeState, DataFrame]:
    """A tree whose surface has no gaps where depths meet, and its vertices.

    Leaves that faces need but that have no vertex and no sign change are split until there are none.
    """
    g = tree.grid
    verts = cut(surface.vertices(tree.leaves, tree.contributors, g))
    for _ in range(g.max_depth):
        missing = surface.missing_incident(tree.leaves, verts, g)
        finer = surface.split_missing(tree.leaves, missing, g)
        if finer is None:
            return tree, cut(surface.activate_missing(tree.leaves, missing, verts, tree.contributors, g))
        tree = sampled(g, tree.particles, finer)
        verts = cut(surface.vertices(tree.leaves, tree.contributors, g))
    return tree, verts


def extract_mesh(state: TreeState | TopologyState, smoothing_iterations: int = 0, smoothing_strength: float = 0.5, max_edge_ratio: float = 1.5, remove_islands_fraction: float | None = None) -> Mesh:
    """Dual-contoured surface of a tree, or the faces of an opened solid; then smoothing, long edges, islands."""
    if isinstance(state, TreeState):
        g = state.grid
        state, verts = tree_vertices(state)
        faces = cut(surface.faces(state.leaves, verts, g))
        sizes = verts.select("vid", F.expr(f"{g.width()!r}D / CAST((1 << depth) AS double)").alias("size"))
    elif isinstance(state, TopologyState):
        g = state.tree.grid
        verts, faces = solid.blocky_surface(state.opened, state.solid, g)
        verts, faces = cut(verts), cut(faces)
        sizes = verts.select("vid", F.lit(g.width(g.max_depth)).alias("size"))
    else:
        raise TypeError(f"extract_mesh takes a TreeState or a TopologyState, not {type(state).__name__}")
    points = verts.select("vid", "x", "y", "z")
    if smoothing_iterations > 0:
        near = surface.vertex_adjacency(state.leaves, verts, g) if isinstance(state, TreeState) else mesh.adjacency(faces)
        points = cut(mesh.laplacian(points, cut(near), smoothing_iterations, smoothing_strength))
    if max_edge_ratio > 0:
        points, faces = mesh.subdivide_long(points, faces, sizes, max_edge_ratio)
        points, faces = cut(points), cut(faces)
    return Mesh(points, mesh.remove_islands(points, faces, remove_islands_fraction), g.isovalue)


def generate_mesh(particles: DataFrame, domain_min: float, domain_max: float, base_resolution: int, max_depth: int, isovalue: float, smoothing_iterations: int = 0, smoothing_strength: float = 0.5, max_edge_ratio: float = 1.5, minimum_usable_hermite_samples: int = 3, max_qef_rms_residual_ratio: float = 0.1, min_normal_alignment_threshold: float = 0.97, min_feature_thickness: float = 0.0, pre_thickening_radius: float = 0.0, remove_islands_fraction: float | None = None) -> Mesh:
    """One shot. With a thickness, the cleaned opened solid gives the surface; it is at least two finest leaves."""
    grid = Grid(domain_min, domain_max, base_resolution, isovalue, max_depth)
    thickness = max(min_feature_thickness, 2 * grid.width(max_depth)) if min_feature_thickness > 0 else 0.0
    state = build_tree(particles, grid, minimum_usable_hermite_samples, max_qef_rms_residual_ratio, min_normal_alignment_threshold, thickness / 2 or None)
    if thickness:
        state = regularize(state, thickness, pre_thickening_radius, clean=True)
    return extract_mesh(state, smoothing_iterations, smoothing_strength, max_edge_ratio, remove_islands_fraction)


def generate_group_meshes(particles: DataFrame, labels: DataFrame, *args, least: int = 3, **settings) -> Mesh:
    """One surface for each group `(pid, group)` with at least `least` particles, joined into one mesh.

    Takes what `generate_mesh` takes. Groups are done one after another, as each has a tree of its own; only
    their numbers come to the driver. Groups without a surface give no faces.
    """
    known = cut(particles.select(*PARTICLE).join(labels.select("pid", "group"), "pid"))
    groups = sorted(r["group"] for r in known.groupBy("group").count().where(F.col("count") >= least).collect())
    if not groups:
        raise ValueError("no group has enough particles")
    made = [generate_mesh(known.where(F.col("group") == g), *args, **settings) for g in groups]
    verts, faces = made[0].vertices, made[0].faces
    for m in made[1:]:
        verts, faces = mesh.merge((verts, faces), (m.vertices, m.faces))
        verts, faces = cut(verts), cut(faces)
    return Mesh(verts, faces, made[0].isovalue)


def repair_mesh(m: Mesh, smoothing: int = 0) -> Mesh:
    """Merge vertices of one place, close holes of up to 128 edges, smooth, and turn faces outward."""
    return Mesh(*mesh.repair(m.vertices, m.faces, smoothing), m.isovalue)


def simplify_mesh(m: Mesh, factor: float = 1.0) -> Mesh:
    """Keep about `factor` of the faces, four at least; 1 keeps all."""
    return m if factor == 1 else Mesh(*mesh.decimate(m.vertices, m.faces, factor), m.isovalue)


def cluster_particles(particles: DataFrame, domain: float, linking_factor: float = 1.5) -> DataFrame:
    """`(pid, group)`: friends of friends, with a linking length from the mean distance."""
    return fof.cluster(particles, fof.linking_length(particles, linking_factor, domain))


def smooth_mesh(m: Mesh, iterations: int) -> Mesh:
    """Taubin smoothing: each iteration shrinks, then inflates."""
    return Mesh(cut(mesh.taubin(m.vertices, cut(mesh.adjacency(m.faces)), 2 * iterations)), m.faces, m.isovalue)


def subdivide_mesh(m: Mesh, iterations: int = 1) -> Mesh:
    return Mesh(*subdivision.loop(m.vertices, m.faces, iterations), m.isovalue)
