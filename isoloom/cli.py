"""Command line: a Parquet particle table to a binary STL file."""

from __future__ import annotations

import argparse
import sys

from isoloom import api
from isoloom.operators import fof, mesh
from isoloom.operators.octree import Grid
from isoloom.session import cut, local_session
from isoloom.sources import meshfiles
from isoloom.sources import particles as P


def positive(text: str) -> float:
    value = float(text)
    if not value > 0:
        raise argparse.ArgumentTypeError("must be positive")
    return value


def fraction(text: str) -> float:
    value = float(text)
    if not 0 < value <= 1:
        raise argparse.ArgumentTypeError("must be above 0 and at most 1")
    return value


def percentile(text: str) -> float:
    value = float(text)
    if not 0 <= value <= 100:
        raise argparse.ArgumentTypeError("must be between 0 and 100")
    return value


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="isoloom", description=__doc__)
    # fixed values: names and defaults of the arguments
    p.add_argument("filename", nargs="?", help="Parquet particles: pid, x, y, z and, optionally, h, family and box; not read with --load-octree")
    p.add_argument("-o", "--output", default="mesh.stl")
    p.add_argument("-p", "--particle-type", choices=P.FAMILIES)
    p.add_argument("-b", "--box-size", type=positive, help="the snapshot's own if not given")
    p.add_argument("--shift", type=float, nargs=3, default=(0.0, 0.0, 0.0))
    p.add_argument("--wrap-shift", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--center", type=float, nargs=3)
    p.add_argument("--extent", type=positive)
    p.add_argument("--no-periodic", action="store_true")
    p.add_argument("--tight-bounds", action="store_true")
    p.add_argument("--smoothing-factor", type=positive, default=1.0)
    p.add_argument("--base-resolution", type=int, default=4)
    p.add_argument("--max-depth", type=int, default=4)
    p.add_argument("-t", "--isovalue", type=positive)
    p.add_argument("--surface-percentile", type=percentile, default=5.0)
    p.add_argument("--min-usable-hermite-samples", type=int, default=3)
    p.add_argument("--max-qef-rms-residual-ratio", type=positive, default=0.1)
    p.add_argument("--min-normal-alignment-threshold", type=float, default=0.97)
    p.add_argument("--smoothing-iterations", type=int, default=0)
    p.add_argument("--smoothing-strength", type=float, default=0.5)
    p.add_argument("--max-edge-ratio", type=positive, default=1.5)
    p.add_argument("--min-feature-thickness", type=float, default=0.0, help="in centimetres with --target-size, else in particle units")
    p.add_argument("--pre-thickening-radius", type=float, default=0.0, help="same unit")
    p.add_argument("--fof", action="store_true", help="a surface for each group of particles")
    p.add_argument("--min-fof-cluster-size", type=int)
    p.add_argument("--linking-factor", type=positive, default=0.2)
    p.add_argument("--remove-islands-fraction", type=float)
    p.add_argument("--simplify-factor", type=fraction, default=1.0, help="share of the faces to keep")
    p.add_argument("-s", "--target-size", type=positive, help="longest extent of the mesh in centimetres")
    p.add_argument("--save-octree", help="folder for the tree's tables")
    p.add_argument("--load-octree", help="folder of a saved tree; particles are not read")
    p.add_argument("--silent", action="store_true", help="print nothing but errors")
    p.add_argument("--visualise-verts", help="picture of a sample of the vertices (needs matplotlib)")
    p.add_argument("--nthreads", type=int, help="cores of the local session; all if not given")
    return p


def run(args: argparse.Namespace) -> int:
    """Number of triangles written."""
    if not args.load_octree and not args.filename:
        raise ValueError("give a particle table or --load-octree")
    if args.load_octree and args.fof:
        raise ValueError("--fof needs particles, not a saved tree")
    spark, origin = local_session(args.nthreads or "*"), (0.0, 0.0, 0.0)
    if args.load_octree:
        tree = api.TreeState.load(spark, args.load_octree)
        thickness, radius = _lengths(args, tree.grid.high - tree.grid.low, tree.grid)
    else:
        if (args.center is None) != (args.extent is None):
            raise ValueError("--center and --extent go together")
        box = side = P.box_size(spark, args.filename, args.box_size)
        p = P.shift(P.load(spark, args.filename, args.particle_type, args.smoothing_factor, box), tuple(args.shift), box if args.wrap_shift else None)
        if args.extent is not None:
            p, side = P.crop(p, tuple(args.center), args.extent, side, not args.no_periodic), args.extent
            origin = tuple(c - args.extent / 2 for c in args.center)
            origin = origin if args.no_periodic else tuple(v % box for v in origin)
        p = cut(p)
        if args.extent is not None and p.isEmpty():
            raise ValueError("no particles in the cube: move --center, enlarge --extent or choose another --particle-type")
        if args.tight_bounds:
            p, side, moved = P.tighten(p, side)
            origin = tuple(a + b for a, b in zip(origin, moved))
        if args.min_fof_cluster_size is not None:
            p = cut(fof.drop_small(p, fof.cluster(p, fof.linking_length(p, args.linking_factor, side)), args.min_fof_cluster_size))
        if p.isEmpty():
            raise ValueError("no particles are left: check the selection and --particle-type")
        iso = args.isovalue or P.isovalue(p, args.surface_percentile).first()["isovalue"]
        grid = Grid(0.0, side, args.base_resolution, iso, args.max_depth)
        thickness, radius = _lengths(args, side, grid)
        if args.fof:
            labels = cut(fof.cluster(p, fof.linking_length(p, args.linking_factor, side)))
            settings = (0.0, side, args.base_resolution, args.max_depth, iso, args.smoothing_iterations, args.smoothing_strength, args.max_edge_ratio, args.min_usable_hermite_samples, args.max_qef_rms_residual_ratio, args.min_normal_alignment_threshold, thickness, radius)
            return _finish(args, api.generate_group_meshes(p, labels, *settings), origin)
        tree = api.build_tree(p, grid, args.min_usable_hermite_samples, args.max_qef_rms_residual_ratio, args.min_normal_alignment_threshold, thickness / 2 or None)
        if args.save_octree:
            tree.save(args.save_octree)
    state = api.regularize(tree, thickness, radius, clean=True) if thickness else tree
    return _finish(args, api.extract_mesh(state, args.smoothing_iterations, args.smoothing_strength, args.max_edge_ratio), origin)


def _finish(args: argparse.Namespace, m: api.Mesh, origin: tuple[float, ...]) -> int:
    """Islands, then simplification, then scale; number of triangles written."""
    if m.faces.isEmpty():
        raise ValueError("no triangles: the surface is empty")
    m = api.simplify_mesh(api.Mesh(m.vertices, cut(mesh.remove_islands(m.vertices, m.faces, args.remove_islands_fraction)), m.isovalue), args.simplify_factor)
    if args.visualise_verts:
        meshfiles.picture(m.vertices, args.visualise_verts)
    verts = mesh.translate(m.vertices, origin)
    if args.target_size:
        verts = mesh.scale_to_print(verts, args.target_size)
    return api.Mesh(cut(verts), m.faces, m.isovalue).save(args.output)


def _lengths(args: argparse.Namespace, side: float, grid: Grid) -> tuple[float, float]:
    """Thickness (two finest leaves at least) and pre-thickening radius in particle units."""
    unit = side / args.target_size if args.target_size else 1.0
    thickness = args.min_feature_thickness * unit
    return (max(thickness, 2 * grid.width(grid.max_depth)) if thickness > 0 else 0.0), args.pre_thickening_radius * unit


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        written = run(args)
        if not args.silent:
            print(f"{written} triangles written to {args.output}")
    except KeyboardInterrupt:
        return 130
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
