"""Scalar functions as SQL text: lattice keys, the smoothing kernel, boxes, crossings.

Arguments and results are SQL expressions, so they stay inside whole-stage code generation. Literals are
written with an exponent, which makes them doubles.
"""

from __future__ import annotations

import math

MAX_COORDINATE = (1 << 21) - 1
CORNERS = [(i & 1, i >> 1 & 1, i >> 2 & 1) for i in range(8)]
#: The twelve cell edges by corner numbers: four along x, four along y, four along z.
EDGES = [(a, a | 1 << axis) for axis in range(3) for a in range(8) if not a >> axis & 1]
#: Face directions -x, +x, -y, +y, -z, +z.
FACES = [tuple((1 if f & 1 else -1) if axis == f // 2 else 0 for axis in range(3)) for f in range(6)]
NORM = 21.0 / (2.0 * math.pi)


def num(v: float) -> str:
    """A double literal."""
    text = repr(float(v))
    return text if "e" in text else f"{text}e0"


def _bit_sum(x: str, axis: int) -> str:
    return " | ".join(f"(((CAST({x} AS bigint) >> {b}) & 1) << {3 * b + axis})" for b in range(21))


def morton_encode(x: str, y: str, z: str) -> str:
    """Interleave 21 bits of each coordinate; x is bit 0."""
    return f"({_bit_sum(x, 0)} | {_bit_sum(y, 1)} | {_bit_sum(z, 2)})"


def morton_decode(key: str, axis: int) -> str:
    return "(" + " | ".join(f"(((CAST({key} AS bigint) >> {3 * b + axis}) & 1) << {b})" for b in range(21)) + ")"


def pack(ix: str, iy: str, iz: str) -> str:
    """(ix << 42) | (iy << 21) | iz; null outside 0 .. 2**21 - 1."""
    ok = " AND ".join(f"{v} BETWEEN 0 AND {MAX_COORDINATE}" for v in (ix, iy, iz))
    return f"CASE WHEN {ok} THEN (CAST({ix} AS bigint) << 42) | (CAST({iy} AS bigint) << 21) | CAST({iz} AS bigint) END"


def profile(q: str) -> str:
    """Wendland C2: (1 - q)^4 (1 + 4 q) on [0, 1), else 0."""
    return f"CASE WHEN {q} < 0e0 OR {q} >= 1e0 THEN 0e0 ELSE (1e0 - {q}) * (1e0 - {q}) * (1e0 - {q}) * (1e0 - {q}) * (1e0 + 4e0 * {q}) END"


def kernel(r: str, h: str, normalize: bool = True) -> str:
    scale = f" * ({num(NORM)} / ({h} * {h} * {h}))" if normalize else ""
    return f"CASE WHEN {h} <= 0e0 THEN 0e0 ELSE ({profile(f'({r} / {h})')}){scale} END"


def kernel_slope(r: str, h: str) -> str:
    """What the displacement is multiplied by in the normalised kernel's gradient; 0 at r <= 0 and r >= h."""
    q = f"({r} / {h})"
    return f"CASE WHEN {h} <= 0e0 OR {r} <= 0e0 OR {r} >= {h} THEN 0e0 ELSE (-20e0 * {q} * (1e0 - {q}) * (1e0 - {q}) * (1e0 - {q})) / ({h} * {r}) * ({num(NORM)} / ({h} * {h} * {h})) END"


def distance(dx: str, dy: str, dz: str) -> str:
    return f"sqrt(({dx}) * ({dx}) + ({dy}) * ({dy}) + ({dz}) * ({dz}))"


def gap(v: str, lo: str, hi: str) -> str:
    """Distance along an axis from v to [lo, hi]."""
    return f"greatest({lo} - {v}, 0e0, {v} - {hi})"


def support_overlaps(lo: list[str], hi: list[str], p: str = "") -> str:
    """Closest point of the box within h of the particle (touching counts)."""
    d = [gap(f"{p}{a}", lo[i], hi[i]) for i, a in enumerate("xyz")]
    return f"({d[0]}) * ({d[0]}) + ({d[1]}) * ({d[1]}) + ({d[2]}) * ({d[2]}) <= {p}h * {p}h"


def box_contains(lo: list[str], hi: list[str]) -> str:
    """Half open."""
    return " AND ".join(f"{a} >= {lo[i]} AND {a} < {hi[i]}" for i, a in enumerate("xyz"))


def box_overlaps(lo: list[str], hi: list[str], lo2: list[str], hi2: list[str]) -> str:
    """Strict: touching boxes do not overlap."""
    return " AND ".join(f"{lo[i]} < {hi2[i]} AND {lo2[i]} < {hi[i]}" for i in range(3))


def closed_box(lo: list[str], hi: list[str], slack: float = 1e-12, names: tuple[str, ...] = ("x", "y", "z")) -> str:
    return " AND ".join(f"{a} >= {lo[i]} - {num(slack)} AND {a} <= {hi[i]} + {num(slack)}" for i, a in enumerate(names))


def bin_of(v: str, lo: float, width: float, resolution: int) -> str:
    """Bin number, clamped to the grid's edge bins."""
    return f"CAST(least(greatest(floor(({v} - {num(lo)}) / {num(width)}), 0), {resolution - 1}) AS int)"


def wrap(v: str, size: float) -> str:
    """Floored modulo."""
    n = num(size)
    return f"(({v}) - {n} * floor(({v}) / {n}))"


def crossing(a: str, b: str, iso: str) -> str:
    """Where along an edge the value crosses iso, 0 to 1; 0.5 on flat edges."""
    return f"CASE WHEN abs({b} - {a}) < 1e-12 THEN 0.5e0 ELSE least(greatest(({iso} - {a}) / ({b} - {a}), 0e0), 1e0) END"


def sign_mask(v: list[str], iso: str) -> str:
    return "(" + " + ".join(f"(CASE WHEN {c} >= {iso} THEN {1 << i} ELSE 0 END)" for i, c in enumerate(v)) + ")"


def straddles(v: list[str], iso: str) -> str:
    lo, hi = f"least({', '.join(v)})", f"greatest({', '.join(v)})"
    return f"({lo} <= {iso} AND {hi} >= {iso} AND {lo} <> {hi})"


def trilinear(v: list[str], fx: str, fy: str, fz: str) -> str:
    terms = []
    for i, (a, b, c) in enumerate(CORNERS):
        w = " * ".join(f if bit else f"(1e0 - {f})" for bit, f in ((a, fx), (b, fy), (c, fz)))
        terms.append(f"({v[i]}) * {w}")
    return "(" + " + ".join(terms) + ")"


def neighbour_key(key: str, depth: str, axis: int, step: int, resolution: int) -> str:
    """Morton key of the next (step 1) or previous (-1) cell along an axis, at the same depth; null beyond the grid.

    The axis' bits are counted up or down in place: the others are filled or cleared, so that carries pass them.
    """
    bits = sum(1 << 3 * b + axis for b in range(21))
    k, one = f"CAST({key} AS bigint)", f"CAST({1 << axis} AS bigint)"
    moved = f"((({k} | {~bits}L) + {one}) & {bits}L)" if step > 0 else f"((({k} & {bits}L) - {one}) & {bits}L)"
    return f"CASE WHEN {morton_decode(key, axis)} + {step} BETWEEN 0 AND {resolution} * CAST(1 << {depth} AS bigint) - 1 THEN {moved} | ({k} & {~bits}L) END"


def share_face(p: str, q: str, max_depth: int) -> str:
    """Whether two cells, named by prefixes of depth, ix, iy and iz, touch in a face: one axis touches, two overlap."""
    lo = lambda c, a: f"({c}i{a} << ({max_depth} - {c}depth))"
    hi = lambda c, a: f"(({c}i{a} + 1) << ({max_depth} - {c}depth))"
    touch = {a: f"({hi(p, a)} = {lo(q, a)} OR {hi(q, a)} = {lo(p, a)})" for a in "xyz"}
    meet = {a: f"({lo(p, a)} < {hi(q, a)} AND {lo(q, a)} < {hi(p, a)})" for a in "xyz"}
    return "(" + " OR ".join(f"({touch[a]} AND {' AND '.join(meet[b] for b in 'xyz' if b != a)})" for a in "xyz") + ")"


def print_scale(extent: float, size_cm: float) -> float:
    """Millimetres a native unit is printed at, so that the longest extent is `size_cm`."""
    if extent <= 0:
        raise ValueError("the extent must be positive")
    return size_cm * 10.0 / extent


def native_length(length_cm: float, extent: float, size_cm: float) -> float:
    return length_cm * 10.0 / print_scale(extent, size_cm)
