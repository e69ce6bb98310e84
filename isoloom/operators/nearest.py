"""Distance to the k-th neighbour among the points of the 27 bins around, exact and without listing pairs.

Equal positions are one point with a count. Points are dealt to leaves of a k-d tree, whose borders come from a sample
and change the work only, never the result. A leaf settles the points whose ball lies inside; the others ask
the leaves that their ball touches for what is nearer there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoloom.session import stored

#: Points of a leaf; fewer where that gives fewer leaves than FEW_LEAVES, more beyond MOST_LEAVES of them.
LEAF, SMALL_LEAF, FEW_LEAVES, MOST_LEAVES = 16384, 256, 64, 4096
#: Points of the sample for each leaf, points that are searched together, and candidates compared at once.
SAMPLE, GROUP, CHUNK = 64, 64, 16384


def split_tree(sample: np.ndarray, leaves: int) -> tuple | int:
    """Nested (axis, value, below, rest) down to leaf numbers, by medians of the widest axis."""
    count = iter(range(leaves))

    def node(points: np.ndarray, n: int) -> tuple | int:
        extent = np.ptp(points, axis=0) if len(points) else np.zeros(3)
        axis = int(extent.argmax())
        if n <= 1 or extent[axis] == 0:
            return next(count)
        v = np.sort(points[:, axis])
        at = v[len(v) * (n // 2) // n]
        at = at if at > v[0] else v[np.searchsorted(v, at, "right")]
        low = points[:, axis] < at
        return axis, float(at), node(points[low], n // 2), node(points[~low], n - n // 2)

    return node(sample, leaves)


def leaf_of(tree: tuple | int, points: np.ndarray) -> np.ndarray:
    out, stack = np.empty(len(points), np.int32), [(tree, np.arange(len(points)))]
    while stack:
        node, idx = stack.pop()
        if isinstance(node, int):
            out[idx] = node
        else:
            low = points[idx, node[0]] < node[1]
            stack += [(node[2], idx[low]), (node[3], idx[~low])]
    return out


def _squares(d: np.ndarray) -> np.ndarray:
    """Summed in the order of `scalar.distance`, so that roots are equal to the last bit."""
    return d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2]


def _gap(lo: np.ndarray, hi: np.ndarray, at_lo: np.ndarray, at_hi: np.ndarray) -> np.ndarray:
    """Squared distance of two boxes. Rounding is monotone: never more than that of points inside."""
    return _squares(np.maximum(np.maximum(lo - at_hi, at_lo - hi), 0.0))


def _meet(lo: np.ndarray, hi: np.ndarray, at_lo: np.ndarray, at_hi: np.ndarray) -> np.ndarray:
    """Whether some bins of two ranges are neighbours."""
    return ((at_hi >= lo - 1) & (at_lo <= hi + 1)).all(-1)


def _halves(points: np.ndarray, idx: np.ndarray) -> list[np.ndarray]:
    p = points[idx]
    order = np.argpartition(p[:, np.ptp(p, axis=0).argmax()], len(idx) // 2)
    return [idx[order[: len(idx) // 2]], idx[order[len(idx) // 2 :]]]


def _groups(points: np.ndarray, most: int) -> Iterator[np.ndarray]:
    stack = [np.arange(len(points))] if len(points) else []
    while stack:
        idx = stack.pop()
        if len(idx) > most:
            stack += _halves(points, idx)
        else:
            yield idx


def _brute(q: np.ndarray, qb: np.ndarray, c: np.ndarray, cb: np.ndarray, k: int) -> np.ndarray:
    """The k least squared distances to candidates in neighbouring bins, ascending; inf where there are fewer."""
    best = np.full((len(q), k), np.inf)
    for at in range(0, len(c), CHUNK):
        p, b = c[at : at + CHUNK], cb[at : at + CHUNK]
        d = _squares(q[:, None, :] - p[None, :, :])
        if (b.max(0) - qb.min(0) > 1).any() or (qb.max(0) - b.min(0) > 1).any():
            d[(np.abs(qb[:, None, :] - b[None, :, :]) > 1).any(-1)] = np.inf
        best = np.partition(np.concatenate([best, d], 1), k - 1, axis=1)[:, :k]
    return np.sort(best, axis=1)


def search(q: np.ndarray, qb: np.ndarray, reach: np.ndarray, c: np.ndarray, cb: np.ndarray, cn: np.ndarray, k: int) -> np.ndarray:
    """Like `_brute` for candidates that count `cn` times; complete up to each query's squared reach."""
    out = np.full((len(q), k), np.inf)
    stack = [(np.arange(len(q)), np.arange(len(c)))] if len(q) else []
    while stack:
        i, j = stack.pop()
        j = j[_meet(qb[i].min(0), qb[i].max(0), cb[j], cb[j])]
        j = j[_gap(q[i].min(0), q[i].max(0), c[j], c[j]) <= reach[i].max()]
        if len(j) and len(i) > GROUP:
            stack += [(half, j) for half in _halves(q, i)]
        elif len(j):
            j = np.repeat(j, cn[j])
            out[i] = _brute(q[i], qb[i], c[j], cb[j], k)
    return out


def within(p: np.ndarray, b: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Squared distances of each point to its k nearest of the same leaf, itself not counted."""
    n = np.minimum(n, k + 1)
    reach = np.full(len(p), np.inf)
    for i in _groups(p, 3 * (k + 1)):  # halves of more hold k and the point itself, so that it has a reach
        j = np.repeat(i, n[i])
        reach[i] = _brute(p[i], b[i], p[j], b[j], k + 1)[:, k]
    return search(p, b, reach, p, b, n, k + 1)[:, 1:]


def routes(p: np.ndarray, b: np.ndarray, reach: np.ndarray, boxes: dict[str, np.ndarray], own: int, k: int) -> list[np.ndarray]:
    """The leaves that each point has to ask. `reach` is lowered to what a leaf that holds k candidates warrants."""
    out = [np.empty(0, np.int32)] * len(p)
    for i in _groups(p, GROUP):
        i = i[reach[i] > 0]
        if not len(i):
            continue
        near = _meet(b[i].min(0), b[i].max(0), boxes["blo"], boxes["bhi"]) & (_gap(p[i].min(0), p[i].max(0), boxes["lo"], boxes["hi"]) <= reach[i].max())
        leaf, lo, hi, blo, bhi, n = (boxes[x][near & (boxes["leaf"] != own)] for x in ("leaf", "lo", "hi", "blo", "bhi", "n"))
        if not len(leaf):
            continue
        at, bin_at = p[i][:, None, :], b[i][:, None, :]
        whole = ((blo >= bin_at - 1) & (bhi <= bin_at + 1)).all(-1) & (n >= k)
        most = np.where(whole, _squares(np.maximum(np.abs(at - lo), np.abs(at - hi))), np.inf).min(1)
        reach[i] = np.minimum(reach[i], most)
        asked = _meet(bin_at, bin_at, blo, bhi) & (_gap(at, at, lo, hi) <= reach[i][:, None])
        for row, which in zip(i, asked):
            out[row] = leaf[which]
    return out


def _lists(rows: list[np.ndarray], kind: type) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.empty(0, kind)])))


def _arrays(t: pa.Table | pa.RecordBatch, *names: str) -> np.ndarray:
    return np.column_stack([t.column(x).to_numpy() if isinstance(t, pa.Table) else t.column(x).to_numpy(zero_copy_only=False) for x in names])


POINT, BINS = ("x", "y", "z"), ("bx", "by", "bz")


def kth_distances(points: DataFrame, k: int) -> DataFrame:
    """For rows `x, y, z` (finite) with bins `bx, by, bz`: each position's distance `d` to its k-th neighbour or, of fewer,
    the last (null without any), and their number `m`, k at most. Equal positions give one row."""
    u = stored(points.groupBy(*POINT, *BINS).agg(F.count("*").alias("n")), "positions")
    total = u.count()
    leaves = max(1, min(MOST_LEAVES, max(total // LEAF, min(FEW_LEAVES, total // SMALL_LEAF))))
    every = max(1, total // (SAMPLE * leaves))
    sample = u.where(F.pmod(F.xxhash64(*POINT), F.lit(every)) == 0).select(*POINT).toArrow() if leaves > 1 else None
    tree = split_tree(_arrays(sample, *POINT), leaves) if sample is not None else 0

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            yield t.append_column("leaf", pa.array(leaf_of(tree, _arrays(t, *POINT)), pa.int32()))

    dealt = u.mapInArrow(deal, "x double, y double, z double, bx int, by int, bz int, n long, leaf int")
    ends = [f(a).alias(f"{name}_{a}") for name, f in (("lo", F.min), ("hi", F.max)) for a in (*POINT, *BINS)]
    found = dealt.groupBy("leaf").agg(F.sum("n").alias("n"), *ends).toArrow()
    boxes = {"leaf": found.column("leaf").to_numpy(), "n": found.column("n").to_numpy()}
    boxes |= {f"{p}{end}": _arrays(found, *[f"{end}_{a}" for a in names]) for p, names in (("", POINT), ("b", BINS)) for end in ("lo", "hi")}

    def settle(t: pa.Table) -> pa.Table:
        p, b, n = _arrays(t, *POINT), _arrays(t, *BINS), t.column("n").to_numpy()
        near = within(p, b, n, k)
        reach = near[:, -1].copy()
        asked = routes(p, b, reach, boxes, t.column("leaf")[0].as_py(), k)
        m = np.isfinite(near).sum(1)
        kept = [d[(d <= r) & np.isfinite(d)] if len(a) else d[max(0, c - 1) : c] for d, r, a, c in zip(near, reach, asked, m)]
        out = {x: t.column(x) for x in (*POINT, *BINS)}
        return pa.table(out | {"m": pa.array(m, pa.int32()), "reach": reach, "near": _lists(kept, np.float64), "asked": _lists(asked, np.int32)})

    settled = stored(dealt.groupBy("leaf").applyInArrow(settle, "x double, y double, z double, bx int, by int, bz int, m int, reach double, near array<double>, asked array<int>"), "settled")

    def answer(t: pa.Table, c: pa.Table) -> pa.Table:
        p, reach = _arrays(t, *POINT), t.column("reach").to_numpy()
        rows = []
        if len(p):
            near = search(p, _arrays(t, *BINS), reach, _arrays(c, *POINT), _arrays(c, *BINS), np.minimum(c.column("n").to_numpy(), k), k)
            rows = [d[(d <= r) & np.isfinite(d)] for d, r in zip(near, reach)]
        return pa.table({x: t.column(x) for x in POINT} | {"near": _lists(rows, np.float64)})

    asking = settled.where("size(asked) > 0")
    asks = asking.select(*POINT, *BINS, "reach", F.explode("asked").alias("leaf"))
    answers = asks.groupBy("leaf").cogroup(dealt.groupBy("leaf")).applyInArrow(answer, "x double, y double, z double, near array<double>").where("size(near) > 0")
    merged = asking.select(*POINT, "near").unionAll(answers).groupBy(*POINT).agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    ready = settled.where("size(asked) = 0").select(*POINT, "m", "near").unionAll(merged.select(*POINT, F.size("near").alias("m"), "near"))
    return ready.select(*POINT, "m", F.expr("CASE WHEN size(near) > 0 THEN sqrt(element_at(near, -1)) END AS d"))
