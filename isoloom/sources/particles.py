"""Particle sources and their projections: shift, wrap, crop, tight bounds, isovalue, smoothing lengths.

A particle table has `pid bigint, x, y, z, h double`; any DataFrame with these columns is a source.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isoloom.functions import scalar as S
from isoloom.operators.nearest import kth_distances
from isoloom.session import stored

FAMILIES = ("gas", "dark_matter", "stars", "black_holes")


def from_arrays(spark: SparkSession, positions, lengths) -> DataFrame:
    """In-memory arrays (N, 3) and (N,)."""
    import numpy as np
    import pandas as pd

    p, h = np.asarray(positions, float), np.asarray(lengths, float)
    if p.ndim != 2 or p.shape[1] != 3:
        raise ValueError("positions must have shape (N, 3)")
    if h.ndim != 1 or len(h) != len(p):
        raise ValueError("smoothing lengths must have shape (N,) and match positions")
    frame = pd.DataFrame({"pid": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "h": h})
    return spark.createDataFrame(frame, "pid bigint, x double, y double, z double, h double")


def box_size(spark: SparkSession, path: str, given: float | None = None) -> float:
    """The box's side: the one given, else the snapshot's `box` column, of a vector the largest; else an error."""
    if given is not None:
        return float(given)
    df = spark.read.parquet(path)
    kind = dict(df.dtypes).get("box")
    row = df.where("box IS NOT NULL").selectExpr(("array_max(box)" if kind.startswith("array") else "box") + " AS b").first() if kind else None
    if row is None or row["b"] is None:
        raise ValueError("the snapshot has no box size: give one")
    return float(row["b"])


def load(spark: SparkSession, path: str, family: str | None = None, smoothing_factor: float = 1.0, box: float | None = None) -> DataFrame:
    """A Parquet snapshot; with a `family` column, one family of it (pushed down to the scan).

    Without a column `h` smoothing lengths are estimated from neighbours, for which the box's side is needed.
    """
    if family is not None and family not in FAMILIES:
        raise ValueError(f"unknown particle family: {family}")
    df = spark.read.parquet(path)
    if family is not None and "family" in df.columns:
        df = df.where(F.col("family") == family)
    if "h" not in df.columns:
        if box is None:
            raise ValueError("the snapshot has no smoothing lengths, and without a box size none can be estimated")
        resolution = max(1, int((df.count() / 8) ** (1 / 3)))
        df = estimate_lengths(df.select("pid", "x", "y", "z"), box, min(resolution, 1 << 20))
    return df.selectExpr("pid", "x", "y", "z", f"h * {S.num(smoothing_factor)} AS h")


def orders_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Particles in [0, 4]^3 from `orders`."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    top = o.agg((F.max("o_custkey") + 1).alias("top"))
    return o.join(F.broadcast(top)).selectExpr("o_orderkey AS pid", "o_totalprice / 125000e0 AS x", "CAST(o_custkey AS double) * 4e0 / CAST(top AS double) AS y", "CAST(datediff(o_orderdate, timestamp'1995-01-01') AS double) / 602e0 AS z", "0.25e0 AS h")


def embeddings_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Particles in [0, 4]^3 from the first three embedding components."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.selectExpr("vec_id AS pid", *[f"CAST(embedding[{i}] AS double) * 2e0 + 2e0 AS {a}" for i, a in enumerate("xyz")], "0.2e0 + 0.01e0 * CAST(label AS double) AS h")


def shift(p: DataFrame, offset: tuple[float, float, float], box: float | None = None) -> DataFrame:
    """Translate; with a box, wrap by floored modulo."""
    moved = {a: f"({a} + {S.num(d)})" for a, d in zip("xyz", offset)}
    return p.selectExpr("pid", *[f"{S.wrap(v, box) if box else v} AS {a}" for a, v in moved.items()], "h")


def crop(p: DataFrame, center: tuple[float, float, float], extent: float, box: float, periodic: bool = True) -> DataFrame:
    """Particles of a cube, in its local coordinates. Periodic: closed; else half open and inside the box."""
    half = extent / 2
    if periodic:
        delta = [f"({S.wrap(f'{a} - {S.num(c)} + {S.num(box / 2)}', box)} - {S.num(box / 2)})" for a, c in zip("xyz", center)]
        d = p.selectExpr("pid", "h", *[f"{v} AS d{a}" for a, v in zip("xyz", delta)])
        return d.where(" AND ".join(f"abs(d{a}) <= {S.num(half)}" for a in "xyz")).selectExpr("pid", *[f"d{a} + {S.num(half)} AS {a}" for a in "xyz"], "h")
    low = [c - half for c in center]
    if any(v < 0 or v + extent > box for v in low):
        raise ValueError("the cube leaves the box")
    inside = " AND ".join(f"{a} >= {S.num(v)} AND {a} < {S.num(v + extent)}" for a, v in zip("xyz", low))
    return p.where(inside).selectExpr("pid", *[f"{a} - {S.num(v)} AS {a}" for a, v in zip("xyz", low)], "h")


def centre_and_extent(low: str, high: str) -> tuple[str, str]:
    """SQL of the middle and the extent of a box along an axis."""
    return f"(({low}) + ({high})) / 2e0", f"({high}) - ({low})"


def bin_max_h(p: DataFrame, low: float, width: float, resolution: int) -> DataFrame:
    """Largest smoothing length of each bin, and in a row of null bins that of all."""
    binned = p.selectExpr(*[f"{S.bin_of(a, low, width, resolution)} AS i{a}" for a in "xyz"], "h")
    return binned.groupingSets([["ix", "iy", "iz"], []], "ix", "iy", "iz").agg(F.max("h").alias("max_h"))


def tight_bounds(p: DataFrame, box: float) -> DataFrame:
    """One row: clamped minima of the supports and the side of their bounding cube."""
    bounds = p.agg(*[F.expr(f"greatest(min({a} - h), 0e0)").alias(f"{a}0") for a in "xyz"], *[F.expr(f"least(max({a} + h), {S.num(box)})").alias(f"{a}1") for a in "xyz"])
    return bounds.selectExpr("x0", "y0", "z0", "greatest(x1 - x0, y1 - y0, z1 - z0) AS side")


def tighten(p: DataFrame, box: float) -> tuple[DataFrame, float, tuple[float, float, float]]:
    """Move the particles to their bounding cube: particles, side, origin. Empty input is an error."""
    b = tight_bounds(p, box).first()
    if p.isEmpty():
        raise ValueError("no particles: the selection is empty")
    if b["side"] <= 0:
        return p, box, (0.0, 0.0, 0.0)
    origin = (b["x0"], b["y0"], b["z0"])
    return shift(p, tuple(-v for v in origin)), b["side"], origin


def isovalue(p: DataFrame, percentile: float) -> DataFrame:
    """One row: the percentile (0 to 100, linear) of the particles' own densities."""
    if not 0 <= percentile <= 100:
        raise ValueError("percentile must be between 0 and 100")
    return p.agg(F.percentile(F.expr(f"{S.num(21 / (2 * math.pi))} / (h * h * h)"), percentile / 100).alias("isovalue"))


def _kth_by_pairs(asked: DataFrame, points: DataFrame, neighbours: int) -> DataFrame:
    """By id, the distance to the k-th neighbour, from all pairs: for the few rows that `kth_distances` does not take."""
    near = asked
    for a in "xyz":
        near = near.withColumn(f"b{a}", F.explode(F.array(*[F.col(f"b{a}") + d for d in (-1, 0, 1)])))
    pairs = near.alias("p").join(points.alias("q"), ["bx", "by", "bz"]).where("p.pid <> q.pid")
    d = pairs.selectExpr("p.pid AS pid", f"{S.distance('p.x - q.x', 'p.y - q.y', 'p.z - q.z')} AS d")
    ranked = d.withColumn("rank", F.row_number().over(Window.partitionBy("pid").orderBy("d"))).where(F.col("rank") <= neighbours)
    return ranked.groupBy("pid").agg(F.max("d").alias("pair_d"))


def estimate_lengths(p: DataFrame, domain: float, resolution: int, neighbours: int = 32, gamma: float = 1.8) -> DataFrame:
    """Smoothing lengths for particles without: gamma times the distance to the k-th neighbour of the 27 bins around.

    Of fewer neighbours the last one counts; without any, the bin's width. Rows of one id are no neighbours and get one
    length; a row with a null id or coordinate is nobody's neighbour and gets the bin's width.
    """
    w = domain / resolution
    p = stored(p.select("pid", "x", "y", "z"), "particles")
    bins = [f"CASE WHEN isnan({a}) THEN {resolution - 1} ELSE {S.bin_of(a, 0.0, w, resolution)} END AS b{a}" for a in "xyz"]
    points = p.where(" AND ".join(f"{c} IS NOT NULL" for c in p.columns)).selectExpr("pid", "x", "y", "z", *bins)
    usual = " AND ".join(f"abs({a}) <= 1e150" for a in "xyz")  # squares stay finite; NaN is more
    d = kth_distances(points.where(usual).select("x", "y", "z", "bx", "by", "bz"), neighbours)
    out = p.join(d, ["x", "y", "z"], "left").selectExpr("pid", "x", "y", "z", f"CASE WHEN pid IS NOT NULL THEN {S.num(gamma)} * d END AS h", "m")
    twice = points.groupBy("pid").count().where("count > 1").selectExpr("pid", "true AS twice")
    odd = not points.where(f"NOT ({usual})").isEmpty()
    if odd or not twice.isEmpty():
        out = out.join(twice, "pid", "left").withColumn("apart", F.expr(f"twice IS NOT NULL OR NOT ({usual}) OR {str(odd).lower()} AND m < {neighbours}"))
        out = stored(out, "lengths")
        asked = out.where("apart AND pid IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").selectExpr("pid", "x", "y", "z", *bins)
        out = out.join(_kth_by_pairs(asked, points, neighbours), "pid", "left").withColumn("h", F.expr(f"CASE WHEN apart THEN {S.num(gamma)} * pair_d ELSE h END"))
    return out.selectExpr("pid", "x", "y", "z", f"coalesce(h, {S.num(w)}) AS h")
