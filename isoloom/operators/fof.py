"""Friends-of-friends groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoloom.functions import scalar as S
from isoloom.operators.graph import connected_components
from isoloom.operators.numbering import numbered


def linking_length(p: DataFrame, factor: float, domain: float) -> float:
    """factor * cbrt(volume / n); the volume is the bounding box's, or the domain's where that is flat."""
    b = p.agg(F.count("*").alias("n"), *[F.min(a).alias(f"{a}0") for a in "xyz"], *[F.max(a).alias(f"{a}1") for a in "xyz"]).first()
    if not b["n"]:
        return 0.0
    volume = (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]) * (b["z1"] - b["z0"])
    volume = volume if volume > 0 else domain**3 if domain > 0 else 1.0
    return factor * (volume / b["n"]) ** (1 / 3)


def pairs(p: DataFrame, length: float) -> DataFrame:
    """`(a, b)`, a < b, of particles closer than `length`: an equi-join on 27 bins."""
    home = p.selectExpr("pid", "x", "y", "z", *[f"CAST(floor({a} / {S.num(length)}) AS bigint) AS b{a}" for a in "xyz"])
    near = home
    for a in "xyz":
        near = near.withColumn(f"b{a}", F.explode(F.array(*[F.col(f"b{a}") + d for d in (-1, 0, 1)])))
    d2 = "(s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) + (s.z - t.z) * (s.z - t.z)"
    return home.alias("s").join(near.alias("t"), ["bx", "by", "bz"]).where(f"s.pid < t.pid AND {d2} < {S.num(length * length)}").selectExpr("s.pid AS a", "t.pid AS b")


def cluster(p: DataFrame, length: float) -> DataFrame:
    """`(pid, group)`: groups are numbered from 0 in the order of their first particle.

    A length of 0 or less links nothing: each particle is a group of its own.
    """
    if length <= 0:
        return numbered(p.select("pid"), ["pid"], "group")
    found = connected_components(pairs(p, length))
    root = p.select("pid").join(found, F.col("pid") == F.col("node"), "left").selectExpr("pid", "coalesce(component, pid) AS root")
    first = numbered(root.select("root").distinct(), ["root"], "group")
    return root.join(first, "root").select("pid", "group")


def drop_small(p: DataFrame, labels: DataFrame, least: int) -> DataFrame:
    """Particles of groups with at least `least` members. Sizes are aggregated before they meet members."""
    if least <= 0:
        raise ValueError("the least group size must be positive")
    big = labels.groupBy("group").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    return p.join(labels.join(big.select("group"), "group"), "pid")
