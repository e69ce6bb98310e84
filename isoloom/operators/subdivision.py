"""Loop subdivision of triangle meshes as joins on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoloom.operators.numbering import numbered
from isoloom.session import cut


def _total(column: str) -> str:
    return f"CAST(sum(CAST({column} AS decimal(28, 9))) AS double)"


def loop(verts: DataFrame, faces: DataFrame, iterations: int = 1) -> tuple[DataFrame, DataFrame]:
    """Split each triangle in four, `iterations` times.

    A vertex in the middle of an edge of two triangles weighs its ends 3/8 and the opposite corners 1/8;
    on other edges it is the midpoint. An old vertex with no such open edge moves by Loop's weight of its
    valence, one with two by 1/8 of each open neighbour, any other stays. New vertices are numbered after
    the old ones by (lower end, upper end).
    """
    if iterations < 0:
        raise ValueError("iterations must not be negative")
    for _ in range(iterations):
        verts, faces = _once(verts.select("vid", "x", "y", "z"), faces.select("v0", "v1", "v2"))
    return verts, faces


def _once(verts: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    sides = faces.selectExpr("inline(array(named_struct('s', v0, 't', v1, 'o', v2), named_struct('s', v1, 't', v2, 'o', v0), named_struct('s', v2, 't', v0, 'o', v1)))")
    across = sides.join(verts.withColumnRenamed("vid", "o"), "o").groupBy(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"))
    edge = across.agg(F.count("*").alias("n"), *[F.expr(_total(c)).alias(f"o{c}") for c in "xyz"])
    for end in "ab":
        edge = edge.join(verts.selectExpr(f"vid AS {end}", *[f"{c} AS {end}{c}" for c in "xyz"]), end)
    edge = cut(numbered(edge, ["a", "b"], "k"))

    top = verts.agg(F.coalesce(F.max("vid") + 1, F.lit(0)).alias("top"))
    middle = [f"CASE WHEN n = 2 THEN 0.375e0 * (a{c} + b{c}) + 0.125e0 * o{c} ELSE 0.5e0 * (a{c} + b{c}) END AS {c}" for c in "xyz"]
    new = cut(edge.join(F.broadcast(top)).selectExpr("a", "b", "CAST(k + top AS bigint) AS vid", *middle))

    both = ", ".join(f"named_struct('vid', {s}, {', '.join(f"'{c}', {t}{c}" for c in 'xyz')})" for s, t in ("ab", "ba"))
    near = edge.selectExpr("n <> 2 AS open", f"inline(array({both}))").groupBy("vid").agg(
        F.count("*").alias("valence"),
        F.expr("count_if(open)").alias("opened"),
        *[F.expr(_total(c)).alias(f"s{c}") for c in "xyz"],
        *[F.expr(_total(f"if(open, {c}, 0e0)")).alias(f"t{c}") for c in "xyz"],
    )
    bend = "(0.375e0 + 0.25e0 * cos(2e0 * pi() / valence))"
    near = near.selectExpr("*", f"(0.625e0 - {bend} * {bend}) / valence AS beta")
    moved = [f"CASE WHEN opened = 0 THEN (1e0 - valence * beta) * {c} + beta * s{c} WHEN opened = 2 THEN 0.75e0 * {c} + 0.125e0 * t{c} ELSE {c} END AS {c}" for c in "xyz"]
    old = verts.join(near, "vid", "left").selectExpr("vid", *moved)

    for i, (s, t) in enumerate(((0, 1), (1, 2), (2, 0))):
        keyed = faces.withColumn("a", F.least(f"v{s}", f"v{t}")).withColumn("b", F.greatest(f"v{s}", f"v{t}"))
        faces = keyed.join(new.select("a", "b", F.col("vid").alias(f"m{i}")), ["a", "b"]).drop("a", "b")
    quarters = ", ".join(f"named_struct('v0', {p}, 'v1', {q}, 'v2', {r})" for p, q, r in (("v0", "m0", "m2"), ("m0", "v1", "m1"), ("m2", "m1", "v2"), ("m0", "m1", "m2")))
    return cut(old.unionByName(new.select("vid", "x", "y", "z"))), cut(faces.selectExpr(f"inline(array({quarters}))"))
