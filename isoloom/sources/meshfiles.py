"""Mesh and tree files: binary STL, and Parquet tables of a mesh or tree."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoloom.operators.mesh import with_points
from isoloom.operators.numbering import numbered
from isoloom.session import cut

#: One triangle of a binary STL file: normal, three corners, attribute.
TRIANGLE = np.dtype([("normal", "<f4", 3), ("corners", "<f4", (3, 3)), ("attribute", "<u2")])


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        corners = batch.to_numpy(np.float64).reshape(-1, 3, 3)
        normal = np.cross(corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0])
        length = np.linalg.norm(normal, axis=1, keepdims=True)
        out = np.zeros(len(batch), TRIANGLE)
        out["normal"] = np.divide(normal, length, out=np.zeros_like(normal), where=length > 0)
        out["corners"] = corners
        yield pd.DataFrame({"block": [out.tobytes()], "n": [len(batch)]})


def save_stl(verts: DataFrame, faces: DataFrame, path: str | os.PathLike) -> int:
    """Write a binary STL file on the driver; returns the number of triangles.

    Executors pack triangles to bytes, the driver holds the blocks of one partition at a time. The file
    appears under its name when it is complete; on any failure nothing is left of it.
    """
    target = Path(path)
    part = target.with_name(f"{target.stem}.tmp{target.suffix}")
    at = with_points(verts, faces).select(*[f"{a}{i}" for i in range(3) for a in "xyz"])
    total = 0
    try:
        with open(part, "wb") as out:
            out.write(b"\0" * 80 + struct.pack("<I", 0))
            for row in at.mapInPandas(_packed, "block binary, n long").toLocalIterator():
                out.write(row["block"])
                total += row["n"]
            out.seek(80)
            out.write(struct.pack("<I", total))
        os.replace(part, target)
    except BaseException:
        part.unlink(missing_ok=True)
        raise
    return total


def save_obj(verts: DataFrame, faces: DataFrame, path: str | os.PathLike) -> int:
    """Write a text file of vertices `v x y z` and triangles `f i j k`, counted from 1; returns the triangles.

    Vertices are numbered anew in the order of their numbers. The file is complete or absent.
    """
    order = cut(numbered(verts.select("vid", "x", "y", "z"), ["vid"], "at"))
    at = faces
    for i in range(3):
        at = at.join(order.select(F.col("vid").alias(f"v{i}"), (F.col("at") + 1).alias(f"p{i}")), f"v{i}")
    lines = order.orderBy("at").selectExpr("concat_ws(' ', 'v', x, y, z) AS line"), at.selectExpr("concat_ws(' ', 'f', p0, p1, p2) AS line")
    target, total = Path(path), 0
    part = target.with_name(f"{target.stem}.tmp{target.suffix}")
    try:
        with open(part, "w") as out:
            for k, table in enumerate(lines):
                for row in table.toLocalIterator():
                    out.write(row["line"] + "\n")
                    total += k
        os.replace(part, target)
    except BaseException:
        part.unlink(missing_ok=True)
        raise
    return total


def save_mesh(verts: DataFrame, faces: DataFrame, path: str | os.PathLike) -> int:
    """Write by suffix: `.obj` as text, `.stl` or none as binary STL; others are an error."""
    kind = Path(path).suffix.lower()
    if kind not in ("", ".stl", ".obj"):
        raise ValueError(f"unknown mesh format: {kind}")
    return save_obj(verts, faces, path) if kind == ".obj" else save_stl(verts, faces, path)


def picture(verts: DataFrame, path: str | os.PathLike, most: int = 20_000) -> None:
    """Scatter of at most about `most` vertices from six sides, as a PNG file; an error without matplotlib."""
    try:
        from matplotlib.figure import Figure
    except ImportError as e:
        raise ValueError("a picture of vertices needs matplotlib, which is not installed") from e
    n = verts.count()
    points = (verts if n <= most else verts.sample(most / n, 1)).select("x", "y", "z").toPandas().to_numpy()
    figure = Figure(figsize=(12, 8))
    for k, (u, v, sign) in enumerate(((0, 1, 1), (0, 2, 1), (1, 2, 1), (0, 1, -1), (0, 2, -1), (1, 2, -1))):
        ax = figure.add_subplot(2, 3, k + 1)
        ax.scatter(sign * points[:, u], points[:, v], s=1)
        ax.set(xlabel="xyz"[u], ylabel="xyz"[v], aspect="equal")
    figure.savefig(path)


def read_stl(path: str | os.PathLike) -> np.ndarray:
    """Triangles of a binary STL file, (N, 3, 3)."""
    raw = Path(path).read_bytes()
    return np.frombuffer(raw, TRIANGLE, struct.unpack_from("<I", raw, 80)[0], 84)["corners"]


def save_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Write each table as Parquet below one folder, which may be on any file system that Spark writes to."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def load_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in names}
