"""Smoothing lengths from neighbours: odd tables against the query's SQL, clustered ones against brute force."""

import threading

import duckdb
import numpy as np
import pandas as pd
import pytest

from isoloom.operators import nearest
from isoloom.plans import catalog
from isoloom.sources import particles as P


def by_brute_force(p: np.ndarray, w: float, resolution: int, which, k: int = 32) -> np.ndarray:
    b = np.clip(np.floor(p / w), 0, resolution - 1)
    out = []
    for i in which:
        near = (np.abs(b - b[i]) <= 1).all(1)
        near[i] = False
        d = np.sort(np.sqrt(((p[near] - p[i]) ** 2).sum(1)))[:k]
        out.append(1.8 * d[-1] if len(d) else w)
    return np.array(out)


def lengths(spark, p: np.ndarray, w: float, resolution: int) -> np.ndarray:
    frame = pd.DataFrame({"pid": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})
    got = P.estimate_lengths(spark.createDataFrame(frame), w * resolution, resolution).toPandas()
    assert len(got) == len(p)
    return got.sort_values("pid")["h"].to_numpy()


def as_in_sql(spark, folder, rows) -> list[tuple]:
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(folder / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    order = lambda rows: sorted((repr(tuple(r)) for r in rows))
    got, want = catalog.queries()["src3_lengths"](spark, str(folder)).collect(), con.execute(catalog.oracle_sql()["src3_lengths"]).fetchall()
    assert order(got) == order(want)
    return got


def test_odd_rows_are_as_in_sql(spark, tmp_path):
    rng = np.random.default_rng(3)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(v) for v in rng.normal(0, 0.1, 3)], 1) for i in range(60)]
    rows += [(100 + i, [0.25, 0.25, -0.5], 1) for i in range(40)]  # more copies than neighbours
    rows += [(200 + i, [5.0 + i, 0.0, -0.0], None) for i in range(3)] + [(210, [-0.9, -0.9, 0.9], 0), (211, [-9.0, -0.9, 0.9], 0)]  # beyond the box, and alone
    rows += [(7, [0.0, 0.1, 0.0], 1), (7, [0.0, 0.1, 0.0], 1), (None, [0.0, 0.0, 0.0], 1), (None, [0.1, 0.0, 0.0], 1)]
    rows += [(300, [nan, 0.9, 0.9], 1), (301, [0.9, nan, 0.9], 1), (302, [None, -0.9, -0.9], 1), (303, None, 1), (304, [-0.9, -0.9, -0.9], 1), (305, [0.9, 0.9, 0.9], 1), (306, [inf, 0.0, 0.9], 1)]
    got = as_in_sql(spark, tmp_path, rows)
    assert {r["h"] for r in got if r["pid"] is not None and 100 <= r["pid"] < 140} == {0.0}


def test_no_rows_and_one_row(spark, tmp_path):
    for i, rows in enumerate(([], [(1, [0.0, 0.0, 0.0], 1)])):
        as_in_sql(spark, tmp_path / str(i), rows)


@pytest.mark.parametrize("kind", ["ball", "cluster", "lattice", "copies", "sparse"])
def test_leaves_ask_each_other(spark, monkeypatch, kind):
    monkeypatch.setattr(nearest, "LEAF", 64)
    rng = np.random.default_rng(5)
    p = {
        "ball": lambda: rng.normal(2, 0.3, (3000, 3)),
        "cluster": lambda: np.concatenate([rng.uniform(1, 3, (1500, 3)), 2 + rng.normal(0, 1e-7, (1500, 3)), 1.2 + rng.normal(0, 1e-3, (500, 3))]),
        "lattice": lambda: np.stack(np.meshgrid(*[np.arange(14) / 8] * 3), -1).reshape(-1, 3),
        "copies": lambda: np.repeat(rng.uniform(0, 2, (600, 3)), rng.integers(1, 12, 600), axis=0),
        "sparse": lambda: rng.uniform(-1, 5, (2000, 3)),
    }[kind]()
    w, resolution = (0.25, 16) if kind == "sparse" else (0.5, 8)
    assert np.array_equal(lengths(spark, p, w, resolution), by_brute_force(p, w, resolution, range(len(p))))


def test_a_full_bin_does_not_list_its_pairs(spark):
    """Some 1.6 billion pairs, which were listed and sorted before."""
    p = np.random.default_rng(7).uniform(1.0, 1.5, (40_000, 3))
    late = threading.Timer(120, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        h = lengths(spark, p, 0.5, 8)
    finally:
        late.cancel()
    which = range(0, len(p), 199)
    assert np.array_equal(h[which], by_brute_force(p, 0.5, 8, which))
