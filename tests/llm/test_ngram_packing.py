"""The n-gram join's parity sketches never exclude a link; packed numbers come back."""

import numpy as np

from isoloom.llm.ngram_join import SKETCH, parity_sketch, planes, unplanes


def test_sketch_distance_is_at_most_the_symmetric_difference():
    rng = np.random.default_rng(5)
    for n in (0, 1, 3, 40, 300, 5000):
        for keep in (0.0, 0.5, 0.86, 1.0):
            x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            y = np.unique(np.concatenate([x[: int(keep * len(x))], rng.integers(0, 1 << 63, n - int(keep * n), dtype=np.uint64)]))
            a, b = parity_sketch(x), parity_sketch(y)
            while len(a) != len(b):  # fold the longer
                a, b = (a[: len(a) // 2] ^ a[len(a) // 2 :], b) if len(a) > len(b) else (a, b[: len(b) // 2] ^ b[len(b) // 2 :])
            assert sum(int(v).bit_count() for v in (a ^ b).view(np.uint64)) <= len(np.setxor1d(x, y))
            assert len(a) >= SKETCH and 64 * len(parity_sketch(x)) >= len(x)


def test_planes_round_trip():
    for kind in (np.int64, np.int32):
        for values in ([], [0], [-7, 3, 2**31 - 1, 0], list(range(-50, 300))):
            v = np.array(values, kind)
            assert unplanes(planes(v), kind).tolist() == values
