"""Clustering against plain loops, and the parts that the blocks rest on."""

import hashlib
import math
import random

import numpy as np
import pytest

from gridloom.llm import centroids

SCHEMA = "vec_id long, embedding array<float>"


def brute_clusters(rows, dim, k, rounds, seed=1):
    """Sorted result rows of the contract."""
    kept = [
        (i, [math.floor(64 * x) for x in v]) for i, v in rows
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)
    ]
    name = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    middle = [v for _, v in sorted((name(i), v) for i, v in kept if i is not None)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(middle))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for n, group in groups.items():
            middle[n] = [sum(column) // len(group) for column in zip(*group, strict=True)]
    found = [(i, *reversed(near(v))) for i, v in kept] if middle else []
    sums = {}
    for _, n, far in found:
        sums[n] = sums.get(n, 0) + far
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    key = lambda r: (r[0] is None, r)
    return sorted(((i, n, far, sums[n], sum(sums.values()), digest[n]) for i, n, far in found), key=key)


def sorted_rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("spread", [0.01, 1.0, 5000.0])
def test_clusters_match_plain_loops(spark, spread):
    rng = random.Random(int(spread))
    middles = [[rng.gauss(0, spread) for _ in range(6)] for _ in range(5)]
    rows = [(i, [float(np.float32(x + rng.gauss(0, spread / 5))) for x in rng.choice(middles)]) for i in range(300)]
    # Equal vectors, repeated ids and ties between centroids.
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(7, rows[9][1]), (7, rows[9][1])]
    got = centroids.clustered(centroids.whole_vectors(spark.createDataFrame(rows, SCHEMA), 6), 6, 7)
    assert sorted_rows(got) == brute_clusters(rows, 6, 7, 3)


def test_vectors_that_take_no_part(spark):
    rows = [
        (1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("-inf"), 1.0]), (6, []),
        (7, [1.0, 2.0, 3.0]), (None, [-0.01, 0.5]), (9, [-3.0, 0.5]),
    ]
    schema = "vec_id long, embedding array<float>, curve string, v int"
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], schema)
    got = centroids.clustered(centroids.whole_vectors(frame, 2), 2)
    assert sorted_rows(got) == brute_clusters(rows, 2, 16, 3) and got.count() == 3
    for none in ([], rows[1:6], rows[7:8]):
        empty = centroids.whole_vectors(spark.createDataFrame(none, SCHEMA), 2)
        assert centroids.clustered(empty, 2).count() == 0


def test_curve_visits_every_cell_by_steps_of_one():
    for dim, bits in ((2, 3), (3, 2)):
        cells = np.array(list(np.ndindex(*[1 << bits] * dim)))
        keys = centroids.curve_keys(cells, bits)
        assert len(set(keys)) == len(cells)
        path = cells[sorted(range(len(cells)), key=lambda i: keys[i])]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_boxes_leave_out_far_centroids_and_never_the_nearest():
    rng = np.random.default_rng(3)
    left_out = 0
    for _ in range(60):
        values = rng.integers(-9, 9, 4) * 20 + rng.integers(-15, 15, (30, 4))
        middle = rng.integers(-200, 200, (12, 4))
        numbers = centroids.candidates(values.min(axis=0), values.max(axis=0), middle)
        far = ((values[:, None] - middle[None]) ** 2).sum(axis=2)
        assert (numbers[far[:, numbers].argmin(axis=1)] == far.argmin(axis=1)).all()
        left_out += 12 - len(numbers)
    assert left_out > 300


def test_blocks_keep_neighbours_together(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice((-1.0, 1.0)) + rng.gauss(0, 0.01) for _ in range(3)]) for i in range(400)]
    packed = centroids.blocks(centroids.whole_vectors(spark.createDataFrame(rows, SCHEMA), 3), 3, rows=10)
    sizes = [np.prod(np.frombuffer(r.high, "<i8") - np.frombuffer(r.low, "<i8") + 1.0) for r in packed.collect()]
    assert sum(packed.toPandas().ids.map(len)) == 400
    # Eight far corners: most blocks stay within one.
    assert np.median(sizes) < 20**3


def test_sums_beyond_floating_point_are_exact(spark):
    rows = [(i, [2.0**24 + i, -(2.0**24)]) for i in range(60)]
    schema = "vec_id long, embedding array<double>"
    got = centroids.clustered(centroids.whole_vectors(spark.createDataFrame(rows, schema), 2), 2, 3)
    assert sorted_rows(got) == brute_clusters(rows, 2, 3, 3)
