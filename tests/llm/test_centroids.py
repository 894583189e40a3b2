import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirlog.llm import centroids

SCHEMA = "vec_id bigint, embedding array<double>"


def brute(rows, k, rounds, width, scale=1024):
    kept = [
        (i, [math.floor(scale * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)
    ]
    key = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(kept, key=key)[:k]]

    def assign():
        far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
        return [min((far(v, c), n) for n, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centres)):
            mine = [v for (_, v), (_, c) in zip(kept, found) if c == n]
            if mine:
                centres[n] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted(((i is None, i), c, d) for (i, _), (d, c) in zip(kept, assign())), centres


def run(spark, rows, k, rounds, width):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cluster", F.lit("clash")).withColumn("point", F.lit("clash"))
    labels, centres = centroids.cluster_vectors(df, k, rounds, width=width)
    return sorted(((r[0] is None, r[0]), r[1], r[2]) for r in labels.collect()), centres


def vectors(n, width, seed=1):
    draw = random.Random(seed)
    around = [[draw.uniform(-1, 1) for _ in range(width)] for _ in range(6)]
    return [(i, [x + draw.gauss(0, 0.1) for x in draw.choice(around)]) for i in range(n)]


@pytest.mark.parametrize("rounds", [0, 1, 10])
def test_like_brute_force(spark, rounds):
    rows = vectors(150, 5)
    rows += [rows[3], (4, rows[9][1]), (None, rows[5][1]), (None, [0.0] * 5), (200, None), (201, [1.0] * 4), (202, [])]
    rows += [(203, [math.nan] * 5), (204, [math.inf, 0.0, 0.0, 0.0, 0.0]), (205, [None, 1.0, 1.0, 1.0, 1.0])]
    assert run(spark, rows, 4, rounds, 5) == brute(rows, 4, rounds, 5)


def test_ties_and_copies(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(40)] + [(100 + i, [0.5, 0.0]) for i in range(7)]
    assert run(spark, rows, 5, 6, 2) == brute(rows, 5, 6, 2)


def test_components_beyond_64_bits_squared(spark):
    big = 2.0**40
    rows = [(i, [big + i % 3, -big + i]) for i in range(30)]
    assert run(spark, rows, 3, 5, 2) == brute(rows, 3, 5, 2)


def test_fewer_vectors_and_none(spark):
    rows = vectors(3, 4)
    assert run(spark, rows, 8, 4, 4) == brute(rows, 8, 4, 4)
    assert run(spark, [(1, None)], 8, 4, 4) == ([], [])


def test_sums_and_hashes(spark):
    rows = vectors(60, 4, seed=3)
    df = spark.createDataFrame(rows, SCHEMA)
    found = centroids.with_inertia(*centroids.cluster_vectors(df, 4, 3, width=4)).collect()
    expected, centres = brute(rows, 4, 3, 4)
    assert len(found) == 60
    for r in found:
        assert r["inertia"] == sum(d for _, _, d in expected)
        assert r["cluster_inertia"] == sum(d for _, c, d in expected if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centres[r["cluster"]])).encode()).hexdigest()


def test_bounds_spare_distances():
    rows = np.array([v for _, v in vectors(400, 8)]) * 1024
    points = np.floor(rows).astype(np.int64)
    centres = points[:6]
    roots = centroids._roots(points, centres)
    cluster, distance, made = centroids.nearest(points, roots, centres, centroids._roots(centres, centres))
    every = np.stack([centroids.squared(points, c) for c in centres], axis=1)
    assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert made < every.size / 2
