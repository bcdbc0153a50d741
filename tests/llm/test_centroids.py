"""Clustering against a plain version, ties and odd rows included."""

import hashlib
import math
import random

import numpy as np
import pytest

from fitgate.llm import centroids


def brute(rows, k=centroids.CLUSTERS, rounds=centroids.ROUNDS):
    kept = [(i, tuple(math.floor(256 * float(x)) for x in e)) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    points = [v for _, v in first[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, p)), c) for c, p in enumerate(points))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        points = [tuple(sum(x) // len(groups[c]) for x in zip(*groups[c])) if c in groups else p for c, p in enumerate(points)]
    last = [(i, *nearest(v)) for i, v in kept]
    total = {}
    for _, d, c in last:
        total[c] = total.get(c, 0) + d
    sha = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return sorted(((i, c, d, total[c], sum(total.values()), sha[c]) for i, d, c in last), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, e, 1, "x") for i, e in rows], "vec_id long, embedding array<double>, cluster int, distance string").repartition(3)


@pytest.mark.parametrize(("n", "grid"), [(400, 0), (300, 2), (25, 0)])
def test_clusters(spark, n, grid):
    """Free vectors, vectors on a coarse grid (equal distances everywhere), fewer vectors than centroids."""
    rng = random.Random(n)
    draw = lambda: [rng.randrange(grid) / 256 if grid and k > 4 else 0.0 if grid and k > 9 else rng.gauss(0, 0.2) if not grid else rng.randrange(3) / 256 for k in range(64)]
    rows = [(i, draw()) for i in range(n)]
    rows += [(5, rows[5][1])] * 3 + [(7, rows[9][1]), (None, rows[3][1]), (None, None), (900, None), (901, []), (902, rows[0][1][:63]), (903, rows[0][1] + [0.1])]
    rows += [(904, [float("nan"), *rows[0][1][1:]]), (905, [float("inf"), *rows[0][1][1:]]), (906, [None, *rows[0][1][1:]]), (907, [-0.0, 1e-12, -1e-12, *rows[0][1][3:]])]
    got = sorted((tuple(r) for r in centroids.cluster_vectors(table(spark, rows)).collect()), key=repr)
    assert got == brute(rows)


def test_most_equal(spark):
    """One vector makes up most of the table: many of the first centroids are one point, and all but one stay empty."""
    same = [0.25] * 64
    rows = [(i, same) for i in range(200)] + [(500 + i, [i / 64] + same[1:]) for i in range(40)]
    got = sorted((tuple(r) for r in centroids.cluster_vectors(table(spark, rows)).collect()), key=repr)
    assert got == brute(rows)


def test_empty_and_too_large(spark):
    assert centroids.cluster_vectors(table(spark, [])).collect() == []
    assert centroids.cluster_vectors(table(spark, [(1, None)])).collect() == []
    with pytest.raises(Exception, match="64 bits"):
        centroids.cluster_vectors(table(spark, [(1, [1e9] * 64)])).collect()


def test_scan_is_spared():
    """Later rounds work out far fewer distances than all pairs, and large integers stay exact."""
    rng = np.random.default_rng(3)
    home = rng.integers(-2000, 2000, (40, 64))
    x = home[rng.integers(0, 40, 5000)] + rng.integers(-300, 300, (5000, 64))
    now = centroids.Centroids(home)
    cluster, first, lower = now.scan(x, np.arange(40))
    upper = np.sqrt(first.astype(float)) * 1.000001
    assert now.assign(x, cluster.copy(), upper, lower * 0.999999) < 5000 * 3
    big = np.array([[2**26 - 1, -(2**26) + 1]])
    assert centroids.squared_distances(big, -big).tolist() == [[8 * (2**26 - 1) ** 2]]
