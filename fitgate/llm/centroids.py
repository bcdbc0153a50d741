"""Centroid clustering in exact integers by exponion search.

Every vector carries its cluster, an upper bound of the distance to that centroid and a lower
bound of the distance to any other. After a round the bounds follow the moves of the centroids.
A vector whose upper bound stays below its lower bound, or below half of the distance from its
centroid to the nearest other, keeps its cluster unseen. Any other vector at distance u from its
centroid c looks only at the centroids within ``2u + (distance from c to its nearest other)`` of
c: its nearest and its second nearest centroid both lie in this ball. The centroids around c are
sorted by distance, so a ball is the head of a list; heads are rounded up to powers of two and
vectors with one head are measured together.

Bounds are floats, rounded outwards; they only save work. Distances, sums and means are integers,
and a centroid at just the radius of a ball is looked at, so ties go to the smaller number.

Centroids are k rows whatever the data; they travel with the task. New centroids come from the
old sums and from the vectors that changed their cluster, pre-aggregated before the shuffle.
Every round is a written table, so a lost executor costs running tasks only.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitgate.llm.common import Stages

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Largest scaled component whose squared distances over 64 dimensions fit in 64 bits.
LARGEST = 2**26
#: Relative slack of the float bounds.
_UP, _DOWN = 1 + 1e-9, 1 - 1e-9
STATE = "vec_id long, v array<int>, cluster int, before int, upper double, lower double, distance long"


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances between the rows of two integer matrices."""
    most = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if most <= 2**22:  # all sums stay below 2**53: floats are exact and BLAS is fast
        x, c = x.astype(np.float64), c.astype(np.float64)
    cross = x @ c.T
    return ((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * cross).astype(np.int64)


class Centroids:
    """k centroids with, for each, all of them sorted by their distance from it."""

    def __init__(self, points: np.ndarray):
        self.points = points
        between = np.sqrt(squared_distances(points, points).astype(np.float64))
        # among equals, a centroid itself comes first
        self.order = np.array([np.lexsort((np.arange(len(points)) != j, row)) for j, row in enumerate(between)], np.int64).reshape(len(points), -1)
        self.sorted = np.take_along_axis(between, self.order, 1)
        self.nearest = self.sorted[:, 1] if len(points) > 1 else np.full(len(points), np.inf)

    def scan(self, x: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the centroids ``among``: each vector's nearest (the smaller number among equals), its squared distance, the distance of the next."""
        among = np.sort(among)
        d = squared_distances(x, self.points[among])
        best = d.argmin(1)
        rows = np.arange(len(x))
        first = d[rows, best]
        if len(among) == 1:
            return among[best], first, np.full(len(x), np.inf)
        d[rows, best] = np.iinfo(np.int64).max
        return among[best], first, np.sqrt(d.min(1).astype(np.float64))

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Bring cluster, upper and lower up to date in place; returns how many distances were worked out."""
        safe = np.maximum(lower, self.nearest[cluster] / 2) * _DOWN
        open_ = np.flatnonzero(upper >= safe)
        own = np.zeros(len(open_), np.float64)
        for j in np.unique(cluster[open_]):
            mine = cluster[open_] == j
            own[mine] = np.sqrt(squared_distances(x[open_[mine]], self.points[j : j + 1])[:, 0].astype(np.float64))
        upper[open_] = own * _UP
        measured = len(open_)
        still = upper[open_] >= safe[open_]
        open_, own = open_[still], own[still]
        here = cluster[open_]  # as it was: it changes below
        for j in np.unique(here):
            mine = np.flatnonzero(here == j)
            radius = (2 * own[mine] + self.nearest[j]) * _UP
            heads = np.searchsorted(self.sorted[j], radius, "right")
            heads = np.minimum(2 ** np.ceil(np.log2(np.maximum(2, heads))).astype(np.int64), len(self.points))
            for m in np.unique(heads):
                at = open_[mine[heads == m]]
                number, first, second = self.scan(x[at], self.order[j, :m])
                cluster[at], upper[at], lower[at] = number, np.sqrt(first.astype(np.float64)) * _UP, second * _DOWN
                measured += len(at) * int(m)
        return measured


def moved(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each centroid moved, and how far any other did at most."""
    far = np.sqrt(((old - new).astype(np.float64) ** 2).sum(1)) * _UP
    others = np.array([np.delete(far, j).max(initial=0) for j in range(len(far))])
    return far, others


def scaled(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors of full length without NULL or non-finite components, as integers floor(scale * x)."""
    x = F.col("embedding")
    whole = (F.size(x) == dimensions) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    integers = F.transform(x, lambda e: F.floor(e.cast("double") * scale))
    fits = F.forall("v", lambda e: F.abs(e) < LARGEST)
    checked = F.when(fits, F.col("v").cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component of {LARGEST} or more: squared distances would not fit in 64 bits")))
    return vectors.select("vec_id", x).where(whole).select("vec_id", integers.alias("v")).select("vec_id", checked.alias("v"))


def first_centroids(kept: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The k vectors with the smallest hashes of their ids; k rows reach the driver."""
    ranked = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v")
    return np.array([r.v for r in ranked.limit(k).collect()], np.int64).reshape(-1, DIMENSIONS)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("v")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _round(state: DataFrame, points: np.ndarray, drift: tuple[np.ndarray, np.ndarray] | None, exact: bool) -> DataFrame:
    """State after an assignment to ``points``; drift: moves since the last one. exact: with distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Centroids(points)
        for batch in batches:
            x = _matrix(batch)
            distance = np.zeros(len(x), np.int64)
            if drift is None:
                before = np.full(len(x), -1, np.int32)
                cluster, first, lower = now.scan(x, np.arange(len(points)))
                upper, lower = np.sqrt(first.astype(np.float64)) * _UP, lower * _DOWN
            else:
                before = batch.column("cluster").to_numpy()
                cluster = before.astype(np.int64)
                upper = (batch.column("upper").to_numpy() + drift[0][cluster]) * _UP
                lower = (batch.column("lower").to_numpy() - drift[1][cluster]) * _DOWN
                now.assign(x, cluster, upper, lower)
            if exact:
                distance = ((x - points[cluster]) ** 2).sum(1)
            columns = [batch.column("vec_id"), batch.column("v"), *(pa.array(c) for c in (cluster.astype(np.int32), before, upper, lower, distance))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in STATE.split(", ")])

    return state.mapInArrow(run, STATE)


def _changes(state: DataFrame) -> list[tuple[int, int, list[int]]]:
    """(cluster, vectors more, sums more) since the last assignment; at most one row per centroid."""
    turned = state.where("cluster <> before").select("v", F.explode(F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("sign")), F.struct(F.col("before").alias("c"), F.lit(-1).alias("sign")))).alias("s"))
    sums = [F.sum(F.col("v")[i].cast("long") * F.col("s.sign")).alias(f"x{i}") for i in range(DIMENSIONS)]
    rows = turned.where("s.c >= 0").groupBy("s.c").agg(F.sum("s.sign").alias("n"), *sums).collect()
    return [(r["c"], r["n"], [r[f"x{i}"] for i in range(DIMENSIONS)]) for r in rows]


def cluster_vectors(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every kept vector.

    Kept are vectors of exactly 64 components, none NULL or non-finite, as integers floor(256 * x). The first centroids are the
    k vectors with the smallest hashes of their ids (a NULL id comes last; with equal ids, the smaller vector first); with fewer vectors than k, all of them.
    Repeated rows are vectors of their own, rows with a NULL id get a cluster like any other, an empty table gives an empty
    result, other columns are ignored. A centroid without vectors stays where it is. A component of 2**18 or more in
    size (2**26 scaled) stops the job with an error, because its squared distances do not fit in the result's 64 bits.
    """
    spark = vectors.sparkSession
    stages = Stages(spark, "centroids")
    state = stages.write(scaled(vectors), "kept")
    points = first_centroids(state, k, seed)
    if not len(points):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    counts, sums, drift = [0] * len(points), [[0] * DIMENSIONS for _ in points], None
    for turn in range(rounds):
        state = stages.write(_round(state, points, drift, exact=False), f"round{turn}")
        stages.keep(f"round{turn}")
        for c, n, more in _changes(state):
            counts[c] += n
            sums[c] = [a + b for a, b in zip(sums[c], more, strict=True)]
        new = np.array([[s // n for s in row] if n else old for n, row, old in zip(counts, sums, points.tolist(), strict=True)], np.int64)
        drift, points = moved(points, new), new
    state = stages.write(_round(state, points, drift, exact=True).select("vec_id", "cluster", "distance"), "assigned")
    stages.keep("assigned")
    inertia = {r["cluster"]: r["d"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    hashes = [sha256(",".join(map(str, p)).encode()).hexdigest() for p in points.tolist()]
    totals = spark.createDataFrame([(c, inertia.get(c, 0), sum(inertia.values()), h) for c, h in enumerate(hashes)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # one row per centroid: k rows, whatever the data
    return state.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
