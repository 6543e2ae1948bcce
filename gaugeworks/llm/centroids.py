"""Centroid clustering with a LAESA pivot table and exact integer distances.

Vectors become integers, ``floor(scale * x)`` per component. The table of vectors is written once, with every
vector's distances to ``PIVOTS`` fixed pivots beside it. In a round, the difference of two distances to
a pivot bounds the distance between a vector and a centroid from below. A vector visits the centroids by
rising bound and stops at the first bound beyond the best distance found; those visited get exact integer
distances. Bounds are lowered by more than the rounding of their square roots, so that no nearest centroid
and no tie is lost.

A round reads the table once. Each task adds up its vectors by cluster, and the sums of the tasks meet per
cluster and component; ``k`` times ``length`` sums are all that reaches the driver. Pivots are picked from
the ``SAMPLE`` vectors that come first by the hash that orders the seeds, each farthest from those before it.

Defined cases: vectors that are null, of another length, or hold null or non-finite components take no part;
scaled components beyond ``most_component(length)`` (134,217,728 for 64 components) count as that, which keeps
squared distances within 63 bits; a row with a null id is clustered, but is a seed only after all others;
equal rows are clustered each, and may be seeds each; rows of equal hash are seeds by their components;
with fewer vectors than ``k`` there are as many centroids as vectors; an empty table gives an empty
result; inertias beyond 63 bits are given as 2^63 - 1. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.components import stored

PIVOTS = 8
SAMPLE = 256
# Rows whose bounds are held at once.
SLICE = 4096
# Relative error allowed for a square root, far above that of doubles.
ERROR = 1e-12
MOST_LONG = (1 << 63) - 1


def most_component(length: int) -> int:
    """Largest component whose squared distances, summed over ``length`` components, fit in 63 bits."""
    return isqrt((1 << 62) // max(length, 1)) // 2


def _matrix(column: pa.Array, length: int, kind: type) -> np.ndarray:
    return np.asarray(column.flatten(), kind).reshape(-1, length)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances between rows of ``x`` and of ``y``, which are as many or one."""
    apart = x - y
    return np.einsum("ij,ij->i", apart, apart)


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([_distances(x, p) for p in pivots], 1).astype(float)) if len(pivots) else np.zeros((len(x), 0))


def _scaled(length: int, scale: float):
    most = most_component(length)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            batch = batch.filter(pc.equal(pc.list_value_length(batch.column("vector")), length))
            flat = batch.column("vector").flatten().cast(pa.float64())
            values = np.asarray(flat.fill_null(np.nan)).reshape(-1, length)
            whole = np.isfinite(values).all(1)
            with np.errstate(over="ignore"):
                numbers = np.clip(np.floor(values[whole] * scale), -most, most).astype(np.int32 if most < 1 << 31 else np.int64)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(numbers) + 1, dtype=np.int32) * length), pa.array(numbers.ravel().astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(whole)), rows], names=["id", "numbers"])

    return run


def _with_pivots(pivots: np.ndarray, length: int):
    def run(batches):
        for batch in batches:
            far = _to_pivots(_matrix(batch.column("numbers"), length, np.int64), pivots)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(far) + 1, dtype=np.int32) * len(pivots)), pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("numbers"), rows], names=["id", "numbers", "to_pivots"])

    return run


def spread_out(points: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` of the points: the first, then always the farthest from those chosen."""
    chosen: list[int] = []
    near = np.full(len(points), np.iinfo(np.int64).max)
    while len(chosen) < count and len(points) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(points, points[chosen[-1]]))
    return points[chosen]


@dataclass
class Centroids:
    points: np.ndarray
    to_pivots: np.ndarray

    def nearest(self, x: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid, squared distance and number of exact distances computed, of every row."""
        bound = np.zeros((len(x), len(self.points)))
        for p in range(far.shape[1]):
            mine, theirs = far[:, p, None], self.to_pivots[None, :, p]
            np.maximum(bound, np.abs(mine - theirs) - ERROR * (mine + theirs), out=bound)
        order = np.argsort(bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, order, 1) ** 2
        which = order[:, 0].copy()
        best = _distances(x, self.points[which])
        counted = np.ones(len(x), np.int32)
        alive = np.arange(len(x))
        for place in range(1, len(self.points)):
            alive = alive[bound[alive, place] <= best[alive] * (1 + ERROR)]
            if not len(alive):
                break
            other = order[alive, place]
            distance = _distances(x[alive], self.points[other])
            counted[alive] += 1
            closer = (distance < best[alive]) | ((distance == best[alive]) & (other < which[alive]))
            best[alive[closer]], which[alive[closer]] = distance[closer], other[closer]
        return which, best, counted


def _slices(batches: Iterator[pa.RecordBatch], centroids: Centroids, length: int):
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            part = batch.slice(start, SLICE)
            x = _matrix(part.column("numbers"), length, np.int64)
            yield part, x, *centroids.nearest(x, _matrix(part.column("to_pivots"), centroids.to_pivots.shape[1], float) if centroids.to_pivots.shape[1] else np.zeros((len(x), 0)))


def _sums(centroids: Centroids, length: int):
    """Per task one row for every cluster that has vectors in it."""

    def run(batches):
        count = np.zeros(len(centroids.points), np.int64)
        total = np.zeros((len(centroids.points), length), np.int64)
        for _, x, which, _, _ in _slices(batches, centroids, length):
            order = np.argsort(which, kind="stable")
            heads = np.flatnonzero(np.diff(which[order], prepend=-1))
            total[which[order][heads]] += np.add.reduceat(x[order], heads, axis=0)
            count += np.bincount(which, minlength=len(count))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"],
        )

    return run


def _assigned(centroids: Centroids, length: int):
    def run(batches):
        for part, _, which, best, counted in _slices(batches, centroids, length):
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(which.astype(np.int32)), pa.array(best), pa.array(counted)], names=["id", "cluster", "distance", "n_exact"],
            )

    return run


def _moved(vectors: DataFrame, centroids: Centroids, pivots: np.ndarray, length: int) -> Centroids:
    """Centroids at the floored means of their vectors; those without vectors stay."""
    sums = vectors.mapInArrow(_sums(centroids, length), "cluster int, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("place", "total"))
    whole = lambda name: F.sum(F.col(name).cast("decimal(38,0)")).alias(name)
    points = centroids.points.copy()
    for row in sums.groupBy("cluster", "place").agg(whole("n"), whole("total")).collect():
        points[row.cluster, row.place] = int(row.total) // int(row.n)
    return Centroids(points, _to_pivots(points, pivots))


def cluster(
    rows: DataFrame, k: int = 16, rounds: int = 3, length: int = 64, scale: float = 64, seed: str = "1:", pivots: int = PIVOTS, id: str = "vec_id", vector: str = "embedding",
) -> tuple[DataFrame, Centroids]:
    """Assignments after ``rounds`` rounds, and the final centroids.

    Assignments are ``id``, ``cluster``, ``distance`` (squared) and ``n_exact``, the number of exact distances of
    the last search. Centroids start as the vectors with the smallest SHA-256 of ``seed`` followed by the id.
    """
    slim = rows.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vector")).filter("vector IS NOT NULL")
    numbers = stored(slim.mapInArrow(_scaled(length, scale), "id long, numbers array<long>"), "numbers")
    hashed = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    first = numbers.orderBy(hashed.asc_nulls_last(), "numbers").limit(max(k, SAMPLE)).select("numbers").collect()
    sample = np.array([r.numbers for r in first], np.int64).reshape(-1, length)
    fixed = spread_out(sample, pivots)
    vectors = stored(numbers.mapInArrow(_with_pivots(fixed, length), "id long, numbers array<long>, to_pivots array<double>"), "vectors")
    centroids = Centroids(sample[:k], _to_pivots(sample[:k], fixed))
    for _ in range(rounds if len(sample) else 0):
        centroids = _moved(vectors, centroids, fixed, length)
    return stored(vectors.mapInArrow(_assigned(centroids, length), "id long, cluster int, distance long, n_exact int"), "assigned"), centroids


def described(assigned: DataFrame, centroids: Centroids) -> DataFrame:
    """``assigned`` with its cluster's and the whole inertia and a digest of the cluster's centroid."""
    sums = dict(assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())
    own = [min(int(sums.get(c, 0)), MOST_LONG) for c in range(len(centroids.points))] or [0]
    digests = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in centroids.points.tolist()] or [""]
    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)
    return assigned.select(
        "*", at(own).cast("long").alias("cluster_inertia"), F.lit(min(int(sum(sums.values())), MOST_LONG)).cast("long").alias("inertia"), at(digests).alias("centroid_sha256"),
    )
