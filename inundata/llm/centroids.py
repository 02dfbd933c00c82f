"""Clusters around centroids, each vector assigned by the threshold algorithm.

For every dimension the centroids' values are a sorted list. A vector walks each list outward from
its own value; every centroid that it meets is compared exactly. The sum of the squared distances
at which the walks stand bounds all centroids not met yet, and the search ends when it strictly
exceeds the best distance, so ties are all seen. Components are whole numbers and sums are exact,
which makes the result the same however the rows are dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from inundata.llm.text import cut

#: Larger components could overflow the 64-bit distance.
_LIMIT = 1 << 27
_FAR = np.iinfo(np.int64).max


@dataclass(frozen=True)
class CentroidParams:
    clusters: int = 8
    rounds: int = 10
    dim: int = 64
    scale: int = 1024
    #: Put before the id whose digest orders the first centroids.
    salt: str = "3:"
    #: Cells (vectors x centroids) that one numpy step holds, about.
    cells: int = 262_144


def scaled_vectors(vectors: DataFrame, id_col: str, vector: str, p: CentroidParams) -> DataFrame:
    """id, vec (array<int>): floor(scale * x) of vectors of the right length without odd components."""
    v = F.col("vec")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    flat = vectors.select(vectors[id_col].alias("id"), vectors[vector].cast("array<double>").alias("vec")).where(v.isNotNull() & (F.size(v) == p.dim) & ~odd)
    large = F.raise_error(F.lit("a component is too large for exact 64-bit distances"))
    whole = F.transform(v, lambda x: F.when(F.abs(x * p.scale) < _LIMIT, F.floor(x * p.scale).cast("int")).otherwise(large.cast("int")))
    return flat.select("id", whole.alias("vec"))


def first_centroids(points: DataFrame, p: CentroidParams) -> list[list[int]]:
    """The vectors of the smallest digests, in order; at most ``clusters`` rows reach the driver."""
    digest = F.sha2(F.concat(F.lit(p.salt), F.col("id").cast("string")), 256)
    return [list(r["vec"]) for r in points.select(digest.alias("digest"), "vec").orderBy(F.col("digest").asc_nulls_last(), "vec").limit(p.clusters).collect()]


class CentroidLists:
    """The centroids' values of every dimension in order, and the walks along them."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids.astype(np.int64)
        k, dim = self.centroids.shape
        self.order = np.argsort(self.centroids, axis=0, kind="stable")
        # a place beyond each end, where a walk that has left the list stands for good
        ends = np.zeros((1, dim), dtype=np.int64)
        self.values = np.concatenate([-ends, np.take_along_axis(self.centroids, self.order, axis=0), ends])
        self.k, self.dim = k, dim

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """cluster, squared distance, and how many exact comparisons it took."""
        n, k = len(x), self.k
        x = x.astype(np.int64)
        cluster, best = np.full(n, k), np.full(n, _FAR)
        seen = np.zeros((n, k), dtype=bool)
        # right: place in ``values`` of the next centroid at or above the vector's value; left: below it
        right = np.stack([np.searchsorted(self.values[1:-1, d], x[:, d], side="left") + 1 for d in range(self.dim)], axis=1)
        left, dims, active, compared = right - 1, np.arange(self.dim)[None, :], np.arange(n), 0
        while len(active):
            at, lo, hi = x[active], left[active], right[active]
            below = np.where(lo > 0, at - self.values[lo, dims], _FAR)
            above = np.where(hi <= k, self.values[hi, dims] - at, _FAR)
            down = below <= above
            place = np.where(down, lo, hi)
            met = self.order[np.clip(place, 1, k) - 1, dims]
            rows = np.repeat(active, self.dim)[(place >= 1).ravel() & (place <= k).ravel()]
            fresh = np.zeros((n, k), dtype=bool)
            fresh[rows, met[(place >= 1) & (place <= k)]] = True
            fresh &= ~seen
            seen |= fresh
            q, c = np.nonzero(fresh)
            compared += len(q)
            far = np.square(x[q] - self.centroids[c]).sum(axis=1)
            # the nearest of the fresh ones, the smaller number of equals, comes first in each vector
            ranked = np.lexsort((c, far, q))
            ranked = ranked[np.unique(q[ranked], return_index=True)[1]]
            q, c, far = q[ranked], c[ranked], far[ranked]
            better = (far < best[q]) | ((far == best[q]) & (c < cluster[q]))
            best[q[better]], cluster[q[better]] = far[better], c[better]
            left[active], right[active] = np.where(down & (lo > 0), lo - 1, lo), np.where(~down & (hi <= k), hi + 1, hi)
            lo, hi = left[active], right[active]
            below = np.where(lo > 0, at - self.values[lo, dims], _FAR)
            above = np.where(hi <= k, self.values[hi, dims] - at, _FAR)
            frontier = np.minimum(below, above)
            # where a list is at its end every centroid has been met
            done = (frontier == _FAR).any(axis=1) | seen[active].all(axis=1)
            bound = np.square(np.where(frontier == _FAR, 0, frontier)).sum(axis=1)
            active = active[~(done | (bound > best[active]))]
        return cluster, best, compared


def _assigned(batches: Iterator[pa.RecordBatch], lists: CentroidLists, p: CentroidParams):
    """Parts of the batches as (part, vectors, cluster, distance)."""
    step = max(1, p.cells // max(lists.k, lists.dim))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            x = part.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(part.num_rows, lists.dim)
            yield part, x, *lists.nearest(x)[:2]


def _moved(points: DataFrame, centroids: np.ndarray, p: CentroidParams) -> np.ndarray:
    """One round: assignment, then the exact floor of each mean; clusters without vectors stay.

    Each task adds up its own vectors; clusters x dimensions sums reach the driver.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = CentroidLists(centroids)
        total, count = np.zeros((lists.k, lists.dim), dtype=np.int64), np.zeros(lists.k, dtype=np.int64)
        for _, x, cluster, _ in _assigned(batches, lists, p):
            order = np.argsort(cluster, kind="stable")
            held, starts = np.unique(cluster[order], return_index=True)
            total[held] += np.add.reduceat(x[order], starts, axis=0)
            count += np.bincount(cluster, minlength=lists.k)
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(held, pa.int32()), "n": pa.array(count[held], pa.int64()), "total": pa.array(list(total[held]), pa.list_(pa.int64()))})

    by_task = points.select("vec").mapInArrow(sums, "cluster int, n long, total array<long>")
    wide = F.sum(F.col("x").cast("decimal(38,0)")).alias("total")
    rows = by_task.select("cluster", "n", F.posexplode("total").alias("d", "x")).groupBy("cluster", "d").agg(wide, F.sum("n").alias("n")).collect()
    new = centroids.copy()
    for r in rows:
        new[r["cluster"], r["d"]] = int(r["total"]) // r["n"]
    return new


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", p: CentroidParams = CentroidParams()) -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance; the final centroids): see ``centroid_clusters``."""
    points = cut(scaled_vectors(vectors, id_col, vector, p))
    start = first_centroids(points, p)
    centroids = np.array(start, dtype=np.int64).reshape(len(start), p.dim)
    if len(start):
        for _ in range(p.rounds):
            centroids = _moved(points, centroids, p)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = CentroidLists(centroids)
        for part, _, cluster, distance in _assigned(batches, lists, p):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=[id_col, "cluster", "distance"])

    kind = StructType([StructField(id_col, points.schema["id"].dataType), StructField("cluster", IntegerType()), StructField("distance", LongType())])
    return cut(points.mapInArrow(assign, kind)), centroids.tolist()


def centroid_clusters(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", p: CentroidParams = CentroidParams()) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row per usable vector.

    Vectors that are null, of another length, or hold null or non-finite components have no row.
    Repeated rows count each. Of equally near centroids the smaller number holds. Vectors without
    an id come last as first centroids; with fewer vectors than clusters there are as many
    centroids as vectors, and equal centroids leave the later ones empty. A component of 2^27 or
    more after scaling fails the job, as distances would overflow. Extra columns are not looked
    at. An empty table gives an empty table.
    """
    spark: SparkSession = vectors.sparkSession
    found, centroids = cluster_vectors(vectors, id_col, vector, p)
    digests = [(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids)]
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("cluster_inertia")).collect()  # one row per cluster
    total = sum(r["cluster_inertia"] for r in sums)
    inertia = {r["cluster"]: r["cluster_inertia"] for r in sums}
    table = spark.createDataFrame([(k, inertia.get(k, 0), total, digest) for k, digest in digests], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
