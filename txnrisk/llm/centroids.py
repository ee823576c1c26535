"""Centroid clustering with exact integer arithmetic, assignment by the threshold algorithm.

For each dimension the centroids are sorted by their value there. From a vector's own value the lists are walked outward, the
nearer side first; a centroid met for the first time gets its exact distance. The distances at the frontiers of all lists
together bound the distance of every centroid not met yet, so the walk ends when their sum strictly exceeds the best exact
distance (strictly, because a centroid at the same distance and of a smaller number wins).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from txnrisk.llm.shared import written
from txnrisk.llm.vectors import finite_vectors

#: Vectors walked at a time.
ROWS = 1024
#: Above every distance between components, and every distance.
FAR, NONE = np.int64(1) << np.int64(62), np.iinfo(np.int64).max


def whole_vectors(batch: pa.RecordBatch, scale: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and floor(scale * x) of the vectors with ``width`` known, finite components."""
    for places, wide in finite_vectors(batch.column("vector")):
        if wide.shape[1] == width:
            scaled = np.floor(scale * wide)
            # The squared distance of two such vectors stays below 2 ** 63.
            if np.abs(scaled).max(initial=0) > 2.0**30 / np.sqrt(width):
                raise OverflowError("a squared distance may not fit into 64 bits")
            return places, scaled.astype(np.int64)
    return np.empty(0, np.int64), np.empty((0, width), np.int64)


class Lists:
    """The centroids sorted in each dimension."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = np.array(centroids, np.int64)
        self.order = np.argsort(self.centroids, axis=0, kind="stable").T.copy()  # dimension, place -> centroid
        # A place on either side of each list that is never reached.
        self.values = np.pad(np.sort(self.centroids, axis=0).T, ((0, 0), (1, 1)))
        self.dimensions = np.arange(self.order.shape[0])

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid, ties to the smaller number."""
        k = len(self.centroids)
        n, dims = len(vectors), self.dimensions
        best, number = np.full(n, NONE), np.full(n, k)
        met = np.zeros((n, k), bool)
        # The last place below and the first place at or above the vector's value, in each list.
        right = (self.values[None, :, 1:-1] < vectors[:, :, None]).sum(axis=2) + 1
        left = right - 1
        walking = np.arange(n)
        for _ in range(k):
            x, lo, hi = vectors[walking], left[walking], right[walking]
            below = np.where(lo >= 1, x - self.values[dims, lo], FAR)
            above = np.where(hi <= k, self.values[dims, hi] - x, FAR)
            down = below <= above
            place = np.where(down, lo, hi)
            left[walking] -= down
            right[walking] += ~down
            found = self.order[dims, place - 1]
            fresh = np.zeros((len(walking), k), bool)
            fresh[np.arange(len(walking))[:, None], found] = True
            fresh &= ~met[walking]
            met[walking] |= fresh
            row, centroid = np.nonzero(fresh)
            exact = ((x[row] - self.centroids[centroid]) ** 2).sum(axis=1)
            at = walking[row]
            # Each vector's best of the new ones: by distance, then number.
            ranked = np.lexsort((centroid, exact, at))
            first = ranked[np.concatenate(([True], at[ranked][1:] != at[ranked][:-1]))] if len(ranked) else ranked
            nearer = (exact[first] < best[at[first]]) | ((exact[first] == best[at[first]]) & (centroid[first] < number[at[first]]))
            best[at[first[nearer]]], number[at[first[nearer]]] = exact[first[nearer]], centroid[first[nearer]]
            frontier = (np.minimum(below, above) ** 2).sum(axis=1)
            walking = walking[frontier <= best[walking]]
            if not len(walking):
                break
        return number, best

    def assigned(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.nearest(vectors[at : at + ROWS]) for at in range(0, len(vectors), ROWS)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 2


def first_centroids(rows: DataFrame, k: int, scale: int, width: int, seed: int) -> list[list[int]]:
    """The kept vectors with the smallest SHA-256 of seed and id, in this order; of rows with equal ids, by their vectors."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, wide = whole_vectors(batch, scale, width)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(places)), pa.array(list(wide), pa.list_(pa.int64()))], ["vec_id", "whole"])

    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    kept = rows.mapInArrow(keep, "vec_id long, whole array<long>")
    return [list(r["whole"]) for r in kept.withColumn("drawn", drawn).orderBy("drawn", "whole").limit(k).collect()]


def moved(rows: DataFrame, centroids: list[list[int]], scale: int, width: int) -> list[list[int]]:
    """The centroids after one round. Each task adds up its vectors, so a row per task and centroid is shuffled."""
    lists = Lists(centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), width), np.int64)
        for batch in batches:
            wide = whole_vectors(batch, scale, width)[1]
            number = lists.assigned(wide)[0]
            counts += np.bincount(number, minlength=len(centroids))
            np.add.at(sums, number, wide)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = rows.mapInArrow(add, "cluster long, n long, total array<long>")
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)])
    after = [list(c) for c in centroids]
    for r in added.collect():  # a row per centroid
        after[r["cluster"]] = [r[f"t{i}"] // r["n"] for i in range(width)]
    return after


def cluster(embeddings: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, width: int = 64, seed: int = 1, vector: str = "embedding") -> DataFrame:
    """One row per kept row of ``embeddings`` (vec_id and a vector): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors with ``width`` components, none null or non-finite, are kept; a component x counts as floor(scale * x). All
    arithmetic is exact; components so large that a squared distance could overflow 64 bits end the job with an error. The ``k``
    first centroids are kept vectors in the order of the SHA-256 of ``<seed>:<vec_id>`` (a null id counts as empty text), fewer
    if there are fewer vectors. Each round gives every vector to its nearest centroid (ties: smaller number) and moves every
    centroid that has vectors to the floor of their mean; then vectors are assigned once more. Rows repeated with the same id
    are rows of their own. Empty tables give no rows; other columns are not read.

    Only the centroids and sums pass through the driver, ``k`` rows of ``width`` numbers whatever the data.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    centroids = first_centroids(rows, k, scale, width, seed)
    if not centroids:
        return rows.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(rows, centroids, scale, width)
    lists = Lists(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, wide = whole_vectors(batch, scale, width)
            number, distance = lists.assigned(wide)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(places)), pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    assigned = written(rows.mapInArrow(assign, "vec_id long, cluster int, distance long"))
    inertia = {r["cluster"]: r["inertia"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    spelled = {c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest() for c in inertia}
    of_cluster = F.create_map(*chain.from_iterable((F.lit(c), F.lit(v).cast("long")) for c, v in inertia.items()))
    digest = F.create_map(*chain.from_iterable((F.lit(c), F.lit(v)) for c, v in spelled.items()))
    return assigned.select("vec_id", "cluster", "distance", of_cluster[F.col("cluster")].alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), digest[F.col("cluster")].alias("centroid_sha256"))
