"""Centroid clustering whose distance bounds are kept by the geometry of the moves.

Lloyd's rounds on integer vectors: every vector goes to the nearest centroid (squared Euclidean distance, ties to the
smaller number), then every non-empty centroid becomes the componentwise floor of its vectors' mean. Distances, sums
and means are exact integers.

A vector carries an upper bound of its distance to its own centroid and a lower bound of the distance to any other.
After the centroids have moved, the lower bound need not fall by the whole drift of another centroid: all vectors of a
cluster lie in a sphere about the cluster's centroid, and for a centroid that moves from F to G over a drift p, the
distance of a point x falls by |x - F| - |x - G| <= p * cos(t), t being the angle at the middle of F and G between x
and the direction of the move. Centroid, F and G span a plane; in it the sphere is a disc, seen from the middle under
an angle of asin(r / distance) to either side. So the bound falls by at most p * cos of the smallest angle, and by
nothing if the whole sphere lies behind. The loosening of a cluster is the largest over the other centroids.

Vectors whose upper bound is below the lower one (or below half the gap to the next centroid) keep their centroid
without a distance; for others the own distance is worked out; those that are still ambiguous are scanned exactly.

A round is one pass that writes the vectors with their bounds and one that adds up sums by task. The driver sees the
centroids only: k rows of sums, whatever the input.

Nulls and ties: ``grid`` says what takes part. Starts are the k vectors with the smallest hash of their id (ties by
the vector); a row without an id is no start. Fewer than k vectors: as many centroids. None: no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.llm.textops import map_batches
from strataweave.scratch import Scratch

LIMIT = 1 << 27  # components beyond are held at it: squares of 64 differences then fit into a long
SLACK = 1e-9  # relative and absolute, far above the error of a square root
STATE = "vec_id long, v array<int>, cluster int, upper double, lower double"


def grid(vector: Column, scale: int, limit: int = LIMIT) -> Column:
    """floor(scale * x) of every component as integers, or null if the vector or a component is null or not finite."""
    x = F.transform(vector, lambda c: c.cast("double"))
    whole = F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(c))
    held = F.transform(
        x, lambda c: F.greatest(F.least(F.floor(c * F.lit(float(scale))), F.lit(limit)), F.lit(-limit)).cast("int")
    )
    return F.when(whole, held)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """By how much the lower bounds of each cluster fall at most when the centroids move from ``old`` to ``new``.

    ``radius`` of a cluster: all its vectors lie within it of the old centroid.
    """
    k = len(old)
    out = np.zeros(k)
    old, new = old.astype(np.float64), new.astype(np.float64)
    for j in range(k):
        move = new[j] - old[j]
        drift = float(np.sqrt(move @ move))
        if not drift:
            continue
        middle = (old[j] + new[j]) / 2
        for i in range(k):
            if i == j:
                continue
            line = old[i] - middle
            far = float(np.sqrt(line @ line))
            fall = drift
            if far > radius[i]:
                angle = math.acos(max(-1.0, min(1.0, float(line @ move) / (far * drift))))
                angle = max(0.0, angle - math.asin(radius[i] / far))
                fall = drift * max(0.0, math.cos(angle))
            out[i] = max(out[i], fall * (1 + SLACK) + SLACK)
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim).astype(np.int64)


def squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances to one centroid, or row by row to as many."""
    apart = vectors - centroid
    return (apart * apart).sum(axis=1)


def scan(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, distance to it, distance to the next nearest) of every vector."""
    apart = np.stack([squared(vectors, c) for c in centroids], axis=1)
    nearest = apart.argmin(axis=1)
    rows = np.arange(len(vectors))
    upper = np.sqrt(apart[rows, nearest].astype(np.float64))
    rest = apart.astype(np.float64)
    rest[rows, nearest] = np.inf
    return nearest, upper, np.sqrt(rest.min(axis=1))


def reassign(
    vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray,
    centroids: np.ndarray, drift: np.ndarray, loosen: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New (cluster, upper, lower) after the centroids moved, and how many vectors were scanned."""
    if len(centroids) > 1:
        gaps = np.array([np.sqrt(squared(centroids, c).astype(np.float64)) for c in centroids])
        np.fill_diagonal(gaps, np.inf)
        half = gaps.min(axis=1) / 2
    else:
        half = np.full(1, np.inf)
    upper = upper + drift[cluster]
    lower = lower - loosen[cluster]
    bound = np.maximum(lower, half[cluster])
    close = np.flatnonzero(upper * (1 + SLACK) + SLACK >= bound)
    if len(close):
        upper[close] = np.sqrt(squared(vectors[close], centroids[cluster[close]]).astype(np.float64))
        close = close[upper[close] * (1 + SLACK) + SLACK >= bound[close]]
    if len(close):
        cluster[close], upper[close], lower[close] = scan(vectors[close], centroids)
    return cluster, upper, lower, len(close)


def _pass(state: DataFrame, centroids: np.ndarray, drift: np.ndarray | None, loosen: np.ndarray | None) -> DataFrame:
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column(1), dim)
            if drift is None:
                cluster, upper, lower = scan(vectors, centroids)
            else:
                kept = [np.array(batch.column(i)) for i in (2, 3, 4)]
                cluster, upper, lower, _ = reassign(vectors, *kept, centroids, drift, loosen)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower)],
                ["vec_id", "v", "cluster", "upper", "lower"],
            )

    return map_batches(state, run, STATE)


def _sums(state: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Sizes, radii and component sums of the clusters, added up by task and then by cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, radius, sums = np.zeros(k, np.int64), np.zeros(k), np.zeros((k, dim), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, cluster, upper = _matrix(batch.column(0), dim), np.array(batch.column(1)), np.array(batch.column(2))
            size += np.bincount(cluster, minlength=k)
            np.maximum.at(radius, cluster, upper)
            for c in np.unique(cluster):
                sums[c] += vectors[cluster == c].sum(axis=0)
        some = np.flatnonzero(size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(size[some]), pa.array(radius[some]),
             pa.array(sums[some].tolist(), pa.list_(pa.int64()))],
            ["cluster", "size", "radius", "sums"],
        )

    parts = map_batches(state.select("v", "cluster", "upper"), run, "cluster int, size long, radius double, sums array<long>")
    total = parts.groupBy("cluster").agg(
        F.sum("size").alias("size"), F.max("radius").alias("radius"),
        F.array(*[F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).cast("string") for i in range(dim)]).alias("sums"),
    )
    size, radius, sums = np.zeros(k, np.int64), np.zeros(k), [[0] * dim for _ in range(k)]
    for r in total.collect():  # at most k rows
        size[r.cluster], radius[r.cluster], sums[r.cluster] = r["size"], r.radius, [int(x) for x in r.sums]
    return size, radius, sums


def kmeans(vectors: DataFrame, k: int, rounds: int, seed: int, dim: int) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per row of ``vectors(vec_id, v)``.

    ``v`` holds ``dim`` integers. Start number 0, 1, .. are the vectors with the smallest sha256 of ``seed:vec_id``.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "llm-kmeans")
    base = scratch.save(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "v"))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = base.where("vec_id IS NOT NULL").orderBy(name, "v").limit(k).collect()
    none = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not starts:
        return spark.createDataFrame([], none)
    centroids = np.array([r.v for r in starts], np.int64)
    k = len(centroids)
    state, drift, loosen = base, None, None
    for number in range(rounds + 1):
        state = scratch.save(_pass(state, centroids, drift, loosen), replaces=state)
        if number == rounds:
            break
        size, radius, sums = _sums(state, k, dim)
        moved = np.array(
            [[s // int(n) for s in total] if n else list(c) for total, n, c in zip(sums, size, centroids.tolist())], np.int64
        )
        drift = np.sqrt(squared(moved, centroids).astype(np.float64)) * (1 + SLACK)
        loosen = loosening(centroids, moved, radius * (1 + SLACK) + SLACK)
        centroids = moved

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = centroids[np.array(batch.column(2))]
                apart = squared(_matrix(batch.column(1), dim), own)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(apart)], ["vec_id", "cluster", "distance"]
                )

    found = scratch.save(map_batches(state.select("vec_id", "v", "cluster"), exact, "vec_id long, cluster int, distance long"))
    inertia = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    every = sum(inertia.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame(
        [(c, s, every, digest[c]) for c, s in inertia.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return found.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
