"""Centroid clustering in whole numbers, with Hamerly's bounds.

Each vector keeps its cluster, an upper bound of the distance to that centroid
and one lower bound of the distance to the second-nearest. When centroids move,
the bounds are loosened by how far: the upper by its own centroid's way, the
lower by the longest way of any other. As long as the upper stays below the
lower, or below half the way to the nearest other centroid, the vector stays
where it is without a look at the others. Only vectors for which that leaves a
doubt get a full scan, in exact whole numbers, so the result is that of plain
assignment, ties included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm.common import durable

#: A component is held within these bounds, so that a squared distance of 64 components fits in 63 bits.
MOST = (1 << 27) - 1
#: Bounds are floating-point numbers: widened by more than their rounding.
SLACK = 1e-9
STATE = "id long, v array<int>, cluster int, upper double, lower double, scanned boolean"


def quantised(embeddings: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """(id, v) of the vectors with so many components, all of them finite: floor(scale * component), held within MOST."""
    whole = F.transform("embedding", lambda x: F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), F.floor(x.cast("double") * scale).cast("double"))).cast("int"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    kept = F.coalesce((F.size("embedding") == dimensions) & F.forall("embedding", finite), F.lit(False))
    return embeddings.where(kept).select(F.col("vec_id").cast("long").alias("id"), whole.alias("v"))


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to rows, from differences: sums of squares would need more bits."""
    return np.stack([((v - one) ** 2).sum(axis=1) for one in c], axis=1)


def assigned(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of each vector (the first of equals), and bounds of the distances to it and to the second-nearest."""
    d = distances(v, c)
    best = d.argmin(axis=1)
    rows = np.arange(len(v))
    upper = np.sqrt(d[rows, best].astype(float)) * (1 + SLACK)
    if len(c) == 1:
        return best, upper, np.full(len(v), 1e300)
    d[rows, best] = np.iinfo(np.int64).max
    return best, upper, np.sqrt(d.min(axis=1).astype(float)) * (1 - SLACK)


def reassigned(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Clusters and bounds after centroids moved from old to new; which vectors were scanned."""
    way = np.sqrt((((new - old).astype(float)) ** 2).sum(axis=1)) * (1 + SLACK)
    others = np.array([np.delete(way, k).max(initial=0.0) for k in range(len(way))])
    between = np.sqrt(distances(new, new).astype(float))
    np.fill_diagonal(between, np.inf)
    half = between.min(axis=1) / 2 * (1 - SLACK)
    cluster, upper, lower = cluster.copy(), (upper + way[cluster]) * (1 + SLACK), (lower - others[cluster]) - SLACK * np.abs(lower)
    far = np.maximum(lower, half[cluster])
    doubt = np.flatnonzero(~(upper < far))
    exact = ((v[doubt] - new[cluster[doubt]]) ** 2).sum(axis=1)
    upper[doubt] = np.sqrt(exact.astype(float)) * (1 + SLACK)
    doubt = doubt[~(upper[doubt] < far[doubt])]
    scanned = np.zeros(len(v), bool)
    if len(doubt):
        cluster[doubt], upper[doubt], lower[doubt] = assigned(v[doubt], new)
        scanned[doubt] = True
    return cluster, upper, lower, scanned


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def _state(batch: pa.RecordBatch, cluster, upper, lower, scanned) -> pa.RecordBatch:
    columns = [batch.column("id"), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(upper, pa.float64()), pa.array(lower, pa.float64()), pa.array(scanned, pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, ["id", "v", "cluster", "upper", "lower", "scanned"])


def _first(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, upper, lower = assigned(_matrix(batch.column("v"), centroids.shape[1]), centroids)
                yield _state(batch, cluster, upper, lower, np.ones(batch.num_rows, bool))

    return kept.mapInArrow(run, STATE)


def _next(state: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column("v"), new.shape[1])
                yield _state(batch, *reassigned(v, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower")), old, new))

    return state.mapInArrow(run, STATE)


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids as the exact floors of the means of their vectors; those of none stay. Sums are combined before the shuffle."""
    sums = [F.sum(F.col("v")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for r in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        out[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(centroids.shape[1])]
    return out


def seeds(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes; equal ids go by their components. A null id comes last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return np.array([list(r.v) for r in kept.orderBy(digest.asc_nulls_last(), "v").limit(k).collect()], np.int64)


def cluster(embeddings: DataFrame, k: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(id, v, cluster, distance, scanned) of each vector that is kept, and the centroids.

    embeddings: vec_id, embedding (array of numbers). Vectors of other lengths,
    and with null or infinite components or none that are numbers, are left out.
    With fewer vectors than k there are as many clusters as vectors; with none,
    the result is empty. Repeated rows count each; a null id is a vector like any
    other. Components beyond MOST count as MOST. Further columns are left alone.

    Each round's state is a checkpoint, so a lost executor costs no round. The
    centroids and one sum for each cluster and component are all that passes
    through the driver.
    """
    if dimensions * (2 * MOST) ** 2 >= 1 << 63:
        raise ValueError("fewer than 128 dimensions")
    kept = quantised(embeddings, dimensions, scale)
    centroids = seeds(kept, k, seed)
    if not len(centroids):
        return kept.select("id", "v", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(False).alias("scanned")), np.zeros((0, dimensions), np.int64)
    state = durable(_first(kept, centroids))
    for _ in range(rounds):
        moved = _moved(state, centroids)
        state, centroids = durable(_next(state, centroids, moved)), moved
    return state.select("id", "v", "cluster", _distance(state.sparkSession, centroids).alias("distance"), "scanned"), centroids


def _distance(spark: SparkSession, centroids: np.ndarray):
    """Of v to the centroid of its cluster."""
    all_of = F.array(*[F.array(*[F.lit(int(x)).cast("long") for x in c]) for c in centroids])
    pairs = F.zip_with("v", all_of[F.col("cluster")], lambda a, b: (a.cast("long") - b) * (a.cast("long") - b))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda s, x: s + x)


def report(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256. An inertia of more than 63 bits is null."""
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    if not digests:
        return found.select(F.col("id").alias("vec_id"), "cluster", "distance", F.col("distance").alias("cluster_inertia"), F.col("distance").alias("inertia"), F.lit("").alias("centroid_sha256"))
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(30,0)")).alias("s")).collect()}
    long = lambda x: F.lit(x if x < 1 << 63 else None).cast("long")
    by_cluster = F.array(*[long(sums.get(k, 0)) for k in range(len(digests))])
    digest = F.array(*[F.lit(d) for d in digests])
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", by_cluster[F.col("cluster")].alias("cluster_inertia"), long(sum(sums.values())).alias("inertia"), digest[F.col("cluster")].alias("centroid_sha256"))
