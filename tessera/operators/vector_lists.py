"""An index of vectors by lists: each vector is in the list of its nearest centroid, a query reads the nearest few lists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import vector_scan

#: The centroids are fitted on so many vectors at most; every vector is indexed.
FITTED = 4096


def centroids(vectors: DataFrame, lists: int, fitted: int = FITTED, rounds: int = 20, key: str = "id", vector: str = "v") -> np.ndarray:
    """Spherical k-means of the `fitted` vectors with the least hash of the id; fewer centroids if there are fewer vectors.

    The sample is bounded by its number of vectors, and the same whatever the partitions.
    """
    rows = vectors.where(F.size(vector) > 0).orderBy(F.xxhash64(key), key).limit(fitted).select(vector).collect()
    x = np.array([r[0] for r in rows], dtype=float)
    if not len(x):
        return np.zeros((0, 0))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centers = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)].copy()
    for _ in range(rounds):
        nearest = (x @ centers.T).argmax(1)
        for k in range(len(centers)):
            mean = x[nearest == k].sum(0)
            if np.linalg.norm(mean) > 0:
                centers[k] = mean / np.linalg.norm(mean)
    return centers


def nearest(queries: DataFrame, vectors: DataFrame, centers: np.ndarray, probes: int, k: int, key: str = "id", vector: str = "v") -> DataFrame:
    """(a, b, cosine, rank): for each query the k nearest other vectors of the lists it reads; ties by id.

    A vector goes to one list, a query to `probes`. The vectors are scanned in blocks with the queries that read their lists, and a
    query's k best are found in each task first, so that a window holds no more than k rows of it from each. Vectors without
    numbers are in no list.
    """
    if not len(centers):
        return queries.select(F.col(key).alias("a"), F.col(key).alias("b"), F.lit(0.0).alias("cosine"), F.lit(0).alias("rank")).limit(0)
    length = centers.shape[1]
    listed = [x.where(F.size(vector) == length).select(key, F.transform(vector, lambda e: e.cast("double")).alias(vector)) for x in (queries, vectors)]
    few = vector_scan.best(*listed, k, key, vector, centers=centers, probes=probes)
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))
    return few.withColumn("rank", rank).where(F.col("rank") <= k).select("a", "b", "cosine", "rank")
