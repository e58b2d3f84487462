"""Clusters of vectors: centroids, assignment, borders, and the candidates for a new vector.

Vectors are rows (uri, embedding); clusters rows (uri, cluster).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.vectors import cosine, vector


def kmeans(vectors: DataFrame, k: int = 3, seed: int = 42, first: int = 0) -> DataFrame:
    """(uri, cluster): k-means with as many clusters as there are rows at most, numbered from `first`."""
    n = vectors.limit(k).count()
    if n < 2:
        return vectors.select("uri", F.lit(first).alias("cluster"))
    features = vectors.select("uri", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=n, seed=seed).fit(features)
    return model.transform(features).select("uri", (F.col("prediction") + first).alias("cluster"))


def hybrid(vectors: DataFrame, communities: DataFrame | None = None, k: int = 3, seed: int = 42) -> DataFrame:
    """k-means inside each community (uri, community), cluster ids ten apart. Without communities all rows are one."""
    if communities is None:
        return kmeans(vectors, k, seed)
    ids = [r[0] for r in communities.select("community").distinct().orderBy("community").collect()]  # one model is fitted for each
    parts = [kmeans(vectors.join(communities.where(F.col("community") == c), "uri", "left_semi"), k, seed, 10 * i) for i, c in enumerate(ids)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def centroids(vectors: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, centroid): the mean vector. Positions are averaged apart, with partial sums before the shuffle."""
    at = vectors.join(clusters, "uri").select("cluster", F.posexplode("embedding").alias("pos", "x"))
    means = at.groupBy("cluster", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("centroid"))


def assign(vector_: Sequence[float], means: DataFrame) -> DataFrame:
    """One row: the cluster whose centroid is nearest by cosine, the least of several; -1 without centroids."""
    near = F.max_by("cluster", F.struct(cosine(F.col("centroid"), vector(vector_)), -F.col("cluster")))
    return means.agg(F.coalesce(near, F.lit(-1)).cast("int").alias("cluster"))


def borders(vectors: DataFrame, clusters: DataFrame, means: DataFrame, top: int = 3) -> DataFrame:
    """(cluster, rank, uri, other, similarity): the members least similar to other clusters' centroids.

    It ranks pairs of member and centroid, so a member may stand there more than once.
    """
    others = means.select(F.col("cluster").alias("other"), "centroid")
    # centroids: one row for each cluster
    paired = vectors.join(clusters, "uri").join(F.broadcast(others), F.col("cluster") != F.col("other"))
    scored = paired.select("cluster", "uri", "other", cosine(F.col("embedding"), F.col("centroid")).alias("similarity"))
    order = Window.partitionBy("cluster").orderBy("similarity", "uri", "other")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("cluster", "rank", "uri", "other", "similarity")


def candidates(vector_: Sequence[float], vectors: DataFrame, clusters: DataFrame, border: DataFrame, cluster: int, top_k: int = 10, exclude: str | None = None) -> DataFrame:
    """(uri, similarity): the nearest of the vector's own cluster and of the other clusters' borders; of all if the cluster is -1.

    Only these are scored by the dear model, as a border node that stands there twice is a candidate twice.
    """
    if cluster == -1:
        pool = vectors
    else:
        own = clusters.where(F.col("cluster") == cluster).select("uri")
        pool = vectors.join(own.unionByName(border.where(F.col("cluster") != cluster).select("uri")), "uri")
    if exclude:
        pool = pool.where(F.col("uri") != exclude)
    return pool.select("uri", cosine(F.col("embedding"), vector(vector_)).alias("similarity")).orderBy(F.desc("similarity"), "uri").limit(top_k)


def nearest(vectors: DataFrame, query: Sequence[float], top_k: int = 10) -> DataFrame:
    """(uri, similarity): pure vector search."""
    return vectors.select("uri", cosine(F.col("embedding"), vector(query)).alias("similarity")).orderBy(F.desc("similarity"), "uri").limit(top_k)
