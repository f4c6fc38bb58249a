"""K-means, assignment, reduction. Grouped Lloyd runs all periods in one job; single fits are pyspark.ml's."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifdrift.functions.columns import squared_distance
from motifdrift.sources.scratch import new_path

#: Centroids that go to every task at most; beyond, points meet them by shuffle on the period.
BROADCAST_CENTROIDS = 20_000
SALTS = 64
#: Fits of single periods that run side by side.
FITS = 4


def centroid_table(points: DataFrame, keys: list[str], places: int | None = None) -> DataFrame:
    """keys, features: the mean of the members' features (array<double>), place by place."""
    mean = F.avg("v") if places is None else F.round(F.avg("v"), places)
    by_place = points.select(*keys, F.posexplode("features").alias("pos", "v")).groupBy(*keys, "pos").agg(mean.alias("v"))
    return by_place.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("f")).select(*keys, F.col("f.v").alias("features"))


def assign_nearest(points: DataFrame, centroids: DataFrame, group: str = "period_idx") -> DataFrame:
    """points with cluster and dist2: the nearest centroid of their group; ties go to the lowest cluster number.

    A group's centroids travel as one array, so a point is one row throughout.
    """
    packed = centroids.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("cluster", F.col("features").alias("center")))).alias("_centers"))
    small = centroids.count() <= BROADCAST_CENTROIDS
    near = F.array_min(F.transform("_centers", lambda c: F.struct(squared_distance(F.col("features"), c["center"]).alias("dist2"), c["cluster"].alias("cluster"))))
    points_of = points.drop("cluster")
    if small:
        joined = points_of.join(F.broadcast(packed), group)
    else:  # a period's points are dealt over salts, each of which has its centroids
        salted = points_of.withColumn("_salt", F.pmod(F.xxhash64("features"), F.lit(SALTS)).cast("int"))
        joined = salted.join(packed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [group, "_salt"]).drop("_salt")
    return joined.withColumn("_near", near).select(*[c for c in points.columns if c != "cluster"], F.col("_near.cluster").alias("cluster"), F.col("_near.dist2").alias("dist2"))


def lloyd_update(assigned: DataFrame, centroids: DataFrame, group: str = "period_idx") -> DataFrame:
    """Means of the members; a cluster without members keeps its centroid."""
    means = centroid_table(assigned.select(group, "cluster", "features"), [group, "cluster"]).withColumnRenamed("features", "mean")
    return centroids.join(means, [group, "cluster"], "left").select(group, "cluster", F.coalesce("mean", "features").alias("features"))


def kmeans_grouped(points: DataFrame, start: DataFrame, iterations: int, group: str = "period_idx") -> DataFrame:
    """Centroids after so many Lloyd rounds over all groups at once. Rounds end in a checkpoint where a folder for it is set, so plans stay short."""
    centroids = start
    for i in range(iterations):
        centroids = lloyd_update(assign_nearest(points, centroids, group), centroids, group)
        if i % 4 == 3 and points.sparkSession.sparkContext.getCheckpointDir():
            centroids = centroids.checkpoint()
    return centroids


def inertia(assigned: DataFrame, group: str = "period_idx") -> DataFrame:
    return assigned.groupBy(group).agg(F.sum("dist2").alias("inertia"), F.count("*").alias("n"))


def kmeans_fit(points: DataFrame, k: int, seeds: tuple[int, ...] = (1, 2, 3), max_iter: int = 500):
    """The model of least cost over a few seeds of k-means||; points: features array<double>."""
    data = points.select(array_to_vector("features").alias("features"))
    return min((KMeans(k=k, maxIter=max_iter, seed=s).fit(data) for s in seeds), key=lambda m: m.summary.trainingCost)


def kmeans_range(points: DataFrame, low: int = 10, high: int = 22, **options) -> list:
    return [kmeans_fit(points, k, **options) for k in range(low, high + 1)]


def elbow_table(points: DataFrame, low: int, high: int, **options) -> DataFrame:
    rows = [(m.getK(), float(m.summary.trainingCost)) for m in kmeans_range(points, low, high, **options)]
    return points.sparkSession.createDataFrame(rows, "k int, distortion double")


def labelled(points: DataFrame, model) -> DataFrame:
    return model.transform(points.withColumn("_f", array_to_vector("features")).drop("features").withColumnRenamed("_f", "features")).withColumn("features", vector_to_array("features")).withColumnRenamed("prediction", "cluster")


def kmeans_per_period(points: DataFrame, k_of: dict, group: str = "period_idx", **options) -> DataFrame:
    """points with cluster, fitted period by period. Points are written once, in a folder for each period, and a fit reads its own; a few fits run side by side."""
    spark, path = points.sparkSession, new_path(points.sparkSession, "points")
    points.write.partitionBy(group).parquet(path)
    stored = spark.read.schema(points.schema).parquet(path)

    def fit(item: tuple) -> DataFrame:
        own = stored.filter(F.col(group) == item[0])
        return labelled(own, kmeans_fit(own, item[1], **options))

    with ThreadPoolExecutor(FITS) as pool:
        return reduce(lambda a, b: a.unionByName(b), pool.map(fit, k_of.items())).select(*[c for c in points.columns if c != "cluster"], "cluster")


def pca_fit(points: DataFrame, dims: int = 2):
    """Centring scaler and PCA model; Spark's PCA doesn't centre what it projects."""
    data = points.select(array_to_vector("features").alias("raw"))
    scaler = StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False).fit(data)
    return scaler, PCA(k=dims, inputCol="centred", outputCol="pc").fit(scaler.transform(data))


def pca_project(points: DataFrame, dims: int = 2) -> DataFrame:
    """points with pc1, pc2, ..; of a component's loadings the largest (the first of them) is positive."""
    scaler, model = pca_fit(points, dims)
    loadings = model.pc.toArray()
    signs = [1.0 if column[np.abs(column).round(9).argmax()] >= 0 else -1.0 for column in loadings.T]
    out = model.transform(scaler.transform(points.withColumn("raw", array_to_vector("features")))).withColumn("_pc", vector_to_array("pc"))
    return out.select(*points.columns, *[(F.get("_pc", F.lit(i)) * signs[i]).alias(f"pc{i + 1}") for i in range(dims)])


def pca_explained_variance(points: DataFrame, dims: int = 2) -> DataFrame:
    _, model = pca_fit(points, dims)
    return points.sparkSession.createDataFrame([(i + 1, float(v)) for i, v in enumerate(model.explainedVariance)], "component int, ratio double")


def cluster_scatter(points: DataFrame, centroids: DataFrame, key: str, group: str = "period_idx", reduction: str = "PCA") -> DataFrame:
    """key, pc1, pc2, cluster: the rows behind a cluster plot."""
    reduced = REDUCTION_METHODS[reduction](assign_nearest(points, centroids, group))
    return reduced.select(key, group, "pc1", "pc2", "cluster")


#: Registries of methods by name.
CLUSTER_METHODS: dict[str, Callable] = {"KMeans": kmeans_fit}
REDUCTION_METHODS: dict[str, Callable[[DataFrame], DataFrame]] = {"PCA": pca_project}
