"""The two-level cluster dimension: families (level 1), grains (level 2), members."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.scalars import blank
from shelfmark.functions.vectors import dot


def families(clusters: DataFrame) -> DataFrame:
    return clusters.where("level = 1").orderBy(F.desc("size"), "id").select("id", "size", "label", "centroid", "flatness", "attack", "duration")


def medoids(samples: DataFrame) -> DataFrame:
    """cluster_id, medoid: the member at the smallest distance; a null distance comes first, ties by path."""
    nearest = F.min_by("path", F.struct(F.col("cluster_d").isNotNull().alias("known"), F.col("cluster_d"), F.col("path")))
    return samples.where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(nearest.alias("medoid"))


def grains(clusters: DataFrame, samples: DataFrame, family: int | None = None) -> DataFrame:
    rows = clusters.where("level = 2") if family is None else clusters.where((F.col("level") == 2) & (F.col("parent") == family))
    return rows.join(medoids(samples), rows["id"] == F.col("cluster_id"), "left").orderBy(F.desc("size"), "id").select("id", "parent", "size", "label", "centroid", "flatness", "attack", "duration", "medoid")


def members(samples: DataFrame, cluster: int, limit: int = 60) -> DataFrame:
    return samples.where(F.col("cluster_id") == cluster).orderBy(F.asc_nulls_first("cluster_d"), "path").limit(limit).select("path", "cluster_d")


def family_labels(clusters: DataFrame) -> DataFrame:
    """id, label for every id from 0 to the largest family's; gaps are named ``family i``."""
    named = clusters.where("level = 1").select("id", "label")
    ids = named.agg(F.max("id").alias("m")).where("m IS NOT NULL").select(F.explode_outer(F.sequence(F.lit(0), "m")).alias("id"))
    return ids.join(named, "id", "left").select("id", F.coalesce("label", F.concat(F.lit("family "), F.col("id").cast("string"))).alias("label"))


def with_cluster_labels(items: DataFrame, clusters: DataFrame) -> DataFrame:
    """``items`` with the labels of their grain (cluster_id) and family (cluster_l1)."""
    grain = clusters.where("level = 2").select(F.col("id").alias("cluster_id"), F.col("label").alias("grain"))
    family = clusters.where("level = 1").select(F.col("id").alias("cluster_l1"), F.col("label").alias("family"))
    return items.join(F.broadcast(grain), "cluster_id", "left").join(F.broadcast(family), "cluster_l1", "left")


def cluster_purity(samples: DataFrame, label: str = "human_instrument") -> DataFrame:
    """cluster_id, n, labels, top, purity, entropy: how far the people's labels of each cluster's members agree.

    n counts the labelled members and ``labels`` their different labels; purity is the share of the most frequent one
    (``top``; of equals the one that sorts first), entropy that of the shares in nats, 0 where all agree. A cluster
    without a labelled member has no row. Counted by cluster and label first, so a cluster may have any size.
    """
    known = samples.where(F.col("cluster_id").isNotNull() & ~blank(F.col(label)) & (F.col("status") != "missing"))
    counts = known.groupBy("cluster_id", F.col(label).alias("label")).agg(F.count("*").alias("m"))
    sums = counts.groupBy("cluster_id").agg(
        F.sum("m").alias("n"),
        F.count("*").alias("labels"),
        F.min(F.struct((-F.col("m")).alias("minus"), "label")).alias("t"),
        F.sum(F.col("m") * F.log("m")).alias("s"),
    )
    entropy = F.greatest(F.lit(0.0), F.log("n") - F.col("s") / F.col("n"))
    return sums.select("cluster_id", "n", "labels", F.col("t.label").alias("top"), (-F.col("t.minus") / F.col("n")).alias("purity"), entropy.alias("entropy"))


def fit_families(features: DataFrame, k: int = 8, seed: int = 42) -> DataFrame:
    """An extension: k-means families for the dimension that readers expect; path, cluster_l1, cluster_d."""
    rows = features.select("path", "vec", array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster_l1").fit(rows)
    centers = features.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster_l1 int, center array<double>")
    joined = model.transform(rows).join(F.broadcast(centers), "cluster_l1")
    gap = F.zip_with(F.col("vec").cast("array<double>"), "center", lambda x, y: x - y)
    return joined.select("path", "cluster_l1", F.sqrt(dot(gap, gap)).alias("cluster_d"))
