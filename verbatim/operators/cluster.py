"""k-means over a range of k, with the measures that choose among them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kmeans_sweep(rows: DataFrame, features: str, ks: range = range(2, 9), seed: int = 7) -> DataFrame:
    """k, inertia and silhouette (squared Euclidean) of k-means on standardised features; nulls aren't clustered."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    points = rows.filter(F.col(features).isNotNull()).select(array_to_vector(F.col(features).cast("array<double>")).alias("raw"))
    scaled = StandardScaler(withMean=True, withStd=True, inputCol="raw", outputCol="features").fit(points).transform(points).cache()
    found = []
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol="features").fit(scaled)
        score = ClusteringEvaluator(featuresCol="features").evaluate(model.transform(scaled))
        found.append((k, float(model.summary.trainingCost), float(score)))
    scaled.unpersist()
    return rows.sparkSession.createDataFrame(found, "k int, inertia double, silhouette double")


def adjusted_rand(rows: DataFrame, a: str, b: str) -> DataFrame:
    """The adjusted Rand index of two labelings; 1 where neither parts anything."""
    two = lambda c: c * (c - 1) / 2
    joint = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    cells = joint.agg(F.sum(two(F.col("n"))).alias("both"), F.sum("n").alias("n"))
    left, right = (joint.groupBy(c).agg(F.sum("n").alias("m")).agg(F.sum(two(F.col("m"))).alias(name)) for c, name in ((a, "in_a"), (b, "in_b")))
    out = reduce(DataFrame.crossJoin, (cells, left, right))  # one row each
    chance = F.col("in_a") * F.col("in_b") / two(F.col("n"))
    most = (F.col("in_a") + F.col("in_b")) / 2
    return out.select(F.when(most == chance, 1.0).otherwise((F.col("both") - chance) / (most - chance)).alias("adjusted_rand"))
