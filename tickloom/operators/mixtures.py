"""K-means by Spark ML; mixtures and grids of fits are in ``fits``."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kmeans(points: DataFrame, k: int, features: str = "x", seed: int = 7, quantile: float = 0.99) -> tuple[DataFrame, DataFrame]:
    """(points with cluster and distance, clusters with the distance that holds ``quantile`` of their points)."""
    rows = points.withColumn("__f", array_to_vector(F.col(features).cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="__f", predictionCol="cluster", initSteps=5, maxIter=30).fit(rows)
    centres = [[float(v) for v in c] for c in model.clusterCenters()]  # k short vectors
    held = F.array(*(F.array(*(F.lit(v) for v in c)) for c in centres))
    out = model.transform(rows).drop("__f")
    gap = F.zip_with(F.col(features).cast("array<double>"), held[F.col("cluster")], lambda a, b: (a - b) * (a - b))
    out = out.withColumn("distance", F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, v: s + v)))
    return out, out.groupBy("cluster").agg(F.percentile("distance", quantile).alias("limit"), F.count(F.lit(1)).alias("n"))
