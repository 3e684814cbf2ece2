"""Clustering and projection of unit vectors."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kmeans(rows: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """``rows`` (id, v) with the number of their cluster."""
    x = rows.withColumn("features", array_to_vector("v"))
    model = KMeans(k=k, seed=seed, predictionCol="cluster").fit(x)
    return model.transform(x).drop("features")


def principal_components(rows: DataFrame, k: int) -> DataFrame:
    """(id, pc): the first k components."""
    x = rows.select("id", array_to_vector("v").alias("features"))
    return PCA(k=k, inputCol="features", outputCol="pc").fit(x).transform(x).select("id", F.transform(vector_to_array("pc"), lambda e: F.round(e, 6)).alias("pc"))
