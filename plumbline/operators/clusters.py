"""Clusters of rows and the check of a sample against its source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from .common import number
from .compare import KEY, ecdf_merge, ecdf_summary
from .correlation import correlation_sides
from .entropy import column_entropies, entropy_ratio
from .pairs import stack_pair


def cluster_rows(df: DataFrame, cols: Sequence[str], k: int = 10, seed: int = 42) -> DataFrame:
    """K-means on standardised columns: adds ``cluster_id`` and the scaled ``features``."""
    clean = df.select("*", *[F.coalesce(number(c), F.lit(0.0)).alias(f"_x_{c}") for c in cols])
    stages = [
        VectorAssembler(inputCols=[f"_x_{c}" for c in cols], outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True),
        KMeans(k=k, seed=seed, maxIter=20, featuresCol="features", predictionCol="cluster_id"),
    ]
    out = Pipeline(stages=stages).fit(clean).transform(clean)
    return out.drop("_raw", *[f"_x_{c}" for c in cols])


def cluster_summary(clustered: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Size, share, centroid and density (rows per unit of mean squared spread) of every cluster."""
    total = clustered.agg(F.count(F.lit(1)).alias("_total"))
    spread = sum((F.var_pop(number(c)) for c in cols), F.lit(0.0))
    per = clustered.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("size"), F.array(*[F.avg(number(c)) for c in cols]).alias("centroid"), spread.alias("_spread")
    )
    return per.crossJoin(F.broadcast(total)).select(  # one row
        "cluster_id", "size", (F.col("size") / F.col("_total")).alias("share"), "centroid",
        (F.col("size") / (F.sqrt("_spread") + 1e-6)).alias("density"),
    )


def cluster_quality(clustered: DataFrame) -> DataFrame:
    """Mean silhouette (squared distances, from cluster aggregates)."""
    score = ClusteringEvaluator(predictionCol="cluster_id", featuresCol="features").evaluate(clustered)
    return clustered.agg(F.count_distinct("cluster_id").alias("clusters")).withColumn("silhouette", F.lit(float(score)))


def validate_sample(sample: DataFrame, full: DataFrame, cols: Sequence[str]) -> DataFrame:
    """KS similarity, largest correlation gap and entropy ratio of a sample against its source."""
    pair = stack_pair(sample, full, cols)
    ks = ecdf_summary(ecdf_merge(pair, cols)).groupBy(KEY).agg(F.avg(100.0 * (1.0 - F.col("ks"))).alias("ks_similarity"))
    gap = correlation_sides(pair, cols).groupBy(KEY).agg(F.max(F.abs(F.col("r_s") - F.col("r_o"))).alias("max_correlation_gap"))
    entropy = entropy_ratio(column_entropies(pair, cols, shared=True)).select(KEY, "entropy_ratio")
    return ks.join(gap, KEY).join(entropy, KEY).drop(KEY)
