"""Session settings used by the tests, the bench and the examples."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(cores: int | str = "*", app: str = "plumbline", shuffle_partitions: int = 8) -> SparkSession:
    """Local session. On a cluster the caller brings a session; nothing here is required by the operators."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, folder: str, name: str):
    """One of the supplied tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
