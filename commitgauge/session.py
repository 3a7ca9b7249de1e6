"""Session for tests and benchmarks; on a cluster the job's own session is used."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", partitions: int = 8, name: str = "commitgauge") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
