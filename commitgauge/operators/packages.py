"""Package ecosystem: rankings, community data and dependency centrality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitgauge.operators.commits import scalar


def top_packages(metrics: DataFrame, n: int = 10, by: str = "out_degree_centrality") -> DataFrame:
    return metrics.orderBy(F.desc(by), "package").limit(n)


def fill_package_docs(docs: DataFrame) -> DataFrame:
    """Missing numbers to 0 and missing language to 'N/A'."""
    return docs.select(
        "package",
        F.coalesce("stars", F.lit(0)).alias("stars"),
        F.coalesce("forks", F.lit(0)).alias("forks"),
        F.coalesce("language", F.lit("N/A")).alias("language"),
        F.coalesce("contributions_count", F.lit(0)).alias("contributors_count"),
    )


def join_package_docs(metrics: DataFrame, docs: DataFrame) -> DataFrame:
    return metrics.join(docs, "package", "left")


def degree_centrality(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """In and out degree of every node over the other nodes, repeated edges counted once.

    Each edge becomes one row for either end, summed before the shuffle.
    """
    ends = F.array(
        F.struct(F.col(src).alias("node"), F.lit(0).alias("n_in"), F.lit(1).alias("n_out")),
        F.struct(F.col(dst).alias("node"), F.lit(1).alias("n_in"), F.lit(0).alias("n_out")),
    )
    degrees = (
        edges.select(src, dst)
        .distinct()
        .select(F.explode(ends).alias("end"))
        .groupBy("end.node")
        .agg(F.sum("end.n_in").alias("in_degree"), F.sum("end.n_out").alias("out_degree"))
    )
    counted = degrees.withColumn("_others", scalar(degrees, F.count(F.lit(1))) - 1)

    def centrality(degree: str):
        share = F.try_divide(F.col(degree).cast("double"), F.col("_others"))
        return F.when(F.col("_others") < 1, F.lit(1.0)).otherwise(share)

    return counted.withColumns(
        {
            "in_degree_centrality": centrality("in_degree"),
            "out_degree_centrality": centrality("out_degree"),
        }
    ).drop("_others")
