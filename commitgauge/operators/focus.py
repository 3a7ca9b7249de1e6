"""What kinds of work projects spend their commits on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from commitgauge import fixed_values as V
from commitgauge.functions import text as X


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Rows per combination of keys, NULL being a key of its own."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def category_counts(df: DataFrame) -> DataFrame:
    return count_by(df, "language", "category")


def repo_category_counts(df: DataFrame) -> DataFrame:
    return count_by(df, "repo", "category")


def with_share(counts: DataFrame, within: Sequence[str], n: str = "n", into: str = "share") -> DataFrame:
    """Part of the group total; works on counts, so the window only sees aggregated rows."""
    total = F.sum(n).over(W.partitionBy(*within))
    return counts.withColumn(into, F.col(n).cast("double") / total)


def category_share_by_language(df: DataFrame) -> DataFrame:
    return with_share(category_counts(df), ["language"])


def category_share_by_library(df: DataFrame) -> DataFrame:
    labelled = df.withColumn("library", X.library_label(F.col("language"), F.col("repo")))
    return with_share(count_by(labelled, "library", "category"), ["library"])


def domain_delta(df: DataFrame) -> DataFrame:
    """Share of each category in C minus its share in Rust, per functional domain.

    Totals count every row of a project, also those without a domain or category.
    """
    counts = count_by(
        df.withColumn("work_type", X.work_type(F.col("category"))),
        "language", "repo", "domain", "category", "work_type",
    )
    shares = with_share(counts, ["language", "repo"]).dropna(
        subset=["language", "repo", "domain", "category"]
    )
    wide = (
        shares.groupBy("domain", "category", "work_type")
        .pivot("language", ["c", "rust"])
        .agg(F.avg("share"))
        .na.fill(0.0, ["c", "rust"])
    )
    return wide.withColumn("delta", F.col("c") - F.col("rust"))


def memory_share_ratio(df: DataFrame, category: str = V.MEMORY) -> DataFrame:
    """Share of one category in C and in Rust, and how many times larger the first is."""
    hit = F.avg(F.when(F.col("category") == category, 1.0).otherwise(0.0))
    return (
        df.groupBy(F.lit(category).alias("category"))
        .pivot("language", ["c", "rust"])
        .agg(hit)
        .withColumn("ratio", F.try_divide("c", "rust"))
    )


def top_categories(df: DataFrame, n: int = 9) -> DataFrame:
    return count_by(df, "category").orderBy(F.desc("n"), "category").limit(n)


def category_by_year(df: DataFrame, n: int = 9) -> DataFrame:
    """Counts and yearly shares of the ``n`` largest categories, the rest as one group.

    Counts first, so only (year, category) rows meet the short list of top ones.
    """
    counts = count_by(df, "year", "category")
    top = (
        counts.groupBy("category")
        .agg(F.sum("n").alias("total"))
        .orderBy(F.desc("total"), "category")
        .limit(n)
        .select("category", F.lit(True).alias("is_top"))
    )
    grouped = (
        counts.join(F.broadcast(top), "category", "left")
        .withColumn("category", F.when(F.col("is_top"), F.col("category")).otherwise(V.OTHER))
        .groupBy("year", "category")
        .agg(F.sum("n").alias("n"))
    )
    return with_share(grouped, ["year"])
