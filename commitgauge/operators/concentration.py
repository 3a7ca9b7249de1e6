"""How evenly commits are spread over contributors.

Shares and Gini values only depend on how many authors have how many commits.
They are computed from that histogram, which stays short (its distinct counts
grow with the square root of the commits), so no group of authors is ever
sorted as a whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from commitgauge.functions import text as X
from commitgauge.operators.commits import scalar
from commitgauge.operators.focus import count_by


def commit_histogram(df: DataFrame, by: Sequence[str], author: str = "author") -> DataFrame:
    """Authors per number of commits, with the authors at or below and in all."""
    by = list(by)
    per_author = count_by(df, *by, author, name="commits")
    blocks = count_by(per_author, *by, "commits", name="authors")
    group = W.partitionBy(*by)
    upward = group.orderBy("commits").rowsBetween(W.unboundedPreceding, 0)
    return blocks.withColumns(
        {
            "authors_up_to": F.sum("authors").over(upward),
            "n_contributors": F.sum("authors").over(group),
        }
    )


def gini_by(df: DataFrame, by: Sequence[str], author: str = "author") -> DataFrame:
    """Gini coefficient of commits per contributor, contributors and commits per group."""
    blocks = commit_histogram(df, by, author)
    x = F.col("commits").cast("double")
    m, n = F.col("authors"), F.col("n_contributors")
    below = F.col("authors_up_to") - m
    return blocks.groupBy(*by).agg(
        (F.sum(x * m * (2 * below + m - n)) / (F.max(n) * F.sum(x * m))).alias("gini"),
        F.max(n).alias("n_contributors"),
        F.sum(F.col("commits") * m).alias("total_commits"),
    )


def author_concentration(
    df: DataFrame, by: Sequence[str], author: str = "author", tops: Sequence[int] = (1, 3, 5)
) -> DataFrame:
    """Percentage of commits made by the most active 1, 3 and 5 contributors of each group."""
    blocks = commit_histogram(df, by, author)
    m, n = F.col("authors"), F.col("n_contributors")
    above = n - F.col("authors_up_to")

    def top_commits(k: int) -> Column:
        return F.sum(F.col("commits") * F.least(m, F.greatest(F.lit(0), k - above)))

    total = F.sum(F.col("commits") * m)
    return blocks.groupBy(*by).agg(
        total.alias("total_commits"),
        F.max(n).alias("n_contributors"),
        *[(top_commits(k) / total * 100).alias(f"top{k}_pct") for k in tops],
    )


def concentration_long(wide: DataFrame, by: Sequence[str], tops: Sequence[int] = (1, 3, 5)) -> DataFrame:
    return wide.unpivot(list(by), [f"top{k}_pct" for k in tops], "rank_group", "percent")


def gini_distribution(
    ginis: DataFrame, by: str = "language", probs: Sequence[float] = (0.25, 0.5, 0.75)
) -> DataFrame:
    """Quartiles of the yearly Gini values; one value per group and year goes in."""
    return ginis.groupBy(by).agg(
        *[F.percentile("gini", p).alias(f"q{round(100 * p)}") for p in probs],
        F.count("gini").alias("n_years"),
    )


def author_rank(
    df: DataFrame, by: Sequence[str], author: str = "author", top: int | None = None, parts: int = 256
) -> DataFrame:
    """Contributors numbered from the most active within each group.

    With ``top`` only that many rows per group survive, and Spark drops the rest
    before the shuffle. Without it every author is numbered: a tie block is cut
    into ``parts`` by name hash, blocks are sized first, and each part only
    numbers its own authors on top of the authors in front of it.
    """
    by = list(by)
    counts = count_by(df, *by, author, name="commits")
    digest = F.md5(F.coalesce(F.col(author), F.lit("")))
    order = [F.desc("commits"), F.asc("_digest"), F.asc_nulls_first(author)]
    hashed = counts.withColumn("_digest", digest)
    if top is not None:
        rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
        return hashed.withColumn("rank", rank).where(F.col("rank") <= top).drop("_digest")

    width = max(1, (parts - 1).bit_length() // 4)
    hashed = hashed.withColumn("_part", F.left("_digest", F.lit(width)))
    sizes = count_by(hashed, *by, "commits", "_part", name="_size")
    forward = W.partitionBy(*by).orderBy(F.desc("commits"), "_part")
    before = F.coalesce(
        F.sum("_size").over(forward.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    offsets = sizes.withColumn("_before", before).drop("_size")
    keys = [*by, "commits", "_part"]
    same = [F.col(f"h.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    located = hashed.alias("h").join(offsets.alias("o"), same).select("h.*", "o._before")
    within = F.row_number().over(
        W.partitionBy(*keys).orderBy("_digest", F.asc_nulls_first(author))
    )
    return located.withColumn("rank", (F.col("_before") + within).cast("int")).drop(
        "_digest", "_part", "_before"
    )


def author_totals(author_years: DataFrame, author: str = "author") -> DataFrame:
    return author_years.groupBy(author).agg(F.sum("commits").alias("total"))


def top_authors(author_years: DataFrame, n: int = 20, author: str = "author") -> DataFrame:
    """The ``n`` largest totals and everybody tied with the last of them.

    The bound is the smallest of the ``n`` best totals; authors are then kept by
    a plain filter, however many are tied.
    """
    totals = author_totals(author_years, author)
    bound = scalar(totals.orderBy(F.desc("total")).limit(n), F.min("total"))
    return totals.where(F.col("total") >= bound)


def top_authors_latest(author_years: DataFrame, n: int = 10, author: str = "author") -> DataFrame:
    """Exactly ``n`` authors (ties by name) of the latest year."""
    latest = scalar(author_years, F.max("year"))
    return author_years.where(F.col("year") == latest).orderBy(F.desc("commits"), author).limit(n)


def contributor_heatmap(author_years: DataFrame, n: int = 20, author: str = "author") -> DataFrame:
    """Yearly commits of the top authors."""
    return author_years.join(top_authors(author_years, n, author).select(author), author, "left_semi")


def contributor_totals(author_years: DataFrame, year: int, author: str = "author") -> DataFrame:
    """Commits per author in one year, largest first."""
    chosen = author_years.where(F.col("year") == year)
    totals = chosen.groupBy(author).agg(F.sum("commits").alias("total_commits"))
    return totals.orderBy(F.desc("total_commits"), author)


def max_commits_order(author_years: DataFrame, author: str = "author") -> DataFrame:
    """Authors by their busiest year."""
    best = author_years.groupBy(author).agg(F.max("commits").alias("max_commits"))
    return best.orderBy(F.desc("max_commits"), author)
