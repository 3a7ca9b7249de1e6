"""Lines, churn, commits and contributors over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from commitgauge import fixed_values as V
from commitgauge.functions import text as X
from commitgauge.operators.focus import count_by
from commitgauge.operators.joins import deal


def sum_of(column: str, strict_nulls: bool = False) -> Column:
    """Sum skipping NULL, or NULL as soon as one value is missing."""
    if not strict_nulls:
        return F.sum(column)
    return F.when(F.count_if(F.col(column).isNull()) == 0, F.sum(column))


def distinct_with_null(column: str) -> Column:
    """Distinct values, a missing value counting as one more."""
    return F.count_distinct(column) + F.coalesce(F.max(F.col(column).isNull().cast("int")), F.lit(0))


def net_loc_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("language", "repo").agg(
        F.sum("lines_added").alias("total_added"),
        F.sum("lines_removed").alias("total_removed"),
        F.sum(F.col("lines_added") - F.col("lines_removed")).alias("net_lines"),
    )


def daily_net_loc(df: DataFrame, strict_nulls: bool = False) -> DataFrame:
    return (
        df.withColumn("net_lines", F.col("lines_added") - F.col("lines_removed"))
        .groupBy("language", "repo", F.to_date("date").alias("day"))
        .agg(sum_of("net_lines", strict_nulls).alias("net_lines"))
    )


def cumulative_net_loc(df: DataFrame, strict_nulls: bool = False) -> DataFrame:
    """Running net lines per library by day; a window over days, not over commits."""
    by_day = W.partitionBy("language", "repo").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    running = F.sum("net_lines").over(by_day)
    if strict_nulls:
        missing = F.count_if(F.col("net_lines").isNull()).over(by_day)
        running = F.when(missing == 0, running)
    return daily_net_loc(df, strict_nulls).withColumn("cum_net_lines", running)


def yearly_net_loc(df: DataFrame) -> DataFrame:
    return df.groupBy("year", "language").agg(
        F.sum(F.col("lines_added") - F.col("lines_removed")).alias("net_loc")
    )


def pair_yearly_net_loc(
    df: DataFrame, pairs: Sequence[tuple[str, str]] = V.PAIRS, languages: tuple[str, str] = ("c", "rust")
) -> DataFrame:
    """Yearly net lines of both libraries of every pair, all pairs in one job.

    Net lines are summed per library and year first; a library in several pairs
    then repeats only its yearly rows.
    """
    yearly = df.groupBy("language", "repo", "year").agg(
        F.sum(F.col("lines_added") - F.col("lines_removed")).alias("net_loc")
    )
    members = [
        F.when(
            (F.col("language") == language) & (F.col("repo") == library),
            F.lit(f"{pair[0]} / {pair[1]}"),
        )
        for pair in pairs
        for language, library in zip(languages, pair)
    ]
    named = yearly.withColumn("pair", F.explode(F.array_compact(F.array(*members))))
    return named.select("pair", "language", "repo", "year", "net_loc")


def contributors(df: DataFrame, by: str = "language", author: str = "author") -> DataFrame:
    return df.groupBy(by, "year").agg(distinct_with_null(author).alias("contributors"))


def commits_by_library_year(df: DataFrame) -> DataFrame:
    return count_by(df, "language", "repo", "year", name="commits")


def traffic(df: DataFrame, author: str = "author") -> DataFrame:
    totals = df.groupBy("language", "year").agg(
        distinct_with_null(author).alias("contributors"), F.count(F.lit(1)).alias("commits")
    )
    return totals.withColumns(
        {
            "commits_per_contributor": F.col("commits").cast("double") / F.col("contributors"),
            "log_commits": F.log(F.col("commits").cast("double")),
        }
    )


def commit_frequency(df: DataFrame, author: str = "author", days: int = 365) -> DataFrame:
    """Commits per developer and day, with its decimal logarithm."""
    totals = df.groupBy("language", "year").agg(
        F.count(F.lit(1)).alias("total_commits"), distinct_with_null(author).alias("developers")
    )
    rate = F.col("total_commits").cast("double") / (days * F.col("developers"))
    return totals.withColumn("frequency", rate).withColumn("log10_frequency", F.log10("frequency"))


def churn(df: DataFrame, by: str = "language") -> DataFrame:
    changed = F.col("lines_added") + F.col("lines_removed")
    return df.groupBy(by, "year").agg(
        F.sum(changed).alias("total_churn"),
        F.avg(changed).alias("avg_churn_per_commit"),
        F.count(F.lit(1)).alias("commits"),
    )


def changes_daily(df: DataFrame, author: str = "author", strict_nulls: bool = False) -> DataFrame:
    """One change per author, library and day: its commits and its size."""
    sized = df.withColumn("_size", F.col("lines_added") + F.col("lines_removed"))
    return (
        sized.groupBy("language", "repo", author, F.to_date("date").alias("day"))
        .agg(F.count(F.lit(1)).alias("revisions"), sum_of("_size", strict_nulls).alias("total_loc"))
        .withColumn("year", F.year("day"))
    )


def changes_by_file(df: DataFrame, author: str = "author", file: str = "file", rows: int | None = None) -> DataFrame:
    """One change per author, file, library and day.

    There are about as many changes as rows: ``rows``, if known, deals them to as many tasks as they need."""
    daily = df.select("language", "repo", author, file, F.to_date("date").alias("day"))
    return (
        deal(daily, rows, *daily.columns).groupBy(*daily.columns)
        .agg(F.count(F.lit(1)).alias("revisions"))
        .withColumn("year", F.year("day"))
    )


def revisions_per_change(changes: DataFrame) -> DataFrame:
    return changes.groupBy("language", "year").agg(
        F.avg("revisions").alias("avg_revisions"), F.count(F.lit(1)).alias("n_changes")
    )


def commits_by_year(df: DataFrame) -> DataFrame:
    return count_by(df, "year", name="commits").orderBy("year")


def author_year_counts(df: DataFrame, author: str = "author", *extra: str) -> DataFrame:
    """Commits per author and year; pass the e-mail column as an extra key to keep it."""
    named = df.withColumn(author, X.fill_author(F.col(author)))
    return count_by(named, "year", author, *extra, name="commits")


def commits_by_author_year(df: DataFrame, author: str = "author", *extra: str) -> DataFrame:
    """The counts of ``author_year_counts``, busiest authors of each year first."""
    counts = author_year_counts(df, author, *extra)
    return counts.orderBy("year", F.desc("commits"), author, *extra)


def maintainers_by_year(author_years: DataFrame, author: str = "author") -> DataFrame:
    return author_years.groupBy("year").agg(distinct_with_null(author).alias("maintainers"))


def yearly_activity(df: DataFrame, author: str = "author") -> DataFrame:
    """Commits, maintainers and commits per maintainer of every year.

    One row per year and author carries both figures, so the yearly counts and
    the maintainers need no join by year.
    """
    yearly = author_year_counts(df, author).groupBy("year").agg(
        F.sum("commits").alias("commits"), F.count(F.lit(1)).alias("maintainers")
    )
    return yearly.withColumn(
        "commits_per_maintainer", F.col("commits").cast("double") / F.col("maintainers")
    )


def join_maintainers(by_year: DataFrame, maintainers: DataFrame) -> DataFrame:
    """The same table from two stored yearly tables; years without maintainers stay."""
    return by_year.join(maintainers, "year", "left").withColumn(
        "commits_per_maintainer", F.try_divide(F.col("commits").cast("double"), F.col("maintainers"))
    )


def library_order(df: DataFrame) -> DataFrame:
    return df.select("language", "repo").distinct().orderBy("language", "repo")
