"""Building, cleaning and narrowing commit tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commitgauge import fixed_values as V
from commitgauge.functions import text as X


def sanitize_commits(df: DataFrame) -> DataFrame:
    """Valid text in message (also stripped), diff and author."""
    return df.withColumns(
        {
            "message": X.strip(X.sanitize_text(F.col("message"))),
            "diff": X.sanitize_text(F.col("diff")),
            "author": X.sanitize_text(F.col("author")),
        }
    )


def rename_older(df: DataFrame) -> DataFrame:
    """Column names of older extracts to the current ones."""
    return df.withColumnsRenamed({"author_name": "author", "authored_datetime": "date"})


def bind_libraries(
    frames: Mapping[tuple[str, str], DataFrame], language: str = "language", library: str = "repo"
) -> DataFrame:
    """Stack per-library tables, adding (language, library) of each as columns."""
    named = [
        df.withColumns({language: F.lit(lang), library: F.lit(lib)})
        for (lang, lib), df in frames.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def concat_pages(pages: Sequence[DataFrame], schema: T.StructType, like: DataFrame) -> DataFrame:
    """Stack saved pages; with no page an empty table of the given schema."""
    if not pages:
        return like.sparkSession.createDataFrame([], schema)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pages)


def with_net_lines(df: DataFrame) -> DataFrame:
    return df.withColumn("net_lines", F.col("lines_added") - F.col("lines_removed"))


def with_year(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumns({"day": F.to_date(date), "year": F.year(date)})


def api_commit_times(df: DataFrame) -> DataFrame:
    """Time and year of saved API commits; rows without a readable time are dropped."""
    stamped = df.withColumn(
        "ts", X.commit_timestamp(F.col("committed_date"), F.col("authored_date"))
    )
    return stamped.where(F.col("ts").isNotNull()).withColumn("year", F.year("ts"))


def date_window(df: DataFrame, since: str | None = None, until: str | None = None, ts: str = "date") -> DataFrame:
    """Rows whose time lies within the bounds, both optional and inclusive."""
    if since is not None:
        df = df.where(F.col(ts) >= F.lit(since).cast("timestamp"))
    if until is not None:
        df = df.where(F.col(ts) <= F.lit(until).cast("timestamp"))
    return df


def drop_null_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.dropna(subset=list(keys))


def year_after(df: DataFrame, year: int) -> DataFrame:
    return df.where(F.col("year") > year)


def maintenance_only(df: DataFrame, by: str = "category") -> DataFrame:
    """Drop feature work, told by the category or by the ``is_feature`` flag."""
    if by == "category":
        return df.where(F.col("category") != V.FEATURE)
    return df.where(F.lower(F.col(by).cast("string")) == "false")


def scalar(df: DataFrame, value: Column) -> Column:
    """A one-value aggregate of ``df`` as an uncorrelated subquery."""
    return df.agg(value.alias("value")).scalar()
