"""Diff operators. All of them are narrow: one row in, its rows out, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitgauge.functions import diffs as D
from commitgauge.functions.text import count_added, count_removed


def add_loc(df: DataFrame, diff: str = "diff", drop: Sequence[str] = ("message", "diff")) -> DataFrame:
    """Count changed lines of the raw diff, then drop the wide text columns."""
    counted = df.withColumns(
        {"lines_added": count_added(F.col(diff)), "lines_removed": count_removed(F.col(diff))}
    )
    return counted.drop(*drop)


def explode_diff_lines(df: DataFrame, diff: str = "diff_raw", keep: Sequence[str] = ("commit_id",)) -> DataFrame:
    """One row per hunk line: file_no, hunk_no, line_no (from 1), path, kind, text."""
    keep = list(keep)
    files = df.select(*keep, F.posexplode(D.read_files(F.col(diff))).alias("file_no", "file"))
    hunks = files.select(
        *keep,
        (F.col("file_no") + 1).alias("file_no"),
        F.col("file.path").alias("path"),
        F.posexplode("file.hunks").alias("hunk_no", "hunk"),
    )
    lines = hunks.select(
        *keep,
        "file_no",
        "path",
        (F.col("hunk_no") + 1).alias("hunk_no"),
        F.posexplode(D.hunk_lines(F.col("hunk"))).alias("line_no", "text"),
    )
    return lines.withColumns(
        {"line_no": F.col("line_no") + 1, "kind": D.line_kind(F.col("text"))}
    )


def split_file_chunks(df: DataFrame, diff: str = "diff", drop: Sequence[str] = ("message",)) -> DataFrame:
    """One row per file section that has a new path, with the path and its line counts."""
    chunks = df.where(F.col(diff).isNotNull()).withColumn(
        "_chunk", F.explode(F.split(F.col(diff), "diff --git"))
    )
    files = chunks.where(F.contains(F.col("_chunk"), F.lit("+++ b/")))
    return files.withColumns(
        {
            "file": F.nullif(F.regexp_extract("_chunk", r"(?<=\+\+\+ b/)\S+", 0), F.lit("")),
            "lines_added": count_added(F.col("_chunk")),
            "lines_removed": count_removed(F.col("_chunk")),
        }
    ).drop("_chunk", diff, *drop)


def list_files(df: DataFrame, diff: str = "diff_raw", keep: Sequence[str] = ("commit_id",)) -> DataFrame:
    """One row per file of a diff with its path, status tag, class and line counts."""
    files = df.select(*keep, F.posexplode(D.read_files(F.col(diff))).alias("file_no", "file"))
    return files.select(
        *keep,
        (F.col("file_no") + 1).alias("file_no"),
        "file.path",
        F.trim("file.tag").alias("tag"),
        F.col("file.kind").alias("file_kind"),
        F.col("file.added").alias("lines_added"),
        F.col("file.removed").alias("lines_removed"),
    )


def condense_diffs(
    df: DataFrame,
    diff: str = "diff_raw",
    into: str = "diff",
    error: str | None = None,
    limits: D.Limits = D.Limits(),
    stats: bool = False,
) -> DataFrame:
    """Add the condensed diff; ``error`` names a column with the text of a failed fetch.

    ``stats`` adds entropy and churn as ``commit_stats`` does, from the same reading of the diff.
    """
    files = df.withColumn("_files", D.read_files(F.col(diff)))
    failed = None if error is None else F.col(error)
    columns = {into: D.condensed_diff(F.col(diff), F.col("_files"), failed, limits)}
    return files.withColumns(columns | (_sizes() if stats else {})).drop("_files")


def _sizes() -> dict[str, Column]:
    changed = F.aggregate(
        "_files", F.lit(0).cast("long"), lambda acc, f: acc + f["added"] + f["removed"]
    )
    return {"entropy": F.size("_files"), "churn": changed}


def commit_stats(df: DataFrame, diff: str = "diff_raw") -> DataFrame:
    """Add files touched (entropy) and lines added plus removed (churn) of each diff."""
    files = df.withColumn("_files", D.read_files(F.col(diff)))
    return files.withColumns(_sizes()).drop("_files")


def truncation_ratio(
    df: DataFrame, raw: str = "diff_raw", condensed: str = "diff", by: Sequence[str] = ()
) -> DataFrame:
    """Share of characters that condensing removes."""
    sums = df.groupBy(*by).agg(
        F.sum(F.length(raw)).alias("raw_chars"), F.sum(F.length(condensed)).alias("condensed_chars")
    )
    return sums.withColumn(
        "reduction", 1 - F.col("condensed_chars").cast("double") / F.col("raw_chars")
    )
