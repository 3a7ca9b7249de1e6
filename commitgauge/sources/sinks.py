"""Writing tables, classifier requests and training examples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commitgauge import fixed_values as V
from commitgauge.functions import text as X
from commitgauge.operators.labels import clean_labels
from commitgauge.sources.tables import read_lines


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", max_rows: int = 100_000) -> None:
    """CSV that ``read_commits_csv`` reads back; files hold ``max_rows`` at most, since each is read by one task."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("maxRecordsPerFile", max_rows)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_by_repo(df: DataFrame, path: str, mode: str = "errorifexists", keys: Sequence[str] = ("language", "repo")) -> None:
    """Parquet in folders per language and library; readers of one library open only its folder.

    Rows stay where they are: gathering each library first would put the largest
    one into a single task.
    """
    df.write.mode(mode).partitionBy(*keys).parquet(path)


def _turn(role: str, text: Column) -> Column:
    return F.struct(
        F.lit(role).alias("role"), F.array(F.struct(text.alias("text"))).alias("parts")
    )


def llm_requests(commits: DataFrame, instruction: str) -> DataFrame:
    """One classifier request per commit: nested request and pass-through key."""
    text = X.model_input(
        F.col("language"), F.coalesce("message", F.lit("")), F.coalesce("diff", F.lit(""))
    )
    return commits.select(
        F.struct(
            _turn("system", F.lit(instruction)).alias("systemInstruction"),
            F.array(_turn("user", text)).alias("contents"),
        ).alias("request"),
        X.unique_key(F.col("language"), F.col("repo"), F.col("commit_id")).alias("key"),
    )


def tuning_examples(labels: DataFrame, instruction: str) -> DataFrame:
    """One training example per labelled commit; the model turn is JSON text."""
    cleaned = clean_labels(labels)
    user = X.model_input(F.col("language_inferred"), F.col("message"), F.col("diff_preview"))
    model = F.to_json(F.struct("cat", "feat", "sec", "comp", "reas"))
    return cleaned.select(
        _turn("system", F.lit(instruction)).alias("systemInstruction"),
        F.array(_turn("user", user), _turn("model", model)).alias("contents"),
    )


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One compact JSON object per line."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)


def merge_jsonl(
    spark: SparkSession, root: str, path: str, glob: str = V.REQUEST_FILE_GLOB, mode: str = "errorifexists"
) -> None:
    """Gather request files into one folder, in path order and line order, without blank lines."""
    lines = read_lines(spark, root, glob)
    if lines.isEmpty():
        raise ValueError(f"no {glob} lines under {root}")
    ordered = lines.withColumn("_line", F.monotonically_increasing_id()).orderBy(
        "file_path", "block_start", "_line"
    )
    ordered.select("value").write.mode(mode).text(path)
