"""Reading stored commit, label, answer and package tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commitgauge import fixed_values as V
from commitgauge import schemas
from commitgauge.functions.text import strip


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    file_system = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return file_system.exists(hadoop_path)


def _quoted_csv(spark: SparkSession, schema: T.StructType):
    """CSV with quoted fields that may hold line breaks and doubled quotes."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("enforceSchema", False)
    )


def _stem(column: str = "_metadata.file_name") -> Column:
    return F.regexp_replace(F.col(column), r"\.[^.]*\z", "")


def read_commits_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType = schemas.COMMITS
) -> DataFrame:
    """Commits with embedded line breaks. ``schema`` lists the columns as they stand in the file."""
    return _quoted_csv(spark, schema).csv(path)


def read_library_tables(
    spark: SparkSession, base: str, schema: T.StructType = schemas.COMMITS, skip_unreadable: bool = False
) -> DataFrame:
    """All per-library CSVs of a folder tree laid out as language/<prefix><library>.csv.

    An unreadable file, such as one with other columns, fails the job unless
    ``skip_unreadable`` asks to go on without it.
    """
    rows = (
        _quoted_csv(spark, schema)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .option("ignoreCorruptFiles", skip_unreadable)
    )
    parts = F.split(F.col("_metadata.file_path"), "/")
    return rows.csv(base).select(
        "*",
        F.replace(_stem(), F.lit(V.COMMIT_FILE_PREFIX), F.lit("")).alias("repo"),
        F.get(parts, F.size(parts) - 2).alias("language"),
    )


def read_source_metadata(
    spark: SparkSession, base: str, schema: T.StructType = schemas.COMMITS, skip_unreadable: bool = False
) -> DataFrame:
    """Commit id, entropy and churn of all libraries; other columns are not parsed out."""
    rows = read_library_tables(spark, base, schema, skip_unreadable)
    return rows.select("commit_id", "entropy", "churn", "repo", "language")


def read_labels_csv(spark: SparkSession, path: str | list[str], names: Sequence[str] | None = None) -> DataFrame:
    """Labels with every column as text and '' for missing values."""
    columns = names or schemas.GOLD_LABELS.fieldNames()
    schema = T.StructType([T.StructField(n, T.StringType()) for n in columns])
    return _quoted_csv(spark, schema).csv(path).na.fill("")


def read_labels_in_order(spark: SparkSession, path: str | list[str], names: Sequence[str] | None = None) -> DataFrame:
    """Labels with the file stem and an ordinal that follows the order inside each file.

    A CSV with line breaks in fields is read by one task per file, so the row id
    grows in file order.
    """
    columns = names or schemas.GOLD_LABELS.fieldNames()
    schema = T.StructType([T.StructField(n, T.StringType()) for n in columns])
    rows = _quoted_csv(spark, schema).csv(path)
    return rows.select("*", _stem().alias("file"), F.monotonically_increasing_id().alias("ordinal"))


def read_lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """Non-blank lines of every matching file of a folder tree, with their origin."""
    lines = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    )
    return lines.where(strip(F.col("value")) != "").select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )


def read_predictions_jsonl(spark: SparkSession, folder: str) -> DataFrame:
    """Response lines of one folder (not of its subfolders), for ``parse_predictions``."""
    return spark.read.option("pathGlobFilter", "*.jsonl").text(folder)


def read_package_docs(spark: SparkSession, folder: str, packages: Sequence[str] | None = None) -> DataFrame:
    """One JSON document per package file; packages without a file are simply absent."""
    docs = (
        spark.read.schema(schemas.PACKAGE_DOCS)
        .option("multiLine", True)
        .option("pathGlobFilter", "*.json")
        .json(folder)
        .select(_stem().alias("package"), "*")
    )
    return docs if packages is None else docs.where(F.col("package").isin(*packages))


def extract_or_load(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Stored commits if they are there, otherwise built and stored first; empty text for NULL.

    Later work starts from the written table, so a lost executor never repeats the extract.
    """
    if not path_exists(spark, path):
        build().write.parquet(path)
    return spark.read.parquet(path).na.fill("", ["message", "diff"])
