"""Shared helpers: reading tables, cutting lineage in the shared folder, splitting words."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that one task writes, where their number is known before.
ROWS_PER_FILE = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the checkpoint folder the context was given; only where neither is set
    (a local session, as in tests) a folder of this machine, which then becomes the context's checkpoint folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def stored(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """The rows written to the shared folder and read back: cuts the lineage, survives lost executors.

    ``rows``: about how many rows a last shuffle of narrow rows in `df` brings. They are merged and written by one task
    for each ROWS_PER_FILE of them, if the shuffle deals to more: files cost an executor time and memory each.
    """
    spark = df.sparkSession
    df = df if rows is None else df.coalesce(max(1, math.ceil(rows / ROWS_PER_FILE)))
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Words of a text as an array; empty for a missing or blank text."""
    split = F.split(F.coalesce(text, F.lit("")), GAP)
    return F.filter(split, lambda w: w != "")


def let(value: Column, use) -> Column:
    """Compute an array or text once and use it several times in one expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def computed(df: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """The columns `keep` and new ones, behind a generator: later filters and projections can't repeat their work."""
    return df.select(*keep, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def plain_words(text: str | None) -> list[bytes]:
    """Words of a text as bytes, with A-Z in lower case; bytes know ASCII white space and letters only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


#: Stands for a missing id on the way through pandas, which would turn the ids around it into floats.
NO_ID = -(1 << 63)


def hide_missing(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID)).alias(name)


def show_missing(name: str) -> Column:
    return F.when(F.col(name) != NO_ID, F.col(name)).alias(name)
