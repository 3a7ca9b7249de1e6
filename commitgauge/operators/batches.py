"""Batch classification that goes on after a failure: a ledger of shards, each committed on its own.

Rows are dealt to ``shards`` shards by a hash of their key, and shards ``per_job`` at a time to groups; the input is
written once, partitioned by group, so that each group's job reads its own rows. Each group's result is written to
its own folder through Spark's commit protocol, whose mark (``_SUCCESS``) is the ledger. The model is trained and
written once too: no group trains it again, and a rerun goes on with the model of the groups that are done. A rerun
reads the marks and classifies only the groups without one; a half-written group (no mark) is written again, whole.
The result is the union of all committed groups, so a finished run reads the same rows whatever was lost before.

A row is known by its id and the digest of its text: rows that share an id but hold other texts are classified apart
(one row each), equal repeated rows once; a row without id is classified too and keeps a missing id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitgauge.operators import bayes

SHARDS = 64
PER_JOB = 8


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (spark.checkpoint.dir, or the context's)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("no shared folder: set spark.checkpoint.dir")
    return folder.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def committed(spark: SparkSession, folder: str) -> bool:
    """Whether a folder holds the commit mark of a finished write."""
    return exists(spark, f"{folder}/_SUCCESS")


def classify_in_shards(
    model: DataFrame,
    df: DataFrame,
    id_: str,
    folder: str,
    text: str = "text",
    shards: int = SHARDS,
    per_job: int = PER_JOB,
    after_group: Callable[[int], None] | None = None,
) -> DataFrame:
    """Rows (id, text_sha256, predicted) of every distinct (id, text), classified by ``bayes.classify`` group by group.

    ``folder`` must be shared by driver and executors and name this run: a rerun with the same folder, model and
    input goes on where the last one stopped. ``after_group`` is called with each group's number after its commit.
    """
    spark = df.sparkSession
    keyed = df.select(
        F.col(id_).alias("_id"), F.col(text).alias("_text"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("text_sha256")
    ).withColumn("_key", F.concat_ws("#", F.coalesce(F.col("_id").cast("string"), F.lit("-")), "text_sha256"))
    keyed = keyed.withColumn("_group", F.floor(F.pmod(F.xxhash64("_key"), F.lit(shards)) / per_job).cast("int"))
    # The input is dealt to its groups once, and committed: each group's job then reads its own rows only.
    staged = f"{folder}/input"
    if not committed(spark, staged):
        keyed.write.mode("overwrite").partitionBy("_group").parquet(staged)
    trained = f"{folder}/model"
    if not committed(spark, trained):
        model.write.mode("overwrite").parquet(trained)
    model = spark.read.schema(model.schema).parquet(trained)
    stored_schema = keyed.drop("_group").schema
    groups = range((shards + per_job - 1) // per_job)
    out_schema = f"{id_} {df.schema[id_].dataType.simpleString()}, text_sha256 string, predicted string"
    for g in groups:
        place = f"{folder}/group={g}"
        if committed(spark, place):
            continue
        if exists(spark, f"{staged}/_group={g}"):
            mine = spark.read.schema(stored_schema).parquet(f"{staged}/_group={g}").dropDuplicates(["_key"])
            mine = mine.select(F.struct("_id", "text_sha256").alias("_row"), "_text")
            found = bayes.classify(model, mine, "_row", "_text", "predicted")
            rows = found.select(F.col("_row._id").alias(id_), "_row.text_sha256", "predicted")
        else:
            rows = spark.createDataFrame([], out_schema)
        rows.write.mode("overwrite").parquet(place)
        if after_group:
            after_group(g)
    return spark.read.schema(out_schema).parquet(*(f"{folder}/group={g}" for g in groups))


def run_name(*parts: str) -> str:
    """A folder name for a run, the same for the same parts."""
    return hashlib.sha256("\x00".join(parts).encode()).hexdigest()[:16]
