"""Samples and splits that give the same rows on every run."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from commitgauge import fixed_values as V
from commitgauge.functions import text as X
from commitgauge.operators.joins import broadcast_if_short


def hash_order(seed: str, key: Column) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), key))


def _join_alike(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys where a missing key equals a missing one."""
    renamed = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys]
    return left.join(renamed, reduce(lambda a, b: a & b, on)).drop(*[f"_right_{k}" for k in keys])


def gold_sample(
    df: DataFrame,
    frac: float = V.SAMPLE_FRACTION,
    cap: int = V.SAMPLE_CAP,
    by: Sequence[str] = ("language", "repo"),
    words: Sequence[str] = V.INTERESTING_WORDS,
    diff_word: str = V.INTERESTING_DIFF_WORD,
    seed: str = "42",
    ordinal: str | None = None,
) -> DataFrame:
    """Commits to label, at most ``cap`` per project: a random part, then telling ones.

    Random order is the order of a hash of the id. Text is reduced to one flag
    before anything moves, and both rankings keep ``cap`` ids per project, so a
    project of any size sends only a few rows into its ranking. The chosen ids are at
    most ``cap`` short rows per project; where the number of projects bounds them, they
    are broadcast and unchosen text never moves, else they are joined by shuffle.
    ``ordinal`` names a column whose order, instead of the hash order, the telling
    rows follow.
    """
    by = list(by)
    flag = X.is_interesting(F.col("message"), F.col("diff"), words, diff_word)
    ids = (
        df.select(*by, "commit_id", flag.alias("_hit"), F.col(ordinal or "commit_id").alias("_place"))
        .groupBy(*by, "commit_id")
        .agg(F.count(F.lit(1)).alias("_copies"), F.max("_hit").alias("_hit"), F.min("_place").alias("_place"))
        .withColumn("_order", hash_order(seed, F.col("commit_id")))
    )
    sizes = df.groupBy(*by).agg(F.bround(F.count(F.lit(1)) * F.lit(frac)).alias("_wanted"))
    group = W.partitionBy(*by)
    hashed = group.orderBy("_order", "commit_id")

    told = group.orderBy("_place" if ordinal else "_order", "commit_id")

    def first_ids(rows: DataFrame, order: WindowSpec) -> DataFrame:
        return rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= cap)

    earlier = F.coalesce(
        F.sum("_copies").over(hashed.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    drawn = (
        first_ids(ids, hashed)
        .withColumn("_earlier", earlier)
        .transform(lambda rows: _join_alike(rows, sizes, by))
        .where(F.col("_earlier") < F.col("_wanted"))
        .withColumn("_turn", F.lit(0))
    )
    telling = first_ids(ids.where("_hit"), told).withColumn("_turn", F.lit(1))
    keys = [*by, "commit_id"]
    both = drawn.select(*keys, "_rank", "_turn").unionByName(telling.select(*keys, "_rank", "_turn"))
    chosen = (
        both.groupBy(*keys)
        .agg(F.min(F.struct("_turn", "_rank")).alias("_place"))
        .withColumn("sample_rank", F.row_number().over(group.orderBy("_place", "commit_id")))
        .where(F.col("sample_rank") <= cap)
        .select(*keys, "sample_rank", (F.col("_place._turn") == 0).alias("is_random"))
    )
    chosen = broadcast_if_short(chosen, df.select(*by), cap)
    return _join_alike(df, chosen, keys).dropDuplicates(keys)


def to_label(sample: DataFrame) -> DataFrame:
    """Sampled commits laid out for hand labelling, with empty label columns."""
    return sample.select(
        "commit_id",
        "message",
        "entropy",
        "churn",
        *[
            F.lit("").alias(f"label_{name}")
            for name in ("category", "is_security", "is_feature", "complexity", "reasoning")
        ],
        F.col("diff").alias("diff_preview"),
    )


def holdout_split(df: DataFrame, key: str = "commit_id", train: float = 0.8, seed: str = "42") -> DataFrame:
    """Add ``split`` (train or holdout) from a hash of the key."""
    bound = format(round(train * 16**4), "04x")
    digest = F.left(hash_order(seed, F.col(key).cast("string")), F.lit(4))
    return df.withColumn("split", F.when(digest < bound, "train").otherwise("holdout"))
