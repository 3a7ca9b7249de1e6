"""Joins that hold where one side is short, or where one key has a large part of all rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of a table that is broadcast after its rows were counted.
MOST_BROADCAST = 100_000
#: Rows that one task sorts or groups, where their number is known before.
ROWS_PER_TASK = 500_000


def broadcast_if_short(small: DataFrame, keys: DataFrame, rows_per_key: int = 1, most: int = MOST_BROADCAST) -> DataFrame:
    """``small`` marked for broadcast if it has at most ``most`` rows, else as it is, for a join by shuffle.

    ``small`` has at most ``rows_per_key`` rows for each distinct row of ``keys``. Those are counted, up to the bound
    and from their own columns alone, before the join is planned. The joined rows are the same either way.
    """
    bound = most // rows_per_key
    return F.broadcast(small) if keys.distinct().limit(bound + 1).count() <= bound else small


def deal(df: DataFrame, rows: int | None, *keys: str, per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``df`` dealt by ``keys`` to so many tasks that each gets about ``per_task`` of ``rows`` rows, for a join or
    grouping by these keys; as it is, if the session's shuffles deal to as many tasks anyway, or ``rows`` is unknown."""
    tasks = math.ceil((rows or 0) / per_task)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def hot_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread: Sequence[str],
    counts: DataFrame,
    total: int,
    how: str = "inner",
    parts: int = 1024,
    least: int = 1024,
) -> DataFrame:
    """Join many rows with at most one row a key, hot keys in slices.

    ``counts`` holds ``n`` rows of ``left`` for each key, of ``total`` in all. A key with more than ``total / parts``
    rows, and more than ``least``, is cut into slices of about that size by a hash of the columns ``spread``; its row of
    ``right`` goes to each slice. There are fewer than ``parts`` such keys, so their list is broadcast. Keys missing
    from ``counts`` are not cut.
    """
    piece = max(total / parts, least)
    hot = F.broadcast(counts.where(F.col("n") > piece).select(key, F.ceil(F.col("n") / piece).alias("_slices")))
    slices = F.coalesce("_slices", F.lit(1).cast("long"))
    cut = left.join(hot, key, "left").withColumn("_slice", F.pmod(F.xxhash64(*spread), slices)).drop("_slices")
    dealt = right.join(hot, key, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)))
    return cut.join(dealt.drop("_slices").hint("merge"), [key, "_slice"], how).drop("_slice")
