"""Joins by a checked size and joins of hot keys."""

import pytest
from pyspark.sql import functions as F

from commitgauge.operators import activity, joins, labels, sampling


@pytest.fixture()
def rows(spark):
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 50).cast("string"))
    return spark.range(6000).select("id", key.alias("k"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_join_gives_the_rows_of_a_join(rows, how):
    short = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low")).where("k is null or k <> '1'")
    ours = joins.hot_join(rows, short.select("k", "low"), "k", ["id"], short, 6000, how, parts=64, least=10)
    plain = rows.join(short.select("k", "low"), "k", how)
    assert sorted(ours.select("id", "k", "low").collect(), key=str) == sorted(plain.select("id", "k", "low").collect(), key=str)


def test_hot_join_of_nothing(rows):
    none = rows.where("id < 0")
    counts = none.groupBy("k").count().withColumnRenamed("count", "n")
    assert joins.hot_join(none, counts, "k", ["id"], counts, 0).count() == 0


def test_hot_keys_are_cut(rows):
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    joined = joins.hot_join(rows, counts, "k", ["id"], counts, 6000, parts=64, least=10)
    text = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [k#" in text and "_slice#" in text.split("SortMergeJoin [k#")[1].split("\n")[0]


def test_broadcast_only_under_the_bound(spark, rows):
    small = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    keys = rows.select("k")

    def hinted(df):
        return "broadcast" in df._jdf.queryExecution().logical().toString().lower()

    assert hinted(joins.broadcast_if_short(small, keys))
    assert not hinted(joins.broadcast_if_short(small, keys, most=10))
    assert not hinted(joins.broadcast_if_short(small, keys, rows_per_key=100, most=1000))


def test_results_are_the_same_beyond_the_bound(spark, monkeypatch):
    df = spark.range(300).select(
        F.col("id").cast("string").alias("commit_id"), F.col("id").alias("ordinal"), (F.col("id") % 9).cast("string").alias("repo"),
        F.lit("py").alias("language"), F.lit("fix memory leak").alias("message"), F.lit("free(x)").alias("diff"),
        (F.col("id") % 4).cast("string").alias("label_category"), F.lit("why").alias("label_reasoning"),
    )

    def results():
        tables = labels.tail_rewrite(df, "repo", "ordinal"), labels.reasons_by_label(df), sampling.gold_sample(df, cap=5)
        return [sorted(map(str, t.select(sorted(t.columns)).collect())) for t in tables]

    short = results()
    monkeypatch.setattr(joins.broadcast_if_short, "__defaults__", (1, 2))
    assert results() == short


def test_deal_grows_the_tasks_with_the_rows(spark):
    rows = spark.range(1000).selectExpr("id % 7 AS k", "id")
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert joins.deal(rows, None, "k") is rows and joins.deal(rows, 1000, "k", per_task=1000) is rows
    dealt = joins.deal(rows, 1000, "k", per_task=10)
    assert dealt.rdd.getNumPartitions() == 100 > session
    assert sorted(dealt.collect()) == sorted(rows.collect())


def test_file_changes_are_grouped_in_as_many_tasks_as_they_need(spark):
    """The join's and the grouping's exchanges grow with the rows, whatever the session's number of partitions."""
    row = (
        "IF(id % 3 < 9, 'c', 'd') AS language, IF(id % 3 < 9, 'r', 's') AS repo, IF(id % 2 = 0, 'a', NULL) AS author, "
        "CAST(id % 5 AS string) AS file, timestamp_seconds(id % 10) AS date"
    )
    df = spark.sql(f"SELECT {row} FROM range(100)")
    plan = activity.changes_by_file(df, rows=30 * joins.ROWS_PER_TASK)._jdf.queryExecution().executedPlan().toString()
    assert ", 30), REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
    few = sorted(map(str, activity.changes_by_file(df).collect()))
    assert sorted(map(str, activity.changes_by_file(df, rows=30 * joins.ROWS_PER_TASK).collect())) == few and len(few) == 10
