"""What the physical plans have to look like for large and skewed tables."""

import pytest
from pyspark.sql import functions as F

from commitgauge.checks.queries import QUERIES
from commitgauge.operators import activity, concentration, labels, sampling, scoring

NO_SHUFFLE_OF_TEXT = ("condensed_diff", "commit_stats", "line_counts", "file_changes", "file_kinds", "request_rows", "condensed_history")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loops_and_no_python(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "Pandas" not in text


@pytest.mark.parametrize("name", NO_SHUFFLE_OF_TEXT)
def test_diffs_are_never_shuffled(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "Exchange" not in text


def commits(spark):
    """A third of all rows belongs to one library and to one author."""
    row = spark.range(3000).select(
        F.concat(F.lit("id"), "id").alias("commit_id"),
        F.lit("c").alias("language"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), (F.col("id") % 50))).alias("repo"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("a"), (F.col("id") % 700))).alias("author"),
        F.lit(2000).alias("year"),
        F.lit("fix").alias("message"),
        F.lit("d").alias("diff"),
        F.col("id").alias("ordinal"),
        (F.col("id") % 7).cast("double").alias("ccs_score"),
    )
    return row


def test_bounded_rankings_cut_before_the_shuffle(spark):
    df = commits(spark)
    assert "WindowGroupLimit" in plan(concentration.author_rank(df, ["repo"], top=3))
    assert "WindowGroupLimit" in plan(labels.tail_rewrite(df, "repo", "ordinal"))
    assert "WindowGroupLimit" in plan(sampling.gold_sample(df))


def test_text_stays_out_of_sampling_rankings(spark, tmp_path):
    path = str(tmp_path / "commits")
    commits(spark).write.parquet(path)
    text = plan(sampling.gold_sample(spark.read.parquet(path)))
    rankings = [line for line in text.splitlines() if "Window [" in line or "WindowGroupLimit" in line]
    assert rankings and not any("message" in line or "diff#" in line for line in rankings)


@pytest.fixture()
def wide_tables(spark, tmp_path):
    """Stored rows with wide text, and no automatic broadcasts."""
    path = str(tmp_path / "rows")
    rows = commits(spark).withColumn("label_category", F.col("language")).withColumn("label_reasoning", F.col("message"))
    rows.write.parquet(path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark.read.parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_wide_rows_stay_where_they_are(wide_tables):
    for df in (
        labels.tail_rewrite(wide_tables, "repo", "ordinal"),
        labels.reasons_by_label(wide_tables),
        sampling.gold_sample(wide_tables),
    ):
        text = plan(df)
        assert "SortMergeJoin [repo" not in text and "SortMergeJoin [label" not in text
        assert text.count("BroadcastHashJoin") >= 1
    final = plan(sampling.gold_sample(wide_tables)).split("BroadcastHashJoin")[0]
    assert final.count("Exchange") <= 1  # chosen rows alone, to drop repeated ones


def test_history_reads_a_diff_once(spark, sf_dir):
    from commitgauge.checks.adapters import diffs_v
    from commitgauge.operators.diffs import condense_diffs
    from commitgauge.plans.history import condensed_commits

    def readings(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("@@ -([0-9]+)")

    history = diffs_v(spark, sf_dir)
    assert readings(condensed_commits(history)) == readings(condense_diffs(history))


def test_one_join_for_scores(spark, sf_dir):
    text = QUERIES["scored_predictions"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join Inner") + text.count("Join Left") <= 8


def test_skewed_results_are_whole(spark):
    df = commits(spark)
    ranks = concentration.author_rank(df, ["language"])
    assert ranks.count() == df.select("author").distinct().count()
    assert ranks.agg(F.max("rank")).first()[0] == ranks.count()
    assert activity.author_year_counts(df).agg(F.sum("commits")).first()[0] == 3000
    hot = concentration.author_concentration(df, ["language", "year"]).first()
    assert hot.top1_pct == pytest.approx(100 / 3)
    tail = labels.tail_rewrite(df, "repo", "ordinal", n=20).where("is_synthetic_commit_id").groupBy("repo").count()
    assert {r["count"] for r in tail.collect()} == {20}
    quartiles = scoring.ccs_quartiles(df, ("repo",)).where("repo = 'hot'").first()
    assert (quartiles.q25, quartiles.q50, quartiles.q75) == (1.0, 3.0, 5.0)
