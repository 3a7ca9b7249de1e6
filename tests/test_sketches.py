"""Contributors from stored sketches against the exact count, at sizes below and beyond the sketch's exact range."""

import math

from pyspark.sql import functions as F

from commitgauge.checks import adapters as V
from commitgauge.operators import activity, sketches


def test_sketches_equal_exact_counts_below_their_range(spark, sf_dir):
    commits = V.commits_v(spark, sf_dir)
    exact = {(r.language, r.year): r.contributors for r in activity.contributors(commits, "language").collect()}
    stored = sketches.author_sketches(commits)
    found = {(r.language, r.year): r.contributors for r in sketches.contributors_from(stored, ["language", "year"]).collect()}
    assert found == exact
    by_repo = {(r.repo, r.year): r.contributors for r in activity.contributors(commits, "repo").collect()}
    assert {(r.repo, r.year): r.contributors for r in sketches.contributors_from(stored, ["repo", "year"]).collect()} == by_repo


def test_large_unions_stay_within_the_error_bound(spark):
    rows = spark.range(400_000).select(
        F.lit("c").alias("language"), (F.col("id") % 7).cast("string").alias("repo"),
        F.when(F.col("id") % 1000 == 0, None).otherwise((F.col("id") % 150_000).cast("string")).alias("author"),
        F.make_date(F.lit(2020), (F.col("id") % 12 + 1).cast("int"), F.lit(1)).cast("timestamp").alias("date"),
    )
    found = sketches.contributors_from(sketches.author_sketches(rows), ["language"]).first()
    exact = 150_000 + 1  # every author, and one more for the commits without one
    assert abs(found.contributors - exact) <= 3 * 1.04 / math.sqrt(1 << sketches.LG_BUCKETS) * exact
    assert found.commits == 400_000


def test_quartiles_from_sketches_lie_within_the_rank_error(spark):
    rng = __import__("numpy").random.default_rng(5)
    values = rng.lognormal(1.0, 0.7, 60_000)
    rows = [("c" if i % 3 else "rust", f"r{i % 9}", f"2021-0{1 + i % 9}-1{i % 10}", float(v)) for i, v in enumerate(values)]
    rows += [("c", "r0", "2021-01-10", None), ("c", "r0", "2021-01-10", float("nan"))]
    df = spark.createDataFrame(rows, "language string, repo string, day string, v double").withColumn("date", F.to_timestamp("day"))
    found = {r.language: r for r in sketches.quantiles_from(sketches.value_sketches(df, "v"), ["language"]).collect()}
    error = 1.65 / sketches.KLL_K * 2  # twice the normalised rank error of a sketch
    for language, picked in (("c", values[[i % 3 != 0 for i in range(60_000)]]), ("rust", values[::3])):
        ordered = sorted(picked)
        assert found[language].n == len(picked)
        for p in (0.25, 0.5, 0.75):
            rank = sum(1 for v in ordered if v <= found[language][f"q{round(100 * p)}"]) / len(ordered)
            assert abs(rank - p) <= error
