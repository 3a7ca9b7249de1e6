"""Activity, concentration, focus, scoring and trends on literal tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from commitgauge import fixed_values as V
from commitgauge.operators import activity, commits, concentration, focus, packages, scoring, trends


def authors(spark, counts, **columns):
    """Commits of authors a0, a1, ... with the given numbers of commits."""
    rows = [(f"a{i}",) for i, n in enumerate(counts) for _ in range(n)]
    df = spark.createDataFrame(rows, "author string")
    return df.withColumns({k: F.lit(v) for k, v in {"language": "c", "repo": "r", "year": 2000, **columns}.items()})


@pytest.mark.parametrize("counts, expect", [((1, 2, 7), 0.4), ((5,), 0.0), ((4, 4, 4), 0.0)])
def test_gini(spark, counts, expect):
    row = concentration.gini_by(authors(spark, counts), ["language", "year"]).first()
    assert (row.gini, row.n_contributors, row.total_commits) == (pytest.approx(expect), len(counts), sum(counts))


def test_gini_and_shares_against_direct_formula(spark):
    rng = random.Random(3)
    for _ in range(3):
        counts = [rng.choice([1, 1, 1, 2, 3, 5, 8, 13]) for _ in range(rng.randint(2, 40))]
        x, n = sorted(counts), len(counts)
        gini = sum((2 * (i + 1) - n - 1) * v for i, v in enumerate(x)) / (n * sum(x))
        df = authors(spark, counts)
        assert concentration.gini_by(df, ["year"]).first().gini == pytest.approx(gini)
        row = concentration.author_concentration(df, ["year"]).first()
        for k in (1, 3, 5):
            assert row[f"top{k}_pct"] == pytest.approx(100 * sum(x[::-1][:k]) / sum(x))


def test_shares(spark):
    wide = concentration.author_concentration(authors(spark, (7, 2, 1)), ["year"])
    long = {r.rank_group: r.percent for r in concentration.concentration_long(wide, ["year"]).collect()}
    assert long == {"top1_pct": 70.0, "top3_pct": 100.0, "top5_pct": 100.0}


def test_null_author_counts_once(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",), (None,)], "author string").withColumns(
        {"language": F.lit("c"), "year": F.lit(2000)}
    )
    assert activity.contributors(df).first().contributors == 3
    row = activity.traffic(df).first()
    assert (row.contributors, row.commits) == (3, 4)
    assert activity.yearly_activity(df).first().maintainers == 3
    assert concentration.gini_by(df, ["year"]).first().n_contributors == 3


@pytest.mark.parametrize("parts", [1, 16, 256])
def test_author_rank_numbers_everybody(spark, parts):
    counts = [1] * 60 + [2] * 5 + [9]
    df = authors(spark, counts)
    rows = concentration.author_rank(df, ["language", "year"], parts=parts).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 67))
    assert [r.commits for r in rows] == sorted(counts, reverse=True)
    top = concentration.author_rank(df, ["language", "year"], top=7).orderBy("rank").collect()
    assert [(r.author, r["rank"]) for r in top] == [(r.author, r["rank"]) for r in rows[:7]]


def test_top_authors(spark):
    totals = [30] + [5] * 25
    df = authors(spark, totals).groupBy("year", "author").agg(F.count("*").alias("commits"))
    assert concentration.top_authors(df, 20).count() == 26
    assert concentration.top_authors(df, 1).count() == 1
    assert concentration.top_authors_latest(df, 10).count() == 10
    assert concentration.contributor_heatmap(df, 1).first().author == "a0"


def daily(spark):
    rows = [
        ("c", "r", "a", "2000-01-01 10:00:00", 5, 1),
        ("c", "r", "a", "2000-01-01 12:00:00", None, None),
        ("c", "r", "b", "2000-01-02 00:00:00", 2, 4),
        ("c", "r", None, "2001-01-02 00:00:00", 7, 0),
    ]
    df = spark.createDataFrame(rows, "language string, repo string, author string, date string, lines_added bigint, lines_removed bigint")
    return commits.with_year(df.withColumn("date", F.col("date").cast("timestamp")))


def test_cumulative(spark):
    rows = activity.cumulative_net_loc(daily(spark)).orderBy("day").collect()
    assert [(r.net_lines, r.cum_net_lines) for r in rows] == [(4, 4), (-2, 2), (7, 9)]
    strict = activity.cumulative_net_loc(daily(spark), strict_nulls=True).orderBy("day").collect()
    assert [(r.net_lines, r.cum_net_lines) for r in strict] == [(None, None), (-2, None), (7, None)]


def test_changes(spark):
    rows = activity.changes_daily(daily(spark)).orderBy("day").collect()
    assert [(r.author, r.revisions, r.total_loc, r.year) for r in rows] == [
        ("a", 2, 6, 2000), ("b", 1, 6, 2000), (None, 1, 7, 2001),
    ]
    strict = activity.changes_daily(daily(spark), strict_nulls=True).orderBy("day").first()
    assert strict.total_loc is None
    mean = {r.year: (r.avg_revisions, r.n_changes) for r in activity.revisions_per_change(activity.changes_daily(daily(spark))).collect()}
    assert mean == {2000: (1.5, 2), 2001: (1.0, 1)}


def test_pairs_share_a_library(spark):
    rows = [("c", "coreutils", 2000, 5, 1), ("rust", "coreutils", 2000, 9, 2), ("c", "sqlite", 2000, 3, 0), ("c", "other", 2000, 1, 0)]
    df = spark.createDataFrame(rows, "language string, repo string, year int, lines_added bigint, lines_removed bigint")
    pairs = [("coreutils", "coreutils"), ("sqlite", "coreutils")]
    got = {(r.pair, r.language): r.net_loc for r in activity.pair_yearly_net_loc(df, pairs).collect()}
    assert got == {
        ("coreutils / coreutils", "c"): 4, ("coreutils / coreutils", "rust"): 7,
        ("sqlite / coreutils", "c"): 3, ("sqlite / coreutils", "rust"): 7,
    }


def test_fix_ratio(spark):
    rows = [(2000, True)] * 4 + [(2000, False)] * 2 + [(2001, True)] * 3
    df = spark.createDataFrame(rows, "year int, is_bug_fix boolean")
    got = trends.fix_ratio_trend(df).orderBy("year").collect()
    assert [(r.bug_fix_ratio, r.idx) for r in got] == [(2.0, 1), (3.0, 2)]
    assert [r.trend_line for r in got] == [pytest.approx(2.0), pytest.approx(3.0)]


def test_linear_trend(spark):
    series = spark.createDataFrame([(1, 1.0, 2.0), (2, 2.0, 4.0), (3, 2.0, 6.0), (4, 5.0, 8.0)], "year int, y double, exact double")
    got = {r.measure: r for r in trends.linear_trend(series, "year", ["y", "exact"]).collect()}
    # slope 1.2, residual variance 0.9, standard error sqrt(0.18), t = 2.8284 with 2 degrees
    assert got["y"].slope == pytest.approx(1.2)
    assert got["y"].p_value == pytest.approx(1 - (8 / 10) ** 0.5, abs=1e-9)
    assert got["exact"].p_value is None
    assert trends.linear_trend(series.limit(2), "year", ["y"]).first().p_value is None


def test_category_groups(spark):
    rows = [(2000, f"k{i}") for i in range(12) for _ in range(20 - i)]
    df = spark.createDataFrame(rows, "year int, category string")
    got = {r.category: r for r in focus.category_by_year(df).collect()}
    assert len(got) == 10 and got[V.OTHER].n == 11 + 10 + 9
    assert sum(r.share for r in got.values()) == pytest.approx(1.0)


def test_domain_delta_keeps_totals(spark):
    rows = [("c", "a", "D", V.MEMORY)] * 2 + [("c", "a", "D", None)] * 2 + [("rust", "b", "D", V.FEATURE)] + [("c", "x", None, V.LOGIC)]
    df = spark.createDataFrame(rows, "language string, repo string, domain string, category string")
    got = {r.category: (r.c, r.rust, r.delta, r.work_type) for r in focus.domain_delta(df).collect()}
    assert got == {V.MEMORY: (0.5, 0.0, 0.5, "Maintenance"), V.FEATURE: (0.0, 1.0, -1.0, "Feature")}


@pytest.mark.parametrize("low, step", [(0.0, 1e-5), (1e12, 1.0), (-3.0, 1e9)])
def test_quantiles_of_any_range(spark, low, step):
    values = [low + step * i for i in range(3001)]
    rows = spark.createDataFrame([("c", v) for v in values + [math.nan] * 500], "language string, ccs_score double")
    got = scoring.ccs_quartiles(rows.repartition(5)).first()
    assert [got.q25, got.q50, got.q75] == [pytest.approx(values[i]) for i in (750, 1500, 2250)]
    known = rows.where("not isnan(ccs_score)")
    bins = scoring._with_bin(known.crossJoin(
        known.agg(F.percentile_approx("ccs_score", [i / 1024 for i in range(1, 1024)], 10240).alias("_splits"))
    ), "ccs_score", 32).groupBy("_bin").count()
    assert bins.count() > 900 and bins.agg(F.max("count")).first()[0] < 10


def test_quantiles_without_groups(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(5)], "v double")
    assert tuple(scoring.exact_quantiles(rows, "v", []).first()) == (1.0, 2.0, 3.0)


def test_quantiles_against_interpolation(spark):
    rng = random.Random(5)
    values = {"c": [rng.choice([1.0, 1.5, 2.25]) for _ in range(50)], "rust": [rng.uniform(-3, 9) for _ in range(37)], "one": [2.5]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("c", None)]
    df = spark.createDataFrame(rows, "language string, ccs_score double")
    for row in scoring.ccs_quartiles(df).collect():
        ordered = sorted(values[row.language])
        for p in (0.25, 0.5, 0.75):
            at = (len(ordered) - 1) * p
            low = int(at)
            high = min(low + 1, len(ordered) - 1)
            assert row[f"q{round(100 * p)}"] == pytest.approx(ordered[low] + (ordered[high] - ordered[low]) * (at - low))


def test_maintenance_years(spark):
    rows = [("c", 2000, "False", V.LOGIC, 2.0)] * 3 + [("c", 2001, "False", V.LOGIC, 2.0)] * 2 + [("c", 2000, "True", V.FEATURE, 9.0)]
    df = spark.createDataFrame(rows, "language string, year int, is_feature string, category string, ccs_score double")
    assert [tuple(r) for r in scoring.maintenance_ccs_by_year(df).collect()] == [("c", 2000, 2.0, 3)]
    assert [tuple(r) for r in scoring.maintenance_ccs_by_category_year(df).collect()] == [("c", V.LOGIC, 2000, 2.0, 3)]
    burden = df.withColumn("repo", F.lit("r"))
    assert scoring.maintenance_burden(burden).first().burden == 10.0
    assert commits.year_after(df, 2000).count() == 2
    assert commits.drop_null_keys(df, "year").count() == 6


def test_score_join_tells_languages_apart(spark):
    predicted = spark.createDataFrame([("c", "coreutils", "1", 2), ("rust", "coreutils", "1", 3)], "language string, repo string, commit_id string, complexity int")
    sizes = spark.createDataFrame([("c", "coreutils", "1", 10, 100), ("rust", "coreutils", "1", 1, 1)], "language string, repo string, commit_id string, entropy int, churn bigint")
    got = {r.language: r.ccs_score for r in scoring.score_predictions(predicted, sizes, ["commit_id", "repo", "language"]).collect()}
    assert got == {"c": 3.5, "rust": 3.0}


def test_degrees(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("b", "c")], "src string, dst string")
    got = {r.node: (r.in_degree_centrality, r.out_degree_centrality) for r in packages.degree_centrality(edges).collect()}
    assert got == {"a": (0.0, 1.0), "b": (0.5, 0.5), "c": (1.0, 0.0)}
    lonely = spark.createDataFrame([("a", "a")], "src string, dst string")
    assert packages.degree_centrality(lonely).first().in_degree_centrality == 1.0


def test_api_times(spark):
    rows = [("2020-05-01T00:00:00Z", None), ("2020-05-01T00:00:00Z", "2021-01-01T03:00:00+05:00"), ("x", None)]
    df = spark.createDataFrame(rows, "authored_date string, committed_date string")
    got = sorted(r.year for r in commits.api_commit_times(df).collect())
    assert got == [2020, 2020]
    window = commits.date_window(commits.api_commit_times(df), since="2020-06-01", ts="ts")
    assert window.count() == 1
