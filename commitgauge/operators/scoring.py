"""Complexity scores of classified commits and what is read off them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from commitgauge.functions import stats as S
from commitgauge.functions import text as X
from commitgauge.operators.commits import maintenance_only
from commitgauge.operators.focus import count_by


def score_predictions(
    predictions: DataFrame,
    metadata: DataFrame,
    on: Sequence[str] = ("commit_id", "repo"),
    plus_one: bool = False,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Join sizes to predictions and add the score; ``carry`` names more metadata columns to keep.

    Give ``language`` as a further key where both sides have it, since one
    project name may exist in both languages.
    """
    on = list(on)
    sizes = metadata.select(*on, "entropy", "churn", *carry)
    score = S.ccs_score(F.col("complexity"), F.col("entropy"), F.col("churn"), plus_one=plus_one)
    return predictions.join(sizes, on, "inner").withColumn("ccs_score", score)


def with_commit_year(scored: DataFrame, commits: DataFrame, on: Sequence[str] = ("commit_id", "repo")) -> DataFrame:
    """Add the year a commit was authored, for scores without metadata at hand.

    Where they are, carry ``year`` through ``score_predictions`` and save this join. A key
    repeated in ``commits`` repeats its rows.
    """
    on = list(on)
    return scored.join(commits.select(*on, F.year("date").alias("year")), on, "inner")


def avg_ccs(scored: DataFrame) -> DataFrame:
    worked = scored.withColumn("work_type", X.work_type(F.col("category")))
    return worked.groupBy("work_type", "category", "language").agg(F.avg("ccs_score").alias("avg_ccs"))


def _join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beside the figures of their group; a missing key is a group too."""
    v, g = rows.alias("v"), groups.alias("g")
    same = [F.col(f"v.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys]
    figures = [f"g.{c}" for c in groups.columns if c not in keys]
    return v.join(g, same).select("v.*", *figures)


def _with_bin(rows: DataFrame, value: str, side: int) -> DataFrame:
    """Add the number of split points up to the value, found in two steps of about ``side`` comparisons."""

    def upto(points: Column) -> Column:
        return F.size(F.filter(points, lambda p: p <= F.col(value)))

    marks = F.transform(F.sequence(F.lit(1), F.lit(side - 1)), lambda i: F.get(F.col("_splits"), i * side - 1))
    coarse = rows.withColumn("_coarse", upto(marks) * side)
    fine = upto(F.slice("_splits", F.col("_coarse") + 1, F.lit(side)))
    return coarse.withColumn("_bin", F.col("_coarse") + fine).drop("_coarse")


def exact_quantiles(
    df: DataFrame,
    value: str,
    by: Sequence[str],
    probs: Sequence[float] = (0.25, 0.5, 0.75),
    side: int = 32,
) -> DataFrame:
    """Quantiles with linear interpolation, one column ``q<percent>`` per probability.

    Missing and NaN values take no part. Counts per distinct value come first, so
    repeated values cost one row. Approximate quantiles of the distinct values cut
    each group into ``side`` squared bins of about equal numbers of values, whatever
    their range; exact counts then tell in which bin each wanted position lies, and
    values are only numbered inside those bins.
    """
    by = list(by)
    if not by:
        whole = df.withColumn("_all", F.lit(1))
        return exact_quantiles(whole, value, ["_all"], probs, side).drop("_all")
    usable = F.col(value).isNotNull() & ~F.isnan(F.col(value))
    values = count_by(df.where(usable), *by, value, name="_n")
    cuts = side * side
    splits = values.groupBy(*by).agg(
        F.percentile_approx(value, [i / cuts for i in range(1, cuts)], 10 * cuts).alias("_splits")
    )
    values = _with_bin(_join_groups(values, splits, by), value, side).drop("_splits")
    bins = values.groupBy(*by, "_bin").agg(F.sum("_n").alias("_in_bin"))
    group = W.partitionBy(*by)
    sized = bins.withColumns(
        {
            "_upto": F.sum("_in_bin").over(
                group.orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)
            ),
            "_total": F.sum("_in_bin").over(group),
        }
    ).withColumn("_before", F.col("_upto") - F.col("_in_bin"))

    last = F.col("_total") - 1
    positions = [p for prob in probs for p in (F.floor(last * prob), F.ceil(last * prob))]
    inside = [(p >= F.col("_before")) & (p < F.col("_upto")) for p in positions]
    needed = sized.where(F.array_contains(F.array(*inside), True)).drop("_in_bin", "_upto")
    keys = [*by, "_bin"]
    numbered = _join_groups(values, needed, keys)
    within = F.sum("_n").over(
        W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    )
    placed = numbered.withColumn("_last", F.col("_before") + within - 1).withColumn(
        "_first", F.col("_last") - F.col("_n") + 1
    )

    def at(position):
        hit = (position >= F.col("_first")) & (position <= F.col("_last"))
        return F.max(F.when(hit, F.col(value)))

    def quantile(prob: float):
        exact = (F.max("_total") - 1) * prob
        low, high = at(F.floor(last * prob)), at(F.ceil(last * prob))
        return (low + (high - low) * (exact - F.floor(exact))).alias(f"q{round(100 * prob)}")

    return placed.groupBy(*by).agg(*[quantile(p) for p in probs])


def ccs_quartiles(scored: DataFrame, by: Sequence[str] = ("language",)) -> DataFrame:
    return exact_quantiles(scored, "ccs_score", by)


def maintenance_ccs_by_year(
    scored: DataFrame, by: Sequence[str] = ("language",), flag: str = "is_feature", min_commits: int = 3
) -> DataFrame:
    """Yearly mean score of maintenance commits, for years with enough of them."""
    yearly = maintenance_only(scored, flag).groupBy(*by, "year").agg(
        F.avg(F.nanvl("ccs_score", F.lit(None).cast("double"))).alias("avg_ccs_score"),
        F.count(F.lit(1)).alias("n_commits"),
    )
    return yearly.where(F.col("n_commits") >= min_commits)


def maintenance_ccs_by_category_year(scored: DataFrame, min_commits: int = 3) -> DataFrame:
    known = scored.dropna(subset=["category", "year", "ccs_score"])
    return maintenance_ccs_by_year(known, ("language", "category"), "category", min_commits)


def maintenance_burden(scored: DataFrame, by: Sequence[str] = ("language", "repo")) -> DataFrame:
    """Summed score of maintenance commits."""
    return maintenance_only(scored).groupBy(*by).agg(
        F.sum("ccs_score").alias("burden"), F.count(F.lit(1)).alias("n_commits")
    )


def library_summary(df: DataFrame, n: int = 10) -> DataFrame:
    """Commits, years and commits per year of the ``n`` largest libraries."""
    totals = df.where(F.col("year").isNotNull()).groupBy("language", "repo").agg(
        F.count(F.lit(1)).alias("total_commits"),
        F.min("year").alias("min_year"),
        F.max("year").alias("max_year"),
    )
    span = F.col("max_year") - F.col("min_year") + 1
    return (
        totals.orderBy(F.desc("total_commits"), "language", "repo")
        .limit(n)
        .select(
            "language",
            "repo",
            "total_commits",
            X.format_range(F.col("min_year"), F.col("max_year")).alias("year_range"),
            F.round(F.col("total_commits") / span, 2).alias("avg_commits_per_year"),
        )
    )
