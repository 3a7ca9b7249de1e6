"""Trends and regressions over small yearly series and over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from commitgauge.functions import stats as S
from commitgauge.functions import text as X


def linear_trend(series: DataFrame, x: str, measures: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Slope, intercept and two-sided p-value of each measure over ``x``.

    ``series`` is a yearly table: the p-value takes work that grows with its rows.
    """
    long = series.select(
        *by,
        F.col(x).cast("double").alias("_x"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("y"))
                    for m in measures
                ]
            )
        ).alias("_m"),
    ).select(*by, "_m.measure", "_x", F.col("_m.y").alias("_y"))
    fitted = long.groupBy(*by, "measure").agg(
        F.regr_count("_y", "_x").alias("n"),
        F.regr_slope("_y", "_x").alias("slope"),
        F.regr_intercept("_y", "_x").alias("intercept"),
        F.regr_sxx("_y", "_x").alias("_sxx"),
        F.regr_syy("_y", "_x").alias("_syy"),
        F.regr_sxy("_y", "_x").alias("_sxy"),
    )
    p_value = S.slope_p_value(F.col("n"), F.col("_sxx"), F.col("_syy"), F.col("_sxy"))
    return fitted.withColumn("p_value", p_value).drop("_sxx", "_syy", "_sxy")


def with_year_index(series: DataFrame, by: Sequence[str] = (), year: str = "year") -> DataFrame:
    """Number the rows of a yearly series from 1, in each group."""
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    return series.withColumn("idx", F.row_number().over(group.orderBy(year)))


def fitted_line(
    series: DataFrame, x: str, y: str, into: str = "trend_line", by: Sequence[str] = ()
) -> DataFrame:
    """Add the value of the fitted line at every row of a yearly series."""
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    x_, y_ = F.col(x).cast("double"), F.col(y).cast("double")
    slope, intercept = F.regr_slope(y_, x_).over(group), F.regr_intercept(y_, x_).over(group)
    return series.withColumn(into, intercept + slope * x_)


def grouped_regression(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """One fitted line per group, as a single aggregation, with the slope's standard error and two-sided p-value
    (NULL below three points; the p-value also for an exact fit). The p-value takes the same work for any group size."""
    fitted = df.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_count(y, x).alias("n"),
        F.regr_sxx(y, x).alias("_sxx"),
        F.regr_syy(y, x).alias("_syy"),
        F.regr_sxy(y, x).alias("_sxy"),
    )
    sums = [F.col(c) for c in ("n", "_sxx", "_syy", "_sxy")]
    return fitted.withColumns(
        {"slope_error": S.slope_error(*sums), "p_value": S.slope_p_value(*sums)}
    ).drop("_sxx", "_syy", "_sxy")


def yearly_fix_ratio(df: DataFrame, flag: str = "is_bug_fix", by: Sequence[str] = ()) -> DataFrame:
    """Fixes per other commit and year (the plain number of fixes where there is no other).

    Rows without flag or year take no part.
    """
    known = df.where(F.col(flag).isNotNull() & F.col("year").isNotNull())
    counts = known.groupBy(*by, "year").agg(
        F.count_if(F.col(flag)).alias("bug_fixes"), F.count_if(~F.col(flag)).alias("other_commits")
    )
    fixes, others = F.col("bug_fixes").cast("double"), F.col("other_commits")
    return counts.withColumn("bug_fix_ratio", F.when(others > 0, fixes / others).otherwise(fixes))


def fix_ratio_trend(df: DataFrame, flag: str = "is_bug_fix", by: Sequence[str] = ()) -> DataFrame:
    indexed = with_year_index(yearly_fix_ratio(df, flag, by), by)
    return fitted_line(indexed, "idx", "bug_fix_ratio", by=by)


def first_last_change(series: DataFrame, measures: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Percent change of each measure from the first to the last year."""
    changes = [
        X.percent_change(F.min_by(m, "year"), F.max_by(m, "year")).alias(f"{m}_change")
        for m in measures
    ]
    years = X.format_range(F.min("year"), F.max("year")).alias("years")
    return series.groupBy(*by).agg(years, *changes)
